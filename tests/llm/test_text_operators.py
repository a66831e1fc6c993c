"""Operators on documents against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from helper import same_rows
from folioframe.llm import bloom_lm, bpe, convnet, merkle, mixing, ngram_join, queries
from folioframe.llm._spark import checkpointed
from folioframe.llm._words import STEP_BYTES, shingles, steps, word_hashes

RANKS = P.path(queries.RANKS)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_word_hashes():
    texts = ["", "a  B\tc", "Ab ab AB", " \n", "日本 a\x0bb", "x" * (STEP_BYTES + 5)]
    seen: dict = {}
    for first, held in steps(t.encode() for t in texts):
        hashes, off = word_hashes(held)
        for k in range(len(held)):
            own = hashes[off[k] : off[k + 1]].tolist()
            assert len(own) == len(words_of(texts[first + k]))
            for w, h in zip(words_of(texts[first + k]), own):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# byte-level BPE


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.load_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_merges_like_the_reference_library(encoder, reference):
    rng = random.Random(3)
    pool = [32, 10, 9, 97, 98, 101, 116, 48, 0x1F600, 0x300, 0x4E00, 0x660, 0x2028, 0xA0, 0x1680, 0x200B, 39, 46, 0x1C]
    texts = ["", "a", " " * 50, "ab" * 3000, "q" * 129, "'s't ''ll I'LL", "<|endoftext|>"] + ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(400))) for _ in range(150)]
    for t, ids in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert encoder.encoder.decode(ids) == t.encode()


def test_bpe_long_and_wide_trees_agree(encoder):
    rng = random.Random(4)
    for n in (2, 3, 17, 64, 128):
        piece = bytes(rng.choice(b"aetinos r") for _ in range(n))
        assert encoder.encoder._merge_one(piece) == encoder.encoder._merge_rows([piece], max(2, 1 << (n - 1).bit_length()))[0]


def test_bpe_query(spark, data, reference):
    got = {r["doc_id"]: r for r in queries.op10_bpe(spark, data).collect()}
    for r in documents(spark, data).collect():
        ids = reference.encode_ordinary(r["text"])
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_bpe_edges(spark, edge, none):
    ids = bpe.encode(edge, RANKS, P.PATTERN)
    back = bpe.decode(ids, RANKS)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in edge.collect())
    assert bpe.encode(none, RANKS, P.PATTERN, digests=True).collect() == []


# mixing


def test_mixing_query(spark, data, duck):
    same_rows(queries.op3_mixing(spark, data), duck.sql(queries.ORACLES["op3_mixing"]))


def test_mixing_reaches_targets_and_caps(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "hot" if k % 3 else f"s{k % 12}") for k in range(6000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
    assert sum(v[0]["target"] for v in by.values()) == pytest.approx(total)
    for own in by.values():
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_mixing_of_null_ids_and_empty_rows(spark):
    rows = [(None, f"{'w ' * (1 + k % 3)}n{k}", "a") for k in range(300)] + [(7, f"x{k}", "b") for k in range(90)] + [(k, "", "b") for k in range(60)] + [(900 + k, None, "b") for k in range(40)] + [(2000 + k, "y " * 9, "c") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {s: docs.where(F.col("source") == s) for s in "abc"}
    taken = {r["source_size"]: (r["target"], r["t"]) for r in mixing.mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(target - got) <= 9 for target, got in taken.values()) and len(taken) == 3
    number = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.apply_plan(docs).collect())
    assert max(number.values()) <= 3 and by["b"].count() == 190


def test_mixing_edges(spark, edge, none):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and all(r["size"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    taken = {}
    for r in rows:
        taken[r["doc_id"], r["size"]] = r["taken"] // max(1, r["size"])
    mixed = mixing.apply_plan(edge)
    assert mixed.columns == edge.columns
    counts = Counter((r["doc_id"], len(words_of(r["text"]))) for r in mixed.where(F.length(F.trim("text")) > 0).collect())
    rows_of = Counter((r["doc_id"], len(words_of(r["text"]))) for r in edge.collect())
    assert all(counts[k] == n * rows_of[k] for k, n in taken.items() if k[1])
    assert mixing.mix(none).collect() == [] and mixing.apply_plan(none).collect() == []


# n-gram Jaccard join


def brute_links(rows, words, num, den):
    sets = []
    for _, t in rows:
        w = words_of(t)
        n = min(words, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)), links[k]) for k, (i, _) in enumerate(rows))


def joined(df, *args):
    return Counter((r["id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.link(df, *args).collect())


@pytest.mark.parametrize("args", [(3, 9, 10), (5, 8, 10), (1, 1, 2)])
def test_join_against_brute_force(spark, args):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 40, 90]))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(230):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(t + (passage if rng.random() < 0.3 else []))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, *args) == brute_links(rows, *args)


def test_join_deals_a_large_group_into_chunks(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(400):
        t = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows, 3, 9, 10)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    assert joined(df, 3, 9, 10) == want
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)  # more classes than the filter has room for
    assert joined(df, 3, 9, 10) == want


def test_join_of_sizes_at_the_edge(spark):
    """Sets whose sizes differ by exactly the factor that links still allow."""
    rows = []
    for n in (10, 20, 40, 100, 250):
        words = [f"s{n}w{k}" for k in range(n + 4)]
        rows += [(len(rows) + k, " ".join(words[: m + 4])) for k, m in enumerate((n, n * 8 // 10, n * 8 // 10 - 1))]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), 5, 8, 10) == brute_links(rows, 5, 8, 10)


def test_join_sends_copies_once(spark):
    """Copies of every text, with ids of their own, null ids and repeated ids."""
    texts = [" ".join(f"c{k}w{j % (17 + k)}" for j in range(30)) for k in range(12)] + [" ".join(f"c0w{j % 17}" for j in range(29))]
    rows = [(k * 100 + c if k % 3 else None if c % 2 else k, t) for k, t in enumerate(texts) for c in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert joined(df, 3, 9, 10) == brute_links(rows, 3, 9, 10)


def test_join_edges(spark, edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert joined(edge, 3, 90, 100) == brute_links(rows, 3, 90, 100)
    assert ngram_join.link(none).collect() == []


def shuffled(spark):
    """Bytes that the session's executors have written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_join_sends_no_more_for_more_ranges(spark, monkeypatch):
    """As a corpus grows, a class's shingles are dealt over more ranges, here to two in each; what is sent for a shingle must stay bounded."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"u{rng.randrange(10**9)}" for _ in range(802))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in ("COUNTED", "COUNTED_NARROW"):
        monkeypatch.setattr(ngram_join, bound, 1_200, raising=False)
    before = shuffled(spark)
    assert joined(df, 3, 90, 100) == {(k, 800, k, 0): 1 for k in range(600)}
    assert shuffled(spark) - before < 9 * (600 * 800 / 4)


def test_join_with_numbers_of_eight_bytes(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(120):
        t = [f"n{k % 6}w{j}" for j in range(50)]
        t[rng.randrange(50)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "NARROW", 40)
    monkeypatch.setattr(ngram_join, "COUNTED", 500)
    assert joined(df, 3, 8, 10) == brute_links(rows, 3, 8, 10)


def test_counts_of_32_bits_lose_no_shared_shingle():
    """Shingles that agree in the bits that are sent count as shared, copies from other tasks do not."""
    base = np.array([5, 6, 1 << 40, 1 << 63, 2**64 - 1], np.uint64)
    one, two = (np.append(base, np.uint64(x)) for x in (1 << 50, 1 << 51))
    alone = np.array([1 << 45, 1 << 46, 1 << 62], np.uint64)
    for parts in (1, 3):
        width = 2**64 // parts + 1
        sets = [np.sort(s) for s in (one, two, alone)]
        rows = [r for _ in range(2) for r in ngram_join._sent(enumerate(sets), parts, width, 2**64, True)]
        shared = Counter()
        for p in range(parts):
            own = [r for r in rows if r["p"] == p]
            if own:
                _, owner, number, fps = ngram_join._counted(pa.Table.from_pylist(own, ngram_join._DEALT), np.uint32)
                shared.update(fps[owner[number > 1]].tolist())
        got = [shared[ngram_join.set_fingerprint(s)] for s in sets]
        assert got == [5, 5, 0]


def test_trie_finds_all_overlaps():
    rng = np.random.default_rng(8)
    sim = ngram_join.Similarity(8, 10)
    for _ in range(20):
        base = rng.choice(300, 40, replace=False)
        sets = []
        for _ in range(40):
            own = set(base.tolist()) - set(rng.choice(base, rng.integers(0, 6)).tolist()) | set(rng.integers(300, 330, rng.integers(0, 5)).tolist())
            sets.append(np.array(sorted(own), np.uint64))
        sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        want = {(a, b) for a in range(40) for b in range(a) if sim.linked(len(np.intersect1d(sets[a], sets[b])), int(sizes[a]), int(sizes[b]))}
        got = [(max(a, b), min(a, b)) for a, b, _ in ngram_join.join_group(sets, sizes, sim)]
        assert len(got) == len(set(got)) and set(got) == want


def test_shingles_of_short_texts():
    hashes, _ = word_hashes([b"a b"])
    assert len(shingles(hashes, 3)) == 1 and len(shingles(hashes[:0], 3)) == 0
    assert shingles(hashes, 3)[0] != shingles(hashes[::-1], 3)[0]


# language model


def test_lm_counts_and_base(spark, data):
    got = {r["doc_id"]: r for r in queries.op8_bloom_lm(spark, data).collect()}
    tokens = {r["doc_id"]: [*words_of(r["text"]), "\n"] for r in documents(spark, data).collect()}
    c = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ts), sum(c[t] > 0 for t in ts), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    held = [g for g in got.values() if g["held_out"]]
    assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_lm_filter_levels_and_probabilities():
    rng = np.random.default_rng(1)
    text = [" ".join(f"t{int(x)}" for x in rng.zipf(1.4, 4000) % 300).encode()]
    tokens, before, _ = bloom_lm.token_runs(text)
    words, wc = np.unique(tokens, return_counts=True)
    pairs, pc = np.unique(bloom_lm.pair_hashes(before, tokens) & bloom_lm._LOW48, return_counts=True)
    held = bloom_lm.segment(words, wc, pairs, pc, 0).tobytes()
    model = bloom_lm.Model(len(tokens), len(words), int((wc == 1).sum()), 0, np.zeros(1), np.array([8 * len(held)]), held)
    zero = np.zeros(len(words), np.int64)
    got = model.levels(words, zero, 0)
    assert (got >= bloom_lm.word_level(wc)).all() and (got == bloom_lm.word_level(wc)).mean() > 0.9
    deep = model.levels(pairs, np.zeros(len(pairs), np.int64), 1)
    assert (deep >= bloom_lm.pair_level(pc, 0)).all() and (deep == bloom_lm.pair_level(pc, 0)).mean() > 0.9
    # probabilities of all words after one history, and of the unknown class, do not exceed 1 (but for false positives)
    history = words[np.argmax(wc)]
    level = model.levels(words, zero, 0)
    low, high = 2.0 ** ((level - 1) / 4), 2.0 ** (level[np.argmax(wc)] / 4)
    after = model.levels(bloom_lm.pair_hashes(np.full(len(words), history), words) & bloom_lm._LOW48, zero, 1)
    share = bloom_lm.WEIGHT * high / (high + bloom_lm.PULL)
    total = (share * np.where(after >= 0, 2.0**after / high, 0) + (1 - share) * (1 - model.unknown) * low / model.total).sum() + (1 - share) * model.unknown
    assert total <= 1.03


def brute_scores(texts, train):
    """Scores from exact counts, quantised as the filter quantises them."""
    tokens = [[*words_of(t), "\n"] for t in texts]
    pairs = [list(zip(["\n", *t], t)) for t in tokens]
    c = Counter(x for k in train for x in tokens[k])
    c2 = Counter(x for k in train for x in pairs[k])
    n = sum(c.values())
    unknown = min(max(sum(v == 1 for v in c.values()) / n, 1 / (n + 1)), 0.5)
    step = lambda w: math.floor(4 * math.log2(c[w]) + 1e-9)
    out = []
    for t in pairs:
        s = 0.0
        for h, w in t:
            one = (1 - unknown) * 2 ** (step(w) / 4) / n if c[w] else unknown
            high = 2 ** ((step(h) + 1) / 4) if c[h] else 0
            share = bloom_lm.WEIGHT * high / (high + bloom_lm.PULL)
            both = min(1.0, 2 ** math.floor(math.log2(c2[h, w])) / high) if c2[h, w] and high else 0
            s += math.log10(share * both + (1 - share) * one)
        out.append(s)
    return out


def test_lm_scores_against_brute_force(spark, data):
    docs = documents(spark, data)
    rows = docs.collect()
    want = brute_scores([r["text"] for r in rows], [k for k, r in enumerate(rows) if zlib.crc32(str(r["doc_id"]).encode()) % 10])
    want = {r["doc_id"]: s for r, s in zip(rows, want)}
    # with room for 200 bits an entry the filter errs hardly ever, and with its own size little
    for entry_bits, least in ((200, 1e-9), (bloom_lm.ENTRY_BITS, 0.02)):
        got = {r["id"]: r["score"] for r in bloom_lm.score(docs, entry_bits=entry_bits).collect()}
        assert np.mean([abs(got[i] - s) <= least * abs(s) for i, s in want.items()]) > 0.95
    # segments that are too many for a copy on every executor give the same scores
    apart = {r["id"]: r for r in bloom_lm.score(docs, most=0).collect()}
    assert {i: r["score"] for i, r in apart.items()} == pytest.approx(got, rel=1e-12)
    assert all(r["n_known"] <= r["n_tokens"] == len(words_of(x["text"])) + 1 for x in rows for r in [apart[x["doc_id"]]])


def test_lm_edges(spark, edge, none):
    rows = bloom_lm.score(edge, folds=10).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert math.isfinite(r["score"]) and math.isfinite(r["base_score"]) and r["n_tokens"] >= 1
    same = [(r["score"], r["base_score"], r["n_known"]) for r in rows if r["id"] == 7]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])
    assert bloom_lm.score(none).collect() == [] and bloom_lm.score(none, most=0).collect() == []
    apart = bloom_lm.score(edge, folds=10, most=0).collect()
    assert sorted(round(r["score"], 9) for r in apart) == sorted(round(r["score"], 9) for r in rows)


def test_lm_filter_grows_with_its_entries(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 2000) % 3000) for _ in range(4)]
    tokens, before, _ = bloom_lm.token_runs([t.encode() for t in texts])
    model = bloom_lm.train(checkpointed(bloom_lm.count(spark.createDataFrame([(t,) for t in texts], "t string"), 8)), 8)
    words, wc = np.unique(tokens, return_counts=True)
    got = model.levels(words, bloom_lm.range_of(words, 8), 0)
    assert (got >= bloom_lm.word_level(wc)).all() and (got == bloom_lm.word_level(wc)).mean() > 0.9
    pairs, pc = np.unique(bloom_lm.pair_hashes(before, tokens), return_counts=True)
    deep = model.levels(pairs & bloom_lm._LOW48, bloom_lm.range_of(pairs, 8), 1)
    assert (deep >= bloom_lm.pair_level(pc, 0)).all() and (deep == bloom_lm.pair_level(pc, 0)).mean() > 0.9


def test_lm_pairs_seen_once_count(spark):
    model = bloom_lm.train(checkpointed(bloom_lm.count(spark.createDataFrame([("a b c d a c",), ("a d b",)], "t string"), 8)), 8)
    tokens, before, _ = bloom_lm.token_runs([b"b c", b"c b"])  # 'b c' was seen once, 'c b' never
    pairs = bloom_lm.pair_hashes(before, tokens)
    assert model.levels(pairs & bloom_lm._LOW48, bloom_lm.range_of(pairs, 8), 1).tolist()[1::3] == [0, -1]
    once, never = (model.scores([t])[1][0] for t in (b"a b c", b"a c b"))
    assert once > never


def test_lm_needs_no_training_text(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = bloom_lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 3)


# fingerprints


def test_merkle_query(spark, data):
    rows = documents(spark, data).orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in queries.op9_merkle(spark, data).collect()}
    by_text = {}
    for k, r in enumerate(rows):
        t, following = r["text"], rows[(k + 1) % len(rows)]["text"]
        cut = len(t) // 4
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()
        assert by_text.setdefault(t, g["fingerprint"]) == g["fingerprint"] and 0 <= g["near_next"] <= 1 and 0 <= g["near_edited"] <= 1
    assert len(set(by_text.values())) == len(by_text)
    assert np.mean([g["near_edited"] for g in got.values()]) > 0.6 and np.mean([g["near_next"] for g in got.values()]) < 0.1


def brute_tree(t):
    pattern = r"(?s).{1,4}" if len(t) <= merkle.SHORT else r"[^.!?]{1,32}[.!?]*|[.!?]+"
    own = lambda x, seed=42: xxhash.xxh64(x, seed).intdigest()
    sections = re.findall(r"(?s).+?(?:\n{2,}|\Z)", t)
    return [[[own(x.encode()) for x in re.findall(pattern, p)] for p in re.findall(r"[^\n]*\n+|[^\n]+", s)] for s in sections]


def brute_digest(numbers):
    h = 42
    for x in numbers:
        h = xxhash.xxh64(x.to_bytes(8, "little"), h).intdigest()
    return h


def brute_fingerprint(tree):
    root = hashlib.sha256(",".join(f"{brute_digest([brute_digest(p) for p in s]):X}" for s in tree).encode()).hexdigest()
    return root + ":" + "".join(f"{x & 0xFFFFFFFF:08x}" for s in tree for p in s for x in p)


def brute_likeness(a, b):
    left, right, same = [], [], 0
    for k in range(max(len(a), len(b))):
        s, u = (x[k] if k < len(x) else [] for x in (a, b))
        for j in range(max(len(s), len(u))):
            p, q = (x[j] if j < len(x) else [] for x in (s, u))
            if p == q:
                same += len(p)
            else:
                left, right = left + p, right + q
    left, right = set(left), set(right)
    return 2 * (same + len(left & right)) / d if (d := 2 * same + len(left) + len(right)) else 1.0


def test_merkle_against_brute_force(spark, data):
    texts = [r["text"] for r in documents(spark, data).orderBy("doc_id").collect()]
    moved = "\n".join(f"Line {k} of a longer text that someone else edits." for k in range(12))
    texts += ["abcdefgh", "", "a\n\n\nb", moved, "A new first line that was not there before.\n" + moved, moved.replace("Line 5", "Line V"), "x. " * 400, "é" * 129 + "\n\n" + "ü" * 64, moved]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in merkle.with_edits(df).collect()}
    for k, t in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        a, b, c = brute_tree(t), brute_tree(t[: len(t) - cut] + following[:cut]), brute_tree(following)
        r = got[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute_fingerprint(a), brute_fingerprint(b))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(brute_likeness(a, b)), pytest.approx(brute_likeness(a, c)))
    first = len(texts) - 9
    assert got[first]["near_edited"] >= 0.5 and got[first + 3]["near_next"] > 0.8 and got[first + 8]["near_next"] < 0.1


def test_merkle_locates_edits(spark):
    a = "One. Two.\nThree.\n\nFour.\nFive.\n"
    df = spark.createDataFrame([(a, a.replace("Three", "3")), (a, a)], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    got = df.select(merkle.edited_paragraphs(F.col("a"), F.col("b")).alias("e"), (merkle.root(F.col("a")) == merkle.root(F.col("b"))).alias("same")).collect()
    assert [(r["e"], r["same"]) for r in got] == [([1], False), ([], True)]


def test_merkle_pieces_spell_the_text(spark):
    texts = ["", "\n\n\na", "no end", "a.b!?c\n\n\n.d", "x" * 100 + "\n" + "é" * 40, "...\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parts = F.flatten(F.flatten(F.transform(F.regexp_extract_all("t", F.lit(r"(?s).+?(?:\n{2,}|\z)"), F.lit(0)), lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"[^\n]*\n+|[^\n]+"), F.lit(0)), lambda p: F.regexp_extract_all(p, F.lit(r"[^.!?]{1,32}[.!?]*|[.!?]+"), F.lit(0))))))
    assert [r[0] for r in df.select(F.array_join(parts, "")).collect()] == texts


def test_merkle_edges(spark, edge, none):
    rows = merkle.with_edits(edge).collect()
    assert len(rows) == edge.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert len({tuple(r) for r in rows if r["doc_id"] == 7}) == 1
    assert merkle.with_edits(none).collect() == []
    one = merkle.with_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


# quality classifier


def test_convnet_scores_held_out_rows(spark, data):
    from pathlib import Path

    data = str(Path(data).parent / "sf0.01")
    rows = queries.op1_byte_convnet(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([g >= 0.5 for g in good]) > 0.95


def test_convnet_reads_every_byte_once_more():
    net = convnet.ConvNet()
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(1, 256, n, dtype=np.uint8)) for n in (0, 1, 31, 255, 256, 257, 481, 3000, convnet.PIECE + 700)]
    net.shift += 0.3

    def brute(t: bytes) -> float:
        h = []
        for a in convnet.chunk_starts(len(t)):
            c = np.frombuffer(t[a : a + convnet.CHUNK].ljust(convnet.CHUNK, b"\0"), np.uint8)
            z = sum(net.kernel[j][c[j : j + convnet.CHUNK - convnet.WIDTH + 1 : 2]] for j in range(convnet.WIDTH))
            h.append(np.maximum(z.max(0) + net.shift, 0))
        h = np.array(h)
        return 1 / (1 + np.exp(-float(h.mean(0) @ net.out[0] + h.max(0) @ net.out[1] + net.bias[0])))

    assert net.probabilities(texts) == pytest.approx([brute(t) for t in texts], abs=1e-4)
    assert all(set(range(len(t))) <= {k for a in convnet.chunk_starts(len(t)) for k in range(a, a + convnet.CHUNK)} for t in texts)


def test_convnet_gradients():
    net = convnet.ConvNet(seed=3)
    net.kernel, net.shift, net.out, net.bias = (x.astype(np.float64) for x in (net.kernel, net.shift, net.out, net.bias))
    rng = np.random.default_rng(4)
    docs, y = [rng.integers(0, 256, (k + 1, convnet.CHUNK), dtype=np.uint8) for k in range(4)], np.array([0.0, 1, 1, 0])
    grads = net._gradients(docs, y)

    def loss() -> float:
        total = 0.0
        for d, label in zip(docs, y):
            z = sum(net.kernel[j][d[:, j : j + convnet.CHUNK - convnet.WIDTH + 1 : 2]] for j in range(convnet.WIDTH))
            h = np.maximum(z.max(1) + net.shift, 0)
            s = h.mean(0) @ net.out[0] + h.max(0) @ net.out[1] + net.bias[0]
            total += np.log1p(np.exp(-s)) if label else np.log1p(np.exp(s))
        return total / len(docs)

    for p, g, at in ((net.out, grads[2], (0, 3)), (net.out, grads[2], (1, 5)), (net.bias, grads[3], (0,)), (net.shift, grads[1], (2,))):
        keep = p[at]
        p[at] = keep + 1e-5
        up = loss()
        p[at] = keep - 1e-5
        down = loss()
        p[at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=2e-3)


def test_convnet_edges(spark, edge, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(5, None), (None, 1)], "doc_id long, quality int")
    rows = convnet.score(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1
    assert convnet.score(none, labels).collect() == []
    assert {r["score"] for r in convnet.score(edge, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in convnet.score(edge, labels.where("quality = 1")).collect()} == {1.0}
