"""Language-model scores from a log-frequency Bloom filter.

Counting: every batch of training texts sends its distinct words and word pairs with their counts to ranges of the
hash space, packed as bytes; each range adds them up over the whole corpus. Counts are quantised to levels, four to an octave for words and
one for pairs (a pair seen once has level 0), and every range writes a segment of the filter, in which an n-gram of level q is entered with
levels 1 to q (pairs with levels 0 to q, so those seen once too). A segment has ``ENTRY_BITS`` for each of its entries, so the filter grows with the corpus and its
error does not. A filter of at most ``BROADCAST_BYTES`` is broadcast. A larger one stays in its segments: groups of texts send their distinct
n-grams there and get levels back. Both ways probe the same segments and give equal scores.

Scoring: the level of an n-gram is found by probing level 1, 2, ... up to the first miss. With c' the lower end of the level and c" its upper end,

    P(w | h) = a * c'(h, w) / c"(h) + (1 - a) * P1(w),   a = WEIGHT * c"(h) / (c"(h) + PULL)
    P1(w) = (1 - u) * c'(w) / N for known words, u for the class of unknown ones; u is the share of words seen once (Good and Turing)

so probabilities of a history sum to at most 1, apart from false positives of the filter (about 1 %).

The base score uses exact counts: texts send the places of their words to the ranges, which hold the counts, and
get sums back; no table of the vocabulary is broadcast.

Edge cases: null text is empty and has the end token only; a null id trains (is not held out); very long texts are read whole;
repeated rows get equal results; with no training texts N is 0, no word is known and both scores follow the formulas with
u = 1 (the base, 0.1 / 0.1, is 1 for each token); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm._spark import checkpointed, mapped, ship, spread
from folioframe.llm._words import mix, release, steps, tidied, word_hashes

#: Bits for each entry of the filter, and probes.
ENTRY_BITS, PROBES = 10, 4
#: The least level at which pairs are entered; pairs seen once have level 0.
LEAST = 0
#: Bytes of text that one range of hashes stands for, tokens that a batch sends at once, and the most ranges (beyond 200 TB of text a range grows).
RANGE_BYTES, BATCH_TOKENS, MOST_RANGES = 12_000_000, 1_500_000, 1 << 24
#: Bytes of the filter up to which it is broadcast.
BROADCAST_BYTES = 1 << 28
#: Keys that are entered at once.
STEP_KEYS = 1 << 17
#: Share of pair evidence and its pull towards single words.
WEIGHT, PULL = 0.5, 5.0
#: The end of a text; as a history, its beginning.
END = np.uint64(0x0123456789ABCDEF)
_K = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64(2**48 - 1)
LEVELS = 64


def token_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts, each ended by END; their histories; tokens in each text."""
    words, off = word_hashes(texts)
    tokens = np.insert(words, off[1:], END)
    sizes = np.diff(off) + 1
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = END
    return tokens, before, sizes


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; it rises with the hash."""
    return ((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """In its range a pair goes by the low 48 bits of its hash."""
    return mix(before * _K + tokens)


def cuts(words: np.ndarray, pairs: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int, int, int]]:
    """For each range that sorted hashes lie in: its number, and where its words and its pairs begin and end."""
    w, p = range_of(words, ranges), range_of(pairs, ranges)
    has = np.union1d(w, p)
    places = [np.searchsorted(x, has, side) for x in (w, p) for side in ("left", "right")]
    return zip(has.tolist(), *(x.tolist() for x in places))


def pair_level(counts: np.ndarray, least: int = 1) -> np.ndarray:
    """floor(log2(count)); below ``least`` nothing is entered."""
    level = np.frexp(counts.astype(np.float64))[1].astype(np.int64) - 1
    return np.where(level >= least, level, 0)


def word_level(counts: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(counts.astype(np.float64)) + 1e-9).astype(np.int64) + 1


def _places(keys: np.ndarray, kind: int, level: int, probe: int, bits: np.ndarray) -> np.ndarray:
    x = mix(keys ^ np.uint64((kind * LEVELS * 4 + level) * 0x9E3779B97F4A7C15 % 2**64))
    return (x + np.uint64(probe) * (x >> np.uint64(32) | np.uint64(1))) % bits


def segment(words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, least: int, entry_bits: int = ENTRY_BITS) -> np.ndarray:
    """The filter's bytes for one range (``pairs``: low 48 bits of their hashes)."""
    of_words, of_pairs = word_level(word_counts), pair_level(pair_counts, least)
    entries = int(of_words.sum() + np.maximum(of_pairs - least + 1, 0).sum())
    bits = max(64, (entries * entry_bits + 63) // 64 * 64)
    out = np.zeros(bits, np.uint8)
    for kind, keys, levels in ((0, words, of_words), (1, pairs, of_pairs)):
        for level in range(least if kind else 1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= level]
            for at in range(0, len(own), STEP_KEYS):
                for probe in range(PROBES):
                    out[_places(own[at : at + STEP_KEYS], kind, level, probe, np.uint64(bits))] = 1
    return np.packbits(out, bitorder="little")


class Model:
    """Corpus sums, and the filter, unless it stays in its segments (``held`` is None)."""

    def __init__(self, total: int, distinct: int, once: int, least: int, first: np.ndarray, bits: np.ndarray, held: bytes | bytearray | np.ndarray | None):
        """``first``, ``bits``: where each range's segment begins in ``held``, and its size, in bits."""
        self.total, self.distinct, self.once, self.least = total, distinct, once, least
        self.unknown = min(max(once / total, 1 / (total + 1)), 0.5) if total else 1.0
        self.first, self.bits, self.ranges = first.astype(np.uint64), bits.astype(np.uint64), len(bits)
        self.held = held

    def levels(self, keys: np.ndarray, where: np.ndarray, kind: int) -> np.ndarray:
        """The highest level up to which every level is entered in segment ``where``; the one below the least if none is."""
        segments = np.frombuffer(self.held, np.uint8)
        level = self.least if kind else 1
        out = np.full(len(keys), level - 1, np.int64)
        alive = np.arange(len(keys))
        while len(alive):
            for probe in range(PROBES):
                at = self.first[where[alive]] + _places(keys[alive], kind, level, probe, self.bits[where[alive]])
                alive = alive[(segments[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            out[alive] = level
            level += 1
            if level >= LEVELS * 4:
                break
        return out

    def scores(self, texts: list[bytes], told: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text and the sum of their log10 probabilities; ``told``: levels of the texts' n-grams as ``distinct_ngrams`` has them."""
        tokens, before, sizes = token_runs(texts)
        words, at = np.unique(np.append(tokens, END), return_inverse=True)
        pairs, back = np.unique(pair_hashes(before, tokens), return_inverse=True)
        level, deep = told or (self.levels(words, range_of(words, self.ranges), 0), self.levels(pairs & _LOW48, range_of(pairs, self.ranges), 1))
        low, high = np.where(level > 0, 2.0 ** ((level - 1) / 4), 0), np.where(level > 0, 2.0 ** (level / 4), 0)
        one = np.where(level > 0, (1 - self.unknown) * low / max(1, self.total), self.unknown)
        own = at[:-1]
        previous = np.empty_like(own)
        previous[1:] = own[:-1]
        previous[np.cumsum(sizes) - sizes] = at[-1]
        deep = deep[back]
        # with pair counts rounded down and history counts up, a history's pairs never sum to more than 1
        history = high[previous]
        share = WEIGHT * history / (history + PULL)
        seen = np.where((deep >= self.least) & (history > 0), np.minimum(2.0**deep / np.maximum(history, 1e-9), 1.0), 0.0)
        p = share * seen + (1 - share) * one[own]
        return sizes, np.add.reduceat(np.log10(p), np.cumsum(sizes) - sizes)


def distinct_ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the texts' words (with the end) and pairs."""
    tokens, before, _ = token_runs(texts)
    return np.unique(np.append(tokens, END)), np.unique(pair_hashes(before, tokens))


def packed_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys; their counts in a byte, 255 standing for the next of the larger ones, which come third."""
    keys, counts = np.unique(keys, return_counts=True)
    return keys, np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def unpacked_counts(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int32 if not len(large) or large.max() < 2**31 else np.int64)
    out[small == 255] = large
    return out


def short(keys: np.ndarray) -> bytes:
    """The low 48 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


_COUNTS = ["words", "word_counts", "word_large", "pairs", "pair_counts", "pair_large"]


_DEALT = pa.schema([("p", pa.int32()), *[(c, pa.binary()) for c in _COUNTS]])
_KEPT = pa.schema([("p", pa.int32()), *[(c, pa.binary()) for c in _COUNTS[:3]], ("total", pa.int64()), ("distinct", pa.int64()), ("once", pa.int64()), ("bits", pa.binary())])


def _token_batches(column: pa.Array, most: int) -> Iterator[tuple[int, list[int], list[np.ndarray], list[np.ndarray]]]:
    """Runs of texts with about ``most`` tokens: first row, tokens in each text, tokens, histories."""
    first, sizes, tokens, before, held = 0, [], [], [], 0
    for at, texts in steps(x or b"" for x in column.cast(pa.binary()).to_pylist()):
        t, b, n = token_runs(texts)
        sizes += n.tolist()
        tokens.append(t)
        before.append(b)
        held += len(t)
        if held >= most:
            yield first, sizes, tokens, before
            first, sizes, tokens, before, held = at + len(texts), [], [], [], 0
    if held:
        yield first, sizes, tokens, before


def held_out(ident: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == 0, F.lit(False))


def count(docs: DataFrame, ranges: int, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """Exact counts of the words of the texts (column ``t``) and the filter's segment: a row for each range of hashes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import bloom_lm as m

        for batch in tidied(batches):
            for _, _, tokens, before in m._token_batches(batch.column(0), m.BATCH_TOKENS):
                tokens, before = np.concatenate(tokens), np.concatenate(before)
                words, wc, wl = m.packed_counts(tokens)
                pairs, pc, pl = m.packed_counts(m.pair_hashes(before, tokens))
                wbig, pbig = np.concatenate([[0], np.cumsum(wc == 255)]), np.concatenate([[0], np.cumsum(pc == 255)])
                out = []
                for p, a, b, c, d in m.cuts(words, pairs, ranges):
                    out.append({"p": p, "words": words[a:b].tobytes(), "word_counts": wc[a:b].tobytes(), "word_large": wl[wbig[a] : wbig[b]].tobytes(), "pairs": m.short(pairs[c:d]), "pair_counts": pc[c:d].tobytes(), "pair_large": pl[pbig[c] : pbig[d]].tobytes()})
                yield pa.RecordBatch.from_pylist(out, m._DEALT)

    def add(t: pa.Table) -> pa.Table:
        from folioframe.llm import bloom_lm as m

        release()
        p = t.column("p")[0].as_py()
        rows = t.to_pylist()

        def counts(r: dict, kind: str) -> np.ndarray:
            return m.unpacked_counts(np.frombuffer(r[f"{kind}_counts"], np.uint8), np.frombuffer(r[f"{kind}_large"], np.int64))

        words, wc = m.added([(np.frombuffer(r["words"], np.uint64), counts(r, "word")) for r in rows])
        pairs, pc = m.added([(m.long(r["pairs"]), counts(r, "pair")) for r in rows])
        row = {"p": p, "words": words.tobytes(), "word_counts": np.minimum(wc, 255).astype(np.uint8).tobytes(), "word_large": wc[wc >= 255].tobytes()}
        row |= {"total": int(wc.sum()), "distinct": len(wc), "once": int((wc == 1).sum()), "bits": m.segment(words, wc, pairs, pc, m.LEAST, entry_bits).tobytes()}
        return pa.Table.from_pylist([row], m._KEPT)

    sql = "p int, " + ", ".join(f"{c} binary" for c in _COUNTS)
    return docs.mapInArrow(deal, sql).groupBy("p").applyInArrow(add, "p int, words binary, word_counts binary, word_large binary, total long, distinct long, once long, bits binary")


def train(counts: DataFrame, ranges: int, most: int = BROADCAST_BYTES) -> Model:
    """The model of counted texts; ``counts`` is what ``count`` returned, written down. A filter of more than ``most`` bytes stays in its segments."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct", "once")], F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("bytes")).first()
    known = (sums["total"], sums["distinct"], sums["once"], LEAST)
    if sums["bytes"] > most:
        return Model(*known, np.zeros(0), np.zeros(0), None)
    # a range without n-grams has the empty segment at the front
    first, bits, held, at = np.zeros(ranges, np.int64), np.full(ranges, 64), bytearray(8 + sums["bytes"]), 8
    for r in counts.select("p", "bits").toLocalIterator(prefetchPartitions=True):
        end = at + len(r["bits"])
        held[at:end] = r["bits"]
        first[r["p"]], bits[r["p"]], at = 8 * at, 8 * len(r["bits"]), end
    return Model(*known, first, bits, held)


def level_sums(docs: DataFrame, counts: DataFrame, ranges: int, model: Model, groups: int) -> DataFrame:
    """(rk, n_tokens, score) for each distinct row key of ``docs`` (rk, t), with levels probed where the segments lie.

    Texts are dealt into ``groups`` by their keys; a group sends each range its distinct n-grams there and meets the levels again.
    """
    own = docs.dropDuplicates(["rk"]).select(F.pmod("rk", F.lit(groups)).alias("g"), "rk", "t")

    def post(t: pa.Table) -> pa.Table:
        from folioframe.llm import bloom_lm as m

        release()
        words, pairs = m.distinct_ngrams([x or b"" for x in t.column("t").cast(pa.binary()).to_pylist()])
        g = t.column("g")[0].as_py()
        rows = [{"p": p, "g": g, "words": words[a:b].tobytes(), "pairs": m.short(pairs[c:d]), "bits": None} for p, a, b, c, d in m.cuts(words, pairs, ranges)]
        return pa.Table.from_pylist(rows, m._ASKED)

    def probe(t: pa.Table) -> pa.Table:
        from folioframe.llm import bloom_lm as m

        release()
        rows = t.to_pylist()
        bits = next((r["bits"] for r in rows if r["bits"] is not None), bytes(8))
        one = m.Model(1, 1, 1, model.least, np.zeros(1), np.array([8 * len(bits)]), bits)
        out = []
        for r in (r for r in rows if r["bits"] is None):
            told = [one.levels(keys, np.zeros(len(keys), np.int64), kind) for kind, keys in enumerate((np.frombuffer(r["words"], np.uint64), m.long(r["pairs"])))]
            out.append({"g": r["g"], "p": r["p"], "words": told[0].astype(np.int16).tobytes(), "pairs": told[1].astype(np.int16).tobytes()})
        return pa.Table.from_pylist(out, m._TOLD)

    def add(texts: pa.Table, told: pa.Table) -> pa.Table:
        release()
        rows = sorted(told.to_pylist(), key=lambda r: r["p"])
        levels = tuple(np.frombuffer(b"".join(r[c] for r in rows), np.int16).astype(np.int64) for c in ("words", "pairs"))
        n, s = model.scores([x or b"" for x in texts.column("t").cast(pa.binary()).to_pylist()], levels)
        return pa.table({"rk": texts.column("rk"), "n_tokens": n.astype(np.int64), "score": s})

    asked = own.groupBy("g").applyInArrow(post, _ASKED_SQL).unionByName(counts.select("p", F.lit(None).cast("long").alias("g"), F.lit(b"").alias("words"), F.lit(b"").alias("pairs"), "bits"))
    told = asked.groupBy("p").applyInArrow(probe, "g long, p int, words binary, pairs binary")
    return own.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(add, "rk long, n_tokens long, score double")


_ASKED = pa.schema([("p", pa.int32()), ("g", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary()), ("bits", pa.binary())])
_ASKED_SQL = "p int, g long, words binary, pairs binary, bits binary"
_TOLD = pa.schema([("g", pa.int64()), ("p", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])


def base_sums(docs: DataFrame, counts: DataFrame, ranges: int, total: int, distinct: int) -> DataFrame:
    """(rk, base, known) for each distinct row key of ``docs`` (rk, t): sums over the text's tokens, with exact counts."""
    tasks = spread(docs.sparkSession)
    below = total + 0.1 * (distinct + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import bloom_lm as m

        for batch in tidied(batches):
            keys = batch.column(0).to_numpy()
            for first, sizes, tokens, _ in m._token_batches(batch.column(1), m.BATCH_TOKENS):
                tokens = np.concatenate(tokens)
                owner = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 65536 else np.uint32), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                words, number = tokens[new], np.diff(np.append(new, len(tokens))).astype(np.int32)
                at = np.append(new, len(tokens))
                for p, a, b, _, _ in m.cuts(words, words[:0], ranges):
                    own = owner[at[a] : at[b]]
                    has, place = np.unique(own, return_inverse=True)
                    row = {"p": p, "kind": 1, "words": words[a:b].tobytes(), "number": number[a:b].tobytes(), "owner": place.astype(np.uint16 if len(has) < 65536 else np.uint32).tobytes(), "keys": keys[first + has.astype(np.int64)].tobytes()}
                    yield pa.RecordBatch.from_pylist([row], _POSTED)

    def look_up(t: pa.Table) -> pa.Table:
        from folioframe.llm import bloom_lm as m

        release()
        rows = t.to_pylist()
        held = [r for r in rows if r["kind"] == 0]
        known = np.frombuffer(held[0]["words"], np.uint64) if held else np.zeros(0, np.uint64)
        count = m.unpacked_counts(np.frombuffer(held[0]["number"], np.uint8), np.frombuffer(held[0]["owner"], np.int64)) if held else np.zeros(0, np.int64)
        keys, sums = [], []
        for r in rows:
            if r["kind"] == 1:
                words = np.frombuffer(r["words"], np.uint64)
                key = np.frombuffer(r["keys"], np.int64)
                c = np.zeros(len(words), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    c = np.where(known[at] == words, count[at], 0)
                number = np.frombuffer(r["number"], np.int32)
                owner = np.frombuffer(r["owner"], np.uint16 if len(key) < 65536 else np.uint32)
                cols = [np.log10((c + 0.1) / below), (c > 0).astype(np.float64), (words == m.END).astype(np.float64)]
                keys.append(key)
                sums.append(np.stack([np.bincount(owner, np.repeat(x, number), len(key)) for x in cols]))
        if not keys:
            return pa.Table.from_pylist([], m._SUMS)
        key, total = np.concatenate(keys), np.concatenate(sums, axis=1)
        group = (key.astype(np.uint64) % np.uint64(tasks)).astype(np.int64)
        return pa.Table.from_pylist([{"q": q, "keys": key[group == q].tobytes(), "sums": np.ascontiguousarray(total[:, group == q]).tobytes()} for q in np.unique(group).tolist()], m._SUMS)

    def add(t: pa.Table) -> pa.Table:
        release()
        rows = t.to_pylist()
        key = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        sums = np.concatenate([np.frombuffer(r["sums"], np.float64).reshape(3, -1) for r in rows], axis=1)
        keys, at = np.unique(key, return_inverse=True)
        base, known, ends = (np.bincount(at, s, len(keys)) for s in sums)
        # a row key that several equal rows have was added as often as it has ends
        return pa.table({"rk": keys, "base": base / ends, "known": np.rint(known / ends).astype(np.int64)})

    sql = "p int, kind int, words binary, number binary, owner binary, keys binary"
    table = counts.select("p", F.lit(0).alias("kind"), "words", F.col("word_counts").alias("number"), F.col("word_large").alias("owner"), F.lit(b"").alias("keys"))
    posted = docs.select("rk", "t").mapInArrow(deal, sql).union(table)
    return posted.groupBy("p").applyInArrow(look_up, "q int, keys binary, sums binary").groupBy("q").applyInArrow(add, "rk long, base double, known long")


_POSTED = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("words", pa.binary()), ("number", pa.binary()), ("owner", pa.binary()), ("keys", pa.binary())])
_SUMS = pa.schema([("q", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])


def score(df: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_BYTES, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; rows whose id's crc32 is a multiple of ``folds`` do not train."""
    spark = df.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), held_out(F.col(id_col), folds).alias("held_out"), text.alias("t")).withColumn("rk", F.xxhash64("id", "t"))
    kind = docs.schema["id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(8, -(-size // RANGE_BYTES)))
    counts = checkpointed(count(docs.where("NOT held_out").select("t"), ranges, entry_bits))
    model = train(counts, ranges, most)
    total = model.total
    sums = base_sums(docs, counts, ranges, model.total, model.distinct)
    cols = ["id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"]
    if model.held is None:
        scored = docs.select("id", "held_out", "rk").join(level_sums(docs.select("rk", "t"), counts, ranges, model, -(-size // RANGE_BYTES) or 1), "rk")
        return scored.join(sums, "rk").select(cols)
    size, shared = len(model.held), spark.sparkContext.broadcast(model.held)
    model.held = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.held = mapped(shared, size)
        for batch in tidied(batches):
            n, s = [], []
            for _, texts in steps(x or b"" for x in batch.column(3).cast(pa.binary()).to_pylist()):
                a, b = model.scores(texts)
                n.append(a)
                s.append(b)
            cols = [np.concatenate(x) if x else np.zeros(0) for x in (n, s)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.float64))], ["id", "held_out", "rk", "n_tokens", "score"])

    scored = docs.select("id", "held_out", "rk", "t").mapInArrow(run, f"id {kind}, held_out boolean, rk long, n_tokens long, score double")
    return scored.join(sums, "rk").select(cols)
