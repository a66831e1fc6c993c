"""N-gram Jaccard join: all links between word-shingle sets of a given Jaccard similarity, by prefix trees.

1. Every text becomes its set of shingle hashes; texts with equal sets form one class, and only classes are compared.
2. Two linked sets miss at most D(n) = floor((1 - t) n) of each other's shingles. In a fixed slice of the hash space that holds more
   than that share, shingles are counted over all classes; a class whose slice has more than D(n) shingles that no other class has
   cannot link and goes no further. A range of the slice gets 32 bits of a hash: two that agree in them count as one that is shared, so a
   class may go on for nothing but none is lost. Only classes with shared shingles are told of, so what returns does not grow with the ranges.
3. For the rest, all shingles are counted, and those of two or more classes get numbers, which stand for them from there on. Sorted by
   rising count, two linked sets share one of their first D(n) + 1
   shingles (their prefixes). Classes of like sizes with a common prefix shingle meet at the smallest of them, their leader, so a pair that
   shares many shingles meets at few leaders, and a long text meets no short ones: sizes fall into classes a factor 1 / t wide, and linked
   sets lie in the same or in neighbouring ones.
4. At a leader, the sets stand in a trie in one global order, frequent shingles first, so that long runs are shared. Each set
   walks down the trie; overlaps of a shared run are counted once, and a subtree is cut when the shingles that remain on either side, or the
   set sizes below, cannot reach the needed overlap. A pair counts at the least leader that both have.
   A leader with many classes is dealt into chunks, bounded in classes and in shingles, and every pair of chunks meets in a task of its
   own, so no task holds more than two chunks. Only linked components and link counts leave a task, no lists of pairs.
5. Components of the links are found by star contractions.

Shingles and classes are compared by 64-bit hashes; a false match of two has a chance of about 2**-64.

Edge cases: null, empty or wordless text has an empty set, which links with nothing; a text with fewer words than a shingle has one shingle, the
whole sequence; very long texts are whole sets like others; repeated rows and equal ids are rows of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm._groups import SALTS, beside, components, salt, summed
from folioframe.llm._spark import checkpointed, ship, spread
from folioframe.llm._words import mix, release, shingles, steps, tidied, word_hashes

#: Shingles that one counting task takes (of whole hashes, of 32 bits), and that a reading task sends at once.
COUNTED, COUNTED_NARROW, SENT = 1_000_000, 2_000_000, 1_000_000
#: The largest number of a shingle that is sent in 4 bytes.
NARROW = 2**32 - 1
#: Least and most classes of a chunk at a leader, the chunks that it is dealt into before they grow, and the shingles of a chunk.
CHUNK, CHUNK_MOST, CHUNKS, CHUNK_SHINGLES = 128, 1_024, 16, 1_000_000
#: Bits of the filter that tells which documents go on: 16 for each class. Where these are more than this bound (16 MB), a join tells it.
FILTER_BITS = 1 << 27
FILTER_PARTS = 64


class Similarity:
    """A Jaccard threshold as a ratio of integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def misses(self, n):
        """D(n): how many shingles of a set of n a linked set may lack."""
        return n * (self.den - self.num) // self.den

    def linked(self, overlap, n, m):
        return self.den * overlap >= self.num * (n + m - overlap)

    def needed(self, n, m):
        """The least overlap that links sets of n and m shingles."""
        return -(-(self.num * (n + m)) // (self.num + self.den))


def set_fingerprint(s: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)[None] + np.uint64(len(s)))[0].astype(np.int64))


def text_sets(column: pa.Array, words: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted shingle hashes) of the texts of an Arrow column; of rows in ``keep`` only, if given."""
    texts = column.cast(pa.binary()).to_pylist()
    at = range(len(texts)) if keep is None else keep.tolist()
    for first, held in steps(texts[k] or b"" for k in at):
        hashes, off = word_hashes(held)
        for k in range(len(held)):
            yield at[first + k], shingles(hashes[off[k] : off[k + 1]], words)


def _small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _dealt(found: list[tuple[int, int, np.ndarray]], parts: int, width: int, narrow: bool) -> Iterator[dict]:
    """Sets (fingerprint, size, shingles) as a row for each range of hashes: fingerprints, sizes, counts and shingles, as bytes.

    ``narrow``: without sizes, and of a shingle the first 32 bits of its place in the range.
    """
    if not found:
        return
    fps = np.array([f for f, _, _ in found], np.int64)
    sizes = np.array([n for _, n, _ in found], np.int32)
    hashes = np.concatenate([s for _, _, s in found])
    owner = np.repeat(np.arange(len(found)), [len(s) for _, _, s in found])
    part = np.minimum((hashes // np.uint64(min(width, 2**64 - 1))).astype(np.int64), parts - 1)
    if narrow:
        place = hashes - part.astype(np.uint64) * np.uint64(min(width, 2**64 - 1))
        hashes = (place >> np.uint64(max(0, (width - 1).bit_length() - 32))).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        own = order[cuts[p] : cuts[p + 1]]
        if len(own):
            count = np.bincount(owner[own], minlength=len(found))
            has = np.flatnonzero(count)
            yield {"p": p, "fps": fps[has].tobytes(), "sizes": b"" if narrow else sizes[has].tobytes(), "counts": _small(count[has]), "hashes": hashes[own].tobytes()}


def _sent(sets: Iterator[tuple[int, np.ndarray]], parts: int, width: int, edge: int, narrow: bool) -> Iterator[dict]:
    """The distinct non-empty sets, cut to hashes below ``edge``, dealt by range; about SENT shingles at a time."""
    found, seen, held = [], set(), 0
    for _, s in sets:
        if len(s) and (fp := set_fingerprint(s)) not in seen:
            seen.add(fp)
            found.append((fp, len(s), s if edge == 2**64 else s[: np.searchsorted(s, np.uint64(edge))].copy()))
            held += len(found[-1][2])
        if held >= SENT:
            yield from _dealt(found, parts, width, narrow)
            found, held = [], 0
    yield from _dealt(found, parts, width, narrow)


_DEALT = pa.schema([("p", pa.int32()), ("fps", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
_DEALT_SQL = "p int, fps binary, sizes binary, counts binary, hashes binary"


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])


def _joined_small(t: pa.Table, name: str, beside: str, width: int) -> np.ndarray:
    """A column of ``_small`` counts, one for each ``width`` bytes of another column."""
    pairs = zip(t.column(name).to_pylist(), t.column(beside).to_pylist())
    return np.concatenate([np.frombuffer(x, f"u{len(x) // (len(y) // width)}").astype(np.int64) for x, y in pairs])


def _counted(t: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a range, each class's once, sorted by hash: where the hash is new, their classes' places in the range, how many
    entries have the hash; and the classes' fingerprints by place. Equal classes that came from several tasks have equal shingles."""
    fps, hashes = _joined(t, "fps", np.int64), _joined(t, "hashes", kind)
    once = np.zeros(len(fps), bool)
    once[np.unique(fps, return_index=True)[1]] = True
    owner = np.repeat(np.arange(len(fps)), _joined_small(t, "counts", "fps", 8))
    if not once.all():
        keep = once[owner]
        owner, hashes = owner[keep], hashes[keep]
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    run = np.cumsum(first) - 1
    return first, owner, np.bincount(run)[run] if len(run) else run, fps


class Trie:
    """Sets (arrays of ranks in one global order) in a path-compressed trie, level by level."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, ranks: int):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[k] for k in self.order]
        self.sizes = sizes[self.order].astype(np.int64)
        self.flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.int64)
        self.ranks = ranks
        at = np.concatenate([[0], np.cumsum([len(s) for s in self.sets])])
        m = len(self.sets)
        common = [0] * (m + 1)
        for k in range(1, m):
            a, b = self.sets[k - 1], self.sets[k]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[k] = int(differ[0]) if len(differ) else n
        level, self.levels = [(0, m, 0, -1)], []
        while level:
            nodes, below = [], []
            for lo, hi, depth, parent in level:
                end = len(self.sets[lo]) if hi - lo == 1 else min(common[lo + 1 : hi])
                me = len(nodes)
                nodes.append((at[lo] + depth, at[lo] + end, lo, hi, parent, end))
                if hi - lo > 1:
                    a = lo
                    for k in range(lo + 1, hi + 1):
                        if k == hi or common[k] == end:
                            below.append((a, k, end, me))
                            a = k
            table = np.array(nodes, np.int64)
            lengths = np.array([len(s) for s in self.sets])
            extra = np.array([[self.sizes[lo:hi].min(), self.sizes[lo:hi].max(), lengths[lo:hi].max() - end] for _, _, lo, hi, _, end in nodes], np.int64)
            parents = table[:, 4]
            width = len(self.levels[-1][0]) if self.levels else 1
            first = np.searchsorted(parents, np.arange(width)) if self.levels else np.zeros(1, np.int64)
            last = np.searchsorted(parents, np.arange(width), side="right") if self.levels else np.ones(1, np.int64)
            self.levels.append((table, extra, first, last))
            level = below

    def links(self, k: int, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
        """Places after ``k`` (in trie order) of the sets that set ``k`` may link with, and the overlaps."""
        own, n = self.sets[k], int(self.sizes[k])
        mark = np.zeros(self.ranks + 1, np.int64)
        mark[own] = 1
        floor = -(-sim.num * n // sim.den)
        ceiling = n * sim.den // sim.num
        up, score = np.zeros(1, np.int64), np.zeros(1, np.int64)
        places, overlaps = [], []
        for table, extra, first, last in self.levels:
            number = last[up] - first[up]
            total = int(number.sum())
            if not total:
                break
            at = np.repeat(first[up] - (np.cumsum(number) - number), number) + np.arange(total)
            got = np.repeat(score, number)
            keep = (table[at, 3] > k + 1) & (extra[at, 1] >= floor) & (extra[at, 0] <= ceiling)
            at, got = at[keep], got[keep]
            if not len(at):
                break
            start, stop = table[at, 0], table[at, 1]
            run = stop - start
            place = np.repeat(start - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
            gained = np.concatenate([[0], np.cumsum(mark[self.flat[place]])])
            ends = np.cumsum(run)
            got = got + gained[ends] - gained[ends - run]
            end = np.where(table[at, 5] > 0, self.flat[np.maximum(stop - 1, 0)], -1)
            mine = len(own) - np.searchsorted(own, end, side="right")
            need = sim.needed(n, np.maximum(extra[at, 0], floor))
            keep = got + np.minimum(mine, extra[at, 2]) >= need
            at, got = at[keep], got[keep]
            leaf = table[at, 3] - table[at, 2] == 1
            if leaf.any():
                places.append(table[at[leaf], 2])
                overlaps.append(got[leaf])
            up, score = at, got
        none = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(overlaps)) if places else (none, none)


def join_group(sets: list[np.ndarray], sizes: np.ndarray, sim: Similarity) -> Iterator[tuple[int, int, int]]:
    """(a, b, overlap) of all linked pairs among sets of 64-bit shingles; ``sizes`` are their full sizes."""
    if len(sets) < 2:
        return
    shared, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.full(len(shared), -1, np.int64)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 1]
    rank[order] = np.arange(len(order))
    ranked, at = [], 0
    for s in sets:
        r = rank[inverse[at : at + len(s)]]
        ranked.append(np.sort(r[r >= 0]))
        at += len(s)
    trie = Trie(ranked, np.asarray(sizes), len(order))
    for k, me in enumerate(trie.order):
        if len(trie.sets[k]) < trie.sizes[k] - sim.misses(int(trie.sizes[k])):
            continue
        places, overlaps = trie.links(k, sim)
        for p, o in zip(places.tolist(), overlaps.tolist()):
            if p > k and sim.linked(o, int(trie.sizes[k]), int(trie.sizes[p])):
                yield me, trie.order[p], o


def _id_filter(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter (bytes) of the column ``h`` of ``ids``, put together from ranges of its bits."""
    bits = 1 << max(16, (16 * count - 1).bit_length())
    size = bits // FILTER_PARTS

    def fill(key: tuple, t: pa.Table) -> pa.Table:
        own = np.zeros(size, np.uint8)
        own[t.column("bit").to_numpy() % size] = 1
        return pa.table({"part": [key[0].as_py()], "bits": [np.packbits(own, bitorder="little").tobytes()]}, pa.schema([("part", pa.int64()), ("bits", pa.binary())]))

    places = ids.select(F.explode(F.array(F.pmod("h", F.lit(bits)), F.pmod(F.xxhash64("h"), F.lit(bits)))).alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / size))
    out = np.zeros(bits // 8, np.uint8)
    for r in places.groupBy("part").applyInArrow(fill, "part long, bits binary").collect():
        out[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def link(df: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n_shingles, component_id, n_links, root`` of every row of ``df``.

    Rows link when ``den * intersection >= num * union`` of their sets of ``words``-word shingles; ``component_id`` is the smallest id reachable by
    links, ``n_links`` the number of other rows linked directly, ``root`` a key of the component (null for empty sets), which differs between components also
    where ids repeat.
    """
    spark = df.sparkSession
    ship(spark)
    sim = Similarity(num, den)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()
    part_of = min(1.0, 2.5 * (den - num) / den)
    edge = int(part_of * 2**64) if part_of < 1 else 2**64

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import ngram_join as m

        for batch in tidied(batches):
            fp, n, held = [], [], []
            for _, s in m.text_sets(batch.column(2), words):
                fp.append(m.set_fingerprint(s))
                n.append(len(s))
                held.append(len(s) if edge == 2**64 else int(np.searchsorted(s, np.uint64(edge))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.int64())], ["id", "text_hash", "fp", "n", "held"])

    keyed = docs.select("id", F.xxhash64("t").alias("text_hash"), "t")
    rows = checkpointed(keyed.mapInArrow(fingerprint, f"id {kind}, text_hash long, fp long, n long, held long").withColumn("_salt", salt("id", "text_hash")))
    classes = checkpointed(summed(rows.where("n > 0"), "fp", [F.min("id").alias("id"), F.min(F.xxhash64("id", "text_hash")).alias("k"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("held").alias("held")], [F.min("id").alias("least"), F.min("k").alias("one"), F.sum("c").alias("members"), F.first("n").alias("n"), F.first("held").alias("held")]))

    lacking = F.floor(F.col("n") * (den - num) / den)
    total = rows.agg(F.sum("held")).first()[0] or 0
    alive = classes.join(_slice_shared(keyed, total, words, edge), "fp", "left")
    alive = checkpointed(alive.where(F.coalesce("shared", F.lit(0)) >= F.col("held") - lacking).select("fp", "one", "members", "n"))
    live = checkpointed(_ordered_sets(keyed, alive, words, sim))
    found = checkpointed(_meet(live, alive.select("fp", "members"), sim))

    root = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    of = classes.select("fp", "least").join(root.withColumnRenamed("node", "fp"), "fp").withColumn("_salt", salt("fp"))
    comp = beside(of, "root", summed(of, "root", [F.min("least").alias("l")], [F.min("l").alias("component")])).select("fp", "root", "component")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    told = classes.join(comp, "fp", "left").join(links, "fp", "left")
    told = told.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"), "_salts")
    linked = beside(rows.where("n > 0"), "fp", told).select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "n_links", "root")
    return linked.union(rows.where("n = 0").select("id", "text_hash", "n", F.col("id"), F.lit(0).cast("long"), F.lit(None).cast("long")))


def _slice_shared(keyed: DataFrame, total: int, words: int, edge: int) -> DataFrame:
    """(fp, shared): how many of a class's shingles below ``edge`` another class has too (no fewer; 32 bits may mistake one); without classes that share none.

    Every task sends the classes that it reads, copies in other tasks too, so ranges are sized by the ``total`` of the rows' shingles.
    """
    parts = max(1, round(total / COUNTED_NARROW) + 1)
    width = edge // parts + 1
    tasks = spread(keyed.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import ngram_join as m

        for batch in tidied(batches):
            for row in m._sent(m.text_sets(batch.column(0), words), parts, width, edge, True):
                yield pa.RecordBatch.from_pylist([row], m._DEALT)

    def count(t: pa.Table) -> pa.Table:
        from folioframe.llm import ngram_join as m

        release()
        _, owner, number, fps = m._counted(t, np.uint32)
        return m._told(fps, np.bincount(owner[number > 1], minlength=len(fps)), tasks)

    def add(t: pa.Table) -> pa.Table:
        from folioframe.llm import ngram_join as m

        release()
        fps, at = np.unique(m._joined(t, "fps", np.int64), return_inverse=True)
        return pa.table({"fp": fps, "shared": np.bincount(at, m._joined_small(t, "shared", "fps", 8)).astype(np.int64)})

    dealt = keyed.select("t").mapInArrow(deal, _DEALT_SQL)
    told = dealt.groupBy("p").applyInArrow(count, "q int, fps binary, shared binary")
    return told.groupBy("q").applyInArrow(add, "fp long, shared long")


def _told(fps: np.ndarray, shared: np.ndarray, tasks: int) -> pa.Table:
    """Counts of one range of hashes, without zeros, packed into a row for each of ``tasks`` groups of classes."""
    has = np.flatnonzero(shared)
    fps, shared = fps[has], shared[has]
    group = (fps.astype(np.uint64) % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(tasks + 1))
    out = []
    for q in range(tasks):
        own = order[cuts[q] : cuts[q + 1]]
        if len(own):
            out.append({"q": q, "fps": fps[own].tobytes(), "shared": _small(shared[own])})
    return pa.Table.from_pylist(out, pa.schema([("q", pa.int32()), ("fps", pa.binary()), ("shared", pa.binary())]))


def _ordered_sets(keyed: DataFrame, alive: DataFrame, words: int, sim: Similarity) -> DataFrame:
    """(fp, n, prefix, shingles, wide) of the classes that share a prefix shingle with another; one of a class's rows sends its shingles.

    Shingles are numbers of 4 bytes, of 8 where ``wide``: in its range each gets the next one, and ranges take turns. A few classes may be
    there that are not in ``alive`` (the filter's mistakes); they link with none.
    """
    spark = keyed.sparkSession
    size = alive.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
    keyed = keyed.select(F.xxhash64("id", "text_hash").alias("one"), "t")
    small = 16 * size["c"] <= FILTER_BITS
    shared = spark.sparkContext.broadcast(_id_filter(alive.select(F.col("one").alias("h")), size["c"]) if small else None)
    if not small:
        keyed = keyed.join(alive.select("one"), "one", "left_semi")
    parts = max(1, round((size["n"] or 0) / COUNTED) + 1)
    width = 2**64 // parts + 1
    sets = max(parts, spread(spark))
    narrow = NARROW

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import ngram_join as m

        bits = shared.value
        for batch in tidied(batches):
            keep = None
            if bits is not None:
                a, b = batch.column(0).to_numpy() & (8 * len(bits) - 1), batch.column(1).to_numpy() & (8 * len(bits) - 1)
                keep = np.flatnonzero((bits[a >> 3] >> (a & 7).astype(np.uint8) & 1) & (bits[b >> 3] >> (b & 7).astype(np.uint8) & 1))
            for row in m._sent(m.text_sets(batch.column(2), words, keep), parts, width, 2**64, False):
                yield pa.RecordBatch.from_pylist([row], m._DEALT)

    def common(t: pa.Table) -> pa.Table:
        from folioframe.llm import ngram_join as m

        release()
        first, owner, number, fps = m._counted(t, np.uint64)
        sizes, keep = m._joined(t, "sizes", np.int32), number > 1
        rank = (np.cumsum(first[keep]) - 1).astype(np.uint32)
        owner, number = owner[keep], np.minimum(number[keep], 65535)
        part = (fps.astype(np.uint64) % np.uint64(sets)).astype(np.int64)[owner]
        order = np.lexsort((owner, part))
        cuts = np.searchsorted(part[order], np.arange(sets + 1))
        p, out = t.column("p")[0].as_py(), []
        for q in range(sets):
            own = order[cuts[q] : cuts[q + 1]]
            if len(own):
                has, count = np.unique(owner[own], return_counts=True)
                out.append({"q": q, "p": p, "fps": fps[has].tobytes(), "sizes": sizes[has].tobytes(), "counts": m._small(count), "ranks": rank[own].tobytes(), "numbers": m._small(number[own])})
        return pa.Table.from_pylist(out, pa.schema([("q", pa.int32()), ("p", pa.int32()), *((c, pa.binary()) for c in ("fps", "sizes", "counts", "ranks", "numbers"))]))

    def order_sets(t: pa.Table) -> pa.Table:
        from folioframe.llm import ngram_join as m

        release()
        counts = m._joined_small(t, "counts", "fps", 8)
        fps, sizes = np.repeat(m._joined(t, "fps", np.int64), counts), np.repeat(m._joined(t, "sizes", np.int32), counts)
        turn = np.repeat(t.column("p").to_numpy().astype(np.uint64), [len(x) // 4 for x in t.column("ranks").to_pylist()])
        ids = m._joined(t, "ranks", np.uint32).astype(np.uint64) * np.uint64(parts) + turn
        order = np.lexsort((ids, m._joined_small(t, "numbers", "ranks", 4), fps))
        fps, sizes, ids = fps[order], sizes[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])).tolist() if len(fps) else []
        out = []
        for a, b in zip(first, [*first[1:], len(fps)]):
            n = int(sizes[a])
            prefix = sim.misses(n) + 1 - (n - (b - a))
            if prefix > 0:
                wide = bool(ids[a:b].max() > narrow)
                out.append({"fp": int(fps[a]), "n": n, "prefix": ids[a : a + prefix].astype(np.int64), "shingles": ids[a:b].astype(np.uint64 if wide else np.uint32).tobytes(), "wide": wide})
        return pa.Table.from_pylist(out, pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shingles", pa.binary()), ("wide", pa.bool_())]))

    dealt = keyed.select(F.col("one").alias("a"), F.xxhash64("one").alias("b"), "t").mapInArrow(deal, _DEALT_SQL)
    kept = dealt.groupBy("p").applyInArrow(common, "q int, p int, fps binary, sizes binary, counts binary, ranks binary, numbers binary")
    return kept.groupBy("q").applyInArrow(order_sets, "fp long, n long, prefix array<long>, shingles binary, wide boolean")


def _meet(live: DataFrame, members: DataFrame, sim: Similarity) -> DataFrame:
    """(fp, root, links): for each leader, the linked classes, the least of their component there, and the rows they link with there."""
    # a hair wider than the factor, so that rounding parts no linked sets
    scale = F.floor(F.log(F.col("n").cast("double")) / (math.log(sim.den / sim.num) + 1e-9)) if sim.num < sim.den else F.col("n")
    near = F.array(scale, scale + 1) if sim.num < sim.den else F.array(scale)
    prefix = live.select("fp", "n", F.explode("prefix").alias("x"), near.alias("near")).select("fp", "n", "x", F.explode("near").alias("size"))
    prefix = prefix.select("fp", "n", F.xxhash64("x", "size").alias("key")).withColumn("_salt", salt("fp"))
    leaders = summed(prefix, "key", [F.min("fp").alias("m"), F.count("*").alias("c")], [F.min("m").alias("leader"), F.sum("c").alias("c")]).where("c > 1")
    met = beside(prefix, "key", leaders).select("fp", "n", "leader").distinct().withColumn("_salt", salt("fp"))
    met = checkpointed(met)
    sizes = summed(met, "leader", [F.count("*").alias("c"), F.sum("n").alias("n")], [F.sum("c").alias("c"), F.sum("n").alias("all_n")])
    width = F.greatest(F.lit(CHUNK), F.least(F.lit(CHUNK_MOST), F.ceil(F.col("c") / CHUNKS)))
    by_shingles = F.ceil(F.col("all_n") / CHUNK_SHINGLES)
    chunks = F.when((F.col("c") <= 2 * CHUNK) & (by_shingles <= 2), 1).otherwise(F.greatest(F.ceil(F.col("c") / width), F.least(by_shingles, F.col("c")))).cast("int")
    placed = beside(met, "leader", sizes).select("fp", "leader", chunks.alias("g")).withColumn("ci", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("g")).cast("int"))
    all_of = met.groupBy("fp").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    dealt = placed.withColumn("cj", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("fp", "leader", "ci", F.least("ci", "cj").alias("i"), F.greatest("ci", "cj").alias("j"))
    whole = live.join(all_of.join(members, "fp"), "fp").select("fp", "n", "members", "leaders", "shingles", "wide")
    tasks = dealt.join(whole, "fp").repartition(spread(live.sparkSession), "leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import ngram_join as m

        held: list[dict] = []
        for batch in tidied(batches):
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                if held and (row["leader"], row["i"], row["j"]) != (held[0]["leader"], held[0]["i"], held[0]["j"]):
                    out += m._group_links(held, sim)
                    held = []
                held.append(row)
            yield m._links_batch(out)
        if held:
            yield m._links_batch(m._group_links(held, sim))

    return tasks.select("leader", "i", "j", "ci", "fp", "n", "members", "leaders", "shingles", "wide").mapInArrow(run, "fp long, root long, links long")


def _links_batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["fp", "root", "links"])


def _group_links(held: list[dict], sim: Similarity) -> list[tuple[int, int, int]]:
    """What one task at a leader finds: (class, least class of its component here, rows that it links with here)."""
    if len(held) < 2:
        return []
    fps = [r["fp"] for r in held]
    leader, across = held[0]["leader"], held[0]["i"] != held[0]["j"]
    parent = list(range(len(held)))
    links = [0] * len(held)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets = [np.frombuffer(r["shingles"], np.uint64 if r["wide"] else np.uint32) for r in held]
    for a, b, _ in join_group(sets, np.array([r["n"] for r in held], np.int64), sim):
        if across and held[a]["ci"] == held[b]["ci"]:
            continue
        la, lb = held[a]["leaders"], held[b]["leaders"]
        if (la[0] if la[0] == lb[0] else min(set(la).intersection(lb))) != leader:
            continue
        links[a] += held[b]["members"]
        links[b] += held[a]["members"]
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for k, fp in enumerate(fps):
        r = find(k)
        least[r] = min(least.get(r, fp), fp)
    return [(fps[k], least[find(k)], links[k]) for k in range(len(held)) if links[k]]
