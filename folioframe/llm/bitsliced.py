"""Exact top-k by inner product over a bit-sliced index.

A block of the index holds its rows' integer components as bitmaps: one for every component and binary digit, a
bit a row. For a query, every set digit of a weight adds a component's bitmaps at that place value; carry-save adders
work on whole bitmaps, and what remains are the bitmaps of all rows' scores. Rows are then selected from the most
significant bitmap downward; rows that all digits leave tied are resolved by their ids. A run of query blocks streams past a block of
the index, whose bitmaps are made once for the run; each block sends on at most k rows for a query, and those are ranked by query. Runs have as many
queries as a block has rows (fewer when there are too few blocks to keep the session's tasks busy), so index and queries are copied alike.

Edge cases: vectors that are null, or hold null, NaN or infinite components take no part; vectors with a scaled component of 2**25 or more in size
lie in blocks of their own, whose bitmaps have as many digits as they need, and from 2**62 on their components are Python integers; a result whose score
leaves 64 bits fails the query; a query meets rows of its own length only; rows that
share the query's id are its own rows; ties go to the smaller id, null ids last; repeated query rows each get an answer;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.llm._spark import checkpointed, ship, spread

#: Rows of a block of the index, and queries of a block.
INDEX_ROWS, QUERY_ROWS = 32_768, 256
#: Rows of the index, of those with wide and with huge components, that share bitmaps.
WIDE_ROWS, HUGE_ROWS = 4_096, 64
#: Tasks that the session should have for each of its shuffle partitions.
TASKS = 2
#: Sizes from which on a scaled component is wide, and huge: too large for 64-bit integers with room for differences.
_WIDE, _HUGE = 2**25, 2.0**62
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(vector: Column, scale: float = 64.0) -> tuple[Column, Column]:
    """floor(scale * x) of every component, and the vector itself if one of these is huge; both null for a vector that takes no part."""
    x = vector.cast("array<double>")
    part = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    huge = F.exists(x, lambda c: F.abs(c) * scale >= _HUGE)
    return F.when(part & ~huge, F.transform(x, lambda c: F.floor(c * scale).cast("long"))), F.when(part & huge, x)


def whole(x: float, scale: float) -> int:
    """floor(scale * x), of any size."""
    n = Fraction(x) * Fraction(scale)
    return n.numerator // n.denominator


def matrix(kind: int, data: bytes, dims: int, scale: float) -> np.ndarray:
    """Rows of a block: 64-bit integers, or Python integers for huge components."""
    if kind < 2:
        return np.frombuffer(data, np.int64 if kind else np.int32).reshape(-1, dims).astype(np.int64)
    return np.array([whole(x, scale) for x in np.frombuffer(data, np.float64).tolist()], object).reshape(-1, dims)


class SlicedBlock:
    """Bitmaps of one block of rows: planes[s, d, j] holds digit j of component d, complemented for s = 1."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, rows: np.ndarray):
        self.ids, self.known, self.n = ids, known, len(rows)
        self.dims = rows.shape[1]
        self.low = rows.min(0) if self.dims else np.zeros(0, np.int64)
        up = rows - self.low if rows.dtype == object else (rows - self.low).astype(np.uint64)
        one = 1 if rows.dtype == object else np.uint64(1)
        self.digits = max(1, int(up.max()).bit_length()) if up.size else 1
        width = (self.n + 63) // 64 * 8
        planes = np.zeros((2, self.dims, self.digits, width), np.uint8)
        for j in range(self.digits):
            packed = np.packbits((up >> (j * one) & one).astype(np.uint8), axis=0, bitorder="little")
            planes[0, :, j, : len(packed)] = packed.T
        planes[1] = ~planes[0]
        self.planes = planes.view(np.uint64)
        every = np.zeros(width, np.uint8)
        ones = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        every[: len(ones)] = ones
        self.every = every.view(np.uint64)
        order = np.argsort(ids, kind="stable")
        self.order, self.sorted_ids = order, ids[order]

    def score_planes(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores' digits, lowest first, and what to add to them."""
        size, sign = np.abs(query), (query < 0).astype(np.int64)
        most = (1 << self.digits) - 1
        # Python integers: sums of wide components leave 64 bits
        base = sum(a * b for a, b in zip(query.tolist(), self.low.tolist())) - most * sum(size[query < 0].tolist())
        top = int(size.max()).bit_length() if len(size) else 0
        held: list[np.ndarray] = []
        out = []
        at = 0
        while at < top + self.digits - 1 or held:
            parts = held
            for i in range(max(0, at - self.digits + 1), min(top, at + 1)):
                d = np.flatnonzero((size >> i & 1).astype(bool))
                if len(d):
                    parts.append(self.planes[sign[d], d, at - i])
            stack = np.concatenate(parts) if parts else np.zeros((0, len(self.every)), np.uint64)
            held = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                t = a ^ b
                held.append(a & b | t & c)
                t ^= c
                stack = np.concatenate([t, stack[3 * m :]]) if len(stack) > 3 * m else t
            if len(stack) == 2:
                held.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros_like(self.every))
            at += 1
        return out, base

    def top(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows, without rows of id ``own``; scores beyond 64 bits end at their bounds."""
        rest = self.every.copy()
        if own is not None:
            a, b = np.searchsorted(self.sorted_ids, [own, own + 1])
            for p in self.order[a:b].tolist():
                if self.known[p]:
                    rest[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        planes, base = self.score_planes(query)
        sure, left = np.zeros_like(rest), k
        for plane in reversed(planes):
            ones = rest & plane
            n = int(np.bitwise_count(ones).sum())
            if n >= left:
                rest = ones
            else:
                sure |= ones
                left -= n
                rest &= ~plane
        chosen = self._places(sure)
        tied = self._places(rest)
        tied = tied[np.lexsort((self.ids[tied], ~self.known[tied]))][:left]
        places = np.concatenate([chosen, tied])
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        exact = np.int64 if len(planes) < 62 and abs(base) < 2**62 else object
        scores = np.full(len(places), base, exact)
        for j, plane in enumerate(planes):
            scores += (plane[word] >> bit & np.uint64(1)).astype(np.int64).astype(exact) << j
        return places, scores if exact is np.int64 else np.array([min(max(x, _LEAST), _MOST) for x in scores], np.int64)

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


_BLOCK = pa.schema([("dims", pa.int32()), ("kind", pa.int32()), ("b", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("vectors", pa.binary())])


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each block, vector length and kind (0 narrow, 1 wide, 2 huge components): its ids and its matrix, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from folioframe.llm import bitsliced as m

        part = TaskContext.get().partitionId()
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for c in (1, 2):
                own = batch.column(c).is_valid().to_numpy(zero_copy_only=False)
                vectors = batch.column(c).filter(pa.array(own))
                sizes = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                for d in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == d)
                    values = flat[starts[at][:, None] + np.arange(d)]
                    kind = (np.abs(values) >= _WIDE).any(1).astype(int) if c == 1 else np.full(len(at), 2)
                    for w in np.unique(kind).tolist():
                        k = kind == w
                        held.setdefault((d, w), []).append((ids[own][at][k], known[own][at][k], values[k].astype((np.int32, np.int64, np.float64)[w])))
        for (d, w), parts in held.items():
            ids, known, values = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_pylist([{"dims": d, "kind": w, "b": part, "ids": ids.tobytes(), "known": known.tobytes(), "vectors": values.tobytes()}], m._BLOCK)

    return rows.repartition(blocks).mapInArrow(run, "dims int, kind int, b int, ids binary, known binary, vectors binary")


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` holds, the k best other rows of ``df``."""
    spark = df.sparkSession
    ship(spark)
    v, huge = quantised(F.col(vector_col), scale)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), huge.alias("w"), F.coalesce(is_query, F.lit(False)).alias("q")).where("v IS NOT NULL OR w IS NOT NULL")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    index_blocks, query_blocks = max(1, -(-counts["n"] // INDEX_ROWS)), max(1, -(-counts["q"] // QUERY_ROWS))
    index = checkpointed(_packed(rows.select("id", "v", "w"), index_blocks))
    queries = checkpointed(_packed(rows.where("q").select("id", "v", "w"), query_blocks).withColumnRenamed("b", "qb"))
    most = max(1, -(-index_blocks * query_blocks // (TASKS * spread(spark))))
    run_blocks = min(most, max(1, INDEX_ROWS // QUERY_ROWS))
    runs = -(-query_blocks // run_blocks)
    left = index.select("b", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(-1).alias("qb"), "dims", "kind", "ids", "known", "vectors")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))).alias("b"), F.floor(F.col("qb") / run_blocks).cast("int").alias("run"), "qb", "dims", "kind", "ids", "known", "vectors")
    # the blocks of the index come before the queries of their run
    met = left.union(right).repartition(min(max(spread(spark), 1) * TASKS * 2, index_blocks * runs), "b", "run").sortWithinPartitions("b", "run", "qb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm.bitsliced import HUGE_ROWS, WIDE_ROWS, SlicedBlock, matrix

        now, held = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                ids, known = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["known"], bool)
                rows = matrix(x["kind"], x["vectors"], x["dims"], scale) if x["dims"] else np.zeros((len(ids), 0), np.int64)
                if (x["b"], x["run"]) != now:
                    now, held = (x["b"], x["run"]), {}
                own = held.setdefault(x["dims"], [])
                if x["qb"] < 0:
                    step = (len(rows), WIDE_ROWS, HUGE_ROWS)[x["kind"]]
                    own += [SlicedBlock(ids[s : s + step], known[s : s + step], rows[s : s + step]) for s in range(0, len(rows), step)]
                    continue
                out: list[tuple] = []
                for block in own:
                    for p, q in enumerate(rows):
                        places, scores = block.top(q, int(ids[p]) if known[p] else None, k)
                        out.append((np.full(len(places), ids[p]), np.full(len(places), x["qb"] << 32 | x["kind"] << 30 | p), block.ids[places], block.known[places], scores))
                if out:
                    qid, at, vid, has, score = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.full(len(qid), x["dims"], np.int32)), pa.array(at.astype(np.int64)), pa.array(vid, mask=~has), pa.array(score)], ["query_id", "dims", "at", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, dims int, at long, vec_id long, score long")
    best = W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("row", F.struct("query_id", "dims", "at")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    left_64 = F.raise_error(F.concat(F.lit("score leaves 64 bits: query "), F.col("query_id").cast("string"))).cast("long")
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", F.when(F.col("score").isin(_LEAST, _MOST), left_64).otherwise(F.col("score")).alias("score"))
