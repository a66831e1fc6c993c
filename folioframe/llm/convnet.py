"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP, the last one padded with zeros, so that every byte is in a
chunk. FILTERS learned filters of WIDTH bytes slide over each chunk by two bytes; one byte has one learned
weight for each place in a filter. Each filter's highest positive response in a chunk is kept. The chunks' responses are combined by their mean
and their maximum over the document, and a logistic unit turns both into one probability.

Training (on the driver) takes at most ``per_class`` labelled documents of either class, those of lowest id hash, and of them, in that order,
as many as ``TRAIN_BYTES`` have room for; all their chunks are learned from. So it costs the same for any corpus; scoring reads every byte of every text. Labels, language,
source and id are not inputs.

Edge cases: null or empty text is one chunk of zeros and gets a score like any other; very long texts are scored piece by piece in bounded
memory; repeated rows get equal scores; labels that are null are not used; of an id's several labels all are used;
without labels of both classes every score is the share of label 1 (0.5 without labels); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm._spark import ship
from folioframe.llm._words import steps, tidied

CHUNK, OVERLAP, WIDTH, FILTERS = 256, 32, 8, 24
#: Bounds of the labelled sample: documents of a class, and bytes of all documents; a document that would exceed these is passed over.
PER_CLASS, TRAIN_BYTES = 1_000, 8_000_000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 7
_STEP = CHUNK - OVERLAP
#: Bytes that are scored at once: of short texts together, and of one long text (a whole number of chunks).
STEP_BYTES = 1 << 18
PIECE = _STEP * 1024


def chunk_starts(size: int) -> np.ndarray:
    """Where a text's chunks begin."""
    return np.arange(max(1, -(-(size - OVERLAP) // _STEP))) * _STEP


class ConvNet:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (2, FILTERS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.constant: float | None = None
        self._pairs: np.ndarray | None = None

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, prior: float) -> None:
        """``docs``: for each document its chunks (uint8, chunks x CHUNK); ``prior``: share of label 1 among all labelled documents."""
        rng = np.random.default_rng(SEED)
        params = [self.kernel, self.shift, self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(docs))
            rate = RATE * (1 - epoch / EPOCHS)
            for s in range(0, len(order), BATCH):
                own = order[s : s + BATCH]
                grads = self._gradients([docs[k] for k in own], labels[own])
                t += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        # the sample holds both classes alike; scores are for documents as they come
        share = labels.mean()
        self.bias += np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))

    def _gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
        chunks = np.concatenate(docs)
        count = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), count)
        n = (CHUNK - WIDTH) // 2 + 1
        # responses to two bytes at once, for the pairs that occur
        pairs, at = np.unique(np.ascontiguousarray(chunks).view("<u2"), return_inverse=True)
        at = at.reshape(len(chunks), CHUNK // 2)
        z = np.zeros((len(chunks), n, FILTERS), self.kernel.dtype)
        for j in range(0, WIDTH, 2):
            z += (self.kernel[j][pairs & 255] + self.kernel[j + 1][pairs >> 8])[at[:, j // 2 : j // 2 + n]]
        best = z.argmax(1)
        top = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + self.shift
        h = np.maximum(top, 0)
        starts = np.cumsum(count) - count
        mean = np.add.reduceat(h, starts) / count[:, None]
        most = np.maximum.reduceat(h, starts)
        p = 1 / (1 + np.exp(-np.clip(mean @ self.out[0] + most @ self.out[1] + self.bias, -30, 30)))
        d = ((p - labels) / len(docs)).astype(np.float32)
        g_out = np.stack([d @ mean, d @ most]) + 1e-4 * self.out
        is_top = (h == most[owner]) / np.maximum(np.add.reduceat(h == most[owner], starts), 1)[owner]
        g_h = d[owner, None] * (self.out[0] / count[owner, None] + self.out[1] * is_top) * (top > 0)
        g_kernel = np.zeros_like(self.kernel)
        row, f = np.nonzero(g_h)
        at, g = best[row, f] * 2, g_h[row, f].astype(np.float32)
        for j in range(WIDTH):
            g_kernel[j] = np.bincount(chunks[row, at + j].astype(np.int64) * FILTERS + f, g, 256 * FILTERS).reshape(256, FILTERS)
        return [g_kernel + 1e-5 * self.kernel, g_h.sum(0).astype(np.float32), g_out.astype(np.float32), np.array([d.sum()], np.float32)]

    def _pair_tables(self) -> np.ndarray:
        """Responses to two bytes at once: tables[k][b + 256 * c] for bytes b, c at places 2k, 2k + 1."""
        if self._pairs is None:
            even, odd = self.kernel[0::2], self.kernel[1::2]
            self._pairs = (odd[:, :, None, :] + even[:, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS)
        return self._pairs

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean and maximum over chunks, for each text: texts x 2 x FILTERS."""
        tables = self._pair_tables()
        parts, starts, owner, at = [], [], [], 0
        for k, t in enumerate(texts):
            own = chunk_starts(len(t))
            size = int(own[-1]) + CHUNK
            parts.append(t.ljust(size, b"\0"))
            starts.append(own + at)
            owner.append(np.full(len(own), k))
            at += size
        data = np.frombuffer(b"".join(parts), "<u2")
        n = len(data) - WIDTH // 2 + 1
        z = np.full((n + 1, FILTERS), -np.inf, np.float32)
        z[:n] = tables[0][data[:n]]
        for j in range(1, WIDTH // 2):
            z[:n] += tables[j][data[j : j + n]]
        begin = np.concatenate(starts) // 2
        cuts = np.stack([begin, begin + (CHUNK - WIDTH) // 2 + 1], 1).ravel()
        h = np.maximum.reduceat(z, cuts)[0::2]
        h = np.maximum(h + self.shift, 0)
        count = np.bincount(np.concatenate(owner), minlength=len(texts))
        first = np.cumsum(count) - count
        return np.stack([np.add.reduceat(h, first), np.maximum.reduceat(h, first), np.broadcast_to(count[:, None], (len(texts), FILTERS))], 1)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One probability of label 1 for each text; long texts go through in pieces."""
        out = np.empty(len(texts))
        if self.constant is not None:
            out[:] = self.constant
            return out
        for first, held in steps(texts, STEP_BYTES):
            if len(held) == 1 and len(held[0]) > PIECE + OVERLAP:
                t = held[0]
                runs = [self.features([t[a : a + PIECE + OVERLAP]])[0] for a in range(0, len(t) - OVERLAP, PIECE)]
                total, most, count = sum(r[0] for r in runs), np.max([r[1] for r in runs], 0), sum(r[2] for r in runs)
                f = np.stack([total, most, count])[None]
            else:
                f = self.features(held)
            logit = (f[:, 0] / f[:, 2]) @ self.out[0] + f[:, 1] @ self.out[1] + self.bias
            out[first : first + len(held)] = 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(np.float64)))
        return out


def all_chunks(text: bytes) -> np.ndarray:
    """The chunks of a text."""
    return np.frombuffer(b"".join(text[a : a + CHUNK].ljust(CHUNK, b"\0") for a in chunk_starts(len(text)).tolist()), np.uint8).reshape(-1, CHUNK)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ConvNet:
    """A net for ``docs`` (id, t) and ``labels`` (id, y): a bounded sample of each class is fetched."""
    labels = labels.where("y in (0, 1)").select("id", F.col("y").cast("int").alias("y"))
    count = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    net = ConvNet()
    if len(count) < 2:
        net.constant = float(next(iter(count))) if count else 0.5
        return net
    order = [F.xxhash64("id", F.lit(SEED)), F.col("id")]
    chosen = labels.where("y = 0").orderBy(*order).limit(per_class).union(labels.where("y = 1").orderBy(*order).limit(per_class))

    # at most 2 * per_class rows of an id and a label are broadcast, their documents' sizes fetched, and then TRAIN_BYTES of texts at most
    of = docs.join(F.broadcast(chosen), "id").select("id", "y", F.octet_length("t").alias("size"), F.xxhash64("t").alias("h"))
    first = [F.xxhash64("id", F.lit(SEED)), "id", "y", "h"]
    sizes = of.orderBy(*first).limit(2 * per_class).collect()
    room, taken = TRAIN_BYTES, []
    for r in sizes:
        if r["size"] <= room:
            room -= r["size"]
            taken.append((r["id"], r["y"], r["h"]))
    wanted = docs.sparkSession.createDataFrame(sorted(set(taken)), f"id {docs.schema['id'].dataType.simpleString()}, y int, h long")
    texts = docs.withColumn("h", F.xxhash64("t")).join(F.broadcast(wanted), ["id", "h"]).select("id", "y", "h", "t").orderBy(*first).limit(len(taken)).collect()
    rows = [(r["y"], (r["t"] or "").encode()) for r in texts]
    y = np.array([label for label, _ in rows], np.float32)
    prior = count[1] / (count[0] + count[1])
    if len(set(y.tolist())) < 2:
        net.constant = prior
        return net
    net.fit([all_chunks(t) for _, t in rows], y, prior)
    return net


def trains(ident: Column, folds: int, fold: int) -> Column:
    """Whether a row's label may be learned from."""
    return ~held_out(ident, folds, fold)


def held_out(ident: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(df: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row (and the columns in ``carry``); labels of the held-out fold are not learned from."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    seen = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(trains(F.col("id"), folds, fold))
    net = train(docs, seen, per_class)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            p = shared.value.probabilities([x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_net_text"), id_col, held_out(F.col(id_col), folds, fold).alias("held_out"), *carry)
    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{sql}, score double, predicted int")
