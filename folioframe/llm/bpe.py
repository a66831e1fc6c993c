"""Byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree stands over the byte
positions of a match; its leaf ``i`` holds ``rank * width + i`` of the pair that begins at live position ``i``,
so the root is the leftmost pair of the lowest rank. A merge changes three leaves (the pair itself, the pair before it
and the swallowed position), each by one walk to the root: O(n log n) for a match of n bytes. Matches that a worker
has not met before are merged together, many trees as the rows of one numpy array; its cache of
merged matches is emptied when full, so memory does not grow with the input.

Edge cases: null or empty text has no ids and decodes to no bytes; a very long match (megabytes without a break)
takes the same tree one match at a time; repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioframe.llm._spark import ship
from folioframe.llm._words import steps, tidied

#: Matches that a worker's cache holds before it is emptied.
CACHE_MATCHES = 300_000
#: Bytes of text that are split at once.
STEP_BYTES = 1 << 19
#: Longest match (bytes) that is merged beside others; longer ones are merged alone.
WIDE = 128
_NONE = np.int64(2**62)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class Encoder:
    """Merges by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * size
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of matches of at most ``width`` bytes (a power of two)."""
        rows = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        ids = np.zeros((rows, width + 1), np.int32)
        ids[:, :width] = self.byte_id[data]
        place = np.arange(width + 1)
        following = np.where(place[None, :] + 1 < sizes[:, None], place[None, :] + 1, width)
        before = np.broadcast_to(place - 1, (rows, width + 1)).copy()
        live = place[None, :width] < sizes[:, None]
        tree = np.full((rows, 2 * width), _NONE)
        r, c = np.nonzero(place[None, :width] + 1 < sizes[:, None])
        rank = self._pair(ids[r, c], ids[r, c + 1])
        has = rank >= 0
        tree[r[has], width + c[has]] = rank[has] * width + c[has]
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        at = np.flatnonzero(tree[:, 1] < _NONE)
        while len(at):
            root = tree[at, 1]
            i = root % width
            j = following[at, i]
            k = following[at, j]
            ids[at, i] = root // width
            live[at, j] = False
            following[at, i] = k
            before[at, k] = i
            h = before[at, i]
            after = np.where(k < width, self._pair(ids[at, i], ids[at, k]), -1)
            ahead = np.where(h >= 0, self._pair(ids[at, h], ids[at, i]), -1)
            h = np.where(h >= 0, h, i)
            ahead = np.where(before[at, i] >= 0, ahead, after)
            for leaf, rank in ((j, np.full(len(at), -1)), (i, after), (h, ahead)):
                node = width + leaf
                tree[at, node] = np.where(rank >= 0, rank * width + leaf, _NONE)
                node >>= 1
                while node[0]:
                    tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
                    node = node >> 1
            at = at[tree[at, 1] < _NONE]
        kept = ids[:, :width][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        return [kept[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, piece: bytes) -> bytes:
        """The same tree for one long match, in plain lists."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none, get = 1 << 62, self.pairs.get
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for p in range(n - 1):
            rank = get(ids[p] << 32 | ids[p + 1])
            if rank is not None:
                tree[width + p] = rank * width + p
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, rank: int | None) -> None:
            node = width + leaf
            tree[node] = none if rank is None else rank * width + leaf
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        live = [True] * n
        while (root := tree[1]) < none:
            rank, i = divmod(root, width)
            j = following[i]
            k, h = following[j], before[i]
            ids[i], live[j], following[i] = rank, False, k
            put(j, None)
            put(i, get(rank << 32 | ids[k]) if k < n else None)
            if k < n:
                before[k] = i
            if h >= 0:
                put(h, get(ids[h] << 32 | rank))
        return np.array([t for t, x in zip(ids, live) if x], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each match, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        wide: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[k] = self._merge_one(p)
            elif p:
                wide.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        for width, places in wide.items():
            step = max(1, (1 << 19) // width)
            for s in range(0, len(places), step):
                run = places[s : s + step]
                for k, ids in zip(run, self._merge_rows([pieces[k] for k in run], max(2, width))):
                    out[k] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian unsigned 32-bit integers."""
        a = np.frombuffer(ids, "<u4")
        n = self.lengths[a]
        total = int(n.sum())
        first = np.cumsum(n) - n
        return self.bytes[np.arange(total) + np.repeat(self.starts[a] - first, n)].tobytes()


class TextEncoder:
    """Splits texts by a pattern and keeps the ids of matches already merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.encoder = Encoder(ranks)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        fresh = list(set().union(*pieces).difference(self.cache)) if pieces else []
        if len(self.cache) + len(fresh) > CACHE_MATCHES:
            self.cache = {}
            fresh = list(set().union(*pieces))
        self.cache.update(zip(fresh, self.encoder.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


_KEPT: dict[tuple[int, str], TextEncoder] = {}


def _text_encoder(shared, pattern: str) -> TextEncoder:
    """One encoder for all tasks that a worker runs with the same broadcast vocabulary."""
    key = (shared._jid if hasattr(shared, "_jid") else id(shared), pattern)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = TextEncoder(shared.value, pattern)
    return _KEPT[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids of every text of ``df``.

    Returns ``id_col, ids array<int>`` or, with ``digests``, ``id_col, n_tokens, ids_sha256, decoded_sha256``: hashes of the ids as
    little-endian unsigned 32-bit integers and of the bytes that those ids decode to. The vocabulary file is read on the
    driver and broadcast; its size is that of the public file, whatever the input.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import bpe

        enc = bpe._text_encoder(shared, pattern)
        for batch in tidied(batches):
            whole: list[bytes] = []
            for _, held in steps((x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()), STEP_BYTES):
                whole += enc.encode_all([x.decode("utf-8", "replace") for x in held])
            if digests:
                cols = [
                    pa.array([len(x) // 4 for x in whole], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in whole], pa.string()),
                    pa.array([hashlib.sha256(enc.encoder.decode(x)).hexdigest() for x in whole], pa.string()),
                ]
            else:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in whole])]).astype(np.int32)
                cols = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(whole), "<i4")))]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, *names])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {out}")


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """``id_col, text``: what the ids of each row decode to; bytes that are no UTF-8 are replaced. Null ids give null."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from folioframe.llm import bpe

        enc = bpe._text_encoder(shared, "").encoder
        for batch in tidied(batches):
            out = [None if x is None else enc.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
