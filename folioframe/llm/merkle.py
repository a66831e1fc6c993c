"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions only.

A section ends with a blank line, a paragraph with a line break, and a paragraph is cut into pieces at sentence ends or after 32
characters; in texts of at most ``SHORT`` characters, after 4. Every character is in exactly one piece, so the pieces spell the text. A piece's digest is its
64-bit hash, a paragraph's the hash of its pieces' digests, a section's that of its paragraphs', and the root is the SHA-256 of the section digests.
Equal roots mean equal texts; where roots differ, sections, paragraphs and pieces that differ locate the edits.

The fingerprint string is the root in hex, a colon, and 8 hex digits for every piece in order. Two trees are compared from the top: sections at equal
places with equal digests are passed over, in the others paragraphs at equal places with equal digests; what remains are the differing branches. The likeness is
twice the number of pieces that agree (those under equal branches, and the distinct ones that the differing branches have in common, wherever
they moved to) over that number and the distinct pieces of either side's differing branches: 1 for equal roots, 0 when nothing agrees.

Edge cases: null text counts as empty; the empty text has a root and no pieces; very long texts grow their own row's tree only;
repeated rows repeat their result; a text of at most ``SHORT`` characters has nothing in common with a longer one. For ``with_edits`` documents stand in order of id (null first), then of text hash; rows with equal id and
text are one document there and get the same answer; with one document it is its own successor; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.llm._spark import checkpointed

#: Documents in a range of ids, and the least number of ranges in which successors are looked up beside each other.
RANGE_ROWS, RANGES = 1_000_000, 64
#: Characters up to which a text is cut into short pieces, and the two cuts.
SHORT = 128
_SHORT_PIECES, _PIECES = r"(?s).{1,4}", r"[^.!?]{1,32}[.!?]*|[.!?]+"


def tree(text: Column) -> Column:
    """Digests of the pieces, by section and paragraph: array<array<array<long>>>."""
    def cut(pattern: str) -> Column:
        def pieces(p: Column) -> Column:
            return F.transform(F.regexp_extract_all(p, F.lit(pattern), F.lit(0)), lambda x: F.xxhash64(x))

        def paragraphs(s: Column) -> Column:
            return F.transform(F.regexp_extract_all(s, F.lit(r"[^\n]*\n+|[^\n]+"), F.lit(0)), pieces)

        return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s).+?(?:\n{2,}|\z)"), F.lit(0)), paragraphs)

    return F.when(F.length(text) <= SHORT, cut(_SHORT_PIECES)).otherwise(cut(_PIECES))


def section_digests(t: Column) -> Column:
    return F.transform(t, lambda s: F.xxhash64(F.transform(s, lambda p: F.xxhash64(p))))


def paragraph_digests(t: Column) -> Column:
    return F.transform(F.flatten(t), lambda p: F.xxhash64(p))


def leaves(t: Column) -> Column:
    return F.flatten(F.flatten(t))


def root(t: Column) -> Column:
    return F.sha2(F.array_join(F.transform(section_digests(t), lambda d: F.hex(d)), ","), 256)


def rendered(root_hex: Column, piece_digests: Column) -> Column:
    low = F.transform(piece_digests, lambda d: F.lpad(F.hex(d.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.concat(root_hex, F.lit(":"), F.lower(F.array_join(low, "")))


def _paired(a: Column, b: Column) -> Column:
    """Branches at equal places side by side; one side is null where the other has more."""
    return F.zip_with(F.coalesce(a, F.array()), F.coalesce(b, F.array()), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def differing(a: Column, b: Column) -> Column:
    """Pairs (x, y) of paragraphs in which two trees differ, found from the top."""
    def digest(section: Column) -> Column:
        return F.xxhash64(F.transform(section, lambda p: F.xxhash64(p)))

    sections = F.filter(_paired(a, b), lambda s: s["x"].isNull() | s["y"].isNull() | (digest(s["x"]) != digest(s["y"])))
    paragraphs = F.flatten(F.transform(sections, lambda s: _paired(s["x"], s["y"])))
    return F.filter(paragraphs, lambda p: p["x"].isNull() | p["y"].isNull() | (F.xxhash64(p["x"]) != F.xxhash64(p["y"])))


def side(pairs: Column, name: str) -> Column:
    """Pieces of the differing branches of one tree ('x' or 'y')."""
    return F.flatten(F.transform(pairs, lambda p: F.coalesce(p[name], F.array().cast("array<bigint>"))))


def with_likeness(df: DataFrame, pieces: Column, trees: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds, by name, the likeness of two trees each, of which the first has ``pieces``. Every step has columns of its own, so that none is worked out twice."""
    df = df.withColumns({f"_{n}": differing(a, b) for n, (a, b) in trees.items()})
    df = df.withColumns({f"_{n}_{s}": side(F.col(f"_{n}"), s) for n in trees for s in "xy"})
    df = df.withColumns({f"_{n}_same": pieces - F.size(f"_{n}_x") for n in trees} | {f"_{n}_d{s}": F.array_distinct(f"_{n}_{s}") for n in trees for s in "xy"})
    out = {}
    for n in trees:
        same, x, y = F.col(f"_{n}_same"), F.col(f"_{n}_dx"), F.col(f"_{n}_dy")
        both = 2.0 * same + F.size(x) + F.size(y)
        out[n] = F.when(both == 0, 1.0).otherwise(2.0 * (same + F.size(F.array_intersect(x, y))) / both)
    return df.withColumns(out)


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of ``a``'s paragraphs that the tree ``b`` does not hold anywhere."""
    own = paragraph_digests(a)
    gone = F.array_except(own, paragraph_digests(b))
    return F.filter(F.transform(own, lambda d, i: F.when(F.array_contains(gone, d), i)), lambda i: i.isNotNull())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, root, fingerprint, tree`` of every row."""
    t = df.select(id_col, tree(F.col(text_col)).alias("tree"))
    return t.select(id_col, root(F.col("tree")).alias("root"), rendered(root(F.col("tree")), leaves(F.col("tree"))).alias("fingerprint"), "tree")


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (k long, h long, n) are distinct on (k, h); adds that of the row before: pk, ph, pn; the first row follows the last.

    Ranges of ids keep every window small, at any size; only the last row of each range is looked at together with others.
    """
    number = max(RANGES, -(-keys.count() // RANGE_ROWS))
    keys = checkpointed(keys.repartitionByRange(number, "k", "h").withColumn("r", F.spark_partition_id()))
    inside = W.partitionBy("r").orderBy("k", "h")
    ends = keys.groupBy("r").agg(F.max(F.struct(F.col("k").isNotNull(), "k", "h", "n")).alias("last"))
    every = W.orderBy("r")
    ends = ends.withColumn("e", F.coalesce(F.lag("last").over(every), F.last("last").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    ends = ends.select(F.col("r").alias("er"), "e")
    row = F.struct(F.col("k").isNotNull(), "k", "h", "n")
    keys = keys.withColumn("p", F.lag(row).over(inside)).join(F.broadcast(ends), F.col("r") == F.col("er"))
    p = F.coalesce("p", "e")
    return keys.select("k", "h", "n", p["k"].alias("pk"), p["h"].alias("ph"), p["n"].alias("pn"))


def with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n / 4) code points give way to the first of the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Texts are
    shuffled once, by id and hash; what goes to the document before is the start of the text that it needs and the tree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("k"), text.alias("t"), F.xxhash64(text).alias("h"))
    keys = checkpointed(docs.select("k", "h", F.length("t").cast("long").alias("n")).distinct())
    before = successors(keys)
    held = docs.select(F.coalesce("k", F.lit(0)).alias("kk"), F.col("k").isNull().alias("kn"), "h", "t")  # the same columns for both uses, so that one shuffle serves them
    link = before.select(F.coalesce("k", F.lit(0)).alias("kk"), F.col("k").isNull().alias("kn"), "h", "pk", "ph", "pn")
    # each document, once, sends what its predecessor needs
    sent = held.join(link, ["kk", "kn", "h"]).select("pk", "ph", F.expr("substring(t, 1, cast(floor(pn / 4) as int))").alias("start"), tree(F.col("t")).alias("next_tree"))
    sent = sent.groupBy(F.coalesce("pk", F.lit(0)).alias("kk"), F.col("pk").isNull().alias("kn"), F.col("ph").alias("h")).agg(F.first(F.struct("start", "next_tree")).alias("s"))
    x = held.join(sent, ["kk", "kn", "h"])
    n = F.length("t")
    x = x.select(F.when(~F.col("kn"), F.col("kk")).alias("k"), "t", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 4) as int))"), F.col("s.start")).alias("edited"), F.col("s.next_tree").alias("c"))
    x = x.select("k", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("t")).alias("a"), tree(F.col("edited")).alias("b"), "c")
    x = x.withColumn("la", leaves(F.col("a")))
    x = with_likeness(x, F.size("la"), {"near_edited": (F.col("a"), F.col("b")), "near_next": (F.col("a"), F.col("c"))})
    prints = rendered(root(F.col("a")), F.col("la")).alias("fingerprint"), rendered(root(F.col("b")), leaves(F.col("b"))).alias("edited_fingerprint")
    return x.select(F.col("k").alias(id_col), "n_chars", "edited_sha256", *prints, "near_edited", "near_next")
