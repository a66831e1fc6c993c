"""Embedded images, references to images, and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: an image embedded in Markdown, and the first bytes of image formats
EMBEDDED = r"!\[([^\]]*)\]\(\s*data:image/([a-zA-Z0-9.+-]+);base64,([A-Za-z0-9+/=\s]+)\)"
MAGICS = [("FFD8FF", "jpg"), ("89504E47", "png"), ("47494638", "gif"), ("424D", "bmp"), ("3C737667", "svg")]


def extension(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k == "jpeg", "jpg").when(k == "svg+xml", "svg").otherwise(k)


def embedded_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, ext, digest, size, name``: decodable embedded images; equal contents share the name that the first of them gets."""
    group = lambda n: F.regexp_extract_all(F.col(text), F.lit(EMBEDDED), F.lit(n))
    rows = docs.where(F.col(text).contains("base64,")).select(key, F.posexplode(F.arrays_zip(group(2).alias("k"), group(3).alias("d"))).alias("pos", "x"))
    data = F.try_to_binary(F.regexp_replace("x.d", r"\s", ""), F.lit("base64"))
    rows = rows.select(key, "pos", extension(F.col("x.k")).alias("ext"), data.alias("content")).where(F.col("content").isNotNull())
    rows = rows.select(key, "pos", "ext", F.md5("content").alias("digest"), F.length("content").cast("long").alias("size"))
    first = rows.groupBy(key, "digest").agg(F.min(F.struct("pos", "ext")).alias("f"))
    named = first.withColumn("name", F.format_string("img_%03d.%s", F.row_number().over(W.partitionBy(key).orderBy("f.pos")), F.col("f.ext")))
    return rows.join(named.select(key, "digest", "name"), [key, "digest"]).select(key, "pos", "ext", "digest", "size", "name")


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = "images") -> DataFrame:
    """``key, text, n_images, saved``: texts with references to files instead of embedded images, and the bytes that this saves.

    Images that cannot be decoded stay as they are. ``embedded_images`` gives the files.
    """
    rows = docs.select(key, text)
    named = embedded_images(rows, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "name"))).alias("_names"))
    group = lambda n: F.regexp_extract_all(F.col(text), F.lit(EMBEDDED), F.lit(n))
    put = F.transform(F.arrays_zip(group(0).alias("whole"), group(1).alias("alt")), lambda x, i: F.coalesce(F.concat(F.lit("!["), x["alt"], F.lit(f"]({folder}/"), F.try_element_at(F.col("_names"), i), F.lit(")")), x["whole"]))
    between = F.split(F.col(text), EMBEDDED)
    new = F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(F.col("_put"), i), F.lit(""))))), "")
    out = rows.join(named, key, "left").withColumn("_put", put).withColumn("_new", F.when(F.col("_names").isNull(), F.col(text)).otherwise(new))
    saved = (F.octet_length(text) - F.octet_length("_new")).cast("long")
    return out.select(key, F.col("_new").alias(text), F.coalesce(F.size(F.array_distinct(F.map_values("_names"))), F.lit(0)).cast("long").alias("n_images"), saved.alias("saved"))


def dedupe(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """``digest, first, copies, size``: one row for each distinct content."""
    return rows.groupBy(F.md5(content).alias("digest")).agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first(F.length(content)).cast("long").alias("size"))


def sniffed(content: Column) -> Column:
    """Image format by first bytes, or null."""
    out = F.lit(None).cast("string")
    for magic, ext in reversed(MAGICS):
        out = F.when(F.startswith(content, F.unhex(F.lit(magic))), ext).otherwise(out)
    return out


def image_refs(docs: DataFrame, images: DataFrame) -> DataFrame:
    """``doc_id, pos, recindex, name``: references by base-36 embed or decimal recindex, with the image's name or an empty string."""
    embeds = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<img[^>]*?src=[\"']kindle:embed:([0-9A-Za-z]+)[^>]*>"), F.lit(1)), lambda x: F.conv(x, 36, 10).try_cast("int"))
    plain = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<(?:img|image)[^>]*?recindex=[\"']?(\d+)[\"']?[^>]*>"), F.lit(1)), lambda x: x.try_cast("int"))
    rows = docs.select("doc_id", F.posexplode(F.concat(embeds, plain)).alias("pos", "recindex"))
    return rows.join(images, ["doc_id", "recindex"], "left").select("doc_id", "pos", "recindex", F.coalesce("name", F.lit("")).alias("name"))


def hotwords(lines: DataFrame, order: str = "line_no", text: str = "text") -> DataFrame:
    """One row: the words of a list, without blank lines and comments, in file order, joined by spaces."""
    s = F.trim(F.col(text))
    kept = lines.where((s != "") & ~F.startswith(s, F.lit("#"))).select(F.struct(F.col(order).alias("o"), s.alias("s")).alias("x"))
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), " ").alias("hotwords"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of transcripts: one that is a single line is cut after the ideographic full stop, others have a line each."""
    cut = F.when(F.col(text).contains("\n"), F.split(text, "\n")).otherwise(F.regexp_extract_all(F.col(text), F.lit("[^。]+。?"), F.lit(0)))
    return docs.select(key, F.posexplode(cut).alias("sentence_no", "sentence"))
