"""A training corpus from documents: keep good text, keep one of each group of near copies, mix the sources, encode.

Each stage reads all that its predecessor kept, whole texts of any length, and returns the columns of documents, the last one ids by document.
Null texts, empty texts and null ids pass through every stage by the rules that the operators state. Extra columns are carried, whatever their
names (a row travels as one struct; ``mix`` needs names that do not begin with ``_mix_``). Every stage returns an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, convnet, mixing, ngram_join
from folioframe.llm._spark import checkpointed, table


#: Keys of rows to drop or to keep once (25 bytes each) up to which they are broadcast; beyond it the planner joins.
BROADCAST_KEYS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network does not reject (score of 0.5 or more; equal texts score alike; null and empty texts are scored as no bytes).

    Without labels of both classes all have one score, the share of good labels, 0.5 without labels: all stay, or all go.
    """
    carried = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    scored = convnet.score(carried, table(spark, sf_dir, "labels"), folds=3, fold=1, carry=("_row",))
    return scored.where("predicted = 1").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group linked by five-word shingles at a similarity of 0.8 or more.

    Rows that equal each other in id and text are one document, of which any row stays; of equal ids with different texts in a group, the one of smallest text hash stays; a
    null id is larger than others. Texts without words link with nothing: all that differ in id stay.
    """
    found = ngram_join.link(docs, words=5, num=8, den=10)
    key = F.coalesce(F.col("id"), F.lit(0)).alias("_k"), F.col("id").isNull().alias("_n"), F.col("text_hash").alias("_h")
    alone = found.where("n_shingles = 0").select("id", "text_hash")
    first = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("f"))
    kept = first.select("f.id", "f.text_hash").union(alone).distinct().select(*key, F.lit(True).alias("_kept"))
    # most rows are kept and occur once; keys of the others are few, and only these meet the texts
    number = found.select(*key).groupBy("_k", "_n", "_h").agg(F.count("*").alias("_c"))
    other = number.join(kept, ["_k", "_n", "_h"], "left").where("_kept IS NULL OR _c > 1").select("_k", "_n", "_h", F.coalesce("_kept", F.lit(False)).alias("_one"))
    other = checkpointed(other)
    size = other.agg(F.count("*").alias("n"), F.count_if("_one").alias("repeated")).first()
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_n"), F.xxhash64("text").alias("_h"))
    marked = rows.join(F.broadcast(other) if size["n"] <= BROADCAST_KEYS else other, ["_k", "_n", "_h"], "left")
    out = marked.where("_one IS NULL").select("_row.*")
    return out.unionByName(marked.where("_one").dropDuplicates(["_k", "_n", "_h"]).select("_row.*")) if size["repeated"] else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (weights 5, 2, 1, repeating) takes them: by hash of id and text, so reruns agree and equal rows go together."""
    return mixing.apply_plan(docs, weights=(5, 2, 1), max_repeats=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the byte-level BPE of every row, as count and digests, with the digest of what they decode to; null and empty texts have no ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: Learned scores and merges by rank are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the checkpoint folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
