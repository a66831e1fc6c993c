"""Mixing sources to target weights by hash thresholds.

Every document has a 48-bit hash of its id and text. For each source, token sums by hash bucket (12 bits) show in which bucket the
source's budget ends; only that bucket is summed again by its next 12 bits, and so on until one hash value is left. A document is
taken when its hash is below its source's threshold: no rows are sorted, a source of any size is spread over all tasks, a larger budget takes
a superset of a smaller one, and reruns agree.

Targets: sources by code point (null last) weigh ``weights`` in turn and share the sum of all sizes; a
target stops at ``max_repeats`` times its source's size and the excess is shared by weight among the rest. A source with a target above its
size is taken ``floor(target / size)`` times whole and once more up to the threshold of the remainder.

Edge cases: null text has size 0; null is a source of its own; rows that equal each other in id (null or not) and text share a hash and are taken
together; rows without words follow their hash too and are taken ``max_repeats`` times at most; a source without words has target 0; an empty table gives an empty result; other columns are carried by
``apply_plan`` and may have any name that does not begin with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.llm._spark import checkpointed

#: Sources up to which their table (one row of about 60 bytes each) is broadcast; beyond it the join is left to the planner.
BROADCAST_SOURCES = 100_000
#: Hash bits, and bits that one refinement resolves.
BITS, STEP = 48, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(ident: Column, text: Column) -> Column:
    both = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int) -> DataFrame:
    """``sizes`` (_mix_source, _mix_total): one row a source. Adds _mix_target.

    With sources in the order in which they reach their caps, the common rate of all that stay below theirs has a closed form.
    """
    by_name = W.orderBy(F.col("_mix_source").isNull(), "_mix_source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    t = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    t = t.withColumn("_cap", F.col("_mix_total") * max_repeats).withColumn("_all", F.sum("_mix_total").over(W.partitionBy()))
    fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col("_mix_source").isNull(), "_mix_source")
    t = t.withColumn("_before", F.sum("_cap").over(fill.rowsBetween(W.unboundedPreceding, -1)))
    t = t.withColumn("_left", F.sum("_w").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
    rate = (F.col("_all") - F.coalesce("_before", F.lit(0))).cast("double") / F.col("_left")
    t = t.withColumn("_rate", rate).withColumn("_open", F.col("_rate") * F.col("_w") <= F.col("_cap"))
    t = t.withColumn("_rate", F.max(F.when(F.col("_open"), F.struct(-F.row_number().over(fill), "_rate"))).over(W.partitionBy())["_rate"])
    target = F.least(F.coalesce(F.col("_rate") * F.col("_w"), F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return t.select("_mix_source", "_mix_total", target.alias("_mix_target"))


def plan(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with _mix_source, _mix_size and _mix_hash; one row a source with its target, whole copies and threshold)."""
    sized = checkpointed(df.select(F.col(id_col), F.col(source_col).alias("_mix_source"), words(F.col(text_col)).alias("_mix_size"), row_hash(F.col(id_col), F.col(text_col)).alias("_mix_hash")))
    sources = sized.groupBy("_mix_source").agg(F.sum("_mix_size").alias("_mix_total"))
    state = targets(sources, weights, max_repeats)
    ratio = F.when(F.col("_mix_total") > 0, F.floor(F.col("_mix_target") / F.col("_mix_total"))).otherwise(0).cast("long")
    state = state.withColumn("_mix_copies", ratio).withColumn("_rest", F.col("_mix_target") - F.col("_mix_copies") * F.col("_mix_total"))
    state = checkpointed(state.withColumn("_at", F.lit(0).cast("long")).withColumn("_below", F.lit(0).cast("long")).withColumn("_here", F.lit(0).cast("long")))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = with_plan(sized, state).where(F.shiftright("_mix_hash", shift + STEP) == F.col("_at"))
        sums = inside.groupBy(F.col("_mix_source").alias("_s"), F.shiftright("_mix_hash", shift).alias("_b")).agg(F.sum("_mix_size").alias("_sum"), F.first("_rest").alias("_r"), F.first("_below").alias("_base"))
        run = sums.withColumn("_cum", F.col("_base") + F.sum("_sum").over(W.partitionBy("_s").orderBy("_b")))
        edge = run.where(F.col("_cum") > F.col("_r")).groupBy("_s").agg(F.min(F.struct("_b", "_cum", "_sum")).alias("_e"))
        state = state.join(edge, F.col("_mix_source").eqNullSafe(F.col("_s")), "left").select(
            "_mix_source", "_mix_total", "_mix_target", "_mix_copies", "_rest",
            F.coalesce(F.col("_e._b"), F.lit(-1).cast("long")).alias("_at"), F.coalesce(F.col("_e._cum") - F.col("_e._sum"), F.lit(0)).alias("_below"), F.coalesce("_e._sum", F.lit(0)).alias("_here"),
        )
        state = checkpointed(state)
    nearer = F.abs(F.col("_below") + F.col("_here") - F.col("_rest")) < F.abs(F.col("_below") - F.col("_rest"))
    edge = F.when((F.col("_at") < 0) | (F.col("_rest") <= 0), 0).otherwise(F.col("_at") + nearer.cast("long"))
    return sized, state.select("_mix_source", "_mix_total", "_mix_target", "_mix_copies", edge.alias("_mix_edge"))


def with_plan(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with _mix_source, joined with their source's row of the plan."""
    small = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = state.withColumnRenamed("_mix_source", "_mix_plan_source")
    return rows.join(F.broadcast(named) if small else named, F.col("_mix_source").eqNullSafe(F.col("_mix_plan_source"))).drop("_mix_plan_source")


def copies() -> Column:
    """How often a row is taken."""
    return F.col("_mix_copies") + (F.col("_mix_hash") < F.col("_mix_edge")).cast("long")


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, size, source_size, target, taken`` of every row."""
    sized, state = plan(df, weights, max_repeats, id_col, text_col, source_col)
    return with_plan(sized, state).select(F.col(id_col), F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * copies()).alias("taken"))


def apply_plan(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every row of ``df``, all columns, as often as the mix takes it."""
    _, state = plan(df, weights, max_repeats, id_col, text_col, source_col)
    rows = df.withColumn("_mix_source", F.col(source_col)).withColumn("_mix_hash", row_hash(F.col(id_col), F.col(text_col)))
    taken = with_plan(rows, state).withColumn("_mix_n", copies()).where(F.col("_mix_n") > 0)
    return taken.withColumn("_mix_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n")))).select(*[F.col(f"`{c}`") for c in df.columns])
