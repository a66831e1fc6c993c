"""Document audit: text volume, line cleaning, faults, page tiers, verdicts and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import tables as tb
from folioframe.operators import tokens as tk


def volume(pages: DataFrame, keys: list[str], text: str = "text", least: int = 20) -> DataFrame:
    """``keys, n_pages, n_chars, scanned``: a document with fewer than ``least`` characters a page has no text layer."""
    out = pages.groupBy(*keys).agg(F.count("*").alias("n_pages"), F.sum(F.length(text)).cast("long").alias("n_chars"))
    return out.withColumn("scanned", F.coalesce("n_chars", F.lit(0)) < least * F.col("n_pages"))


def volume_verdict(md: Column, source: Column, red_below: float = 0.7) -> tuple[Column, Column]:
    """(ratio, finding) of two lengths."""
    ratio = F.when(source > 0, md / source).otherwise(0.0)
    return ratio, F.when(ratio < red_below, "content_lost").when(ratio.between(0.8, 1.4), "normal").otherwise("unusual")


def without_running_heads(lines: DataFrame, keys: list[str], order: str = "line_no", text: str = "text") -> DataFrame:
    """Lines between the first and the last that is no running head; such lines in between stay."""
    body = F.when(~t.is_running_head(F.col(text)), F.col(order))
    w = W.partitionBy(*keys)
    kept = lines.withColumn("_a", F.min(body).over(w)).withColumn("_z", F.max(body).over(w))
    return kept.where(F.col(order).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")


def body_lines(lines: Column) -> Column:
    """struct<first, last, lines> of an array of lines: numbers of the first and the last that is no running head, and the lines from one to the other."""
    heads = F.transform(lines, lambda x: ~t.is_running_head(x))
    first = F.array_position(heads, True)
    last = F.size(lines) + 1 - F.array_position(F.reverse(heads), True)
    return F.when(first > 0, F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), F.slice(lines, first.cast("int"), (last - first + 1).cast("int")).alias("lines")))


def contents_pages(lines: DataFrame, keys: list[str], text: str = "text", least_lines: int = 6, least_leaders: int = 5) -> DataFrame:
    """``keys, n_lines, n_leaders, is_contents`` of pages, from their lines."""
    out = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(t.has_leader(F.col(text))).alias("n_leaders"))
    return out.withColumn("is_contents", (F.col("n_lines") >= least_lines) & (F.col("n_leaders") >= least_leaders))


def lines_from_words(words: DataFrame, keys: list[str], height: float = 3.0) -> DataFrame:
    """``keys, line, text``: words (text, x0, top, ord) clustered into lines by rounded height and joined from left to right."""
    rows = words.groupBy(*keys, F.bround(F.col("top") / height).cast("long").alias("line")).agg(F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))).alias("w"))
    return rows.select(*keys, "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"))


def glitches(docs: DataFrame, keys: list[str], text: str = "text", samples: int = 5, patterns: list[tuple[str, str]] = t.GLITCHES) -> DataFrame:
    """``keys, glitch, hits, samples``: each fault pattern (name, regular expression) that occurs, with its first few matches."""
    found = F.array(*[F.struct(F.lit(name).alias("glitch"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("m")) for name, p in patterns])
    rows = docs.select(*keys, F.explode(found).alias("g")).where(F.size("g.m") > 0)
    return rows.select(*keys, "g.glitch", F.size("g.m").cast("long").alias("hits"), F.array_join(F.slice("g.m", 1, samples), " ").alias("samples"))


def tiers(must: DataFrame, tables: DataFrame, formulas: DataFrame, keys: tuple[str, str] = ("doc_id", "page")) -> DataFrame:
    """``doc_id, page, tier``: A before B before C; a page has one tier."""
    every = must.select(*keys, F.lit("A").alias("tier")).union(tables.select(*keys, F.lit("B"))).union(formulas.select(*keys, F.lit("C")))
    return every.groupBy(*keys).agg(F.min("tier").alias("tier"))


def coverage(page_tiers: DataFrame, sizes: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id, n_listed, n_pages, too_many``: whether the pages to look at are more than ``share`` of all."""
    n = page_tiers.groupBy("doc_id").agg(F.count("*").alias("n_listed"))
    out = sizes.join(n, "doc_id", "left").na.fill(0, ["n_listed"])
    return out.select("doc_id", "n_listed", "n_pages", (F.col("n_listed") > F.col("n_pages") * share).alias("too_many"))


def capped_list(numbers: Column, cap: int = 25) -> Column:
    """The first ``cap`` numbers, and how many more there are."""
    shown = F.array_join(F.slice(numbers, 1, cap), ",")
    return F.when(F.size(numbers) == 0, "none").when(F.size(numbers) <= cap, shown).otherwise(F.concat(shown, F.lit(" +"), (F.size(numbers) - cap).cast("string")))


def sample_pages(pages: DataFrame, group: str, ident: str, k: int, seed: str = "audit") -> DataFrame:
    """``k`` pages of each group in order of a seeded digest; reruns agree."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(group).cast("string"), F.col(ident).cast("string")))
    return pages.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(order, ident))).where(F.col("rn") <= k)


def grade(missing: Column, errors: Column, many: int = 3) -> Column:
    """A: intact and no sampled error; C: gaps, or at least ``many`` errors; B between."""
    return F.when((missing == 0) & (errors == 0), "A").when((missing > 0) | (errors >= many), "C").otherwise("B")


def original_of(files: DataFrame) -> DataFrame:
    """Copies of a file: same stem without a numeric suffix, same size and digest. ``path, original`` (the least path of its group)."""
    stem = F.regexp_replace(t.stem(F.col("path")), r"(?:\s*\(\d+\)|[-_ ]\d+)$", "")
    keyed = files.select("path", stem.alias("stem"), F.length("content").alias("size"), F.md5("content").alias("digest"))
    first = keyed.groupBy("stem", "size", "digest").agg(F.min("path").alias("original"))
    return keyed.join(first, ["stem", "size", "digest"]).select("path", "original")


# fixed values: labels of a statement's provenance
VERIFIED, UNVERIFIED = "已回原件核实", "仅据转录、待核"


def provenance(findings: DataFrame, verified: DataFrame) -> DataFrame:
    """Adds ``provenance`` to findings (doc_id, page, ...): whether their page is among those looked at in the original (doc_id, page)."""
    seen = verified.select("doc_id", "page").distinct().withColumn("_seen", F.lit(True))
    return findings.join(seen, ["doc_id", "page"], "left").withColumn("provenance", F.when(F.col("_seen"), VERIFIED).otherwise(UNVERIFIED)).drop("_seen")


def transcription_pages(pages: DataFrame, md: DataFrame, tables: DataFrame, few_pages: int = 30, least: int = 20) -> DataFrame:
    """``doc_id, page, tier``: pages of originals to look at, from token deficits, tables and formulas.

    ``pages``: doc_id, page, text of the original; ``md``: doc_id, text of its transcription; ``tables``: doc_id, page, tbl_no, n_rows, n_cols of the original.
    """
    state, (src, shown) = _table_state(pages, md, tables, few_pages, least)
    layered = pages.join(state.where(~F.col("scanned")).select("doc_id"), "doc_id", "left_semi")
    lacking = tk.deficit(tk.multiset(layered, ["doc_id", "page"], F.col("text")), tk.multiset(md, ["doc_id"], t.normalised_markdown(F.col("text"))))
    pairs = tb.pair(src, shown)
    every = pages.select("doc_id", "page").join(state.select("doc_id", "pages_to"), "doc_id")
    held = src.select("doc_id", "page").distinct().join(state.select("doc_id", "pages_to"), "doc_id")
    must = lacking.select("doc_id", "page").union(every.where("pages_to = 'A'").select("doc_id", "page")).union(held.where("pages_to = 'source_pages'").select("doc_id", "page")).union(pairs.where("NOT same").select("doc_id", "page"))
    second = every.where("pages_to = 'B'").select("doc_id", "page").union(held.where("pages_to IN ('paired', 'none')").select("doc_id", "page"))
    return tiers(must, second, pages.where(t.is_formula(F.col("text"))))


def _table_state(pages: DataFrame, md: DataFrame, tables: DataFrame, few_pages: int, least: int):
    """Volume and table findings by document; tables of originals with a text layer, and of transcriptions."""
    sizes = volume(pages, ["doc_id"], least=least)
    src = tables.join(sizes.where(~F.col("scanned")).select("doc_id"), "doc_id", "left_semi")
    shown = md.select("doc_id", F.posexplode(tb.shapes(F.col("text"))).alias("p", "s")).select("doc_id", F.col("p").alias("tbl_no"), "s.n_rows", "s.n_cols")
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    both = sizes.join(count(src, "n_src"), "doc_id", "left").join(count(shown, "n_md"), "doc_id", "left").na.fill(0, ["n_src", "n_md"])
    return tb.findings(both, few_pages), (src, shown)


def transcription(pages: DataFrame, md: DataFrame, tables: DataFrame, second: DataFrame | None = None, few_pages: int = 30, least: int = 20, least_chars: int = 50, red_below: float = 0.7, share: float = 0.5, cap: int = 25) -> DataFrame:
    """The whole audit, one row a document of ``md``.

    ``doc_id, n_pages, n_chars, md_chars, scanned, ratio, n_src_tables, n_md_tables, n_disagreements, must, tables, formulas, too_many, red, exit_code``: volumes and their
    ratio, tables of either side, tokens on which a ``second`` rendition (doc_id, text) disagrees (null without one), pages to look at by tier, whether
    these are more than ``share`` of all, and the red findings, joined by commas.
    """
    state, _ = _table_state(pages, md, tables, few_pages, least)
    listed = transcription_pages(pages, md, tables, few_pages, least)
    by_tier = listed.groupBy("doc_id").agg(F.count("*").alias("n_listed"), *[F.sort_array(F.collect_list(F.when(F.col("tier") == x, F.col("page")))).alias(x) for x in "ABC"])
    faults = glitches(md, ["doc_id"]).groupBy("doc_id").agg(F.collect_set("glitch").alias("faults"))
    out = md.select("doc_id", F.length("text").cast("long").alias("md_chars")).join(state, "doc_id").join(by_tier, "doc_id", "left").join(faults, "doc_id", "left")
    if second is not None:
        tokens = [tk.multiset(x, ["doc_id"], t.normalised_markdown(F.col("text"))) for x in (md.join(second.select("doc_id"), "doc_id", "left_semi"), second)]
        differ = tk.difference(*tokens, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("differ"))
        out = out.join(second.select("doc_id", F.lit(True).alias("compared")), "doc_id", "left").join(differ, "doc_id", "left")
        n = F.when(F.col("compared"), F.coalesce("differ", F.lit(0)))
    else:
        n = F.lit(None).cast("long")
    ratio = volume_verdict(F.col("md_chars"), F.col("n_chars"), red_below)[0]
    nothing = F.array().cast("array<string>")
    red = F.concat(
        F.when(F.col("md_chars") < least_chars, F.array(F.lit("nearly_empty"))).otherwise(nothing),
        F.when(~F.col("scanned") & (ratio < red_below), F.array(F.lit("content_lost"))).otherwise(nothing),
        F.coalesce(F.transform(F.sort_array("faults"), lambda x: F.concat(F.lit("glitch_"), x)), nothing),
        F.when(F.col("red"), F.array(F.lit("table_count"))).otherwise(nothing),
    )
    lists = [F.coalesce(capped_list(F.col(x), cap), F.lit("none")).alias(name) for x, name in zip("ABC", ("must", "tables", "formulas"))]
    return out.withColumn("r", red).select(
        "doc_id", "n_pages", "n_chars", "md_chars", "scanned", F.round(ratio, 6).alias("ratio"), F.col("n_src").alias("n_src_tables"), F.col("n_md").alias("n_md_tables"), n.alias("n_disagreements"), *lists,
        (F.coalesce("n_listed", F.lit(0)) > F.col("n_pages") * share).alias("too_many"), F.array_join("r", ",").alias("red"), F.when(F.size("r") > 0, 1).otherwise(0).alias("exit_code"),
    )
