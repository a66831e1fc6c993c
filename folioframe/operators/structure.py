"""Headings, outlines, page anchors, routes, and reading records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.operators.order import numbered

# fixed values: a numbered heading, heading style names, outline numbering
NUMBERED = r"(?U)^\s*(\d+(?:\.\d+)*)[\s、\.．]+\S"
OUTLINE = r"^\s*\d{1,2}(?:\.\d{1,2}){0,2}\s+\S"
# fixed values: phrases that open an act of reading, in order of precedence
ACTS = [(4, "我读完了"), (4, "还剩一点就读完"), (1, "我读完第"), (1, "今天读到"), (2, "辩论"), (5, "拆书稿"), (5, "读书会"), (6, "这让我想到")]
# fixed values: what each kind of source is put through
ROUTES = [("docx", "xml_tables", "none"), ("text_pdf", "text_layer", "tables_and_formulas"), ("scan", "two_renditions", "all_flagged"), ("epub", "ebook", "none"), ("mobi", "ebook", "none"), ("subtitle", "transcript", "none")]
# fixed values: kinds of error in transcriptions, and stars of danger
ERROR_KINDS = [("merged_cell_shift", 3), ("comparator_loss", 3), ("roman_numeral", 2), ("symbol_loss", 2), ("formula", 3)]
# fixed values: recommended tier by class of document
TIERS_BY_CLASS = [("standard", "advanced"), ("general", "standard"), ("index_only", "flash"), ("private", "basic")]


# fixed values: how names of heading styles begin, in English and in Chinese
HEADING_STYLES = ("Heading", "标题")


def is_heading_style(style: Column, names: tuple[str, ...] = HEADING_STYLES) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(style, F.lit(n)) for n in names])


def heading_level(text: Column, longest: int = 60) -> Column:
    """Level of an unstyled numbered heading (parts of its number), or null."""
    number = F.regexp_extract(text, NUMBERED, 1)
    return F.when((number != "") & (F.length(F.trim(text)) <= longest), F.length(F.regexp_replace(number, r"[^.]", "")) + 1)


def headings(paragraphs: DataFrame) -> DataFrame:
    """Adds ``styled`` and ``level`` to doc_id, para_no, style, text."""
    styled = F.coalesce(is_heading_style(F.col("style")), F.lit(False))
    return paragraphs.withColumn("styled", styled).withColumn("level", F.when(~styled, heading_level(F.col("text"))))


def heading_census(found: DataFrame, shown: int = 10) -> DataFrame:
    """``doc_id, n_styled, n_candidates, first, action``: 'stop' without headings, 'insert' with styled ones, else 'suggest'."""
    w = W.partitionBy("doc_id").orderBy(F.col("level").isNull(), "para_no")
    rows = found.withColumn("rn", F.row_number().over(w))
    out = rows.groupBy("doc_id").agg(
        F.count_if("styled").alias("n_styled"), F.count("level").alias("n_candidates"),
        F.sort_array(F.collect_list(F.when(F.col("level").isNotNull() & (F.col("rn") <= shown), F.struct("para_no", "text")))).alias("c"),
    )
    action = F.when(F.col("n_styled") > 0, "insert").when(F.col("n_candidates") > 0, "suggest").otherwise("stop")
    return out.select("doc_id", "n_styled", "n_candidates", F.array_join(F.transform("c", lambda x: x["text"]), "|").alias("first"), action.alias("action"))


def styled_levels(found: DataFrame, styles: DataFrame, most: int) -> DataFrame:
    """The style that each candidate of a level up to ``most`` gets: the English name if the document has it, else the Chinese one."""
    j = found.where(F.col("level") <= most).withColumn("en", F.concat(F.lit("Heading "), F.col("level").cast("string"))).withColumn("zh", F.concat(F.lit("标题 "), F.col("level").cast("string")))
    a = styles.select("doc_id", F.col("style").alias("en"), F.col("style").alias("has_en"))
    b = styles.select("doc_id", F.col("style").alias("zh"), F.col("style").alias("has_zh"))
    return j.join(a, ["doc_id", "en"], "left").join(b, ["doc_id", "zh"], "left").select("doc_id", "para_no", "level", F.coalesce("has_en", "has_zh").alias("apply"))


def anchored(blocks: DataFrame, group: str, order: str, page: str) -> DataFrame:
    """Blocks without a page take the last known one."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("anchor", F.last(page, ignorenulls=True).over(w))


def numbered_tree(nodes: DataFrame, top: str, below: str) -> DataFrame:
    """``number``: 1, 1.1, ... of a two-level tree in order of its keys."""
    tops = numbered(nodes.select(top).distinct(), [], [top], "a")
    rows = numbered(nodes, [top], [below], "b").join(tops, top)
    return rows.withColumn("number", F.concat_ws(".", "a", "b")).drop("a", "b")


def outline_lint(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, fault`` of outline lines that are neither numbered headings of three levels at most nor hints, and of long ones."""
    s = F.trim(F.col("text"))
    hint = F.startswith(s, F.lit("→"))
    fault = F.when(F.rlike(s, F.lit(r"^\d+(?:\.\d+){3,}")), "too_deep").when(~hint & ~F.rlike(s, F.lit(OUTLINE)) & ~F.startswith(s, F.lit("【")), F.when(F.length(s) > 40, "body_text").otherwise("not_numbered"))
    return lines.where(s != "").withColumn("fault", fault).where("fault IS NOT NULL").select("doc_id", "line_no", "fault")


def triggered_acts(turns: DataFrame, phrases: list[tuple[int, str]] = ACTS) -> DataFrame:
    """``conv_id, turn, act`` of user turns: the act of the first of ``phrases`` (act, phrase) that they hold; a conversation's first user turn opens act 0."""
    users = turns.where("role = 'user'").withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")))
    act = F.when(F.col("rn") == 1, 0)
    for number, phrase in phrases:
        act = act.when(F.col("text").contains(phrase), number)
    return users.select("conv_id", "turn", act.alias("act")).where("act IS NOT NULL")


def first_speakers(turns: DataFrame) -> DataFrame:
    """``conv_id, speaker, user_first``: who speaks first, system turns aside."""
    out = turns.where("role <> 'system'").groupBy("conv_id").agg(F.min_by("role", "turn").alias("speaker"))
    return out.withColumn("user_first", F.col("speaker") == "user")


def recall(chapters: DataFrame, mentioned: DataFrame) -> DataFrame:
    """``book_id, chapter, state``: remembered or forgotten."""
    m = mentioned.select("book_id", "chapter").distinct().withColumn("m", F.lit(1))
    return chapters.join(m, ["book_id", "chapter"], "left").select("book_id", "chapter", F.when(F.col("m").isNull(), "forgotten").otherwise("remembered").alias("state"))


def closing(records: DataFrame) -> DataFrame:
    """``book_id, done``: whether a decision, rule, checklist or experiment is recorded."""
    return records.groupBy("book_id").agg((F.count_if(F.col("kind").isin("decision", "rule", "checklist", "experiment")) >= 1).alias("done"))


# fixed values: what a chapter that was only skimmed carries
SKIMMED = "略读·AI 代梳理"


def skimming(chapters: DataFrame) -> DataFrame:
    """``book_id, chapter, finding``: skimmed chapters (mode 'skim') without their label or with a compression sentence, and others with the label."""
    skim = F.col("mode") == "skim"
    labelled = F.coalesce(F.col("label") == SKIMMED, F.lit(False))
    finding = F.when(skim & ~labelled, "label_missing").when(skim & F.col("compression").isNotNull(), "compressed_though_skimmed").when(~skim & labelled, "label_without_skimming")
    return chapters.select("book_id", "chapter", finding.alias("finding")).where("finding IS NOT NULL")


def reading_queue(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """``book_id, place, title, relation, author``: books that come up while reading, queued after the current one, direct ones first.

    A mentioned book counts once, at its first mention, and only when ``known`` (title, author) confirms that it exists.
    """
    first = mentions.groupBy("book_id", "title").agg(F.min(F.struct("seq", "relation")).alias("m"))
    found = first.join(known.select("title", "author").dropDuplicates(["title"]), "title")
    order = W.partitionBy("book_id").orderBy(F.col("m.relation") != "direct", "m.seq", "title")
    return found.select("book_id", F.row_number().over(order).alias("place"), "title", F.col("m.relation").alias("relation"), "author")


def merged_parts(parts: DataFrame) -> DataFrame:
    """``doc_id, n_parts, contiguous, text``: partial outputs (first_page, last_page, text) in order of pages; whether they follow on each other without holes."""
    held = F.sort_array(F.collect_list(F.struct("first_page", "last_page", "text")))
    out = parts.groupBy("doc_id").agg(held.alias("p"))
    follows = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.element_at("p", i)["first_page"] == F.try_element_at(F.col("p"), F.greatest(i - 1, F.lit(1)))["last_page"] + 1))
    return out.select("doc_id", F.size("p").alias("n_parts"), follows.alias("contiguous"), F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def split_tables(blocks: DataFrame) -> DataFrame:
    """Blocks marked 'table' or 'narrative'; tables must be confirmed at the source."""
    table = F.rlike("text", F.lit(r"(?s)<table|^\s*\|.*\|\s*$"))
    return blocks.withColumn("part", F.when(table, "table").otherwise("narrative")).withColumn("confirm", table)


# fixed values: the seven blocks of a draft on a book and the sections of the reading archive that they are put together from; the longest hook; characters of a block in
# the one-page and in the full form (about 3,000 in seven blocks)
DRAFT_BLOCKS = [
    (1, "hook", ["hook"]), (2, "why", ["interview"]), (3, "skeleton", ["compression"]), (4, "concepts", ["concept"]), (5, "agree_or_refute", ["debate"]),
    (6, "me_and_it", ["life", "fragment"]), (7, "changes", ["decision", "rule", "checklist", "experiment"]),
]
HOOK_CHARS, BLOCK_CHARS = 30, {"page": 200, "full": 430}


def _in_blocks(archive: DataFrame) -> DataFrame:
    block, title = F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, name, sections in DRAFT_BLOCKS:
        block, title = F.when(F.col("section").isin(sections), n).otherwise(block), F.when(F.col("section").isin(sections), name).otherwise(title)
    rows = archive.withColumn("block", block).withColumn("title", title)
    return rows.where(F.col("block").isNotNull() & ((F.col("section") != "hook") | (F.length("text") <= HOOK_CHARS)))


def draft(archive: DataFrame, form: str = "page") -> DataFrame:
    """``book_id, block, title, body, n_chars, too_long``: the blocks of a draft, from the archive (book_id, section, seq, text) alone; ``form`` is 'page' or 'full'."""
    lines = F.sort_array(F.collect_list(F.struct("section", "seq", "text")))
    out = _in_blocks(archive).groupBy("book_id", "block", "title").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("body"))
    return out.withColumn("n_chars", F.length("body").cast("long")).withColumn("too_long", F.col("n_chars") > BLOCK_CHARS[form])


def draft_gaps(archive: DataFrame) -> DataFrame:
    """``book_id, block, title`` of blocks that the archive has nothing for."""
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("block"), F.lit(name).alias("title")) for n, name, _ in DRAFT_BLOCKS])).alias("b")
    held = _in_blocks(archive).select("book_id", "block").distinct()
    return archive.select("book_id").distinct().select("book_id", every).select("book_id", "b.block", "b.title").join(held, ["book_id", "block"], "left_anti")
