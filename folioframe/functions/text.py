"""Text functions: Column in, Column out. Unicode-aware where the rules are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: symbols that are compared one by one, in the order in which they are looked up
COMPARATORS = "≤≥＜＞<>≦≧"
ROMANS = "ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"
UNITS = "°‰℃㎡㎥±×÷√∅φΦ"
# fixed values: full-width characters and their ASCII forms
FULL_WIDTH, HALF_WIDTH = "＜＞＝（），．０１２３４５６７８９", "<>=(),.0123456789"
# fixed values: LaTeX commands and the symbols that they stand for
LATEX = [("times", "×"), ("div", "÷"), ("sqrt", "√"), ("pm", "±"), ("geq", "≥"), ("ge", "≥"), ("leq", "≤"), ("le", "≤"), ("circ", "°"), ("phi", "φ"), ("varphi", "φ"), ("Phi", "Φ"), ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("sigma", "σ"), ("sum", "∑"), ("int", "∫"), ("permil", "‰")]
# fixed values: patterns of recognition faults
GLITCHES = [("double_point", r"\p{Nd}\.\.\p{Nd}"), ("roman_pile", r"[IⅠ]{3,}"), ("replacement", "�")]
# fixed values: a running head or foot (page number, or standard code), a dot leader, a formula, a LaTeX fragment
RUNNING_HEAD = r"^(?:[-—\s]*\p{Nd}{1,4}[-—\s]*|[A-Z]{1,4}[\s/]?\p{Nd}{3,5}[\s—-]*\p{Nd}{0,4})$"
LEADER, LEADER_END = r"[.·…]{3,}", r"[.·…]{3,}\s*\p{Nd}+\s*$"
FORMULA, FRAGMENT = r"[=＝].*[a-zA-Zαβγφσ]|[∑∫√]", r"\$\$?[^$]+\$\$?"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
# fixed values: titles that name a part of a book, not the book
GENERIC_TITLES = ["书名页", "封面", "扉页", "版权页", "cover", "titlepage", "title page", "copyright", "unknown", ""]


def strip(t: Column) -> Column:
    """Without Unicode white space (and the separators U+001C to U+001F) at either end."""
    return F.regexp_replace(t, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def collapse_space(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)[\s\x1C-\x1F]+", " ")


def collapse_newlines(t: Column) -> Column:
    """Three and more line breaks become two; trimmed; one break at the end."""
    return F.concat(strip(F.regexp_replace(t, r"\n{3,}", "\n\n")), F.lit("\n"))


def _only(t: Column, pattern: str, changed: Column) -> Column:
    """``changed`` for texts that hold the pattern; the others, which it would leave as they are, pass after one scan."""
    return F.when(F.rlike(t, F.lit(pattern)), changed).otherwise(t)


def fold_width(t: Column) -> Column:
    return _only(t, f"[{FULL_WIDTH}]", F.translate(t, FULL_WIDTH, HALF_WIDTH))


def latex_symbols(t: Column, commands: list[tuple[str, str]] = LATEX) -> Column:
    return _only(t, r"\\", _symbols(t, commands))


def _symbols(t: Column, commands: list[tuple[str, str]] = LATEX) -> Column:
    for name, symbol in commands:
        t = F.regexp_replace(t, rf"\\{name}(?![a-zA-Z])", symbol)
    return t


def without_structure(t: Column) -> Column:
    return F.translate(t, "\\{}$^_", "")


def fuse_digits(t: Column) -> Column:
    """``1 . 9 0`` becomes ``1.90``; line breaks between digits are spaces too."""
    return _only(t, r"\p{Nd}", _fused(t))


def _fused(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?U)(?<=\d)\s+(?=[.\d])", "")
    return F.regexp_replace(t, r"(?U)(?<=\.)\s+(?=\d)", "")


def normalised_markdown(t: Column) -> Column:
    """Symbols for LaTeX commands, no structure characters, digits fused; a text without any of these and without digits stays as it is."""
    return _only(t, r"[\\{}$^_\p{Nd}]", _fused(without_structure(_symbols(t))))


def is_running_head(line: Column) -> Column:
    s = strip(line)
    return (s != "") & (F.length(s) <= 24) & F.rlike(s, F.lit("(?U)" + RUNNING_HEAD))


def without_leader(line: Column) -> Column:
    return F.regexp_replace(line, "(?U)" + LEADER_END, "")


def has_leader(line: Column) -> Column:
    return F.rlike(line, F.lit(LEADER))


def is_formula(t: Column) -> Column:
    """Whether a line holds a formula; texts without one of its signs pass after a plain search."""
    signs = [t.contains(x) for x in "=＝∑∫√"]
    return reduce(lambda a, b: a | b, signs) & F.rlike(t, F.lit(FORMULA))


def fragments(t: Column) -> Column:
    return F.regexp_count(t, F.lit(FRAGMENT))


def without_asr_tags(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"<\|[^|]+\|>", ""))


def headings(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"(?m)^#{1,6} "))


def footnote_refs(t: Column) -> Column:
    return F.regexp_count(t, F.lit(r"\[\^.+?\]"))


def without_head(html: Column) -> Column:
    """Page breaks become rules, the head goes."""
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<mbp:pagebreak[^>]*>", "<hr/>"), r"(?is)<head[^>]*>.*?</head>", "")


def guessed_title(html: Column, stem: Column) -> Column:
    """The first title element unless it is generic, else the file's stem."""
    t = strip(collapse_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.when(F.lower(t).isin(GENERIC_TITLES), stem).otherwise(t)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def book_header(title: Column, author: Column) -> Column:
    """Title, author if there is one, and a rule."""
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("**作者：** "), F.when(author != "", author)), F.lit("---"))


def page_range(start: Column, end: Column) -> Column:
    """0-based inclusive pages as ``first-last``; ``r1`` for an open end, null without limits."""
    last = F.when(end.isNull(), F.lit("r1")).otherwise((end + 1).cast("string"))
    return F.when(start.isNull() & end.isNull(), F.lit(None).cast("string")).otherwise(F.concat((F.coalesce(start, F.lit(0)) + 1).cast("string"), F.lit("-"), last))


def selected_pages(selector: Column, pages: Column) -> Column:
    """Page numbers of ``1-5,8,r3-r1`` or ``all``; rN counts from the end, pages outside the document drop out."""
    def place(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("r")), pages + 1 - F.substr(x, F.lit(2)).try_cast("int")).otherwise(x.try_cast("int"))

    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        a, b = place(F.element_at(ends, 1)), place(F.element_at(ends, -1))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    chosen = F.flatten(F.transform(F.split(selector, ","), one))
    every = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    return F.when(selector == "all", every).otherwise(F.sort_array(F.array_distinct(F.filter(chosen, lambda p: (p >= 1) & (p <= pages)))))


# fixed values: endings of default outputs by kind (that of PDF conversions is the converter's name, a parameter), and of a converter's debug files
OUTPUT_ENDINGS = {"epub": "_epub", "mobi": "_mobi", "docx": "_带目录.docx"}
BY_PRODUCTS = ["_layout.pdf", "_span.pdf", "_origin.pdf", "_middle.json", "_model.json", "_content_list.json"]


def output_path(path: Column, kind: Column, pdf_ending: str = "_converted") -> Column:
    """Where a converter puts its output by default, beside the input."""
    base = F.regexp_replace(path, r"\.[^./]*$", "")
    tail = F.when(kind == "pdf", pdf_ending)
    for name, ending in OUTPUT_ENDINGS.items():
        tail = tail.when(kind == name, ending)
    return F.concat(base, tail)


def is_by_product(path: Column, keep_layout: bool) -> Column:
    """Debug files of a converter; a batch keeps the layout lists."""
    kinds = [x for x in BY_PRODUCTS if not (keep_layout and "content_list" in x)]
    return reduce(lambda a, b: a | b, [F.endswith(path, F.lit(x)) for x in kinds])
