"""Queries on token multisets and normalised text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import text as t
from folioframe.operators import tokens as tk
from folioframe.plans.registry import Literal, query, table

RENDITION = Literal("fx", "doc_id int, page int, src string, md string", [
    (1, 1, "H≤30 H≤20 H≤10", "H<30 H<20 H<10"), (2, 1, "Ⅲ或Ⅳ", "IⅢ或IV"), (3, 1, "系数 1.90", "系数 1 . 9 0"), (4, 1, "2×3", "2\\times3"),
    (5, 1, "＜5", "<5"), (6, 1, "7", "7"), (6, 2, "7", "7"), (7, 1, "7 7", "7"), (8, 1, "a 1 b 2", "b 2 a 1"), (9, 1, "1 2 3 4 5 6 7 8", ""),
    (10, 1, "α 3", "\\alpha 3 \\alphabet"), (11, 1, "x 10", "x 1 0"),
])
_FOLD = f"translate({{}}, '{t.FULL_WIDTH}', '{t.HALF_WIDTH}')"
_SYMBOLS = f"[{t.COMPARATORS}{t.ROMANS}{t.UNITS}]"


def _bag(keys: str, text: str, source: str) -> str:
    """A token multiset in SQL."""
    f = _FOLD.format(text)
    kind = f"CASE WHEN contains('{t.COMPARATORS}', tok) THEN 'cmp' WHEN contains('{t.ROMANS}', tok) THEN 'rom' ELSE 'unit' END"
    return f"""(SELECT {keys}, kind, tok, count(*) AS cnt FROM (
SELECT {keys}, 'num' AS kind, unnest(regexp_extract_all({f}, '{t.NUMBER}')) AS tok FROM {source}
UNION ALL SELECT {keys}, {kind} AS kind, tok FROM (SELECT {keys}, unnest(regexp_extract_all({f}, '{_SYMBOLS}')) AS tok FROM {source})) GROUP BY ALL)"""


def _latex(x: str) -> str:
    # without look-ahead: the next character is captured and put back; twice, for neighbours
    for name, symbol in t.LATEX:
        for _ in range(2):
            x = rf"regexp_replace({x}, '\\{name}([^a-zA-Z]|$)', '{symbol}\1', 'g')"
    return x


def _fuse(x: str) -> str:
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{Nd}})\s+([.\p{{Nd}}])', '\1\2', 'g')"
    return rf"regexp_replace({x}, '(\.)\s+(\p{{Nd}})', '\1\2', 'g')"


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_NORMAL = _fuse(f"translate({_latex('md')}, '\\{{}}$^_', '')")


@query("token_multiset", f"SELECT * FROM {_bag('doc_id', 'text', 'documents')}")
def token_multiset(spark, d):
    return tk.multiset(table(spark, d, "documents"), ["doc_id"], F.col("text"))


@query("token_profile_by_lang", f"SELECT lang, kind, sum(cnt)::BIGINT AS total, count(*) AS distinct_tokens FROM {_bag('lang', 'text', 'documents')} GROUP BY ALL")
def token_profile_by_lang(spark, d):
    return tk.multiset(table(spark, d, "documents"), ["lang"], F.col("text")).groupBy("lang", "kind").agg(F.sum("cnt").alias("total"), F.count("*").alias("distinct_tokens"))


_PAGES = "(SELECT page_id AS doc_id, 1 AS page, html, regexp_replace(html, '<[^>]*>', '', 'g') AS md FROM pages)"
_DEFICIT = f"""p AS {_bag('doc_id, page', 'html', _PAGES)}, m AS {_bag('doc_id', 'md', _PAGES)},
d AS (SELECT p.doc_id, p.page, p.kind, p.tok, p.cnt - coalesce(m.cnt, 0) AS short FROM p LEFT JOIN m ON (p.doc_id, p.kind, p.tok) = (m.doc_id, m.kind, m.tok) WHERE p.cnt > coalesce(m.cnt, 0))"""


def _page_deficit(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "html")
    return tk.deficit(tk.multiset(pages, ["doc_id", "page"], F.col("html")), tk.multiset(pages, ["doc_id"], t.without_tags(F.col("html"))))


@query("page_token_deficit", f"WITH {_DEFICIT} SELECT * FROM d")
def page_token_deficit(spark, d):
    return _page_deficit(spark, d)


@query("page_deficit_fold", f"WITH {_DEFICIT} SELECT doc_id, page, count(*) AS n_missing, CASE WHEN count(*) >= 8 THEN 'read_whole_page' ELSE 'listed' END AS finding FROM d GROUP BY doc_id, page")
def page_deficit_fold(spark, d):
    return tk.fold(_page_deficit(spark, d))


@query("page_missing_list", f"WITH {_DEFICIT} SELECT doc_id, page, array_to_string(list(tok || ' -' || short ORDER BY kind, tok, short)[1:12], ', ') AS missing FROM d GROUP BY doc_id, page HAVING count(*) < 8")
def page_missing_list(spark, d):
    return tk.listed(_page_deficit(spark, d))


@query("rendition_deficit", f"""WITH {RENDITION.sql}, whole AS (SELECT doc_id, {_NORMAL} AS md FROM (SELECT doc_id, first(md ORDER BY page) AS md FROM fx GROUP BY doc_id)),
p AS {_bag('doc_id, page', 'src', 'fx')}, m AS {_bag('doc_id', 'md', 'whole')}
SELECT p.doc_id, p.page, p.kind, p.tok, p.cnt - coalesce(m.cnt, 0) AS short FROM p LEFT JOIN m ON (p.doc_id, p.kind, p.tok) = (m.doc_id, m.kind, m.tok) WHERE p.cnt > coalesce(m.cnt, 0)""")
def rendition_deficit(spark, d):
    fx = RENDITION.df(spark)
    whole = fx.groupBy("doc_id").agg(F.min_by("md", "page").alias("md"))
    return tk.deficit(tk.multiset(fx, ["doc_id", "page"], F.col("src")), tk.multiset(whole, ["doc_id"], t.normalised_markdown(F.col("md"))))


_DEGRADED = "(SELECT doc_id, regexp_replace(regexp_replace(text, '7', '1', 'g'), '\\$[^$]*\\$', '', 'g') AS text FROM documents)"


@query("rendition_diff", f"""WITH x AS {_bag('doc_id', 'text', 'documents')}, y AS {_bag('doc_id', 'text', _DEGRADED)},
j AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.kind, y.kind) AS kind, coalesce(x.tok, y.tok) AS tok, coalesce(x.cnt, 0) AS a, coalesce(y.cnt, 0) AS b
      FROM x FULL JOIN y ON (x.doc_id, x.kind, x.tok) = (y.doc_id, y.kind, y.tok))
SELECT * FROM j WHERE a <> b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, tok) <= 30""")
def rendition_diff(spark, d):
    docs = table(spark, d, "documents")
    worse = F.regexp_replace(F.regexp_replace("text", "7", "1"), r"\$[^$]*\$", "")
    return tk.difference(tk.multiset(docs, ["doc_id"], F.col("text")), tk.multiset(docs, ["doc_id"], worse), ["doc_id"], top=30)


def _documents(name, column, sql):
    """A query that applies a text function to all documents and returns lengths and digests."""
    query(name, f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {sql} AS x FROM documents)")(
        lambda spark, d: table(spark, d, "documents").select("doc_id", column(F.col("text")).alias("x")).select("doc_id", F.length("x").cast("long").alias("n"), F.md5(F.encode("x", "utf-8")).alias("digest"))
    )


_documents("latex_normalize", t.normalised_markdown, _NORMAL.replace("md", "text"))
_documents("digit_fuse", t.fuse_digits, _fuse("text"))
_documents("fullwidth_fold", t.fold_width, _FOLD.format("text"))
_documents("space_collapse", t.collapse_space, r"regexp_replace(text, '[\s\p{Z}\x1C-\x1F\x85]+', ' ', 'g')")
_documents("newline_collapse", t.collapse_newlines, _STRIP.format(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')") + " || chr(10)")
