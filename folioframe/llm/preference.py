"""Preference formatting of paired conversations, in DataFrame functions only.

Input: the turns of both sides of each pair, one row a turn. Turns of equal number are compared between the sides; the turns before the
first difference are the longest common prefix. It is rendered once, as the prompt; the rest of each side is its completion,
and spans of characters say which part of a completion is learned from (the texts of assistant turns; markers and other roles are masked).

The first difference is a minimum by pair and is given back to turns by a salted join; only the rendering brings a conversation's turns
together, as the string that it is.

Edge cases: null role or text render as empty; a null turn number comes last; several rows of one number and side are one turn, distinct
and in order of role and text, so repeated rows count once; a side without turns has an empty completion; equal sides are all prompt; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm._groups import beside, salt, summed
from folioframe.llm._spark import checkpointed

#: How a turn is rendered: what stands before the role, between role and text, and after the text.
MARKS = ("<|", "|>\n", "<|end|>\n")
LEARNED = "assistant"
_LAST = 2**62


def pairs(turns: DataFrame, pair: Column, side: Column, turn: Column, role: Column, text: Column, marks: tuple[str, str, str] = MARKS, learned: str = LEARNED) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans`` of every pair.

    ``side`` is 'chosen' or 'rejected'. Spans are 'from-to' in characters of the completion, from 0, joined by commas.
    """
    said = F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = turns.where(pair.isNotNull() & side.isin("chosen", "rejected")).select(pair.alias("pair_id"), side.alias("side"), F.coalesce(turn.cast("long"), F.lit(_LAST)).alias("turn"), said.alias("said"))

    def of(name: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("side") == name, F.col("said"))))

    both = rows.groupBy("pair_id", "turn").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    both = checkpointed(both.withColumn("differs", F.col("c") != F.col("r")).withColumn("_salt", salt("turn")))  # used twice
    first = summed(both, "pair_id", [F.min(F.when(F.col("differs"), F.col("turn"))).alias("m")], [F.min("m").alias("cut")])
    laid = beside(both, "pair_id", first)
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    rendered = laid.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(common, F.struct("turn", F.col("c").alias("s"))))).alias("p"),
        F.sort_array(F.collect_list(F.when(~common, F.struct("turn", F.col("c").alias("s"))))).alias("c"),
        F.sort_array(F.collect_list(F.when(~common, F.struct("turn", F.col("r").alias("s"))))).alias("r"),
    )
    flat = {k: F.flatten(F.transform(F.col(k), lambda x: x["s"])) for k in ("p", "c", "r")}
    rendered = rendered.select("pair_id", F.size("p").alias("n_prompt_turns"), *[v.alias(k) for k, v in flat.items()])
    a, b, z = marks

    def text_of(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(a), x["role"], F.lit(b), x["text"], F.lit(z))), "")

    def spans(turns: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["role"]) + len(a) + len(b)
            end = begin + F.length(x["text"])
            span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
            return F.struct((end + len(z)).alias("at"), F.when(x["role"] == learned, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.array_join(F.aggregate(turns, start, add)["out"], ",")

    return rendered.select("pair_id", "n_prompt_turns", text_of(F.col("p")).alias("prompt"), text_of(F.col("c")).alias("chosen"), spans(F.col("c")).alias("chosen_spans"), text_of(F.col("r")).alias("rejected"), spans(F.col("r")).alias("rejected_spans"))


def with_next_answer(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Pairs for ``pairs``: every conversation as it is (chosen), and with its last assistant turn given by the next conversation (rejected).

    The rejected side has the turns before its last assistant turn, then, under that number, the last assistant turn of the next conversation by id (after the
    last: the first) that has one. Conversations without an assistant turn have two equal sides. Turns with a null id belong to no conversation.
    """
    from folioframe.llm.merkle import successors

    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("pair_id"), F.coalesce(F.col(turn).cast("long"), F.lit(_LAST)).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("_salt", salt("turn"))
    answer = F.when(F.col("role") == LEARNED, F.struct("turn", "text"))
    every = checkpointed(summed(rows, "pair_id", [F.max(answer).alias("m")], [F.max("m").alias("last")]))
    answers = every.where("last IS NOT NULL")
    link = successors(answers.select(F.col("pair_id").alias("k"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("n")))
    other = answers.select(F.col("pair_id").alias("k"), F.col("last.text").alias("given")).join(link, "k").select(F.col("pk").alias("pair_id"), "given")
    ends = checkpointed(answers.join(other, "pair_id").select("pair_id", F.col("last.turn").alias("end"), "given"))
    laid = beside(rows, "pair_id", every.select("pair_id", F.col("last.turn").alias("end"), "_salts"))
    sides = F.when(F.col("end").isNull() | (F.col("turn") < F.col("end")), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    shared = laid.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text")
    swapped = ends.select("pair_id", F.lit("rejected").alias("side"), F.col("end").alias("turn"), F.lit(LEARNED).alias("role"), F.col("given").alias("text"))
    return shared.unionByName(swapped)


#: The same, from conversations, for DuckDB.
SQL = r"""
WITH t AS (SELECT DISTINCT conv_id AS pair_id, coalesce(turn, 4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT pair_id, turn AS ending, text AS answer FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1),
n AS (SELECT pair_id, ending, coalesce(lead(answer) OVER (ORDER BY pair_id), first(answer) OVER (ORDER BY pair_id)) AS given FROM a),
s AS (SELECT t.pair_id, 'chosen' AS side, turn, role, text FROM t
      UNION ALL SELECT t.pair_id, 'rejected', turn, role, text FROM t LEFT JOIN n USING (pair_id) WHERE ending IS NULL OR turn < ending
      UNION ALL SELECT pair_id, 'rejected', ending, 'assistant', given FROM n),
b AS (SELECT pair_id, turn, list((role, text) ORDER BY role, text) FILTER (side = 'chosen') AS c, list((role, text) ORDER BY role, text) FILTER (side = 'rejected') AS r FROM s GROUP BY ALL),
f AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS cut FROM b GROUP BY ALL),
p AS (SELECT s.*, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS part, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
      FROM s JOIN f USING (pair_id) WHERE side = 'chosen' OR NOT (cut IS NULL OR turn < cut)),
w AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(role) + 5 AS begins FROM p)
SELECT pair_id, count(DISTINCT turn) FILTER (part = 'prompt') AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(begins || '-' || (begins + length(text)), ',' ORDER BY turn, role, text) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(begins || '-' || (begins + length(text)), ',' ORDER BY turn, role, text) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_spans
FROM w GROUP BY pair_id"""
