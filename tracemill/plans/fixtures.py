"""Traces, responses and puzzles over the standard tables, once as DataFrames and once as SQL.

The tables hold no model-written rewrites, so they are derived from every document: `output` is its whole text with a
worked ending, `rewrite` one of eight kinds of good and bad rewrites, by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.common import spread

DOUBT = "\n\nWait, maybe 1,"
WORK = " is what I think, and 29.98 too. I'm unsure; let me check that $I is$ right. No, hold on. We see \\( wait \\).\n\n**Final Answer** early \\boxed{"
MORE = "}\n\nSo we get \\boxed{"
LAST = "}.\n\n**Final Answer**\n\\boxed{"
LISTS = "\n1. one\n2. two\n- three\n* four\n"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: What texts() makes, as a common table expression.
TRACES = f"""traces AS (SELECT *, CASE idx % 8 WHEN 1 THEN '' WHEN 2 THEN left(output, length(output) // 4)
  WHEN 3 THEN output || output || ' ' || output WHEN 4 THEN regexp_replace(output, '[0-9]', '', 'g')
  WHEN 5 THEN regexp_replace(output, '[a-z]', 'x', 'g') WHEN 6 THEN output || {quoted(LISTS)} ELSE output END AS rewrite,
  CASE WHEN idx % 8 = 7 THEN 'length' ELSE 'stop' END AS finish
  FROM (SELECT doc_id AS idx, source, lang, 'Find item ' || (doc_id % 400) || '.' AS instruction,
  coalesce(text, '') || {quoted(DOUBT)} || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || {quoted(WORK)} || (doc_id % 7) || {quoted(MORE)}
  || (doc_id % 5) || ', ' || (doc_id % 3) || {quoted(LAST)} || (doc_id % 5) || '}}' AS output FROM documents))"""


def traces(d: DataFrame) -> DataFrame:
    """(idx, source, lang, instruction, output, rewrite, finish)."""
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    output = F.concat(
        F.coalesce("text", F.lit("")), F.lit(DOUBT), F.lpad(text(i % 1000), 3, "0"), F.lit(WORK), text(i % 7), F.lit(MORE),
        text(i % 5), F.lit(", "), text(i % 3), F.lit(LAST), text(i % 5), F.lit("}"),
    )
    rows = spread(d).select(
        i.alias("idx"), "source", "lang", F.concat(F.lit("Find item "), text(i % 400), F.lit(".")).alias("instruction"), output.alias("output")
    )
    o, k = F.col("output"), F.col("idx") % 8
    rewrite = (
        F.when(k == 1, "")
        .when(k == 2, F.left(o, F.floor(F.length(o) / 4).cast("int")))
        .when(k == 3, F.concat(o, o, F.lit(" "), o))
        .when(k == 4, F.regexp_replace(o, "[0-9]", ""))
        .when(k == 5, F.regexp_replace(o, "[a-z]", "x"))
        .when(k == 6, F.concat(o, F.lit(LISTS)))
        .otherwise(o)
    )
    return rows.withColumn("rewrite", rewrite).withColumn("finish", F.when(k == 7, "length").otherwise("stop"))


NAMES = ["Ann", "Bob", "Cy"]

#: What puzzles() makes: texts that state labels in several ways, and the labels that are to be read (null: none).
PUZZLES = """puzzles AS (SELECT id, n_people, [(id & 1) > 0, (id & 2) > 0, (id & 4) > 0] AS solution,
  CASE id % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN [(id & 1) = 0, (id & 2) > 0, (id & 4) > 0]
  ELSE [(id & 1) > 0, (id & 2) > 0, (id & 4) > 0] END AS labels
  FROM (SELECT event_id AS id, 3 AS n_people FROM events))"""


def puzzles(e: DataFrame) -> DataFrame:
    """(id, n_people, names, solution, text): by id % 6 a numbered list, the same behind a scratchpad and bold, prose,
    one label missing, no conclusion, and a wrong first label."""
    i = F.col("event_id")
    bit = lambda b: i.bitwiseAND(b) > 0
    said = lambda c: F.when(c, "knight").otherwise("knave")
    a, b, c = said(bit(1)), said(bit(2)), said(bit(4))
    lines = lambda x: F.concat(F.lit("CONCLUSION:\n(1) Ann is a "), x, F.lit("\n(2) Bob is a "), b, F.lit("\n(3) Cy is a "), c, F.lit("\n"))
    again = F.lit("\nIndeed Ann is a knight or Ann is a knave.")
    bold = F.concat(F.lit("Conclusion: unsure.</think>\n**CONCLUSION**:\n(1) **Ann** is a "), a, F.lit("\n(2) Bob is "), b, F.lit("\n(3) Cy is a "), c)
    prose = F.concat(F.lit("So. Conclusion: Ann is a "), a, F.lit(", Bob is a "), b, F.lit(", and Cy is a "), c, F.lit(".\n\nAnn is a knight, Ann is a knave."))
    missing = F.concat(F.lit("CONCLUSION:\n(1) Ann is a "), a, F.lit("\n(2) Bob is a "), b)
    k = i % 6
    text = F.when(k == 0, F.concat(lines(a), again)).when(k == 1, bold).when(k == 2, prose).when(k == 3, missing)
    text = text.when(k == 4, F.concat(F.lit("Ann is a "), a)).otherwise(lines(said(~bit(1))))
    return e.select(
        i.alias("id"), F.lit(3).alias("n_people"), F.array(*map(F.lit, NAMES)).alias("names"),
        F.array(bit(1), bit(2), bit(4)).alias("solution"), text.alias("text"),
    )
