"""Text functions on whole documents in which common syllables have become the marks that the functions look for, so that
marks come in any number and order; each SQL works the result out anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import answers, puzzles, text
from tracemill.operators.common import spread

from .fixtures import quoted
from .registry import query

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _marked(d, **marks: str):
    """(doc_id, t): every text with the keys' syllables, _ being a blank, replaced by marks one after the other."""
    t = F.coalesce("text", F.lit(""))
    for old, new in marks.items():
        t = F.replace(t, F.lit(old.replace("_", " ")), F.lit(new))
    return spread(d).select("doc_id", t.alias("t"))


def _sql(**marks: str) -> str:
    t = "coalesce(text, '')"
    for old, new in marks.items():
        t = f"replace({t}, {quoted(old.replace('_', ' '))}, {quoted(new)})"
    return f"m AS (SELECT doc_id, {t} AS t FROM documents)"


def _md5(c):
    return F.md5(c.cast("binary"))


_GOLD = {"_th": " #### th", "_an": " , $5.", "_de": " ####"}
_SHOWN = {"._": ".\nThe answer is ", ",_": ", The answer is -1,200.5 or "}
_FINAL = {"_th": " Final Answer: The final answer is $", "_an": "$. I hope ", "_que": " \\boxed{1}"}


@query("t36_gold_of_texts", "documents", sql=f"""WITH {_sql(**_GOLD)}, g AS (SELECT doc_id, contains(t, '####') AS has, rtrim(regexp_replace(trim(string_split(t, '####')[-1], {_WS}), '[,$]', '', 'g'), '.') AS g FROM m)
  SELECT doc_id, CASE WHEN has AND g <> '' THEN md5(g) END AS gold, CASE WHEN has AND g <> '' THEN length(g) END AS chars FROM g""")
def golds(d):
    rows = _marked(d, **_GOLD).select("doc_id", answers.hash_gold(F.col("t")).alias("g"))
    return rows.select("doc_id", _md5(F.col("g")).alias("gold"), F.length("g").alias("chars"))


@query("t37_shown_in_texts", "documents", sql=rf"""WITH {_sql(**_SHOWN)}, s AS (SELECT doc_id, t, split_part(split_part(t || chr(10), 'The answer is', 2), chr(10), 1) AS said0, string_split(t, 'The answer is') AS p FROM m),
  l AS (SELECT doc_id, t, p, CASE WHEN len(p) > 1 THEN string_split(ltrim(array_to_string(p[2:], 'The answer is'), {_WS}), chr(10))[1] END AS said FROM s),
  n AS (SELECT doc_id, p, replace(regexp_extract(said, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS n FROM l)
  SELECT doc_id, CASE WHEN n <> '' THEN md5(trim(trim(p[1], {_WS}) || ' The answer is \boxed{{' || n || '}}.', {_WS})) END AS shown FROM n""")
def shown(d):
    rows = _marked(d, **_SHOWN).select("doc_id", answers.shown_solution(F.col("t")).alias("s"))
    return rows.select("doc_id", _md5(F.col("s")).alias("shown"))


@query("t38_final_lines_of_texts", "documents", sql=rf"""WITH {_sql(**_FINAL)}, b AS (SELECT doc_id, t, trim(string_split(t, 'Final Answer:')[1], {_WS}) AS body,
  trim(regexp_extract(t, 'Final Answer:\s*The final answer is\s*\$?(.+?)\$?\s*\.\s*I hope', 1, 's'), {_WS}) AS said FROM m)
  SELECT doc_id, CASE WHEN contains(body, '\boxed{{') THEN md5(body) WHEN said <> '' THEN md5(body || chr(10) || 'The final answer is $\boxed{{' || said || '}}$.') END AS final FROM b""")
def finals(d):
    rows = _marked(d, **_FINAL).select("doc_id", answers.final_line_solution(F.col("t")).alias("s"))
    return rows.select("doc_id", _md5(F.col("s")).alias("final"))


_PASS2 = {"_th": " <SUB>th", ",_": "</sub> ", "_an": " <rewritten>an", "_en": "</REWRITTEN> ", "._": ".\n- "}
_BLOCK, _SUB = "<REWRITTEN>(.*?)</REWRITTEN>", "<SUB>(.*?)</SUB>"
_STRIPPED = lambda x: f"trim({x}, {_WS})"


@query("t5_pass2_of_texts", "documents", sql=rf"""WITH {_sql(**_PASS2)}, b AS (SELECT doc_id, t, regexp_extract_all(t, '{_BLOCK}', 1, 'si') AS blocks, string_split(regexp_replace(t, '<rewritten>', chr(1), 'gi'), chr(1)) AS opened FROM m),
  c AS (SELECT doc_id, len(blocks) = 0 AS open, len(blocks) = 0 AND (len(opened) = 1 OR doc_id % 3 = 0) AS lost, CASE WHEN len(blocks) > 0 THEN blocks[-1] ELSE opened[-1] END AS x,
    list_filter(list_transform(flatten(list_transform(regexp_extract_all(regexp_replace(t, '{_BLOCK}', '', 'gsi'), '{_SUB}', 1, 'si'), lambda i: string_split({_STRIPPED('i')}, chr(10)))), lambda l: {_STRIPPED("regexp_replace(l, '^[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']*(?:[-*•]|[0-9]+[.)])[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']*', '')")}), lambda l: l <> '') AS own FROM b),
  e AS (SELECT *, list_filter(list_transform(regexp_extract_all(x, '{_SUB}', 1, 'si'), lambda i: {_STRIPPED('i')}), lambda i: i <> '') AS inside FROM c),
  f AS (SELECT *, list_filter(inside, lambda i: NOT list_contains(own, i)) AS more FROM e)
  SELECT doc_id, CASE WHEN NOT lost THEN md5({_STRIPPED("regexp_replace(x, '</?(?:SUB|REWRITTEN)>', '', 'gi')")}) END AS text,
  CASE WHEN lost THEN 0 ELSE len(own) + len(list_distinct(more)) END AS subs, CASE WHEN NOT lost THEN md5(array_to_string(list_sort(own || list_distinct(more)), '|')) END AS items,
  CASE WHEN lost THEN 'no_rewritten_block' ELSE concat_ws(',', CASE WHEN open THEN 'unclosed' END, CASE WHEN regexp_matches(x, '</?(?:SUB|REWRITTEN)>', 'i') THEN 'tags_in_text' END) END AS flags FROM f""")
def passes(d):
    p = _marked(d, **_PASS2).select("doc_id", text.parse_pass2(F.col("t"), F.col("doc_id") % 3 == 0).alias("p"))
    items = F.when(F.col("p.text").isNotNull(), _md5(F.array_join(F.array_sort("p.subs"), "|")))
    return p.select("doc_id", _md5(F.col("p.text")).alias("text"), F.size("p.subs").alias("subs"), items.alias("items"), F.array_join("p.flags", ",").alias("flags"))


_ENDED = {"_th": "</think>", "_an": " <|channel|>final<|message|>", "_en": "<|end|>", "_de": " Conclusion"}


@query("t43_t44_outputs_of_texts", "documents", sql=rf"""WITH {_sql(**_ENDED)}, p AS (SELECT doc_id, t, string_split(t, '</think>') AS p, string_split(t, '<|channel|>final<|message|>') AS c FROM m),
  f AS (SELECT *, CASE WHEN len(p) > 1 THEN array_to_string(p[2:], '</think>') ELSE t END AS part FROM p)
  SELECT doc_id, len(p) > 1 AS ended, md5(p[-1]) AS rewrite, md5(CASE WHEN len(p) > 1 THEN left(t, length(t) - length(p[-1]) - 8) ELSE t END) AS reasoning, len(c) > 1 AS final,
  md5(trim(regexp_replace(c[-1], '<\|[a-z_]+\|>', CASE WHEN len(c) > 1 THEN '' ELSE ' ' END, 'g'), {_WS})) AS said,
  md5(CASE WHEN contains(lower(part), 'conclusion') THEN left(part, instr(lower(part), 'conclusion') - 1 + 600) ELSE part END) AS first FROM f""")
def outputs(d):
    rows = _marked(d, **_ENDED)
    t = F.col("t")
    rows = rows.select("doc_id", puzzles.split_output(t).alias("s"), puzzles.split_output(t, channel=True).alias("c"), puzzles.first_answer(t).alias("f"))
    return rows.select(
        "doc_id", "s.ended", _md5(F.col("s.rewrite")).alias("rewrite"), _md5(F.col("s.reasoning")).alias("reasoning"),
        F.col("c.ended").alias("final"), _md5(F.col("c.rewrite")).alias("said"), _md5(F.col("f")).alias("first"),
    )


_BOXES = {"ntl": "\\boxed{2}. ", "sht": " \\boxed{x{3}y}", "thb": "\\boxed{"}
_BOX = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"


@query("t45_t46_u6_rewards_of_texts", "documents", sql=rf"""WITH {_sql(**_BOXES)}, s AS (SELECT doc_id, left(t, 400 + doc_id % 300) || CASE WHEN doc_id % 2 = 0 THEN ' \boxed{{' || n_chars % 4 || '}}.' ELSE '' END AS t FROM m JOIN documents USING (doc_id)),
  b AS (SELECT doc_id, trim(t, {_WS}) AS t, len(string_split(t, '\boxed{{')) - 1 AS n, regexp_extract_all(t, {quoted(_BOX)}, 1) AS boxes FROM s), f AS (SELECT *, n = 1 AND regexp_matches(t, {quoted(_BOX.replace('((', '(?:(').replace('((', '(') + chr(92) + 's*(?:' + chr(92) * 2 + chr(92) + ']|' + chr(92) + '$)?' + chr(92) + 's*' + chr(92) + '.?' + chr(92) + 's*$')}) AS final FROM b)
  SELECT doc_id, n > 0 AS anywhere, final, final AND len(regexp_extract_all(string_split(t, '\boxed{{')[1], '[^ \t-\r]+')) >= 50 AS reasoned, CASE WHEN boxes[-1] = '2' THEN 1.0 ELSE 0.0 END AS exact,
  CASE WHEN n = 0 THEN -1.0 WHEN boxes[-1] = '2' THEN 1.0 ELSE -0.5 END AS mixed FROM f""")
def rewarded(d):
    end = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" \\boxed{"), (F.col("n_chars") % 4).cast("string"), F.lit("}."))).otherwise("")
    rows = _marked(d, **_BOXES).join(d.select("doc_id", "n_chars"), "doc_id")
    rows = rows.select("doc_id", F.concat(F.left("t", (400 + F.col("doc_id") % 300).cast("int")), end).alias("t"))
    c = F.col("t")
    return rows.select(
        "doc_id", answers.format_ok(c, "anywhere").alias("anywhere"), answers.format_ok(c, "final").alias("final"),
        answers.format_ok(c, "final_reasoned", 50).alias("reasoned"), answers.reward_exact(c, F.lit("2")).alias("exact"), answers.reward_mix(c, F.lit("2")).alias("mixed"),
    )


_PERSON = lambda x: f"CASE ({x}) % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' ELSE 'Cy' END"
_SAID = lambda j: f"'(' || ((event_id // {j}) % 3 + 1 + CASE WHEN event_id % 11 = {j} THEN 1 ELSE 0 END) || ') ' || {_PERSON(f'event_id // {j} + user_id // 50 * {j}')} || ' is ' || CASE WHEN (user_id // {j}) % 3 = 0 THEN 'a **knight**' WHEN (user_id // {j}) % 3 = 1 THEN 'a knave' ELSE 'knave, or is a knave' END || chr(10)"


@query("t40_t41_labels_of_lines", "events", sql=rf"""WITH l AS (SELECT event_id, user_id, 'Ann is a knight.' || chr(10) || CASE WHEN event_id % 7 > 0 THEN 'Conclusion :' || chr(10) ELSE '' END || {_SAID(1)} || {_SAID(3)} || {_SAID(9)} || {_SAID(2)} AS t FROM events),
  c AS (SELECT event_id, user_id, t, string_split(regexp_replace(lower(regexp_replace(t, '[*_`]', '', 'g')), 'conclusion\s*:', chr(1), 'g'), chr(1)) AS p FROM l),
  n AS (SELECT event_id, user_id, len(p) > 1 AS has, list_filter(string_split(p[-1], chr(10)), lambda x: regexp_matches(x, '\([0-9]+\)')) AS lines FROM c),
  w AS (SELECT event_id, user_id, has, array_to_string(list_transform([1, 2, 3], lambda i: coalesce(list_filter(lines, lambda x: starts_with(x, '(' || i || ')'))[1], '')), ' ') AS t FROM n),
  s AS (SELECT event_id, user_id, has, list_transform(['ann', 'bob', 'cy'], lambda n: list_distinct(regexp_extract_all(t, '\b' || n || '\s+is\s+(?:a\s+)?(knight|knave)\b', 1))) AS said FROM w),
  y AS (SELECT event_id, CASE WHEN has AND len(said[1]) = 1 AND len(said[2]) = 1 AND len(said[3]) = 1 THEN list_transform(said, lambda x: x[1] = 'knight') END AS labels, [user_id % 3 = 0, user_id % 2 = 0, true] AS solution FROM s)
  SELECT event_id AS id, array_to_string(list_transform(labels, lambda x: CASE WHEN x THEN 'k' ELSE 'n' END), '') AS labels, coalesce(labels = solution, false) AS correct,
  round(CASE WHEN labels IS NULL THEN 0 ELSE len(list_filter([1, 2, 3], lambda i: labels[i] = solution[i])) / 3 END, 6) AS share FROM y""")
def lines_of_labels(e):
    """Four numbered lines whose numbers, names and labels depend on the event: they contradict, repeat or lack some."""
    i, u = F.col("event_id"), F.col("user_id")
    over = lambda c, j: F.floor(c / j).cast("long")

    def said(j):
        number = over(i, j) % 3 + 1 + F.when(i % 11 == j, 1).otherwise(0)
        person = (over(i, j) + over(u, 50) * j) % 3
        label = F.when(over(u, j) % 3 == 0, "a **knight**").when(over(u, j) % 3 == 1, "a knave").otherwise("knave, or is a knave")
        name = F.when(person == 0, "Ann").when(person == 1, "Bob").otherwise("Cy")
        return F.concat(F.lit("("), number.cast("string"), F.lit(") "), name, F.lit(" is "), label, F.lit("\n"))

    t = F.concat(F.lit("Ann is a knight.\n"), F.when(i % 7 > 0, "Conclusion :\n").otherwise(""), *map(said, (1, 3, 9, 2)))
    names, solution = F.array(*map(F.lit, ("Ann", "Bob", "Cy"))), F.array(u % 3 == 0, u % 2 == 0, F.lit(True))
    rows = e.select(i.alias("id"), puzzles.parse_labels(t, names).alias("l"), solution.alias("s"), puzzles.strict_correct(t, names, solution).alias("correct"))
    shown_ = F.array_join(F.transform("l", lambda x: F.when(x, "k").otherwise("n")), "")
    return rows.select("id", shown_.alias("labels"), "correct", F.round(puzzles.share_right(F.col("l"), F.col("s")), 6).alias("share"))
