"""Queries of the text functions: splitters, cleaners, guards, markers, answers, puzzles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import alignment, answers, copies, expressions, markers, puzzles, strips, text
from tracemill.functions import tokens as vocabulary
from tracemill.operators import ordered
from tracemill.operators.common import spread

from .fixtures import PUZZLES, TRACES, quoted, traces
from .fixtures import puzzles as puzzle_rows
from .registry import query

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_COUNT = lambda x, p: f"len(regexp_extract_all({x}, {quoted(p)}))"
_WORDS = lambda x: _COUNT(x, "[^ \t-\r]+")
#: Numbers: commas before just three digits are marked twice over, as one match takes the digit before the next.
_ONCE = lambda x: f"regexp_replace({x}, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\\1§\\2\\3', 'g')"
_NUMBERS = lambda x: f"list_distinct(regexp_extract_all(replace({_ONCE(_ONCE(x))}, '§', ''), '[0-9]+(?:\\.[0-9]+)?'))"
_STOP = "[" + ", ".join(map(quoted, text.STOP)) + "]"
_CONTENT = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{4,}}')), lambda w: NOT list_contains({_STOP}, w))"
_UNITS = lambda x: f"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([.!?])\\s+', '\\1§', 'g'), '§|\\n+'), lambda u: trim(u, {_WS})), lambda u: length(u) >= 20)"
_LISTS = r"(?m)^\s*(?:[0-9]+[.)]|[-*•])\s"
_BOX = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"


@query("t1_split_answer", "documents", sql=f"""WITH {TRACES}, s AS (SELECT idx, output, string_split(output, '**Final Answer**')[-1] AS tail FROM traces),
  h AS (SELECT idx, output, left(output, length(output) - length(tail) - 16) AS head FROM s)
  SELECT idx, md5(rtrim(head, {_WS})) AS reasoning, length(head) - length(rtrim(head, {_WS})) AS gap, substring(output, length(head) + 1) AS answer, true AS exact FROM h""")
def split_answers(d):
    s = traces(d).select("idx", "output", text.split_answer(F.col("output")).alias("s"))
    whole = F.concat("s.reasoning", "s.gap", "s.answer") == F.col("output")
    return s.select("idx", F.md5(F.col("s.reasoning").cast("binary")).alias("reasoning"), F.length("s.gap").cast("long").alias("gap"), "s.answer", whole.alias("exact"))


@query("t2_paragraphs", "documents", sql=f"""WITH {TRACES} SELECT idx, len(regexp_split_to_array(output, '\\n[ \\t]*\\n\\s*')) AS parts,
  md5(array_to_string(regexp_split_to_array(output, '\\n[ \\t]*\\n\\s*'), '|')) AS digest, length(array_to_string(regexp_extract_all(output, '\\n[ \\t]*\\n\\s*'), '')) AS gap_chars FROM traces""")
def paragraph_split(d):
    p = traces(d).select("idx", text.paragraphs(F.col("output")).alias("p"))
    return p.select("idx", F.size("p.parts").cast("long").alias("parts"), F.md5(F.array_join("p.parts", "|").cast("binary")).alias("digest"), F.length(F.array_join("p.gaps", "")).cast("long").alias("gap_chars"))


@query("t3_token_count", "conversations", sql=f"SELECT conv_id, sum({_WORDS('text')}) AS tokens FROM conversations GROUP BY conv_id")
def tokens(c):
    return c.groupBy("conv_id").agg(F.sum(text.token_count(F.col("text"))).cast("long").alias("tokens"))


_RAW = f"""CASE doc_id % 4 WHEN 0 THEN ' Sure! Here is the rewritten text:' || chr(10) || chr(10) || coalesce(text, '') WHEN 1 THEN '```text' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10)
  WHEN 2 THEN 'Text: ' || coalesce(text, '') ELSE text END"""


def _raw():
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    return (
        F.when(k == 0, F.concat(F.lit(" Sure! Here is the rewritten text:\n\n"), t))
        .when(k == 1, F.concat(F.lit("```text\n"), t, F.lit("\n```\n")))
        .when(k == 2, F.concat(F.lit("Text: "), t))
        .otherwise(F.col("text"))
    )


_PREAMBLE_SQL = text.PREAMBLE.replace("(?i)", "").replace(r"\A", "^")


@query("t3_u3_vocabulary_tokens", "conversations", sql=None)
def vocabulary_tokens(c):
    """Tokens of each conversation by a public vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return vocabulary.token_counts(c, ["conv_id"], "text", path, public_tokenizers.PATTERN)


@query("t55_vocabulary", "conversations", sql=None)
def vocabulary_words(c):
    """All words of the conversations, with the token that stands for each alone."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    words = c.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return vocabulary.resolved(words, "word", path, public_tokenizers.PATTERN)


@query("t4_clean_pass1", "documents", sql=f"""WITH a AS (SELECT doc_id, trim(coalesce({_RAW}, ''), {_WS}) AS t FROM documents),
  b AS (SELECT doc_id, t LIKE '```%' AND regexp_matches(t, '^```[a-zA-Z]*\\n.*\\n```$', 's') AS fence, CASE WHEN regexp_matches(t, '^```[a-zA-Z]*\\n.*\\n```$', 's') THEN trim(regexp_extract(t, '^```[a-zA-Z]*\\n(.*?)\\n```$', 1, 's'), {_WS}) ELSE t END AS t FROM a),
  c AS (SELECT doc_id, fence, regexp_matches(t, {quoted(_PREAMBLE_SQL)}, 'i') AS preamble, trim(regexp_replace(t, {quoted(_PREAMBLE_SQL)}, '', 'i'), {_WS}) AS t FROM b)
  SELECT doc_id, md5(CASE WHEN starts_with(t, 'Text:') THEN trim(substring(t, 6), {_WS}) ELSE t END) AS digest,
  concat_ws(',', CASE WHEN fence THEN 'fence' END, CASE WHEN preamble THEN 'preamble' END, CASE WHEN starts_with(t, 'Text:') THEN 'echoed_label' END) AS flags FROM c""")
def cleaned(d):
    c = d.select("doc_id", text.clean_pass1(_raw()).alias("c"))
    return c.select("doc_id", F.md5(F.col("c.text").cast("binary")).alias("digest"), F.array_join("c.flags", ",").alias("flags"))


@query("t5_parse_pass2", "documents", sql=f"""SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'kept open' END ELSE 'a' || doc_id || ' b' END AS text,
  CASE doc_id % 4 WHEN 0 THEN 'first|second|b' WHEN 1 THEN 'b' WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END ELSE '' END AS subs,
  CASE doc_id % 4 WHEN 2 THEN 'no_rewritten_block' WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'no_rewritten_block' ELSE 'unclosed' END ELSE 'tags_in_text' END AS flags FROM documents""")
def parsed(d):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    block = F.concat(F.lit("<rewritten>old</rewritten> <REWRITTEN>\na"), i, F.lit(" <sub>b</sub> </REWRITTEN> end"))
    raw = (
        F.when(k == 0, F.concat(F.lit("<SUB>- first\n2) second\n</SUB>"), block))
        .when(k == 1, block)
        .when(k == 2, F.concat(F.lit("<SUB>lost</SUB>"), i))
        .otherwise(F.lit("<SUB>* x</SUB> <REWRITTEN> kept open "))
    )
    p = d.select("doc_id", text.parse_pass2(raw, F.col("doc_id") % 3 == 0).alias("p"))
    return p.select("doc_id", "p.text", F.array_join("p.subs", "|").alias("subs"), F.array_join("p.flags", ",").alias("flags"))


@query("t6_t7_numbers", "documents", sql=f"""WITH {TRACES}, n AS (SELECT idx, {_NUMBERS('output')} AS a, {_NUMBERS('rewrite')} AS b FROM traces)
  SELECT idx, len(a) AS total, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, list_contains(a, '29.98') AS has_decimal FROM n""")
def numbers(d):
    t = traces(d).select("idx", text.missing_numbers(F.col("output"), F.col("rewrite")).alias("m"), F.array_contains(text.numbers(F.col("output")), "29.98").alias("has_decimal"))
    return t.select("idx", F.col("m.total").cast("long").alias("total"), F.col("m.missing").cast("long").alias("missing"), "has_decimal")


@query("t8_so3_content_words", "documents", sql=f"SELECT doc_id, len({_CONTENT('text')}) AS n FROM documents WHERE text IS NOT NULL")
def content(d):
    return d.filter(F.col("text").isNotNull()).select("doc_id", F.size(text.content_words(F.col("text"))).cast("long").alias("n"))


@query("t9_so4_content_recall", "documents", sql=f"""WITH {TRACES}, c AS (SELECT idx, {_CONTENT('output')} AS a, {_CONTENT('rewrite')} AS b FROM traces)
  SELECT idx, round(CASE WHEN len(a) >= 5 THEN 1.0 * len(list_intersect(a, b)) / len(a) END, 6) AS recall FROM c""")
def recall(d):
    return traces(d).select("idx", F.round(text.content_recall(F.col("output"), F.col("rewrite")), 6).alias("recall"))


def _guard_sql(low, high, recall):
    return f"""CASE WHEN finish = 'length' THEN 'truncated' WHEN trim(rewrite, {_WS}) = '' THEN 'empty' WHEN length(output) >= 300 AND 1.0 * length(rewrite) / length(output) < {low} THEN 'too_short'
      WHEN length(output) >= 300 AND 1.0 * length(rewrite) / length(output) > {high} THEN 'too_long'
      WHEN miss > greatest(1, ceil(0.10 * total)) THEN 'numbers_missing' WHEN recall < {recall} THEN 'content_lost' WHEN lists > 2 THEN 'list_introduced' END"""


_FACTS = f"""facts AS (SELECT idx, lang, output, rewrite, finish, len(a) AS total, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS miss,
  CASE WHEN len(c) >= 5 THEN 1.0 * len(list_intersect(c, e)) / len(c) END AS recall, {_COUNT('rewrite', _LISTS)} - {_COUNT('output', _LISTS)} AS lists
  FROM (SELECT *, {_NUMBERS('output')} AS a, {_NUMBERS('rewrite')} AS b, {_CONTENT('output')} AS c, {_CONTENT('rewrite')} AS e FROM traces))"""


@query("t10_t11_guards", "documents", sql=f"""WITH {TRACES}, {_FACTS} SELECT idx, {_guard_sql(0.35, 1.30, 0.50)} AS pass1, {_guard_sql(0.75, 1.35, 0.70)} AS pass2,
  {_guard_sql(0.90, 1.60, 0.70)} AS revoice, {_guard_sql(0.90, 2.20, 0.70)} AS style FROM facts""")
def guards(d):
    o, r, f = F.col("output"), F.col("rewrite"), F.col("finish")
    head = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    return traces(d).select(
        "idx", head(text.check(o, r, 1, f)).alias("pass1"), head(text.check(o, r, 2, f)).alias("pass2"),
        head(text.check_revoice(o, r, f)).alias("revoice"), head(text.check_revoice(o, r, f, text.STYLE_RATIO)).alias("style"),
    )


@query("ag11_reason_counts", "documents", sql=f"""WITH {TRACES}, {_FACTS}, r AS (SELECT {_guard_sql(0.35, 1.30, 0.50)} AS one, {_guard_sql(0.75, 1.35, 0.70)} AS two FROM facts)
  SELECT reason, count(*) AS n FROM (SELECT one AS reason FROM r UNION ALL SELECT two FROM r) WHERE reason IS NOT NULL GROUP BY reason""")
def reason_counts(d):
    o, r, f = F.col("output"), F.col("rewrite"), F.col("finish")
    fails = traces(d).select(F.explode(F.array_compact(F.array(text.check(o, r, 1, f), text.check(o, r, 2, f)))).alias("x"))
    return fails.groupBy(F.split_part("x", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("t12_t14_units", "documents", sql=None)
def unit_match(d):
    """Units of a trace that its rewrite holds with a similarity of 70 or more."""
    return alignment.lexical_match(traces(d), ["idx"], "output", "rewrite")


@query("t12_verbatim_units", "documents", sql=f"""WITH {TRACES}, u AS (SELECT idx, rewrite, {_UNITS('output')} AS u FROM traces)
  SELECT idx, len(u) AS units, len(list_filter(u, lambda x: contains(rewrite, x))) AS found FROM u""")
def verbatim_units(d):
    m = traces(d).select("idx", text.verbatim_match(F.col("output"), F.col("rewrite")).alias("m"))
    return m.select("idx", F.col("m.units").cast("long").alias("units"), F.col("m.found").cast("long").alias("found"))


@query("t13_t14_aligned_units", "conversations", sql=None)
def unit_scores(c):
    """Each sentence of a turn against the turn with its words thinned out and its halves exchanged: similarity and place."""
    words = F.split("text", " ")
    thin = F.filter(words, lambda w, i: i % 9 != 8)
    half = F.floor(F.size(thin) / 2).cast("int")
    turned = F.array_join(F.concat(F.slice(thin, half + 1, F.size(thin)), F.slice(thin, F.lit(1), half)), " ")
    rows = c.select("conv_id", "turn", text.units(F.col("text")).alias("units"), turned.alias("other"))
    m = alignment.aligned(rows, "units", "other", 50.0, "m")
    return m.select("conv_id", "turn", F.col("m.at").alias("unit"), F.round("m.score", 6).alias("score"), "m.start")


@query("t15_reorder", "conversations", sql=f"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS a, regexp_split_to_array(coalesce(text, ''), ' ') AS w FROM conversations),
  t AS (SELECT conv_id, turn, a, array_to_string(w[len(w) // 2 + 1:], ' ') || ' ' || array_to_string(w[:len(w) // 2], ' ') AS b, {_UNITS('a')} AS u FROM p),
  x AS (SELECT conv_id, turn, list_filter(list_transform(u, lambda s: instr(b, s)), lambda k: k > 0) AS places FROM t),
  l AS (SELECT conv_id, turn, places, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(places, lambda k: [k])), lambda d, k: list_append(d, 1 + coalesce(list_max(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN places[i] < k[1] THEN d[i] END)), 0))) AS d FROM x)
  SELECT conv_id, turn, len(places) AS located, len(places) - coalesce(list_max(d), 0) AS moved FROM l""")
def reordered(c):
    """Each turn's sentences in the turn with its halves exchanged: how many are found, how many out of their order."""
    w = F.split(F.coalesce("text", F.lit("")), " ")
    half = F.floor(F.size(w) / 2).cast("int")
    turned = F.concat(F.array_join(F.slice(w, half + 1, F.size(w)), " "), F.lit(" "), F.array_join(F.slice(w, F.lit(1), half), " "))
    rows = spread(c).select("conv_id", "turn", text.units(F.col("text")).alias("units"), turned.alias("b"))
    places = F.filter(F.transform("units", lambda u: F.instr(F.col("b"), u)), lambda k: k > 0)
    out = rows.withColumn("places", places)
    return out.select("conv_id", "turn", F.size("places").alias("located"), (F.size("places") - ordered.rise(F.col("places"))).alias("moved"))


@query("t15_hoisted", "conversations", sql="""WITH p AS (SELECT conv_id, turn, text AS a, array_to_string(list_reverse(string_split(text, '. ')), '. ') AS b, list_distinct(list_filter(string_split(text, '. '), lambda s: length(s) >= 20)) AS s FROM conversations WHERE text IS NOT NULL),
  u AS (SELECT conv_id, turn, a, b, unnest(s) AS s FROM p) SELECT conv_id, turn, count(*) FILTER ((instr(b, s) - 1) / length(b) < (instr(a, s) - 1) / length(a) - 0.05) AS hoisted FROM u GROUP BY conv_id, turn""")
def hoists(c):
    """Each turn's pieces in the turn with its pieces in reverse: those that stand earlier by more than 5 %."""
    pieces = F.split("text", r"\. ")
    rows = c.filter(F.col("text").isNotNull()).select("conv_id", "turn", F.col("text").alias("a"), F.array_join(F.reverse(pieces), ". ").alias("b"), F.array_distinct(pieces).alias("s"))
    return alignment.hoisted(rows, ["conv_id", "turn"], "a", "b", "s")


@query("t24_w20_copies", "conversations", sql=r"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS a, coalesce(regexp_extract(text, '^(.*?[.!?])(?:\s|$)', 1, 's'), '') AS h FROM conversations),
  h AS (SELECT *, CASE WHEN length(h) >= 20 THEN len(string_split(a, h)) - 1 ELSE 0 END AS k FROM p)
  SELECT conv_id, turn, CASE WHEN k = 1 THEN 2 ELSE NULL END AS removed, CASE WHEN k = 1 THEN 0 END AS left_over, CASE WHEN k = 1 THEN md5(h || CASE WHEN length(a) > length(h) THEN regexp_replace(substr(a, length(h) + 1), '^[ \t]+', ' ') ELSE '' END) END AS digest FROM h WHERE k <= 1""")
def copies_of_heads(c):
    """Each turn's first sentence before and after it: the copies behind the first one go. Turns that hold it once."""
    a = F.coalesce("text", F.lit(""))
    head = F.regexp_extract(a, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    rows = spread(c).select("conv_id", "turn", a.alias("a"), head.alias("h"))
    known = F.when(F.length("h") >= 20, copies.occurrences(F.col("a"), F.col("h"))).otherwise(0)
    rows = rows.withColumn("k", known).filter("k <= 1").withColumn("b", F.concat_ws(" ", "h", "a", "h"))
    rows = rows.select("conv_id", "turn", "k", copies.without_copies(F.col("a"), F.col("b"), F.array("h")).alias("x"))
    one = F.col("k") == 1
    return rows.select("conv_id", "turn", F.when(one, F.col("x.removed")).alias("removed"), F.when(one, F.col("x.left")).alias("left_over"), F.when(one, F.md5(F.col("x.text").cast("binary"))).alias("digest"))


@query("t16_t20_scratchpad", "documents", sql=f"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '<think>' || text || '</think>' || chr(10) || ' answer ' || doc_id || ' ' ELSE 'a</think> b </think>' || doc_id END AS t FROM documents)
  SELECT doc_id, CASE WHEN contains(t, '</think>') THEN trim(string_split(t, '</think>')[-1], {_WS}) END AS harvested, md5(trim(replace(replace(t, '</think>', ''), '<think>', ''), {_WS})) AS stripped FROM r""")
def scratchpad(d):
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    t = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("<think>"), "text", F.lit("</think>\n answer "), i, F.lit(" "))).otherwise(F.concat(F.lit("a</think> b </think>"), i))
    r = d.select("doc_id", t.alias("t"))
    return r.select("doc_id", text.after_last(F.col("t"), "</think>").alias("harvested"), F.md5(text.strip_think(F.col("t")).cast("binary")).alias("stripped"))


@query("t17_t18_boxes", "documents", sql=f"""WITH {TRACES}, b AS (SELECT idx, regexp_extract_all(output, {quoted(_BOX)}, 1) AS b, list_filter(string_split(output, chr(10)), lambda l: contains(l, '\\boxed{{'))[-1] AS line FROM traces)
  SELECT idx, len(b) AS boxes, b[-1] AS last, array_to_string(regexp_extract_all(line, {quoted(_BOX)}, 1), ';') AS own FROM b""")
def boxes(d):
    o = F.col("output")
    own = answers.own_answer(F.concat(F.lit("thought</think>"), o))
    return traces(d).select("idx", F.size(answers.boxed(o)).cast("long").alias("boxes"), answers.extract_answer(o).alias("last"), F.array_join(own, ";").alias("own"))


@query("t19_j17_answers_agree", "documents", sql=f"""WITH {TRACES}, b AS (SELECT idx, list_transform(string_split(regexp_extract_all(output, {quoted(_BOX)}, 1)[-2], ','), lambda x: trim(x)) AS g,
  list_transform(flatten(list_transform(regexp_extract_all(rewrite, {quoted(_BOX)}, 1), lambda x: string_split(x, ','))), lambda x: trim(x)) AS p FROM traces)
  SELECT idx, CASE WHEN len(p) = 0 THEN NULL ELSE len(list_filter(g, lambda x: NOT list_contains(p, x))) = 0 END AS agrees FROM b""")
def agreement(d):
    """The last but one box, of two parts, against all boxes of the rewrite."""
    source = F.regexp_replace(F.col("output"), r"\*\*Final Answer\*\*\n\\boxed\{[^}]*\}$", "")
    return traces(d).select("idx", answers.answers_agree(source, F.col("rewrite")).alias("agrees"))


@query("e1_e3_math_equal", "documents", sql="""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false ELSE doc_id % 3 = 0 END AS equal FROM documents""")
def equalities(d):
    i, k = F.col("doc_id"), F.col("doc_id") % 8
    t = lambda x: x.cast("string")
    a = (
        F.when(k == 0, F.concat(F.lit("\\frac{"), t(i), F.lit("}{4}"))).when(k == 1, F.lit("1,000")).when(k == 2, F.lit("\\text{ Yes }"))
        .when(k == 3, F.concat(F.lit("x + "), t(i))).when(k == 4, F.lit("$\\dfrac12$")).when(k == 5, F.lit("50\\%")).when(k == 6, F.lit("")).otherwise(t(i % 3))
    )
    b = (
        F.when(k == 0, t(i / 4)).when(k == 1, F.lit("1000.0")).when(k == 2, F.lit("yes")).when(k == 3, F.concat(F.lit("x - "), t(i)))
        .when(k == 4, F.lit("0.5")).when(k == 5, F.lit("0.5")).when(k == 6, F.lit("")).otherwise(F.lit("0"))
    )
    return d.select("doc_id", answers.math_equal(a, b).alias("equal"))


_I, _N = "coalesce(doc_id, 0)", "coalesce(n_chars, 0)"


@query("e1_expressions", "documents", sql=f"""WITH v AS (SELECT doc_id, {_I} % 6 AS k, {_I} // 6 AS i, {_N} AS n FROM documents)
  SELECT doc_id, CASE k WHEN 0 THEN (i % 5) + (n % 7) = (i % 5) + (n % 7) + n // 7 % 2 AND (i % 5) * (n % 7) = (i % 5) * (n % 7) + i // 5 % 2
    WHEN 1 THEN (i % 12) * (n % 5 + 1) = (n % 12) * (i % 5 + 1) WHEN 2 THEN list_sort(list_distinct([i % 3, n % 3, 2])) = list_sort(list_distinct([n % 2, i % 2, 2]))
    WHEN 3 THEN i % 60 + 1 = (n % 3 + 1) * (n % 3 + 1) * (n % 9 + 1) WHEN 4 THEN (i % 4) * 2 = n % 8 AND i % 2 = n // 8 % 2 ELSE i % 6 = n % 6 END AS equal FROM v""")
def equal_expressions(d):
    """Products and sums, fractions in another order, sets, roots, intervals and quotients of numbers that differ by row;
    the SQL compares their coefficients."""
    k, i, n = F.coalesce("doc_id", F.lit(0)) % 6, F.expr("coalesce(doc_id, 0) div 6"), F.coalesce("n_chars", F.lit(0))
    div = lambda c, by: F.floor(c / by)
    put = lambda form, *cs: F.format_string(form, *[c.cast("long") for c in cs])
    a, b = i % 5, n % 7
    pairs = [
        (put("(x+%d)(x+%d)", a, b), put("%d + x^2 + %d\\cdot x", a * b + div(i, 5) % 2, a + b + div(n, 7) % 2)),
        (put("\\frac{%d}{%d}y + \\sqrt{z}", i % 12, i % 5 + 1), put("\\sqrt{z}+y\\left(%d/%d\\right)", n % 12, n % 5 + 1)),
        (put("\\{%d, %d, 2\\}", i % 3, n % 3), put("2,%d,\\frac{%d}{2}", n % 2, i % 2 * 2)),
        (put("\\sqrt{%d}", i % 60 + 1), put("%d\\sqrt{%d}", n % 3 + 1, n % 9 + 1)),
        (put("\\left[%d, t+%d\\right)", i % 4, i % 2), put("[\\frac{%d}{2}, %d + t)", n % 8, div(n, 8) % 2)),
        (put("\\frac{x^2 - %d}{x - %d}", (i % 6) * (i % 6), i % 6), put("%d+x", n % 6)),
    ]
    pick = lambda side: F.element_at(F.array(*[p[side] for p in pairs]), (k + 1).cast("int"))
    rows = spread(d).select("doc_id", pick(0).alias("a"), pick(1).alias("b"))
    return rows.select("doc_id", expressions.math_equal(F.col("a"), F.col("b")).alias("equal"))


@query("e2_extract_answer", "documents", sql=f"""SELECT doc_id, regexp_extract_all(coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' \\boxed{{a{{b}}c}}' ELSE '' END, {quoted(_BOX)}, 1)[-1] AS boxed,
  CASE WHEN doc_id % 2 = 0 THEN 'a{{b}}c' ELSE regexp_extract_all(replace(coalesce(text, ''), ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')[-1] END AS with_fallback FROM documents""".replace("{{", "{").replace("}}", "}"))
def extracted(d):
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.lit(" \\boxed{a{b}c}")).otherwise(""))
    return d.select("doc_id", answers.extract_answer(t).alias("boxed"), answers.extract_answer(t, fallback=True).alias("with_fallback"))


#: Distinct n-word windows to all of a list of words l, 1 below 4n words.
_SHARE = lambda l, n: f"CASE WHEN len({l}) < {4 * n} THEN 1.0 ELSE len(list_distinct(list_transform(range(len({l}) - {n - 1}), lambda i: array_to_string({l}[i + 1:i + {n}], ' ')))) / (len({l}) - {n - 1}) END"


@query("t22_t23_w13_clean_prefix", "documents", sql=f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x != '') AS w FROM documents),
  l AS (SELECT doc_id, w || flatten(list_transform(range(30), lambda k: w[greatest(len(w) - 19, 1):])) AS l FROM d WHERE len(w) > 0),
  g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id, x ORDER BY i) AS before FROM (SELECT doc_id, i, array_to_string(l[i + 1:i + 8], ' ') AS x FROM (SELECT doc_id, l, unnest(range(len(l) - 7)) AS i FROM l WHERE len(l) >= 400))),
  s AS (SELECT doc_id, unnest(range(0, len(l) - 400, 100)) AS s FROM l WHERE len(l) > 400),
  b AS (SELECT doc_id, min(s) AS cut FROM (SELECT s.doc_id, s FROM s JOIN g ON g.doc_id = s.doc_id AND g.i >= s AND g.i < s + 393 GROUP BY s.doc_id, s HAVING count(*) FILTER (before IS NULL OR before < s) < 0.6 * 393) GROUP BY doc_id),
  c AS (SELECT doc_id, l, CASE WHEN len(l) >= 400 AND coalesce(cut, len(l)) >= 400 THEN array_to_string(l[:coalesce(cut, len(l))], ' ') END AS t FROM l LEFT JOIN b USING (doc_id)),
  e AS (SELECT doc_id, l, t, length(t) - length(string_split(t, '. ')[-1]) - 1 AS ended FROM c),
  f AS (SELECT doc_id, l, CASE WHEN contains(t, '. ') AND ended - 1 > length(t) * 0.5 THEN left(t, ended) ELSE t END AS t FROM e),
  o AS (SELECT doc_id, l, CASE WHEN {_SHARE('l', 12)} >= 0.6 THEN array_to_string(l, ' ') WHEN {_SHARE("string_split(t, ' ')", 12)} >= 0.6 THEN t END AS out FROM f)
  SELECT doc_id, len(l) AS words, len(string_split(out, ' ')) AS kept, md5(out) AS digest FROM o""")
def prefixes(d):
    """Each text, then thirty copies of its last words: the loop is cut off, or the text refused."""
    w = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), "")

    def made(x):
        loop = F.repeat(F.concat(F.lit(" "), F.array_join(F.slice(x, F.greatest(F.size(x) - 19, F.lit(1)), F.lit(20)), " ")), F.lit(30))
        looped = F.concat(F.array_join(x, " "), loop)
        facts = lambda o: F.struct(text.word_count(o).alias("kept"), F.md5(o.cast("binary")).alias("digest"))
        return text.let(looped, lambda t: F.struct(text.word_count(t).alias("words"), text.let(text.build_output(F.lit("search"), t, F.lit("")), facts).alias("o")))

    some = spread(d).filter(F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]"))
    out = some.select("doc_id", text.let(w, made).alias("x"))
    return out.select("doc_id", "x.words", "x.o.kept", "x.o.digest")


_MARK = "(?i)" + markers.MARKER.replace("(?i)", "")
_HELD = "(?i)" + "|".join(markers.HELD_OUT)
_BLANKED = f"regexp_replace(output, {quoted(markers.MATH.replace('(?s)', ''))}, ' ', 'gs')"
_PER = lambda n, x: f"round(1000.0 * ({n}) / greatest({_WORDS(x)}, 1), 6)"
#: RE2's \\b knows ASCII letters only, so what parts words is doubled and matched.
_APART = "regexp_replace(b, '([^\\p{L}\\p{N}_''’])', '\\1\\1', 'g')"
_PLURAL = r"(?i)(?:^|[^\p{L}\p{N}_])(?:we|us|our|ours|ourselves|let's|let’s)(?:$|[^\p{L}\p{N}_])"
_FIRST = "{} - {} + {}".format(_COUNT("b", r"\bI\s+[a-z]"), _COUNT("b", r"\b[lL]et I\s+[a-z]"), _COUNT("b", r"\bI'(?:m|ll|ve|d)\b"))


@query("t25_t26_t29_t30_densities", "documents", sql=f"""WITH {TRACES}, b AS (SELECT idx, output, {_BLANKED} AS b FROM traces)
  SELECT idx, {_PER(_COUNT('output', _MARK), 'output')} AS markers, {_PER(_COUNT('output', _HELD), 'output')} AS held_out, {_PER(_COUNT('output', '(?i)\\b(?:' + '|'.join(markers.NINE) + ')\\b'), 'output')} AS nine,
  {_PER(_FIRST + ' + ' + _COUNT('b', markers.INTERJECTION), 'b')} AS self_talk, {_PER(_COUNT(_APART, _PLURAL), 'b')} AS plural FROM b""")
def all_densities(d):
    o, c = F.col("output"), F.col("c")
    six = lambda x: F.round(x, 6)
    per = lambda n: six(markers.per_thousand(c[n], o)).alias(n)
    rows = traces(d).select("idx", "output", markers.lexicon_counts(o).alias("c"))
    return rows.select("idx", per("markers"), per("held_out"), per("nine"), six(markers.self_talk_density(o)).alias("self_talk"), six(markers.plural_density(o)).alias("plural"))


_TOKEN_SUMS = " UNION ALL ".join(f"SELECT {quoted(t)} AS token, sum({_COUNT('output', '(?i)' + chr(92) + 'b' + t + chr(92) + 'b')}) AS n FROM traces" for t in markers.NINE)
_BYPASS_SUM = " + ".join(_COUNT("output", f"(?i){p}") for p in markers.BYPASS)


@query("t31_t32_token_counts", "documents", sql=f"WITH {TRACES} {_TOKEN_SUMS} UNION ALL SELECT 'bypass', sum({_BYPASS_SUM}) FROM traces")
def token_sums(d):
    rows = traces(d).select(markers.lexicon_counts(F.col("output")).alias("c"))
    counts = markers.counts_by_token(F.col("c"))
    sums = rows.agg(*[F.sum(c).cast("long").alias(t) for t, c in counts.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(t).alias("n")) for t in counts])).alias("x")).select("x.*")


_BARE = f"regexp_replace(replace(output, '$$$', ''), {quoted(markers.MATH_OR_BOX)}, '¤', 'gs')"
_ANY = "(?i)\\b(?:" + "|".join(markers.MARKERS) + ")\\b"
_SPLIT = lambda t: f"string_split(regexp_replace({t}, '([.!?])(\\s+)', '\\1§\\2§', 'g'), '§')"
_KEPT = f"trim(array_to_string(list_filter(string_split(regexp_replace(s, '([,;:])', '\\1§', 'g'), '§'), lambda c: NOT regexp_matches(c, {quoted(_ANY)})), ''), ' ,;:')"


@query("t27_t28_strips", "documents", sql=rf"""WITH {TRACES}, b AS (SELECT idx, {_BARE} AS t FROM traces),
  w AS (SELECT idx, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {quoted(_ANY + '[' + chr(92) + 's,:;.!?-]*')}, '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '(^|\n)\s*[,;:]\s*', '\1', 'g'), '(^|[.!?]\s+)([a-z])', '\1§\2', 'g'), '§') AS p FROM b),
  c AS (SELECT idx, list_transform({_SPLIT('t')}, lambda s: CASE WHEN NOT regexp_matches(s, {quoted(_ANY)}) THEN s WHEN {_KEPT} = '' OR regexp_matches({_KEPT}, '[.!?]\n?$') THEN {_KEPT} ELSE {_KEPT} || '.' END) AS p FROM b),
  s AS (SELECT idx, list_filter(regexp_split_to_array(regexp_replace(t, '([.!?])\s+', '\1§', 'g'), '§|\n+'), lambda s: trim(s, {_WS}) != '' AND NOT regexp_matches(s, {quoted(_ANY)})) AS p FROM b)
  SELECT idx, md5(w.p[1] || array_to_string(list_transform(w.p[2:], lambda x: upper(x[1]) || x[2:]), '')) AS words, md5(regexp_replace(array_to_string(c.p, ''), '[ \t]{{2,}}', ' ', 'g')) AS clauses, md5(array_to_string(s.p, chr(10))) AS sentences
  FROM w JOIN c USING (idx) JOIN s USING (idx)""")
def strips_of_traces(d):
    """Each trace without markers, their clauses and their sentences; mathematics is blanked in what is compared, and
    strings of three dollar signs go before, as the loss of one would pair others."""
    t = strips.stripped(traces(d).select("idx", F.replace("output", F.lit("$$$")).alias("o")), "o", *strips.EDITS)
    bare = lambda n: F.regexp_replace(n, "(?s)" + markers.MATH_OR_BOX, "¤")
    return t.select("idx", *[F.md5(bare(n).cast("binary")).alias(n) for n in strips.EDITS])


@query("t33_common_prefix", "documents", sql="SELECT doc_id, least(length(text), 10 + doc_id % 90) AS prefix FROM documents WHERE text IS NOT NULL")
def prefix_lengths(d):
    other = F.concat(F.left("text", (10 + F.col("doc_id") % 90).cast("int")), F.lit("\x01"), F.col("text"))
    return d.filter(F.col("text").isNotNull()).select("doc_id", text.common_prefix(F.col("text"), other).cast("long").alias("prefix"))


@query("t36_t37_t38_solutions", "documents", sql="""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id * 1000 AS VARCHAR) END AS gold, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE 'work. The answer is \\boxed{' || doc_id || '}.' END AS shown,
  CASE doc_id % 3 WHEN 0 THEN 'body \\boxed{1}' WHEN 1 THEN 'body' || chr(10) || 'The final answer is $\\boxed{' || doc_id || '}$.' END AS final FROM documents""".replace("\\\\", "\\"))
def solutions(d):
    i = F.col("doc_id").cast("string")
    gold = F.when(F.col("doc_id") % 5 == 0, "no mark").otherwise(F.concat(F.lit("a #### b #### $"), i, F.when(F.col("doc_id") == 0, "000").otherwise(",000"), F.lit(".")))
    gold = F.when(F.col("doc_id") == 0, F.lit("no mark")).otherwise(gold)
    shown = F.when(F.col("doc_id") % 5 == 1, "The answer is none\n5").otherwise(F.concat(F.lit("work. The answer is "), i, F.lit(" of 9.\nThe answer is 4.")))
    line = F.concat(F.lit("body \nFinal Answer: The final answer is $"), i, F.lit("$. I hope it is correct."))
    final = F.when(F.col("doc_id") % 3 == 0, "body \\boxed{1} Final Answer: x").when(F.col("doc_id") % 3 == 1, line).otherwise("body")
    return d.select("doc_id", answers.hash_gold(gold).alias("gold"), answers.shown_solution(shown).alias("shown"), answers.final_line_solution(final).alias("final"))


@query("t39_pf15_teacher_reference", "documents", sql="""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\\boxed{1, 2}' WHEN 1 THEN '\\boxed{' || doc_id || '}' WHEN 2 THEN '\\boxed{x}' ELSE '' END AS reference, doc_id % 4 <> 3 AND doc_id % 4 = 2 AS matched FROM documents""".replace("\\\\", "\\"))
def references(d):
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    trace = F.when(k == 0, "so \\boxed{1, 2} and \\boxed{\\text{ANSWER}}")
    forced = F.concat(F.lit("\\boxed{"), i, F.lit("}"))
    forced = F.when(k == 1, forced).otherwise("no box")
    said = F.when(k == 0, F.lit("12")).otherwise(F.lit("None"))
    late = F.when(k.isin(1, 2), "7").otherwise("")
    ref = answers.teacher_reference(trace, said, forced, late, F.when(k == 2, "x"))
    return d.select("doc_id", ref.alias("reference"), answers.matches_label(F.lit("x"), answers.extract_answer(ref)).alias("matched"))


@query("t40_t41_t46_puzzle_labels", "events", sql=f"""WITH {PUZZLES} SELECT id, labels IS NOT NULL AS readable, coalesce(labels = solution, false) AS correct,
  round(CASE WHEN labels IS NULL THEN 0 WHEN id % 6 = 5 THEN 2 / 3 ELSE 1 END, 6) AS share FROM puzzles""")
def labels(e):
    p = puzzle_rows(e).withColumn("labels", puzzles.parse_labels(F.col("text"), F.col("names")))
    right = puzzles.strict_correct(F.col("text"), F.col("names"), F.col("solution"))
    return p.select("id", F.col("labels").isNotNull().alias("readable"), right.alias("correct"), F.round(puzzles.share_right(F.col("labels"), F.col("solution")), 6).alias("share"))


@query("t41_published_criterion", "events", sql="SELECT event_id AS id, event_id % 6 IN (0, 2) AS correct FROM events")
def published(e):
    p = puzzle_rows(e)
    said = F.zip_with("names", "solution", lambda n, s: F.concat(n, F.lit(" is a "), F.when(s, "knight").otherwise("knave")))
    gold = F.concat(F.array_join(F.slice(said, F.lit(1), F.lit(2)), ", "), F.lit(", and "), F.element_at(said, 3), F.lit("."))
    return p.select("id", puzzles.published_correct(F.col("text"), gold).alias("correct"))


@query("t42_t43_t44_conclusions", "events", sql="""SELECT event_id AS id, event_id % 3 < 2 AS has_conclusion, event_id % 2 = 0 AS ended, CASE WHEN event_id % 2 = 0 THEN 'rewrite ' || event_id ELSE 'thought rewrite ' || event_id END AS rewrite,
  CASE WHEN event_id % 3 = 2 THEN 17 ELSE 631 END AS first_chars FROM events""")
def conclusions(e):
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 3
    lines = F.when(k == 0, "**Conclusion**:\n(1) a\n(2) b\n(3) c").when(k == 1, "conclusion: \nnone\nCONCLUSION:\n(1) a\n(1) b\nx\n *(2) c").otherwise("no end (1) (2) (3)")
    whole = F.concat(F.lit("so</think>"), lines)
    channel = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("thought<|channel|>final<|message|>rewrite "), i, F.lit("<|end|>"))).otherwise(F.concat(F.lit("thought<|x|>rewrite "), i))
    part = F.when(k == 2, F.lit("a</think>b</think>12345678")).otherwise(F.concat(F.lit("</think>"), F.repeat(F.lit("y"), 31), F.lit("Conclusion: "), F.repeat(F.lit("z"), 900)))
    rows = e.select("event_id", puzzles.teacher_conclusion(whole, F.when(k == 0, 3).otherwise(2)).alias("c"), puzzles.split_output(channel, channel=True).alias("s"), puzzles.first_answer(part).alias("f"))
    return rows.select(F.col("event_id").alias("id"), F.col("c").isNotNull().alias("has_conclusion"), "s.ended", "s.rewrite", F.length("f").alias("first_chars"))


@query("t45_t46_u6_rewards", "documents", sql="""SELECT doc_id, doc_id % 4 < 3 AS anywhere, doc_id % 4 < 2 AS final, doc_id % 4 = 0 AS reasoned, CASE WHEN doc_id % 4 < 3 AND doc_id % 5 = 2 THEN 1.0 ELSE 0.0 END AS exact,
  CASE WHEN doc_id % 4 = 3 THEN -1.0 WHEN doc_id % 5 = 2 THEN 1.0 ELSE -0.5 END AS mixed FROM documents""")
def rewards(d):
    k, a = F.col("doc_id") % 4, F.concat(F.lit("\\boxed{"), (F.col("doc_id") % 5).cast("string"), F.lit("}"))
    t = F.when(k == 0, F.concat(F.lit("one two three four five "), a, F.lit("."))).when(k == 1, F.concat(F.lit("so "), a, F.lit(" $ ")))
    t = t.when(k == 2, F.concat(a, F.lit(" it is"))).otherwise("none")
    row = d.select("doc_id", t.alias("t"))
    c = F.col("t")
    return row.select(
        "doc_id", answers.format_ok(c, "anywhere").alias("anywhere"), answers.format_ok(c, "final").alias("final"),
        answers.format_ok(c, "final_reasoned", 5).alias("reasoned"), answers.reward_exact(c, F.lit("2")).alias("exact"), answers.reward_mix(c, F.lit("2")).alias("mixed"),
    )


@query("t47_t48_t50_t53_t54_formats", "events", sql="""WITH s AS (SELECT event_id, CASE WHEN (event_id & 1) > 0 THEN 'knight' ELSE 'knave' END AS a, CASE WHEN (event_id & 2) > 0 THEN 'knight' ELSE 'knave' END AS b, CASE WHEN (event_id & 4) > 0 THEN 'knight' ELSE 'knave' END AS c FROM events)
  SELECT event_id AS id, 'CONCLUSION:' || chr(10) || '(1) Ann is a ' || a || chr(10) || '(2) Bob is a ' || b || chr(10) || '(3) Cy is a ' || c || chr(10) AS said,
  chr(10) || '(The correct identities are: Ann is a ' || a || ', Bob is a ' || b || ', Cy is a ' || c || '. Show the reasoning that leads to them.)' AS hint,
  'runs/a.b/' || event_id || '.meta.json' AS sidecar, CASE WHEN event_id % 2 = 0 THEN '<think>' || chr(10) || 'x' ELSE 'x' END AS target, event_id % 3 <> 0 AS plain FROM s""")
def formats(e):
    p = puzzle_rows(e)
    i = F.col("id").cast("string")
    number = F.when(F.col("id") % 3 == 0, F.concat(i, F.lit(".x"))).when(F.col("id") % 3 == 1, F.concat(F.lit("-"), i, F.lit(".5"))).otherwise(i)
    return p.select(
        "id", puzzles.conclusion(F.col("names"), F.col("solution")).alias("said"), puzzles.hint_text(F.col("names"), F.col("solution")).alias("hint"),
        text.sidecar_name(F.concat(F.lit("runs/a.b/"), i, F.lit(".json"))).alias("sidecar"), text.as_target(F.lit("x"), F.col("id") % 2 == 0).alias("target"), text.is_plain_number(number).alias("plain"),
    )


@query("t51_rounding", "lineitem", sql="SELECT l_returnflag, round_even(avg(l_quantity), 1) AS mean FROM lineitem GROUP BY l_returnflag")
def rounding(line):
    return line.groupBy("l_returnflag").agg(F.bround(F.avg("l_quantity"), 1).alias("mean"))


@query("j16_other_labels", "events", sql="SELECT event_id AS id, 7 AS others, true AS all_wrong FROM events")
def others(e):
    p = puzzle_rows(e).select("id", "solution", puzzles.other_labels(F.col("solution")).alias("o"))
    return p.select("id", F.size(F.array_distinct("o")).alias("others"), F.forall("o", lambda v: v != F.col("solution")).alias("all_wrong"))
