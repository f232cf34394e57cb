"""The columns of the corpus queries that SQL can express, as queries of their own, with the SQL.

Each takes its rows through the operator's own query; what hashing, boosting or search decide has no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .mixing import op7_mixing
from .pii import op1_pii
from .quality import op3_quality
from .secrets import op2_secrets
from .sharding import op10_sharding

_W = "[^ ' || chr(9) || '-' || chr(13) || ']+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_W}')"
_T = "coalesce(text, '')"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
#: The sum of a digit string by Luhn's rule; every second digit from the right is doubled.
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substring(d, length(d) - i + 1, 1) AS INT) ELSE 2 * CAST(substring(d, length(d) - i + 1, 1) AS INT) - CASE WHEN CAST(substring(d, length(d) - i + 1, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

SQL = {
    "base_op1_pii": rf"""SELECT doc_id, len(regexp_extract_all({_T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
      len(list_filter(regexp_extract_all({_T}, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right('0' || p, 4) AS INT) > 255)) = 0)) AS n_ip,
      len(list_filter(list_transform(regexp_extract_all({_T}, '[0-9](?:[ -]?[0-9])+'), lambda x: {_DIGITS}), lambda d: length(d) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
      len(list_filter(regexp_extract_all({_T}, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone FROM documents""",
    "base_op2_secrets": rf"""SELECT doc_id, len(list_filter(regexp_extract_all({_T}, '(?i:password|passwd|secret|token|api_?key)["'']?[ ]*[:=][ ]*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
      len(list_filter(regexp_extract_all({_T}, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all({_T}, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM documents""",
    "base_op3_quality": rf"""WITH w AS (SELECT doc_id, {_T} AS t, {_WORDS} AS w, list_filter(string_split({_T}, chr(10)), lambda l: regexp_matches(l, '{_W}')) AS l FROM documents),
      g AS (SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 2, 0)), lambda i: struct_pack(i := i, g := array_to_string(w[i + 1:i + 3], ' ')))) AS x FROM w),
      r AS (SELECT doc_id, x.i AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x.g) AS n FROM g) WHERE n > 1), c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) t(k) GROUP BY doc_id)
      SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
      len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN c USING (doc_id)""",
    "base_op7_mixing": rf"SELECT doc_id, len({_WORDS}) AS size, sum(len({_WORDS})) OVER (PARTITION BY source) AS source_size FROM documents",
    "base_op10_sharding": f"WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, octet_length(encode({_T})) + 16 AS size, 'rows' AS law, CAST(NULL AS INT) AS grown_shard FROM documents",
    "base_op10_shard_sizes": "WITH n AS (SELECT count(*) AS n FROM documents) SELECT CAST(i AS INT) AS shard, n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END AS rows, n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END - 1 AS last_slot FROM n, range(40) t(i) WHERE n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END > 0",
}


def _columns(query: Callable[[SparkSession, str], DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, sf_dir).select(*names)


def _shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = op10_sharding(spark, sf_dir).groupBy("shard")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.max("slot").alias("last_slot"))


QUERIES = {
    "base_op1_pii": _columns(op1_pii, "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "base_op2_secrets": _columns(op2_secrets, "doc_id", "n_assign", "n_access", "n_hex"),
    "base_op3_quality": _columns(op3_quality, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "base_op7_mixing": _columns(op7_mixing, "doc_id", "size", "source_size"),
    "base_op10_sharding": _columns(op10_sharding, "doc_id", "size", "law", "grown_shard"),
    "base_op10_shard_sizes": _shard_sizes,
}
