"""Readers of run files: JSON arrays, JSON lines that may be torn, folders whose paths hold columns, shards, settings.

All paths are Spark's, so any file system that Spark reads will do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.common import asserted, ranked


_KEY = re.compile(r"[^'\"\[{][^:]*:(?: |$)|-(?: |$)")


def with_place(rows: DataFrame) -> DataFrame:
    """rows of a file scan with `place`, which rises along each file and from file to file by path."""
    block = F.col("_metadata.file_block_start").alias("block")
    return rows.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), block, F.monotonically_increasing_id().alias("row")))


def read_json_array(spark: SparkSession, path: str, schema: str, by_line: bool = True) -> DataFrame:
    """Rows of files that are JSON arrays, with idx, their place in all files by path.

    by_line: each element stands on a line, as write_json_array has it; files are split like any text. Otherwise each file
    is read whole by one task, which arrays of any other layout need.
    """
    kind = T.StructType.fromDDL(schema)
    if not by_line:
        whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        rows = whole.select("file", F.posexplode(F.from_json("value", T.ArrayType(kind))).alias("at", "__r"))
        return ranked(rows, [F.col("file"), F.col("at")], "idx").select("idx", "__r.*")
    lines = with_place(spark.read.text(path)).select("place", F.regexp_replace(F.trim("value"), r"^[\[,]\s*|[\],]\s*$", "").alias("value"))
    # what is left of an element's closing bracket belongs to it; only the array's own have been taken off
    rows = lines.filter("value != ''").select("place", F.from_json("value", kind).alias("__r"))
    return ranked(rows, [F.col("place")], "idx").select("idx", "__r.*")


def read_document_rows(spark: SparkSession, path: str, schema: str, field: str = "rows") -> DataFrame:
    """The rows that JSON documents, one a line, hold in a field, with idx: their place, behind the document's `first`."""
    kind = T.StructType.fromDDL(f"first long, {field} array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in T.StructType.fromDDL(schema))}>>")
    docs = spark.read.text(path).select(F.from_json("value", kind).alias("d"))
    rows = docs.select(F.coalesce("d.first", F.lit(0)).alias("first"), F.posexplode(f"d.{field}").alias("at", "__r"))
    return rows.select((F.col("first") + F.col("at")).alias("idx"), "__r.*")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str, corrupt: str | None = None) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. corrupt: a column for lines that cannot be parsed, null for others;
    without it they are left out, and torn_lines counts them."""
    name = corrupt or "__corrupt"
    full = T.StructType.fromDDL(schema).add(name, "string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": name}).alias("r"), "value")
    rows = parsed.select("r.*")
    return rows if corrupt else rows.filter(F.col(name).isNull()).drop(name)


def torn_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One row: lines in all and lines that cannot be parsed."""
    rows = read_json_lines(spark, path, schema, "__torn")
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.count("__torn").alias("torn"))


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with the same key the last by order; `place` as the last of them decides among equals, by file and line."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("__r")).select("__r.*")


def shard_ranges(rows: DataFrame, index: str) -> DataFrame:
    """(file, n, first, last): each shard's number of rows, least and greatest index; rows has to be a file scan."""
    file = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return rows.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"))


def resumed(spark: SparkSession, path: str, jobs: DataFrame, key: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(done, pending): the good lines of a cache that may be torn, one for each key, and the jobs that it lacks."""
    done = read_json_lines(spark, path, schema).dropDuplicates([key])
    return done, jobs.join(done.select(key), key, "left_anti")


def prefix_resumed(jobs: DataFrame, place: str, done: int) -> DataFrame:
    """The jobs behind the first `done` places, which an ordered cache holds."""
    return jobs.filter(F.col(place) >= done)


def with_path_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds the last folders of each row's file as columns, e.g. condition, model and benchmark; and file, its name.

    Rows whose path is too shallow for all of them have null in the first ones. rows has to be a file scan.
    """
    parts = F.split("_metadata.file_path", "/")
    n = len(names)
    columns = {name: F.try_element_at(parts, F.lit(i - n - 1)) for i, name in enumerate(names)}
    return rows.withColumns(columns | {"file": F.element_at(parts, -1)})


def name_parameters(file: Column) -> dict[str, Column]:
    """temperature, k, start and end from names like t0.7_k4_s0_e100.jsonl; null where the name has none."""
    part = lambda p, kind: F.nullif(F.regexp_extract(file, p, 1), F.lit("")).try_cast(kind)
    return {
        "temperature": part(r"(?:^|_)t([0-9.]+?)(?=_|\.jsonl?$)", "double"),
        "k": part(r"_k([0-9]+)", "int"),
        "start": part(r"_s([0-9]+)", "int"),
        "end": part(r"_e([0-9]+)", "int"),
    }


def is_greedy(file: Column) -> Column:
    """Names of runs at temperature 0 with one try."""
    return F.contains(file, F.lit("t0.0_k1_"))


def first_file(rows: DataFrame, by: list[str], file: str = "file") -> DataFrame:
    """Of each combination of columns the rows of its first file by name."""
    first = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(file).alias("__first"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(file) == F.col("__first")]
    return rows.join(first, on).drop("__first", *[f"__{c}" for c in by])


def read_shards(spark: SparkSession, paths: list[str], schema: str, key: str, tries: str) -> DataFrame:
    """One row a key: the tries of all shards of it, in order of file, then of place within it."""
    full = T.StructType.fromDDL(schema)
    rows = spark.read.schema(full).json(paths).select("*", F.col("_metadata.file_path").alias("__file"))
    each = rows.select(key, "__file", F.posexplode(tries).alias("__at", "__try"))
    merged = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__file", "__at", "__try"))).alias("__all"))
    return merged.select(key, F.transform("__all", lambda x: x["__try"]).alias(tries))


def with_sidecar(spark: SparkSession, records: str, meta: str, record_schema: str, meta_schema: str) -> DataFrame:
    """The rows of a JSON array and of the one beside it, by place; fails if one is longer."""
    a, b = read_json_array(spark, records, record_schema), read_json_array(spark, meta, meta_schema)
    other = b.select(F.col("idx").alias("__idx"), *[c for c in b.columns if c != "idx"])
    both = a.join(other, F.col("idx") == F.col("__idx"), "full_outer")
    return asserted(both, F.col("idx").isNotNull() & F.col("__idx").isNotNull(), "records and descriptions differ in number").drop("__idx")


def read_dataset(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A published data set as Parquet, its columns renamed {new: old}."""
    return spark.read.parquet(path).select(*[F.col(old).alias(new) for new, old in columns.items()])


def read_settings(text: str) -> dict:
    """Nested settings from YAML of maps and lists, of plain values or of maps and lists again; settings are small, so on
    the driver. Anchors, tags, blocks of text and several documents are not read."""
    lines = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if line.strip() and not line.lstrip().startswith("#"):
            lines.append((len(line) - len(line.lstrip()), line.strip()))
    return _node(lines, 0)[0] if lines else {}


def _node(lines: list[tuple[int, str]], at: int):
    """The map or list that begins at a line, and the line behind it; all its entries stand as deep as the first."""
    depth, out = lines[at][0], [] if lines[at][1].startswith("-") else {}
    while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("-") == isinstance(out, list):
        body = lines[at][1]
        if isinstance(out, list):
            rest = body[1:].strip()
            if not rest or _KEY.match(rest):  # a map or list that may begin on this line
                inner = depth + len(body) - len(rest) if rest else depth
                lines[at : at + 1] = [(inner, rest)] if rest else []
                value, at = _node(lines, at) if at < len(lines) and lines[at][0] > depth else (None, at)
            else:
                value, at = _plain(rest), at + 1
            out.append(value)
            continue
        name, _, rest = body.partition(":")
        at += 1
        if rest.strip():
            out[_plain(name.strip())] = _plain(rest.strip())
        elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("-"))):
            out[_plain(name.strip())], at = _node(lines, at)
        else:
            out[_plain(name.strip())] = None
    return out, at


def _plain(value: str):
    if value[:1] in "'\"" and value[-1:] == value[:1]:
        return value[1:-1]
    if value.startswith("[") and value.endswith("]"):
        return [_plain(v.strip()) for v in value[1:-1].split(",") if v.strip()]
    if value in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(value)
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value
