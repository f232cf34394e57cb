"""Writers: JSON arrays and lines, appended units, versions, CSV, and reports as Markdown.

Everything but a report is committed as a whole by Spark, so a lost executor or a second run leaves no half file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions.text import trimmed
from tracemill.operators.common import ranked


def write_json_array(rows: DataFrame, path: str, order: str) -> None:
    """A folder of JSON arrays, `part=<n>` in the order of the rows, each a range of it and an array of its own; n has
    leading zeros, as readers go by path.

    No task holds more than its range, and an element stands on a line, so that read_json_array can split the files.
    Order has to be without ties. Empty input: an empty folder, which reads as no rows.
    """
    part, at = Window.partitionBy("part"), Window.partitionBy("part").orderBy(order)
    ranged = rows.repartitionByRange(order).withColumn("part", F.format_string("%010d", F.spark_partition_id()))
    line = F.concat(
        F.when(F.row_number().over(at) == 1, "[").otherwise(","),
        F.to_json(F.struct(*rows.columns)),
        F.when(F.row_number().over(at) == F.count(F.lit(1)).over(part), "]").otherwise(""),
    )
    lines = ranged.select("part", F.col(order).alias("__order"), line.alias("value")).sortWithinPartitions("part", "__order")
    lines.drop("__order").write.mode("overwrite").partitionBy("part").text(path)


def write_documents(rows: DataFrame, path: str, order: str, field: str = "rows", most: int = 1000, **facts: str) -> None:
    """JSON documents, one a line, of `most` rows by order in a field, beside facts that are the same in all; `first` is
    the place of the document's first row."""
    placed = ranked(rows, [F.col(order)], "__rank")
    own = F.struct("__rank", *rows.columns)
    docs = placed.groupBy(F.floor(F.col("__rank") / most).alias("__doc")).agg(F.sort_array(F.collect_list(own)).alias(field))
    listed = F.transform(field, lambda r: F.struct(*[r[c].alias(c) for c in rows.columns])).alias(field)
    docs.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in facts.items()], (F.col("__doc") * most).alias("first"), listed)).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Finished units beside those that are there."""
    rows.write.mode("append").json(path)


def checkpoint_batch(rows: DataFrame, path: str) -> None:
    """All rows so far in place of those written before."""
    rows.write.mode("overwrite").parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def replace_keeping_first(rows: DataFrame, path: str) -> None:
    """rows at path; what was there before the first replacement stays at path.original for good.

    The new rows are complete before the old ones go.
    """
    spark = rows.sparkSession
    fs, at = _file_system(spark, path)
    new, kept = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "original"))
    rows.write.mode("overwrite").parquet(new.toString())
    if fs.exists(at):
        if fs.exists(kept):
            fs.delete(at, True)
        else:
            fs.rename(at, kept)
    fs.rename(new, at)


def fixed(value: Column, decimals: int) -> Column:
    """A double with so many digits behind the point, rounded by its exact binary value as C's printf does, exact halves to
    the even digit. format_string rounds the shortest decimal that reads as the double, which can be a half when the
    double is none. Null stays null."""
    shown = F.call_function("format_number", value, F.lit("0." + "0" * decimals if decimals else "0"))
    return F.when(F.abs(value) == float("inf"), value.cast("string")).otherwise(shown)


def write_csv(rows: DataFrame, path: str, decimals: int | None = None) -> None:
    """With a header; decimals: doubles with so many digits behind the point. Nulls are empty fields."""
    kinds = dict(rows.dtypes)
    shown = [fixed(F.col(c), decimals).alias(c) if decimals is not None and kinds[c] == "double" else F.col(c) for c in rows.columns]
    rows.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def cell(value: Column, pattern: str | None = None) -> Column:
    """A table cell; null is a dash."""
    text = F.format_string(pattern, value) if pattern else value.cast("string")
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("—"))


def markdown_lines(rows: DataFrame, columns: dict[str, str | None], order: list[Column]) -> DataFrame:
    """(place, line): a Markdown table; columns: name -> printf pattern or None. A report's rows are few."""
    shown = [cell(F.col(c), p) for c, p in columns.items()]
    body = ranked(rows, order, "__rank").select((F.col("__rank") + 2).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "| " + " | ".join("---" for _ in columns) + " |")]
    return rows.sparkSession.createDataFrame(head, "place long, line string").unionByName(body)


def example_sheet(rows: DataFrame, title: str, text: str) -> DataFrame:
    """(title, sheet): long texts by their beginning and end."""
    return rows.select(title, F.concat(F.lit("## "), F.col(title).cast("string"), F.lit("\n\n"), trimmed(F.col(text))).alias("sheet"))


def summary_line(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One JSON line that marks a finished run and sums it up."""
    return rows.agg(*[v.alias(k) for k, v in values.items()]).select(F.to_json(F.struct(*values)).alias("summary"))


def sidecar_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: rows compared and, for each field, how many values would change. The dry run of an update."""
    other = new.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = old.join(other, F.col(key) == F.col("__k"))
    return both.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f) for f in fields])
