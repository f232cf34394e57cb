"""Merkle manifest of a data set: trees by group, their roots in one tree, and what each row needs to prove itself.

Levels are built by windows: a partition is a group and a parent's number, and the ordered list of the whole frame is
both the parent's input and each node's siblings. One row a parent goes on to the next level, so all levels together
have two rows for each first one. A leaf's way to the root is then put together from bands of levels: all nodes of
`arity ** band` leaves are one bounded row, to which the way above it is joined once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, settle
from .order import numbered


def digest(*columns: Column | str) -> Column:
    """Each value as `length in bytes:value`, `-` for null, all joined and hashed: lower-case hex of SHA-256."""

    def field(value):
        s = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[field(F.col(c) if isinstance(c, str) else c) for c in columns]), 256)


def _levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of the levels over nodes (grp, idx, hash, row), the first one's first, and (grp, hash, height) of the roots.

    left and right are the siblings before and after a node, joined; `alone` marks a group's root.
    """
    most = nodes.agg(F.max("idx")).first()[0]
    if most is None:
        return [], None
    run = Window.partitionBy("grp", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.col("idx") % arity).cast("int")
    levels, here, n = [], nodes, most + 1
    while True:
        placed = here.withColumn("up", F.expr(f"idx div {arity}")).withColumn("run", F.collect_list("hash").over(run))
        placed = placed.withColumn("alone", (F.col("idx") == 0) & (F.size("run") == 1)).withColumns(
            {
                "left": F.concat_ws("", F.slice("run", F.lit(1), at)),
                "right": F.concat_ws("", F.slice("run", at + 2, F.size("run"))),
                "parent": F.sha2(F.concat_ws("", "run"), 256),
            }
        )
        levels.append(settle(placed.drop("run")))
        if n == 1:
            break
        parents = levels[-1].filter(~F.col("alone") & (F.col("idx") % arity == 0))
        here, n = parents.select("grp", F.col("up").alias("idx"), F.col("parent").alias("hash")), -(-n // arity)
    roots = None
    for height, level in enumerate(levels):
        found = level.filter("alone").select("grp", "hash", F.lit(height).alias("height"))
        roots = found if roots is None else roots.unionByName(found)
    return levels, settle(roots)


def _ways(levels: list[DataFrame], tops: DataFrame, arity: int, band: int, result: Callable[[Column], Column]) -> DataFrame:
    """A row for each first node: result() of a struct of its idx, hash, row, subroot and way, an array of (left, right).

    tops: (grp, height, subroot, way) with the way from each group's root on.
    """
    above = None
    for base in range((len(levels) - 1) // band * band, -1, -band):
        own = levels[base : base + band]
        reach = (F.col("height") > base) & (F.col("height") <= base + band) | (F.col("height") == 0) & F.lit(base == 0)
        upper = tops.filter(reach).select("grp", F.lit(0).cast("long").alias("block"), "subroot", "way")
        if above is not None:
            upper = upper.unionByName(above.select("grp", F.col("idx").alias("block"), "subroot", "way"))
        entries = None
        for k, level in enumerate(own):
            step = F.struct("idx", F.when(~F.col("alone"), F.col("left")).alias("left"), F.when(~F.col("alone"), F.col("right")).alias("right"))
            first = F.struct("idx", "hash", *(["row"] if base == 0 else [])) if k == 0 else F.lit(None)
            shown = level if k == 0 and base == 0 else level.filter(~F.col("alone"))
            shown = shown.select("grp", F.expr(f"idx div {arity ** (band - k)}").alias("block"), F.lit(k).alias("k"), step.alias("step"), first.alias("first"))
            entries = shown if entries is None else entries.unionByName(shown)
        blocks = entries.groupBy("grp", "block").agg(
            F.sort_array(F.collect_list("first")).alias("nodes"),
            *[F.sort_array(F.collect_list(F.when(F.col("k") == k, F.col("step")))).alias(f"steps{k}") for k in range(len(own))],
        )
        joined = blocks.join(upper.withColumnsRenamed({"grp": "__g", "block": "__b"}), (F.col("grp") == F.col("__g")) & (F.col("block") == F.col("__b")))

        def way_of(x: Column) -> Column:
            within = x["idx"] - F.col("block") * arity**band
            steps = [F.get(f"steps{k}", F.floor(within / arity**k).cast("int")) for k in range(len(own))]
            passed = F.filter(F.array(*steps), lambda s: s["left"].isNotNull())
            return F.concat(F.transform(passed, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"))), F.col("way"))

        def node_of(x: Column) -> Column:
            row = [x["row"].alias("row")] if base == 0 else []
            return F.struct(x["idx"].alias("idx"), x["hash"].alias("hash"), *row, F.col("subroot").alias("subroot"), way_of(x).alias("way"))

        found = joined.select("grp", F.transform("nodes", node_of).alias("nodes"))
        if base:
            above = found.select("grp", F.explode("nodes").alias("n")).select("grp", "n.idx", "n.subroot", "n.way")
    return found.select(F.explode(F.transform("nodes", result)).alias("n")).select("n.*")


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(way, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(way: Column) -> Column:
    """All siblings on the way, level by level and left to right, joined."""
    return F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, group: str, order: str, leaf: str, arity: int = 2, band: int = 8, result: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """A row for each row of `rows`: its columns but for the group, subroot, root and way, or what result(node, root) makes.

    leaf names the column of leaf digests. Leaves of a group stand by `order`, ascending, null first; ties by digest, and
    what is alike in both is alike in the tree. While a group has several nodes, each run of `arity` becomes the digest
    of its digests joined, the last run of fewer too. Groups' roots, by group, null first, bytewise, give the root
    likewise. Null groups are a group. Empty input: no rows. A node given to result has row, hash, subroot and way.
    """
    kept = [c for c in rows.columns if c != group]
    result = result or (lambda n, root: F.struct(*[n["row"][c].alias(c) for c in kept], n["subroot"].alias("subroot"), F.lit(root).alias("root"), n["way"].alias("way")))
    grp = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("-"))  # in the order of the groups, null first
    leaves = settle(rows.select(grp.alias("grp"), F.col(order).alias("at"), F.col(leaf).alias("hash"), F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("tie")))
    placed = numbered(leaves, ["grp"], [F.asc_nulls_first("at"), F.asc("hash"), F.asc("tie")], "idx")
    placed = settle(placed.select("grp", "idx", "hash", "row"))
    levels, roots = _levels(placed, arity)
    if roots is None:
        nodes = placed.select(F.struct("row", "hash", F.lit("").alias("subroot"), F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).alias("way")).alias("n"))
        return nodes.select(result(F.col("n"), "").alias("n")).select("n.*")
    groups = numbered(roots, [], [F.asc("grp")], "idx").select(F.lit("").alias("grp"), "idx", "hash", F.struct("grp", "height").alias("row"))
    upper, root_of = _levels(settle(groups), arity)
    root = root_of.first()["hash"]
    end = root_of.select("grp", "height", F.col("hash").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("way"))
    tops = _ways(upper, end, arity, band, lambda n: F.struct(n["row"]["grp"].alias("grp"), n["row"]["height"].alias("height"), n["hash"].alias("subroot"), n["way"].alias("way")))
    return _ways(levels, settle(tops), arity, band, lambda n: result(n, root))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `manifest` defines it; ids, languages and texts may be null or repeated."""
    docs = documents(spark, sf_dir)
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = ["doc_id", "source", "lang"]
    rows = docs.select(
        "doc_id",
        "lang",
        digest(*fields, "n_chars", "text").alias("leaf"),
        F.when(forged & F.col("n_chars").isNotNull(), digest(*fields, F.col("n_chars") + 1, F.col("text"))).alias("forged"),
    )

    def result(node: Column, root: str) -> Column:
        folded = fold(F.coalesce(node["row"]["forged"], node["hash"]), node["way"])
        return F.struct(
            node["row"]["doc_id"].alias("doc_id"),
            node["hash"].alias("leaf"),
            node["subroot"].alias("subroot"),
            F.lit(root).alias("root"),
            F.sha2(proof(node["way"]), 256).alias("proof_sha256"),
            folded.alias("folded_root"),
        )

    return manifest(rows, "lang", "doc_id", "leaf", result=result).withColumn("verified", F.col("folded_root") == F.col("root"))
