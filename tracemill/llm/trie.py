"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns. It is known by 128 bits: the exclusive or of a hash of each turn and its
place, so that every conversation names its own nodes by a running exclusive or, and a node its parent by taking off
its last turn. The child with most members continues its parent's path, so each path ends at a leaf, and the leaf's
least member walks it from end to end: the path's array is a stretch of that conversation's turns. Totals of subtrees
are suffix sums along these arrays; paths that begin as lighter children hand theirs to their parents, deepest first.
As a lighter child has half its parent's members at most, there are as many rounds as the logarithm of the members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, settle, word_count
from .order import PART, looked_up, numbered, running

KEY = ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, x1, x2, words, PART): the turns of each conversation, from place 1; x1 and x2 stand for role and text.

    By turn, null first; turns that tie go by role, then by a hash of role and text. Null roles and texts are empty. Rows
    without conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Texts are hashed
    where they are read and do not travel.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), digest.alias("digest"), word_count(text).alias("words")
    )
    rows = rows.select("conv_id", "turn", "role", *[F.xxhash64(F.lit(i), "digest").alias(f"x{i}") for i in (1, 2)], "words")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("x1"), F.asc("x2"), F.asc("tie")]
    placed = numbered(rows, ["conv_id"], order, "place")
    return settle(placed.select("conv_id", (F.col("place") + 1).alias("place"), "x1", "x2", "words", PART))


def conversations_of(placed: DataFrame) -> DataFrame:
    """(conv_id, n, PART): each conversation's number of turns and the first range that holds some."""
    return placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min(PART).alias(PART))


def _prefixes(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, q1, q2, words, PART): each conversation's nodes from depth 0 on; q1, q2: of the parent."""
    own = [F.xxhash64(F.lit(10 + i), "place", "x1", "x2").alias(f"h{i}") for i in (1, 2)]
    rows = placed.select("conv_id", F.col("place").alias("depth"), *own, "words", PART)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("words"), PART)
    keyed = running(rows.unionByName(roots), "conv_id", "depth", {f"k{i}": ("xor", F.col(f"h{i}")) for i in (1, 2)})
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"q{i}") for i in (1, 2)]
    return settle(keyed.select("conv_id", *KEY, *parents, "words", PART))


def _nodes(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, smallest, n_convs, words, n_children, heavy): heavy is whether the node continues its parent's path."""
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("smallest"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("q1", "q2", "words")]
    )
    found = settle(found)
    parents = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("p0"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    parents = settle(parents.agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "k1", "k2")).alias("most")))
    heavy = parents.select((F.col("p0") + 1).alias("h0"), F.col("most.k1").alias("h1"), F.col("most.k2").alias("h2"), F.lit(True).alias("heavy"))
    out = found.join(parents.drop("most"), [F.col(a) == F.col(b) for a, b in zip(KEY, ("p0", "p1", "p2"))], "left")
    out = out.join(heavy, [F.col(a) == F.col(b) for a, b in zip(KEY, ("h0", "h1", "h2"))], "left")
    columns = [F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy")]
    return settle(out.select(*KEY, "smallest", "n_convs", "words", *columns))


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) to (depth, k1, k2, first, ids): at most so many ids of a node, comma-joined."""
    key, ids = None, []
    for batch in batches:
        out = []
        for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if node != key or len(ids) == most:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = node, []
            ids.append(conv)
        yield _rows(out)
    if ids:
        yield _rows([(*key, ids[0], ",".join(map(str, ids)))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [*KEY, "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to (depth, k1, k2, first, ids), ids the SHA-256 of the node's list; a list is read chunk by chunk."""
    key = state = None
    for batch in batches:
        out = []
        for *node, first, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != key:
                if state is not None:
                    out.append((*key, 0, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(out)
    if state is not None:
        yield _rows([(*key, 0, state.hexdigest())])


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes where conversations end.

    The members are range-sorted and joined in chunks first, so a node where very many end is shared out; its chunks
    are then hashed in their order as a stream, for SHA-256 has no other way.
    """
    kind = "depth long, k1 long, k2 long, first long, ids string"
    ends = settle(rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("end.*", "conv_id"))
    chunks = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_chunks, kind)
    hashed = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashes, kind)
    return hashed.select(*KEY, F.col("ids").alias("ends_sha256"))


def trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of the conversations in placed (conv_id, place, x1, x2, words, PART), as `turns`
    makes it, and convs (conv_id, PART), which has the conversations without turns too; both settled.

    conv_id: smallest member; depth; parent_conv_id, null at the root; n_convs; n_children; n_leaves: childless nodes in
    the subtree, itself included; saved_tokens: over the subtree, words of the node's last turn times its members but
    one; ends_sha256: of the comma-joined ids of the members that end there. No conversations: no nodes.
    """
    spark = placed.sparkSession
    folder = f"{checkpoint_folder(spark)}/trie-{uuid4().hex}"
    rows = _prefixes(placed, convs)
    nodes = _nodes(rows)
    # each leaf's least member walks the leaf's path and what lies above it
    leaves = nodes.filter("n_children = 0").select(F.col("smallest").alias("conv_id"), F.lit(True).alias("walks"))
    lengths = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows")).join(leaves, "conv_id", "left")
    walked = looked_up(rows, settle(lengths), ["conv_id"], "n_rows").filter("walks").drop("n_rows", "walks", "words")
    walked = settle(looked_up(settle(walked), nodes, KEY, "n_convs"))
    light = F.when(F.col("heavy"), 0).otherwise(1)
    # least members only grow with depth, so the greatest one above a node is its parent's
    walked = running(walked, "conv_id", "depth", {"lights": ("sum", light), "parent": ("max", F.col("smallest"))}, before_it=True)
    walked = settle(walked.withColumn("light", (F.col("lights") + light).cast("int")).drop("lights"))
    below = running(walked, "conv_id", "depth", {"after": ("sum", light)}, down=True, before_it=True)
    paths = below.filter("after = 0").drop("after")
    paths.write.partitionBy("light").parquet(f"{folder}/paths")
    own = _gathered(spark, folder, walked.agg(F.max("light")).first()[0] or 0)
    out = own.join(_ends(rows), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("smallest").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _gathered(spark: SparkSession, folder: str, deepest: int) -> DataFrame:
    """The rows of all paths with the totals of their subtrees: suffix sums, paths under most lighter children first."""
    done = None
    for light in range(deepest, 0, -1):
        own = spark.read.parquet(f"{folder}/paths/light={light}")
        own = own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
        if done is not None:
            heads = done.filter(~F.col("heavy"))
            hung = heads.groupBy((F.col("depth") - 1).alias("p0"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
            hung = hung.agg(F.sum("n_leaves").alias("p_leaves"), F.sum("saved_tokens").alias("p_saved"))
            own = own.join(hung, [F.col(a) == F.col(b) for a, b in zip(KEY, ("p0", "p1", "p2"))], "left").withColumns(
                {"n_leaves": F.col("n_leaves") + F.coalesce("p_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("p_saved", F.lit(0))}
            )
            own = own.drop("p0", "p1", "p2", "p_leaves", "p_saved")
        totals = {c: ("sum", F.col(f"own_{c}")) for c in ("n_leaves", "saved_tokens")}
        own = settle(own.withColumnsRenamed({c: f"own_{c}" for c in totals}))
        running(own, "conv_id", "depth", totals, down=True).write.parquet(f"{folder}/done/light={light}")
        done = spark.read.parquet(f"{folder}/done/light={light}")
    if done is None:
        schema = "conv_id long, depth long, k1 long, k2 long, smallest long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long"
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder}/done")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are, as `trie` gives it; rows as `turns` reads them."""
    placed = turns(conversations)
    return trie(placed, settle(conversations_of(placed)))


def with_shared_heads(placed: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with its first h turns replaced by those of conversation c - c % every, h = crc32(c) % most.

    All of that one's turns if it has fewer than h, none if it is absent. Returns what `trie` takes.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    convs = settle(conversations_of(placed))
    first = placed.filter((F.col("conv_id") % every == 0) & (F.col("place") < most))
    heads = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "x1", "x2", "words"))).alias("head"))
    heads = heads.select(F.col("conv_id").alias("__base"), "head")  # fewer than `most` turns, and at most `every` who share them
    known = convs.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("__base"), "left").drop("__base")
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<place:bigint,x1:bigint,x2:bigint,words:bigint>>")), lambda t: t["place"] <= F.col("h"))
    known = settle(known.withColumn("head", head).withColumn("short", F.col("h") - F.size("head")))
    shared = known.select("conv_id", PART, F.explode("head").alias("t")).select("conv_id", "t.*", PART)
    own = placed.filter(F.col("place") > h)
    moved = looked_up(own, known.select("conv_id", "short", "n"), ["conv_id"], "n")
    moved = moved.withColumn("place", F.col("place") - F.col("short")).drop("short", "n")
    return settle(moved.unionByName(shared)), known.select("conv_id", PART)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of the trie of conversations with shared heads; rows as `turns` reads them, columns as `trie` has them."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(*with_shared_heads(turns(conversations)))
