"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length one and cosine c are sqrt(2 - 2c) apart; that is epsilon. They are sorted by the cells, one epsilon
wide, that they fall into along the leading principal axes, and cut into blocks of the sequence. Blocks are the leaves of a
tree of intervals, each known by its box along the axes and a ball around its mean. Pairs of intervals are followed from
the top: boxes farther apart than epsilon hold no link, balls that fit into epsilon hold nothing but links, which are
counted without a look at the vectors; what is left goes down to pairs of blocks, where it is done once more with
parts of blocks before products are taken. Axes only steer the work: any will do, for they never lengthen a distance.

No pair is written out: tasks return each vector's number of links and one edge a vector that keeps what is connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .components import components
from .order import numbered

#: Distance between vectors of other lengths, which never link.
APART = 10.0
#: What rounding may add to a distance.
SLACK = 1e-6


class Space:
    """Axes, bounds and sizes, as the tasks need them; vectors stand as the bytes of `kind`."""

    def __init__(self, cosine: float, kind: str, longest: int, axes: np.ndarray, block: int, part: int):
        self.cosine, self.kind, self.longest, self.axes, self.block, self.part = cosine, kind, longest, axes, block, part
        self.epsilon = math.sqrt(2 - 2 * cosine)
        self.balls = longest <= 1024
        self.wide = len(axes) + 1
        self.loose = max(1e-4, longest * 2.4e-7)

    def unit(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of length one, filled up with zeros, and their numbers of components."""
        dims = np.array([len(x) for x in raw], np.int64) // np.dtype(self.kind).itemsize
        if len(raw) and (dims == dims[0]).all():
            out = np.frombuffer(b"".join(raw), self.kind).reshape(len(raw), -1).astype(np.float64)
        else:
            out = np.zeros((len(raw), dims.max(initial=0)))
            for row, x, n in zip(out, raw, dims):
                row[:n] = np.frombuffer(x, self.kind)
        if len(raw):
            out /= np.abs(out).max(axis=1, keepdims=True)
            out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out, dims

    def places(self, unit: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Coordinates along the axes, before them one that keeps lengths apart."""
        n = min(unit.shape[1], self.axes.shape[1])
        return np.column_stack([dims * APART, unit[:, :n] @ self.axes[:, :n].T])

    def stat(self, unit: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Number, box and ball of some vectors in one row."""
        at = self.places(unit, dims)
        center, radius = np.zeros(0), math.inf
        if self.balls:
            full = np.zeros((len(unit), self.longest + 1))
            full[:, 0], full[:, 1 : 1 + unit.shape[1]] = dims * APART, unit
            center = full.mean(axis=0)
            radius = math.sqrt(((full - center) ** 2).sum(axis=1).max())
        return np.concatenate([[len(unit), radius], at.min(axis=0), at.max(axis=0), center])

    def merged(self, stats: np.ndarray) -> np.ndarray:
        w = self.wide
        center, radius = np.zeros(0), math.inf
        if self.balls:
            centers = stats[:, 2 + 2 * w :]
            center = np.average(centers, axis=0, weights=stats[:, 0])
            radius = (np.sqrt(((centers - center) ** 2).sum(axis=1)) + stats[:, 1]).max()
        return np.concatenate([[stats[:, 0].sum(), radius], stats[:, 2 : 2 + w].min(axis=0), stats[:, 2 + w : 2 + 2 * w].max(axis=0), center])

    def bounds(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of a with each of b: whether they may hold links, whether they hold nothing else."""
        w = self.wide
        low_a, high_a, low_b, high_b = a[:, None, 2 : 2 + w], a[:, None, 2 + w : 2 + 2 * w], b[None, :, 2 : 2 + w], b[None, :, 2 + w : 2 + 2 * w]
        gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
        near = np.sqrt((gap * gap).sum(axis=2)) <= self.epsilon + SLACK
        if not self.balls:
            return near, np.zeros_like(near)
        ca, cb = a[:, None, 2 + 2 * w :], b[None, :, 2 + 2 * w :]
        far = np.sqrt(((ca - cb) ** 2).sum(axis=2)) + a[:, None, 1] + b[None, :, 1]
        return near, near & (far <= self.epsilon - SLACK)

    def hits(self, a: np.ndarray, b: np.ndarray, a32: np.ndarray, b32: np.ndarray, same: np.ndarray | None) -> np.ndarray | None:
        """Which pairs reach the cosine: by single precision where that settles it, else by double; None if none does."""
        near = a32 @ b32.T
        if near.max(initial=-1) < self.cosine - self.loose:
            return None
        found = near >= self.cosine + self.loose
        i, j = np.nonzero((near >= self.cosine - self.loose) & ~found)
        for s in range(0, len(i), 65536):
            k, l = i[s : s + 65536], j[s : s + 65536]
            found[k, l] = (a[k] * b[l]).sum(axis=1) >= self.cosine
        return found if same is None else found & same


def joined(space: Space, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links and a label of each vector of one block with itself, or of two blocks with each other (one after the other).

    Vectors that the links connect share the label, the least number among them.
    """
    two = len(sides) == 2
    cut = [[(s, min(s + space.part, len(u))) for s in range(0, len(u), space.part)] for u, _ in sides]
    stats = [np.array([space.stat(u[s:e], d[s:e]) for s, e in c]) for (u, d), c in zip(sides, cut)]
    single = [u.astype(np.float32) for u, _ in sides]
    (ua, da), (ub, db) = sides[0], sides[-1]
    width = max(ua.shape[1], ub.shape[1])
    if ua.shape[1] != ub.shape[1]:
        ua, ub = (np.pad(u, ((0, 0), (0, width - u.shape[1]))) for u in (ua, ub))
        single = [ua.astype(np.float32), ub.astype(np.float32)]
    mixed = len(np.unique(np.concatenate([da, db]))) > 1
    shift = len(ua) if two else 0
    links, label = np.zeros(shift + len(ub), np.int64), np.arange(shift + len(ub))

    def unite(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal label
        while True:
            x, y = label[u], label[v]
            open_ = x != y
            if not open_.any():
                return
            u, v, x, y = u[open_], v[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]

    near, whole = space.bounds(stats[0], stats[-1])
    for p, q in zip(*np.nonzero(near)):
        if not two and p > q:
            continue
        (s, e), (f, g) = cut[0][p], cut[-1][q]
        own = not two and p == q
        if whole[p, q]:
            links[s:e] += g - f - own
            if not own:
                links[shift + f : shift + g] += e - s
            ends = np.concatenate([np.arange(s, e), np.arange(shift + f, shift + g)])
            unite(ends, np.full(len(ends), s))
            continue
        same = da[s:e, None] == db[None, f:g] if mixed else None
        found = space.hits(ua[s:e], ub[f:g], single[0][s:e], single[-1][f:g], same)
        if found is None:
            continue
        if own:
            np.fill_diagonal(found, False)
        links[s:e] += found.sum(axis=1)
        if not own:
            links[shift + f : shift + g] += found.sum(axis=0)
        i, j = np.nonzero(found)
        unite(s + i, shift + f + j)
    return links, label


def _axes(vectors: DataFrame, sample: int, most: int) -> np.ndarray:
    """The leading principal axes of at most `sample` vectors, those of the least hashes, over their first 1024 components."""
    few = vectors.select(F.slice("embedding", 1, 1024).alias("v")).orderBy(F.xxhash64("v")).limit(sample).collect()
    n = max((len(r["v"]) for r in few), default=1)
    x = np.zeros((len(few) or 1, n))
    for row, r in zip(x, few):
        row[: len(r["v"])] = r["v"]
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(n, n))
    return np.ascontiguousarray(axes[:, ::-1][:, :most].T)


def _placed(vectors: DataFrame, space: Space) -> DataFrame:
    """vectors with their cells, one epsilon wide and a sixteenth of it, along the axes, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, space.kind).tobytes() for v in batch.column(1).to_pylist()]
            unit, dims = space.unit(raw)
            at = space.places(unit, dims)[:, 1:] / space.epsilon
            cells = [pa.array(np.floor(at * k).astype(np.int32).tolist(), pa.list_(pa.int32())) for k in (1, 16)]
            columns = [batch.column(0), pa.array(dims), *cells, pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "dim", "cell", "fine", "raw"])

    schema = "vec_id long, dim long, cell array<int>, fine array<int>, raw binary"
    # settled before it is sorted, so that rounding can't place a row differently when a task runs again
    return settle(vectors.select("vec_id", "embedding").mapInArrow(run, schema).withColumn("tie", F.monotonically_increasing_id()))


def _blocks(rows: DataFrame, space: Space) -> DataFrame:
    """(node, first, stat, ids, raw): a row for each block of the sequence; first is its first vector's id."""
    schema = "node long, first long, stat binary, ids array<long>, raw array<binary>"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        raw, ids = table.column("raw").to_pylist(), table.column("vec_id").to_pylist()
        stat = space.stat(*space.unit(raw)).tobytes()
        block = table.column("block")[0].as_py()
        return pa.table(
            {"node": pa.array([block], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "stat": [stat], "ids": pa.array([ids], pa.list_(pa.int64())), "raw": pa.array([raw], pa.list_(pa.binary()))}
        )

    return settle(rows.select("block", "seq", "vec_id", "raw").groupBy("block").applyInArrow(run, schema))


def _intervals(blocks: DataFrame, space: Space, fan: int, n: int) -> list[DataFrame]:
    """Tables of the levels: (node, first, stat) of blocks and of `fan` intervals of the level below; kids above the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [space.merged(np.array([np.frombuffer(k["stat"]) for k in kids])).tobytes() for kids in batch.column(1).to_pylist()]
            firsts = [kids[0]["first"] for kids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, pa.int64()), pa.array(stats, pa.binary()), batch.column(1)], ["node", "first", "stat", "kids"])

    kids = "kids array<struct<node:long,first:long,stat:binary>>"
    levels = [blocks.select("node", "first", "stat")]
    while n > 1:
        up = levels[-1].groupBy(F.expr(f"node div {fan}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "first", "stat"))).alias("kids"))
        levels.append(settle(up.mapInArrow(run, f"node long, first long, stat binary, {kids}")))
        n = -(-n // fan)
    return levels


def _followed(levels: list[DataFrame], space: Space) -> tuple[DataFrame, DataFrame]:
    """Open pairs of blocks (a, b), and pairs of intervals that hold nothing but links: (level, a, b, na, nb, fa, fb)."""
    schema = "a long, b long, na long, nb long, fa long, fb long, whole boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                sa, sb = (np.array([np.frombuffer(k["stat"]) for k in kids]) for kids in (left, right))
                near, whole = space.bounds(sa, sb)
                for i, j in zip(*np.nonzero(near)):
                    x, y = left[i], right[j]
                    if x["node"] <= y["node"]:
                        out.append((x["node"], y["node"], int(sa[i, 0]), int(sb[j, 0]), x["first"], y["first"], bool(whole[i, j])))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.bool_())], schema_names)

    schema_names = [f.split()[0] for f in schema.split(", ")]
    top = levels[-1]
    own = top.select(F.struct("node", "first", "stat").alias("kid")).select(F.lit(0).cast("long").alias("node"), F.array("kid").alias("kids"))
    pairs, wholes = None, []
    for level in range(len(levels), 0, -1):
        kids = own if level == len(levels) else levels[level].select("node", "kids")
        if pairs is None:
            rows = kids.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("kids").alias("ka"), F.col("kids").alias("kb"))
        else:
            rows = pairs.select("a", "b").join(kids.select(F.col("node").alias("a"), F.col("kids").alias("ka")), "a")
            rows = rows.join(kids.select(F.col("node").alias("b"), F.col("kids").alias("kb")), "b").select("a", "b", "ka", "kb")
        found = settle(rows.mapInArrow(run, schema))
        wholes.append(found.filter("whole").drop("whole").withColumn("level", F.lit(level - 1)))
        pairs = found.filter("NOT whole").select("a", "b")
    whole = wholes[0]
    for more in wholes[1:]:
        whole = whole.unionByName(more)
    return pairs, settle(whole)


def _compared(pairs: DataFrame, blocks: DataFrame, space: Space, copies: int = 64) -> DataFrame:
    """(seq, vec_id, links, root_seq, root_id): vectors with links in a pair of blocks, root standing for what they connect.

    A block is sent out by several rows, each to at most `copies` pairs on average.
    """
    sides = pairs.select("a", "b", F.col("a").alias("block")).union(pairs.filter("a != b").select("a", "b", F.col("b").alias("block")))
    sides = settle(sides)
    parts = sides.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / copies).cast("int").alias("parts")).withColumnRenamed("block", "__b")
    dealt = sides.join(parts, F.col("block") == F.col("__b")).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"))
    dealt = dealt.drop("__b", "parts")
    sent = blocks.join(parts, F.col("node") == F.col("__b")).select("node", "ids", "raw", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__part"))
    rows = dealt.join(sent, (F.col("block") == F.col("node")) & (F.col("part") == F.col("__part"))).select("a", "b", "node", "ids", "raw")
    schema = "seq long, vec_id long, links long, root_seq long, root_id long"

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        links, label = joined(space, [space.unit(r["raw"]) for r in rows])
        ids = [i for r in rows for i in r["ids"]]
        seqs = np.concatenate([r["node"] * space.block + np.arange(len(r["ids"])) for r in rows])
        who = np.nonzero(links)[0]
        take = lambda at: pa.array([ids[i] for i in at], pa.int64())
        return pa.table({"seq": seqs[who], "vec_id": take(who), "links": links[who], "root_seq": seqs[label[who]], "root_id": take(label[who])})

    return settle(rows.groupBy("a", "b").applyInArrow(run, schema))


def _node(vec_id: str, seq: Column | str) -> Column:
    """A vector as a node: the least id first, those without id last."""
    return F.struct(F.col(vec_id).isNull().alias("none"), F.col(vec_id).alias("id"), F.col(seq).alias("seq") if isinstance(seq, str) else seq.alias("seq"))


def valid(embedding: Column) -> Column:
    """Whether a vector has a direction: not null, no component null or not finite, some component not zero."""
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, axes: int = 8, sample: int = 5_000, block: int = 4096, part: int = 256, fan: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    n_links: other rows whose cosine with it is at least `cosine`, in double precision; component_id: the smallest
    vec_id that links reach, itself included; kept: whether that is its own. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, nor do vectors of different length. Rows of one vec_id are rows of their
    own. Rows without id link like others, but give a component no id unless it has none. Empty input: no rows.

    Axes are fitted on at most `sample` vectors; every vector is joined. A block has at most `block` vectors, fewer where they
    are long; `part` of them are compared at once.
    """
    exact = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    cast = "array<float>" if exact == "<f4" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(cast).alias("embedding"))
    good = rows.filter(valid(F.col("embedding")))
    rest = rows.filter(~valid(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    n, longest = good.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n == 0:
        return rest.withColumn("kept", F.lit(True))
    block = max(1, min(block, 2**18 // longest))
    space = Space(cosine, exact, longest, _axes(good, sample, axes), block, part)
    order = [F.asc("dim"), F.asc("cell"), F.asc("fine"), F.asc("hash"), F.asc("vec_id"), F.asc("tie")]
    placed = numbered(_placed(good, space).withColumn("hash", F.xxhash64("raw")), [], order, "seq")
    placed = settle(placed.select("vec_id", "seq", F.expr(f"seq div {block}").alias("block"), "raw"))
    blocks = _blocks(placed, space)
    levels = _intervals(blocks, space, fan, -(-n // block))
    pairs, whole = _followed(levels, space)
    compared = _compared(pairs, blocks, space)

    sides = whole.select("level", F.col("a").alias("node"), F.when(F.col("a") == F.col("b"), F.col("nb") - 1).otherwise(F.col("nb")).alias("more"), F.col("fa").alias("first"))
    sides = sides.union(whole.filter("a != b").select("level", "b", "na", "fb")).groupBy("level", "node").agg(F.sum("more").alias("more"), F.max("first").alias("first"))
    lines = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("block") / F.pow(F.lit(fan), k)).alias("up"))))
    above = levels[0].select(F.col("node").alias("block")).select("block", lines.alias("l")).select("block", "l.level", "l.up")
    above = above.join(sides.withColumnRenamed("level", "__level"), (F.col("level") == F.col("__level")) & (F.col("up") == F.col("node")))
    start = F.col("node") * F.pow(F.lit(fan), F.col("level")).cast("long") * block
    credit = above.groupBy("block").agg(F.sum("more").alias("more"), F.max(F.struct("level", start.alias("seq"), "first")).alias("top"))
    credit = settle(credit.select(F.col("block").alias("__block"), "more", F.col("top.seq").alias("top_seq"), F.col("top.first").alias("top_first")))
    placed = placed.select("vec_id", "seq", "block")
    own = placed.join(credit, F.col("block") == F.col("__block"))

    scale = F.pow(F.lit(fan), F.col("level")).cast("long") * block
    edges = compared.select(_node("vec_id", "seq").alias("a"), _node("root_id", "root_seq").alias("b"))
    edges = edges.union(own.select(_node("vec_id", "seq"), _node("top_first", "top_seq")))
    edges = edges.union(whole.select(_node("fa", F.col("a") * scale), _node("fb", F.col("b") * scale)))
    roots = components(edges).select(F.col("node").alias("__node"), "root")
    links = compared.groupBy("seq").agg(F.sum("links").alias("links")).withColumnRenamed("seq", "__seq")
    out = placed.join(credit.select("__block", "more"), F.col("block") == F.col("__block"), "left")
    out = out.join(links, F.col("seq") == F.col("__seq"), "left").withColumn("__me", _node("vec_id", "seq")).join(roots, F.col("__me") == F.col("__node"), "left")
    total = F.coalesce("links", F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))
    out = out.select("vec_id", total.alias("n_links"), F.coalesce("root.id", "vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of embeddings, as `near_duplicates` defines it, whatever its label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
