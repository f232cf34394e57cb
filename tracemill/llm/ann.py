"""Approximate nearest neighbours by the largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. A first graph comes from cells of random half-spaces. NN-descent then lets each node
introduce its neighbours, and those it is a neighbour of, to each other: what is better than a node's worst neighbour is
offered to it, and the offers are merged with its list. Pairs of which both edges are old are not compared again. A query
walks the graph from its own node: in each round the best of its pool that have not been looked at yet give their lists,
whose members are scored. The pool's best are scored exactly, on the original vectors, in double precision.

Each node has a home task, by its number. Tasks send each other messages, Spark rows of packed arrays, so that an edge is
13 bytes and not a row: a round of NN-descent is four joins of messages with the tasks' own state (who is whose
neighbour, who needs which vectors, the vectors, the offers), a round of the walk three. A task sends a node at most as
many backward edges and offers as the node could keep, so a hub gets a bounded message from each task. Vectors travel as
bytes with a scale (8 bits a component); this bears on which nodes are found, not on scores.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Kinds of messages.
GRAPH, VECTORS, BACK, LISTS, WANT, GIVE, OFFER, POOL, LOOK, SCORE, SCORED = range(11)
_MESSAGE = "task int, kind int, data binary, n long"
Message = tuple[int, int, bytes, int]


def packed(*arrays: np.ndarray) -> bytes:
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x).tobytes()
        out += [struct.pack("<cq", x.dtype.char.encode(), len(raw)), raw]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<cq", data, at)
        at += struct.calcsize("<cq")
        out.append(np.frombuffer(data, np.dtype(kind.decode()), n // np.dtype(kind.decode()).itemsize, at))
        at += n
    return out


def _messages(rows: list[Message]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["task", "kind", "data", "n"])


def home(n: np.ndarray, tasks: int) -> np.ndarray:
    return (n.astype(np.int64).view(np.uint64) % np.uint64(tasks)).astype(np.int64)


def sent(kind: int, to: np.ndarray, *arrays: np.ndarray) -> list[Message]:
    """A message to each task in `to` with the rows of the arrays that go there."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return [(int(to[p[0]]), kind, packed(*(x[p] for x in arrays)), len(p)) for p in parts]


class Inbox:
    """The messages that a task gets."""

    def __init__(self, table: pa.Table):
        self.by: dict[int, list[list[np.ndarray]]] = defaultdict(list)
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            self.by[kind].append(unpacked(data))

    def all(self, kind: int, *kinds) -> list[np.ndarray]:
        """The arrays of all messages of a kind, put together; empty ones of these types if there are none."""
        found = self.by.get(kind)
        return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, k) for k in kinds]


_EDGES = (np.int64, np.int64, np.float32, np.bool_)


def exchanged(messages: DataFrame, tasks: int, step: Callable[[int, Inbox], list[Message]]) -> DataFrame:
    """What each task answers to the messages it gets."""

    def run(table: pa.Table) -> pa.Table:
        return _messages(step(table.column("task")[0].as_py(), Inbox(table)))

    return messages.repartition(tasks, "task").groupBy("task").applyInArrow(run, _MESSAGE)


def best(u: np.ndarray, c: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each u its k best distinct c, u in order; of an edge that is there already and offered again, the old one."""
    order = np.lexsort((fresh, c, u))
    u, c, s, fresh = u[order], c[order], s[order], fresh[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
    u, c, s, fresh = u[first], c[first], s[first], fresh[first]
    order = np.lexsort((c, -s, u))
    u, c, s, fresh = u[order], c[order], s[order], fresh[order]
    keep = _rank(u) < k
    return u[keep], c[keep], s[keep], fresh[keep]


def _rank(u: np.ndarray) -> np.ndarray:
    """The place of each item among its equals, which stand together."""
    begins = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    return np.arange(len(u)) - np.repeat(begins, np.diff(np.append(begins, len(u))))


def _some(u: np.ndarray, c: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """At most `most` edges of each u, fresh ones first, then in an order of hashes."""
    mixed = (u * np.int64(-7046029254386353131)) ^ (c * np.int64(-4417276706812531889))
    mixed ^= mixed >> np.int64(29)
    order = np.lexsort((mixed, ~fresh, u))
    keep = order[_rank(u[order]) < most]
    return u[keep], c[keep], fresh[keep]


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def vectors(rows: DataFrame, tasks: int) -> DataFrame:
    """A message of kind VECTORS for each task: its nodes' numbers in order, their components as bytes, their scales."""
    distinct = rows.groupBy("n").agg(F.first("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column(0).to_numpy()
                e = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
                scale = np.abs(e).max(axis=1) / 127
                q = np.rint(e / np.maximum(scale, 1e-300)[:, None]).astype(np.int8)
                yield from _messages(sent(VECTORS, home(n, tasks), n, q, scale.astype(np.float32))).to_batches()

    def gather(task: int, box: Inbox) -> list[Message]:
        n, q, scale = box.all(VECTORS)
        order = np.argsort(n)
        return [(task, VECTORS, packed(n[order], q.reshape(len(n), -1)[order], scale[order]), len(n))]

    return exchanged(distinct.select("n", "e").mapInArrow(run, _MESSAGE), tasks, gather)


def _vectors(box: Inbox, kind: int = VECTORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, bytes as a matrix, scales."""
    n, q, scale = box.all(kind, np.int64, np.int8, np.float32)[:3]
    return n, q.reshape(len(n), -1) if len(n) else np.zeros((0, 1), np.int8), scale


def first_graph(vectors: DataFrame, count: int, dim: int, k: int, trees: int, tasks: int, seed: int, cell: int = 160) -> DataFrame:
    """Offers among the nodes of a cell of each of several families of random half-spaces; crowded cells are split."""
    depth = max(0, int(np.ceil(np.log2(max(1, count / cell)))))
    planes = np.random.default_rng(seed).normal(size=(trees, depth, dim)).astype(np.float32)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(2).to_pylist():
                n, q, scale = unpacked(data)
                q = q.reshape(len(n), -1)
                x = q.astype(np.float32)
                for t in range(trees):
                    sign = (x @ planes[t].T > 0) @ (1 << np.arange(depth)) if depth else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sign * trees + t, pa.int64()), pa.array(n), pa.array(list(map(bytes, q)), pa.binary()), pa.array(scale)],
                        ["cell", "n", "q", "scale"],
                    )

    placed = vectors.mapInArrow(cells, "cell long, n long, q binary, scale float")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).alias("__pieces"))
    placed = placed.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("n"), F.col("__pieces"))).drop("__pieces")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("cell", "ascending"), ("piece", "ascending")])
        n, own, piece, scale = (table.column(c).to_numpy() for c in ("n", "cell", "piece", "scale"))
        x = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int8).reshape(len(n), -1).astype(np.float32) * scale[:, None]
        cuts = np.flatnonzero((own[1:] != own[:-1]) | (piece[1:] != piece[:-1])) + 1
        found: list[tuple] = []
        for part in np.split(np.arange(len(n)), cuts):
            if len(part) > 1:
                s = x[part] @ x[part].T
                np.fill_diagonal(s, -np.inf)
                top = np.argpartition(-s, min(k, len(part) - 1) - 1, axis=1)[:, : min(k, len(part) - 1)]
                found.append((np.repeat(n[part], top.shape[1]), n[part][top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        if found:
            u, c, s = (np.concatenate(f) for f in zip(*found))
            u, c, s, _ = best(u, c, s, np.ones(len(u), bool), k)
            yield from _messages(sent(OFFER, home(u, tasks), u, c, s)).to_batches()

    return placed.repartition(tasks, "cell", "piece").mapInArrow(link, _MESSAGE)


def neighbour_graph(
    vectors: DataFrame, count: int, dim: int, tasks: int, k: int, back: int, each: int, trees: int = 6, rounds: int = 7,
    enough: float = 0.02, seed: int = 9,
) -> DataFrame:
    """Messages GRAPH and BACK for each task: for each node about its k best neighbours, and some whose neighbour it is.
    Stops when a round changes few of the edges."""

    def take(task: int, box: Inbox) -> list[Message]:
        """The graph with the offers, and its backward edges."""
        u, c, s, fresh = box.all(GRAPH, *_EDGES)
        a, b, t = box.all(OFFER, *_EDGES[:3])
        new = np.concatenate([np.zeros(len(u), bool), np.ones(len(a), bool)])
        u, c, s, fresh = best(np.concatenate([u, a]), np.concatenate([c, b]), np.concatenate([s, t]), new, k)
        to, of, young = _some(c, u, fresh, back)
        return [(task, GRAPH, packed(u, c, s, fresh), int(fresh.sum())), *sent(BACK, home(to, tasks), to, of, young)]

    def ask(task: int, box: Inbox) -> list[Message]:
        """Each node's list, and whose vectors the lists need."""
        u, c, s, fresh = box.all(GRAPH, *_EDGES)
        a, b, young = lists_of(u, c, fresh, box, back)
        wanted = np.unique(b)
        want = [(t, WANT, packed(np.array([task]), *unpacked(data)), n) for t, _, data, n in sent(WANT, home(wanted, tasks), wanted)]
        return [(task, GRAPH, packed(u, c, s, fresh), 0), (task, LISTS, packed(a, b, young), 0), *want]

    def give(task: int, box: Inbox) -> list[Message]:
        """The vectors that others need, with the worst score that still helps each."""
        n, q, scale = _vectors(box)
        u, c, s, fresh = box.all(GRAPH, *_EDGES)
        worst = np.full(len(n), -np.inf, np.float32)
        heads, begin, many = np.unique(u, return_index=True, return_counts=True)
        full = many >= k
        if full.any():
            low = np.minimum.reduceat(s, begin)
            worst[np.searchsorted(n, heads[full])] = low[full]
        out = [(task, GRAPH, packed(u, c, s, fresh), 0)]
        out += [(task, LISTS, packed(*m), 0) for m in box.by[LISTS]]
        for asker, ids in box.by[WANT]:
            at = np.searchsorted(n, ids)
            out.append((int(asker[0]), GIVE, packed(ids, q[at], scale[at], worst[at]), len(ids)))
        return out

    def introduce(task: int, box: Inbox) -> list[Message]:
        """Offers: of each list the pairs that better one of the two."""
        u, c, fresh = box.all(LISTS, np.int64, np.int64, np.bool_)
        out = [(task, GRAPH, packed(*m), 0) for m in box.by[GRAPH]]
        n, q, scale = _vectors(box, GIVE)
        if not len(u) or not len(n):
            return out
        worst = box.all(GIVE)[3]
        order = np.argsort(n)
        n, x, worst = n[order], q[order].astype(np.float32) * scale[order, None], worst[order]
        at, found = np.searchsorted(n, c), []
        for part in np.split(np.arange(len(u)), np.flatnonzero(u[1:] != u[:-1]) + 1):
            m, new = at[part], fresh[part]
            s = x[m] @ x[m].T
            s[~(new[:, None] | new[None, :])] = -np.inf
            np.fill_diagonal(s, -np.inf)
            s[s <= worst[m][:, None]] = -np.inf
            top = np.argpartition(-s, each, axis=1)[:, :each] if len(m) > each else np.broadcast_to(np.arange(len(m)), s.shape)
            s = np.take_along_axis(s, top, 1)
            i, j = np.nonzero(s > -np.inf)
            found.append((m[i], m[top[i, j]], s[i, j]))
        a, b, s = (np.concatenate(f) for f in zip(*found))
        # of a task's offers to a node no more than k can be among its k best
        a, b, s, _ = best(a, b, s, np.ones(len(a), bool), k)
        return out + sent(OFFER, home(n[a], tasks), n[a], n[b], s)

    graph = settle(exchanged(first_graph(vectors, count, dim, k, trees, tasks, seed), tasks, take))
    for _ in range(rounds):
        asked = exchanged(graph, tasks, ask)
        given = exchanged(asked.union(vectors), tasks, give)
        graph = settle(exchanged(exchanged(given, tasks, introduce), tasks, take))
        if (graph.filter(F.col("kind") == GRAPH).agg(F.sum("n")).first()[0] or 0) <= enough * count * k:
            break
    return graph


def lists_of(u: np.ndarray, c: np.ndarray, fresh: np.ndarray, box: Inbox, back: int) -> tuple[np.ndarray, ...]:
    """(u, c, fresh) in order of u: neighbours and, at most `back` of them, the nodes whose neighbour u is."""
    a, b, young = _some(*box.all(BACK, np.int64, np.int64, np.bool_), back)
    u, c, fresh = np.concatenate([u, a]), np.concatenate([c, b]), np.concatenate([fresh, young])
    order = np.lexsort((~fresh, c, u))
    u, c, fresh = u[order], c[order], fresh[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (c[1:] != c[:-1])
    return u[first], c[first], fresh[first]


def walk(asked: DataFrame, graph: DataFrame, vectors: DataFrame, tasks: int, rounds: int, wide: int, pool: int, back: int, keep: int) -> DataFrame:
    """(u, c, s): for each node u of `asked` (n) the `keep` best nodes c that its walk has met."""

    def listed(task: int, box: Inbox) -> list[Message]:
        u, c, _, fresh = box.all(GRAPH, *_EDGES)
        u, c, _ = lists_of(u, c, fresh, box, back)
        return [(task, LISTS, packed(u, c), len(u))]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_numpy()
            yield from _messages(sent(POOL, home(n, tasks), n, n, np.full(len(n), np.inf, np.float32), np.ones(len(n), bool))).to_batches()

    def look(task: int, box: Inbox) -> list[Message]:
        """The pools with what was scored, and whom to look at next: the best that are fresh, that is, not looked at."""
        u, c, s, fresh = box.all(POOL, *_EDGES)
        a, b, t = box.all(SCORED, *_EDGES[:3])
        new = np.concatenate([fresh, np.ones(len(a), bool)])
        u, c, s, fresh = best(np.concatenate([u, a]), np.concatenate([c, b]), np.concatenate([s, t]), new, pool + 1)
        at = np.flatnonzero(fresh)
        at = at[_rank(u[at]) < wide]
        fresh = fresh.copy()
        fresh[at] = False
        n, q, scale = _vectors(box)
        row = np.searchsorted(n, u[at])
        return [(task, POOL, packed(u, c, s, fresh), len(u)), *sent(LOOK, home(c[at], tasks), u[at], c[at], q[row], scale[row])]

    def expand(task: int, box: Inbox) -> list[Message]:
        """The members of the lists that are looked at, sent with the query to their homes."""
        out = [(task, POOL, packed(*m), 0) for m in box.by[POOL]]
        if LOOK not in box.by:
            return out
        u, c, q, scale = box.all(LOOK)
        q = q.reshape(len(u), -1)
        heads, members = box.all(LISTS, np.int64, np.int64)
        low, high = np.searchsorted(heads, c), np.searchsorted(heads, c, side="right")
        many = high - low
        who = np.repeat(np.arange(len(u)), many)
        at = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        met = members[at]
        keys, first = np.unique(u, return_index=True)
        row = np.searchsorted(keys, u)[who]
        both = np.unique(np.stack([row, met]), axis=1)
        row, met = both[0], both[1]
        other = keys[row] != met
        row, met = row[other], met[other]
        for t, _, data, n in sent(SCORE, home(met, tasks), row, met):
            mine, ids = unpacked(data)
            used, place = np.unique(mine, return_inverse=True)
            out.append((t, SCORE, packed(keys[used], q[first[used]], scale[first[used]], place.astype(np.int32), ids), n))
        return out

    def score(task: int, box: Inbox) -> list[Message]:
        out = [(task, POOL, packed(*m), 0) for m in box.by[POOL]]
        n, q, scale = _vectors(box)
        for u, own, size, place, ids in box.by[SCORE]:
            x = own.reshape(len(u), -1).astype(np.float32) * size[:, None]
            at, s = np.searchsorted(n, ids), np.empty(len(ids), np.float32)
            for k in range(0, len(ids), 65_536):
                part = slice(k, k + 65_536)
                s[part] = np.einsum("ij,ij->i", x[place[part]], q[at[part]].astype(np.float32) * scale[at[part], None])
            out += sent(SCORED, home(u[place], tasks), u[place], ids, s)
        return out

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == POOL:
                    u, c, s, fresh = unpacked(data)
                    other = u != c
                    u, c, s, _ = best(u[other], c[other], s[other], fresh[other], keep)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c), pa.array(s)], ["u", "c", "s"])

    lists = settle(exchanged(graph, tasks, listed))
    state = exchanged(asked.mapInArrow(begin, _MESSAGE).union(vectors), tasks, look)
    for _ in range(rounds):
        scored = exchanged(exchanged(state.union(lists), tasks, expand).union(vectors), tasks, score)
        state = settle(exchanged(scored.union(vectors), tasks, look))
    return state.mapInArrow(ended, "u long, c long, s float")


def _least_ids(rows: DataFrame, count: int, most: int, fan: int = 8) -> DataFrame:
    """(n, vec_id) with at most the `most` least ids of each node, a row each for repeated rows; by levels, so that no
    group of equal vectors or rows meets in one task. rows has to be a checkpoint."""
    salts = 1
    while salts * most * fan < count:
        salts *= fan
    out = rows.select("n", "vec_id", F.xxhash64(F.monotonically_increasing_id()).alias("__place"))
    while True:
        rank = F.row_number().over(Window.partitionBy("n", F.pmod(F.col("__place"), F.lit(salts))).orderBy("vec_id"))
        out = out.withColumn("__r", rank).filter(F.col("__r") <= most).drop("__r")
        if salts == 1:
            return out.drop("__place")
        salts //= fan


def numbered(rows: DataFrame) -> DataFrame:
    """rows with n, a number that equal vectors share and others do not: a seeded hash, the first without a collision."""
    for seed in range(100):
        out = rows.withColumn("n", F.xxhash64(F.lit(seed), "e"))
        other = F.xxhash64(F.lit(-1 - seed), "e")
        clash = out.groupBy("n").agg((F.min(other) != F.max(other)).alias("__two")).filter("__two")
        if clash.isEmpty():
            return settle(out)
    raise RuntimeError("no seed gives each vector a number of its own")


def search(
    rows: DataFrame, is_query: Column, top: int = 20, k: int = 64, back: int = 64, each: int = 8, rounds: int = 4, wide: int = 16,
    pool: int = 160, node_rows: int = 2_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query holds for, its `top` nearest other rows, best first,
    ties to the smaller vec_id.

    rows: vec_id, embedding. k neighbours and up to `back` backward edges a node, `each` offers a node makes for another
    at once; a walk of `rounds` rounds, `wide` looks a round, pools of `pool`. More of any finds more and costs more.

    Vectors that are null or zero or hold null or non-finite components take no part, nor do rows without vec_id. Inner
    products need one length: vectors of another than the most frequent (of equals the longest) take no part either.
    Equal vectors and repeated rows: each row asks and is found as a row of its own; only the asking row itself is left
    out. Fewer others than top: all of them that the walk meets. Very long vectors: any length. Empty input: no rows.
    Other columns do not matter.
    """
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), is_query.alias("is_query"))
    rows = rows.filter(usable(F.col("e")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 1
    rows = numbered(rows.filter(F.size("e") == dim))
    total = rows.count()
    tasks = max(48, -(-total // node_rows))
    own = settle(vectors(rows, tasks))
    count = own.agg(F.sum("n")).first()[0] or 0
    graph = neighbour_graph(own, count, dim, tasks, k, back, each)
    asked = settle(rows.filter("is_query").select("n").distinct())
    near = walk(asked, graph, own, tasks, rounds, wide, pool, back, 3 * top).select("u", "c")
    near = near.union(asked.select(F.col("n").alias("u"), F.col("n").alias("c")))  # rows with the query's own vector
    exactly = rows.groupBy("n").agg(F.first("e").alias("e"))
    near = near.join(exactly.select(F.col("n").alias("__n"), F.col("e").alias("__b")), F.col("c") == F.col("__n")).drop("__n")
    near = near.join(exactly.select(F.col("n").alias("__n"), F.col("e").alias("__a")), F.col("u") == F.col("__n")).drop("__n")
    exact = F.aggregate(F.zip_with("__a", "__b", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    near = near.select("u", "c", exact.alias("score"))
    ids = _least_ids(rows, total, top + 1).select(F.col("n").alias("__n"), "vec_id")
    near = near.join(ids, F.col("c") == F.col("__n")).select("u", "vec_id", "score", (F.col("c") == F.col("u")).alias("own"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("score").desc(), "vec_id", F.col("own").desc()))
    near = near.withColumn("__r", rank).filter(F.col("__r") <= top + 1)
    lists = near.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("__r", "vec_id", "score", "own"))).alias("near"))
    queries = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("n"))
    out = queries.join(lists, F.col("n") == F.col("u"))
    itself = F.get(F.filter("near", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), F.lit(0))["__r"]
    out = out.withColumn("__self", F.coalesce(itself, F.lit(0)))
    others = F.slice(F.filter("near", lambda x: x["__r"] != F.col("__self")), 1, top)
    return out.select("query_id", F.posexplode(others).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows for each query row, as `search` defines them; nulls, ties, repeated rows and empty tables likewise."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, F.col("vec_id") % 20 == 0, top=20)
