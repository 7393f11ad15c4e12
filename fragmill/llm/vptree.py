"""Nearest neighbours by vantage-point trees, one per shard.

Vectors go to the ball of their nearest pivot, of a bounded number of pivots; a ball of many rows is dealt into shards by
a hash of the id, so that even one vector that a third of all rows hold spreads evenly.  Each shard becomes one tree; a
task makes and holds the trees of one part, a few shards, and then sees the part's queries in batches.  A query first
searches the shard it lies in.  Its k-th distance there tells which balls the triangle inequality cannot exclude, and only
parts with their shards are asked as well, each once for all its shards.  Within a tree a subtree is skipped likewise, for
all queries of a block that allow it, and a leaf's vectors by lower bounds of their distances from one product of matrices
with room for rounding; the rest are measured from differences.  Vectors without any structure are near the quadratic
case still: the bounds exclude few subtrees there, and what is saved is most of the cost of a pair, not the pair.  Every
bound is multiplied by `factor`: one is exact, more skips more.  Splits go by rank, not by value, so any number of equal
vectors still halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, trimming, written

#: Vectors of a shard, least and most pivots, queries of a block, vectors of a leaf.
SHARD_ROWS, PIVOTS, BLOCK, LEAF = 4096, (16, 256), 1024, 256

#: Shards are dealt into about so many parts, of at most so many shards; a task holds the trees of a part.
PARTS, HELD = 64, 16

#: What a product of matrices may be wrong by, of both squares and for each dimension (and some more): several times the
#: bound of rounding errors, whatever the order of the sums.
ROUNDING = 8 * np.finfo(np.float64).eps


class Tree:
    """ids and vectors in leaf order; nodes as rows of (vantage, start, end, near, far) and four bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, bounds: np.ndarray):
        self.ids, self.vectors, self.nodes, self.bounds = ids, vectors, nodes, bounds
        self.squares = np.einsum("ij,ij->i", vectors, vectors)
        self.room = ROUNDING * (vectors.shape[1] + 8)
        self.wide = np.column_stack([vectors, np.where(np.isfinite(self.squares), self.squares * (1 - self.room), -np.inf)])

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        nodes, bounds = [], []

        def grow(start: int, end: int) -> int:
            me = len(nodes)
            nodes.append([-1, start, end, -1, -1])
            bounds.append([0.0] * 4)
            if end - start <= leaf:
                return me
            part = order[start:end]
            pick = int(distances(vectors[part[:1]], vectors[part])[0].argmax())  # an outlying vantage point splits best
            part[0], part[pick] = part[pick], part[0]
            d = distances(vectors[part[:1]], vectors[part[1:]])[0]
            by = np.argsort(d, kind="stable")
            order[start + 1 : end] = part[1:][by]
            d = d[by]
            half = len(d) // 2
            bounds[me] = [d[0], d[half - 1], d[half], d[-1]]
            nodes[me] = [start, start, end, grow(start + 1, start + 1 + half), grow(start + 1 + half, end)]
            return me

        if len(ids):
            grow(0, len(ids))
        return cls(ids[order], vectors[order], np.array(nodes, np.int64).reshape(-1, 5), np.array(bounds, np.float64).reshape(-1, 4))

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, factor: float, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest, as far as within `limits`; inf where there are fewer.

        Queries without a limit first go down to one leaf each.  Then a node is seen once, with all queries that its
        bounds cannot exclude.  A leaf is screened by lower bounds of the distances, from one product of matrices; what
        they leave is measured from differences.
        """
        limits = np.full(len(qids), np.inf) if limits is None else limits
        best = np.full((len(qids), k), np.inf)
        found = np.full((len(qids), k), np.iinfo(np.int64).max)
        home = np.full(len(qids), -1)
        squares, room = (queries * queries).sum(1), self.room
        wide = np.column_stack([-2 * queries, np.ones(len(queries))])
        known = np.isin(qids, self.ids)  # which are, by their id, not to find all

        def within_reach(q: np.ndarray) -> np.ndarray:
            return np.minimum(best[q, -1], limits[q])

        def offer(q: np.ndarray, i: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
            """Takes the distances `d` of q[i], `i` ascending, to the vectors of `ids`."""
            start = np.flatnonzero(np.diff(i, prepend=-1))
            count = np.diff(start, append=len(i))
            row, place = np.repeat(np.arange(len(start)), count), np.arange(len(i)) - np.repeat(start, count)
            q = q[i[start]]
            more, named = np.full((len(q), count.max()), np.inf), np.full((len(q), count.max()), np.iinfo(np.int64).max)
            more[row, place], named[row, place] = d, ids
            more, named = np.concatenate([best[q], more], 1), np.concatenate([found[q], named], 1)
            o = np.lexsort((named, more), axis=1)[:, :k]
            best[q], found[q] = np.take_along_axis(more, o, 1), np.take_along_axis(named, o, 1)

        def leaf(q: np.ndarray, start: int, end: int) -> None:
            least = wide[q] @ self.wide[start:end].T  # with a query's own square, lower bounds of the squares of distances
            if known[q].any():
                least[qids[q][:, None] == self.ids[start:end]] = np.inf
            top = (within_reach(q) * (1 + 1e-12) + 1e-12) ** 2 - squares[q] * (1 - room)
            top[~np.isfinite(squares[q])] = np.nan  # squares beyond all numbers exclude nothing
            some = np.flatnonzero(~(least.min(1) > top))
            if not len(some):
                return
            q, least, top = q[some], least[some], top[some]
            hit = ~(least > top[:, None])
            many = np.flatnonzero(hit.sum(1) > 4 * k)
            if len(many):  # as many are nearer than the k-th of their upper bounds
                most = np.partition(least[many], k - 1, axis=1)[:, k - 1] + 2 * room * (squares[q[many]] + self.squares[start:end].max()) + 1e-24
                hit[many] &= ~(least[many] > most[:, None])
            i, j = np.nonzero(hit)
            j += start
            other = qids[q[i]] != self.ids[j]
            i, j = i[other], j[other]
            if len(i):
                offer(q, i, paired(queries, q[i], self.vectors, j), self.ids[j])

        def sides(node: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = distances(queries[q], self.vectors[self.nodes[node, 1] : self.nodes[node, 1] + 1])[:, 0]
            in_least, in_most, out_least, out_most = self.bounds[node]
            return d, np.maximum(np.maximum(d - in_most, in_least - d), 0), np.maximum(np.maximum(d - out_most, out_least - d), 0)

        def descend(node: int, q: np.ndarray) -> None:
            vantage, start, end, near, far = self.nodes[node]
            if vantage < 0:
                home[q] = node
                return leaf(q, start, end)
            _, inner, outer = sides(node, q)
            for child, mine in ((near, q[inner <= outer]), (far, q[inner > outer])):
                if len(mine):
                    descend(child, mine)

        def visit(node: int, q: np.ndarray) -> None:
            vantage, start, end, near, far = self.nodes[node]
            if vantage < 0:
                q = q[home[q] != node]
                return leaf(q, start, end) if len(q) else None
            d, inner, outer = sides(node, q)
            i = np.flatnonzero((d <= within_reach(q) * (1 + 1e-12) + 1e-12) & (qids[q] != self.ids[start]))
            if len(i):
                offer(q, i, d[i], np.full(len(i), self.ids[start]))
            both = (near, inner), (far, outer)
            for child, bound in both if 2 * (inner <= outer).sum() >= len(q) else both[::-1]:
                go = within(bound * factor, within_reach(q))
                if go.any():
                    visit(child, q[go])

        if len(self.ids) and len(qids):
            if len(free := np.flatnonzero(np.isinf(limits))):
                descend(0, free)
            visit(0, np.arange(len(qids)))
        best[~within(best, limits[:, None])] = np.inf
        return best, found


def within(bound: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether a bound does not exceed a limit, with room for rounding."""
    return bound <= limit * (1 + 1e-12) + 1e-12


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, from differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        x = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt((x * x).sum(-1))
    return out


def paired(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of a[i] and b[j], as `distances` has them."""
    out = np.empty(len(i))
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        x = a[i[s : s + step]] - b[j[s : s + step]]
        out[s : s + step] = np.sqrt((x * x).sum(-1))
    return out


def usable(vectors: DataFrame, column: str, id_column: str) -> DataFrame:
    """_id, _v (array of double): rows with an id and a vector that is neither zero nor holds null or non-finite components."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_column).cast("long").alias("_id"), v.alias("_v"))


_ASK = "part long, turn int, shard long, _id long, _v array<double>, dim int, limit double"


class Balls:
    """Pivots by dimension and, once they are known, radius, shards and first shard of each ball."""

    def __init__(self, pivots: list[tuple[int, list[float]]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in sorted({d for d, _ in pivots}):
            at = [i for i, (d, _) in enumerate(pivots) if d == dim]
            self.of[dim] = np.array(at), np.array([pivots[i][1] for i in at])
        self.shards: dict[tuple[int, int], tuple[float, int, int]] = {}

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance of vectors of one dimension; ball -1 without a pivot, to which no bound applies."""
        if vectors.shape[1] not in self.of:
            return np.full(len(vectors), -1), np.zeros(len(vectors))
        at, pivots = self.of[vectors.shape[1]]
        d = distances(vectors, pivots)
        near = d.argmin(1)
        return at[near], d[np.arange(len(d)), near]

    @cached_property
    def ball_of(self) -> dict[int, tuple[int, float]]:
        """Ball and radius of each shard."""
        return {shard: (ball, radius) for (ball, _), (radius, shards, first) in self.shards.items() for shard in range(first, first + shards)}

    @cached_property
    def size(self) -> int:
        """Shards of a part."""
        return min(HELD, max(1, sum(n for _, n, _ in self.shards.values()) // PARTS))

    def hit(self, shard: int, vectors: np.ndarray, limits: np.ndarray, factor: float) -> np.ndarray:
        """Which of the vectors may find something within their limits in the ball of a shard of their dimension."""
        ball, radius = self.ball_of[shard]
        if ball < 0:
            return np.full(len(vectors), True)
        at, pivots = self.of[vectors.shape[1]]
        d = distances(vectors, pivots[at == ball])[:, 0]
        return within(np.maximum(d - radius, 0) * factor, limits)

    def asked(self, vectors: np.ndarray, limits: np.ndarray, own: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """Parts, and which of the vectors may find something within their limits there, outside their own shards."""
        parts: dict[int, np.ndarray] = {}
        for (_, dim), (_, shards, first) in self.shards.items():
            if dim == vectors.shape[1]:
                hit = self.hit(first, vectors, limits, factor)
                for shard in range(first, first + shards):
                    parts[shard // self.size] = parts.get(shard // self.size, False) | hit & (own != shard)
        for part, hit in parts.items():
            if hit.any():
                yield part, np.flatnonzero(hit)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, places and vectors of a batch with columns dim and _v."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, b.column("_v").take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)


def _searched(rows: DataFrame, asks: DataFrame, k: int, factor: float, balls=None) -> DataFrame:
    """query_id, vec_id, score: what queries find in their own shards or, given `balls`, in the others of the part.

    Both have the columns of _ASK; `rows` have turn 0 and `asks`, a row for each part that a query is sent to, turn 1.
    """

    def answers(trees: dict[int, Tree], b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for dim, at, vectors in _by_dim(b):
            for s in range(0, len(at), BLOCK):
                block, v = at[s : s + BLOCK], vectors[s : s + BLOCK]
                ids, limits, own = (b.column(c).to_numpy()[block] for c in ("_id", "limit", "shard"))
                for shard, tree in trees.items():
                    if tree.vectors.shape[1] != dim:
                        continue
                    q = np.flatnonzero(own == shard if balls is None else (own != shard) & balls.value.hit(shard, v, limits, factor))
                    if len(q):
                        d, found = tree.search(ids[q], v[q], k, factor, limits[q])
                        limits[q] = np.minimum(limits[q], d[:, -1])
                        ok = np.isfinite(d)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[q], ok.sum(1))), pa.array(found[ok]), pa.array(d[ok])], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trees = [], {}  # batches of a part's rows until its first query, then the trees
        for b in batches:
            parts, turns = b.column("part").to_numpy(), b.column("turn").to_numpy()
            ends = np.flatnonzero(np.diff(parts * 2 + turns, append=-1)) + 1
            for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                piece = b.slice(start, end - start)
                if turns[start] == 0:
                    held, trees = [*(x for x in held if x.column("part")[0].as_py() == parts[start]), piece], {}
                    continue
                if held:
                    trees = _trees(held) if held[0].column("part")[0].as_py() == parts[start] else {}
                    held = []
                yield from answers(trees, piece)

    both = rows.unionByName(asks).repartition("part").sortWithinPartitions("part", "turn", "shard")
    return both.mapInArrow(trimming(run), "query_id long, vec_id long, score double")


def _trees(batches: list[pa.RecordBatch]) -> dict[int, Tree]:
    """The tree of each shard, whose vectors have one dimension."""
    pieces: dict[int, list] = {}
    for b in batches:
        shards, ids = b.column("shard").to_numpy(), b.column("_id").to_numpy()
        for _, at, v in _by_dim(b):
            for shard in np.unique(shards[at]):
                mine = shards[at] == shard
                pieces.setdefault(int(shard), []).append((ids[at][mine], v[mine]))
    return {shard: Tree.build(np.concatenate([i for i, _ in p]), np.concatenate([v for _, v in p])) for shard, p in pieces.items()}


def nearest(vectors: DataFrame, is_query, k: int = 10, factor: float = 1.0, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of every row that `is_query` (a Column) holds for.

    Nearest first, ties to the smaller id; fewer rows where there are fewer candidates.  Rows without an id or a usable
    vector take no part, nor does a vector of another dimension than the query's.  Rows that share the query's id are
    not its candidates; other repeated rows count each; queries that repeat an id are ranked as one.  An empty table
    gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors, column, id_column).select("_id", "_v", F.size("_v").alias("dim")), "vectors")
    number = min(PIVOTS[1], max(PIVOTS[0], rows.count() // SHARD_ROWS))
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(number).collect()  # PIVOTS[1] vectors at most
    balls = Balls([(r["dim"], list(r["_v"])) for r in picked])
    sent = spark.sparkContext.broadcast(balls)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ball, far = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for _, at, v in _by_dim(b):
                ball[at], far[at] = sent.value.placed(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball, pa.int32()), pa.array(far)], names=[*b.schema.names, "ball", "far"])

    placed = written(rows.mapInArrow(trimming(place), "_id long, _v array<double>, dim int, ball int, far double"), "placed")
    dropped(rows)
    first = 0
    for r in sorted(placed.groupBy("ball", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()):  # balls
        balls.shards[r["ball"], r["dim"]] = (r["radius"], -(-r["n"] // SHARD_ROWS), first)
        first += -(-r["n"] // SHARD_ROWS)
    known = spark.createDataFrame([(b, d, s, f) for (b, d), (_, s, f) in balls.shards.items()], "ball int, dim int, shards int, first long")
    dealt = placed.join(F.broadcast(known), ["ball", "dim"]).withColumn("shard", F.col("first") + F.pmod(F.xxhash64("_id"), F.col("shards")))  # a row a ball

    part = F.floor(F.col("shard") / balls.size)
    of_parts = dealt.select(part.alias("part"), F.lit(0).alias("turn"), "shard", "_id", "_v", "dim", F.lit(None).cast("double").alias("limit"))
    asked = written(dealt.where(is_query(F.col("_id"))).select("shard", "_id", "_v", "dim"), "asked")
    all_balls = spark.sparkContext.broadcast(balls)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            limits, own = b.column("limit").to_numpy(), b.column("shard").to_numpy()
            for _, at, v in _by_dim(b):
                for to, hit in all_balls.value.asked(v, limits[at], own[at], factor):
                    sent = b.take(pa.array(at[hit]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), to)), pa.array(np.full(len(hit), 1), pa.int32()), *(sent.column(c) for c in ("shard", "_id", "_v", "dim", "limit"))], names=["part", "turn", "shard", "_id", "_v", "dim", "limit"])

    own = asked.select(part.alias("part"), F.lit(1).alias("turn"), "shard", "_id", "_v", "dim", F.lit(float("inf")).alias("limit"))
    near = written(_searched(of_parts, own, k, factor), "near")
    once = asked.groupBy("_id").agg(F.count(F.lit(1)).alias("asked"))
    bound = near.groupBy(F.col("query_id").alias("_id")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most"))
    limit = F.when((F.col("asked") == 1) & (F.col("n") >= k), F.col("most")).otherwise(F.lit(float("inf")))  # no limit for repeated queries
    more = asked.join(once, "_id").join(bound, "_id", "left").select("shard", "_id", "_v", "dim", F.coalesce(limit, F.lit(float("inf"))).alias("limit"))
    found = near.unionByName(_searched(of_parts, more.mapInArrow(trimming(others), _ASK), k, factor, all_balls))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
