"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starprism.llm.common import batches, materialize, new_path
from starprism.llm.files import open_file, write_file

SCALE, EVERY, K = 64, 20, 20
_NARROW, _EXACT = 1 << 24, 1 << 53


class SortedLists:
    """A block of vectors with, for each dimension, the list of its rows by value. Lists are read from whichever end the
    query's sign asks for. ``order``, (n, d): row numbers by falling value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.rows = ids, rows
        self.high, self.low = rows.max(axis=0), rows.min(axis=0)
        self.order = np.argsort(-rows, axis=0, kind="stable") if order is None else order

    def to_bytes(self, cells: np.ndarray) -> bytes:
        """A block's file: numbers of rows and dimensions, ids, the vectors as they came, and the lists."""
        return np.array(cells.shape, "<i8").tobytes() + self.ids.astype("<i8").tobytes() + cells.astype("<f8").tobytes() + self.order.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, numbers: Callable[[np.ndarray], np.ndarray]) -> SortedLists:
        n, d = (int(x) for x in np.frombuffer(data, "<i8", 2))
        at = 16 + 8 * n
        return cls(np.frombuffer(data, "<i8", n, 16), numbers(np.frombuffer(data, "<f8", n * d, at).reshape(n, d)), np.frombuffer(data, "<u4", n * d, at + 8 * n * d).reshape(n, d))

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """The threshold before any list is read: no row of the block can score more."""
        return np.maximum(queries, 0) @ self.high + np.minimum(queries, 0) @ self.low

    def ends(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The values last read in each list after so many steps from the top and from the bottom."""
        at = np.arange(self.rows.shape[1])
        return self.rows[self.order[depth - 1], at], self.rows[self.order[len(self.ids) - depth], at]


class Search:
    """The best ``k`` of a batch of queries over blocks that come one after another."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None):
        """``floor``: k-th scores that are known from elsewhere; what is below them is of no use."""
        self.queries, self.own, self.k, self.scored = queries, own, k, 0
        self.up, self.down = np.maximum(queries, 0), np.minimum(queries, 0)
        self.kth = np.full(len(queries), -np.inf, queries.dtype) if floor is None else floor.astype(queries.dtype)
        self.top = (np.empty(0, np.int64), np.empty(0, queries.dtype), np.empty(0, np.int64))  # query, score, id

    def over(self, block: SortedLists) -> None:
        """Threshold algorithm in one block. The lists of all dimensions are read in step, from both ends, since queries
        have either sign, a few places at first and twice as many each time; each row met is scored in full for the
        queries still at work. A query stops when the sum over dimensions of its value times the value last read is
        below its k-th score: no row that wasn't met can score more, and one that scores the same would need a sum that
        is equal."""
        n = len(block.ids)
        live = np.flatnonzero(block.bound(self.queries) >= self.kth)
        seen, depth = np.zeros(n, bool), 0
        while len(live) and depth < n:
            to = min(n, max(2, 2 * depth))
            fresh = np.zeros(n, bool)
            fresh[block.order[depth:to].ravel()] = True
            fresh[block.order[n - to : n - depth].ravel()] = True
            fresh &= ~seen
            seen |= fresh
            self._score(block, np.flatnonzero(fresh), live)
            depth = to
            if seen.all():
                break
            high, low = block.ends(depth)
            live = live[self.up[live] @ high + self.down[live] @ low >= self.kth[live]]

    def _score(self, block: SortedLists, rows: np.ndarray, live: np.ndarray) -> None:
        if not len(rows):
            return
        scores = self.queries[live] @ block.rows[rows].T
        self.scored += scores.size
        least = self.kth[live]
        mine = block.ids[rows][None, :] == self.own[live][:, None]
        if len(rows) > self.k and scores.dtype != object:
            scores[mine] = -np.inf
            least = np.maximum(least, np.partition(scores, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
        q, r = np.nonzero((scores >= least[:, None]) & ~mine)
        if not len(q):
            return
        query, score, ids = (np.concatenate(x) for x in zip(self.top, (live[q], scores[q, r], block.ids[rows][r]), strict=True))
        order = np.lexsort((ids, -score, query)) if score.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (query[i], -score[i], ids[i])))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        keep = rank < self.k
        self.top = query[keep], score[keep], ids[keep]
        last = rank == self.k - 1
        self.kth[query[last]] = np.maximum(self.kth[query[last]], score[last])


def _numbers(cells: np.ndarray, most: float | None = None) -> np.ndarray:
    """Whole numbers in the narrowest form where every sum of products stays exact, by the largest magnitude ``most`` of
    all vectors: floats of either width, else Python integers."""
    whole = np.floor(cells * SCALE)
    most = (float(np.abs(whole).max()) if whole.size else 0.0) if most is None else most
    room = most * most * max(1, whole.shape[1])
    return whole.astype(np.float32) if room < _NARROW else whole if room < _EXACT else np.vectorize(int, otypes=[object])(whole)


def _block_writer(rows: int, folder: str):
    """Packs sorted rows (place, id, vector) into block files of one vector length and, if it has enough rows, one pivot;
    yields path, dims, n and the block's largest and smallest values."""

    def written(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part, number = TaskContext.get().partitionId(), 0

        def close() -> pa.RecordBatch:
            cells = np.array([h[2] for h in held], "<f8")
            lists = SortedLists(np.array([h[1] for h in held], "<i8"), np.floor(cells * SCALE))
            path = f"{folder}/block-{part:06d}-{number:06d}"
            write_file(path, lists.to_bytes(cells))
            return pa.RecordBatch.from_pydict({"path": [path], "dims": pa.array([cells.shape[1]], pa.int32()), "n": pa.array([len(cells)], pa.int64()), "high": [lists.high.tobytes()], "low": [lists.low.tobytes()]})

        for batch in found:
            for place, i, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held[0][2]) != len(cells) or len(held) == rows or (held[0][0] != place and 4 * len(held) >= rows)):
                    yield close()
                    held, number = [], number + 1
                held.append((place, i, cells))
        if held:
            yield close()

    return written


class Groups:
    """Blocks dealt to groups of about ``rows`` rows of one vector length, with the bound of each for a query."""

    def __init__(self, blocks: list, rows: int):
        self.members: list[list[int]] = []
        self.paths = [b["path"] for b in blocks]
        self.dims = np.array([b["dims"] for b in blocks], np.int64)
        self.high, self.low = ([np.frombuffer(b[x], "<f8") for b in blocks] for x in ("high", "low"))
        held = 0
        for i, b in enumerate(blocks):
            if not self.members or held >= rows or self.dims[self.members[-1][0]] != b["dims"]:
                self.members.append([])
                held = 0
            self.members[-1].append(i)
            held += b["n"]
        self.group = np.repeat(np.arange(len(self.members)), [len(m) for m in self.members])
        self.most = max([float(max(np.abs(h).max(), np.abs(w).max())) for h, w in zip(self.high, self.low, strict=True)], default=0.0)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups for queries of one length, and (queries, groups): no row of the group can score more."""
        at = np.flatnonzero(self.dims == queries.shape[1])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros((len(queries), 0))
        high, low = np.stack([self.high[i] for i in at], axis=1), np.stack([self.low[i] for i in at], axis=1)
        each = np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low
        heads = np.flatnonzero(np.diff(self.group[at], prepend=-1))
        return self.group[at][heads], np.maximum.reduceat(each, heads, axis=1)


def _router(shared, first: bool):
    """Sends each query (query_id, cells, floor) to its most promising group, or to all others that can beat its floor."""

    def routed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for batch in found:
            size = batch.column(1).value_lengths().to_numpy()
            out: list[tuple[int, int]] = []
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                queries = np.floor(np.array([batch.column(1)[int(i)].as_py() for i in at], float) * SCALE)
                names, bounds = groups.bounds(queries)
                if not len(names):
                    continue
                best = bounds.argmax(axis=1)
                if first:
                    out += zip(at.tolist(), names[best].tolist(), strict=True)
                    continue
                floor = np.array([-np.inf if batch.column(2)[int(i)].as_py() is None else batch.column(2)[int(i)].as_py() for i in at])
                may = bounds * (1 + 1e-12) + 1e-6 >= floor[:, None]  # the bound's own rounding
                may[np.arange(len(at)), best] = False
                q, g = np.nonzero(may)
                out += zip(at[q].tolist(), names[g].tolist(), strict=True)
            rows = pa.array([q for q, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array([g for _, g in out], pa.int64())], ["query_id", "cells", "floor", "g"])

    return routed


def _searcher(shared, k: int, together: int = 512):
    def searched(group: pa.Table) -> pa.Table:
        groups = shared.value
        numbers = lambda cells: _numbers(cells, groups.most)
        own = group.column("query_id").to_numpy()
        asked = numbers(np.array(group.column("cells").to_pylist(), float))
        floor = np.array([-np.inf if x is None else x for x in group.column("floor").to_pylist()], float)
        if asked.dtype == object:  # sums beyond 53 bits: what the floor lost by rounding is given back
            floor = (floor - np.abs(floor) * 1e-12).astype(object)
        members = groups.members[group.column("g")[0].as_py()]
        out = [pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})]
        searches = [Search(asked[a : a + together], own[a : a + together], k, floor[a : a + together]) for a in range(0, len(own), together)]
        bound = np.max([np.maximum(asked, 0) @ numbers_of(groups.high[i], asked) + np.minimum(asked, 0) @ numbers_of(groups.low[i], asked) for i in members], axis=1)
        for i in np.argsort(-bound.astype(float), kind="stable"):  # the most promising first, whose scores spare the others
            with open_file(groups.paths[members[i]]) as f:
                block = SortedLists.from_bytes(f.read(), numbers)
            for x in searches:
                x.over(block)
        for x in searches:
            query, score, ids = x.top
            out.append(pa.table({"query_id": pa.array(x.own[query], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array([int(v) for v in score], pa.int64())}))
        return pa.concat_tables(out)

    return searched


def numbers_of(values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whole values in the form of others."""
    return np.array([int(v) for v in values], object) if like.dtype == object else values.astype(like.dtype)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int | None = None, group: int = 65_536, pivots: int = 64, batch: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, the ``k`` highest integer inner
    products with all other rows (all, if fewer); ties go to the smaller vec_id.

    Vectors that are null or hold null, NaN or infinite components, empty ones and null ids take no part. Every row is a
    candidate, repeated ones as often as they stand there; rows of a query's own id are never its candidates, and an id
    with several vectors is one query with the scores of all its vectors. Vectors of different lengths have no product
    and aren't paired. Other columns, whatever their names, play no part. An empty table gives an empty one.

    All rows are sorted once: those near one of a bounded number of ``pivots`` (the first by hash) share blocks, each
    written with its sorted lists. A query goes to the group of blocks with the highest bound first; its k-th score
    there is the floor that decides which other groups it is sent to at all, and in a group which blocks and how much of
    their lists are read. Only queries are shuffled, each group's tasks read its blocks from the shared folder. Of the
    blocks the driver holds largest and smallest values alone; blocks grow with the table, so that there are a few thousand.
    """
    spark = vectors.sparkSession
    batches(spark)
    cells = F.col("embedding").cast("array<double>")
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.exists(cells, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.size("embedding") > 0)
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), cells.alias("cells"))
    total, chosen = rows.count(), rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # bounded by the parameter
    lengths = {len(r["cells"]) for r in chosen}
    near_to = {d: np.array([r["cells"] for r in chosen if len(r["cells"]) == d]) for d in lengths}

    def placed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in found:
            size, out = x.column(1).value_lengths().to_numpy(), np.zeros(x.num_rows, np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                own = np.array([x.column(1)[int(i)].as_py() for i in at], float)
                out[at] = int(d) * 1_000_000 + ((own @ near_to[int(d)].T).argmax(axis=1) if int(d) in near_to else 0)
            yield pa.RecordBatch.from_arrays([pa.array(out), *x.columns], ["place", "vec_id", "cells"])

    block = block or min(65_536, max(1024, total // 4096))
    folder = new_path(spark, "vector-blocks")
    dealt = rows.mapInArrow(placed, "place long, vec_id long, cells array<double>").repartitionByRange(max(1, -(-total // (16 * block))), "place", "vec_id").sortWithinPartitions("place", "vec_id")
    written = materialize(dealt.mapInArrow(_block_writer(block, folder), "path string, dims int, n long, high binary, low binary"), "blocks")
    groups = Groups(written.orderBy("dims", "path").collect(), group)
    shared = spark.sparkContext.broadcast(groups)
    asked = rows.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "cells")
    parts = max(1, -(-total // (every * batch)))

    def found_in(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.mapInArrow(_router(shared, first), "query_id long, cells array<double>, floor double, g long")
        dealt = sent.withColumn("p", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        return materialize(dealt.groupBy("g", "p").applyInArrow(_searcher(shared, k), "query_id long, vec_id long, score long"), "found")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = found_in(asked.withColumn("floor", F.lit(None).cast("double")), True)
    if len(groups.members) > 1:
        floors = best(found).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
        found = found.union(found_in(asked.join(floors, "query_id", "left"), False))
    return best(found).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
