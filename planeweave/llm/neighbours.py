"""Approximate nearest neighbours by balanced posting lists, for the largest inner product.

A coordinate is added to every vector that makes all norms equal, after which the largest inner product is the
least distance. Centroids come from balanced bisection of a bounded sample (``SAMPLE`` vectors, those whose hashed ids come
first) and are searched by a neighbourhood graph held in memory. Every vector is put in the list of its nearest centroid, and
near a boundary in up to ``REPLICAS`` lists: those within ``1 + BOUNDARY`` of the least distance that no chosen centroid
stands before. A query reads the lists whose centroids lie within a ratio of its least distance; the ratio
is found on the sample, as the least with which ``AIM`` of the true neighbours of sample queries lie in lists that are read. It
reads its nearest lists in any case until they hold ``REPLICAS`` times as many entries as a result can show, so that it finds as many as there are.

Lists that follow each other in the bisection, and so lie near each other, are shelved together, ``SHARD`` entries or so a shelf: a
vector is sent to a shelf once with the numbers of its lists there. In a shelf, a query is scored against the entries of its own
lists only.

Equal vectors are one entry with their smallest ids, as many as a result can show, so copies make no list
longer. A shelf of more than ``SHARD`` entries, or queries, is dealt out in parts. Scores are computed on the original
vectors in double precision, term by term from the first, so that equal products tie whichever shelf they come from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.llm.common import cut_lineage

SAMPLE, SHARD = 16_384, 4096
#: Lists are as many as the square root of the vectors, so that lists and centroids grow alike; at most this many.
MOST_LISTS = 4096
REPLICAS, BOUNDARY, DEGREE, BEAM = 4, 0.08, 16, 24
AIM, TRIALS = 0.97, 256
#: Distances computed at once.
PAIRS = 16_384
#: Queries scored at once in a shelf, and how far a blocked product may lie from one summed in order, against the lengths of its vectors.
SCORED, ROUNDING = 256, 1e-12


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` from those of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def bisect(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids of parts of ``x`` of equal size: each part is halved across the direction of two means."""
    done, open_ = [], [(np.arange(len(x)), k)]
    while open_:
        rows, n = open_.pop()
        if n <= 1 or len(rows) < 2:
            done.append(x[rows].mean(axis=0))
            continue
        part = x[rows]
        two = part[rng.choice(len(rows), 2, replace=False)]
        for _ in range(4):
            near = squared(part, two).argmin(axis=1)
            two = np.stack([part[near == i].mean(axis=0) if (near == i).any() else part[rng.integers(len(part))] for i in (0, 1)])
        order = np.argsort(part @ (two[1] - two[0]), kind="stable")
        left = n // 2
        cut = len(rows) * left // n
        open_ += [(rows[order[:cut]], left), (rows[order[cut:]], n - left)]
    return np.array(done)


@dataclass
class Graph:
    """Centroids with edges to their nearest and to some at random, by which all can be reached."""

    centroids: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, rng: np.random.Generator) -> Graph:
        k = len(centroids)
        near = np.argsort(squared(centroids, centroids) + np.diag(np.full(k, np.inf)), axis=1, kind="stable")[:, : min(DEGREE, k - 1)]
        ring = rng.permutation(k)
        after = np.empty(k, np.int64)
        after[ring] = np.roll(ring, -1)
        edges = np.concatenate([near, after[:, None], rng.integers(0, k, (k, 4))], axis=1)
        return Graph(centroids, edges, rng.choice(k, min(8, k), replace=False))

    def search(self, x: np.ndarray, ratio: float, beam: int = BEAM) -> np.ndarray:
        """Squared distances to the centroids that the search met, else infinity: at least the ``beam`` nearest it can reach
        and those within 1 + ``ratio`` of the least distance."""
        n, k = len(x), len(self.centroids)
        found, done = np.full((n, k), np.inf), np.zeros((n, k), bool)
        found[:, self.entries] = squared(x, self.centroids[self.entries])
        while True:
            bound = (1 + ratio) ** 2 * np.maximum(found.min(axis=1), 1e-300)
            if beam < k:
                bound = np.maximum(bound, np.partition(found, beam - 1, axis=1)[:, beam - 1])
            q, c = np.nonzero((found <= bound[:, None]) & ~done & np.isfinite(found))
            if not len(q):
                return found
            done[q, c] = True
            to = np.zeros((n, k), bool)
            to[np.repeat(q, self.edges.shape[1]), self.edges[c].ravel()] = True
            q, c = np.nonzero(to & ~np.isfinite(found))
            for i in range(0, len(q), PAIRS):
                a, b = q[i : i + PAIRS], c[i : i + PAIRS]
                off = x[a] - self.centroids[b]
                found[a, b] = np.einsum("ij,ij->i", off, off)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists that each vector is put in."""
        found = self.search(x, BOUNDARY)
        near = np.argsort(found, axis=1, kind="stable")[:, :BEAM]
        apart = squared(self.centroids, self.centroids)
        out = []
        for d, order in zip(found, near, strict=True):
            kept = [order[0]]
            for c in order[1:]:
                if len(kept) == REPLICAS or d[c] > (1 + BOUNDARY) ** 2 * d[order[0]]:
                    break
                if all(apart[c, o] >= d[c] for o in kept):
                    kept.append(c)
            out.append(np.array(kept))
        return out


def longer(x: np.ndarray, most: float) -> np.ndarray:
    """``x`` with the coordinate that makes the squared norms ``most``."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def fit_ratio(graph: Graph, plain: np.ndarray, most: float, k: int, rng: np.random.Generator) -> float:
    """The least ratio with which AIM of the ``k`` nearest of sample vectors lie in lists that are read."""
    trial = rng.choice(len(plain), min(TRIALS, len(plain)), replace=False)
    score = plain[trial] @ plain.T
    score[np.arange(len(trial)), trial] = -np.inf
    k = min(k, len(plain) - 1)
    if k < 1:
        return 0.0
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    query = np.concatenate([plain[trial], np.zeros((len(trial), 1))], axis=1)
    far = np.sqrt(squared(query, graph.centroids))
    far /= far.min(axis=1, keepdims=True)
    lists = {}
    for part in np.array_split(u := np.unique(best), len(u) // 256 + 1):
        lists |= dict(zip(part, graph.lists_of(longer(plain[part], most)), strict=True))
    need = np.sort([far[i, lists[b]].min() for i, row in enumerate(best) for b in row])
    return float(need[min(len(need) - 1, int(np.ceil(AIM * len(need))))] - 1) + 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _usable(vector: str, size: int) -> Column:
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == size) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each id divisible by ``every``: query_id, rank, vec_id, score of its ``k`` nearest found, ties to smaller ids.

    Vectors that are null, zero, not of the usual length, or hold a null or non-finite component take no part; nor do null ids. Of
    repeated rows with one id and vector, one takes part; an id with several vectors is found by each, and a query
    never finds its own id. With no usable vector there are no rows; further columns are left out.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = max(1, sizes[0].n) if sizes else 1
    rows = rows.where(_usable("v", size))
    show = k + 1  # one may be the query itself
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= show)
    entries = cut_lineage(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"))
    asked = cut_lineage(rows.where(F.col("id") % every == 0).distinct().join(entries.select("rep", "v"), "v").select(F.col("id").alias("query_id"), "rep"))
    n, most = entries.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)

    rng = np.random.default_rng(7)
    # at most SAMPLE vectors
    plain = _matrix(entries.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow().column(0), size)
    n_lists = max(1, min(MOST_LISTS, len(plain) // 4, round(n**0.5)))
    graph = Graph.build(bisect(longer(plain, most), n_lists, rng), rng)
    ratio = fit_ratio(graph, plain, most, k, rng)
    together = max(1, SHARD * n_lists // (2 * n))
    shared = spark.sparkContext.broadcast(graph)

    def chosen(x: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads; ``held`` is how many entries each list has."""
        x = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
        out = []
        for one, d in zip(x, shared.value.search(x, ratio), strict=True):
            within = np.flatnonzero(np.isfinite(d) & (d <= (1 + ratio) ** 2 * d.min()))
            if held[within].sum() < REPLICAS * show:  # an entry is in so many lists at most
                order = np.argsort(squared(one[None], shared.value.centroids)[0], kind="stable")
                within = np.union1d(within, order[: int(np.searchsorted(np.cumsum(held[order]), REPLICAS * show)) + 1])
            out.append(within)
        return out

    def dealt(batches: Iterable[pa.RecordBatch], held: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x = _matrix(part.column(1), size)
                lists = shared.value.lists_of(longer(x, most)) if held is None else chosen(x, held)
                at, shelves, numbers = [], [], []
                for j, u in enumerate(lists):
                    u = np.sort(u)
                    for mine in np.split(u, np.flatnonzero(np.diff(u // together)) + 1):
                        at.append(j)
                        shelves.append(int(mine[0]) // together)
                        numbers.append(mine.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(shelves, pa.int64()), pa.array(numbers, pa.list_(pa.int64())), *(c.take(pa.array(at)) for c in part.columns)], ["shelf", "lists", *part.schema.names])

    lists = cut_lineage(entries.mapInArrow(lambda it: dealt(it, None), "shelf long, lists array<bigint>, rep long, v array<double>, ids array<bigint>"))
    # a row a list, MOST_LISTS at most
    lengths = np.zeros(len(graph.centroids), np.int64)
    for r in lists.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        lengths[r["list"]] = r["count"]
    queries = entries.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    probes = cut_lineage(queries.mapInArrow(lambda it: dealt(it, lengths), "shelf long, lists array<bigint>, rep long, v array<double>"))
    parts = lists.groupBy("shelf").agg(F.ceil(F.count("*") / SHARD).alias("parts")).join(probes.groupBy("shelf").agg(F.ceil(F.count("*") / SHARD).alias("q_parts")), "shelf")
    # every part of a shelf meets every part of its queries
    put = lists.join(parts, "shelf").withColumn("part", F.pmod(F.xxhash64("rep"), "parts")).withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)))
    ask = probes.join(parts, "shelf").withColumn("q_part", F.pmod(F.xxhash64("rep"), "q_parts")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            reps, ids = left["rep"].to_numpy(), left["ids"].combine_chunks()
            x, y = _matrix(left["v"], size), _matrix(right["v"], size)
            first = int(left["shelf"][0].as_py()) * together
            # the lists of each entry, filled up with one that none reads
            own = np.full((len(x), REPLICAS), together)
            for i, u in enumerate(left["lists"].to_pylist()):
                own[i, : len(u)] = np.array(u) - first
            asked_lists = right["lists"].to_pylist()
            q_reps = right["rep"].to_numpy()
            longest = np.sqrt((x * x).sum(axis=1).max())
            for i in range(0, len(y), SCORED):
                block = y[i : i + SCORED]
                reads = np.zeros((len(block), together + 1), bool)
                for j, u in enumerate(asked_lists[i : i + SCORED]):
                    reads[j, np.array(u) - first] = True
                score = block @ x.T
                mine = reads[:, own[:, 0]]
                for r in range(1, REPLICAS):
                    mine |= reads[:, own[:, r]]
                score[~mine] = -np.inf
                least = np.partition(score, len(x) - show, axis=1)[:, len(x) - show] if len(x) > show else np.full(len(block), -np.inf)
                slack = ROUNDING * longest * np.sqrt((block * block).sum(axis=1))
                q, e = np.nonzero((score >= (least - slack)[:, None]) & np.isfinite(score))
                total = np.zeros(len(q))
                for d in range(size):
                    total += block[q, d] * x[e, d]
                order = np.lexsort((reps[e], -total, q))
                q, e, total = q[order], e[order], total[order]
                ends = np.searchsorted(q, np.arange(len(block) + 1))
                for j in np.unique(q):
                    rows = slice(ends[j], min(ends[j + 1], ends[j] + show))
                    out.append((int(q_reps[i + j]), reps[e[rows]].tolist(), total[rows].tolist(), ids.take(pa.array(e[rows])).to_pylist()))
        q, r, s, m = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "reps": pa.array(r, pa.list_(pa.int64())), "scores": pa.array(s, pa.list_(pa.float64())), "ids": pa.array(m, pa.list_(pa.list_(pa.int64())))})

    cut = ("shelf", "part", "q_part")
    near = put.select(*cut, "lists", "rep", "v", "ids").groupBy(*cut).cogroup(ask.select(*cut, "lists", "rep", "v").groupBy(*cut))
    near = near.applyInArrow(compared, "q long, reps array<bigint>, scores array<double>, ids array<array<bigint>>")

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query; each query's entries are merged as they come."""
        query, best, given = None, {}, []

        def end() -> None:
            if query is not None:
                flat = sorted((-s, i) for s, ids in best.values() for i in ids)[:show]
                given.append((query, [i for _, i in flat], [-s for s, _ in flat]))

        def told() -> pa.RecordBatch:
            q, i, s = zip(*given, strict=True) if given else ([], [], [])
            given.clear()
            return pa.record_batch({"rep": pa.array(q, pa.int64()), "ids": pa.array(i, pa.list_(pa.int64())), "scores": pa.array(s, pa.list_(pa.float64()))})

        for batch in batches:
            for q, reps, scores, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    end()
                    query, best = q, {}
                best.update(zip(reps, zip(scores, ids, strict=True), strict=True))
                if len(best) > 20 * show:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:show])
            yield told()
        end()
        yield told()

    top = near.repartition("q").sortWithinPartitions("q").mapInArrow(merged, "rep long, ids array<bigint>, scores array<double>")
    pairs = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id"))
    ranked = asked.join(top, "rep").select("query_id", F.posexplode(F.slice(pairs, 1, k)).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
