"""Approximate nearest neighbours by inner product with balanced posting lists.

Centroids come from a balanced split of a bounded sample. A vector is posted to its nearest centroid and, if it lies near a
boundary, to others about as near; a query reads the lists whose centroids are within a ratio of the nearest one's distance.
Both find their centroids in a navigable graph that every task holds in memory. The largest inner product is the least
distance once vectors get one more component that makes all of them equally long.

The ratio is not guessed: a bounded sample of queries is answered exactly, by reading all vectors, and the ratio is the least
one at which the lists hold the wanted share of those answers. Equal vectors are one entry of the index, with as many of their
ids as an answer can hold; equal queries are asked once. Lists are read in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm import common

K = 20
#: Vectors that a list holds on average, as long as the centroids fit.
LIST = 512
#: The sample that centroids are fitted on has at most so many numbers, so the driver and each task hold at most half as many for the centroids.
SAMPLE_VALUES = 8_000_000
#: Lists that a task can search at once; beyond, lists grow.
MOST_LISTS = 1 << 14
#: Vectors that the sample holds for each centroid at least.
PER_CENTROID = 16
#: Lists that a vector is posted to at most, and how near a boundary it lies for that.
REPLICAS, BOUNDARY = 4, 0.05
#: Members of a block of a list, and queries that are held against it at once.
BLOCK, BATCH = 4096, 512
#: Lists that a query reads in the first round, and how many times as many it has read after each later one. A round passes on only what
#: beats the k best of those before, so what is passed on follows the rounds and not the lists.
FIRST, GROWTH = 4, 8
#: Queries answered exactly to set the ratio, and the share of their answers that the lists must hold.
PROBED, TARGET = 200, 0.97
#: Neighbours of a centroid in the graph, and centroids that a search keeps open at least.
DEGREE, OPEN = 16, 32


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from binary values; shorter vectors end in zeros."""
    values = column.to_pylist()
    if all(len(v) == 8 * dim for v in values):
        return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), dim)
    return np.stack([np.pad(np.frombuffer(v, dtype=np.float64), (0, dim - len(v) // 8)) for v in values])


def balanced(sample: np.ndarray, parts: int, rounds: int = 4) -> np.ndarray:
    """Means of `parts` parts of equal size: each part is split along the line between its two means, at the rank that its
    number of centroids asks for."""
    if parts <= 1 or len(sample) <= 1:
        return sample.mean(axis=0, keepdims=True)
    left = parts // 2
    cut = max(1, min(len(sample) - 1, round(len(sample) * left / parts)))
    spread = sample - sample.mean(axis=0)
    axis = spread[np.argmax((spread**2).sum(axis=1))]
    for _ in range(rounds):
        order = np.argsort(spread @ axis, kind="stable")
        axis = spread[order[:cut]].mean(axis=0) - spread[order[cut:]].mean(axis=0)
    order = np.argsort(spread @ -axis, kind="stable")
    return np.concatenate([balanced(sample[order[:cut]], left, rounds), balanced(sample[order[cut:]], parts - left, rounds)])


class Graph:
    """Centroids with links to near ones in different directions, searched from one entry for many vectors at a time."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE) -> None:
        self.at = centroids
        self.square = (centroids**2).sum(axis=1)
        n = len(centroids)
        self.entry = int(np.argmin(((centroids - centroids.mean(axis=0)) ** 2).sum(axis=1)))
        near = min(n - 1, 3 * degree)
        links = [set() for _ in range(n)]
        for begin in range(0, n, 1024):
            d = self.square[None, :] - 2 * centroids[begin : begin + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(begin, begin + len(d))] = np.inf
            for row, order in enumerate(np.argsort(d, axis=1, kind="stable")[:, :near]):
                self._link(links, begin + row, order, degree)
        for a in range(n):  # both ways, and every centroid can be reached along the chain of the split
            for b in list(links[a]):
                links[b].add(a)
            if a:
                links[a].add(a - 1)
                links[a - 1].add(a)
        width = max((len(x) for x in links), default=0)
        self.links = np.full((n, max(1, width)), -1, dtype=np.int32)
        for a, x in enumerate(links):
            self.links[a, : len(x)] = sorted(x)

    def _link(self, links: list[set[int]], a: int, order: np.ndarray, degree: int) -> None:
        """The nearest first; one that lies nearer to a linked one than to a is left out."""
        kept: list[int] = []
        for b in order:
            if len(kept) == degree:
                break
            to_b = ((self.at[a] - self.at[b]) ** 2).sum()
            if not kept or ((self.at[kept] - self.at[b]) ** 2).sum(axis=1).min() >= to_b:
                kept.append(int(b))
        links[a].update(kept)

    def search(self, x: np.ndarray, ratio: float, least: int = OPEN, width: int = 4) -> np.ndarray:
        """Squared distances of the centroids met, infinite for others: a search goes on from each centroid within the ratio of
        the nearest, or among the `least` nearest."""
        n, rows = len(self.at), len(x)
        own = (x**2).sum(axis=1)
        met = np.full((rows, n), np.inf)
        met[:, self.entry] = np.maximum(0, own + self.square[self.entry] - 2 * x @ self.at[self.entry])
        open_ = np.full((rows, n), np.inf)
        open_[:, self.entry] = met[:, self.entry]
        busy = np.arange(rows)
        while len(busy):
            m, o = met[busy], open_[busy]
            bound = ratio**2 * m.min(axis=1)
            if least < n:
                bound = np.maximum(bound, np.partition(m, least - 1, axis=1)[:, least - 1])
            else:
                bound[:] = np.inf
            some = min(width, n)
            pick = np.argpartition(o, some - 1, axis=1)[:, :some]
            gain = np.take_along_axis(o, pick, axis=1)
            good = (gain <= bound[:, None]) & np.isfinite(gain)
            r, c = np.nonzero(good)
            open_[busy[r], pick[r, c]] = np.inf
            to = self.links[pick[r, c]]
            rr, cc = np.repeat(busy[r], to.shape[1]), to.ravel()
            new = cc >= 0
            rr, cc = rr[new], cc[new]
            new = np.isinf(met[rr, cc])
            rr, cc = rr[new], cc[new]
            if len(rr):
                key = np.unique(rr.astype(np.int64) * n + cc)
                rr, cc = key // n, key % n
                d = np.maximum(0, own[rr] + self.square[cc] - 2 * np.einsum("ij,ij->i", x[rr], self.at[cc]))
                met[rr, cc] = d
                open_[rr, cc] = d
            busy = busy[good.any(axis=1)]
        return met


def posted(met: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lists: the nearest centroid, and the next ones from whose bisecting plane with it the vector is not farther than
    BOUNDARY of the distance between the two."""
    some = min(REPLICAS, met.shape[1])
    order = np.argpartition(met, some - 1, axis=1)[:, :some]
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(met, order, axis=1), axis=1, kind="stable"), axis=1)
    d = np.take_along_axis(met, order, axis=1)
    apart = ((at[order] - at[order[:, :1]]) ** 2).sum(axis=2)
    near = np.isfinite(d) & (d - d[:, :1] <= 2 * BOUNDARY * apart)
    near[:, 0] = True
    rows, k = np.nonzero(near)
    return rows, order[rows, k]


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all have the length of the longest."""
    return np.hstack([x, np.sqrt(np.maximum(0, longest**2 - (x**2).sum(axis=1)))[:, None]])


def _asked(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries of that length; their own length does not change the order of their neighbours."""
    return np.hstack([x * (longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, packed (a binary of doubles), h1, h2 of the rows that take part."""
    numbers = F.col(vector).cast("array<double>")
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), numbers.alias("v")).where(F.col("v").isNotNull() & F.forall("v", plain) & F.exists("v", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            raw = (lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0).tobytes()  # no negative zeros
            ends = 8 * np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([raw[p:q] for p, q in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["vec_id", "packed"])

    packed = kept.mapInArrow(pack, "vec_id long, packed binary")
    return packed.select("vec_id", "packed", F.xxhash64("packed").alias("h1"), F.xxhash64(F.lit("v"), "packed").alias("h2"))


def _entries(rows: DataFrame, k: int, asked: Column) -> DataFrame:
    """One row for each distinct vector: h1, h2, packed, ids (the k + 1 least, null last), low (the least) and whether it is a query."""
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    entry = few.groupBy("h1", "h2").agg(F.min("packed").alias("packed"), F.transform(F.sort_array(F.collect_set(F.struct("rank", "vec_id"))), lambda r: r["vec_id"]).alias("ids"))
    asked_for = rows.where(asked).select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    return entry.join(asked_for, ["h1", "h2"], "left").select("h1", "h2", "packed", "ids", F.element_at("ids", 1).alias("low"), F.coalesce("asked", F.lit(False)).alias("asked"))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in one order whatever stands around them."""
    return np.add.reduce(x * y, axis=1)


def _best(queries: np.ndarray, members: np.ndarray, low: np.ndarray, k: int, bars: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best members that reach its bar, ties by least id, and their scores."""
    rough = queries @ members.T
    for q in range(len(queries)):
        bar = -np.inf if bars is None else bars[q]
        if len(members) > k:
            bar = max(bar, np.partition(rough[q], len(members) - k)[len(members) - k])
        near = np.nonzero(rough[q] >= bar - 1e-9 * (1 + abs(bar)))[0] if np.isfinite(bar) else np.arange(len(members))
        if len(near):
            score = _exact(np.broadcast_to(queries[q], (len(near), queries.shape[1])), members[near])
            order = np.lexsort((low[near], -score))[:k]
            yield q, near[order], score[order]


_FOUND = "q1 long, q2 long, h1 long, h2 long, low long, score double"


def _pack_found(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.float64()]
    cols = [np.concatenate([np.atleast_1d(r[k]) if k > 1 else np.full(len(r[5]), r[k]) for r in rows]) for k in range(6)]
    low = pa.array(cols[4], pa.int64(), mask=cols[4] == _NO_ID)
    return pa.RecordBatch.from_arrays([low if k == 4 else pa.array(c, t) for k, (c, t) in enumerate(zip(cols, types, strict=True))], ["q1", "q2", "h1", "h2", "low", "score"])


#: Stands for a null id in arrays: it comes last among ties.
_NO_ID = np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([_NO_ID if v is None else v for v in column.to_pylist()], dtype=np.int64)


def _read_lists(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of lists pass by, members (side 0) ahead of the queries (side 1) that read them."""
    key, parts, members, low, h1, h2 = None, [], None, None, None, None
    for batch in batches:
        where = list(zip(batch.column("list").to_pylist(), batch.column("block").to_pylist(), batch.column("side").to_pylist(), strict=True))
        cuts = [0, *[i for i in range(1, len(where)) if where[i] != where[i - 1]], len(where)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            here = batch.slice(begin, end - begin)
            if where[begin][:2] != key:
                key, parts, members = where[begin][:2], [], None
            x, a, b = _vectors(here.column("packed"), dim), here.column("h1").to_numpy(), here.column("h2").to_numpy()
            if where[begin][2] == 0:
                parts.append((x, _ids(here.column("low")), a, b))
                continue
            if members is None:
                if not parts:
                    continue
                members, low, h1, h2 = (np.concatenate(c) for c in zip(*parts, strict=True))
            bars = here.column("bar").to_numpy(zero_copy_only=False)
            bars = np.where(np.isnan(bars), -np.inf, bars)
            for at in range(0, len(x), BATCH):
                found = [(a[at + q], b[at + q], h1[near], h2[near], low[near], score) for q, near, score in _best(x[at : at + BATCH], members, low, k, bars[at : at + BATCH])]
                if found:
                    yield _pack_found(found)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query; an entry met in several lists counts once."""
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("low").asc_nulls_last(), "h1", "h2")
    return found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).dropDuplicates(["q1", "q2", "h1", "h2"])


class Index:
    """Posting lists over a table of vectors; `search` answers the rows that `asked` names."""

    def __init__(self, vectors: DataFrame, asked: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET, list_size: int = LIST) -> None:
        self.k, self.target = k, target
        self.rows = common.stored(usable(vectors, vec_id, vector), "vectors")
        self.asked = asked
        self.entries = common.stored(_entries(self.rows, k, asked), "entries")
        self.size, longest_row = self.entries.agg(F.count(F.lit(1)), F.max(F.octet_length("packed"))).first()
        if not self.size:
            return
        self.dim = longest_row // 8
        self.graph, self.longest = self._fit(list_size)
        self.postings = common.stored(self._posted(), "postings")
        counts = self.postings.groupBy("list").count().collect()  # one row for each centroid at most
        self.blocks = {r["list"]: -(-r["count"] // BLOCK) for r in counts}
        self.ratio = self._calibrated()

    def _fit(self, list_size: int) -> tuple[Graph, float]:
        """Centroids from the vectors with the least hashes, which are as good as random."""
        dim = self.dim

        def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(_vectors(b.column("packed"), dim), axis=1).max(initial=0))])], ["norm"])

        longest = self.entries.select("packed").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
        most = max(1, SAMPLE_VALUES // (dim + 1))
        lists = max(1, min(-(-self.size // list_size), most // PER_CENTROID, MOST_LISTS))
        wanted = min(self.size, lists * PER_CENTROID * 4, most)
        sample = self.entries.orderBy("h1", "h2").limit(wanted).select("packed").toArrow().column("packed").combine_chunks()
        return Graph(balanced(_lifted(_vectors(sample, dim), longest), min(lists, wanted))), longest

    def _posted(self) -> DataFrame:
        dim, longest, graph = self.dim, self.longest, self.entries.sparkSession.sparkContext.broadcast(self.graph)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, BATCH):
                    b = big.slice(at, BATCH)
                    x = _lifted(_vectors(b.column("packed"), dim), longest)
                    rows, lists = posted(graph.value.search(x, 1.0), graph.value.at)
                    kept = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *[kept.column(c) for c in ("h1", "h2", "low", "packed")]], ["list", "h1", "h2", "low", "packed"])

        return self.entries.select("h1", "h2", "low", "packed").mapInArrow(run, "list int, h1 long, h2 long, low long, packed binary")

    def _lists_of(self, ratio: float):
        """For a batch of queries: rows, lists within the ratio and the place of a list among its query's, nearest first."""
        dim, longest, graph = self.dim, self.longest, self.entries.sparkSession.sparkContext.broadcast(self.graph)

        def of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            met = graph.value.search(_asked(_vectors(b.column("packed"), dim), longest), ratio)
            rows, lists = np.nonzero(met <= (ratio * (1 + 1e-12)) ** 2 * met.min(axis=1)[:, None] + 1e-12)
            order = np.lexsort((lists, met[rows, lists], rows))
            rows, lists = rows[order], lists[order]
            return rows, lists, np.arange(len(rows)) - np.searchsorted(rows, rows)

        return of

    def _widest(self) -> int:
        """Lists that a query reads at most."""
        of = self._lists_of(self.ratio)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                most = max((int(of(big.slice(at, BATCH))[2].max(initial=-1)) + 1 for at in range(0, big.num_rows, BATCH)), default=0)
                yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], ["most"])

        return self.entries.where("asked").select("packed").mapInArrow(run, "most long").agg(F.max("most")).first()[0] or 0

    def _probes(self, queries: DataFrame, begin: int, end: int) -> DataFrame:
        """list, block, h1, h2, bar, packed of queries for each block of the lists that they read from place begin to end."""
        of, blocks = self._lists_of(self.ratio), self.blocks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, big.num_rows, BATCH):
                    b = big.slice(at, BATCH)
                    rows, lists, places = of(b)
                    here = (places >= begin) & (places < end)
                    rows, lists = rows[here], lists[here]
                    times = np.array([blocks.get(int(c), 0) for c in lists], dtype=int)
                    rows, lists = np.repeat(rows, times), np.repeat(lists, times)
                    part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, dtype=int)
                    kept = b.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(part, pa.int32()), *[kept.column(c) for c in ("h1", "h2", "bar", "packed")]], ["list", "block", "h1", "h2", "bar", "packed"])

        return queries.select("h1", "h2", "bar", "packed").mapInArrow(run, "list int, block int, h1 long, h2 long, bar double, packed binary")

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best entries of a bounded set of queries, from all entries in blocks."""
        dim = self.dim
        held = queries.select("h1", "h2", "packed").toArrow().combine_chunks()
        if not held.num_rows:
            return self.entries.sparkSession.createDataFrame([], _FOUND)
        q1, q2, x = held.column("h1").to_numpy(), held.column("h2").to_numpy(), _vectors(held.column("packed"), dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    members, low, h1, h2 = _vectors(b.column("packed"), dim), _ids(b.column("low")), b.column("h1").to_numpy(), b.column("h2").to_numpy()
                    yield _pack_found([(q1[q], q2[q], h1[near], h2[near], low[near], score) for q, near, score in _best(x, members, low, k)])

        return _first(self.entries.select("h1", "h2", "low", "packed").mapInArrow(run, _FOUND), k)

    def sampled(self) -> DataFrame:
        return self.entries.where("asked").orderBy("h1", "h2").limit(PROBED)

    def _calibrated(self) -> float:
        """The least ratio at which the sampled queries' lists hold the wanted share of their exact answers."""
        truth = common.stored(self.exact(self.sampled(), self.k + 1), "exact-answers")
        held = truth.join(self.postings.select("h1", "h2", "list"), ["h1", "h2"]).groupBy("q1", "q2", "h1", "h2").agg(F.collect_list("list").alias("lists"))
        asked = held.join(self.entries.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "packed"), ["q1", "q2"]).select("packed", "lists").toArrow().combine_chunks()
        if not asked.num_rows:
            return 1.0
        x = _asked(_vectors(asked.column("packed").combine_chunks(), self.dim), self.longest)
        at = self.graph.at
        d = np.maximum(0, (x**2).sum(axis=1)[:, None] + self.graph.square[None, :] - 2 * x @ at.T)
        nearest = np.sqrt(np.maximum(d.min(axis=1), 1e-24))
        needed = np.array([np.sqrt(d[i, lists].min()) for i, lists in enumerate(asked.column("lists").to_pylist())]) / nearest
        return float(max(1.0, np.sort(needed)[min(len(needed) - 1, int(np.ceil(self.target * len(needed))))]))

    def _round(self, best: DataFrame | None, begin: int, end: int) -> DataFrame:
        """The best entries of all queries after their lists from place begin to end."""
        k, dim, asked = self.k, self.dim, self.entries.where("asked").select("h1", "h2", "packed")
        if best is None:
            asked = asked.withColumn("bar", F.lit(None).cast("double"))
        else:
            bars = best.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("bar"))
            asked = asked.join(bars, ["h1", "h2"], "left")
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in sorted(self.blocks.items()) for x in p]), F.col("list")), F.lit(1))
        members = self.postings.select("list", F.pmod(F.col("h1"), parts).cast("int").alias("block"), F.lit(0).alias("side"), "h1", "h2", "low", F.lit(None).cast("double").alias("bar"), "packed")
        probes = self._probes(asked, begin, end).select("list", "block", F.lit(1).alias("side"), "h1", "h2", F.lit(None).cast("long").alias("low"), "bar", "packed")
        met = members.unionByName(probes).repartition("list", "block").sortWithinPartitions("list", "block", "side")
        found = met.mapInArrow(lambda b: _read_lists(b, dim, k + 1), _FOUND)
        return common.stored(_first(found if best is None else found.unionByName(best), k + 1).select("q1", "q2", "h1", "h2", "low", "score"), "best")

    def search(self) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found for each row that is asked for."""
        k = self.k
        if not self.size:
            return self.rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        best, begin, end, widest = self._round(None, 0, FIRST), FIRST, FIRST * GROWTH, self._widest()
        while begin < widest:
            best, begin, end = self._round(best, begin, end), end, end * GROWTH
        # Of a query's rows the first k + 1 are enough: its own is one of them at most.
        rows = best.join(self.entries.select("h1", "h2", "ids"), ["h1", "h2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
        nearest = Window.orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        rows = rows.withColumn("place", F.row_number().over(nearest.partitionBy("q1", "q2"))).where(F.col("place") <= k + 1)
        lists = rows.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
        asked = self.rows.where(self.asked).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
        others = F.slice(F.filter("near", lambda r: ~r["vec_id"].eqNullSafe(F.col("query_id"))), 1, k)
        out = asked.join(lists, ["q1", "q2"]).select("query_id", F.posexplode(others).alias("at", "r"))
        return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def nearest(vectors: DataFrame, k: int = K, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET, list_size: int = LIST) -> DataFrame:
    """The registered query: rows whose vec_id is divisible by 20 against all others.

    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of unequal length compare as if the
    shorter ones ended in zeros. Rows that share an id and a vector count once; with different vectors each is asked for, and no
    row with the query's id is an answer. A row without an id can be an answer, the last among ties. Ties go by vec_id. A table
    with no usable vector gives no rows, a query with no candidate none for it.
    """
    return Index(vectors, F.col("vec_id") % every == 0, k, vec_id, vector, target, list_size).search()
