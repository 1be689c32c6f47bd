"""Exact top-k by inner product over a pivot-distance index.

Every vector x gets one more component, sqrt(M - |x|^2), with M the largest
squared norm, and a query gets 0 there. Then the squared distance of the two is
|q|^2 + M - 2 q.x: the highest inner products are the nearest vectors, and the
triangle inequality holds.

The index keys a vector by its nearest pivot and its distance from it. Around a
pivot, distances are cut into annuli and annuli into tiles. A vector at distance
d from pivot p is at least |d(q, p) - d| away from a query q, which gives each
annulus a bound, and each query opens annuli in the order of theirs. The first
ones, enough to hold k vectors, give a radius within which its answers must lie;
some more make it smaller; then it opens the rest that the radius reaches and
stops. In an open annulus only the distances within reach are scored. Queries
stop one by one: those that open the same annulus meet there, in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logtide.llm.common import ship_package
from logtide.sources.storage import settled

#: Fewest and most pivots, annuli of a pivot from which there are more pivots, and
#: the vectors (first in a random order) they are chosen from.
PIVOTS = 16
MOST_PIVOTS = 256
PIVOT_ANNULI = 16
PIVOT_SAMPLE = 2_000
#: Vectors of an annulus and of a tile, about; annuli of the whole index at most.
TILE_ROWS = 2_048
MOST_ANNULI = 4_096
#: Tiles' worth of vectors a query opens to make its radius smaller.
SECOND_TILES = 4
#: Queries that meet a tile together, about.
BLOCK_ROWS = 256
#: Rows that go through a step of numpy together.
STEP_ROWS = 256

#: Sums below this are exact in doubles.
_EXACT = 2.0**52
#: Below every score.
_LEAST = -(2**63)


@dataclass(frozen=True)
class Index:
    """What tasks need to know of the index; of bounded size."""

    dim: int
    longest: float  # the largest squared norm
    pivots: np.ndarray  # with the additional component
    pivot: np.ndarray  # of each annulus: its pivot, smallest and largest distance, vectors
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def exact(self, norms: np.ndarray) -> np.ndarray:
        """Whether doubles hold the scores of queries of these squared norms."""
        return (norms < _EXACT) & (self.longest < _EXACT)

    def query_distances(self, queries: np.ndarray) -> np.ndarray:
        plain = queries.astype(float)
        flat = np.concatenate([plain, np.zeros((len(plain), 1))], axis=1)
        return _distances(flat, self.pivots)

    def opening_order(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query all annuli, and what the triangle inequality leaves possible in them.

        By that bound; where it is the same, the annulus of the nearer pivot first.
        """
        at = self.query_distances(queries)[:, self.pivot]
        least = np.maximum(0.0, np.maximum(at - self.high, self.low - at))
        order = np.lexsort((at, least), axis=1)
        return order, np.take_along_axis(least, order, axis=1)

    def radius(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far a vector of at least these scores can be, and what rounding adds."""
        norms = (queries.astype(float) ** 2).sum(axis=1)
        slack = 1e-6 * (1.0 + np.sqrt(norms + self.longest))
        reach = np.sqrt(np.maximum(0.0, norms + self.longest - 2.0 * scores)) + slack
        return np.where(self.exact(norms), reach, np.inf)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, by norms and a matrix product."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, squares))


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all of them equally long."""
    plain = vectors.astype(float)
    more = np.sqrt(np.maximum(0.0, longest - (plain**2).sum(axis=1)))
    return np.concatenate([plain, more[:, None]], axis=1)


def _scores(queries: np.ndarray, vectors: np.ndarray, index: Index) -> np.ndarray:
    """Integer inner products; beyond 53 bits by Python's integers, held to 64 bits."""
    wanted = queries.astype(float)
    if index.exact((wanted**2).sum(axis=1)).all():
        return (wanted @ vectors.T.astype(float)).astype(np.int64)
    wide = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(wide, _LEAST, 2**63 - 1).astype(np.int64)


def scaled(rows: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """``(id, vec)`` of the rows that take part: components times ``scale``, rounded down.

    Rows with a null key or vector, or with a component that is null, infinite
    or no number, take no part. Repeated rows count once.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    whole = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    return (
        rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & usable)
        .select(F.col(key).cast("long").alias("id"), whole.alias("vec"))
        .distinct()
    )


def _choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors far from each other, then moved to the middle of those nearest to them."""
    chosen = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen]
    for _ in range(4):
        own = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack(
            [sample[own == i].mean(axis=0) if (own == i).any() else p for i, p in enumerate(pivots)]
        )
    return pivots


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _filled(dim: int) -> Column:
    """Vectors of ``dim`` components: missing ones count as 0, as do those no vector has."""
    zeros = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(dim) - F.size("vec"), F.lit(0)))
    return F.concat(F.slice("vec", 1, dim), zeros)


def build_index(rows: DataFrame) -> tuple[Index, DataFrame, DataFrame] | None:
    """The index of ``(id, vec)`` rows: its directory, its tiles in shared storage, tiles by place.

    Pivots come from a bounded sample, which no result depends on. Quantiles of
    the distances cut the vectors around a pivot into annuli of about
    ``TILE_ROWS``; one that got more, as equal distances can't be cut, has
    several tiles. None if there are no vectors.
    """
    spark = rows.sparkSession
    ship_package(spark)
    norm = F.aggregate("vec", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x)
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.max(norm).alias("longest")
    ).first()
    if not facts["n"]:
        return None
    dim, longest = max(1, facts["dim"]), facts["longest"]
    rows = rows.select("id", _filled(dim).alias("vec"))
    first = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(PIVOT_SAMPLE).select("vec").collect()
    sample = _lifted(np.array([r["vec"] for r in first], dtype=np.int64), longest)
    wanted = min(MOST_PIVOTS, max(PIVOTS, facts["n"] // (PIVOT_ANNULI * TILE_ROWS)))
    pivots = _choose_pivots(sample, wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STEP_ROWS):
                step = batch.slice(first, STEP_ROWS)
                away = _distances(_lifted(_matrix(step.column(1), dim), longest), pivots)
                nearest = away.argmin(axis=1).astype(np.int32)
                columns = [*step.columns, pa.array(nearest), pa.array(away.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "pivot", "away"])

    placed = rows.mapInArrow(place, "id long, vec array<long>, pivot int, away double")
    placed = settled(spark, placed, "topk-placed")

    # Ends of annuli, by pivot: a bounded number of distances.
    parts = min(MOST_ANNULI // len(pivots), max(1, facts["n"] // (len(pivots) * TILE_ROWS)))
    quantiles = F.array(*[F.lit((i + 1) / parts) for i in range(parts)])
    cut = placed.groupBy("pivot").agg(F.percentile_approx("away", quantiles, 20 * parts).alias("ends"))
    ends = {r["pivot"]: sorted(set(r["ends"])) for r in cut.collect()}
    by_pivot = F.lit([[float(e) for e in ends.get(p, [math.inf])][:-1] or [math.inf] for p in range(len(pivots))])
    annulus = F.col("pivot") * MOST_ANNULI + F.size(
        F.filter(F.get(by_pivot, F.col("pivot")), lambda end: end < F.col("away"))
    )
    placed = placed.withColumn("annulus", annulus)
    directory = (
        placed.groupBy("annulus")
        .agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("rows"))
        .withColumn("tiles", F.ceil(F.col("rows") / TILE_ROWS).cast("int"))
    )
    directory = settled(spark, directory, "topk-annuli")
    tiles = (
        placed.join(F.broadcast(directory.select("annulus", "tiles")), "annulus")
        .withColumn("tile", F.pmod(F.xxhash64("id", "vec"), F.col("tiles")))
        .groupBy("annulus", "tile")
        .agg(F.sort_array(F.collect_list(F.struct("away", "id", "vec"))).alias("members"))
    )
    tiles = settled(spark, tiles, "topk-tiles")
    known = directory.orderBy("annulus").collect()
    columns = {c: np.array([r[c] for r in known]) for c in ("annulus", "low", "high", "rows", "tiles")}
    index = Index(
        dim,
        longest,
        pivots,
        columns["annulus"] // MOST_ANNULI,
        columns["low"],
        columns["high"],
        columns["rows"],
    )
    places = [(int(a), i, int(t)) for i, (a, t) in enumerate(zip(columns["annulus"], columns["tiles"], strict=True))]
    numbers = spark.createDataFrame(places, "annulus long, place int, tiles int")
    tiles = tiles.join(F.broadcast(numbers.drop("tiles")), "annulus").select("place", "tile", "members")
    return index, tiles, numbers.drop("annulus")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _opened(queries: DataFrame, index: Index, limit: int | None) -> DataFrame:
    """The next annuli of each query, as ``places``, and how many it has ``seen`` with them.

    ``queries`` has ``query, query_id, vec``, a score ``bound`` that its answers
    reach at least, and the annuli ``seen`` so far, the first ones of its order.
    It goes on while the bounds are within reach and what it opens holds
    ``limit`` vectors at most before the last of them.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, STEP_ROWS):
                step = batch.slice(first, STEP_ROWS)
                vectors = _matrix(step.column("vec"), index.dim)
                order, least = index.opening_order(vectors)
                reach = index.radius(vectors, step.column("bound").to_numpy())
                seen = step.column("seen").to_numpy()
                end = (least <= reach[:, None]).sum(axis=1)
                if limit is not None:
                    held = np.zeros((len(order), order.shape[1] + 1), np.int64)
                    held[:, 1:] = index.rows[order].cumsum(axis=1)
                    before = held[np.arange(len(order)), seen]
                    end = np.minimum(end, (held[:, :-1] - before[:, None] <= limit).sum(axis=1))
                end = np.maximum(end, seen)
                places = [line[a:b] for line, a, b in zip(order, seen, end, strict=True)]
                offsets = np.concatenate([[0], np.cumsum(end - seen)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *places]).astype(np.int32)
                columns = [
                    *[step.column(c) for c in ("query", "query_id", "vec", "bound")],
                    pa.array(end.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["query", "query_id", "vec", "bound", "seen", "places"]
                )

    return queries.select("query", "query_id", "vec", "bound", "seen").mapInArrow(
        opened, "query long, query_id long, vec array<long>, bound long, seen int, places array<int>"
    )


def _meetings(opened: DataFrame, tiles: DataFrame, numbers: DataFrame, block_rows: int) -> DataFrame:
    """Rows of a tile's ``members`` and a batch of the ``queries`` that opened its annulus.

    Batches are dealt by hash, as many as the number of queries at an annulus
    needs, and go to each of its tiles by (annulus, tile): an annulus that all
    queries open, or that a third of all vectors are in, is many tasks.
    """
    visits = opened.select("query", "query_id", "bound", "vec", F.explode("places").alias("place"))
    asked = visits.groupBy("place").agg(F.ceil(F.count("*") / block_rows).alias("batches"))
    batch = F.pmod(F.xxhash64("query"), F.col("batches"))
    # A row per annulus, of which there are ``MOST_ANNULI`` at most.
    batches = (
        visits.join(F.broadcast(asked), "place")
        .groupBy("place", batch.alias("batch"))
        .agg(F.collect_list(F.struct("query", "query_id", "bound", "vec")).alias("queries"))
        .join(F.broadcast(numbers), "place")
    )
    each = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("tiles") - 1).cast("long")))
    return batches.select("place", "queries", each.alias("tile")).join(tiles, ["place", "tile"])


def _search(meetings: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query, query_id, vec_id, score)``: the best of each tile for each query that meets it.

    A tile's members are in the order of their distances, and are scored in
    steps: each against the queries that reach into it. A row with the query -1
    has the number of pairs scored for its score.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                place = batch.column("place")[row].as_py()
                members = batch.column("members")[row].values
                queries = batch.column("queries")[row].values
                away, ids = (members.field(c).to_numpy() for c in ("away", "id"))
                vectors = _matrix(members.field("vec"), index.dim)
                wanted = _matrix(queries.field("vec"), index.dim)
                numbers, own, bounds = (queries.field(c).to_numpy() for c in ("query", "query_id", "bound"))
                reach = index.radius(wanted, bounds)
                at = index.query_distances(wanted)[:, index.pivot[place]]
                first = np.searchsorted(away, at - reach, "left")
                last = np.searchsorted(away, at + reach, "right")
                scores = np.full((len(own), len(ids)), _LEAST, np.int64)
                scored = 0
                for start in range(0, len(ids), STEP_ROWS):
                    end = min(start + STEP_ROWS, len(ids))
                    near = np.flatnonzero((first < end) & (last > start))
                    if len(near):
                        scores[near, start:end] = _scores(wanted[near], vectors[start:end], index)
                        scored += len(near) * (end - start)
                found = [([-1], [-1], [-1], [scored])]
                for i, (a, b) in enumerate(zip(first, last, strict=True)):
                    there = a + np.flatnonzero((ids[a:b] != own[i]) & (scores[i, a:b] >= bounds[i]))
                    there = there[_best(scores[i, there], ids[there], k)]
                    same = np.ones(len(there), np.int64)
                    found.append((numbers[i] * same, own[i] * same, ids[there], scores[i, there]))
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])

    return meetings.select("place", "members", "queries").mapInArrow(
        search, "query long, query_id long, vec_id long, score long"
    )


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    scale: int,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The answers of ``top_k``, and ``(round, pairs)``: the pairs scored in each round."""
    spark = rows.sparkSession
    vectors = settled(spark, scaled(rows, scale, key, vector), "topk-rows")
    built = build_index(vectors)
    if built is None:
        return (
            spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"),
            spark.createDataFrame([], "round int, pairs long"),
        )
    index, tiles, numbers = built
    asked = scaled(queries, scale, key, vector).select(
        F.monotonically_increasing_id().alias("query"),
        F.col("id").alias("query_id"),
        _filled(index.dim).alias("vec"),
        F.lit(_LEAST).cast("long").alias("bound"),
        F.lit(0).alias("seen"),
    )
    # Written, so the numbers of the queries hold.
    asked = settled(spark, asked, "topk-queries")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best, work = None, None
    limits = (k, SECOND_TILES * TILE_ROWS, None)
    for number, limit in enumerate(limits):
        opened = settled(spark, _opened(asked, index, limit), "topk-opened")
        meetings = _meetings(opened, tiles, numbers, block_rows)
        found = settled(spark, _search(meetings, index, k), "topk-found")
        done = found.where(F.col("query") < 0).select(F.lit(number).alias("round"), F.col("score").alias("pairs"))
        work = done if work is None else work.unionByName(done)
        answers = found.where(F.col("query") >= 0)
        answers = answers if best is None else answers.unionByName(best)
        best = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if limit is None:
            break
        best = settled(spark, best.drop("rank"), "topk-best")
        # Fewer than k found: any score may be among the answers.
        bound = F.when(F.count("*") >= k, F.min("score")).alias("bound")
        asked = opened.drop("bound", "places").join(best.groupBy("query").agg(bound), "query", "left")
        asked = asked.withColumn("bound", F.coalesce("bound", F.lit(_LEAST).cast("long")))
    answers = best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return answers, work.groupBy("round").agg(F.sum("pairs").alias("pairs"))


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    scale: int,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the k highest inner products.

    Vectors are taken as integers (``scaled``). Candidates are all rows but
    those of the query's own key; ties go to the smaller key; a query with fewer
    candidates gets all. Rows with nulls or components that are not finite take
    no part, repeated rows count once, vectors that are shorter than the longest
    are filled up with 0, and empty tables give no rows. A vector a third of all
    rows share fills tiles of its own, each of which gives k rows to a query at
    most. Nothing but annulus bounds and pivots reaches the driver.
    """
    return search(rows, queries, k, scale, key, vector, block_rows)[0]
