"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: the vectors' signs after learned rotations (iterative quantisation, fitted on a
bounded sample). A code is split into 8-bit substrings and each substring is indexed.
Two codes within Hamming radius r agree to floor(r / substrings) bits in at least one
substring (pigeonhole), so probing every substring value that near, in every index,
finds each code within r; its Hamming distance is then checked and its inner product
taken in double precision on the original vectors. The radius is the one that holds
TARGET of the sample's true neighbours at the table's density; no candidate is capped.
A query with fewer than k rows within the radius, as in sparse regions, is searched again
over all rows, so every query gets k rows, or all candidates if they are fewer.

Every row is indexed where it lies; queries go to the indexes in blocks of bounded size.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as query or candidate; neither do null ids. Rows that repeat an
id are candidates each, but never of a query with that id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column, saved

#: Rows that the rotations and the radius are fitted on, at most.
SAMPLE_ROWS = 4096
#: Queries that go out together, about.
QUERY_BLOCK = 4096
#: Vectors in one index.
INDEX_ROWS = 16384
ROTATIONS, TARGET, SEED = 4, 0.985, 7


def learn_rotations(sample: np.ndarray, count: int = ROTATIONS, rounds: int = 25, seed: int = SEED) -> np.ndarray:
    """Columns of `count` rotations, each bringing the sample close to sign vectors (alternating least squares)."""
    rng, found = np.random.default_rng(seed), []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(sample @ r >= 0, 1.0, -1.0).T @ sample)
            r = (u @ v).T
        found.append(r)
    return np.hstack(found)


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """One row of code bytes for each vector."""
    return np.packbits(vectors @ rotations >= 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of code rows a to the one code b."""
    pad = -a.shape[1] % 8
    if pad:
        a, b = np.pad(a, ((0, 0), (0, pad))), np.pad(b, (0, pad))
    words = np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)
    return np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def learn_radius(sample: np.ndarray, rotations: np.ndarray, rows: int, k: int, target: float = TARGET, queries: int = 256) -> int:
    """The Hamming radius that holds `target` of the k nearest in a table of `rows`, by the sample's neighbours of the same share."""
    n = len(sample)
    near = max(1, min(n - 1, round(k * n / max(rows, 1))))
    code, found = codes(sample, rotations), []
    if n < 2:
        return rotations.shape[1]
    for q in range(min(n, queries)):
        product = sample @ sample[q]
        product[q] = -np.inf
        found += distances(code, code[q])[np.argpartition(-product, near - 1)[:near]].tolist()
    return int(np.quantile(found, target)) + 1


class MultiIndex:
    """One index for each 8-bit substring of the codes: for every substring value, the rows within reach of it, as a bitmap."""

    def __init__(self, code: np.ndarray, radius: int):
        self.code, self.radius = code, radius
        reach = radius // code.shape[1]
        values = np.arange(256, dtype=np.uint8)
        within = np.bitwise_count(values[:, None] ^ values[None, :]) <= reach
        order = [np.argsort(code[:, j], kind="stable") for j in range(code.shape[1])]
        starts = [np.searchsorted(code[o, j], np.arange(257)) for j, o in enumerate(order)]
        self.tables = []
        for j in range(code.shape[1]):
            maps = np.zeros((256, -(-len(code) // 8)), np.uint8)
            for v in range(256):
                rows = order[j][starts[j][v] : starts[j][v + 1]]
                if len(rows):
                    one = np.zeros(maps.shape[1] * 8, np.uint8)
                    one[rows] = 1
                    maps[within[v]] |= np.packbits(one)
            self.tables.append(maps)

    def search(self, code: np.ndarray) -> np.ndarray:
        """All rows whose codes lie within the radius of code."""
        hit = np.bitwise_or.reduce([maps[code[j]] for j, maps in enumerate(self.tables)])
        rows = np.flatnonzero(np.unpackbits(hit, count=len(self.code)))
        return rows[distances(self.code[rows], code) <= self.radius]


def pieces(batches: Iterator[pa.RecordBatch], dimension: int, most: int = INDEX_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of up to about `most` rows at a time, however the batches are cut."""
    own, vectors, n = [], [], 0
    for batch in batches:
        own.append(column(batch, "k").to_numpy(zero_copy_only=False))
        vectors.append(column(batch, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
        n += batch.num_rows
        if n >= most:
            yield np.concatenate(own), np.concatenate(vectors)
            own, vectors, n = [], [], 0
    if n:
        yield np.concatenate(own), np.concatenate(vectors)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """k (long) and v (array of doubles) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, target: float = TARGET, sample_rows: int = SAMPLE_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k largest inner products found.

    The rows are scanned once for each block of queries, and once more for those of its queries that came out short; a task keeps k rows of a query, and those meet in
    one shuffle by query. At most query_block queries (about) and sample_rows vectors are on the driver at once.
    """
    spark = df.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = usable(df, key, vector)
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], empty)
    dimension = shape["d"]
    rows = rows.where(F.size("v") == dimension)
    total = shape["count"]
    n_queries = rows.where(F.col("k") % every == 0).count()
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("k"), "k").limit(sample_rows).collect()], float)
    rotations = learn_rotations(sample)
    radius = learn_radius(sample, rotations, total, k, target)
    blocks = max(1, -(-n_queries // query_block))

    def part(b: int) -> list[DataFrame]:
        asked = rows.where((F.col("k") % every == 0) & (F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)).collect()
        ids, queries = np.array([r.k for r in asked], np.int64), np.array([r.v for r in asked], float).reshape(-1, dimension)
        near = saved(search(ids, queries, np.arange(len(ids)), True), "near")
        full = {r.place for r in near.groupBy("place").count().where(F.col("count") >= k).select("place").collect()}
        short = np.array([q for q in range(len(ids)) if q not in full], np.int64)
        if not len(short):
            return [near]
        again = saved(search(ids[short], queries[short], short, False), "near")
        return [near.where(~F.col("place").isin(short.tolist())), again]

    def search(ids: np.ndarray, queries: np.ndarray, places: np.ndarray, within: bool) -> DataFrame:
        """The best k rows of each task for each query, within the radius or of all; place tells queries of the same id apart."""
        held = spark.sparkContext.broadcast((ids, queries, places, codes(queries, rotations), rotations))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, places, asked, rotations = held.value
            for own, vectors in pieces(batches, dimension):
                index = MultiIndex(codes(vectors, rotations), radius) if within else None
                out: list[list[np.ndarray]] = [[], [], [], []]
                for q in range(len(ids)):
                    near = index.search(asked[q]) if index else np.arange(len(own))
                    near = near[own[near] != ids[q]]
                    score = vectors[near] @ queries[q]
                    if len(near) > k:
                        best = np.lexsort((own[near], -score))[:k]
                        near, score = near[best], score[best]
                    for x, v in zip(out, (np.full(len(near), ids[q]), own[near], score, np.full(len(near), places[q])), strict=True):
                        x.append(v)
                joined = [np.concatenate(x) if x else np.zeros(0) for x in out]
                yield batch_of({"query_id": (joined[0].astype(np.int64), pa.int64()), "vec_id": (joined[1].astype(np.int64), pa.int64()), "score": (joined[2].astype(float), pa.float64()), "place": (joined[3].astype(np.int64), pa.int64())})

        return rows.mapInArrow(found, "query_id long, vec_id long, score double, place long")

    parts = reduce(DataFrame.unionByName, [x for b in range(blocks) for x in part(b)])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
