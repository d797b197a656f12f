"""Corpus blocks, and questions that blocks ask of hash partitions.

A block holds some megabytes of consecutive documents in one row. What blocks need to
know of the whole corpus they ask by hash: every block sends one payload to each bucket of
the hash space, a bucket answers every block that asked, and the answers meet their
block again. So a shuffle moves arrays, not one row for each hash, and no task holds more
than a bucket or a block, whose number grows with the corpus.

Blocks that wait for answers lie in Spark's buckets, dealt by groups of consecutive blocks: the
answers are shuffled to them, and their texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, release, saved, shared_folder, small_batches, strings

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose hashes share a bucket, about.
BUCKET_BYTES = 8 << 20
#: 2 to this power consecutive blocks of a task lie together.
PART_BITS = 3


def blocked(docs: DataFrame, key: str, text: str, encode: Callable[[list[bytes]], bytes] = b"".join, size: int = BLOCK_BYTES, wait: bool = False) -> DataFrame:
    """block, keys, lengths (bytes of each text) and data, written to the shared folder so that blocks stay as they are.

    encode makes the block's data of its texts (by default, joins them). wait: for with_answers, with the column part.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, texts, total = [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal keys, texts, total, number
            out = batch_of({"block": ([number], pa.int64()), "keys": ([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)), "lengths": ([[len(x) for x in texts]], pa.list_(pa.int64())), "data": ([encode(texts)], pa.binary())})
            number, keys, texts, total = number + 1, [], [], 0
            return out

        for batch in batches:
            k = column(batch, "k")
            for i, x in enumerate(strings(column(batch, "text"))):
                if total and total + len(x) > size:
                    yield made()
                keys.append(k.slice(i, 1))
                texts.append(x)
                total += len(x)
        if keys:
            yield made()

    out = small_batches(rows).mapInArrow(gathered, f"block long, keys array<{kind}>, lengths array<bigint>, data binary")
    return _placed(out.select(_part().alias("part"), "*")) if wait else saved(out, "blocks")


def _part():
    return F.shiftright("block", PART_BITS)


def _placed(blocks: DataFrame) -> DataFrame:
    """Writes blocks in as many buckets as a shuffle has partitions, by part, and reads them back."""
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    out = blocks.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").option("compression", "zstd")
    out.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    found.schema  # known before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return found


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")).first()[0] or 0
    return max(16, -(-total // bucket_bytes))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Spreads the high half of 64-bit hashes evenly."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def split(order_by: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, its places) for every bucket that has some."""
    order = np.argsort(order_by, kind="stable")
    edges = np.searchsorted(order_by[order], np.arange(buckets + 1))
    return [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]


def asked(blocks: DataFrame, ask: Callable[[dict], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """bucket, block, payload: what ask yields for each row of blocks (a dict of its columns)."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: column(batch, n)[i].as_py() for n in batch.schema.names}
                found = list(ask(row))
                if found:
                    yield batch_of({"bucket": ([b for b, _ in found], pa.int32()), "block": ([row["block"]] * len(found), pa.int64()), "payload": ([x for _, x in found], pa.binary())})

    return small_batches(blocks).mapInArrow(sent, "bucket int, block long, payload binary")


def answered(questions: DataFrame, answer: Callable[[list[bytes]], list[bytes | None]], name: str) -> DataFrame:
    """block, bucket, payload: what the buckets answered, written. answer: a bucket's payloads in, one each out (None: nothing)."""

    def reduced(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        out = answer(group.column("payload").to_pylist())
        keep = pa.array([i for i, x in enumerate(out) if x is not None], pa.int64())
        return pa.table({"block": group.column("block").take(keep), "bucket": group.column("bucket").take(keep), "payload": pa.array([x for x in out if x is not None], pa.binary())})

    found = saved(questions.groupBy("bucket").applyInArrow(reduced, "block long, bucket int, payload binary"), name)
    del questions  # the last reference to its shuffle
    release(found.sparkSession)
    return found


def with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """blocks (that wait) with the column answers: (block, step, bucket, payload) of the answers of each step, null where nothing was answered to the block's part.

    One join, whatever the number of steps; only the answers are shuffled.
    """
    every = [found.select(_part().alias("part"), F.struct("block", F.lit(i).alias("step"), "bucket", "payload").alias("a")) for i, found in enumerate(answers)]
    met = reduce(DataFrame.union, every).groupBy("part").agg(F.collect_list("a").alias("answers"))
    own = F.filter("answers", lambda a: a["block"] == F.col("block"))
    return blocks.join(met.hint("shuffle_hash"), "part", "left").withColumn("answers", own)


def of_step(row: dict, step: int) -> list[dict]:
    """A row's answers of one step."""
    return [a for a in row["answers"] or () if a["step"] == step]
