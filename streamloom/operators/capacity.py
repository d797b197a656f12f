"""Capacity: headroom and admission over named dimensions, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The dimensions, in the order in which admission tests them.
DIMENSIONS = ("shm_bytes", "slab_bytes", "topics", "publishers", "subscribers", "bridge_connections", "bridge_egress_bytes", "schema_buffer_bytes", "recorder_buffer_bytes", "file_descriptors", "threads")


def by_dimension(df: DataFrame, keys: list[str], value: str, dimensions=DIMENSIONS) -> DataFrame:
    """Wide columns as rows (keys, ordinal, dimension, value)."""
    each = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(d).alias("dimension"), F.col(d).cast("bigint").alias(value)) for i, d in enumerate(dimensions)])
    return df.select(*keys, F.explode(each).alias("_d")).select(*keys, "_d.*")


def headroom(state: DataFrame) -> DataFrame:
    """Adds data_plane and control_plane: what is left under the limit, for data under the limit less the reserve."""
    used = F.col("committed") + F.col("pending")
    zero = F.lit(0).cast("bigint")
    return state.withColumn("data_plane", F.greatest(zero, F.col("limit") - F.col("reserve") - used)).withColumn("control_plane", F.greatest(zero, F.col("limit") - used))


def admissions(requests: DataFrame, state: DataFrame) -> DataFrame:
    """request_id, admitted, and the first dimension in order that refuses, with what was requested and available.

    requests: request_id, node_id, plane (data, control), ordinal, dimension, requested. All or nothing; zero asks for nothing.
    """
    room = headroom(state).select("node_id", "dimension", "data_plane", "control_plane")
    r = requests.join(room, ["node_id", "dimension"])
    available = F.when(F.col("plane") == "data", F.col("data_plane")).otherwise(F.col("control_plane"))
    r = r.withColumn("available", available).withColumn("_over", (F.col("requested") > 0) & (F.col("requested") > F.col("available")))
    first = F.min(F.when(F.col("_over"), F.struct("ordinal", "dimension", "requested", "available"))).alias("_f")
    return r.groupBy("request_id").agg(first).select("request_id", F.col("_f").isNull().alias("admitted"), F.col("_f.dimension").alias("dimension"), F.col("_f.requested").alias("requested"), F.col("_f.available").alias("available"))


def summed(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests added up; a sum beyond 64 bits is an error."""
    return requests.groupBy(*keys, "ordinal", "dimension").agg(F.sum("requested").alias("requested"))


def rendered(state: DataFrame) -> DataFrame:
    """node_id and json of its dimensions, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "dimension", "limit")))
    one = F.transform(pairs, lambda p: F.concat(F.lit('"'), p["dimension"], F.lit('":'), p["limit"]))
    return state.groupBy("node_id").agg(F.concat(F.lit("{"), F.array_join(one, ","), F.lit("}")).alias("json"))


def recorder_estimate(topics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """topic_id, recorder_buffer_bytes, file_descriptors and schema_buffer_bytes that recording a topic takes; error instead where it has no partition.

    topics: topic_id, partition_count, mode, buffer_limit. artifacts: topic_id and size of each schema's. A partition takes its buffer pool
    (none where only snapshots are kept) and two files, the topic one more and its schemas' artifacts.
    """
    sizes = artifacts.groupBy("topic_id").agg(F.sum("size").alias("_schemas"))
    valid = F.col("partition_count") > 0
    buffers = F.when(F.col("mode") == "snapshot", 0).otherwise(F.col("partition_count") * F.col("buffer_limit"))
    return topics.join(sizes, "topic_id", "left").select(
        "topic_id", F.when(valid, buffers.cast("long")).alias("recorder_buffer_bytes"), F.when(valid, F.col("partition_count") * 2 + 1).cast("long").alias("file_descriptors"),
        F.when(valid, F.coalesce("_schemas", F.lit(0)).cast("long")).alias("schema_buffer_bytes"), F.when(~valid, "no partition").alias("error"),
    )
