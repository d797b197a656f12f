"""Replay: filters on a log, projection of its metadata, deterministic merge, schedule."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.plans.machines import machines
from streamloom.plans.running import running

GAP, TOMBSTONE = 1, 2

#: The merge compares heads by these, in this order.
MERGE_KEY = ("ingestion_ts_ns", "topic_id", "partition_id", "ingestion_sequence", "node_id", "publisher_id", "publisher_epoch", "source_sequence", "observed_ts_ns")


class ReplayError(ValueError):
    """A filter or the log itself is not valid; nothing was replayed."""


@dataclass(frozen=True)
class Range:
    """Inclusive on both ends; None is unbounded."""

    least: int | None = None
    most: int | None = None

    def __post_init__(self):
        if self.least is not None and self.most is not None and self.least > self.most:
            raise ReplayError(f"range {self.least}..{self.most} is empty")

    def contains(self, column: Column) -> Column:
        out = F.lit(True)
        if self.least is not None:
            out = out & (column >= self.least)
        if self.most is not None:
            out = out & (column <= self.most)
        return out


@dataclass(frozen=True)
class ReplayFilter:
    ingestion_ts_ns: Range = Range()
    observed_ts_ns: Range = Range()
    source_sequence: Range = Range()
    ingestion_sequence: Range = Range()
    topic_ids: frozenset[int] = field(default_factory=frozenset)
    topic_names: frozenset[str] = field(default_factory=frozenset)
    node_ids: frozenset[int] = field(default_factory=frozenset)

    def condition(self) -> Column:
        """Gap rows are never replayed; tombstones are."""
        out = (F.col("flags").bitwiseAND(GAP) == 0) & (F.col("topic_id").isin(*self.topic_ids) if self.topic_ids else F.lit(True))
        out = out & (F.col("node_id").isin(*self.node_ids) if self.node_ids else F.lit(True))
        for name in ("ingestion_ts_ns", "observed_ts_ns", "source_sequence", "ingestion_sequence"):
            out = out & getattr(self, name).contains(F.col(name))
        return out


def unknown_topics(topics: DataFrame, ids: Iterable[int] = (), names: Iterable[str] = ()) -> DataFrame:
    """topic: the requested ids and names that no topic has."""
    spark = topics.sparkSession
    out = spark.range(0).select(F.lit(None).cast("string").alias("topic"))
    for kind, column, wanted in (("bigint", "topic_id", sorted(ids)), ("string", "topic_name", sorted(names))):
        if wanted:
            asked = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast(kind) for x in wanted])).alias(column))
            out = out.union(asked.join(topics.select(column), column, "left_anti").select(F.col(column).cast("string")))
    return out


def resolved(flt: ReplayFilter, topics: DataFrame) -> ReplayFilter:
    """The filter by topic ids alone; raises if it asks for a topic that isn't there."""
    bad = [r.topic for r in unknown_topics(topics, flt.topic_ids, flt.topic_names).collect()]
    if bad:
        raise ReplayError(f"unknown topics: {bad}")
    named = {r.topic_id for r in topics.where(F.col("topic_name").isin(*flt.topic_names)).collect()} if flt.topic_names else set()
    return ReplayFilter(flt.ingestion_ts_ns, flt.observed_ts_ns, flt.source_sequence, flt.ingestion_sequence, frozenset(flt.topic_ids | named), frozenset(), flt.node_ids)


def guard_log(records: DataFrame, topics: DataFrame) -> None:
    """Raises before any output if a record names a topic that isn't there."""
    lost = records.join(topics, "topic_id", "left_anti").limit(1).collect()
    if lost:
        raise ReplayError(f"record of unknown topic {lost[0].topic_id}")


def with_merge_key(records: DataFrame) -> DataFrame:
    """Adds merge_key: the largest key up to this record in its partition.

    Merging streams by their heads equals sorting by it: once a large head is taken every other
    head is at least as large, so a smaller successor follows at once. Filter before.
    """
    return running(records, ["topic_id", "partition_id"], "ingestion_sequence", {"merge_key": ("max", F.struct(*MERGE_KEY), True)})


def merged(records: DataFrame) -> DataFrame:
    """Records in replay order."""
    keyed = with_merge_key(records)
    return keyed.orderBy("merge_key", "ingestion_sequence")


def positioned(records: DataFrame, slice_ns: int = 3_600_000_000_000) -> DataFrame:
    """Adds position, the 0-based place in replay order.

    The order is cut into slices of time that are numbered side by side: a slice's first place is the
    number of rows in the slices before it, so no task holds all rows.
    """
    sliced = with_merge_key(records).withColumn("_slice", F.floor(F.col("merge_key.ingestion_ts_ns") / slice_ns))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("_slice").count().select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_slice").orderBy("merge_key", "ingestion_sequence")
    placed = sliced.withColumn("_n", F.row_number().over(own) - 1).join(starts, "_slice")
    return placed.withColumn("position", (F.col("_start") + F.col("_n")).cast("bigint")).drop("_slice", "_n", "_start")


def metadata(records: DataFrame, topics: DataFrame, session: str, namespace: str = "replay", clock_ns: int | None = None, extra: Iterable[str] = ()) -> DataFrame:
    """What a replayed message carries: origin, namespace and the time it is published under."""
    published = F.col("ingestion_ts_ns") if clock_ns is None else F.lit(clock_ns).cast("bigint")
    return records.join(topics, "topic_id").select(
        "topic_id", "topic_name", "partition_id", "ingestion_sequence", "node_id", "publisher_id", "publisher_epoch", "source_sequence", "ingestion_ts_ns", "observed_ts_ns", "flags",
        F.lit(session).alias("session"), F.lit(namespace).alias("namespace"), published.alias("publish_ts_ns"), *extra,
    )


def schedule(records: DataFrame, start_ns: int, speed: float) -> DataFrame:
    """Adds target_ns, when each record is due: start + (time - first time) / speed, not before the start."""
    if not speed > 0:
        raise ReplayError("speed must be positive")
    first = records.agg(F.min_by("ingestion_ts_ns", F.struct(*MERGE_KEY)).alias("_first"))
    since = F.greatest(F.col("ingestion_ts_ns") - F.col("_first"), F.lit(0))
    return records.join(F.broadcast(first)).withColumn("target_ns", start_ns + F.floor(since / speed).cast("bigint")).drop("_first")


def schema_mismatches(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Records other than gaps whose (topic, ref, version, layout) no schema has."""
    return records.where(F.col("flags").bitwiseAND(GAP) == 0).join(schemas, ["topic_id", "schema_ref", "schema_version", "layout_version"], "left_anti")


def authorise(namespace: str, live: bool, allowed: bool) -> str:
    """A live target must be allowed explicitly."""
    if live and not allowed:
        raise ReplayError("replay into a live namespace needs explicit authorisation")
    return namespace


class Publisher:
    """What a replay hands its messages to; one is made for each task that publishes."""

    def publish(self, request: dict) -> None:
        """Takes one message: what metadata gives, and whatever columns came with it. Raising ends the replay of its partition."""
        raise NotImplementedError


def publish(requests: DataFrame, publisher: Callable[[], Publisher]) -> DataFrame:
    """Hands every request to a publisher, in the order of its topic's partition.

    topic_id, partition_id, published, last_published, failed_at and error of each partition. Gaps are never handed on.
    A partition ends at the first message that its publisher refuses; the others go on. Running the result again
    publishes again, so write it rather than look at it twice.
    """

    def start():
        done = {"published": 0, "last": None}
        to = None

        def feed(x):
            nonlocal to
            if x["_end"]:
                return [(x["topic_id"], x["partition_id"], done["published"], done["last"], done.get("failed"), done.get("error"))]
            if "error" in done:
                return []
            try:
                to = to or publisher()
                to.publish({k: v for k, v in x.items() if not k.startswith("_")})
                done["published"], done["last"] = done["published"] + 1, x["ingestion_sequence"]
            except Exception as e:
                done["failed"], done["error"] = x["ingestion_sequence"], f"{type(e).__name__}: {e}"
            return []

        return feed

    due = requests.where(F.col("flags").bitwiseAND(GAP) == 0).withColumn("_end", F.lit(False)).withColumn("_turn", F.struct("_end", "ingestion_sequence"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in requests.schema if f.name not in ("topic_id", "partition_id")]
    ends = due.select("topic_id", "partition_id").distinct().select("topic_id", "partition_id", *rest).select(*requests.columns, F.lit(True).alias("_end")).withColumn("_turn", F.struct("_end", "ingestion_sequence"))
    schema = "topic_id long, partition_id long, published long, last_published long, failed_at long, error string"
    return machines(due.union(ends), ["topic_id", "partition_id"], "_turn", start, schema)
