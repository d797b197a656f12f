"""Storage planning: snapshots, retention, pins, recovery, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.plans.machines import machines
from streamloom.plans.running import running
from streamloom.plans.simulate import RecoveryChain

CREATING, OPEN, SEALED, INDEXED, RETAINED, DELETED = range(1, 7)
AGE, BYTES, COUNT, ARCHIVED = 1, 2, 4, 8

#: Allowed moves of a segment's state.
SEGMENT_MOVES = ((CREATING, OPEN), (OPEN, SEALED), (SEALED, INDEXED), (INDEXED, RETAINED), (INDEXED, DELETED), (RETAINED, DELETED))


def latest(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by order. A partial aggregate on each side of the shuffle, no sort."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def retention_plan(segments: DataFrame, now: int, max_age: int | None = None, max_bytes: int | None = None, max_count: int | None = None, delete_archived: bool = False) -> DataFrame:
    """segment_id, reasons (a bit mask) of the segments to delete, and excess_bytes and excess_count before each.

    First, eligible segments that are old enough or archived. Then, oldest first among the other
    eligible ones, for as long as what remains is over a limit: since every deletion lowers both totals,
    a segment goes exactly if the totals less all older unselected segments are still over.
    """
    s = segments.where(F.col("state") != DELETED)
    eligible = F.col("state").isin(SEALED, INDEXED, RETAINED)
    first = F.lit(0)
    if max_age is not None:
        first = first + F.when((F.col("latest_ts") <= now) & (now - F.col("latest_ts") >= max_age), AGE).otherwise(0)
    if delete_archived:
        first = first + F.when(F.col("archive_complete"), ARCHIVED).otherwise(0)
    marked = s.withColumn("eligible", eligible).withColumn("first", F.when(eligible, first).otherwise(0))
    totals = marked.agg(
        F.coalesce(F.sum("size_bytes") - F.coalesce(F.sum(F.when(F.col("first") > 0, F.col("size_bytes"))), F.lit(0)), F.lit(0)).alias("total_bytes"),
        (F.count("*") - F.count_if(F.col("first") > 0)).alias("total_count"),
    )
    waiting = marked.where("eligible and first = 0").withColumn("_k", F.lit(0))
    # the oldest come first; days cut the order into chunks, so no task sorts all segments
    waiting = waiting.withColumn("_day", F.col("latest_ts"))
    day = waiting.groupBy("_day").agg(F.sum("size_bytes").alias("_b"), F.count("*").alias("_n"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select("_day", F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    own = Window.partitionBy("_day").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    waiting = waiting.withColumn("_b", F.coalesce(F.sum("size_bytes").over(own), F.lit(0))).withColumn("_n", F.count("*").over(own)).join(day, "_day").join(F.broadcast(totals))
    left_bytes, left_count = F.col("total_bytes") - F.col("_b0") - F.col("_b"), F.col("total_count") - F.col("_n0") - F.col("_n")
    over = F.lit(0)
    if max_bytes is not None:
        over = over + F.when(left_bytes > max_bytes, BYTES).otherwise(0)
    if max_count is not None:
        over = over + F.when(left_count > max_count, COUNT).otherwise(0)
    second = waiting.select("segment_id", "size_bytes", over.alias("reasons")).where("reasons > 0")
    return marked.where("first > 0").select("segment_id", "size_bytes", F.col("first").alias("reasons")).union(second)


def retention_summary(segments: DataFrame, plan: DataFrame) -> DataFrame:
    """Totals before and after the plan."""
    there = segments.where(F.col("state") != DELETED).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"), F.count("*").alias("total_count"))
    gone = plan.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("deleted_bytes"), F.count("*").alias("deleted_count"))
    return there.crossJoin(gone).select("*", (F.col("total_bytes") - F.col("deleted_bytes")).alias("remaining_bytes"), (F.col("total_count") - F.col("deleted_count")).alias("remaining_count"))


def active_pins(pins: DataFrame, now: int) -> DataFrame:
    """Pins that haven't reached their expiry; nothing else keeps a pin."""
    return pins.where(F.col("expires_at") > now)


def deletion_steps(plan: DataFrame, pins: DataFrame, now: int) -> DataFrame:
    """segment_id and step: pending while a pin is active, else unlink."""
    held = active_pins(pins, now).select("segment_id").distinct().withColumn("_held", F.lit(True))
    return plan.join(held, "segment_id", "left").select("segment_id", F.when(F.col("_held"), "pending").otherwise("unlink").alias("step"))


def bad_moves(transitions: DataFrame, allowed, key: list[str], order: str, state: str = "state") -> DataFrame:
    """Rows whose state can't follow the one before it; staying is allowed."""
    spark = transitions.sparkSession
    pairs = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).cast("bigint").alias("previous"), F.lit(b).cast("bigint").alias(state)) for a, b in allowed])).alias("p")).select("p.*")
    before = running(transitions, key, order, {"_before": ("max", F.struct(F.col(order).alias("at"), F.col(state).alias("state")), False)})
    before = before.withColumn("previous", F.col("_before.state")).drop("_before")
    moved = before.where(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))
    return moved.join(F.broadcast(pairs), ["previous", state], "left_anti")


def session_totals(segments: DataFrame) -> DataFrame:
    """Topics, partitions, segments and bytes of a session."""
    return segments.agg(F.countDistinct("topic_id").alias("topics"), F.countDistinct("topic_id", "partition_id").alias("partitions"), F.count("*").alias("segments"), F.sum("size_bytes").cast("bigint").alias("bytes"))


def orphans(on_disk: DataFrame, tracked: DataFrame, key: str = "path") -> DataFrame:
    """Files that no manifest tracks."""
    return on_disk.join(tracked.select(key), key, "left_anti")


def recovery_decisions(on_disk: DataFrame, tracked: DataFrame) -> DataFrame:
    """path, topic_id, partition_id and action of each file, as simulate.RecoveryChain decides in its partition's order.

    on_disk: path, topic_id, partition_id, segment_id, first_sequence, last_sequence (of the last complete record), sealed,
    and readable if some files aren't.
    """
    known = tracked.select("path", F.lit(True).alias("known"))
    files = on_disk if "readable" in on_disk.columns else on_disk.withColumn("readable", F.lit(True))
    # tracked files come before untracked ones of any id
    files = files.join(known, "path", "left").select("topic_id", "partition_id", "path", "segment_id", "first_sequence", "last_sequence", F.coalesce("known", F.lit(False)).alias("known"), "sealed", "readable")
    turned = files.withColumn("turn", F.concat(F.when(F.col("known"), "0").otherwise("1"), F.lpad(F.col("segment_id").cast("string"), 20, "0"), F.col("path")))

    def start():
        chain = RecoveryChain()
        return lambda x: [(x["path"], x["topic_id"], x["partition_id"], chain.offer(x["segment_id"], x["first_sequence"], x["last_sequence"], x["known"], x["sealed"], x["readable"]))]

    return machines(turned, ["topic_id", "partition_id"], "turn", start, "path string, topic_id long, partition_id long, action string")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(topic_id, partition_id, segment_id, rule) for every broken rule of a partition's list of segments."""
    w = Window.partitionBy("topic_id", "partition_id").orderBy("position")
    same_path = Window.partitionBy("topic_id", "partition_id", "path")
    m = manifest.select("*", F.lag("segment_id").over(w).alias("_id"), F.lag("last_sequence").over(w).alias("_last"), F.lead("position").over(w).alias("_next"), F.count("*").over(same_path).alias("_paths"))
    sealed = F.col("state") >= SEALED
    rules = {
        "segment_id_order": F.col("segment_id") <= F.col("_id"),
        "sequence_overlap": F.col("first_sequence") <= F.col("_last"),
        "duplicate_path": F.col("_paths") > 1,
        "active_not_last": ~sealed & F.col("_next").isNotNull(),
        "sealed_at": F.when(sealed, F.col("sealed_at") < F.col("created_at")).otherwise(F.col("sealed_at") != 0),
        "sealed_size": sealed & (F.col("size_bytes") < 52),
        "checkpoint_outside": F.col("checkpoint").isNotNull() & ((F.col("checkpoint") < F.col("first_sequence")) | (F.col("checkpoint") > F.col("last_sequence"))),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return m.select("topic_id", "partition_id", "segment_id", F.explode(broken).alias("rule"))


def recording_violations(topics: DataFrame) -> DataFrame:
    """(topic_id, rule) for every broken rule of a recording's list of topics: topic_id, name, schema_ref, digest; refs rise with the ids."""
    one = topics.withColumn("_one", F.lit(1))
    before = running(one.where("topic_id is not null"), ["_one"], "topic_id", {"_before": ("max", F.struct("topic_id", F.col("schema_ref").alias("ref")), False)})
    names = topics.groupBy("name").agg(F.count("*").alias("_names"))
    digests = topics.groupBy("digest", "schema_ref").agg(F.count("*").alias("_digests"))
    t = before.join(names, "name").join(digests, ["digest", "schema_ref"])
    rules = {"zero_id": F.col("topic_id") == 0, "duplicate_name": F.col("_names") > 1, "schema_ref_order": F.col("schema_ref") <= F.col("_before.ref"), "duplicate_digest": F.col("_digests") > 1}
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return t.select("topic_id", F.explode(broken).alias("rule"))


def identity_mismatches(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """partition_id, recording_id and session_id of the partitions (with their session) that name another recording than their session does."""
    named = sessions.select("session", F.col("recording_id").alias("session_id"))
    return parts.join(named, "session").where("recording_id <> session_id").select("partition_id", "recording_id", "session_id")


def rollbacks(manifests: DataFrame, minimum: DataFrame) -> DataFrame:
    """Manifests whose generation, config or durable sequence is below the least that their owner has seen."""
    cols = ("generation", "config_version", "durable_sequence")
    joined = manifests.join(minimum.select("topic_id", *[F.col(c).alias(f"_min_{c}") for c in cols]), "topic_id")
    behind = F.array_compact(F.array(*[F.when(F.col(c) < F.col(f"_min_{c}"), F.lit(c)) for c in cols]))
    return joined.select("topic_id", *cols, F.array_join(behind, ",").alias("behind")).where("behind <> ''")


def rotated(records: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Adds segment_number when segments close after `most` records."""
    n = running(records, keys, order, {"_n": ("sum", F.lit(1).cast("bigint"), True)})
    return n.withColumn("segment_number", F.floor((F.col("_n") - 1) / most)).drop("_n")


def drained(records: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """The longest prefix of each key's records that fits the byte budget."""
    return running(records, keys, order, {"_b": ("sum", F.col(size), True)}).where(F.col("_b") <= budget).drop("_b")


def disposition(findings: DataFrame) -> DataFrame:
    """clean, incomplete_tail, or corruption if a valid record lies after the first damage; by file."""
    f = findings.groupBy("path").agg(F.min(F.when(~F.col("valid"), F.col("offset"))).alias("damage"), F.max(F.when(F.col("valid"), F.col("offset"))).alias("last_valid"), F.count_if("valid").alias("records"))
    kind = F.when(F.col("damage").isNull(), "clean").when(F.col("last_valid") > F.col("damage"), "corruption").otherwise("incomplete_tail")
    return f.select("path", "records", "damage", kind.alias("disposition"))


def state_name(state: Column) -> Column:
    names = ("creating", "open", "sealed", "indexed", "retained", "deleted")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), state.cast("int")), F.lit("unknown"))
