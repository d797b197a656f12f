"""Delivery: stages, completion of receipts, retransmission, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, REMOTE, BUFFERED, WRITTEN, DURABLE = "local_published", "remote_accepted", "recorder_buffered", "storage_written", "storage_durable"
STAGES = (LOCAL, REMOTE, BUFFERED, WRITTEN, DURABLE)
NODE, RECORDER = "node", "recorder"


def stage_satisfied(target_kind: Column, reached: Column, required: Column) -> Column:
    """Stages branch: a node can only accept remotely, a recorder goes buffered, written, durable; local is always met."""
    ladder = {s: F.lit(i) for i, s in enumerate((BUFFERED, WRITTEN, DURABLE))}

    def rung(stage: Column) -> Column:
        out = F.lit(None).cast("int")
        for name, place in ladder.items():
            out = F.when(stage == name, place).otherwise(out)
        return out

    recorder = F.coalesce(rung(reached) >= rung(required), F.lit(False))
    return F.when(required == LOCAL, True).when(target_kind == NODE, (required == REMOTE) & (reached == REMOTE)).otherwise(recorder)


def completion(receipts: DataFrame, targets: DataFrame) -> DataFrame:
    """receipt_id, required, successes, pending, state of each receipt.

    receipts: receipt_id, policy (all, any, quorum), quorum, stage. targets: receipt_id, target_kind, reached (null while
    pending), ok. Complete when enough succeeded; failed when what is pending can't be enough any more.
    """
    t = receipts.join(targets, "receipt_id", "left")
    met = F.col("reached").isNotNull() & F.col("ok") & stage_satisfied(F.col("target_kind"), F.col("reached"), F.col("stage"))
    counted = t.groupBy("receipt_id", "policy", "quorum", "stage").agg(F.count("target_kind").alias("targets"), F.count_if(met).alias("successes"), F.count_if(F.col("target_kind").isNotNull() & F.col("reached").isNull()).alias("pending"))
    required = F.when(F.col("policy") == "all", F.col("targets")).when(F.col("policy") == "any", F.least(F.col("targets"), F.lit(1))).otherwise(F.col("quorum"))
    c = counted.withColumn("required", required.cast("bigint"))
    state = F.when(F.col("successes") >= F.col("required"), "complete").when(F.col("successes") + F.col("pending") < F.col("required"), "failed").otherwise("outstanding")
    return c.select("receipt_id", "required", "successes", "pending", state.alias("state"))


def publish_results(publications: DataFrame) -> DataFrame:
    """status of each publication: the local outcome decides, the bridge's is kept beside it."""
    return publications.withColumn("status", F.when(F.col("local_ok"), "published").otherwise("failed")).withColumn("bridge_status", F.when(~F.col("local_ok"), "skipped").when(F.col("bridge_ok"), "dispatched").otherwise("degraded"))


def expired(frames: DataFrame, now: int, max_age: int) -> DataFrame:
    return frames.where(now - F.col("enqueued_at") >= max_age)


def joined(parts: Column) -> Column:
    """The bytes of an array of (index, bytes), already in order, in one go."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["bytes"])), ""))


def reassembled(fragments: DataFrame) -> DataFrame:
    """message key, status, payload: fragments joined in order.

    rejected if fragments disagree on count or checksum or repeat with other bytes or have an index out of range; incomplete while one
    is missing; corrupt if the whole's CRC-32 differs. Repeats with equal bytes are ignored.
    """
    key = ["connection", "peer", "message_id"]
    one = fragments.groupBy(*key, "index").agg(F.min("bytes").alias("bytes"), F.max("bytes").alias("_other"), F.min("count").alias("_c0"), F.max("count").alias("_c1"), F.min("crc").alias("_k0"), F.max("crc").alias("_k1"))
    whole = one.groupBy(*key).agg(
        F.bool_or(F.col("bytes") != F.col("_other")).alias("v"), F.min("_c0").alias("c0"), F.max("_c1").alias("c1"), F.min("_k0").alias("k0"), F.max("_k1").alias("k1"),
        F.count("*").alias("have"), F.min("index").alias("i0"), F.max("index").alias("i1"), F.collect_list(F.struct("index", "bytes")).alias("parts"),
    )
    bad = F.col("v") | (F.col("c0") != F.col("c1")) | (F.col("k0") != F.col("k1")) | (F.col("i0") < 0) | (F.col("i1") >= F.col("c0"))
    early = F.when(bad, "rejected").when(F.col("have") < F.col("c0"), "incomplete")
    # only messages that have all their fragments are put together
    whole = whole.select(*key, "k0", early.alias("early"), F.when(early.isNull(), joined(F.array_sort("parts"))).alias("_p"))
    status = F.coalesce("early", F.when(F.crc32("_p") != F.col("k0"), "corrupt").otherwise("complete"))
    return whole.select(*key, status.alias("status"), F.when(status == "complete", F.col("_p")).alias("payload"))
