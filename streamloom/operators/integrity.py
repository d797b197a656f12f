"""Log integrity: duplicates, gaps and their reasons, sequence assignment, contiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.plans.running import running

SOURCE = ["topic_id", "node_id", "publisher_id", "publisher_epoch"]


def arrivals_checked(arrivals: DataFrame, source: list[str] = SOURCE, order: str = "arrival") -> DataFrame:
    """Adds last_sequence (the source's largest before this row), duplicate, and gap_first and gap_last of what is missing before it.

    A row at or below the last sequence is a duplicate, late rows included. A source's first row has no gap.
    """
    seen = running(arrivals, source, order, {"last_sequence": ("max", F.col("source_sequence"), False)})
    gap = F.col("source_sequence") > F.col("last_sequence") + 1
    return seen.withColumns({
        "duplicate": F.coalesce(F.col("source_sequence") <= F.col("last_sequence"), F.lit(False)),
        "gap_first": F.when(gap, F.col("last_sequence") + 1),
        "gap_last": F.when(gap, F.col("source_sequence") - 1),
    })


def gaps(checked: DataFrame) -> DataFrame:
    """One row for each gap, with the times of the row that showed it."""
    return checked.where("gap_first is not null").select(*SOURCE, "partition_id", "arrival", "gap_first", "gap_last", "ingestion_ts_ns", "observed_ts_ns")


def written(checked: DataFrame) -> DataFrame:
    """The rows a writer appends, gap rows before the row that showed them, with their place (ingestion_sequence) in the partition."""
    gap = F.struct(F.lit(0).alias("slot"), F.lit(1).cast("bigint").alias("flags"), F.col("gap_first").alias("source_sequence"), F.lit(24).cast("bigint").alias("payload_size"))
    own = F.struct(F.lit(1).alias("slot"), F.col("flags"), F.col("source_sequence"), F.col("payload_size"))
    rows = F.when(F.col("gap_first").isNotNull(), F.array(gap, own)).otherwise(F.array(own))
    kept = checked.where(~F.col("duplicate"))
    n = F.lit(1).cast("bigint") + F.col("gap_first").isNotNull().cast("bigint")
    kept = running(kept, ["topic_id", "partition_id"], "arrival", {"_through": ("sum", n, True)})
    out = kept.select("topic_id", "partition_id", "node_id", "publisher_id", "publisher_epoch", "arrival", "ingestion_ts_ns", "observed_ts_ns", "_through", F.explode(rows).alias("r"))
    return out.select(*[c for c in out.columns if c not in ("_through", "r")], "r.flags", "r.source_sequence", "r.payload_size", (F.col("_through") - 1 + F.col("r.slot")).cast("bigint").alias("assigned_sequence"))


def gap_reasons(spans: DataFrame, discards: DataFrame, default: str = "source_sequence_jump") -> DataFrame:
    """spans with reason: the discard reason if discards of that one reason cover the whole span, else default.

    spans and discards are joined by source; a discard counts where its sequence lies in the span.
    """
    inside = (F.col("d.source_sequence") >= F.col("s.gap_first")) & (F.col("d.source_sequence") <= F.col("s.gap_last"))
    same = [F.col(f"s.{k}") == F.col(f"d.{k}") for k in SOURCE]
    both = spans.alias("s").join(discards.alias("d"), [*same, inside], "left")
    keys = [*SOURCE, "gap_first", "gap_last"]
    found = both.groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).agg(F.countDistinct("d.source_sequence").alias("covered"), F.countDistinct("d.reason").alias("reasons"), F.min("d.reason").alias("reason"))
    uniform = (F.col("covered") == F.col("gap_last") - F.col("gap_first") + 1) & (F.col("reasons") == 1)
    return found.select(*keys, F.when(uniform, F.col("reason")).otherwise(default).alias("reason"))


def highest_contiguous(records: DataFrame, source: list[str] = SOURCE) -> DataFrame:
    """highest: the largest n such that a source's sequences 1..n all occur (0 if 1 doesn't)."""
    distinct = records.groupBy(*source, "source_sequence").agg(F.count("*").alias("copies"))
    numbered = running(distinct, source, "source_sequence", {"rank": ("sum", F.lit(1).cast("bigint"), True)})
    hit = F.when(F.col("source_sequence") == F.col("rank"), F.col("source_sequence"))
    return numbered.groupBy(*source).agg(F.coalesce(F.max(hit), F.lit(0)).cast("bigint").alias("highest"))


def contiguity_breaks(records: DataFrame, group: list[str], sequence: str = "ingestion_sequence") -> DataFrame:
    """Rows whose sequence isn't the one before it in the group plus 1."""
    before = running(records, group, sequence, {"previous": ("max", F.col(sequence), False)})
    return before.where(F.col("previous").isNotNull() & (F.col(sequence) != F.col("previous") + 1))


def order_breaks(segments: DataFrame) -> DataFrame:
    """Segments that don't begin after the one before them in their partition ends."""
    w = Window.partitionBy("topic_id", "partition_id").orderBy("first_sequence", "created_at_ns", "segment_id")
    return segments.withColumn("previous_last", F.lag("last_sequence").over(w)).where(F.col("first_sequence") <= F.col("previous_last"))


def owning_segments(records: DataFrame, segments: DataFrame, width: int = 500) -> DataFrame:
    """records with the segment whose [first, last] holds their sequence.

    A segment is listed under every multiple of width that it reaches, so the range join is an equi-join.
    """
    cells = segments.select("topic_id", "partition_id", "segment_id", "first_sequence", "last_sequence", F.explode(F.sequence(F.floor(F.col("first_sequence") / width), F.floor(F.col("last_sequence") / width))).alias("_cell"))
    keyed = records.withColumn("_cell", F.floor(F.col("ingestion_sequence") / width))
    hit = keyed.join(cells, ["topic_id", "partition_id", "_cell"]).where((F.col("ingestion_sequence") >= F.col("first_sequence")) & (F.col("ingestion_sequence") <= F.col("last_sequence")))
    return hit.drop("_cell", "first_sequence", "last_sequence")


def stats(checked: DataFrame) -> DataFrame:
    """By topic: rows, accepted, duplicates, gaps and missing records."""
    missing = F.col("gap_last") - F.col("gap_first") + 1
    return checked.groupBy("topic_id").agg(
        F.count("*").alias("arrived"), F.count_if(~F.col("duplicate")).alias("accepted"), F.count_if("duplicate").alias("duplicates"),
        F.count("gap_first").alias("gaps"), F.coalesce(F.sum(missing), F.lit(0)).cast("bigint").alias("missing"),
    )


def unacknowledged(frames: DataFrame, acks: DataFrame, source: list[str]) -> DataFrame:
    """Frames that no acknowledgement of their source removes: cumulative up to its highest, or the one observed if accepted.

    Cumulative ones come down to a maximum by source and accepted ones to an equi-join, so nothing is compared pairwise.
    """
    upto = acks.groupBy(*source).agg(F.max("highest").alias("_upto"))
    single = acks.where(F.col("disposition") == "accepted").select(*source, F.col("observed").alias("sequence")).distinct()
    left = frames.join(upto, source, "left").where(F.col("_upto").isNull() | (F.col("sequence") > F.col("_upto"))).drop("_upto")
    return left.join(single, [*source, "sequence"], "left_anti")


def is_gap(flags: Column) -> Column:
    return flags.bitwiseAND(1) != 0
