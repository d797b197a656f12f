"""Telemetry: metrics, histograms, latency between clocks, sampling, limits, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions.scalars import log2_bucket, sampled
from streamloom.plans.running import running

BUCKETS = 65


def gauge_totals(samples: DataFrame, keys: list[str], shard: str, order: str, value: str) -> DataFrame:
    """The last value of each shard, summed by key."""
    last = samples.groupBy(*keys, shard).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(*keys).agg(F.sum("_v").cast("bigint").alias("value"))


def histogram(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, bucket, count, total for every one of the 65 buckets."""
    hit = samples.groupBy(*keys, log2_bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("count"), F.sum(value).alias("total"))
    every = hit.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"))
    return every.join(hit, [*keys, "bucket"], "left").na.fill(0, ["count", "total"])


def cumulative(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cumulative, the count up to each bucket's end."""
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return buckets.withColumn("cumulative", F.sum("count").over(upto))


def bucket_end(bucket: Column) -> Column:
    """2^bucket - 1 as text, +Inf for the last."""
    one = F.lit(1).cast("decimal(21,0)")
    return F.when(bucket >= BUCKETS - 1, "+Inf").otherwise((F.pow(F.lit(2.0), bucket).cast("decimal(21,0)") - one).cast("string"))


def nearest_rank(samples: DataFrame, keys: list[str], value: str, percents=(50, 95, 99, 100)) -> DataFrame:
    """keys, percent, value: the value at rank ceil(p / 100 * n).

    Equal values are counted first, so what is sorted for a key is its distinct values.
    """
    counts = samples.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_to", F.sum("_n").over(upto))
    n = ranked.groupBy(*keys).agg(F.max("_to").alias("_all"))
    asked = n.select(*keys, "_all", F.explode(F.array(*map(F.lit, percents))).alias("percent")).withColumn("_rank", F.greatest(F.ceil(F.col("percent") * F.col("_all") / 100), F.lit(1)))
    return asked.join(ranked, keys).where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_n") < F.col("_rank"))).select(*keys, "percent", F.col(value).alias("value"))


def clock_gated(samples: DataFrame, shard: str, order: str, max_uncertainty: int, max_jump: int, max_age: int) -> DataFrame:
    """Adds decision (clock_jump, uncertain, negative, accepted) and latency of accepted samples.

    The previous clocks are those of the shard's last sample, whatever was decided on it.
    """
    s = running(samples, [shard], order, {"_before": ("max", F.struct(F.col(order).alias("at"), "wall", "mono"), False)})
    s = s.withColumn("_wall", F.col("_before.wall")).withColumn("_mono", F.col("_before.mono")).drop("_before")
    known = F.col("_wall").isNotNull() & ((F.col("_wall") != 0) | (F.col("_mono") != 0))
    wall, mono = F.col("wall") - F.col("_wall"), F.col("mono") - F.col("_mono")
    jump = known & ((wall < 0) | (mono < 0) | (F.abs(wall - mono) > max_jump))
    age = F.col("wall") - F.col("last_sync")
    stale = (age < 0) | ((age > max_age) if max_age else F.lit(False))
    uncertain = ~F.col("synchronized") | (F.col("quality_domain") != F.col("origin_domain")) | (F.col("uncertainty") > max_uncertainty) | stale
    decision = F.when(jump, "clock_jump").when(uncertain, "uncertain").when(F.col("wall") < F.col("origin"), "negative").otherwise("accepted")
    return s.withColumn("decision", decision).withColumn("latency", F.when(F.col("decision") == "accepted", F.col("wall") - F.col("origin"))).drop("_wall", "_mono")


def traced(events: DataFrame, mode: str, ppm: int, topic="topic_id", source="publisher_id", sequence="source_sequence") -> DataFrame:
    """Events that a policy traces: off and counters none, full all, sampled those under the rate."""
    if mode not in ("off", "counters", "sampled", "full"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "sampled":
        return events.where(sampled(F.col(topic), F.col(source), F.col(sequence), ppm))
    return events.where(F.lit(mode == "full"))


def slow_enough(mode: str, threshold: int, duration: Column, slow: Column) -> Column:
    """False only for quick, unflagged events in sampled mode with a threshold."""
    return F.lit(mode != "sampled" or threshold == 0) | (duration >= threshold) | slow


def rate_limited(events: DataFrame, second: str, order: str, limit: int) -> DataFrame:
    """The first `limit` events of every run of equal seconds, by order; 0 is no limit.

    A change of second, back in time too, begins a new run. A row's place in its run is its place in all less
    that of the last row so far whose second isn't its predecessor's. Rows meet their predecessor in chunks of the order,
    and the last row of a chunk is handed to the next.
    """
    if limit == 0:
        return events
    one = events.withColumn("_all", F.lit(0)).withColumn("_chunk", F.floor(F.col(order) / 1_000_000))
    within = Window.partitionBy("_all", "_chunk").orderBy(order)
    last = one.groupBy("_all", "_chunk").agg(F.max_by(second, order).alias("_final"))
    last = last.select("_chunk", F.lag("_final").over(Window.partitionBy("_all").orderBy("_chunk")).alias("_before"))
    linked = one.withColumn("_prev", F.lag(second).over(within)).join(last, "_chunk")
    begins = F.coalesce(F.coalesce("_prev", "_before") != F.col(second), F.lit(True))
    placed = running(linked.withColumn("_new", begins).drop("_chunk", "_prev", "_before"), ["_all"], order, {"_place": ("sum", F.lit(1).cast("bigint"), True)})
    placed = placed.withColumn("_begin", F.when(F.col("_new"), F.col("_place")))
    runs = running(placed, ["_all"], order, {"_first": ("max", F.col("_begin"), True)})
    return runs.where(F.col("_place") - F.col("_first") < limit).select(*events.columns)


def prometheus_lines(buckets: DataFrame, name: str) -> DataFrame:
    """line: the text form of a histogram, cumulative buckets with counts, then +Inf, sum and count; by name."""
    c = cumulative(buckets, [name])
    line = F.concat(F.col(name), F.lit('_bucket{le="'), bucket_end(F.col("bucket")), F.lit('"} '), F.col("cumulative"))
    ends = buckets.groupBy(name).agg(F.sum("total").alias("_s"), F.sum("count").alias("_c"))
    out = c.where((F.col("count") > 0) | (F.col("bucket") == BUCKETS - 1)).select(name, F.col("bucket").alias("place"), line.alias("line"))
    out = out.union(ends.select(name, F.lit(BUCKETS), F.concat(F.col(name), F.lit("_sum "), F.col("_s").cast("bigint"))))
    return out.union(ends.select(name, F.lit(BUCKETS + 1), F.concat(F.col(name), F.lit("_count "), F.col("_c"))))


def otlp_json(counters: DataFrame, name: str, value: str) -> DataFrame:
    """json: one cumulative, monotonic sum metric for each counter."""
    point = F.struct(F.col(value).cast("string").alias("asInt"))
    total = F.struct(F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"), F.array(point).alias("dataPoints"))
    return counters.select(name, F.to_json(F.struct(F.col(name).alias("name"), total.alias("sum"))).alias("json"))


def otlp_gauge(gauges: DataFrame, name: str, value: str, at_ns: int) -> DataFrame:
    """name and its metric as JSON: a gauge's one point."""
    return gauges.select(F.col(name).alias("name"), F.concat(F.lit('{"name":"'), F.col(name), F.lit(f'","gauge":{{"dataPoints":[{{"timeUnixNano":"{at_ns}","asInt":"'), F.col(value), F.lit('"}]}}')).alias("json"))


def otlp_histogram(buckets: DataFrame, name: str, at_ns: int, start_ns: int) -> DataFrame:
    """name and its metric as JSON, of a histogram's buckets (bucket, count, total): cumulative since start_ns, with the 64 upper bounds between the buckets."""
    whole = buckets.groupBy(F.col(name).alias("name")).agg(F.sum("count").alias("n"), F.sum("total").alias("t"), F.array_sort(F.collect_list(F.struct("bucket", "count"))).alias("b"))
    counts = F.array_join(F.transform("b", lambda x: F.concat(F.lit('"'), x["count"].cast("string"), F.lit('"'))), ",")
    bounds = ",".join(str((1 << i) - 1) for i in range(BUCKETS - 1))
    head = F.concat(F.lit('{"name":"'), F.col("name"), F.lit(f'","histogram":{{"aggregationTemporality":2,"dataPoints":[{{"timeUnixNano":"{at_ns}","startTimeUnixNano":"{start_ns}","count":"'))
    return whole.select("name", F.concat(head, F.col("n"), F.lit('","sum":'), F.col("t"), F.lit(',"bucketCounts":['), counts, F.lit(f'],"explicitBounds":[{bounds}]}}]}}}}')).alias("json"))
