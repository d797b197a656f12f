"""Registry and routing: rules on metadata, routes, drivers, leases, lifecycles, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.plans.running import running

SPSC, MPSC, BROADCAST, WORK_QUEUE = range(4)
BLOCK, FAIL, DROP_NEWEST, DROP_OLDEST, SAMPLE = range(5)
BEST_EFFORT, RELIABLE_ORDERED = range(2)
DISCOVERY, STATIC = range(2)

#: The hard bounds of a topic.
TOPIC_BOUNDS = {"capacity": 1 << 30, "publishers": 65_536, "subscribers": 65_536, "partitions": 4096, "broadcast_subscribers": 64, "name_bytes": 255, "accepted_schemas": 16, "static_routes": 1024}


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys and rule for every rule whose condition holds; null is no violation."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def topic_violations(topics: DataFrame, bounds: dict[str, int] = TOPIC_BOUNDS) -> DataFrame:
    """(topic_id, rule) for every rule that a topic's metadata breaks."""
    c = F.col
    drops = c("queue_full_policy").isin(DROP_NEWEST, DROP_OLDEST, SAMPLE)
    return violations(topics, ["topic_id"], {
        "name": ~c("name").rlike(r"^[A-Za-z0-9_./-]+$") | (F.octet_length("name") > bounds["name_bytes"]),
        "channel_kind": ~c("channel_kind").between(SPSC, WORK_QUEUE),
        "capacity": (c("capacity") <= 0) | (c("capacity").bitwiseAND(c("capacity") - 1) != 0) | (c("capacity") > bounds["capacity"]),
        "publishers": ~c("max_publishers").between(1, bounds["publishers"]),
        "subscribers": ~c("max_subscribers").between(1, bounds["subscribers"]),
        "partitions": ~c("partition_count").between(1, bounds["partitions"]),
        "spsc_single": (c("channel_kind") == SPSC) & ((c("max_publishers") != 1) | (c("max_subscribers") != 1)),
        "mpsc_single": (c("channel_kind") == MPSC) & (c("max_subscribers") != 1),
        "broadcast_bitmap": (c("channel_kind") == BROADCAST) & (c("max_subscribers") > bounds["broadcast_subscribers"]),
        "work_queue_sample": (c("channel_kind") == WORK_QUEUE) & (c("queue_full_policy") == SAMPLE),
        "drop_forbidden": ~c("allow_drop") & drops,
        "ordered_drop": (c("reliability") == RELIABLE_ORDERED) & c("allow_drop"),
        "schema_identity": (c("schema_version") == 0) | (c("layout_version") == 0),
        "discovery_routes": (c("route_policy") == DISCOVERY) & (c("static_route_count") > 0),
        "static_routes": (c("route_policy") == STATIC) & (c("static_route_count") == 0),
        "config_version": c("config_version") == 0,
    } | _more_topic_rules(topics, bounds))


def _more_topic_rules(topics: DataFrame, bounds: dict[str, int]) -> dict[str, Column]:
    """The rules on what a topic's metadata may or may not list: each needs its columns.

    schema_id and accepted_schemas (an array of ids), static_routes (an array of nodes), region_version, channel_version, acl_version,
    route_set_version, state and candidate (whether it is only to be created).
    """
    c, there = F.col, set(topics.columns)
    rules = {
        ("queue_full_policy", "reliability", "route_policy"): {"enum": ~c("queue_full_policy").between(BLOCK, SAMPLE) | ~c("reliability").between(BEST_EFFORT, RELIABLE_ORDERED) | ~c("route_policy").between(DISCOVERY, STATIC)},
        ("state",): {"state": ~c("state").between(0, 4)},
        ("schema_id", "accepted_schemas"): {
            "accepted_bound": F.size("accepted_schemas") > bounds["accepted_schemas"],
            "accepted_identity": F.array_contains("accepted_schemas", F.lit(0).cast("long")) | F.array_contains("accepted_schemas", c("schema_id")),
            "accepted_unique": F.size(F.array_distinct("accepted_schemas")) < F.size("accepted_schemas"),
        },
        ("static_routes",): {
            "route_bound": F.size("static_routes") > bounds["static_routes"],
            "route_target": F.array_contains("static_routes", F.lit(0).cast("long")),
            "route_unique": F.size(F.array_distinct("static_routes")) < F.size("static_routes"),
        },
        ("region_version", "channel_version", "acl_version"): {"resource_version": (c("region_version") == 0) | (c("channel_version") == 0) | (c("acl_version") == 0)},
        ("candidate", "state", "route_set_version"): {
            "candidate_assigned": c("candidate") & ((c("topic_id") != 0) | (c("config_version") != 0) | (c("route_set_version") != 0) | (c("state") != 0)),
            "published_identity": ~c("candidate") & ((c("topic_id") == 0) | (c("route_set_version") == 0)),
        },
    }
    return {name: rule for needs, found in rules.items() if there.issuperset(needs) for name, rule in found.items()}


def node_violations(nodes: DataFrame, max_endpoints: int = 4, max_lease: int = 1400) -> DataFrame:
    """(node_id, rule) for every rule that a node's registration breaks."""
    c = F.col
    return violations(nodes, ["node_id"], {
        "identity": c("node_id") == 0,
        "no_endpoint": c("endpoint_count") == 0,
        "too_many_endpoints": c("endpoint_count") > max_endpoints,
        "trust_domain": F.octet_length("trust_domain") == 0,
        "health": ~c("health").between(0, 2),
        "lease": (c("lease_epoch") == 0) | (c("lease_deadline") > max_lease),
        "config_version": c("config_version") == 0,
    })


# recording policies -------------------------------------------------------------------------

MODES = ("best_effort", "buffered", "durable", "snapshot")
TOPOLOGIES = ("strong", "isolated", "best_effort")
NON_DROPPING = ("block", "fail")


def mode_allowed(mode: Column, topology: Column) -> Column:
    """strong takes buffered and durable, isolated all, best effort all but durable."""
    return F.when(topology == "strong", mode.isin("buffered", "durable")).when(topology == "isolated", F.lit(True)).otherwise(mode != "durable")


def resolved_policy(options: DataFrame) -> DataFrame:
    """Adds error (null if the options agree), and the effective full_policy, ack, sync and complete.

    options: mode, topology, full_policy, ack_level and sync_policy (null for the default), state_topic, complete.
    """
    c = F.col
    snapshot = c("mode") == "snapshot"
    own_ack = F.when(c("mode") == "best_effort", "accepted").when(c("mode") == "buffered", "buffered").when(c("mode") == "durable", "durable")
    own_full = F.when(c("mode") == "best_effort", "drop_newest").when(snapshot, "drop_oldest").otherwise("block")
    own_sync = F.when(c("mode") == "best_effort", "none").when(~snapshot, "interval")
    full, complete = F.coalesce("full_policy", own_full), c("complete") | (c("mode") == "durable") | (c("topology") == "strong")
    sync = F.coalesce("sync_policy", own_sync)
    error = (
        F.when(~mode_allowed(c("mode"), c("topology")), "mode_topology")
        .when(snapshot & ~c("state_topic"), "not_a_state_topic").when(snapshot & c("ack_level").isNotNull(), "snapshot_ack")
        .when(snapshot & c("sync_policy").isNotNull(), "snapshot_sync").when(snapshot & c("complete"), "snapshot_complete")
        .when(~snapshot & c("ack_level").isNotNull() & (c("ack_level") != own_ack), "ack_mismatch")
        .when(c("complete") & (c("mode") == "best_effort"), "best_effort_complete")
        .when(c("complete") & (c("topology") == "best_effort"), "topology_complete")
        .when(snapshot & (full != "drop_oldest"), "snapshot_full_policy").when(complete & ~full.isin(*NON_DROPPING), "complete_drops")
        .when((c("mode") == "durable") & (sync == "none"), "durable_sync")
    )
    ok = F.col("error").isNull()
    return options.withColumn("error", error).select("*", F.when(ok, full).alias("effective_full"), F.when(ok, own_ack).alias("effective_ack"), F.when(ok, sync).alias("effective_sync"), F.when(ok, complete).alias("effective_complete"))


# routes -------------------------------------------------------------------------------------


def usable(nodes: DataFrame, now: int) -> Column:
    """Leased, proven alive and not unavailable."""
    return (F.col("lease_deadline") > now) & (F.col("liveness") == 1) & (F.col("health") != 2)


def routes(topics: DataFrame, static: DataFrame, subscribers: DataFrame) -> DataFrame:
    """topic_id, node_id, policy: static routes of static topics, and the distinct nodes of the others' subscribers."""
    fixed = topics.where(F.col("route_policy") == STATIC).join(static, "topic_id").select("topic_id", "node_id", F.lit("static").alias("policy"))
    found = topics.where(F.col("route_policy") == DISCOVERY).join(subscribers.select("topic_id", "node_id").distinct(), "topic_id")
    return fixed.union(found.select("topic_id", "node_id", F.lit("discovery").alias("policy")))


def reliability_satisfied(requested: Column, reliable: Column) -> Column:
    """Best effort takes any driver, reliable ordered a reliable one; nothing else is offered."""
    return (requested == BEST_EFFORT) | ((requested == RELIABLE_ORDERED) & reliable)


def candidates(targets: DataFrame, drivers: DataFrame) -> DataFrame:
    """Each target with every running driver of its endpoint's kind."""
    return targets.join(drivers.where("is_running"), targets["endpoint_kind"] == drivers["kind"])


def best_driver(targets: DataFrame, drivers: DataFrame, target: str, reliability: Column, payload: Column) -> DataFrame:
    """For each target the best driver that may carry it: health, then priority (high first), then id.

    What matters of a driver for a target is its kind, reliability and frame bound, so drivers come down to the
    best of each such class before they meet the targets.
    """
    fit = drivers.where(F.col("is_running") & F.col("health").isin(0, 1))
    rank = F.struct(F.col("health"), (-F.col("priority")).alias("_p"), F.col("driver_id"))
    classes = fit.groupBy("kind", "reliable", "max_frame").agg(F.min(rank).alias("_r"))
    joined = targets.withColumn("_want", reliability).withColumn("_size", payload).join(classes, F.col("endpoint_kind") == F.col("kind"))
    fits = reliability_satisfied(F.col("_want"), F.col("reliable")) & ((F.col("max_frame") == 0) | (F.col("_size") <= F.col("max_frame")))
    best = joined.where(fits).groupBy(target).agg(F.min("_r").alias("_r"))
    return best.select(target, F.col("_r.driver_id").alias("driver_id"), F.col("_r.health").alias("health"), (-F.col("_r._p")).alias("priority"))


# leases and lifecycles ----------------------------------------------------------------------


def node_sweep(nodes: DataFrame, now: int) -> DataFrame:
    """outcome for each node: active, removed (expired and proven dead), else retained_alive or retained_unknown, unavailable."""
    expired = F.col("lease_deadline") <= now
    live = F.coalesce("liveness", F.lit(0))
    outcome = F.when(~expired, "active").when(live == 2, "removed").when(live == 1, "retained_alive").otherwise("retained_unknown")
    return nodes.select("node_id", outcome.alias("outcome"), F.when(expired, 2).otherwise(F.col("health")).alias("health_after"))


def subscriber_sweep(leases: DataFrame, now: int, lease: int) -> DataFrame:
    """subscriber_id, generation and outcome of each active subscriber's lease: kept, evicted (over, and its owner proven dead) or held (over, its owner not known to be dead).

    A heartbeat from the future keeps. What an evicted owner had pinned goes with it (see pins_after).
    """
    over = (F.col("heartbeat") <= now) & (now - F.col("heartbeat") >= lease)
    outcome = F.when(~over, "kept").when(F.coalesce("liveness", F.lit(0)) == 2, "evicted").otherwise("held")
    return leases.where("active").select("subscriber_id", "generation", outcome.alias("outcome"))


def channel_sweep(slots: DataFrame, now: int, lease: int) -> DataFrame:
    """subscriber_id and outcome by the heartbeat alone: evicted only by one that this generation itself wrote a lease ago; a later generation's slot stays."""
    stale = (F.col("heartbeat_generation") == F.col("generation")) & (now - F.col("heartbeat") >= lease)
    return slots.where("active").select("subscriber_id", F.when(stale, "evicted").otherwise("kept").alias("outcome"))


def pins_after(pins: DataFrame, sweep: DataFrame) -> DataFrame:
    """The pins whose subscriber, in that generation, was not evicted."""
    return pins.join(sweep.where("outcome = 'evicted'").select("subscriber_id", "generation"), ["subscriber_id", "generation"], "left_anti")


def reservation_aborts(reservations: DataFrame, now: int, lease: int) -> DataFrame:
    """Reservations that become tombstones: the owner is proven dead, and the age is over, unknown or in the future."""
    old = (F.col("reserved_at") == 0) | (F.col("reserved_at") > now) | (now - F.col("reserved_at") >= lease)
    return reservations.where((F.col("liveness") == 2) & old)


#: Allowed moves of a topic: 0 creating, 1 active, 2 draining, 3 retired, 4 deleted.
TOPIC_MOVES = ((0, 1), (1, 2), (2, 3), (3, 4))


def usage(topics: DataFrame, participants: DataFrame) -> DataFrame:
    """Counts by topic and kind of registration, and whether they keep it from retiring or being deleted."""
    names = ("publishers", "subscribers", "bridges", "recorders", "replay_pins")
    p = participants.groupBy("topic_id").agg(*[F.count_if(F.col("kind") == i).alias(n) for i, n in enumerate(names)])
    all_ = topics.join(p, "topic_id", "left").na.fill(0, list(names))
    return all_.select("topic_id", *names, (sum((F.col(n) for n in names[1:4]), F.col(names[0])) > 0).alias("blocks_retire"), (F.col("replay_pins") > 0).alias("blocks_delete"))


def subscriber_nodes(subscribers: DataFrame) -> DataFrame:
    """The sorted distinct nodes of each topic's subscribers. Distinct first: a list holds nodes, not registrations."""
    return subscribers.select("topic_id", "node_id").distinct().groupBy("topic_id").agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("nodes"), F.count("*").alias("n"))


def version_breaks(history: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """Rows of a registry's history whose version doesn't rise."""
    w = Window.partitionBy(key).orderBy(order)
    return history.withColumn("previous", F.lag(version).over(w)).where(F.col(version) <= F.col("previous"))


def impaired_time(states: DataFrame, key: str, at: str, impaired: Column, now: int) -> DataFrame:
    """Time spent in impaired states by key; the last one lasts until now."""
    w = Window.partitionBy(key).orderBy(at)
    lasts = F.coalesce(F.lead(at).over(w), F.lit(now)) - F.col(at)
    return states.withColumn("_t", F.when(impaired, lasts).otherwise(0)).groupBy(key).agg(F.sum("_t").cast("bigint").alias("degraded"), F.count_if(impaired).alias("episodes"))


# channels -----------------------------------------------------------------------------------


def delivered(messages: DataFrame, members: DataFrame) -> DataFrame:
    """(topic_id, subscriber_id) with what it gets: messages at or after its join and before it left, without tombstones.

    Only counts and ends are needed for each subscriber, so messages are counted up to every sequence once,
    and a membership reads the counts at its two ends instead of being joined with its messages.
    """
    shown = (F.col("flags").bitwiseAND(2) == 0).cast("bigint")
    upto = running(messages, ["topic_id"], "sequence", {"_n": ("sum", shown, True)}).select("topic_id", "sequence", "_n")
    ends = members.select("topic_id", "subscriber_id", F.explode(F.array(F.struct((F.col("joined_at") - 1).alias("sequence"), F.lit(-1).alias("sign")), F.struct((F.col("left_at") - 1).alias("sequence"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("topic_id", "subscriber_id", "e.sign", F.col("e.sequence").alias("asked"))
    # the count at the last message up to the asked one: both kinds in one order, carried forward
    both = upto.select("topic_id", F.col("sequence").alias("asked"), F.col("_n"), F.lit(None).cast("bigint").alias("subscriber_id"), F.lit(None).cast("int").alias("sign"))
    both = both.unionByName(ends.withColumn("_n", F.lit(None).cast("bigint")))
    # a message comes before the ends that ask at it; ends at one place add nothing to each other
    both = both.withColumn("_place", F.col("asked") * 2 + F.col("sign").isNotNull().cast("int"))
    carried = running(both, ["topic_id"], "_place", {"_at": ("max", F.col("_n"), True)}).where("sign is not null").withColumn("_at", F.coalesce("_at", F.lit(0)))
    return carried.groupBy("topic_id", "subscriber_id").agg(F.sum(F.col("sign") * F.col("_at")).cast("bigint").alias("delivered"))


def least_cursor(subscribers: DataFrame) -> DataFrame:
    """The smallest cursor of the active subscribers of each topic, and how many hold it."""
    active = subscribers.where("active").groupBy("topic_id", "cursor").agg(F.count("*").alias("n"))
    return active.groupBy("topic_id").agg(F.min("cursor").alias("least"), F.min_by("n", "cursor").alias("tied"))


def drop_gaps(drops: DataFrame) -> DataFrame:
    """By subscriber and generation: events and messages lost to forced drops, and the last range."""
    return drops.groupBy("subscriber_id", "generation").agg(F.count("*").alias("events"), F.count("*").alias("messages"), F.max("sequence").alias("last_first"), (F.max("sequence") + 1).alias("last_end"))


def assigned(messages: DataFrame, consumers: int) -> DataFrame:
    """Competing consumers: each message goes to exactly one, in turn."""
    return messages.withColumn("consumer", F.col("sequence") % consumers)


# schemas as relations -----------------------------------------------------------------------


def closure(edges: DataFrame, folder: str) -> DataFrame:
    """All (type, dependency) pairs reachable over edges(type, dependency).

    Paths are doubled in each round and kept distinct, so rounds are the logarithm of the longest path and
    cycles end. Every round's pairs are written under folder, which cuts the lineage.
    """
    spark, found, before, k = edges.sparkSession, edges.select("type", "dependency").distinct(), -1, 0
    while True:
        found.write.mode("overwrite").parquet(f"{folder}/round{k}")
        found = spark.read.schema(found.schema).parquet(f"{folder}/round{k}")
        n = found.count()
        if n == before:
            return found
        before, k = n, k + 1
        step = found.alias("a").join(found.alias("b"), F.col("a.dependency") == F.col("b.type")).select("a.type", "b.dependency")
        found = found.union(step).distinct()


def field_directions(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, field_id, direction of every field of two versions of a type.

    neutral, read, write or incompatible: an added field must be optional and not reserved before, a removed one
    optional and reserved now; a matching one must keep type, cardinality and default; a lower limit
    can only be written, a higher one only be read by the older side.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.key") == F.col("n.key")) & (F.col("o.field_id") == F.col("n.field_id")), "full_outer")
    added, removed = F.col("o.key").isNull(), F.col("n.key").isNull()
    same = (F.col("o.type") == F.col("n.type")) & (F.col("o.cardinality") == F.col("n.cardinality")) & F.col("o.default").eqNullSafe(F.col("n.default"))
    limit = F.when(F.col("o.max_bytes").eqNullSafe(F.col("n.max_bytes")), "neutral").when(F.col("o.max_bytes").isNull(), "write").when(F.col("n.max_bytes").isNull(), "read").when(F.col("n.max_bytes") < F.col("o.max_bytes"), "write").otherwise("read")
    direction = (
        F.when(added, F.when((F.col("n.cardinality") == "optional") & ~F.col("n.reserved_before"), "neutral").otherwise("incompatible"))
        .when(removed, F.when((F.col("o.cardinality") == "optional") & F.col("o.reserved_after"), "neutral").otherwise("incompatible"))
        .otherwise(F.when(same, limit).otherwise("incompatible"))
    )
    return both.select(F.coalesce("o.key", "n.key").alias("key"), F.coalesce("o.field_id", "n.field_id").alias("field_id"), direction.alias("direction"))


def compatibility(directions: DataFrame) -> DataFrame:
    """wire, read, write or incompatible by key: directions that disagree are incompatible."""
    has = {d: F.max((F.col("direction") == d).cast("int")) == 1 for d in ("incompatible", "read", "write")}
    verdict = F.when(has["incompatible"] | (has["read"] & has["write"]), "incompatible").when(has["read"], "read").when(has["write"], "write").otherwise("wire")
    return directions.groupBy("key").agg(verdict.alias("compatibility"))


def slab_counts(slots: DataFrame, magic: int, crc_ok: str = "crc_ok") -> DataFrame:
    """Counts by finding. state: 0 free, 1 allocated, 2 building, 3 published, 4 retired; others are unknown."""
    c = F.col
    finding = (
        F.when(~c("occupied"), F.when(c("state") == 0, "free").otherwise("inconsistent"))
        .when(c("magic") != magic, "corrupt").when(c("state") == 3, F.when(c(crc_ok) & (c("size") <= c("capacity")), "ok").otherwise("corrupt"))
        .when(c("state").between(0, 4), "orphan").otherwise("corrupt")
    )
    return slots.groupBy(finding.alias("finding")).agg(F.count("*").alias("slots"))
