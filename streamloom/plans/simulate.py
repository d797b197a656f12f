"""Order-dependent state machines over one key's log, as plain Python; simulations.py runs them on Spark by key.

Each takes an iterable of events in order and yields decisions, holding no more than the machine's own bounded state.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

POLICIES = ("block", "fail", "drop_newest", "drop_oldest", "sample")


def bounded_queue(events: Iterable[tuple[str, int]], capacity: int, policy: str, sample_rate: int = 1) -> Iterator[tuple[int, str, int | None]]:
    """events: ("enqueue" | "dequeue", id). Yields (id, outcome, retired id or None).

    Full: block waits (would_block), fail errs, drop_newest refuses the new one, drop_oldest retires exactly one.
    Sample lets a message wait only where the publish cursor is a multiple of the rate; the cursor stands still on
    rejection, so while the queue is full an unlucky cursor rejects every message.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    queue: deque[int] = deque()
    cursor = 0
    for kind, item in events:
        if kind == "dequeue":
            yield (item, "dequeued", queue.popleft()) if queue else (item, "empty", None)
            continue
        retired = None
        if len(queue) >= capacity:
            if policy == "drop_oldest":
                retired = queue.popleft()
            else:
                lucky = policy == "sample" and sample_rate > 0 and cursor % sample_rate == 0
                yield item, {"block": "would_block", "fail": "failed", "drop_newest": "dropped"}.get(policy, "would_block" if lucky else "sampled_out"), None
                continue
        queue.append(item)
        cursor += 1
        yield item, "accepted", retired


def charge(size: int, classes: tuple[int, ...], most: int) -> int | None:
    """What a payload is charged; None if it is too large."""
    if size == 0:
        return 0
    for c in classes:
        if size <= c:
            return c
    return None if size > most else min(-(-size // classes[0]) * classes[0], most)


@dataclass
class BufferPool:
    """A queue under a global, a per-topic and a slot limit on charged bytes."""

    global_limit: int
    topic_limit: int
    slots: int
    classes: tuple[int, ...] = (4 << 10, 64 << 10, 1 << 20)
    most: int = 16 << 20
    high: float = 0.8
    low: float = 0.5
    queue: deque = field(default_factory=deque)
    used: int = 0
    topics: dict[int, int] = field(default_factory=dict)
    failed: bool = False

    def _fits(self, topic: int, cost: int, freed: int = 0, freed_topic: int = 0, freed_slots: int = 0) -> bool:
        return len(self.queue) - freed_slots < self.slots and self.used - freed + cost <= self.global_limit and self.topics.get(topic, 0) - freed_topic + cost <= self.topic_limit

    def reserve(self, item: int, topic: int, size: int, policy: str) -> tuple[str, list[int]]:
        """(outcome, evicted ids). drop_oldest evicts the shortest prefix, over all topics, that makes every limit hold; fail is for good."""
        if self.failed:
            return "recording_failed", []
        cost = charge(size, self.classes, self.most)
        if cost is None:
            return "too_large", []
        evicted: list[int] = []
        if not self._fits(topic, cost):
            if policy == "block":
                return ("would_block" if cost <= min(self.global_limit, self.topic_limit) else "too_large"), []
            if policy == "fail":
                self.failed = True
                return "recording_failed", []
            if policy == "drop_newest":
                return "dropped_newest", []
            freed = freed_topic = n = 0
            for _, t, c in self.queue:
                freed, n = freed + c, n + 1
                freed_topic += c if t == topic else 0
                if self._fits(topic, cost, freed, freed_topic, n):
                    break
            else:
                return "dropped_newest", []
            evicted = [self.dequeue() for _ in range(n)]
        self.queue.append((item, topic, cost))
        self.used += cost
        self.topics[topic] = self.topics.get(topic, 0) + cost
        return "accepted", evicted

    def dequeue(self) -> int | None:
        if not self.queue:
            return None
        item, topic, cost = self.queue.popleft()
        self.used -= cost
        self.topics[topic] -= cost
        return item

    def pressure(self) -> str:
        return "high" if self.used >= self.high * self.global_limit else "low" if self.used <= self.low * self.global_limit else "normal"


@dataclass
class DedupWindow:
    """A receiver's memory of what it has accepted from many sources of one session."""

    distance: int = 4096
    max_sources: int = 1024
    max_age: int = 60_000_000_000
    epoch: int = 1
    sources: OrderedDict = field(default_factory=OrderedDict)
    clock: int = 0

    def offer(self, epoch: int, source, sequence: int, now: int) -> tuple[str, int | None]:
        """(decision, highest contiguous sequence), committing what is accepted."""
        if epoch != self.epoch:
            return "stale_session", None
        if sequence <= 0:
            return "invalid", None
        now = self.clock = max(self.clock, now)  # time doesn't go back
        while self.sources and now - next(iter(self.sources.values()))[2] >= self.max_age:  # the least recently heard is first
            self.sources.popitem(last=False)
        highest, beyond, _ = self.sources.get(source, (0, set(), now))
        if sequence <= highest:
            decision = "duplicate" if highest - sequence < self.distance else "nack"
        elif sequence - highest > self.distance:
            decision = "nack"
        elif sequence in beyond:
            decision = "duplicate"
        else:
            decision = "accept"
        if decision == "accept":
            if source not in self.sources and len(self.sources) >= self.max_sources:
                self.sources.popitem(last=False)
            beyond.add(sequence)
            while highest + 1 in beyond:
                highest += 1
                beyond.discard(highest)
        if decision == "accept" or source in self.sources:
            self.sources[source] = (highest, beyond, now)
            self.sources.move_to_end(source)
        return decision, highest


@dataclass
class ReceiptTable:
    """Outstanding receipts under a limit for the table and one for each publisher."""

    max_outstanding: int = 65536
    max_per_publisher: int = 1024
    owners: dict[int, int] = field(default_factory=dict)
    held: dict[int, int] = field(default_factory=dict)

    def reserve(self, receipt: int, publisher: int) -> str:
        """admitted, or which limit refuses; the table's own comes first."""
        if len(self.owners) >= self.max_outstanding:
            return "rejected_table"
        if self.held.get(publisher, 0) >= self.max_per_publisher:
            return "rejected_publisher"
        self.owners[receipt] = publisher
        self.held[publisher] = self.held.get(publisher, 0) + 1
        return "admitted"

    def complete(self, receipt: int) -> bool:
        """Frees the receipt's place; False if it has none (a second completion changes nothing)."""
        publisher = self.owners.pop(receipt, None)
        if publisher is None:
            return False
        self.held[publisher] -= 1
        if not self.held[publisher]:
            del self.held[publisher]
        return True


@dataclass
class RecoveryChain:
    """What becomes of a partition's segment files on recovery, one by one: tracked ones first, then untracked ones in the order of their ids.

    An untracked file is taken over if it can be read, its id is above the last taken one's and it begins right after it; one
    with a damaged tail is repaired first. What it ends with is what the next must follow. The others are quarantined.
    """

    last_id: int = 0
    last_sequence: int = 0

    def offer(self, segment_id: int, first: int, last: int, tracked: bool, sealed: bool, readable: bool) -> str:
        if not tracked and not (readable and segment_id > self.last_id and first == self.last_sequence + 1):
            return "quarantine"
        self.last_id, self.last_sequence = max(self.last_id, segment_id), max(self.last_sequence, last)
        return ("keep" if sealed else "repair_tail") if tracked else ("adopt" if sealed else "repair_adopt")


def admission(events: Iterable[tuple[int, str, bool]], topology: str, full_policy: str = "block", state: str = "ready") -> Iterator[dict]:
    """events: (available cursor, recorder state or "", sink full). Yields outcome, reason, cursor after and the gap [first, last) it owes.

    strong blocks or fails the primary and never drops; isolated and best_effort admit the primary and owe a gap
    for what the recorder misses: the lag before the cursor, and one record while the sink is full.
    """
    cursor = 0
    for available, new_state, full in events:
        state = new_state or state
        out = {"outcome": "record", "reason": "ready", "gap": None}
        if available < cursor:
            yield out | {"outcome": "invalid", "reason": "stale_cursor", "cursor": cursor}
            continue
        if state == "unbound":
            cursor = available + 1
            yield out | {"outcome": "bypass", "reason": "unbound", "cursor": cursor}
            continue
        if topology == "strong":
            reason = "recorder_failed" if state == "failed" else "recorder_degraded" if state == "degraded" else "cursor_lag" if available != cursor else "buffer_full" if full else None
            if reason is None:
                cursor = available + 1
                yield out | {"cursor": cursor}
                continue
            if reason == "cursor_lag":
                state = "degraded"
            failed = state == "failed" or full_policy == "fail"
            state = "failed" if failed else state
            yield {"outcome": "fail_primary" if failed else "block_primary", "reason": reason, "gap": None, "cursor": cursor}
            continue
        if state in ("degraded", "failed"):
            out = {"outcome": "drop_recording", "reason": f"recorder_{state}", "gap": (cursor, available + 1)}
        else:
            if available > cursor:
                out |= {"reason": "cursor_lag", "gap": (cursor, available)}
            if full:
                first = cursor if out["gap"] else available
                out = {"outcome": "drop_recording", "reason": "buffer_full", "gap": (first, available + 1)}
                state = "failed" if full_policy == "fail" else state
        cursor = available + 1
        yield out | {"cursor": cursor}


def reservations(events: Iterable[tuple[str, int, dict]], limit: dict, reserve: dict, order: tuple[str, ...]) -> Iterator[tuple[int, str, str | None]]:
    """events: (reserve_data | reserve_control | commit | rollback | release, request id, resources). Yields (id, outcome, refusing dimension)."""
    pending: dict[int, dict] = {}
    committed: dict[int, dict] = {}
    used = dict.fromkeys(order, 0)
    for kind, request, resources in events:
        if kind.startswith("reserve"):
            data = kind == "reserve_data"
            bad = next((x for x in order if resources.get(x, 0) > 0 and resources[x] > max(0, limit[x] - (reserve[x] if data else 0) - used[x])), None)
            if bad or not any(resources.values()):
                yield request, "rejected" if bad else "invalid", bad
                continue
            pending[request] = resources
            for x, n in resources.items():
                used[x] += n
            yield request, "reserved", None
            continue
        held = pending if kind in ("commit", "rollback") else committed
        if request not in held:
            yield request, "unknown", None
            continue
        own = held.pop(request)
        if kind == "commit":
            committed[request] = own
        else:
            for x, n in own.items():
                used[x] -= n
        yield request, {"commit": "committed", "rollback": "rolled_back", "release": "released"}[kind], None


def rotation(records: Iterable[tuple[int, int]], max_bytes: int, max_records: int, max_ns: int) -> Iterator[tuple[int, int]]:
    """records: (size, time). Yields (segment, place): a new segment begins before a record that would pass a limit, never with an empty one."""
    segment, n, size, began = 0, 0, 0, None
    for length, at in records:
        if n and (size + length > max_bytes or n >= max_records or at - began >= max_ns):
            segment, n, size, began = segment + 1, 0, 0, None
        began = at if began is None else began
        yield segment, n
        n, size = n + 1, size + length


@dataclass
class Negotiator:
    """Frames of one connection wait for their schema: each unknown ref is asked for once, a few in a second."""

    max_frames: int = 1024
    max_bytes: int = 4 << 20
    per_second: int = 16
    ready: set = field(default_factory=set)
    asked: set = field(default_factory=set)
    waiting: dict = field(default_factory=dict)
    size: int = 0
    window: int | None = None
    sent: int = 0
    failed: bool = False

    def frame(self, item: int, ref: int, size: int, now_s: int) -> list[tuple[int, str]]:
        if self.failed:
            return [(item, "connection_failed")]
        if ref in self.ready:
            return [(item, "passed")]
        held = sum(map(len, self.waiting.values()))
        if held + 1 > self.max_frames or self.size + size > self.max_bytes:
            lost = [(i, "discarded") for r in sorted(self.waiting) for i, _ in self.waiting[r]]
            self.waiting, self.size, self.failed = {}, 0, True
            return [*lost, (item, "connection_failed")]
        if ref not in self.asked:
            if self.window != now_s:
                self.window, self.sent = now_s, 0
            if self.sent >= self.per_second:
                return [(item, "rate_limited")]
            self.sent += 1
            self.asked.add(ref)
        self.waiting.setdefault(ref, []).append((item, size))
        self.size += size
        return [(item, "buffered")]

    def announce(self, ref: int) -> list[tuple[int, str]]:
        self.ready.add(ref)
        out = self.waiting.pop(ref, [])
        self.size -= sum(n for _, n in out)
        return [(i, "released") for i, _ in out]


@dataclass
class BroadcastChannel:
    """A ring that every subscriber reads at its own pace; where it is full, its oldest message is dropped for all who wait for it, or for none."""

    capacity: int
    drop: bool = True
    next: int = 0
    cursors: dict[int, int] = field(default_factory=dict)
    borrowed: set[int] = field(default_factory=set)
    gaps: dict[int, tuple[int, int]] = field(default_factory=dict)
    dropped: dict[int, int] = field(default_factory=dict)

    def join(self, subscriber: int) -> None:
        """Reads from the next message on."""
        self.cursors[subscriber], self.dropped[subscriber] = self.next, 0

    def leave(self, subscriber: int) -> None:
        for held in (self.cursors, self.gaps, self.dropped):
            held.pop(subscriber, None)
        self.borrowed.discard(subscriber)

    def publish(self) -> tuple[str, int | None]:
        """published, with the sequence that was dropped for it if any; would_block where one who reads the oldest holds it, or nothing may be dropped."""
        lost = None
        least = min(self.cursors.values(), default=self.next)
        if self.next - least >= self.capacity:
            tied = [s for s, c in self.cursors.items() if c == least]
            if not self.drop or self.borrowed.intersection(tied):
                return "would_block", None
            for s in tied:  # the gap is told before the cursor moves past it
                first = self.gaps[s][0] if s in self.gaps and self.gaps[s][1] == least else least
                self.gaps[s] = (first, least + 1)
                self.dropped[s] += 1
                self.cursors[s] = least + 1
            lost = least
        self.next += 1
        return "published", lost

    def poll(self, subscriber: int) -> tuple[str, int, int]:
        """A gap, once, before what follows it; else the next message, held until it is released; else empty."""
        cursor = self.cursors[subscriber]
        if subscriber in self.borrowed:
            return "held", cursor, cursor + 1
        if subscriber in self.gaps:
            return ("gap", *self.gaps.pop(subscriber))
        if cursor == self.next:
            return "empty", cursor, cursor
        self.borrowed.add(subscriber)
        return "message", cursor, cursor + 1

    def release(self, subscriber: int) -> bool:
        """Moves past the message held; False if none is."""
        if subscriber not in self.borrowed:
            return False
        self.borrowed.remove(subscriber)
        self.cursors[subscriber] += 1
        return True


@dataclass
class Reassembler:
    """Fragments put together under quotas of messages and bytes, for a time; messages that were put together lately are remembered."""

    connection_messages: int
    messages: int
    connection_bytes: int
    bytes: int
    timeout: int
    open: dict = field(default_factory=dict)
    done: OrderedDict = field(default_factory=OrderedDict)
    timeouts: int = 0

    def expire(self, now: int) -> None:
        """Forgets what began, or was complete, a timeout ago."""
        for key in [k for k, m in self.open.items() if now - m["created"] >= self.timeout]:
            del self.open[key]
            self.timeouts += 1
        while self.done and now - next(iter(self.done.values())) >= self.timeout:
            self.done.popitem(last=False)

    def offer(self, connection: int, message: int, index: int, count: int, total: int, crc: int, data: bytes, now: int) -> tuple[str, bytes | None]:
        """(stored | duplicate | quota | rejected | complete, the payload if complete). What disagrees with its message ends it."""
        self.expire(now)
        key = (connection, message)
        if key in self.done:
            return "duplicate", None
        if not 0 <= index < count or not data:
            return "rejected", None
        m = self.open.get(key)
        if m is None:
            own = [x["total"] for (c, _), x in self.open.items() if c == connection]
            if len(own) >= self.connection_messages or len(self.open) >= self.messages or sum(own) + total > self.connection_bytes or sum(x["total"] for x in self.open.values()) + total > self.bytes:
                return "quota", None
            m = self.open[key] = {"count": count, "total": total, "crc": crc, "created": now, "parts": {}}
        if (m["count"], m["total"], m["crc"]) != (count, total, crc) or m["parts"].get(index, data) != data:
            del self.open[key]
            return "rejected", None
        if index in m["parts"]:
            return "duplicate", None
        m["parts"][index] = data
        if len(m["parts"]) < count:
            return "stored", None
        del self.open[key]
        whole = b"".join(m["parts"][i] for i in range(count))
        if len(whole) != total or zlib.crc32(whole) != crc:
            return "rejected", None
        while len(self.done) >= self.messages:
            self.done.popitem(last=False)
        self.done[key] = now
        return "complete", whole
