"""Removes every byte of a string of SPAN bytes that starts more than once in the corpus.

A full suffix array of the corpus would have to be one sort of all suffixes, so the
suffixes are sampled: the smallest hash of GRAM bytes in a window of SPAN bytes is the
window's anchor, and equal windows have their anchors in the same place. The windows of
one anchor are a span around it. Only suffixes at anchors that occur elsewhere matter:

1. Blocks ask the hash partition of each anchor whether it occurs again. Anchors that occur
   once are no repeats.
2. The spans of the others meet in the partition, each different one of a block once. Spans
   that recur whole are classes, told by their bytes. The distinct spans of an anchor form an
   enhanced suffix array: sorted by the bytes from the anchor on, with common prefix lengths.
   A stack scan gives the tree of common-prefix intervals. Each interval's left contexts are
   scanned the same way, which tests whether what precedes a repeat differs, so every maximal
   repeat comes out once, with all its occurrences.
3. Covered bytes are removed from their block's documents.

An anchor with more than GROUP distinct spans (a passage that stands in so many different
contexts) would be one task's work, as many as there are: its spans aren't gathered, and their
windows go one by one to the partition of the window instead. They are compared by two
independent 64-bit hashes; all else is compared byte by byte.

repeat_groups gives the maximal repeats themselves. One that is longer than a span comes out at
each of its anchors, as far as the anchor's spans reach.

Null and empty texts have no bytes. Repeated rows are copies of each other. An empty table
gives no rows. Only key and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .blocks import answered, asked, blocked, bucket_count, bucket_of, of_step, split, with_answers
from .common import batch_of, column

SPAN, GRAM, GROUP = 200, 50, 256
#: Bytes of text whose anchors share a bucket, about.
BUCKET_BYTES = 8 << 20
#: Window starts of a block that are hashed at once: a task holds some arrays of so many 64-bit numbers, however long its texts are.
CHUNK = 1 << 19

_M = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base (odd) to the power i and its inverse, modulo 2^64, kept for the next chunk."""
    if int(base) not in _POWERS or len(_POWERS[int(base)][0]) < n:
        inverse = pow(int(base), -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[int(base)] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(0, n - 1), m, np.uint64)))) for m in (base, np.uint64(inverse)))
    power, inverse = _POWERS[int(base)]
    return power[:n], inverse[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of data, by prefix sums of a polynomial modulo 2^64, mixed. Each kind has a table and a base of its own."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        power, self.inverse = _powers(len(data) + 1, _M + np.uint64(kind << 20))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_TABLE >> np.uint64(kind))[data] * power[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Of data[start:end], elementwise (slices or index arrays)."""
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def _sliding_least(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` consecutive values."""
    have = 1
    while have * 2 <= window:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (window - have)], x[window - have :]) if window > have else x


class Anchors:
    """The anchors of a block's documents: place, first and last window start, hash of the gram and of the span."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, span: int, gram: int):
        self.data, self.span = data, span
        found = [self._chunk(ends, gram, a) for a in range(0, len(data) - span + 1, CHUNK)]
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.place, self.first, self.last, self.gram_hash, self.span_hash = (np.concatenate([np.zeros(0, kind), *(x[i] for x in found)]) for i, kind in enumerate(kinds))

    def _chunk(self, ends: np.ndarray, gram: int, a: int) -> list[np.ndarray]:
        """Of the anchors whose first window starts at a to a + CHUNK. An anchor has at most span windows: some more, and the one before, are looked at."""
        span = self.span
        windows = len(self.data) - span + 1
        low, high = max(0, a - 1), min(windows, a + CHUNK + span)
        data = self.data[low : high - 1 + span]
        at = np.arange(low, high)
        window = np.flatnonzero(at + span <= ends[np.searchsorted(ends, at, side="right")])  # those that stay within their document
        if not len(window):
            return [window, window, window, window.astype(np.uint64), window.astype(np.uint64)]
        hashes = Hashes(data)
        n = len(data) - gram + 1
        grams = hashes.of(slice(0, n), slice(gram, gram + n))
        bits = np.uint64((1 << (CHUNK + 2 * span).bit_length()) - 1)  # as many for every chunk, so that all compare the same bits of a hash
        least = _sliding_least((grams & ~bits) | np.arange(n, dtype=np.uint64), span - gram + 1)
        anchor = (least & bits).astype(np.int64)[window]
        edge = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        place, first = anchor[edge], window[edge]
        last = window[np.concatenate((edge[1:], [len(window)])) - 1]
        own = (first + low >= a) & (first + low < a + CHUNK)
        place, first, last = place[own], first[own], last[own]
        gram_hash = _mixed(grams[place] ^ _M)  # the least hashes are all small: mixed again, they spread over the buckets
        shape = (place - first).astype(np.uint64) * np.uint64(1 << 32) + (last - first).astype(np.uint64)
        span_hash = _mixed(hashes.of(first, last + span) + shape * _M)
        return [place + low, first + low, last + low, gram_hash, span_hash]

    def window_hashes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows that start there (rising)."""
        edges = np.searchsorted(start, np.arange(0, len(self.data) + CHUNK, CHUNK))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = start[edges[k] : edges[k + 1]] - k * CHUNK
            for kind in (0, 1):
                out[kind].append(Hashes(self.data[k * CHUNK : (k + 1) * CHUNK + self.span], kind).of(at, at + self.span))
        return np.concatenate(out[0]), np.concatenate(out[1])


# The answers of step 1, for anchors that occur again: the span is compared with the anchor's others; its windows are;
# it is compared with its like alone; that and its windows are.
COMPARE, WINDOWS, AGAIN, AGAIN_WINDOWS = 1, 2, 3, 4


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one behind the other, with their byte lengths before."""
    raw = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw)


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    sizes = np.frombuffer(payload, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def classify(payloads: list[bytes], group: int) -> list[bytes | None]:
    """Step 1 in one bucket: payloads of (gram hash, span hash) in, (places in the payload, codes) out."""
    parts = [_unpack(x, np.uint64, np.uint64) for x in payloads]
    sizes = [len(a) for a, _ in parts]
    gram, whole = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.lexsort((whole, gram))
    g, w = gram[order], whole[order]
    new_group = np.concatenate(([True], g[1:] != g[:-1]))
    new_class = new_group | np.concatenate(([True], w[1:] != w[:-1]))
    group_of, class_of = np.cumsum(new_group) - 1, np.cumsum(new_class) - 1
    in_group, in_class = np.bincount(group_of), np.bincount(class_of)
    first_class = class_of[new_group]
    large = (np.diff(np.concatenate((first_class, [len(in_class)]))) > group)[group_of]
    again = (in_class > 1)[class_of]
    code = np.where(in_group[group_of] < 2, 0, np.where(large, np.where(again, np.where(new_class, AGAIN_WINDOWS, AGAIN), WINDOWS), COMPARE))
    back = np.zeros(len(order), np.uint8)
    back[order] = code
    out: list[bytes | None] = []
    for codes in np.split(back, np.cumsum(sizes)[:-1]):
        hit = np.flatnonzero(codes)
        out.append(_pack(hit.astype(np.uint32), codes[hit]) if len(hit) else None)
    return out


def lcp_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix length, first, last) of every interval of the tree over neighbours' common prefixes, by a stack scan."""
    stack = [(0, 0)]
    for i, x in enumerate([*lcp, -1], start=1):
        begin = i - 1
        while stack and stack[-1][0] > x:
            length, begin = stack.pop()
            yield length, begin, i - 1
        if not stack or stack[-1][0] < x:
            stack.append((x, begin))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, all occurrences) of the maximal repeats of at least `least` bytes.

    left: the reversed bytes before each anchor; right: the bytes from it on.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    rights = [common_prefix(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    for r, i, j in lcp_intervals(rights):
        if not r:
            continue
        members = sorted(order[i : j + 1], key=left.__getitem__)
        lefts = [common_prefix(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        for n, a, b in lcp_intervals(lefts):
            if n + r >= least and b > a:
                yield n, r, members[a : b + 1]


# What a block sends of the spans it compares: gram hash, bytes before the anchor, length, bytes, whether the block has it
# more than once, whether it is compared with its like alone; of the windows two hashes, ordinal of the anchor, step.
_SENT = (np.uint64, np.int32, np.int32, np.uint8, np.bool_, np.bool_, np.uint64, np.uint64, np.uint32, np.uint16)
# What comes back: places in the payload, from, to and repeat of the ranges of spans; ordinal and step of windows.
# Where repeats aren't listed, a span has one range: all its repeats hold its anchor, so what they cover is one range.
_BACK = (np.uint32, np.int32, np.int32, np.uint64, np.uint32, np.uint16)


def compare(payloads: list[bytes], span: int, listed: bool = False) -> list[bytes | None]:
    """Step 2 in one bucket: covered byte ranges of spans (listed: those of every repeat), and windows that occur again."""
    parts = [_unpack(x, *_SENT) for x in payloads]
    found: list[list[list[int]]] = [[[], [], [], []] for _ in parts]
    gram = np.concatenate([p[0] for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    inner = np.concatenate([np.arange(len(p[0])) for p in parts])
    ends = [np.cumsum(p[2]) for p in parts]
    raw = [p[3].tobytes() for p in parts]
    order = np.argsort(gram, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], gram[order][1:] != gram[order][:-1], [True]))) if len(order) else []
    for a, b in zip(edges, edges[1:], strict=False):
        classes: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        twice: set[tuple[int, bytes]] = set()
        alone = False
        for x in order[a:b]:
            p, k = int(owner[x]), int(inner[x])
            same = int(parts[p][1][k]), raw[p][int(ends[p][k]) - int(parts[p][2][k]) : int(ends[p][k])]
            classes.setdefault(same, []).append((p, k))
            if parts[p][4][k]:
                twice.add(same)
            alone = alone or bool(parts[p][5][k])

        def report(same: tuple[int, bytes], n: int, r: int) -> None:
            """The bytes from n before the anchor to r from it on, in all places of a class."""
            before, data = same
            repeat = xxhash.xxh64_intdigest(data[before - n : before + r]) if listed else 0
            for p, k in classes[same]:
                for list_, value in zip(found[p], (k, before - n, before + r, repeat), strict=True):
                    list_.append(value)

        distinct = list(classes)
        whole = [len(classes[same]) > 1 or same in twice for same in distinct]
        for same, again in zip(distinct, whole, strict=True):
            if again:
                report(same, same[0], len(same[1]) - same[0])
        if len(distinct) > 1 and not alone and (listed or not all(whole)):
            covered: dict[int, tuple[int, int]] = {}
            for n, r, members in maximal_repeats([d[:m][::-1] for m, d in distinct], [d[m:] for m, d in distinct], span):
                for x in members:
                    if listed:
                        report(distinct[x], n, r)
                    elif not whole[x]:
                        most = covered.get(x, (0, 0))
                        covered[x] = max(n, most[0]), max(r, most[1])
            for x, (n, r) in covered.items():
                report(distinct[x], n, r)
    first, second = (np.concatenate([p[k] for p in parts]) for k in (6, 7))
    by = np.lexsort((second, first))
    equal = (first[by][1:] == first[by][:-1]) & (second[by][1:] == second[by][:-1])
    hit = np.zeros(len(first), bool)
    hit[by[1:]] |= equal
    hit[by[:-1]] |= equal
    out: list[bytes | None] = []
    for p, f, w in zip(parts, found, np.split(hit, np.cumsum([len(p[6]) for p in parts])[:-1]), strict=True):
        if f[0] or w.any():
            out.append(_pack(*(np.array(x, kind) for x, kind in zip(f if listed else [*f[:3], []], _BACK, strict=False)), p[8][w], p[9][w]))
        else:
            out.append(None)
    return out


class _Search:
    """The two questions of the blocks, and what their answers mean for a block."""

    def __init__(self, docs: DataFrame, key: str, text: str, span: int, gram: int, group: int, listed: bool = False):
        self.blocks = blocked(docs, key, text, wait=True)
        self.kind = self.blocks.schema["keys"].dataType.elementType.simpleString()
        self.span, self.gram, self.buckets = span, gram, bucket_count(self.blocks, BUCKET_BYTES)
        own = _Anchored(span, gram, self.buckets)
        first = answered(asked(self.blocks, own.ask), lambda p: classify(p, group), "anchors")
        second = answered(asked(with_answers(self.blocks, [first]), own.ask_again), lambda p: compare(p, span, listed), "spans")
        self.told = with_answers(self.blocks, [first, second])
        self.anchored = own


class _Anchored:
    """A block's side of the search; it goes to the executors."""

    def __init__(self, span: int, gram: int, buckets: int):
        self.span, self.gram, self.buckets = span, gram, buckets

    def anchors(self, row: dict) -> tuple[np.ndarray, np.ndarray, Anchors]:
        data = np.frombuffer(row["data"], np.uint8)
        ends = np.cumsum(np.array(row["lengths"], np.int64))
        return data, ends, Anchors(data, ends, self.span, self.gram)

    def ask(self, row: dict) -> Iterator[tuple[int, bytes]]:
        _, _, x = self.anchors(row)
        for b, places in split(bucket_of(x.gram_hash, self.buckets), self.buckets):
            yield b, _pack(x.gram_hash[places], x.span_hash[places])

    def codes(self, row: dict, x: Anchors) -> np.ndarray:
        """The codes of step 1, by anchor."""
        code = np.zeros(len(x.place), np.uint8)
        if first := of_step(row, 0):
            by = dict(split(bucket_of(x.gram_hash, self.buckets), self.buckets))
            for a in first:
                hit, codes = _unpack(a["payload"], np.uint32, np.uint8)
                code[by[a["bucket"]][hit]] = codes
        return code

    def sent(self, code: np.ndarray, x: Anchors) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The anchors whose spans go out, by bucket; for every anchor the one that goes out for it, and whether there are more; those whose windows go out."""
        spans = np.flatnonzero((code > 0) & (code != WINDOWS))
        for_, more = np.arange(len(code)), np.zeros(len(code), bool)
        seen: dict[bytes, int] = {}
        data, first, last = x.data, x.first.tolist(), x.last.tolist()
        place = x.place.tolist()
        for i in spans.tolist():
            same = data[first[i] : last[i] + self.span].tobytes() + (place[i] - first[i]).to_bytes(4, "little")
            k = seen.setdefault(same, i)
            if k != i:
                for_[i] = k
                more[k] = True
        out = spans[for_[spans] == spans]
        by = {b: out[p] for b, p in split(bucket_of(x.gram_hash[out], self.buckets), self.buckets)}
        return by, for_, more, np.flatnonzero((code == WINDOWS) | (code == AGAIN_WINDOWS))

    def ask_again(self, row: dict) -> Iterator[tuple[int, bytes]]:
        if not of_step(row, 0):
            return
        data, _, x = self.anchors(row)
        code = self.codes(row, x)
        by, _, more, alone = self.sent(code, x)
        counts = x.last[alone] - x.first[alone] + 1
        ordinal = np.repeat(alone, counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = x.first[ordinal] + step
        first, second = x.window_hashes(start)
        windows = dict(split(bucket_of(first, self.buckets), self.buckets))
        none = np.zeros(0, np.int64)
        for b in sorted({*by, *windows}):
            a, w = by.get(b, none), windows.get(b, none)
            pieces = [data[i:j] for i, j in zip(x.first[a].tolist(), (x.last[a] + self.span).tolist(), strict=True)]
            columns = x.gram_hash[a], x.place[a] - x.first[a], [len(p) for p in pieces], np.concatenate(pieces) if pieces else none, more[a], code[a] != COMPARE, first[w], second[w], ordinal[w], step[w]
            yield b, _pack(*(np.asarray(v, kind) for v, kind in zip(columns, _SENT, strict=True)))

    def ranges(self, row: dict, x: Anchors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, repeat) of the block's byte ranges that are repeats; repeat 0: a window of a large group, or repeats aren't listed."""
        if not of_step(row, 0):
            return
        by, for_, _, _ = self.sent(self.codes(row, x), x)
        like = np.argsort(for_, kind="stable")
        edges = np.searchsorted(for_[like], np.arange(len(for_) + 1))
        for a in of_step(row, 1):
            places, begin, end, repeat, ordinal, step = _unpack(a["payload"], *_BACK)
            if len(places):
                rep = by[a["bucket"]][places]
                times = edges[rep + 1] - edges[rep]
                which = np.repeat(np.arange(len(rep)), times)
                at = x.first[like[np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(edges[rep], times)]]
                yield at + begin[which], at + end[which], repeat[which] if len(repeat) else np.zeros(len(which), np.uint64)
            at = x.first[ordinal] + step
            yield at, at + self.span, np.zeros(len(at), np.uint64)


def duplicate_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, removed (start and end of each removed run, flat)."""
    search = _Search(docs, key, text, span, gram, group)
    own = search.anchored

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: column(batch, n)[i].as_py() for n in batch.schema.names if n not in ("keys", "part")}
                data = np.frombuffer(row["data"], np.uint8)
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                change = np.zeros(len(data) + 1, np.int32)
                if of_step(row, 1):
                    for begin, end, _ in own.ranges(row, Anchors(data, ends, span, gram)):
                        np.add.at(change, begin, 1)
                        np.add.at(change, end, -1)
                gone = np.cumsum(change, out=change)[:-1] > 0
                out: list[list] = [[], [], [], [], []]
                start = 0
                for end in ends.tolist():
                    mask = gone[start:end]
                    runs = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    for list_, value in zip(out, (end - start, int(mask.sum()), len(runs) // 2, hashlib.sha256(data[start:end][~mask].tobytes()).hexdigest(), runs.tolist()), strict=True):
                        list_.append(value)
                    start = end
                n, removed, spans, sha, runs = out
                yield batch_of({"k": (column(batch, "keys")[i].values, None), "n_bytes": (n, pa.int64()), "n_removed": (removed, pa.int64()), "n_spans": (spans, pa.int64()), "kept_sha256": (sha, pa.string()), "removed": (runs, pa.list_(pa.int64()))})

    out = search.told.mapInArrow(finish, f"k {search.kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<bigint>")
    return out.withColumnRenamed("k", key)


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """repeat, key, start, length: every occurrence (bytes of the text) of every maximal repeat, and of every span that recurs whole, by the repeat's hash.

    Repeats at anchors with more than `group` distinct spans aren't listed.
    """
    search = _Search(docs, key, text, span, gram, group, listed=True)
    own = search.anchored

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: column(batch, n)[i].as_py() for n in batch.schema.names if n != "keys"}
                if not of_step(row, 1):
                    continue
                _, ends, x = own.anchors(row)
                found = [np.concatenate(v) for v in zip(*own.ranges(row, x), strict=True)]
                begin, end, repeat = (v[found[2] != 0] for v in found)
                doc = np.searchsorted(ends, begin, side="right")
                start = begin - np.concatenate(([0], ends))[doc]
                yield batch_of({"repeat": (repeat.view(np.int64), pa.int64()), "k": (column(batch, "keys")[i].values.take(pa.array(doc)), None), "start": (start, pa.int64()), "length": (end - begin, pa.int64())})

    out = search.told.mapInArrow(listed, f"repeat long, k {search.kind}, start long, length long").distinct()
    return out.withColumnRenamed("k", key)
