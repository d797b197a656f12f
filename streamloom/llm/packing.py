"""Best-fit packing of tokenised documents into sequences.

Token counts become a histogram of piece lengths (at most `capacity` lengths, however
large the corpus). The configuration linear program over it (fewest sequences, each
filled by a multiset of lengths, every length covered) is solved by multiplicative
weights: the weights are the prices of the lengths, a knapsack dynamic program finds
the best configurations at those prices, and covered lengths become cheaper. The
fractional counts are rounded down to what is still unpacked, the rest goes through
the program again while that helps, and what is left is packed best-fit into open space.

Pieces then take the slots of their length by rank. Ranks are taken within salted
groups of one length, so a length that many documents share isn't one task's work.

A null or empty text is one piece: the end id alone. Repeated rows are packed as often
as they occur. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column, saved, small_batches

CAPACITY, END_ID = 2048, 0
#: Rows of one length that are ranked together.
RANK_ROWS = 1024
SPECIAL = "<|endoftext|>"


def encoder(path: str):
    """text -> ids as the tokenizers library gives them for the file at path, without special tokens added.

    Where the same vocabulary lies beside it as ranks, texts below U+0250 without the special
    string go through the faster library, which gives the same ids; all others through tokenizers.
    """
    import base64
    import re

    from tokenizers import Tokenizer

    ranks = path.removesuffix(".json") + ".tiktoken"
    loaded: list[Tokenizer] = []

    def slow(t: str) -> list[int]:
        if not loaded:
            loaded.append(Tokenizer.from_file(path))
        return loaded[0].encode(t, add_special_tokens=False).ids

    if not path.endswith(".json") or not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    odd = re.compile("[^\x00-ɏ]").search

    def encode(text: str) -> list[int]:
        if SPECIAL in text or not text.isascii() and odd(text):
            return slow(text)
        return fast(text)

    return encode


def tokenised(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids) of every piece. Only documents over capacity are cut; the first piece takes what is left over."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: dict[str, list] = {x: [] for x in ("row", "piece", "start", "length", "crc", "ids")}
            for row, value in enumerate(column(batch, "text")):
                ids = np.array([*encode(value.as_py() or ""), end_id], "<u4")
                ends = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    for x, v in zip(out, (row, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=False):
                        out[x].append(v)
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            columns = {"k": (column(batch, "k").take(pa.array(out["row"], pa.int64())), None), "piece": (out["piece"], pa.int32()), "start": (out["start"], pa.int64()), "length": (out["length"], pa.int64()), "ids_crc32": (out["crc"], pa.int64())}
            yield batch_of(columns | ({"ids": (out["ids"], pa.list_(pa.int32()))} if with_ids else {}))

    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return small_batches(rows).mapInArrow(pieces, schema).withColumnRenamed("k", key)


# the program over the histogram -------------------------------------------------------------


def best_fills(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repetition: for each room w the best total value and the length to take first (0: none)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    priced = value[1:]
    for w in range(1, capacity + 1):
        totals = best[w - 1 :: -1][:w] + priced[:w]
        k = int(totals.argmax())
        if totals[k] > best[w - 1]:
            best[w], take[w] = totals[k], k + 1
        else:
            best[w], take[w] = best[w - 1], 0
    return best, take


def _configuration(first: int, take: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    """The best configuration that holds length first, as (length, times)."""
    room, found = capacity - first, {first: 1}
    while room > 0:
        if length := int(take[room]):
            found[length] = found.get(length, 0) + 1
            room -= length
        else:
            room -= 1
    return tuple(sorted(found.items(), reverse=True))


def fractional(counts: np.ndarray, capacity: int, rounds: int = 40, rate: float = 1.0, slack: float = 0.02) -> dict[tuple, float]:
    """A fractional cover of counts (by length) by configurations, by multiplicative weights."""
    there = np.flatnonzero(counts)
    need = counts[there].astype(float)
    log_price = np.log(there / capacity)  # a length's share of a sequence, to begin with
    solution: dict[tuple, float] = {}
    covered = np.zeros(capacity + 1)
    for _ in range(rounds):
        value = np.zeros(capacity + 1)
        value[there] = np.exp(log_price - log_price.max())
        best, take = best_fills(value, capacity)
        through = value[there] + best[capacity - there]
        step = np.zeros(capacity + 1)
        for length in there[through >= (1 - slack) * best[capacity]].tolist():
            c = _configuration(length, take, capacity)
            mass = min(counts[x] / n for x, n in c) / rounds
            solution[c] = solution.get(c, 0.0) + mass
            for x, n in c:
                step[x] += mass * n
        covered += step
        log_price -= rate * step[there] / need * rounds / max(1.0, (step[there] / need).max() * rounds)
    return solution


def rounded(counts: np.ndarray, capacity: int, passes: int = 12) -> list[tuple[list[tuple[tuple, int]], np.ndarray]]:
    """Whole numbers of configurations and the lengths they leave unpacked, rounded in two ways.

    First down to whole times of the solution, for lengths that mostly exceed half a sequence. Then,
    pass by pass, as often as full configurations of the solution still fit what is left, for short lengths.
    """
    down, left = [], counts.copy()
    solution = fractional(counts, capacity) if counts.any() else {}
    covered = np.zeros(capacity + 1)
    for c, x in solution.items():
        for a, b in c:
            covered[a] += x * b
    scale = 1 / np.median(covered[counts > 0] / counts[counts > 0]) if solution else 1.0
    for c, x in sorted(solution.items(), key=lambda kv: (-kv[1], kv[0])):
        if times := int(min(x * scale, *(left[a] // b for a, b in c))):
            down.append((c, times))
            for a, b in c:
                left[a] -= times * b
    found = [(down, left)]
    plan, left = [], counts.copy()
    for k in range(passes):
        before = int(left.sum())
        if before < 64:
            break
        for c, _ in sorted((fractional(left, capacity) if k else solution).items(), key=lambda kv: (-sum(a * b for a, b in kv[0]), -kv[1], kv[0])):
            if sum(a * b for a, b in c) < capacity - 2:
                continue
            if times := int(min(left[a] // b for a, b in c)):
                plan.append((c, times))
                for a, b in c:
                    left[a] -= times * b
        if left.sum() > 0.9 * before:
            break
    return [*found, (plan, left)]


def best_fit(plan: list[tuple[tuple, int]], left: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Packs what is left, longest first, each piece into the fullest sequence that has room; equal ones in bulk."""
    bins: dict[int, list[tuple[tuple, int]]] = {}
    for c, times in plan:
        bins.setdefault(capacity - sum(a * b for a, b in c), []).append((c, times))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                whole, rest = divmod(n, each)
                for times, held in ((whole, each), (1 if rest else 0, rest)):
                    if times:
                        bins.setdefault(capacity - held * length, []).append((((length, held),), times))
                break
            c, times = bins[room].pop()
            if not bins[room]:
                del bins[room]
            each = room // length
            full = min(times, n // each)
            for k, held in ((full, each), (1, n - full * each) if full < times and n > full * each else (0, 0)):
                if k:
                    bins.setdefault(room - held * length, []).append(((*c, (length, held)), k))
                    n -= k * held
                    times -= k
            if times:
                bins.setdefault(room, []).append((c, times))
    return [x for group in bins.values() for x in group]


def planned(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple, int]], int]:
    """(configuration, times) of all sequences, and how many pieces the program's own configurations hold.

    Of the two roundings the one with fewer sequences, and of equal ones the one that leaves least to best-fit.
    """
    options = [(best_fit(plan, left, capacity), int((counts - left).sum())) for plan, left in rounded(counts, capacity)]
    return min(options, key=lambda x: (sum(times for _, times in x[0]), -x[1]))


def plan_slots(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Slots of each length, in runs: columns length, first rank, slots in a sequence, first sequence, offset of the first slot."""
    packed, _ = planned(counts, capacity)
    runs, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for c, times in packed:
        offset = 0
        for length, held in c:
            runs.append((length, int(used[length]), held, sequence, offset))
            used[length] += times * held
            offset += length * held
        sequence += times
    assert (used == counts).all()
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The pieces (without ids) are written once to the shared folder; the driver gets the histogram,
    at most `capacity` numbers, and sends back the plan, whose size the histogram's lengths bound.
    """
    pieces = saved(tokenised(docs, tokenizer, key, text, capacity, end_id).withColumnRenamed(key, "k"), "pieces")
    full = pieces.where(F.col("length") == capacity)
    short = pieces.where(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in short.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    runs = plan_slots(counts, capacity)
    n_sequences = int(max((r[3] for r in runs.tolist()), default=0)) + int(counts.sum()) + 1

    salts = np.maximum(1, -(-counts // RANK_ROWS))
    groups = F.element_at(F.array(*[F.lit(int(x)) for x in salts]), F.col("length").cast("int") + 1)
    salted = short.withColumn("salt", F.pmod(F.xxhash64("k", "piece", "ids_crc32"), groups))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    own = Window.partitionBy("length", "salt").orderBy("k", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(sizes, ["length", "salt"])
    ranked = ranked.select("k", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("rank0")).cast("long").alias("rank"))
    held = docs.sparkSession.sparkContext.broadcast(runs)
    kind = pieces.schema["k"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = held.value
        stride = int(runs[:, 1].max(initial=0)) + (1 << 40)
        keys = runs[:, 0] * stride + runs[:, 1]
        for batch in batches:
            length, rank = (column(batch, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * stride + rank, side="right") - 1]
            slot = rank - run[:, 1]
            yield batch_of({x: (column(batch, x), None) for x in ("k", "piece", "start", "length", "ids_crc32")} | {"sequence_id": (run[:, 3] + slot // run[:, 2], pa.int64()), "offset": (run[:, 4] + slot % run[:, 2] * length, pa.int64())})

    out = ranked.mapInArrow(placed, f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() + n_sequences).withColumn("offset", F.lit(0).cast("long"))
    return out.unionByName(alone).withColumnRenamed("k", key)
