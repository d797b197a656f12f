"""Benchmark decontamination: an FM-index per training shard, searched backwards for every benchmark window.

Each shard (consecutive documents of a partition) is indexed over the benchmark's own
words: words that no window holds can't be part of an occurrence, so only runs of known
words that are at least as long as the shortest window are kept, each ended by word 0.
Suffix array, Burrows-Wheeler transform, wavelet matrix and sampled suffix positions are
built in numpy; all windows step backwards together; the found ranges are located and
their word spans merged by document.

Null and wordless texts have no words, no hits and no items. Items without words have no
window. Items with a null id hit like others and count as one item more, but aren't named
in items. Repeated rows are judged one by one. An empty benchmark hits nothing; an empty
documents table gives no rows. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, column, small_batches, strings

WINDOW = 13
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text that one index pass takes; more text makes more passes. Its windows take up to some 50 times as much.
BLOCK_BYTES = 4 << 20
#: One suffix position in so many is stored.
SAMPLE = 8

_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(data: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and bytes above 7F."""
    return data.translate(_WORDS).split()


def _in_order(items) -> list:
    """Sorted, null last."""
    return sorted(items, key=lambda x: (x is None, x or ""))


@dataclass
class Windows:
    """Distinct windows of one length (rows of word numbers); row i's items are owners[starts[i]:starts[i + 1]]."""

    rows: np.ndarray
    starts: np.ndarray
    owners: np.ndarray


def windows(items: list[tuple[str | None, bytes]], size: int = WINDOW) -> tuple[dict[bytes, int], list[str | None], list[Windows]]:
    """The words' numbers (from 1), the distinct items, and by window length the distinct windows."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str | None, int] = {}
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for item, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int32)
        if len(ids):
            found.setdefault(min(size, len(ids)), []).append((ids, names.setdefault(item, len(names))))
    out = []
    for n, each in sorted(found.items()):
        flat = np.concatenate([sliding_window_view(ids, n) for ids, _ in each])  # n numbers of four bytes for each word
        owner = np.repeat(np.array([o for _, o in each], np.int64), [len(ids) - n + 1 for ids, _ in each])
        whole = np.ascontiguousarray(flat).view(np.dtype((np.void, 4 * n))).ravel()
        order = np.argsort(whole, kind="stable")
        new = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
        pairs = np.unique((np.cumsum(new) - 1) * len(names) + owner[order])
        row, owners = np.divmod(pairs, len(names))
        out.append(Windows(flat[order[new]], np.searchsorted(row, np.arange(int(new.sum()) + 1)), owners))
    return vocabulary, list(names), out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends comes before one that goes on."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = rank * (n + 2)
        key[: max(0, n - step)] += rank[step:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) + 1
        if step >= n or rank[order[-1]] == n:
            return order
        step *= 2


class FMIndex:
    """Counts and locates word sequences by backward search over a wavelet matrix."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        self.n, self.sample = len(text), sample
        order = suffix_array(text) if self.n else np.zeros(0, np.int64)
        # row 0 is the empty suffix at the end
        self.order = np.concatenate(([self.n], order))
        last = np.where(self.order > 0, text[self.order - 1] + 1 if self.n else 0, 0)  # 0: the end mark
        self.bits = max(1, int(last.max(initial=0)).bit_length())
        self.levels, self.zeros, self.first = [], [], {}
        level = last.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(one))))
            self.zeros.append(int(len(one) - one.sum()))
            level = np.concatenate((level[one == 0], level[one == 1]))
        counts = np.bincount(last, minlength=1 << self.bits)
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.last = last
        kept = (self.order % sample == 0) | (self.order == self.n)
        self.kept, self.rank_kept, self.values = kept, np.cumsum(kept) - 1, self.order[kept]
        del self.order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before row at."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            low, at = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each pattern (all of one length), empty where it doesn't occur."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n + 1, np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, j] + 1
            known = symbol < len(self.starts) - 1
            low[alive[~known]] = high[alive[~known]] = 0
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.starts[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.starts[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back until a sampled row."""
        out = np.zeros(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.kept[row]
            out[left[done]] = self.values[self.rank_kept[row[done]]] + steps
            left, row = left[~done], row[~done]
            symbol = self.last[row]
            row = self.starts[symbol] + self.rank(symbol, row)
            steps += 1
        return out


def _search_shard(texts: list[bytes], vocabulary: dict, names: list, patterns: list[Windows]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text its number of words, merged hit spans (in words) and items."""
    get = vocabulary.get
    shortest = min((w.rows.shape[1] for w in patterns), default=0)
    n_words, parts, origin = np.zeros(len(texts), np.int64), [], []
    for d, text in enumerate(texts):
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        n_words[d] = len(ids)
        if not shortest or len(ids) < shortest:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        for a, b in edge.reshape(-1, 2):
            if b - a >= shortest:
                parts += [ids[a:b], np.zeros(1, np.int64)]
                origin.append((d, a, b - a + 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not parts:
        return n_words, spans, items
    sequence = np.concatenate(parts)
    index = FMIndex(sequence)
    lengths = np.array([x[2] for x in origin])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    hit = np.zeros(len(sequence) + 1, np.int64)
    for each in patterns:
        p = each.rows
        low, high = index.search(p)
        count = high - low
        which = np.repeat(np.arange(len(p)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = index.locate(rows)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + p.shape[1], -1)
        run = np.searchsorted(begins, at, side="right") - 1
        for r, w in set(zip(run.tolist(), which.tolist(), strict=True)):
            items[origin[r][0]].update(names[o] for o in each.owners[each.starts[w] : each.starts[w + 1]].tolist())
    covered = np.cumsum(hit)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).reshape(-1, 2)
    for a, b in edge:
        r = int(np.searchsorted(begins, a, side="right") - 1)
        d, start, _ = origin[r]
        spans[d].append((int(a - begins[r] + start), int(b - begins[r] + start)))
    return n_words, spans, items


def _search(spark: SparkSession, block, shard_bytes: int):
    """A function that adds what one block of the benchmark finds to the columns of batches."""
    held = spark.sparkContext.broadcast(block)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, names, patterns = held.value
        for batch in batches:
            texts = strings(column(batch, "text"))
            ends, total, cuts = 0, 0, [0]
            for ends, x in enumerate(texts):
                if total and total + len(x) > shard_bytes:
                    cuts.append(ends)
                    total = 0
                total += len(x)
            cuts.append(len(texts))
            old_spans, old_items = column(batch, "spans").to_pylist(), column(batch, "items").to_pylist()
            counts, spans, items = [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                n, s, i = _search_shard(texts[a:b], vocabulary, names, patterns)
                counts += n.tolist()
                spans += [x + [v for pair in y for v in pair] for x, y in zip(old_spans[a:b], s, strict=True)]
                items += [_in_order({*x, *y}) for x, y in zip(old_items[a:b], i, strict=True)]
            made = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    return searched


def _pass(df: DataFrame, block, shard_bytes: int) -> DataFrame:
    """Adds what one block of the benchmark finds to the columns of df."""
    return small_batches(df).mapInArrow(_search(df.sparkSession, block, shard_bytes), df.schema)


def merged(flat: list[int]) -> list[tuple[int, int]]:
    """Sorted disjoint spans that cover the same words."""
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _benchmark_blocks(benchmark: DataFrame, item: str, item_text: str, window: int, block_bytes: int) -> Iterator[tuple[dict, list, list]]:
    """The windows of each block of the benchmark."""
    texts = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = texts.agg(F.sum(F.octet_length("t")).cast("long")).first()[0] or 0
    n_blocks = -(-size // block_bytes) or 1
    for b in range(n_blocks):
        part = texts if n_blocks == 1 else texts.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        yield windows([(r.i, r.t.encode()) for r in part.collect()], window)


def _nothing_found() -> list:
    return [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items")]


def _contaminated(hit: int, n: int) -> bool:
    return hit > 0 and 20 * hit >= n


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_hit, n_items, items (sorted strings), spans (word start and end, flat) and contaminated.

    The documents are read once and not shuffled. Only the benchmark goes to the executors:
    in one block if its text is at most block_bytes, else in as many passes as that takes,
    dealt by hash, so no pass and no step on the driver holds more than about a block and its windows.
    """
    df = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), *_nothing_found())
    for block in _benchmark_blocks(benchmark, item, item_text, window, block_bytes):
        df = _pass(df, block, shard_bytes)
    kind = docs.schema[key].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(x) for x in column(batch, "spans").to_pylist()]
            found = column(batch, "items").to_pylist()
            items = [[i for i in x if i is not None] for x in found]
            n = column(batch, "n_words").to_pylist()
            hits = [sum(b - a for a, b in x) for x in spans]
            yield batch_of({
                "k": (column(batch, "k"), None),
                "n_words": (n, pa.int64()),
                "n_hit": (hits, pa.int64()),
                "n_items": ([len(x) for x in found], pa.int64()),
                "items": (items, pa.list_(pa.string())),
                "items_sha256": ([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                "contaminated": ([_contaminated(h, w) for h, w in zip(hits, n, strict=True)], pa.bool_()),
                "spans": ([[v for pair in x for v in pair] for x in spans], pa.list_(pa.int64())),
            })

    out = df.drop("text").mapInArrow(finish, f"k {kind}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans array<bigint>")
    return out.withColumnRenamed("k", key)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that aren't contaminated, whole; one scan, no shuffle.

    The last pass chooses the rows in the Python worker that searches, so a task has no worker more than passes.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    df = docs.toDF(*names).select(*names, F.col(names[docs.columns.index(text)]).cast("string").alias("text"), *_nothing_found())
    blocks = _benchmark_blocks(benchmark, item, item_text, window, BLOCK_BYTES)
    last = next(blocks)
    for block in blocks:
        df, last = _pass(df, last, SHARD_BYTES), block
    searched = _search(df.sparkSession, last, SHARD_BYTES)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in searched(batches):
            hits = [sum(b - a for a, b in merged(x)) for x in column(batch, "spans").to_pylist()]
            keep = [not _contaminated(h, n) for h, n in zip(hits, column(batch, "n_words").to_pylist(), strict=True)]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    out = small_batches(df).mapInArrow(kept, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]))
    return out.toDF(*docs.columns)

_SQL_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The same in DuckDB, of the tables documents and benchmark.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
n AS (SELECT item, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, w[i:i + k - 1] AS words FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
place AS (SELECT doc_id, k, i, w[i:i + k - 1] AS words FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, win.k, i, item FROM place JOIN win ON win.k = place.k AND win.words = place.words),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
