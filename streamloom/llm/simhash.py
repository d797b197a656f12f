"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint maps to the bit counts of its segments (two bits each). Hamming distance is
at least the Manhattan distance of the counts, and counts at Manhattan distance 3 agree
in at least 3 of 6 groups of segments. So the grid cells are the counts of each choice
of 3 groups: fingerprints that share a cell are compared by Manhattan distance first and
exactly after that. Cells that hold more than CELL fingerprints aren't compared as they
are: their fingerprints are dealt again into a finer grid of counts, of 5 of 8 groups and
then of 13 of 16, which agree at least at that distance. Only fingerprints whose counts crowd
even there, which differ in the bits of segments with one bit each, are told apart by the bits
themselves (13 of 16 groups), where a cell can hold no more than 4096.

Equal fingerprints are one node throughout. A cell reports a spanning forest of its
links, not all pairs, and components come from alternating large and small stars.

Null and wordless texts have fingerprint zero, linked like any other. Rows with a null id
get the smallest id that isn't null in their component, or null. Repeated rows are kept.
An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batch_of, bounded, column, numbered, saved, small_batches, strings

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a cell that are compared as they are.
CELL = 64
ODD_BITS = 0x5555555555555555


def shingles(data: bytes, size: int) -> list[bytes]:
    words = ascii_lower(data).split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(data: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half the shingles' hashes; unsigned."""
    parts = shingles(data, size)
    if not parts:
        return 0
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in parts), np.uint64, len(parts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; unsigned."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """k and fp (the fingerprint's bits as a long) of every row."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, size) for x in strings(column(batch, "text"))], np.uint64).view(np.int64)
            yield batch_of({"k": (column(batch, "k"), None), "fp": (found, pa.int64())})

    return small_batches(rows).mapInArrow(mapped, f"k {rows.schema['k'].dataType.simpleString()}, fp long")


def popcounts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each in its segment's place."""
    odd = F.lit(ODD_BITS)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def cell_masks(sizes: list[int], agree: int) -> list[int]:
    """For each choice of `agree` groups (sizes in bits) the mask of their bits."""
    ends = np.cumsum([0, *sizes]).tolist()
    groups = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    return [_signed(sum(x)) for x in combinations(groups, agree)]


#: (masks, cells are of bit counts, fingerprints in a cell at most): all within 3 bits share a cell on each level.
LEVELS = (
    (cell_masks([10, 10, 10, 10, 12, 12], 3), True, CELL),
    (cell_masks([8] * 8, 5), True, CELL),
    (cell_masks([4] * 16, 13), True, CELL),
    (cell_masks([4] * 16, 13), False, 4096),
)


def _fields(fps: np.ndarray) -> np.ndarray:
    x = fps.view(np.uint64)
    odd = np.uint64(ODD_BITS)
    one = np.uint64(1)
    a, b = x & odd, (x >> one) & odd
    return ((a & b) << one) | (a ^ b)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed two-bit counts 0, 1 and 2, which differ in the high bit alone only as 0 and 2."""
    odd = np.uint64(ODD_BITS)
    one = np.uint64(1)
    x = a ^ b
    low, high = x & odd, (x >> one) & odd
    return np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, smallest member) that connect what links within radius connect."""
    n = len(fps)
    bits, counts = fps.view(np.uint64), _fields(fps)
    label = np.arange(n)
    links: list[np.ndarray] = []
    for a in range(0, n, 256):
        near = _manhattan(counts[a : a + 256, None], counts[None, :]) <= radius
        i, j = np.nonzero(near)
        keep = np.bitwise_count(bits[i + a] ^ bits[j]) <= radius
        links.append(np.stack([i[keep] + a, j[keep]]))
    i, j = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(n))
    return fps[other], fps[label[other]]


def _level(nodes: DataFrame, masks: list[int], counted: bool, cap: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Links within cells of at most cap nodes, and the nodes of larger cells. nodes: distinct fp."""
    value = popcounts(F.col("fp")) if counted else F.col("fp")
    # the masks are one literal: an expression for each of 560 takes the driver some hundred MB to plan
    choices = F.posexplode(F.expr(f"array({', '.join(f'{m}L' for m in masks)})")).alias("place", "mask")
    dealt = nodes.select("fp", value.alias("value")).select("fp", "value", choices).select("fp", F.col("place").cast("short").alias("choice"), F.col("value").bitwiseAND(F.col("mask")).alias("cell"))
    sizes = saved(dealt.groupBy("choice", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    pairs = sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    crowds = sizes.where((F.col("n") > 2) & (F.col("n") <= cap)).select("choice", "cell")
    if len(masks) > len(LEVELS[0][0]):  # few nodes, of which each is in many cells: those would be broadcast
        crowds = crowds.hint("merge")
    some = dealt.join(crowds, ["choice", "cell"])
    some = some.groupBy("choice", "cell").agg(F.collect_list("fp").alias("fps")).select("fps")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "fps")
            a, b = [], []
            for k in range(batch.num_rows):
                x, y = forest(np.sort(lists[k].values.to_numpy(zero_copy_only=False).astype(np.int64)), radius)
                a.append(x)
                b.append(y)
            none = [np.zeros(0, np.int64)]
            yield batch_of({"a": (np.concatenate(a or none), pa.int64()), "b": (np.concatenate(b or none), pa.int64())})

    hot = dealt.join(sizes.where(F.col("n") > cap).select("choice", "cell"), ["choice", "cell"], "left_semi").select("fp").distinct()
    return pairs.union(some.mapInArrow(linked, "a long, b long")), hot


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all within radius (at most 3)."""
    if not 0 <= radius <= 3:
        raise ValueError("the cells find distances of at most 3")
    found = None
    for masks, counted, cap in LEVELS:
        some, hot = _level(nodes, masks, counted, cap, radius)
        some = saved(some.distinct(), "links")
        found = some if found is None else found.union(some)
        nodes = saved(hot, "hot")
        if nodes.isEmpty():
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges a, b, by large and small stars until nothing changes."""
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the smallest key reachable) of every row of docs.

    The text is read once, without a shuffle; all later steps move fingerprints and ids only.
    """
    prints = saved(fingerprinted(docs, key, text, size), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("k").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    of = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "least")
    label = of.groupBy("root").agg(F.min("least").alias("label"))
    labels = of.select("node", "root").join(label, "root").select(F.col("node").alias("fp"), "label")
    known = nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "least").alias("component_id"))
    known = saved(known, "known")
    # a hot fingerprint's rows would meet in one task: what is known of each is broadcast while it is small, and AQE splits the join beyond that
    out = prints.join(bounded(known, F.lit(32)), "fp").select(F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the one with the smallest key."""
    return kept(docs, near_duplicates(docs, key, text, size, radius), key)


def kept(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is their component_id in found.

    Of rows that repeat that key one stays. Rows with a null key can't be named and all stay.
    The keys that stay are broadcast if they are few, else joined by key.
    """
    found = saved(found.select(F.col(key).alias("stay"), "component_id"), "components")
    stay = saved(found.where(F.col("stay") == F.col("component_id")).groupBy("stay").agg(F.count("*").alias("times")), "stay")
    small = bounded(stay, F.octet_length(F.col("stay").cast("string")) + 16)
    every = numbered(docs)
    own = F.col(f"c{docs.columns.index(key)}")
    rows = every.join(small, own == F.col("stay"))
    once = rows.where("times = 1").select(every.columns)
    out = once.union(every.where(own.isNull()))
    if not stay.where("times > 1").isEmpty():
        out = out.union(rows.where("times > 1").select(every.columns).dropDuplicates([f"c{docs.columns.index(key)}"]))
    return out.toDF(*docs.columns)
