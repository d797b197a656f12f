"""SimHash near duplicates carried on to a Jaccard similarity, without loss.

The SimHash operator comes first: the fingerprint of a text's shingles, embedded as bit counts by
segment, dealt to cells, compared by Manhattan distance and then exactly. What it links is compared
shingle by shingle. Texts with equal shingle sets are one node.

A fingerprint of 64 bits can't tell a similarity of 0.8 from less, so what it leaves apart goes on
with a longer one: the whole set of the shingles' 64-bit hashes, a bit each in the hash space. It is
embedded as SimHash's is: the space is cut into segments, and the text is the list of its bit
counts by segment. Two sets of similarity 4/5 or more differ in at most a ninth of their joint
size, and the Manhattan distance of the counts is no more than that: pairs beyond it are
dropped, the others are compared exactly.

At such a radius no cell of counts is shared for certain, so cells are of shingles: in any one
order of all shingles, two similar sets share one of their first n // 5 + 1 (n in the set).
Those are a node's tokens, and nodes that share none aren't compared. The order is by hash, but
shingles that are a token of more than HOT rows come last, so that common lines are tokens only
of texts that hold little else. Which do changes the work, not the result. At the first token that
two sets share, all they share lies there or after it in both, so a token's nodes are compared only
where their places in their sets leave room for a similarity of 4/5: the other tokens of a pair
would only find it again.

Nodes that share a token and that fingerprints left apart are first compared with two of them, and
then all that aren't of the token's largest component with all of other components.
So a large group of copies costs rows by its size, not by its square, and only nodes that the first
round left apart are compared with many, by their embeddings, in blocks of at most BLOCK of each.
Sets are never kept: the texts of the pairs left are read again and meet in groups of bounded size.

Null and wordless texts are equal to each other and to nothing else; a text of fewer words than
a shingle is one shingle. Rows with a null key take no part, and stay. Repeated keys count as
one. An empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import ascii_lower, batch_of, bounded, column, release, saved, small_batches, strings
from .simhash import kept, majority

SHINGLE, SEED = 5, 42
#: Rows that may share a token before it comes last in the order, estimated from one row of PART, and how many such tokens the order knows at most.
HOT, HOT_TOKENS, PART = 64, 200_000, 4
#: Segments of an embedding: a power of two, about the set's size.
SEGMENTS = (8, 1024)
#: Segments of the coarser embedding by which nodes ask in blocks, at most.
COARSE = 256
#: Shingles that are compared with one node in one task, about.
GROUP_SHINGLES = 10_000
#: Edges that a task gathers before it contracts them.
EDGES = 1 << 18
#: Nodes of a token that meet in one task, of those that ask and of those that are asked.
BLOCK = 512


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


#: A random number for each byte (none for white space) and for each place in a word (places beyond the last begin again).
_BYTE, _PLACE = (np.random.default_rng(SEED + i).integers(0, 1 << 64, n, dtype=np.uint64) for i, n in enumerate((256, 1024)))
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_SPACE = _BYTE == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingle_set(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, rising.

    A word's hash sums a random number for each byte times one for its place, a shingle's mixes its words' in their order.
    """
    text = np.frombuffer(ascii_lower(data), np.uint8)
    space = _SPACE[text]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(starts[0], len(text)) - np.repeat(starts, np.diff(starts, append=len(text)))
    each = np.add.reduceat(_BYTE[text[starts[0] :]] * _PLACE[place % len(_PLACE)], starts - starts[0])
    size = min(size, len(each))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * _A + each[i : len(each) - size + 1 + i])
    return np.unique(out)


def node_of(hashes: np.ndarray) -> int:
    """One signed number for a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def segment_counts(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall in each segment, 255 at most."""
    bits = int(np.clip(max(1, len(hashes)).bit_length(), *(s.bit_length() - 1 for s in SEGMENTS)))
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, segments: int) -> np.ndarray:
    """Rows of counts in fewer, coarser segments, or as many."""
    if counts.shape[1] == segments:
        return counts.astype(np.int16)
    return np.minimum(counts.reshape(len(counts), segments, -1).sum(axis=2, dtype=np.int32), 255).astype(np.int16)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the difference of the set in the one row a to those in the rows b: the counts' Manhattan distance, in the coarser segments of the two."""
    n = min(a.shape[1], b.shape[1])
    return np.abs(folded(a, n) - folded(b, n)).sum(axis=1, dtype=np.int64)


def rows_of(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)


def tokens(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of rising hashes, those in hot (rising) last."""
    n = len(hashes) // 5 + 1
    if not len(hot) or not len(hashes):
        return hashes[:n]
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    late = hot[at] == hashes
    return np.concatenate([hashes[~late], hashes[late]])[:n]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the sets' similarity is 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def fits(n, place, m, other):
    """Whether sets of n and m shingles may be similar if the first that they share has these places in them."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * np.minimum(n - place, m - other) >= 4 * (n + m))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return small_batches(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).where("k is not null"))


def _embedded(rows: DataFrame, size: int) -> DataFrame:
    """k, node (a hash of the set), n (shingles in it), fp (its SimHash fingerprint), counts and coarse (the counts in at most COARSE segments) of every row."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x, size) for x in strings(column(batch, "text"))]
            counts = [segment_counts(x) for x in found]
            yield batch_of({
                "k": (column(batch, "k"), None),
                "node": ([node_of(x) for x in found], pa.int64()),
                "n": ([len(x) for x in found], pa.int32()),
                "fp": (np.array([majority(x) if len(x) else 0 for x in found], np.uint64).view(np.int64), pa.int64()),
                "counts": (counts, pa.binary()),
                "coarse": ([folded(rows_of([x]), min(len(x), COARSE)).astype(np.uint8).tobytes() for x in counts], pa.binary()),
            })

    return rows.mapInArrow(mapped, f"k {rows.schema['k'].dataType.simpleString()}, node long, n int, fp long, counts binary, coarse binary")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """a, b: the pairs that the SimHash operator's cells link: nodes of one fingerprint, and the least nodes of fingerprints that it links."""
    prints = saved(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = nodes.select("fp", "node").join(prints, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(prints.select("fp"))
    for side in ("a", "b"):
        linked = linked.join(prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node")), side)
    return same.union(linked.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node")).distinct())


def _tokens(rows: DataFrame, size: int, hot: np.ndarray) -> DataFrame:
    """token, node and place (of the token in the order of the node's), a row for each token of each row."""
    held = rows.sparkSession.sparkContext.broadcast(hot)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(column(batch, "text"))
            for at in range(0, len(texts), 100):
                found = [shingle_set(x, size) for x in texts[at : at + 100]]
                token = [tokens(x, held.value) for x in found]
                node = np.repeat(np.array([node_of(x) for x in found], np.int64), [len(x) for x in token])
                place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in token])
                yield batch_of({"token": (np.concatenate(token).view(np.int64), pa.int64()), "node": (node, pa.int64()), "place": (place, pa.int32())})

    return rows.select("text").mapInArrow(mapped, "token long, node long, place int")


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs a, b those whose embeddings allow similarity, with the size of b."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (column(batch, c).to_pylist() for c in ("a_n", "b_n", "a_counts", "b_counts"))
            keep = [5 * min(p, q) >= 4 * max(p, q) and 9 * int(manhattan(rows_of([u]), rows_of([v]))[0]) <= p + q for p, q, u, v in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b", "b_n"]).filter(pa.array(keep, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("counts").alias(f"{side}_counts")), side)
    return saved(pairs.select("a", "b", "a_n", "b_n", "a_counts", "b_counts").mapInArrow(allowed, "a long, b long, b_n int"), "near")


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Of the pairs a, b those that are similar: a meets its partners' texts in groups of about GROUP_SHINGLES."""
    near = _near(pairs, nodes)
    parts = near.groupBy("a").agg(F.ceil(F.sum("b_n") / GROUP_SHINGLES).alias("parts"))
    dealt = near.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest("parts", F.lit(1))).alias("part"))
    sides = dealt.select("a", "part", F.col("b").alias("node")).union(dealt.select("a", "part", F.col("a").alias("node")).distinct())
    sides = saved(sides.join(nodes.select("node", "least"), "node"), "sides")
    texts = rows.join(bounded(sides, F.octet_length(F.col("least").cast("string")) + 32), rows["k"] == F.col("least")).select("a", "part", "node", "text")

    def compared(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        sets: dict[int, np.ndarray] = {}
        for node, data in zip(group.column("node").to_pylist(), strings(group.column("text")), strict=True):
            if node not in sets:
                found = shingle_set(data, size)
                if node_of(found) == node:  # else another text of the same key
                    sets[node] = found
        own = sets.pop(a)
        hits = [b for b, found in sets.items() if similar(own, found)]
        return pa.table({"a": pa.array([a] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})

    return saved(texts.groupBy("a", "part").applyInArrow(compared, "a long, b long"), "similar")


def _apart(blocks: DataFrame) -> DataFrame:
    """a, b: the pairs of one that asks and one that is asked in each block (nodes, sizes, places, labels, asks and counts, a list each) whose labels differ and whose places and embeddings allow similarity."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [column(batch, x) for x in ("nodes", "sizes", "places", "labels", "asks", "counts")]
            for r in range(batch.num_rows):
                node, n, place, label, asks = (x[r].values.to_numpy(zero_copy_only=False) for x in lists[:5])
                n, place, counts = n.astype(np.int64), place.astype(np.int64), lists[5][r].as_py()
                length = np.array([len(x) for x in counts])
                asked = {k: np.flatnonzero(~asks & (length == k)) for k in np.unique(length[~asks]).tolist()}
                tables = {k: rows_of([counts[i] for i in own.tolist()]) for k, own in asked.items()}
                found: list[list[np.ndarray]] = [[], []]
                for q in np.flatnonzero(asks).tolist():
                    one = rows_of([counts[q]])
                    for k, own in asked.items():
                        may = (label[own] != label[q]) & fits(n[own], place[own], n[q], place[q])
                        if may.any():
                            own = own[may]
                            own = own[9 * manhattan(one, tables[k][may]) <= n[own] + n[q]]
                            found[0].append(np.minimum(node[own], node[q]))
                            found[1].append(np.maximum(node[own], node[q]))
                a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
                if len(a):
                    yield batch_of({"a": (a, pa.int64()), "b": (b, pa.int64())})

    return blocks.mapInArrow(mapped, "a long, b long").distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """u, v (less than u): edges that connect what the edges a, b of each task connect, one for each node but the least of a component."""

    def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        label = np.arange(len(node))
        while (differ := label[i] != label[j]).any():
            i, j = i[differ], j[differ]
            x, y = label[i], label[j]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        other = np.flatnonzero(label != np.arange(len(node)))
        return node[other], node[label[other]]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        held = [[a], [b]]
        for batch in batches:
            for list_, name in zip(held, ("a", "b"), strict=True):
                list_.append(column(batch, name).to_numpy(zero_copy_only=False))
            if sum(map(len, held[0])) > 2 * len(a) + EDGES:
                a, b = contracted(*map(np.concatenate, held))
                held = [[a], [b]]
        u, v = contracted(*map(np.concatenate, held))
        for at in range(0, len(u), EDGES):
            yield batch_of({"u": (u[at : at + EDGES], pa.int64()), "v": (v[at : at + EDGES], pa.int64())})

    return edges.select("a", "b").mapInArrow(mapped, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for each node of edges a, b: forests by task, then large and small stars until only stars are left."""
    e = saved(_forest(edges), "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")), "large")
        large = _forest(large).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def _labelled(nodes: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """token, node, place, n and label (the component so far) of the members."""
    known = saved(nodes.select("node", "n").join(components(found), "node", "left").select("node", "n", F.coalesce("root", "node").alias("label")), "known")
    return members.select("token", "node", "place").join(known, "node")


def _blocks(sides: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of each token in blocks: those that aren't of its largest component ask all."""
    sizes = sides.groupBy("token", "label").agg(F.count("*").alias("times")).groupBy("token").agg(F.max_by("label", F.struct("times", "label")).alias("main"), F.max("times").alias("most"), F.sum("times").alias("all"))
    mixed = saved(sizes.where("most < all").select("token", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("asking"), F.ceil(F.col("all") / BLOCK).cast("int").alias("asked")), "mixed")
    each = sides.join(mixed, "token")
    each = each.join(nodes.select("node", F.col("coarse").alias("counts")), "node")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["token", "node", "n", "place", "label", "counts"]
    asked = each.select(*held, place("asked").alias("i"), every("asking").alias("j"), F.lit(False).alias("asks"))
    asking = each.where("label != main").select(*held, every("asked").alias("i"), place("asking").alias("j"), F.lit(True).alias("asks"))
    met = asked.union(asking).groupBy("token", "i", "j").agg(F.collect_list(F.struct("node", "n", "place", "label", "asks", "counts")).alias("x"))
    return met.select(*[F.col(f"x.{c}").alias(name) for c, name in (("node", "nodes"), ("n", "sizes"), ("place", "places"), ("label", "labels"), ("asks", "asks"), ("counts", "counts"))])


def links(rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """a, b: similar nodes, enough of them to connect all that similarity connects."""
    spark, some = rows.sparkSession, rows.where(F.pmod(F.xxhash64("k"), F.lit(PART)) == 0)
    seen = _tokens(some, size, np.zeros(0, np.uint64)).groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") * PART > HOT)
    hot = seen.orderBy(F.desc("times"), "token").limit(HOT_TOKENS).select("token").toArrow()  # a row object for each would take some 50 times as much of the driver
    dealt = _tokens(rows, size, np.sort(hot.column("token").to_numpy().view(np.uint64)))
    shared = saved(dealt.groupBy("token").agg(F.count("*").alias("times"), F.min("node").alias("a"), F.max("node").alias("b")).where("a < b"), "shared")
    release(spark)
    many = shared.where("times > 2").select("token")
    members = saved(dealt.join(bounded(many, F.lit(32)), "token").distinct(), "members")
    release(spark)
    found = _confirmed(saved(by_fingerprint(nodes), "linked"), nodes, rows, size)
    sides = _labelled(nodes, found, members)
    held = [F.col("node").alias("a"), F.col("n").alias("m"), F.col("label").alias("own"), F.col("place").alias("other")]
    centre = sides.groupBy("token").agg(F.min(F.struct(*held)).alias("c"), F.min_by(F.struct(*held), F.xxhash64("node", F.lit(1))).alias("d"), F.min("label").alias("first"), F.max("label").alias("last"))
    centre = saved(centre.where("first < last").select("token", F.explode(F.array_distinct(F.array("c", "d"))).alias("c")).select("token", "c.*"), "centres")
    more = sides.join(centre, "token").where("label != own and 5 * least(n, m) >= 4 * greatest(n, m) and 9L * least(n - place, m - other) >= 4L * (n + m)")
    stars = shared.where("times = 2").select("a", "b").union(more.select(F.least("a", "node"), F.greatest("a", "node"))).distinct()
    stars = stars.join(found, ["a", "b"], "left_anti")
    found = found.union(_confirmed(saved(stars, "stars"), nodes, rows, size))
    release(spark)
    rest = saved(_apart(_blocks(_labelled(nodes, found, members), nodes)), "rest")
    return found.union(_confirmed(rest, nodes, rows, size))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key and component_id (the smallest key reachable) of every row of docs with a key."""
    rows = _rows(docs, key, text)
    prints = saved(_embedded(rows, size), "embedded")
    nodes = saved(prints.groupBy("node").agg(F.min("k").alias("least"), F.max("n").alias("n"), F.first("fp").alias("fp"), F.first("counts").alias("counts"), F.first("coarse").alias("coarse")), "nodes")
    of = nodes.select("node", "least").join(components(links(rows, nodes, size)), "node", "left")
    of = saved(of.select("node", F.coalesce("root", "node").alias("root"), "least"), "roots")
    label = of.groupBy("root").agg(F.min("least").alias("component_id"))
    known = saved(of.join(label, "root").select("node", "component_id"), "labels")
    return prints.select("k", "node").join(bounded(known, F.lit(32)), "node").select(F.col("k").alias(key), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """docs with one row of each component, as simhash.deduplicated keeps them."""
    return kept(docs, near_duplicates(docs, key, text, size), key)
