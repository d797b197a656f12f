"""SimHash components against all pairs."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from streamloom.llm import simhash


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=3):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    base = ["w%d" % x for x in rng.integers(0, 900, 400)]
    texts = [None, "", " \t\n", "one", "ONE", "two words", "Two  Words", "a\x1fb c\x0bd", "a\x1fb c d", "é É x"]
    for _ in range(120):
        copy = base.copy()
        for x in rng.integers(0, 400, int(rng.integers(0, 6))):
            copy[x] = "z%d" % rng.integers(0, 99)
        texts.append(" ".join(copy))
    texts += [" ".join("v%d" % x for x in rng.integers(0, 99999, 30)) for _ in range(60)] + texts[20:25] * 3 + ["long " * 30_000]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    prints = [plain_print(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints)
    assert len(got[0].fingerprint) == 16


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    """Thousands of fingerprints around one, and cells that every level has to split."""
    rng = np.random.default_rng(1)
    monkeypatch.setattr(simhash, "LEVELS", ((simhash.LEVELS[0][0], True, 8), (simhash.LEVELS[1][0], False, 8), simhash.LEVELS[2]))
    prints = [0x0123456789ABCDEF]
    for _ in range(350):
        x = prints[int(rng.integers(0, min(len(prints), 40)))]
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints) | {int(x) for x in rng.integers(0, 1 << 63, 100)})
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    want = plain_components(prints)
    groups = {}
    for x, c in zip(signed, want, strict=True):
        groups.setdefault(c, []).append(x)
    for members in groups.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64).view(np.int64) for _ in range(2))
    b[:1000] = a[:1000] ^ (np.int64(1) << rng.integers(0, 63, 1000))
    near = simhash._manhattan(simhash._fields(a), simhash._fields(b)).astype(int)
    for x, y, d in zip(a.tolist(), b.tolist(), near.tolist(), strict=True):
        count = sum(abs((x >> i & 3).bit_count() - (y >> i & 3).bit_count()) for i in range(0, 64, 2))
        assert count == d <= ((x ^ y) & (1 << 64) - 1).bit_count()


def test_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "A B c d"), (None, "lonely text it is")], "doc_id long, text string")
    got = sorted((r.component_id is None, r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert got == [(False, 3)] * 4 + [(True, None)]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
    assert spark.range(1).select(simhash.popcounts(F.lit(-1).cast("long"))).first()[0] == -0x5555555555555556


def test_a_fine_level_is_a_small_plan(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 3, 7, 1 << 40)], "fp long")
    masks, counted, cap = simhash.LEVELS[2][0], *simhash.LEVELS[2][1:]
    plans = []
    saved = simhash.saved
    simhash.saved = lambda df, name: plans.append(df._jdf.queryExecution().analyzed().treeString()) or saved(df, name)
    try:
        found, _ = simhash._level(nodes, masks, counted, cap, 3)
        assert {(r.a, r.b) for r in found.collect()} >= {(3, 1), (7, 1)}
    finally:
        simhash.saved = saved
    assert len(masks) == 560 and plans[0].count("struct") < 10
