"""Duplicate bytes against brute force over all windows."""

import hashlib

import numpy as np
import pytest

from streamloom.llm import suffix_dedup


def brute(texts, span):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d, x in enumerate(data):
        for i in range(len(x) - span + 1):
            seen.setdefault(x[i : i + span], []).append((d, i))
    masks = [np.zeros(len(x), bool) for x in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                masks[d][i : i + span] = True
    out = []
    for x, m in zip(data, masks, strict=True):
        runs = int((np.diff(np.concatenate(([0], m.astype(np.int8)))) == 1).sum())
        out.append((len(x), int(m.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~m].tobytes()).hexdigest()))
    return out


def check(spark, texts, span, gram, group=suffix_dedup.GROUP, parts=3):
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.duplicate_bytes(frame, span=span, gram=gram, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, span)
    assert len(got) == len(texts)


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda k, v: "".join(chr(97 + int(x)) for x in rng.integers(0, v, k))
    passages = [word(int(rng.integers(150, 600)), 26) for _ in range(6)]
    texts = [None, "", "x", "é" * 150, "é" * 150 + "x", "ab" * 400, "a" * 199, "a" * 201, "b" * 200, word(200, 20)]
    for _ in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            p = passages[int(rng.integers(0, 6))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist())
            parts += [word(int(rng.integers(0, 200)), 26), p[a:b] if rng.random() < 0.7 else p]
        texts.append("".join(parts))
    near = list(texts[-1] + word(700, 26))
    for _ in range(12):
        copy = near.copy()
        for x in rng.integers(0, len(near), 3):
            copy[x] = "ß"
        texts.append("".join(copy))
    return texts + texts[12:15] * 2


@pytest.mark.parametrize("group", [256, 2])
def test_equals_brute_force(spark, group):
    check(spark, corpus(group), 200, 50, group)


def test_groups_hold_every_occurrence(spark):
    texts = corpus(3, 30)
    data = [(t or "").encode() for t in texts]
    rows = suffix_dedup.repeat_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.repeat, []).append((r.doc_id, r.start, r.length))
    for places in groups.values():
        assert len(places) > 1 and len({data[d][a : a + n] for d, a, n in places}) == 1 and places[0][2] >= 200
        found = data[places[0][0]][places[0][1] : places[0][1] + places[0][2]]
        every = {(d, a) for d, x in enumerate(data) for a in range(len(x) - len(found) + 1) if x.startswith(found, a)}
        assert {(d, a) for d, a, _ in places} <= every
    masks = [np.zeros(len(x), bool) for x in data]
    for r in rows:
        masks[r.doc_id][r.start : r.start + r.length] = True
    assert [int(m.sum()) for m in masks] == [removed for _, removed, _, _ in brute(texts, 200)]


def test_maximal_repeats_come_out_once():
    """Against all pairs: what two texts share around the anchor, and can't share more of."""
    rng = np.random.default_rng(12)
    for _ in range(200):
        left = ["".join(rng.choice(list("ab"), int(rng.integers(0, 6)))) for _ in range(7)]
        right = ["".join(rng.choice(list("ab"), int(rng.integers(1, 6)))) for _ in range(7)]
        spans = list({(a, b) for a, b in zip(left, right, strict=True)})
        got = [(n, r, tuple(sorted(m))) for n, r, m in suffix_dedup.maximal_repeats([a.encode() for a, _ in spans], [b.encode() for _, b in spans], 2)]
        common = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        want = set()
        for i, (a, b) in enumerate(spans):
            for c, d in spans[:i]:
                n, r = common(a, c), common(b, d)
                if r and n + r >= 2:
                    want.add((n, r, tuple(k for k, (x, y) in enumerate(spans) if x.startswith(a[:n]) and y.startswith(b[:r]))))
        assert len(got) == len(set(got)) and want <= set(got)


def test_small_spans(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 60)))) for _ in range(120)]
    check(spark, texts, 8, 3)
    check(spark, texts, 8, 3, 2)


def test_nothing(spark):
    assert suffix_dedup.duplicate_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [None, ""], 200, 50)
    check(spark, [f"{i} " * 90 for i in range(3)] + ["unlike any other " + "".join(map(chr, range(300, 900)))], 200, 50)
    check(spark, ["".join(map(chr, range(300 * i + 200, 300 * i + 500))) for i in range(4)], 200, 50)


def test_intervals():
    assert sorted(suffix_dedup.lcp_intervals([1, 3, 0, 3, 0, 2])) == sorted([(0, 0, 6), (1, 0, 2), (3, 1, 2), (3, 3, 4), (2, 5, 6)])


def test_chunks_change_nothing(spark, monkeypatch):
    """Blocks hashed in chunks of a few hundred windows: long texts, and repeats across the edges of chunks."""
    data = np.frombuffer("".join(x or "" for x in corpus(4)).encode(), np.uint8)
    ends = np.array([0, 700, 700, 5000, len(data)])
    whole = suffix_dedup.Anchors(data, ends, 200, 50)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 333)
    cut = suffix_dedup.Anchors(data, ends, 200, 50)
    for name in ("place", "first", "last", "gram_hash", "span_hash"):
        assert getattr(cut, name).tolist() == getattr(whole, name).tolist(), name
    start = np.arange(0, len(data) - 199, 7)
    hashes = [suffix_dedup.Hashes(data, kind).of(start, start + 200).tolist() for kind in (0, 1)]
    assert [x.tolist() for x in cut.window_hashes(start)] == hashes
    check(spark, corpus(5), 200, 50, 2)


def test_a_long_text_is_hashed_in_little_memory():
    import tracemalloc

    data = np.random.default_rng(1).integers(97, 123, 12 << 20, dtype=np.uint8)
    tracemalloc.start()
    x = suffix_dedup.Anchors(data, np.array([len(data)]), 200, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x.place) > len(data) // 100 and most < 8 * len(data)


def test_texts_are_not_shuffled(spark):
    """Only answers are: the blocks are read where they lie, and nothing is broadcast."""
    out = suffix_dedup.duplicate_bytes(spark.createDataFrame(list(enumerate(corpus(6))), "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "BroadcastExchange" not in plan
