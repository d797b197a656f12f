"""Near-duplicates of five-word shingles against all pairs."""

import numpy as np

from streamloom.llm import similar_sets


def plain_components(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set()))
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label


def corpus():
    """Chains of edited copies, a crowd around one text, a line common to most, short and wordless texts."""
    rng = np.random.default_rng(5)
    line = " ".join(f"common{i}" for i in range(9))
    texts = [None, "", " \t", "one two", "One  two", "a b c d e", "a b c d e f"]
    for g in range(12):
        words = [f"g{g}w{x}" for x in rng.integers(0, 500, 120)]
        for _ in range(5):
            texts.append(" ".join(words) + " " + line)
            for x in rng.integers(0, 120, 3):
                words[x] = f"z{rng.integers(0, 999)}"
    crowd = [f"c{x}" for x in rng.integers(0, 500, 150)]
    for _ in range(100):
        copy = crowd.copy()
        for x in rng.integers(0, 150, int(rng.integers(0, 6))):
            copy[x] = f"y{rng.integers(0, 9999)}"
        texts.append(" ".join(copy))
    return texts + [line + " " + " ".join(f"v{x}" for x in rng.integers(0, 9999, 20)) for _ in range(90)]


def test_all_pairs_of_four_fifths_are_found(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK", 9)  # so that a token's nodes meet in many blocks
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_sets.near_duplicates(frame).collect()}
    want = plain_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 30 < len(set(want)) < len(texts) - 60


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near = [*words[:60], "x", *words[61:130], "y", *words[131:]]  # two of 200 words differ: similarity 186 / 206
    far = [*words[:150], *(f"u{i}" for i in range(50))]
    frame = spark.createDataFrame([(3, " ".join(words)), (5, " ".join(near)), (8, " ".join(far)), (None, "q")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()) == [0, 3, 8]
    assert corpus_pipeline.drop_near_duplicates(spark, frame.limit(0), "").count() == 0


def distance(a, b):
    return int(similar_sets.manhattan(*(similar_sets.rows_of([similar_sets.segment_counts(x)]) for x in (a, b)))[0])


def test_tokens_keep_the_promise():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64)]))
        hot = np.sort(a[rng.random(len(a)) > 0.5])
        if similar_sets.similar(a, b):
            assert set(similar_sets.tokens(a, hot).tolist()) & set(similar_sets.tokens(b, hot).tolist())
            assert 9 * distance(a, b) <= len(a) + len(b)


def test_places_leave_room_where_similar_sets_first_meet():
    rng = np.random.default_rng(10)
    met = ruled_out = 0
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64)]))
        hot = np.sort(a[rng.random(len(a)) > 0.5])
        one, other = similar_sets.tokens(a, hot).tolist(), similar_sets.tokens(b, hot).tolist()
        shared = [similar_sets.fits(len(a), i, len(b), other.index(x)) for i, x in enumerate(one) if x in other]
        if similar_sets.similar(a, b):
            met += 1
            assert shared[0]
        ruled_out += len(shared) - sum(map(bool, shared))
    assert met > 100 and ruled_out > 100


def test_a_crowd_below_the_similarity_is_told_apart_before_its_texts_are_read(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(160):
        words = [f"c{i}" for i in range(150)]
        for x in rng.choice(150, 3, replace=False):
            words[x] = f"y{rng.integers(0, 10**9)}"
        texts.append(" ".join(words))
    asked, near = [], similar_sets._near
    monkeypatch.setattr(similar_sets, "_near", lambda pairs, nodes: asked.append(pairs.count()) or near(pairs, nodes))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar_sets.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)
    assert asked[-1] < len(texts)  # pairs of the blocks


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(7)
    for n, m in ((3, 9), (40, 47), (500, 700), (900, 60_000), (300_000, 310_000), (60_000, 300_000)):
        pool = np.unique(rng.integers(0, 1 << 63, max(n, m), dtype=np.uint64) * np.uint64(2))
        crowded = pool >> np.uint64(int(rng.integers(0, 12)))
        for of in (pool, np.unique(crowded)):
            a, b = of[:n], of[-m:]
            assert distance(a, b) == distance(b, a) <= len(np.setxor1d(a, b))


def test_keys_that_are_null_or_repeat(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words, 1), (7, words, 1), (7, "other text of this key", 2), (9, words + " end", 3), (9, words + " end", 3), (11, None, 4), (12, "", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = similar_sets.deduplicated(frame).collect()
    assert sorted((r.doc_id or 0, r.node) for r in got)[:1] == [(0, 1)] and {r.doc_id for r in got} == {None, 7, 11}
    assert similar_sets.near_duplicates(frame.limit(0)).count() == 0


def test_the_stage_goes_by_fingerprints_first(spark, monkeypatch):
    """SimHash's cells deal the shingles' fingerprints; what they link is what is compared first."""
    import corpus_pipeline
    from streamloom.llm import simhash

    texts = corpus()
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, *rest: asked.append({r.fp for r in nodes.collect()}) or links(nodes, *rest))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()}
    want = plain_components(texts)
    assert kept == set(want)
    sets = [similar_sets.shingle_set((t or "").encode()) for t in texts]
    prints = [simhash.majority(x) if len(x) else 0 for x in sets]
    assert asked == [{int(np.array(x, np.uint64).view(np.int64)) for x in prints}]
    nodes = spark.createDataFrame(sorted({(similar_sets.node_of(x), int(np.array(p, np.uint64).view(np.int64))) for x, p in zip(sets, prints, strict=True)}), "node long, fp long")
    pairs = similar_sets.by_fingerprint(nodes).collect()
    of = {similar_sets.node_of(x): p for x, p in zip(sets, prints, strict=True)}
    near = {p for p in of.values() for q in of.values() if 0 < (p ^ q).bit_count() <= 3}
    assert len(pairs) > 10 and all(r.a < r.b for r in pairs) and {of[x] for r in pairs for x in (r.a, r.b) if of[r.a] != of[r.b]} == near


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "EDGES", 16)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in zip(rng.permutation(300), rng.permutation(300), strict=True)] + [(1000 + i, 1001 + i) for i in range(200)] + [(2000, x) for x in range(1900, 2100)]
    label = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    found = {(r.node, r.root) for r in similar_sets.components(frame).collect()}
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert found == {(x, r) for x, r in label.items() if x not in alone}
    assert similar_sets.components(frame.limit(0)).count() == 0
