"""URL filter, decontamination, packing and nearest neighbours against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from streamloom.llm import ann, decontaminate, packing, url_filter

DOCS = "doc_id long, text string, sequence_id string, score double"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts)], DOCS).repartition(3)


# URL filter ---------------------------------------------------------------------------------


def expected_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "x://b.example.net/de/81", "x://example.net/de/7", "x://ex.org?es/", "x://ex.org/es/#", "x://org/es/1", "x://notcom/en/", "x://a.com:80/en/", "http://www.free-bets.example.net/fr/1", "http://blog.ththen.example.net/fr/2", "http://a.com/en/1\n/en/2", "ftp://ÄB.com/en/", "http://" + "a" * 50_000 + ".com/en/"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", (u or "").split("://", 1)[1] if "://" in (u or "") else "")
        host, path = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]
        rule = expected_rule(host, path)
        assert (rows[i].host, rows[i].path) == (host, path), u
        assert rows[i].rule == (rule and rule[1] + rule[2]), u
        assert rule is None or rows[i].verdict == rule[0]
    assert rows[13].verdict == "block" and rows[14].verdict == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_on_hosts_it_has_not_seen():
    """Hosts joined of other common words than it learnt with; none of the labelled hosts is one of the test pages'."""
    learnt, other = url_filter.COMMON[:5], ["club", "zone", "today", "web", *url_filter.COMMON[5:]]
    w, b = url_filter.train(url_filter.labelled_urls(common=learnt))
    seen = {r[0] for r in url_filter.labelled_urls(common=learnt)}
    rows = [r for r in url_filter.labelled_urls(common=other) if r[0] not in seen]
    for label, least in ((0, 0.95), (1, 0.8)):
        right = [(url_filter.score(h, p, w, b) >= 0.5) == bool(y) for h, p, y in rows if y == label]
        assert len(right) > 50 and np.mean(right) > least


def test_url_training_is_logistic_regression():
    """Against the same descent written plainly, feature by feature."""
    rows = url_filter.labelled_urls()[::40]
    w, b = url_filter.train(rows, epochs=30)
    x = np.zeros((len(rows), url_filter.SIZE))
    for i, (h, p, _) in enumerate(rows):
        f = url_filter.features(h, p)
        x[i, f] = 1 / np.sqrt(len(f))
    y, v, c, gv, gc = np.array([r[2] for r in rows]), np.zeros(url_filter.SIZE), 0.0, 1e-8, 1e-8
    gv = np.full(url_filter.SIZE, 1e-8)
    for _ in range(30):
        e = (1 / (1 + np.exp(-(x @ v + c))) - y) / len(rows)
        g = x.T @ e + 1e-4 * v
        gv += g * g
        v -= 0.5 * g / np.sqrt(gv)
        gc += e.sum() ** 2
        c -= 0.5 * e.sum() / np.sqrt(gc)
    assert np.allclose(w, v, atol=1e-6) and abs(b - c) < 1e-6


# decontamination ----------------------------------------------------------------------------


def test_windows_take_bounded_memory():
    """What a block of the benchmark takes on the driver, by its bytes."""
    import tracemalloc

    rng = np.random.default_rng(3)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 20_000, 300)).encode()) for i in range(1500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    decontaminate.windows(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * size  # so at most some 240 MB for BLOCK_BYTES


def brute_hits(text, items, size=13):
    w = decontaminate.words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        b = decontaminate.words((t or "").encode())
        n = min(size, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check_decontamination(spark, texts, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_of(spark, texts), bench, **more).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, h, f = brute_hits(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (n, h, len(f), f), (t or "")[:80]
        assert r.items_sha256 == hashlib.sha256(",".join(f).encode()).hexdigest()
        assert r.contaminated == (h > 0 and 20 * h >= n)
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == h
    return got


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    text = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(i, text(int(rng.integers(1, 40)), 6)) for i in range(30)] + [(90, None), (91, ""), (92, " ,;"), (93, "Ünï x"), (94, items_text := text(20, 6)), (95, items_text)]
    texts = [None, "", "...", "ÜNÏ x", "Ünï X!", "a ünï  x b"] + [text(int(rng.integers(1, 300)), int(rng.integers(2, 9))) for _ in range(60)]
    texts += [f"{text(30, 50)} {items[k][1].upper()} {text(400, 50)}" for k in range(10)] + [texts[20]] * 3 + [" ".join([items_text] * 400)]
    check_decontamination(spark, texts, items)
    check_decontamination(spark, texts, items, shard_bytes=500, block_bytes=300)


def test_decontamination_by_items_without_an_id(spark):
    import duckdb

    docs = spark.createDataFrame([(1, "x a b c y"), (2, "d e"), (3, "q")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "a b c"), (None, "d e"), (7, "d e")], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'x a b c y'), (2, 'd e'), (3, 'q')) t(doc_id, text)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (NULL, 'a b c'), (NULL, 'd e'), (7, 'd e')) t(item_id, text)")
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({decontaminate.SQL})").fetchall())
    for more in ({}, {"block_bytes": 4}):
        found = decontaminate.decontaminate(docs, benchmark, **more)
        assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == want
        assert {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in found.collect()} == {1: (3, [], True), 2: (2, ["7"], True), 3: (0, [], False)}
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, benchmark).collect()] == [3]


def test_the_decontamination_stage_searches_and_chooses_in_one_worker(spark):
    benchmark = spark.createDataFrame([("7", "a b c")], "item_id string, text string")
    out = decontaminate.without_contaminated(docs_of(spark, ["x a b c y", "other words", None]), benchmark)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_decontamination_of_nothing(spark):
    check_decontamination(spark, ["a b", None], [])
    assert decontaminate.decontaminate(docs_of(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        text = rng.integers(0, 4, n)
        index = decontaminate.FMIndex(text)
        for size in (1, 2, 5):
            patterns = rng.integers(0, 6, (40, size))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high, strict=True):
                want = [i for i in range(n - size + 1) if (text[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# packing ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark, path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    texts = [None, "", "a", "<|endoftext|>b", "日本語 text", "é" * 30, "x" * 60_000, " " * 9_000] + [" ".join(rng.choice(["the", "of", "stone", "7"], int(rng.integers(1, 6000)))) for _ in range(60)] + ["same text here"] * 500
    got = packing.pack(docs_of(spark, texts), path).collect()
    tokenizer = Tokenizer.from_file(path)
    by, slots = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        slots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 2048 or k == 0
            at += r.length
        assert at == len(ids) and len(by[i]) == -(-len(ids) // 2048)
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(slots) <= 1.02 * total / 2048 + 2
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_fast_and_whole_tokenizer_agree(path):
    from tokenizers import Tokenizer

    encode, whole = packing.encoder(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0, 0x250, 200))) for _ in range(300)] + ["it's we'LL  \n\n\t x  ", "\u3000a\u200b", "a" * 5000, "  \x85 \xa0 b"]
    assert [encode(t) for t in texts] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_is_tight():
    rng = np.random.default_rng(4)
    for n in (1, 5, 300, 5000):
        counts = np.bincount(rng.integers(1, 2048, n), minlength=2049)
        runs = packing.plan_slots(counts)
        assert runs[:, 0].max() < 2048 and (runs[:, 1] + runs[:, 2] <= counts[runs[:, 0]]).all()
        used = len({s + i for length, rank, held, s, _ in runs.tolist() for i in range(-(-int(counts[length] - rank) // held)) if i == 0})
        plain = sum(t for _, t in packing.best_fit([], counts.copy(), 2048))
        best = min(sum(t for _, t in packing.best_fit(*x, 2048)) for x in packing.rounded(counts, 2048))
        assert used <= best <= 1.01 * plain


@pytest.mark.parametrize(("shape", "shares"), [("short", (0.6, 0.95)), ("long", (1.0, 1.0)), ("even", (0.0, 0.25))])
def test_the_program_makes_the_packing(shape, shares):
    """Its configurations hold most pieces where lengths are those of texts, and the sequences are close to what no packing can beat.

    Lengths spread evenly up to a whole sequence leave each configuration a part of one: there best-fit needs fewer sequences and is taken.
    """
    rng = np.random.default_rng(11)
    draw = {"even": lambda n: rng.integers(1, 2048, n), "short": lambda n: 20 + rng.geometric(1 / 300, n).clip(max=2000), "long": lambda n: rng.integers(1100, 2048, n)}[shape]
    for n, share in zip((1000, 20_000), shares, strict=True):
        counts = np.bincount(draw(n), minlength=2049)
        packed, placed = packing.planned(counts)
        sequences = sum(t for _, t in packed)
        least = max(-(-int((np.arange(2049) * counts).sum()) // 2048), int(counts[1025:].sum()))
        assert sum(t * sum(h for _, h in c) for c, t in packed) == n
        assert placed >= share * n, (shape, n, placed)
        assert sequences <= 1.012 * least, (shape, n, sequences, least)


# nearest neighbours -------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 16))
    vectors = centres[rng.integers(0, 8, 3000)] * 0.5 + rng.standard_normal((3000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors = vectors.astype(np.float32)
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(vectors)]
    odd = [(5000, None, 0.0), (5020, [0.0] * 16, 0.0), (5040, [float("nan")] * 16, 0.0), (5060, [None] + [1.0] * 15, 0.0), (5080, [1.0, 2.0], 0.0), (5100, [float("inf")] * 16, 0.0), (None, [1.0] * 16, 0.0), (5120, [], 0.0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double").repartition(3)
    got = {}
    for r in ann.nearest(frame, query_block=70).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    exact, hits = vectors.astype(float), 0
    for q, found in got.items():
        product = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(3000), -product)) if i != q][:20]
        found.sort()
        assert [x[0] for x in found] == list(range(1, 21))
        assert all(abs(product[i] - s) < 1e-12 for _, i, s in found)
        assert [x[1] for x in found] == sorted((x[1] for x in found), key=lambda i: (-product[i], i))
        hits += len(set(order) & {x[1] for x in found})
    assert hits >= 0.9 * 20 * len(got)


def test_nearest_neighbours_of_lone_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 32))
    vectors = np.repeat(centres, 50, axis=0) + 0.02 * rng.standard_normal((2000, 32))
    lone = np.arange(0, 2000, 100)
    vectors[lone] = rng.standard_normal((len(lone), 32))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(frame, query_block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(x) for q, x in got.items()} == dict.fromkeys(range(0, 2000, 20), 20)
    for q in lone.tolist():
        product = vectors @ vectors[q]
        product[q] = -np.inf
        assert len(set(got[q]) & set(np.argsort(-product)[:20].tolist())) >= 15


def test_nearest_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.nearest(few).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 2, 20]
    assert ann.nearest(few.limit(0)).count() == 0
    assert ann.nearest(few.where("vec_id = 0")).count() == 0
