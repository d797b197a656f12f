"""Back-off scores, shard store and pipeline."""

import hashlib
import math
import re
import uuid

import numpy as np
import pytest

import corpus_pipeline
from streamloom.llm import backoff, decontaminate, packing, pii, sharding, simhash, toxicity
from streamloom.llm.common import shared_folder
from streamloom.llm.queries import tokenizer_path

# back-off scores ----------------------------------------------------------------------------


def plain_scores(texts, corpus, order=3, backoff=0.4):
    count = {}
    held = [decontaminate.words((t or "").encode()) for t in corpus]
    for w in held:
        for n in range(1, order + 1):
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                count[g] = count.get(g, 0) + 1
    log = lambda x: round(math.log10(x) * 1e6)
    total = log(max(1, sum(map(len, held))))
    out = []
    for t in texts:
        w = decontaminate.words((t or "").encode())
        micro = 0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, -1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 0:
                    micro += (longest - 1) * log(backoff) - total
                elif g in count:
                    micro += log(count[g]) - (total if n == 1 else log(count[g[:-1]])) + (longest - n) * log(backoff)
                    break
        out.append((len(w), micro))
    return out


def some_texts(seed, n):
    rng = np.random.default_rng(seed)
    return [None, "", ".,;", "One one ÖNE", f"solitary{seed}"] + [" ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(1, 80))) % 60) for _ in range(n)] + ["w1 w2 w3 w4 w5 w6"] * 40


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, order, monkeypatch):
    monkeypatch.setattr(backoff, "HOT", 20)  # so that some counts are broadcast and some are not
    texts = some_texts(order, 90)
    frame = spark.createDataFrame([(i // 2 * 2 if i > 6 else i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, gram int").repartition(3)
    got = sorted((r.doc_id, r.n_words, round(r.score * 1e6), r["mean"] is None or abs(r["mean"] - r.score / r.n_words) < 1e-9) for r in backoff.score(frame, order=order).collect())
    assert got == sorted((i // 2 * 2 if i > 6 else i, n, micro, True) for i, (n, micro) in enumerate(plain_scores(texts, texts, order)))
    assert backoff.score(frame.limit(0)).count() == 0


def test_scores_against_another_corpus_back_off(spark, monkeypatch):
    monkeypatch.setattr(backoff, "HOT", 20)
    texts, corpus = some_texts(1, 30), some_texts(9, 20)
    told, held = (spark.createDataFrame(list(enumerate(t)), "doc_id long, text string") for t in (texts, corpus))
    got = {r.doc_id: (r.n_words, round(r.score * 1e6)) for r in backoff.score(told, corpus=held).collect()}
    assert [got[i] for i in range(len(texts))] == plain_scores(texts, corpus)
    assert [round(r.score * 1e6) for r in backoff.score(told, corpus=held.limit(0)).orderBy("doc_id").collect()] == [m for _, m in plain_scores(texts, [])]


def test_scores_in_sql(spark):
    import duckdb

    from streamloom.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(backoff.SQL).fetchall()}
    got = {r.doc_id: (r.n_words, r.score, r["mean"]) for r in queries.op6_backoff_scores(spark, "/root/testdata/sf0.001").collect()}
    assert got == want
    want = sorted(con.execute(sharding.SQL).fetchall())
    assert sorted(map(tuple, queries.op8_sharding(spark, "/root/testdata/sf0.001").collect())) == want


# shard store --------------------------------------------------------------------------------


def store_of(spark, frame, **more):
    return sharding.ShardStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", frame.schema, **more)


def test_store(spark):
    rows = [(i if i % 9 else None, "x" * (i % 300) if i % 7 else None, i % 2 == 0) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, bytes boolean")
    key = lambda r: tuple((x is None, x) for x in r)
    store = store_of(spark, frame, target_bytes=40_000, smallest=1000)
    assert store.version() == 0 and store.read().count() == 0
    seen = []
    for a in range(9):
        part = frame.where((frame.doc_id % 9 == a) | (frame.doc_id.isNull() if a == 0 else frame.doc_id < 0)).repartition(3)
        seen += part.collect()
        version = store.append(part)
        assert sorted(map(key, store.read().collect())) == sorted(map(key, seen))
        assert store.compact() >= version
        assert sorted(map(key, store.read().collect())) == sorted(map(key, seen))
        assert sorted(map(key, store.read(version).collect())) == sorted(map(key, seen))
        store.expire()
    manifest = store.manifest().collect()
    assert len(manifest) < 15 and sum(r.rows for r in manifest) == len(seen) == 900
    due = store.tiered(store.manifest()).where("tier is not null").groupBy("tier").agg({"run": "count"}).collect()
    assert all(r[1] <= 12 for r in due)
    store.append(frame.limit(0))
    assert store.read().count() == 900


def test_only_one_writer_commits(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store = store_of(spark, frame)
    store.append(frame)
    before = store.manifest()
    assert store._commit(1, before) == 2
    with pytest.raises(sharding.VersionTaken):
        store._commit(1, before)
    assert store.version() == 2 and store.read().count() == 1


def test_a_commit_is_whole_or_nothing(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store = store_of(spark, frame)
    store.append(frame)
    fs, draft = store._fs(f"{store.root}/commits/.draft-of-a-writer-that-died")
    fs.create(draft, False).close()
    assert store.version() == 1 and store.read().count() == 1  # a draft is no version
    for v in (2, 3, 4):
        assert store.append(frame) == v
    assert store.read(2).count() == 2
    store.expire()
    named = [x.getPath().getName() for x in fs.listStatus(store._fs(f"{store.root}/commits")[1])]
    assert [n for n in named if n.isdigit()] == ["00000000000000000004"]
    assert len(fs.listStatus(store._fs(f"{store.root}/manifests")[1])) == 1 and store.read().count() == 4


def test_two_writers_lose_nothing(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store = store_of(spark, frame)
    base, shards = store.version(), store._written(frame)
    store.append(frame)  # another writer, in between
    with pytest.raises(sharding.VersionTaken):
        store._commit(base, store.manifest(base).unionByName(shards))
    assert store.read().count() == 1 and store.version() == 1


def test_ingest_keeps_columns_of_any_name(spark):
    frame = spark.createDataFrame([(i if i % 5 else None, f"t{i}", -1, "p") for i in range(40)], "doc_id long, text string, arrival int, part string")
    store = sharding.ingest(frame, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    got = store.read()
    assert got.columns == ["doc_id", "text", "arrival", "part", "arrival_"]
    assert sorted(map(str, got.drop("arrival_").collect())) == sorted(map(str, frame.collect()))
    assert sharding.ingest(frame.limit(0), f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").read().count() == 0


# pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(rng.choice(list("aeiourstln"), 5)) for _ in range(n))
    texts = [f"{say(30)}. {say(20)}" for _ in range(60)]
    labels = [0] * 60
    for _ in range(40):
        texts.append(f"{say(15)}. you awful idiot {say(5)}. {say(20)}")
        labels.append(1)
    bench = [say(30) for _ in range(4)]
    texts += [texts[0], texts[1].upper(), f"{say(20)} {bench[0]} {say(9)}", f"{bench[1]} {say(700)}", f"{say(12)} mail me@site.example {say(9)}", None, "", texts[2]]
    labels += [0] * 8
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {i: t for i, t, *_ in rows if toxicity.noisy_or(model.logits(t or "")) < 0.5}
    assert {i for i in range(60)} <= set(left) and not any(60 <= i < 100 for i in left)
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in left.items()}
    left = {i: t for i, t in left.items() if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in left)}
    assert 100 not in left and 101 not in left and 107 not in left
    wins = {tuple(w[i : i + 13]) for w in (decontaminate.words(b.encode()) for b in bench) for i in range(len(w) - 12)}
    for i, t in list(left.items()):
        w = decontaminate.words((t or "").encode())
        hit = {k for j in range(len(w) - 12) if tuple(w[j : j + 13]) in wins for k in range(j, j + 13)}
        if hit and 20 * len(hit) >= len(w):
            del left[i]
    assert 102 not in left and 103 in left
    left = {i: re.sub(r"me@site.example", "[email]", t or "") for i, t in left.items()}
    encode = packing.encoder(tokenizer_path())
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: len(encode(t)) + 1 for i, t in left.items()}
    assert hashlib.sha256(b"").hexdigest() and pii.KINDS[0] == "email"


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", 5), (None, "a b c", None, 7), (2, "a b c", "y", 8), (2, "a b c", "y", 8), (3, "a@b.example +", "z", 13)], "doc_id long, text string, score string, n_chars int")
    bench = spark.createDataFrame([], "item_id long, text string")
    model = toxicity.Model({}, -np.inf)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.schema == b.schema
    assert same(toxicity.without_toxic(docs, model), docs)
    assert same(decontaminate.without_contaminated(docs, bench), docs)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    out = {str(r.doc_id): r.text for r in corpus_pipeline.redact_personal_data(spark, docs, "").collect()}
    assert out == {"1": None, "None": "a b c", "2": "a b c", "3": "[email] +"}
    for f in (lambda d: toxicity.without_toxic(d, model), lambda d: decontaminate.without_contaminated(d, bench), simhash.deduplicated, pii.redacted, lambda d: packing.pack(d, tokenizer_path())):
        assert f(docs.limit(0)).count() == 0
