"""Sessions: manifests, schemas before records, repeated batches, streams."""

import pytest

from streamloom.schema import artifact, language
from streamloom.schema.model import SchemaError
from streamloom.sources.session import RecordingSession, SessionError
from streamloom.streaming import recorder

SCHEMA = "schema_ref long, topic_id long, partition_id long, ingestion_sequence long, flags long, payload string"


def schema():
    return language.compile_files("f", {"f": 'package p; option schema_version = "1.2"; message M { required int32 a = 1; optional string b = 2 [max_bytes = 4, default = "x"]; vector<vector<int32>> c = 3 [max_capacity = 2]; reserved 7; }'})["p.M"]


def test_artifact():
    s = schema()
    assert artifact.loads(artifact.dumps(s)) == s
    for bad in ("{}", "[", artifact.dumps(s).replace('"id": 1', '"id": 4')):
        with pytest.raises(SchemaError):
            artifact.loads(bad)


def test_session(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    s = RecordingSession(spark, root)
    with pytest.raises(SessionError):
        s.manifest()
    s.create(7, "me")
    with pytest.raises(SessionError):
        s.create(7, "other")
    rows = spark.createDataFrame([(1, 1, 0, i, 0, "x") for i in range(1, 6)] + [(0, 2, 1, 1, 1, "gap")], SCHEMA)
    with pytest.raises(SessionError):
        s.append(rows, "a")
    assert s.persist_schema(1, schema()) == s.persist_schema(1, schema()) == 1
    assert s.schema(1) == schema()
    first = s.append(rows, "a")
    assert s.append(rows, "a") == first and s.records().count() == 6
    s.append(rows.limit(1), "b")
    assert s.records().count() == 7 and {(r.topic_id, r.ingestion_sequence) for r in s.snapshot().collect()} == {(1, 5), (2, 1)}
    rows.write.parquet(f"{root}/data/_batch=left-behind")
    assert s.stray_folders() == ["_batch=left-behind"]
    assert s.guard(generation=first["generation"])["durable"] == 2
    with pytest.raises(SessionError):
        s.guard(generation=99)


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    one, other = RecordingSession(spark, root), RecordingSession(spark, root)
    one.create(1, "me")
    one.persist_schema(1, schema())
    rows = spark.createDataFrame([(1, 1, 0, 1, 0, "x")], SCHEMA)
    commit, busy = RecordingSession.commit, []

    def interleaved(self, manifest):
        if self is one and not busy:
            busy.append(True)
            other.append(rows, "theirs")  # after one has read the manifest, before it commits
        return commit(self, manifest)

    monkeypatch.setattr(RecordingSession, "commit", interleaved)
    m = one.append(rows, "mine")
    assert set(m["batches"]) == {"mine", "theirs"} and m["durable"] == 2 and one.records().count() == 2


def test_files_are_whole_or_not_there(spark, tmp_path):
    from streamloom.sources import files

    path = f"file://{tmp_path}/m/000000000001.json"
    files.create_whole(spark, path, b"first")
    with pytest.raises(files.Taken):
        files.create_whole(spark, path, b"second")
    assert files.read_whole(spark, path) == b"first"
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.startswith(".")] == ["000000000001.json"]


def test_recorded_stream(spark, tmp_path):
    s = RecordingSession(spark, f"file://{tmp_path}/s")
    s.create(1, "me")
    s.persist_schema(1, schema())
    for i in range(3):
        spark.createDataFrame([(1, 1, 0, i, 0, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    recorder.record(recorder.sources([stream()]), s, f"{tmp_path}/ck").awaitTermination(120)
    assert s.records().count() == 3
    recorder.record(stream(), s, f"{tmp_path}/other").awaitTermination(120)  # the same batches again
    assert s.records().count() == 3
    seen, outcomes = [], []

    def broken(batch):
        raise OSError("down")

    recorder.publish(stream(), f"{tmp_path}/p", lambda b: seen.append(b.count()), [broken, lambda b: b.count()], outcomes).awaitTermination(120)
    assert sum(seen) == 3 and {x[2] for x in outcomes} == {"degraded: OSError", "dispatched"}
