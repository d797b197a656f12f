"""Recording sessions: a folder of records, the schemas they need, snapshots, and manifests that only move forward."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.operators.storage import latest
from streamloom.schema import artifact
from streamloom.schema.model import Schema
from streamloom.sources.files import Taken, create_whole, path_of, read_whole


class SessionError(RuntimeError):
    """The session is missing, somebody else's, or would go back."""


class Conflict(SessionError):
    """Another writer committed first."""


class RecordingSession:
    """Records lie in batches under data/, partitioned by topic and partition; a batch is in the session once its manifest is.

    A manifest is a small JSON file named by its generation, which one writer can create. Each is built of one older
    manifest alone, and built again where another writer came first, so no commit loses another's.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _list(self, folder: str) -> list[str]:
        fs, p = path_of(self.spark, f"{self.root}/{folder}")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if not n.startswith(".")]

    def _read(self, path: str) -> str:
        return read_whole(self.spark, f"{self.root}/{path}").decode()

    def _create(self, path: str, text: str) -> None:
        """Writes a new file, whole; an existing one is an error."""
        try:
            create_whole(self.spark, f"{self.root}/{path}", text.encode())
        except Taken as e:
            raise Conflict(f"{path} is there already") from e

    # manifests ---------------------------------------------------------------------------

    def manifest(self) -> dict:
        """The manifest of the highest generation."""
        names = [n for n in self._list("manifests") if n.endswith(".json")]
        if not names:
            raise SessionError(f"no session at {self.root}")
        return json.loads(self._read(f"manifests/{names[-1]}"))

    def commit(self, manifest: dict) -> dict:
        new = manifest | {"generation": manifest["generation"] + 1}
        self._create(f"manifests/{new['generation']:012d}.json", json.dumps(new, sort_keys=True))
        return new

    def create(self, recording_id: int, owner: str) -> dict:
        return self.commit({"generation": 0, "recording_id": recording_id, "owner": owner, "batches": {}, "schemas": {}, "topics": {}, "durable": 0})

    def guard(self, generation: int = 0, durable: int = 0) -> dict:
        """The manifest, unless it is older than what its reader has seen before."""
        m = self.manifest()
        if m["generation"] < generation or m["durable"] < durable:
            raise SessionError("the session has gone back")
        return m

    # contents ----------------------------------------------------------------------------

    def changed(self, change: Callable[[dict], dict | None]) -> dict:
        """Commits change(manifest), again and again until no other writer comes first; None: nothing is to be changed."""
        while True:
            m = self.manifest()
            new = change(m)
            if new is None:
                return m
            try:
                return self.commit(new)
            except Conflict:
                continue

    def persist_schema(self, topic_id: int, schema: Schema) -> int:
        """Makes the schema durable before any record can refer to it; its ref."""
        if f"{schema.digest}.json" not in self._list("schemas"):
            try:
                self._create(f"schemas/{schema.digest}.json", artifact.dumps(schema))
            except Conflict:
                pass  # the same schema, by another writer

        def change(m: dict) -> dict | None:
            if schema.digest in m["schemas"]:
                return None
            return m | {"schemas": m["schemas"] | {schema.digest: len(m["schemas"]) + 1}, "topics": m["topics"] | {str(topic_id): schema.name}}

        return self.changed(change)["schemas"][schema.digest]

    def schema(self, ref: int) -> Schema:
        digest = next((d for d, r in self.manifest()["schemas"].items() if r == ref), None)
        if digest is None:
            raise SessionError(f"no schema {ref}")
        return artifact.loads(self._read(f"schemas/{digest}.json"))

    def append(self, records: DataFrame, batch: str | None = None) -> dict:
        """Adds a batch. One that is already in (a stream's repeated micro-batch) changes nothing."""
        m = self.manifest()
        batch = batch or uuid.uuid4().hex
        if batch in m["batches"]:
            return m
        known = self.spark.createDataFrame([(r,) for r in m["schemas"].values()], "schema_ref long")
        stray = records.where((F.col("flags").bitwiseAND(1) == 0) | (F.col("schema_ref") != 0)).join(F.broadcast(known), "schema_ref", "left_anti").limit(1).collect()
        if stray:
            raise SessionError(f"record with unknown schema {stray[0].schema_ref}")
        folder = f"data/_batch={batch}-{uuid.uuid4().hex[:8]}"
        records.write.partitionBy("topic_id", "partition_id").parquet(f"{self.root}/{folder}")
        return self.changed(lambda m: None if batch in m["batches"] else m | {"batches": m["batches"] | {batch: folder}, "durable": m["durable"] + 1})

    def records(self) -> DataFrame:
        """All records of committed batches, in one scan however many there are."""
        folders = [f"{self.root}/{f}" for f in self.manifest()["batches"].values()]
        if not folders:
            raise SessionError("no batch yet")
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*folders).drop("_batch")

    def stray_folders(self) -> list[str]:
        """Folders under data/ that no manifest names: left by writers that died."""
        known = {f.removeprefix("data/") for f in self.manifest()["batches"].values()}
        return [x for x in self._list("data") if x not in known]

    def snapshot(self) -> DataFrame:
        """The last record of each topic and partition."""
        return latest(self.records(), ["topic_id", "partition_id"], "ingestion_sequence")
