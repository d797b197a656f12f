"""A store of immutable shards with size-tiered compaction and versioned manifests.

An arrival is appended as small shards, one for each partition it comes in. When a tier
(files within a factor FANOUT in size) has gathered FANOUT runs or a target's bytes, its files
are merged into files of about the target size. Either change writes a whole new manifest
next to the old ones and commits it by giving the version's marker its name, whole: the marker is
written under another name first and takes its own only where no marker has it, so only one writer
can, and no reader sees half of one. Readers see the last committed version. expire removes old
versions with the shards that only they name; what a writer that failed left behind under no
version is never read.

Only DataFrame and SQL operations touch rows; merging reads files and writes fewer, without
a shuffle. The driver holds sums by tier, at most MERGE_FILES paths while merging, and when a
version is read or expired the paths of its shards, one for each target_bytes of data.

All columns are kept as they come, nulls and repeated rows included. An empty arrival
commits a version without new shards. A store without any version can't be read.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

FANOUT, SMALLEST, TARGET_BYTES, MERGE_FILES = 4, 1 << 20, 128 << 20, 10_000
_MANIFEST = "path string, run string, bytes long, rows long"


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, smallest: int = SMALLEST):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest

    def _nothing(self, schema) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    # versions ----------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        fs, folder = self._fs(f"{self.root}/commits")
        if not fs.exists(folder):
            return 0
        return max((int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, run, bytes and rows of a version's shards."""
        version = self.version() if version is None else version
        if not version:
            return self._nothing(T._parse_datatype_string(_MANIFEST))
        return self.spark.read.schema(_MANIFEST).parquet(self._folder(version))

    def _folder(self, version: int) -> str:
        """Where a version's manifest is."""
        fs, marker = self._fs(f"{self.root}/commits/{version:020d}")
        stream = fs.open(marker)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def _commit(self, base: int, shards: DataFrame) -> int:
        """Makes shards the manifest of version base + 1, or raises VersionTaken."""
        folder = f"{self.root}/manifests/{base + 1:020d}-{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(folder)
        jvm, marker = self.spark._jvm, f"{self.root}/commits/{base + 1:020d}"
        fs, draft = self._fs(f"{self.root}/commits/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.writeUTF(folder)
        stream.close()
        try:
            _, target = self._fs(marker)
            if fs.getScheme() == "file":  # a local rename would overwrite; a link can't
                paths = [jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (target, draft)]
                jvm.java.nio.file.Files.createLink(*paths)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, none)
        except Exception as e:
            if fs.exists(target):
                raise VersionTaken(base + 1) from e
            raise
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)
        return base + 1

    # shards ------------------------------------------------------------------------------

    def _written(self, df: DataFrame) -> DataFrame:
        """Writes df's partitions as the shards of a new run; their manifest rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._found(folder)

    def _found(self, folder: str) -> DataFrame:
        """The manifest rows of a folder's files, which are one run."""
        run = uuid.uuid4().hex
        found = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return found.agg(F.count("*").alias("rows")).select("path", F.lit(run).alias("run"), "bytes", "rows")

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as small shards; the version it is in."""
        base = self.version()
        return self._commit(base, self.manifest(base).unionByName(self._written(df.select(*self.schema.names))))

    def adopt(self, folder: str) -> int:
        """Adds the Parquet files of a folder, which are the store's from then on, as an arrival; the version it is in."""
        base = self.version()
        return self._commit(base, self.manifest(base).unionByName(self._found(folder)))

    def tiered(self, shards: DataFrame) -> DataFrame:
        """Adds tier: 0 for files of at most `smallest` bytes, one more for each factor `fanout`; null from the target's half on."""
        steps = F.ceil(F.log(float(self.fanout), F.greatest(F.col("bytes") / self.smallest, F.lit(1.0))))
        return shards.withColumn("tier", F.when(F.col("bytes") < self.target / 2, steps.cast("int")))

    def compact(self) -> int:
        """Merges the lowest tier that is due, again and again, each merge in a version of its own; the last version."""
        while True:
            base = self.version()
            shards = self.tiered(self.manifest(base))
            due = shards.where("tier is not null").groupBy("tier").agg(F.countDistinct("run").alias("runs"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
            due = due.where((F.col("files") > 1) & ((F.col("runs") >= self.fanout) | (F.col("bytes") >= self.target))).orderBy("tier").first()
            if due is None:
                return base
            chosen = shards.where(F.col("tier") == due.tier).orderBy("bytes", "path").limit(MERGE_FILES)
            merged = chosen.select("path", "bytes").collect()
            files = max(1, math.ceil(sum(r.bytes for r in merged) / self.target))
            if files >= len(merged):
                return base
            rows = self.spark.read.schema(self.schema).parquet(*[r.path for r in merged])
            new = self._written(rows.coalesce(files))
            kept = self.manifest(base).join(F.broadcast(chosen.select("path")), "path", "left_anti")
            self._commit(base, kept.unionByName(new))

    def expire(self, keep: int = 1) -> None:
        """Removes all versions but the last `keep`: their shards that no kept version names, their manifests and their markers."""
        last = self.version()
        kept = [self.manifest(v).select("path") for v in range(max(1, last - keep + 1), last + 1)]
        for v in range(last - keep, 0, -1):
            fs, marker = self._fs(f"{self.root}/commits/{v:020d}")
            if not fs.exists(marker):
                break
            old = self.manifest(v).select("path").join(reduce(DataFrame.union, kept).distinct(), "path", "left_anti")
            for r in old.toLocalIterator():
                f, p = self._fs(r.path)
                f.delete(p, False)
            folder = self._folder(v)
            fs.delete(marker, False)  # before its manifest: a version that is named can be read
            f, p = self._fs(folder)
            f.delete(p, True)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r.path for r in self.manifest(version).where("rows > 0").select("path").orderBy("path").toLocalIterator()]
        if not paths:
            return self._nothing(self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


def arrivals(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df with one more last column, the number of the arrival that each row comes in, by a hash of its key (null keys come in the first).

    It is named arrival, with as many _ behind as it takes to be a name of its own.
    """
    into = free_name(df, "arrival")
    digits = F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 4)
    return df.withColumn(into, F.coalesce(F.conv(digits, 16, 10).cast("int") % parts, F.lit(0)))


def ingest(df: DataFrame, root: str, key: str = "doc_id", parts: int = 4, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Brings df into a new store as `parts` arrivals, compacting after each; the store. df is read once, and dealt to its arrivals as it is written."""
    numbered = arrivals(df, key, parts)
    store = ShardStore(df.sparkSession, root, numbered.schema, target_bytes)
    part = free_name(numbered, "part")
    folder = f"{store.root}/data/{uuid.uuid4().hex}"
    numbered.withColumn(part, F.col(numbered.columns[-1])).write.option("compression", "zstd").partitionBy(part).parquet(folder)
    for a in range(parts):
        fs, arrived = store._fs(f"{folder}/{part}={a}")
        if fs.exists(arrived):
            store.adopt(arrived.toString())
        else:
            store.append(store._nothing(store.schema))
        store.compact()
        store.expire()
    return store


#: The rows of the store that ingest makes of the table documents, in DuckDB.
SQL = """
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5,
  CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::BIGINT % 4 AS INTEGER) AS arrival
FROM documents
"""
