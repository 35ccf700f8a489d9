"""A collection on a shared file system: immutable Parquet commits and a manifest that makes them visible.

Every commit writes changes (offset, op, id, values, metadata) to a folder of its own and then a manifest file of the next
number. Readers list the manifests, so a crash between the two leaves nothing visible. Vector and metadata are one row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import changes
from .vectors import SCHEMA

LOG_SCHEMA = "offset long, op string, id string, values array<float>, metadata map<string,string>"


class Conflict(ValueError):
    pass


class Versions:
    """Numbered records in a folder: each is written beside and renamed, so that readers see the last whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.path}/manifests"))

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(self._path(f"{self.path}/manifests")) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if not version:
            return {"version": 0, "offset": 0, "parts": []}
        text = "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version:012d}.json").collect())
        return json.loads(text)

    def record(self, old: dict, **fields) -> int:
        """Make ``old`` with ``fields`` the next version."""
        new = {**old, **fields, "version": old["version"] + 1}
        target, temporary = self._path(f"{self.path}/manifests/{new['version']:012d}.json"), self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(temporary)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(temporary, target):  # one writer at a time is assumed; a second one fails here
            raise Conflict(f"version {new['version']} was written meanwhile")
        return new["version"]

    def new_part(self, old: dict) -> str:
        return f"parts/{old['version'] + 1:012d}-{uuid.uuid4().hex}"


class Store(Versions):
    def _publish(self, old: dict, part: str, offset: int, whole: bool) -> int:
        return self.record(old, offset=offset, parts=[part] if whole else [*old["parts"], part])

    def log(self, version: int | None = None) -> DataFrame:
        parts = self.manifest(version)["parts"]
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], LOG_SCHEMA)

    def since(self, offset: int) -> DataFrame:
        return changes.since(self.log(), offset)

    def read(self, version: int | None = None) -> DataFrame:
        """id, values, metadata of the current or an older version."""
        return changes.state(self.log(version)).select("id", "values", "metadata")

    def append(self, op: str, rows: DataFrame) -> int:
        """Write changes of one kind; offsets follow the last one, in partitions, without a global sort."""
        old = self.manifest()
        part = self.new_part(old)
        own = {f.name: f for f in rows.schema}
        values = F.col("values").cast("array<float>") if "values" in own else F.lit(None).cast("array<float>")
        metadata = F.col("metadata").cast("map<string,string>") if "metadata" in own else F.lit(None).cast("map<string,string>")
        out = rows.select(F.monotonically_increasing_id().alias("_at"), F.lit(op).alias("op"), "id", values.alias("values"), metadata.alias("metadata"))
        out.select((F.lit(old["offset"]) + 1 + F.col("_at")).alias("offset"), "op", "id", "values", "metadata").write.parquet(f"{self.path}/{part}")
        last = self.spark.read.parquet(f"{self.path}/{part}").agg(F.max("offset")).first()[0]
        return self._publish(old, part, last if last is not None else old["offset"], False)

    def append_log(self, log: DataFrame) -> int:
        """Write changes of all kinds as they are; their offsets follow the last one here and keep their order."""
        old = self.manifest()
        part = self.new_part(old)
        low, high = log.agg(F.min("offset"), F.max("offset")).first()
        if low is None:
            return old["version"]
        shift = old["offset"] + 1 - low
        log.select((F.col("offset") + F.lit(shift)).alias("offset"), "op", "id", "values", "metadata").write.parquet(f"{self.path}/{part}")
        return self._publish(old, part, high + shift, False)

    def upsert(self, rows: DataFrame) -> int:
        return self.append("upsert", rows)

    def insert(self, rows: DataFrame) -> int:
        """All rows or none: blank or repeated ids, empty vectors and ids that are there fail the batch."""
        faults = changes.insert_faults(rows, self.read()).limit(5).collect()
        if faults:
            raise Conflict(", ".join(f"{r['id']}: {r['fault']}" for r in faults))
        return self.append("upsert", rows)

    def delete(self, ids: DataFrame) -> int:
        gone = changes.missing(ids, self.read()).limit(5).collect()
        if gone:
            raise KeyError(", ".join(r["id"] for r in gone))
        return self.append("delete", ids.select("id").distinct())

    def set_metadata(self, rows: DataFrame) -> int:
        return self.append("metadata", rows.select("id", "metadata"))

    def compact(self) -> int:
        """Rewrite the current state as one part. Older versions stay readable."""
        old = self.manifest()
        part = self.new_part(old)
        changes.state(self.log()).select("offset", F.lit("upsert").alias("op"), "id", "values", "metadata").write.parquet(f"{self.path}/{part}")
        return self._publish(old, part, old["offset"], True)

    def files(self, version: int | None = None) -> DataFrame:
        """name, bytes, sha256 of the version's files: the manifest of a backup. Contents are hashed where they are read."""
        parts = self.manifest(version)["parts"]
        if not parts:
            return self.spark.createDataFrame([], "name string, bytes long, sha256 string")
        raw = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([f"{self.path}/{p}" for p in parts])
        return raw.select(F.regexp_extract("path", r"(parts/.*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class Blobs:
    """Named blobs in a folder. A put is written beside and renamed, so that a reader sees the old content or the new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, key: str):
        if not key or key.startswith("/") or any(p in ("", ".", "..") or p.startswith(".put-") for p in key.split("/")):
            raise ValueError(f"not a name of a blob: {key!r}")
        return self._path(f"{self.path}/{key}")

    def put(self, key: str, content: bytes) -> None:
        at = self._at(key)
        beside = self._path(at.getParent(), f".put-{uuid.uuid4().hex}")
        out = self.fs.create(beside)
        out.write(bytearray(content))
        out.close()
        if self.fs.exists(at):
            self.fs.delete(at, False)
        if not self.fs.rename(beside, at):
            raise Conflict(key)

    def get(self, key: str) -> bytes:
        at = self._at(key)
        if not self.fs.exists(at):
            raise KeyError(key)
        row = self.spark.read.format("binaryFile").load(at.toString()).first()  # Spark reads no row of an empty file
        return bytes(row["content"]) if row else b""

    def delete(self, key: str) -> None:
        """A blob that isn't there is no fault."""
        self.fs.delete(self._at(key), False)

    def all(self, prefix: str = "") -> DataFrame:
        """key, bytes, content of the blobs whose key begins with ``prefix``, empty ones left out; contents are read by executors."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)
        root = self.fs.makeQualified(self._path(self.path)).toString()
        key = F.replace(F.col("path"), F.lit(f"{root}/"), F.lit(""))
        return raw.select(key.alias("key"), F.col("length").alias("bytes"), "content").where(F.col("key").startswith(prefix))


def export_snapshot(vectors: DataFrame, path: str) -> None:
    """JSON lines of id, values, metadata."""
    vectors.select("id", "values", "metadata").write.mode("overwrite").json(path)


def import_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def encrypted(blobs: DataFrame, key: str) -> DataFrame:
    """Blobs(key, content) under AES-GCM with the blob's name as associated data; ``key`` is hex."""
    return blobs.withColumn("content", F.expr(f"aes_encrypt(content, unhex('{key}'), 'GCM', 'DEFAULT', '', key)"))


def decrypted(blobs: DataFrame, key: str) -> DataFrame:
    return blobs.withColumn("content", F.expr(f"aes_decrypt(content, unhex('{key}'), 'GCM', 'DEFAULT', key)"))
