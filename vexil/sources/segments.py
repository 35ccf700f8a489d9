"""Built graph segments on a shared file system: staged, published, checked, copied.

Segments are written to a folder of their own and seen by nobody until a record names it. Each row carries a digest of its
payload, so that damage is found and a copy can be compared without reading vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Conflict, Versions


def payload_digest() -> Column:
    """SHA-256 over ids, vectors and links of a packed segment."""
    ids = F.transform("ids", lambda i: F.concat(F.octet_length(i).cast("string"), F.lit(":"), i))
    return F.sha2(F.concat(F.array_join(ids, ",").cast("binary"), F.col("vectors"), F.col("sizes"), F.col("links")), 256)


class SegmentCatalog(Versions):
    def stage(self, index: DataFrame) -> str:
        """Write packed segments, a file task by task; the name returned is to be published."""
        part = self.new_part(self.manifest())
        index.withColumn("digest", payload_digest()).write.parquet(f"{self.path}/{part}")
        return part

    def publish(self, staged: list[str], offset: int = 0, replace: bool = False) -> int:
        """Make staged segments visible together. ``offset`` is that of the last change they hold; ``replace`` drops all others."""
        old = self.manifest()
        known = [] if replace else old["parts"]
        fresh = [p for p in staged if p not in known]
        if not fresh and known == old["parts"]:
            return old["version"]
        return self.record(old, offset=max(offset, old["offset"]), parts=[*known, *fresh])

    def unpublish(self, parts: list[str]) -> int:
        old = self.manifest()
        return self.record(old, parts=[p for p in old["parts"] if p not in parts])

    def index(self, version: int | None = None) -> DataFrame:
        """Packed segments with their digests, of the current or an older version."""
        parts = self.manifest(version)["parts"]
        if not parts:
            raise KeyError("no segment is published")
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def damaged(self, version: int | None = None) -> DataFrame:
        """segment, fault: a payload that differs from its digest, or a number that stands twice."""
        rows = self.index(version)
        broken = rows.where(F.col("digest") != payload_digest()).select("segment", F.lit("digest").alias("fault"))
        twice = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("segment", F.lit("repeated").alias("fault"))
        return broken.unionByName(twice)

    def locations(self) -> DataFrame:
        """id, segment. Written once a version; a table that is missing or unfinished is built again from the segments."""
        at = f"{self.path}/locations/{self.manifest()['version']:012d}"
        if not self.fs.exists(self._path(f"{at}/_SUCCESS")):
            self.index().select(F.explode("ids").alias("id"), "segment").write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def export_to(self, target: SegmentCatalog) -> int:
        """Copy the current segments to another catalog in one version; segments that it has already are left out, so a retry adds nothing.

        Segments are checked before they are visible there. Changes after the record's offset are to be replayed on top.
        """
        here, there = self.manifest(), target.manifest()
        rows = self.index()
        if there["parts"]:
            known = target.index().select("segment", "digest")
            clash = rows.select("segment", F.col("digest").alias("_d")).join(known, "segment").where(F.col("_d") != F.col("digest")).limit(1).count()
            if clash:
                raise Conflict("a segment of this number is there with other contents")
            rows = rows.join(known, ["segment", "digest"], "left_anti")
        if not rows.limit(1).count():
            return there["version"]
        part = target.new_part(there)
        rows.write.parquet(f"{target.path}/{part}")
        written = self.spark.read.parquet(f"{target.path}/{part}")
        if written.where(F.col("digest") != payload_digest()).limit(1).count():
            raise Conflict("a segment was damaged")
        return target.publish([part], here["offset"])
