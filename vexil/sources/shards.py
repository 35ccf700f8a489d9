"""A collection over several stores: batches that all shards take or none, and moves of a shard's rows that can be resumed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import migration_delta
from . import changes
from .store import Store, Versions


class Shards:
    """``route`` gives the number of the store that owns an id."""

    def __init__(self, stores: list[Store], route: Callable[[Column], Column]):
        self.stores, self.route = stores, route

    def read(self) -> DataFrame:
        """All vectors, each from the shard that owns it; copies that a move left behind don't show."""
        own = [s.read().where(self.route(F.col("id")) == i) for i, s in enumerate(self.stores)]
        return reduce(DataFrame.unionByName, own)

    def insert(self, rows: DataFrame) -> list[int]:
        """Insert a batch by owner; where a shard refuses, what others took is deleted again and the fault raised. Returns the shards that took rows.

        The batch is written once, by shard, and each store reads its own folder.
        """
        spark, at = self.stores[0].spark, f"{self.stores[0].path}/staged/{uuid.uuid4().hex}"
        rows.withColumn("_shard", self.route(F.col("id"))).repartition("_shard", F.xxhash64("id") % 64).write.partitionBy("_shard").parquet(at)
        staged = spark.read.parquet(at)
        own = [staged.where(F.col("_shard") == i).drop("_shard") for i in range(len(self.stores))]
        done: list[int] = []
        try:
            for i, store in enumerate(self.stores):
                if own[i].limit(1).count():
                    store.insert(own[i])
                    done.append(i)
        except Exception:
            for i in done:
                self.stores[i].delete(own[i].select("id"))
            raise
        finally:
            self.stores[0].fs.delete(self.stores[0]._path(at), True)
        return done


COPYING, DRAINING, COMPLETE = "copying", "draining", "complete"


class Migration:
    """Moves the rows of one store that ``moves`` names to another. Its progress is a record, so a run that stopped goes on where it was."""

    def __init__(self, spark: SparkSession, path: str, source: Store, target: Store, moves: Column, rounds: int = 8):
        self.progress, self.source, self.target, self.moves, self.rounds = Versions(spark, path), source, target, moves, rounds

    def state(self) -> dict:
        have = self.progress.manifest()
        return {"state": have.get("state", COPYING), "applied": have.get("applied", -1), "copied": have.get("copied", 0)}

    def _save(self, **fields) -> None:
        self.progress.record(self.progress.manifest(), **fields)

    def copy(self) -> None:
        """The rows as they are now, in one commit. A copy that is made again is an upsert of the same rows."""
        at = self.source.manifest()
        rows = self.source.read(at["version"]).where(self.moves)
        if rows.limit(1).count():
            self.target.upsert(rows)
        self._save(state=DRAINING, applied=at["offset"], copied=rows.count())

    def drain(self) -> bool:
        """Apply what changed since; whether there was nothing left."""
        at, applied = self.source.manifest(), self.state()["applied"]
        late = changes.since(self.source.log(at["version"]), applied).where(self.moves)
        if not late.limit(1).count():
            return True
        self.target.append_log(late)
        self._save(state=DRAINING, applied=at["offset"])
        return False

    def differences(self) -> DataFrame:
        return migration_delta(self.source.read().where(self.moves), self.target.read().where(self.moves))

    def run(self) -> dict:
        """Copy, drain until the source is quiet, and compare all records; raises if they differ or the source never rests."""
        if self.state()["state"] == COPYING:
            self.copy()
        if self.state()["state"] == DRAINING:
            if not any(self.drain() for _ in range(self.rounds)):
                raise RuntimeError(f"the source still changed after {self.rounds} rounds")
            if self.differences().limit(1).count():
                raise RuntimeError("source and target differ")
            self._save(state=COMPLETE)
        return self.state()
