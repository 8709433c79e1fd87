"""A table of vectors in committed versions, laid out so that reads touch only the shards they need.

``vectors/attempt=A/partition=P/shard=S`` and ``means/attempt=A`` hold what an attempt wrote; ``index/version=N`` says which ids lie where and names its
attempt. The index is written to a staging folder and renamed into place after everything else is there: that rename is the commit. Readers take the attempts that the
index names, so what a failed attempt left behind is never seen, and a retry writes under a name of its own. One writer at a time; a second
one finds its version taken and fails without harm."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.operators.vectors import mean_vectors, shard_plan
from sitelake.session import child_names, publish

INDEX = "partition string, id bigint, length bigint, shard bigint, start_offset bigint, end_offset bigint, attempt string"


@dataclass(frozen=True)
class VectorStore:
    spark: SparkSession
    folder: str
    capacity: int  # positions of a shard

    def versions(self) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in child_names(self.spark, f"{self.folder}/index") if name.startswith("version="))

    def index(self) -> DataFrame:
        """partition, id, length, shard, start_offset, end_offset, attempt, version of every committed id."""
        paths = [f"{self.folder}/index/version={n}" for n in self.versions()]
        if not paths:
            return self.spark.createDataFrame([], f"{INDEX}, version int")
        return self.spark.read.schema(f"{INDEX}, version int").option("basePath", f"{self.folder}/index").parquet(*paths)

    def _attempts(self) -> list[str]:
        return sorted(r[0] for r in self.index().select("attempt").distinct().collect())  # one per version

    def vectors(self) -> DataFrame:
        """pid, position, vec, attempt, partition, shard of all committed versions; the last three are folders, so conditions on them prune files."""
        return self._parquet([f"attempt={a}" for a in self._attempts()])

    def _parquet(self, folders: list[str]) -> DataFrame:
        schema = "pid bigint, position bigint, vec array<float>, attempt string, partition string, shard bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/vectors").parquet(*[f"{self.folder}/vectors/{f}" for f in sorted(folders)])

    def means(self) -> DataFrame:
        paths = [f"{self.folder}/means/attempt={a}" for a in self._attempts()]
        if not paths:
            return self.spark.createDataFrame([], "pid bigint, mean_vec array<double>")
        return self.spark.read.schema("pid bigint, mean_vec array<double>").parquet(*paths)

    def commit(self, entries: DataFrame, vectors: DataFrame) -> int | None:
        """Add the ids of ``entries`` (partition, seq, id, length) that aren't committed yet, with their rows of ``vectors`` (pid, position, vec).
        New ids open new shards behind those of their partition. Returns the version, or None if every id was there."""
        held, last = self.index(), max(self.versions(), default=0)
        attempt, staging = uuid.uuid4().hex, f"{self.folder}/staging/{uuid.uuid4().hex}"
        fresh = entries.join(held.select("id"), "id", "left_anti")
        behind = held.groupBy("partition").agg((F.max("shard") + 1).alias("first"))
        plan = shard_plan(fresh, self.capacity).join(behind, "partition", "left").withColumn("shard", F.col("shard") + F.coalesce("first", F.lit(0)))
        plan.select("partition", "id", "length", "shard", "start_offset", "end_offset", F.lit(attempt).alias("attempt")).write.parquet(staging)
        index = self.spark.read.schema(INDEX).parquet(staging)
        if index.isEmpty():
            return None
        self._write(attempt, index, vectors)
        publish(self.spark, staging, f"{self.folder}/index/version={last + 1}")
        return last + 1

    def _write(self, attempt: str, index: DataFrame, vectors: DataFrame) -> None:
        rows = vectors.select("pid", "position", "vec").join(index.select(F.col("id").alias("pid"), "partition", "shard", "start_offset"), "pid")
        laid = rows.repartition("partition", "shard").sortWithinPartitions("partition", "shard", "start_offset", "position")
        laid.select("pid", "position", "vec", "partition", "shard").write.partitionBy("partition", "shard").parquet(f"{self.folder}/vectors/attempt={attempt}")
        mean_vectors(rows).write.parquet(f"{self.folder}/means/attempt={attempt}")

    def read(self, wanted: DataFrame) -> DataFrame:
        """The vectors of the ids in ``wanted`` (id). The index tells their shards, and only the folders of these are listed and opened; the driver
        sees a name per folder, as in any listing. Ids without vectors fall away."""
        place = self.index().join(wanted.select("id").distinct(), "id", "left_semi")
        shards = place.select("attempt", "partition", "shard").distinct().collect()
        rows = self._parquet([f"attempt={r['attempt']}/partition={r['partition']}/shard={r['shard']}" for r in shards])
        return rows.join(place.select(F.col("id").alias("pid")), "pid", "left_semi")
