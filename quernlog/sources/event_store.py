"""Stored events whose changes become visible at once.

Data lies in folders by generation, case and bucket of the source, and is never written over.  A commit is one small
table that names the generations valid for each bucket; readers use the newest whole commit, so they never meet half of
a change, and a change that fails before its commit leaves no trace in what is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.sources.records import replaced, with_bucket

_PLACE = ["generation", "case_id", "source_bucket"]
_VALID = "case_id string, source_bucket int, generation bigint"


class EventStore:
    """Events under ``path``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _numbers(self) -> list[int]:
        """Numbers of the commits that were written whole."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def valid(self) -> DataFrame:
        """(case_id, source_bucket, generation) of the newest commit: as many rows as buckets and appends to them."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], _VALID)
        return self.spark.read.schema(_VALID).parquet(f"{self.path}/commits/{numbers[-1]}")

    def read(self) -> DataFrame:
        """The events of the newest commit; folders that it doesn't name are pruned when the join starts."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"no commit under {self.path}")
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(self._schema()).parquet(f"{self.path}/data")
        return rows.join(self.valid(), _PLACE, "left_semi").drop("generation", "source_bucket")

    def _schema(self) -> str:
        # without inference a case named like a number keeps its text
        first = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data").schema
        kinds = {"case_id": "string", "source_bucket": "int", "generation": "bigint"}
        return ", ".join(f"`{f.name}` {kinds.get(f.name) or f.dataType.simpleString()}" for f in first)

    def _write(self, events: DataFrame) -> int:
        """Write a generation of its own; one left by a failed attempt is written over."""
        generation = max(self._numbers(), default=0) + 1
        piece = F.floor(F.col("line_no") / 4_000_000)
        (
            with_bucket(events).repartition("case_id", "source_bucket", piece)
            .sortWithinPartitions("case_id", "source_bucket", "source_id", "line_no")
            .write.mode("overwrite").partitionBy("case_id", "source_bucket").parquet(f"{self.path}/data/generation={generation}")
        )
        return generation

    def _commit(self, valid: DataFrame, generation: int) -> None:
        valid.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{generation}")

    def append(self, events: DataFrame) -> None:
        """Add events; other rows stay as they are."""
        generation = self._write(events)
        added = with_bucket(events).select("case_id", "source_bucket").distinct().withColumn("generation", F.lit(generation).cast("bigint"))
        self._commit(self.valid().unionByName(added), generation)

    def replace_sources(self, fresh: DataFrame) -> None:
        """Renew the sources in ``fresh``: their buckets get a new generation, all others keep theirs."""
        before = self.valid()
        touched = with_bucket(fresh).select("case_id", "source_bucket").distinct()
        generation = max(self._numbers(), default=0) + 1
        if before.isEmpty():
            rows = fresh
        else:
            old = with_bucket(self.read()).join(touched, ["case_id", "source_bucket"], "left_semi").drop("source_bucket")
            rows = replaced(old, fresh)
        self._write(rows)
        renewed = touched.withColumn("generation", F.lit(generation).cast("bigint"))
        self._commit(before.join(touched, ["case_id", "source_bucket"], "left_anti").unionByName(renewed), generation)
