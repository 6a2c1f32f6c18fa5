"""Column helpers shared by the operators that stay inside Spark SQL expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.session import ensure_checkpoint_dir

#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
_RUN = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space; an empty array where there are none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once; a plain reference inside a lambda would be computed per element."""
    return F.transform(F.array(value), body)[0]


def indices(size: Column) -> Column:
    """0 .. size - 1, empty for size 0 or less."""
    return F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def salted_join(rows: DataFrame, small: DataFrame, key: str, spread: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join many rows per key with one row per key; the rows of a key are dealt over ``salts`` tasks by ``spread``.

    ``small`` must hold one row per key and little data: it is repeated ``salts`` times.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


class Scratch:
    """Tables in the shared checkpoint folder that last until :meth:`clear`; compressed, unlike a checkpoint.

    Clear only when nothing that is still to be computed reads them.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, rows: DataFrame) -> DataFrame:
        """Rows written and read again."""
        path = f"{self.spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []
