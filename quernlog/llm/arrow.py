"""Running numpy or pure Python code over texts in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows are taken in slices of about so many bytes of text, whatever the size of Spark's batches.
SLICE = 400_000


def slices(batch: pa.RecordBatch, texts: str = "text") -> Iterator[pa.RecordBatch]:
    column = batch.column(texts)
    start, held = 0, 0
    for i in range(batch.num_rows):
        held += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if held >= SLICE:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(
    docs: DataFrame, keep: list[str], schema: str, start: Callable[[], Callable[..., dict[str, list | object]]], also: str | None = None
) -> DataFrame:
    """Columns ``keep`` as they are, and the columns of ``schema`` that the function from ``start`` gives for the texts.

    ``start`` runs once per task.  Null texts come as empty strings.  The function also gets the numbers of the column
    ``also``, if there is one, as an array.
    """
    given = [] if also is None else [F.col(also).alias("_also")]
    kept = docs.select(*keep, *given, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = StructType([*kept.drop("text", "_also").schema.fields, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = start()
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                made = run(texts) if also is None else run(texts, part.column("_also").to_numpy())
                columns = [part.column(f.name) if f.name in keep else pa.array(made[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(work, out)
