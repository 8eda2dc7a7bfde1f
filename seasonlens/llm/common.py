"""Helpers the operators of this package share.

Conventions every operator keeps:

* it selects only the columns it needs, so extra columns of any name never
  clash with its own;
* a NULL text is the empty text, a NULL id is kept as NULL;
* Python runs per Arrow batch inside Spark tasks and hands back rows in
  small batches, so a task holds one input batch and a few output rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seasonlens.session import scratch_path

# Rows handed back to the JVM at a time.
OUT_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with NULL text as the empty text; columns are named ``id_col`` and ``text``."""
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def map_texts(df: DataFrame, id_col: str, fields: list[T.StructField],
              make: Callable[[], Callable[[str], Iterable[tuple]]]) -> DataFrame:
    """Rows ``(id, *fields)`` for each text of ``texts()``.

    ``make`` runs once in each task and returns the function that turns a
    text into any number of tuples (one value a field).
    """
    id_field = df.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            ids = batch.column(0)
            body = batch.column(1)
            at: list[int] = []
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                for row in each(body[i].as_py()):
                    at.append(i)
                    rows.append(row)
                if len(rows) >= OUT_ROWS:
                    yield _batch(ids, at, rows, arrow)
                    at, rows = [], []
            if rows:
                yield _batch(ids, at, rows, arrow)

    return df.mapInArrow(run, schema)


def _batch(ids: pa.Array, at: list[int], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [ids.take(pa.array(at, pa.int32()))]
    columns += [pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def fresh(prefix: str) -> str:
    """A column name that no input column has."""
    return f"__{prefix}_{uuid.uuid4().hex[:10]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and read back.

    Cuts the lineage: what follows re-reads the files, also after an executor is lost.  ``unstage`` removes the copy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.staged_path = path
    return copy


def unstage(*copies: DataFrame) -> None:
    """Removes staged copies that nothing reads any more."""
    for copy in copies:
        spark = copy.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(copy.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
