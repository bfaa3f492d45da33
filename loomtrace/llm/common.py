"""What the operators share: input columns, saved tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.workspace import shared_folder

# ASCII white space, x20 and x09-x0D, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one table in the shared folder, removed when the driver's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and scan it: a lost executor costs a re-read."""
    folder = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._loomtrace_folder = folder
    return table


def drop(*tables: DataFrame) -> None:
    """Delete ``saved`` tables that nothing reads any more."""
    for one in tables:
        remove(one.sparkSession, one._loomtrace_folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema) -> DataFrame:
    """Run ``work`` on the columns of each Arrow batch, as lists; it returns columns as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = work(part.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in arrow], schema=arrow
                )

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_struct(df.sparkSession, schema))
    return df.mapInArrow(run, schema)


def located(docs: DataFrame, file: str = "_file", row: str = "_row") -> DataFrame:
    """``docs``, read from files, with the place of each row; ``file`` and ``row`` name no column of it."""
    return docs.withColumns({file: F.col("_metadata.file_path"), row: F.col("_metadata.row_index")})


def is_scan(docs: DataFrame) -> bool:
    """Whether the rows of ``docs`` know their places; those of a join or union of files do not."""
    try:
        return bool(located(docs.select()).columns)
    except AnalysisException:
        return False


def _struct(spark: SparkSession, schema):
    from pyspark.sql.types import StructType

    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a part holds about ``most_bytes``, or one row."""
    rows = batch.num_rows
    step = max(1, int(rows * most_bytes / max(most_bytes, batch.nbytes)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)
