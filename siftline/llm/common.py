"""Shared plumbing of the corpus operators: shared-folder tables, row keys, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parquet's writers look at the size of a page and of a row group only after 100 rows, and its readers decode a group of up to
#: 4,096 rows at once: with rows of megabytes both hold a whole file. Such tables, by what they are called, are cut into small groups from the first row on.
PACKED_TABLES = {"index", "windows", "shards", "impacts"}
LONG_ROWS = {"parquet.block.size": 8 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Stands for a null id in keys and orders: nulls come last.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a folder of its own,
    as in tests; a cluster has no folder that could be guessed, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/siftline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the application's own folder, which goes when the application's JVM ends."""
    own = f"{shared_dir(spark)}/siftline/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing. Of
    ``PACKED_TABLES`` few rows are held at once."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.options(compression="zstd", **(LONG_ROWS if what in PACKED_TABLES else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/siftline/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done: Spark deletes them once the driver's collector finds their plans dead,
    which by itself it looks for every half hour."""
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_key(id_col: str = "doc_id") -> Column:
    """Long key of a document id, nulls last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


#: A document's identity: its id (nulls last) and 128 bits over text and whether the id is null. Rows that repeat both are one
#: document; different texts that carry one id, or none, never are.
IDENTITY = ("doc", "m1", "m2")


def identity(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The columns ``IDENTITY`` of a row."""
    none, text = F.col(id_col).isNull(), F.col(text_col)
    return [doc_key(id_col).alias("doc"), F.xxhash64(none, text).alias("m1"), F.xxhash64(F.lit(0x5DEECE66D), none, text).alias("m2")]


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, *but: str) -> Column:
    """All columns but those, as the struct ``row``: no name of theirs can clash with an operator's own."""
    return F.struct(*[quoted(c).alias(c) for c in df.columns if c not in but]).alias("row")


def row_schema(own: DataFrame, rest: str) -> StructType:
    """The column ``row`` of ``own``, whatever its fields are called, and the columns of a DDL string."""
    return StructType([own.schema["row"], *StructType.fromDDL(rest).fields])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice stay near ``most_bytes``; a single longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if len(sizes) > begin:
            yield batch.slice(begin)


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
