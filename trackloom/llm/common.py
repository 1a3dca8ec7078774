"""What the operators of this folder share: tables, the shared folder, lineage cuts, fold rules."""

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals and their small letters; the contracts lower only these.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local sessions only) a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="trackloom-")
        sc.setCheckpointDir(found)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives the memory that it no longer uses back to the system: workers outlive their
    tasks, and what one stage has freed would stay theirs during the next ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return task


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there from now on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, name: str) -> str:
    """name, or with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of df, also those with dots in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


#: Ids (8 bytes each) are broadcast up to this many; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small_or_not(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if they are few enough; a row holds an id and a flag at most."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, by the file system that it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same, and much faster, where no other letter has a lower form."""
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(rest == F.lower(rest), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus
