"""What the corpus operators share: words, keys, and tables written to the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words of letters, digits and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates runs of anything but white space.
SPACE = r"[\x09-\x0D\x20]+"
#: A side of a join is broadcast only up to so many rows and bytes; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII, lower-cased in ASCII only; null has none."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def tokens(text: Column) -> Column:
    """Runs of anything but white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables of one call, written once and read again: they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """For tables that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows and BROADCAST_BYTES; it must be a written table, so that counting is cheap."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of a written table: that of its files
    return size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table, with a broadcast hint if it fits, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions: for stages whose work is far more than their bytes tell, which would be dealt to a few tasks otherwise."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of keys (longs without null), in tables that end where a group ends, with the places at which groups begin and the end."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        new = np.ones(rows.num_rows + 1, bool)
        new[1:-1] = False
        for k in keys:
            v = rows.column(k).to_numpy()
            new[1:-1] |= v[1:] != v[:-1]
        return rows, np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        last = np.ones(batch.num_rows, bool)
        for v in columns:
            last &= v == v[-1]
        cut = int(np.argmax(last))  # the last group may go on
        if held and (cut or any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != v[0] for k, v in zip(keys, columns, strict=True))):
            held.append(batch.slice(0, cut))
            yield whole()
            held = []
        elif cut:
            held = [batch.slice(0, cut)]
            yield whole()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield whole()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
