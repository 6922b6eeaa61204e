"""Shared folders and sizes, as the cluster gives them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only where that is unset and all runs on this machine, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = getattr(spark, "_palaver_root", None)
        if root is None:
            own = tempfile.mkdtemp(prefix="palaver-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = spark._palaver_root = f"file://{own}"
    return f"{root.rstrip('/')}/palaver-{uuid.uuid4().hex}"


def materialise(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read again: later work neither recomputes nor depends on executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palaver_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``materialise`` wrote for these tables, which nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._palaver_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores before it until no column has it, whatever the case of its letters."""
    used, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def filter_rows(docs: DataFrame, column: str, judge: Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """The rows of docs, all columns, that ``judge`` keeps: of an Arrow column it gives (from, to, which rows of these stay)."""
    at = docs.columns.index(column)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots cannot go through mapInArrow

    def run(batches):
        for batch in batches:
            for i, j, kept in judge(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(kept, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


#: A key is hot if it has more than one in this many of all rows, so there are fewer hot keys than that.
HOT = 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: Column, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row for each key) where a few keys may hold most of the rows.

    ``count`` is, in facts, the number of rows with the key, of ``total``.  Hot
    keys are under ``HOT``, so their facts are broadcast and their rows stay
    where they are; the others are joined by a shuffle.
    """
    is_hot = count * HOT > F.lit(total)
    hot = facts.where(is_hot)
    if hot.isEmpty():
        return rows.join(facts.hint("merge"), key, how)
    of_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~is_hot).hint("merge"), key, how)
    return of_hot.unionByName(others)


def input_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def stored_size(df: DataFrame) -> int:
    """Bytes that the plan is estimated to read; from the partitions where there is no estimate that can be used."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size <= 1 << 50 else input_partitions(df) * (64 << 20)


def groups_for(df: DataFrame, stored_bytes: int) -> int:
    """How many groups of about so many stored bytes the input makes."""
    return max(1, -(-stored_size(df) // stored_bytes))
