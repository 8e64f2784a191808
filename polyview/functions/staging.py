"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` is read from the session.  Only where it is unset and Spark runs in this process (tests, a laptop) a
temporary folder is used instead; on a cluster that would scatter the tables, so there an unset folder is an
error.  A written table cuts lineage: a lost executor costs a re-read, not a recomputation from the source.

Results are lazy and read these tables, so they cannot be deleted with the call that wrote them.  ``drop_tables`` deletes
all of this process once results are written; a temporary folder goes with the process.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Names all tables of this process.
_RUN = uuid.uuid4().hex
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="polyview-shared-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return base.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/polyview-{_RUN}"


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def read_tables(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one, by a single scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[_paths[t] for t in tables])


def drop_table(table: DataFrame) -> None:
    """Delete one staged table, when nothing that is still to run reads it."""
    _delete(table.sparkSession, _paths.pop(table))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete every staged table of this process; results that have not been written or collected are lost with them."""
    _delete(spark, _folder(spark))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
