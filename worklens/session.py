"""Spark session settings and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("worklens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``. A session on one
    machine (tests, the bench) may name none and gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="worklens-ckpt-")
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder, so that lost executors do not replay its history."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Bytes of source files for which a shuffle gets one more partition.
SHARE = 1 << 20


def source_files(spark: SparkSession, source: str, tables: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """Names, sizes and change times of the files of ``tables`` in the folder ``source``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    seen = []
    for name in tables:
        path = jvm.org.apache.hadoop.fs.Path(f"{source}/{name}.parquet")
        files = path.getFileSystem(conf).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(seen)


def source_state(spark: SparkSession, source: str, tables: tuple[str, ...]) -> str:
    """Digest of the names, sizes and change times of the files of ``tables`` in the folder ``source``."""
    return hashlib.sha256(repr(source_files(spark, source, tables)).encode()).hexdigest()


def shares_of(spark: SparkSession, source: str, tables: tuple[str, ...] = ("events",)) -> int:
    """Shuffle partitions for work on ``tables``: as many as the session asks for, and more in proportion to the files, so that
    what one task holds does not grow with the input."""
    size = sum(length for _, length, _ in source_files(spark, source, tables))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))


#: Shuffled bytes that adaptive execution may join to one task inside ``sized_shuffles``.
TASK_BYTES = 16 << 20


@contextmanager
def sized_shuffles(spark: SparkSession, source: str, tables: tuple[str, ...] = ("events",)) -> Iterator[None]:
    """Shuffles of the jobs that run inside have ``shares_of`` partitions, of which adaptive execution joins up to ``TASK_BYTES``."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", size)}
    spark.conf.set("spark.sql.shuffle.partitions", shares_of(spark, source, tables))
    spark.conf.set(size, min(TASK_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[size])))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


_STORED: dict[tuple[str, str, str], tuple[str, str, StructType]] = {}


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], tables: tuple[str, ...] = ("events",)) -> DataFrame:
    """A derived table, written as Parquet in the shared folder and read back with column pruning.

    Interval signals, sessions and segments are stored tables of the data model. A stored table is used
    again only while the files of the ``tables`` it is built from are the same (name, size, change time);
    after any change it is built anew at another path. Plans made before keep reading the older table.
    It is built with shuffles in proportion to the source.
    """
    key = (spark.sparkContext.applicationId, source, name)
    state = source_state(spark, source, tables)
    if key not in _STORED or _STORED[key][0] != state:
        path = f"{shared_folder(spark)}/worklens-{key[0]}/{uuid.uuid4().hex[:8]}/{name}"
        with sized_shuffles(spark, source, tables):
            df = build()
            df.write.parquet(path)
        _STORED[key] = (state, path, df.schema)
    _, path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path)
