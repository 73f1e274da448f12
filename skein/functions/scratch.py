"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one on a local master where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-skein-")
    return _OWN[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage before the files, so a lost executor costs a reread, and the planner
    knows its size, so small tables are broadcast by the session's own threshold.
    """
    path = f"{shared_dir(df.sparkSession)}/skein-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_key(spark: SparkSession, inputs: Sequence[str], parameters: object = None) -> str:
    """A key of the files below ``inputs`` (their paths, sizes and times, without reading them) and of ``parameters`` by their ``repr``."""
    digest = hashlib.sha256(repr(parameters).encode())
    for path in inputs:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        found = listed.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")))  # one row, whatever the order of the files
        digest.update(repr((path, *found.first())).encode())
    return digest.hexdigest()[:16]


def cached(spark: SparkSession, name: str, build: Callable[[], DataFrame], inputs: Sequence[str] = (), parameters: object = None) -> DataFrame:
    """The table ``name`` of the shared folder that was made from these ``inputs`` and ``parameters``; if there is none, what ``build`` gives is written there first.

    An input that has changed since, or another parameter, is another table. The table is written in a folder of its own, and a row that names this folder is
    published after it: a write that fails leaves nothing that is found, and of two at a time readers see one or the other whole.
    """
    published = f"{shared_dir(spark)}/skein-cache-{name}-{content_key(spark, inputs, parameters)}"
    try:
        at = spark.read.parquet(published).first()
    except AnalysisException:
        at = None
    if at is None:
        path = f"{published}-{uuid.uuid4().hex[:12]}"
        build().write.parquet(path)
        spark.createDataFrame([(path,)], "path string").write.mode("ignore").parquet(published)
        at = spark.read.parquet(published).first()
    return spark.read.parquet(at["path"])


def spread(df: DataFrame) -> DataFrame:
    """Deal a tiny input over all cores; an input with as many splits as cores stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
