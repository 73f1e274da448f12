"""Readers and writers of the text formats, and a JDBC source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scratch import shared_dir


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/skein-{uuid.uuid4().hex[:12]}-{name}"


def read_edge_lists(spark: SparkSession, path: str, delim: str = "\t", header: bool = True) -> DataFrame:
    """layer, a, b of a folder of edge lists: the layer is the file's stem, or the folder ``layer=...`` that holds it.

    Lines that start with # are comments; rows without both ends are dropped; fields are trimmed.
    """
    read = spark.read.csv(path, schema="A string, B string", sep=delim, header=header, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, recursiveFileLookup=True)
    file = F.substring_index(F.input_file_name(), "/", -1)
    folder = F.substring_index(F.substring_index(F.input_file_name(), "/", -2), "/", 1)
    named = F.when(F.instr(folder, "layer=") > 0, F.expr("substring(folder, instr(folder, 'layer=') + 6)"))
    stem = F.regexp_extract("file", r"^(.+?)(?:\.tsv|\.csv|\.txt)?$", 1)  # from the start of the name: it is done for each row
    ends = read.where("A is not null and B is not null").select(file.alias("file"), folder.alias("folder"), F.col("A").alias("a"), F.col("B").alias("b"))
    return ends.select(F.coalesce(F.nullif(named, F.lit("")), stem).alias("layer"), "a", "b")


def write_edge_lists(edges: DataFrame, path: str) -> None:
    """One folder of tab-separated files a layer."""
    edges.select("layer", "A", "B").write.partitionBy("layer").option("sep", "\t").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, delim: str = "\t") -> None:
    df.write.option("sep", delim).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str, delim: str = "\t", header: bool = True) -> DataFrame:
    """A table of text with a fixed schema; fields are trimmed, as padded keys would lose their joins."""
    return spark.read.csv(path, schema=schema, sep=delim, header=header, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)


def read_memberships(spark: SparkSession, path: str, least: int = 1, most: int = 2000, sep: str = ";") -> DataFrame:
    """name, node of sets given as one joined string each, distinct, of a size within the bounds."""
    genes = F.array_distinct(F.filter(F.split("gene", sep), lambda g: F.trim(g) != ""))
    found = read_table(spark, path, "name string, gene string").select("name", genes.alias("genes")).where(F.size("genes").between(least, most))
    return found.select("name", F.explode("genes").alias("node"))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """name, url, genes of ragged tab-separated lines."""
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].alias("name"), part[1].alias("url"), F.slice(part, F.lit(3), F.greatest(F.size(part) - 2, F.lit(0))).alias("genes"))


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """file, gene, sample, value of expression matrices with two lines before their header: one file, or all below a folder.

    The header of each file is its third line, told by its place in the file's first block, and meets the file's lines in a join; files may have
    different samples. Lines whose number of columns isn't their header's are left out. Cells that are no number are null.
    """
    text = spark.read.text(path, recursiveFileLookup=True)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    first = lines.where("block = 0").groupBy("file").agg(F.min("i").alias("first"))
    placed = lines.join(first, "file").withColumn("part", F.split("value", "\t"))
    heads = placed.where("block = 0 and i = first + 2").select("file", F.slice("part", F.lit(3), F.greatest(F.size("part") - 2, F.lit(0))).alias("samples"))
    rows = placed.where("block > 0 or i > first + 2").join(heads, "file").where(F.size("part") == F.size("samples") + 2)
    cells = F.arrays_zip(F.col("samples").alias("sample"), F.slice("part", F.lit(3), F.size("samples")).alias("value"))
    return rows.select("file", F.col("part")[1].alias("gene"), F.explode(cells).alias("c")).select("file", "gene", F.col("c.sample").alias("sample"), F.col("c.value").try_cast("double").alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """category, label: one label a line; the category is the file's stem, or the folder ``category=...`` that holds it."""
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))  # names come as parts of a URL
    name = F.input_file_name()
    folder = plain(plain(F.regexp_extract(name, r"category=([^/]+)/[^/]+$", 1)))  # and a folder's name is escaped itself
    stem = plain(F.regexp_extract(name, r"([^/]+?)(?:\.[^./]+)?$", 1))
    lines = spark.read.text(path, recursiveFileLookup=True).where("trim(value) <> ''")
    return lines.select(F.when(folder != "", folder).otherwise(stem).alias("category"), F.trim("value").alias("label"))


def read_jdbc(spark: SparkSession, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table by the caller's own options (url, driver, ...); Spark pushes filters and columns down.

    partition: a numeric or time column, the bounds of its values and a number of reads; each read takes one stretch, values beyond the bounds go with the outer ones.
    """
    reader = spark.read.format("jdbc").option("dbtable", table).options(**options)
    if partition:
        column, low, high, reads = partition
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(reads))
    return reader.load()
