"""WARC records of pages and a Merkle audit of their replicas.

A record is a WARC/1.1 ``response`` block of one page. Records lie one after the other in files of at most
``FILE_RECORDS`` records; the manifest (file, ordinal, offset, length) is made when they are written. A replica
is audited against another along the manifest: a leaf is the SHA-256 of a record's bytes, a node the SHA-256 of
its children's digests in order, ``FANOUT`` children and so one range of offsets each, up to one root a file.
Roots are compared first; only children of nodes that differ are read at the next level down, to the records.

Cases. Null url or html: empty fields. Null page_id: a record like others. Repeated rows: records of their own;
very many of them are dealt to several files. A record that a replica lacks is ``missing``, one that only the other has ``extra``, one
whose bytes differ ``corrupt``. Very long pages: one record of any length. An empty table: no rows. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import materialise, need, ranked, read, spread

FILE_RECORDS = 1024
FANOUT = 8
#: Levels above the records, enough for FILE_RECORDS.
LEVELS = 4


def record_bytes(url: Column, html: Column, page_id: Column) -> Column:
    """One WARC response record as UTF-8 bytes."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, body, F.lit("\r\n\r\n")), "UTF-8")


def parse_record(record: Column) -> Column:
    """struct<page_id, url, html> of a record: the inverse of ``record_bytes``; null parts come back empty."""
    text = F.decode(record, "UTF-8")
    cut = F.instr(text, "\r\n\r\n")
    head, body = F.substr(text, F.lit(1), cut), F.substr(text, cut + 4)
    return F.struct(
        F.regexp_extract(head, r"Record-ID: <urn:page:(-?\d*)>", 1).alias("page_id"),
        F.regexp_extract(head, r"(?m)Target-URI: (.*?)\r", 1).alias("url"),
        F.substr(body, F.lit(1), F.length(body) - 4).alias("html"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    """Files, ordinals, offsets and digests of the records of ``pages`` (page_id, url, html), without their bytes.

    nth tells equal records apart. The number of files follows the number of pages and a record's file from its digest and, for
    each FILE_RECORDS / 4 equal ones, from nth; so the windows that lay out a file see about FILE_RECORDS rows of a few numbers whatever the table holds.
    """
    digests = materialise(record_digests(pages), "digests")
    files = max(1, -(-digests.count() // (FILE_RECORDS // 2)))
    placed = digests.withColumn("file", F.pmod(F.xxhash64("page_id", "digest", F.floor(F.col("nth") / (FILE_RECORDS // 4))), F.lit(files)))
    order = Window.partitionBy("file").orderBy("page_id", "digest", "nth")
    return placed.select(
        "file", (F.row_number().over(order) - 1).alias("ordinal"), "page_id", "nth", "length", "digest",
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")).alias("offset"),
    )


def record_digests(pages: DataFrame, damaged: Column | None = None) -> DataFrame:
    """page_id, length, digest, nth of the record of each row of ``pages``, and held: the digest of its bytes after ``damaged``."""
    base = need(pages, page_id=T.LongType(), url=T.StringType(), html=T.StringType())
    made = base.select("page_id", record_bytes(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    held = [] if damaged is None else [F.sha2(damaged, 256).alias("held")]
    found = materialise(
        made.select(F.monotonically_increasing_id().alias("uid"), "page_id", F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), *held), "records"
    )
    return ranked(found, ["page_id", "digest"], F.lit(0), "uid", "nth").drop("uid")


def tree_level(nodes: DataFrame) -> DataFrame:
    """The next level up. Nodes: file, ordinal, digest, offset, length."""
    children = F.array_sort(F.collect_list(F.struct("ordinal", "digest")))  # FANOUT at most
    return (
        nodes.groupBy("file", F.floor(F.col("ordinal") / FANOUT).alias("up"))
        .agg(F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"), F.min("offset").alias("offset"),
             F.max(F.col("offset") + F.col("length")).alias("end"))
        .select("file", F.col("up").alias("ordinal"), "digest", "offset", (F.col("end") - F.col("offset")).alias("length"))
    )


def merkle(leaves: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The levels of the trees, leaves first. leaves: file, ordinal, digest, offset, length."""
    out = [materialise(leaves.select("file", "ordinal", "digest", "offset", "length"), f"{name}-0")]
    for k in range(1, levels + 1):
        out.append(materialise(tree_level(out[-1]), f"{name}-{k}"))
    return out


def audit(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """file, ordinal, offset, length, status of the records that differ between two replicas' trees, and visited nodes by level.

    Each level joins only the children of the nodes that differ one level up.
    """
    top = len(one) - 1
    differ = None
    for k in range(top, -1, -1):
        a, b = one[k], other[k]
        if differ is not None:
            parent = F.floor(F.col("ordinal") / FANOUT).alias("ordinal")
            a, b = (
                x.withColumn("parent", parent).join(differ.select("file", F.col("ordinal").alias("parent")), ["file", "parent"], "left_semi").drop("parent")
                for x in (a, b)
            )
        pair = a.alias("a").join(b.alias("b"), ["file", "ordinal"], "full_outer")
        differ = pair.where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(
            "file", "ordinal", F.coalesce("a.offset", "b.offset").alias("offset"), F.coalesce("a.length", "b.length").alias("length"),
            F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("corrupt").alias("status"),
        )
        if k:
            differ = materialise(differ, f"differ-{k}")
            if not differ.limit(1).count():
                return differ.limit(0)
    return differ


def replica_digests(replica: DataFrame, laid_out: DataFrame) -> DataFrame:
    """Leaves of a replica along the manifest: its records' own digests at the manifest's places.

    replica: file, ordinal, record bytes. Records beyond the manifest keep their place and have no offset.
    """
    own = replica.select("file", "ordinal", F.sha2("record", 256).alias("digest"), F.length("record").cast("long").alias("own"))
    place = laid_out.select("file", "ordinal", "offset", "length")
    return own.join(place, ["file", "ordinal"], "left").select("file", "ordinal", "digest", "offset", F.coalesce("length", "own").alias("length"))


def _damaged(page_id: Column) -> Column:
    """The damage of the audited copy, by page: two in 256 records have a byte flipped, one in 256 is gone."""
    h = F.substring(F.md5(F.concat(F.lit("fixity:"), page_id.cast("string")).cast("binary")), 1, 2)
    return F.when(h == "00", "missing").when(h.isin("01", "02"), "corrupt")


def op8_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """Audit of a damaged copy of all pages' records against the manifest: every record with its place and state.

    The first replica's leaves are the manifest's digests. The second replica is the pages read and serialised
    again, damaged by the rule of ``_damaged``; the audit knows nothing of that rule and finds the records by
    descending the trees. All records come back: intact ones come from the manifest.
    """
    pages = spread(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    laid_out = materialise(manifest(pages), "manifest")
    hurt = _damaged(F.col("page_id"))
    bytes_ = F.when(hurt == "corrupt", F.concat(F.encode(F.lit("X"), "UTF-8"), F.substring("record", 2, 1 << 30))).otherwise(F.col("record"))
    copy = record_digests(pages, bytes_).where(hurt.isNull() | (hurt != "missing"))
    # the copy's records lie where the manifest put the record that they were written as
    same = F.struct(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", "nth").alias("same")
    leaves = copy.select(same, F.col("held").alias("digest")).join(laid_out.select(same, "file", "ordinal", "offset", "length"), "same").drop("same")
    found = audit(merkle(laid_out, "first"), merkle(leaves, "second"))
    return (
        laid_out.select("file", "ordinal", "page_id", "length", "offset").join(found.select("file", "ordinal", "status"), ["file", "ordinal"], "left")
        .select("page_id", "length", F.coalesce("status", F.lit("intact")).alias("status"))
    )


OP8_SQL = r"""
SELECT page_id,
  CAST(strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS BIGINT) AS length,
  CASE WHEN h = '00' THEN 'missing' WHEN h IN ('01', '02') THEN 'corrupt' ELSE 'intact' END AS status
FROM (SELECT *, substr(md5('fixity:' || CAST(page_id AS VARCHAR)), 1, 2) AS h FROM pages)
"""
