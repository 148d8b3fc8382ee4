"""Operator 2: Merkle fixity audit of WARC replicas.

A record's leaf is the SHA-256 of its place and payload digest.  Records are
grouped by ordered offset ranges of their archive (``LEAF_BYTES`` wide): since
offsets in an archive are distinct and records have a header, a range holds a
bounded number of records, so no group is unbounded whatever the archive's size.
Ranges are grouped ``FANOUT`` at a time into nodes up to one root per archive.
Two replicas are compared root by root; only children of mismatching nodes are
read on the next level down, until the records that differ are found.

``warc_records`` lays pages out as WARC ``resource`` records in archives.

Defined results: a null payload is empty, a null URL the empty text; repeated rows
are records of their own at different offsets; an empty table has no archives and
no findings; further columns are ignored.  A record is reported as ``missing``
(in the first replica only), ``extra`` (in the second only) or ``payload`` (same
place, another digest); a root that exists on one side only mismatches.  A very long
page is one record, alone in its range, and is hashed whole.  Rows with one
identifier are ordered by their input partition and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.llm.common import cut, table

LEAF_BYTES = 1 << 18
FANOUT = 16
ARCHIVE_RECORDS = 512


def warc_header(uri: Column, length: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                 archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """``archive, offset, length, record_id, payload``: the pages as WARC records.

    Archives are filled by a hash of identifier and payload digest, and rows that
    are copies of one another are dealt out by their input partition and place,
    so no archive grows with a repeated page."""
    payload = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "utf-8")
    uri = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("record_id"), uri.alias("uri"), payload.alias("payload"))
    archives = max(1, -(-pages.count() // archive_records))
    head = F.encode(warc_header(F.col("uri"), F.length("payload")), "utf-8")
    laid = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .withColumn("archive", F.pmod(F.xxhash64("record_id", "row"), F.lit(archives)))
        .withColumn("record", F.concat(head, F.col("payload"), F.encode(F.lit("\r\n\r\n"), "utf-8")))
        .withColumn("length", F.length("record").cast("bigint"))
    )
    before = W.partitionBy("archive").orderBy(F.col("record_id").asc_nulls_first(), "row").rowsBetween(W.unboundedPreceding, -1)
    return laid.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint"))).select(
        "archive", "offset", "length", "record_id", F.col("record").alias("payload"))


def leaves(replica: DataFrame) -> DataFrame:
    """``archive, offset, record_id, digest`` of every record."""
    return replica.select(
        "archive", "offset", "record_id",
        F.sha2(F.concat_ws(":", F.col("archive"), F.col("offset"), F.length("payload"), F.sha2(F.coalesce("payload", F.lit(b"")), 256)), 256).alias("digest"))


def _level(nodes: DataFrame, group: Column) -> DataFrame:
    """One level of both trees: the digest of each group's digests in order."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "digest")))
    return nodes.groupBy("side", "archive", group.alias("node")).agg(
        F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), ""), 256).alias("digest"))


def levels_above(last_offset: int, leaf_bytes: int, fanout: int) -> int:
    """Levels from the leaf ranges to one root for an archive of this length."""
    levels, nodes = 1, last_offset // leaf_bytes + 1
    while nodes > fanout:
        levels, nodes = levels + 1, -(-nodes // fanout)
    return levels


def tree(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaf ranges (0) to the roots, as ``side, archive, node,
    digest``; each is written once."""
    last = records.agg(F.max("offset")).first()[0] or 0
    levels = levels_above(last, leaf_bytes, fanout)
    out = [cut(_level(records.withColumn("at", F.col("offset")), F.floor(F.col("offset") / leaf_bytes).cast("bigint")), "merkle-level")]
    for level in range(levels):
        below = out[-1].select("side", "archive", F.col("node").alias("at"), "digest")
        up = F.lit(0).cast("bigint") if level == levels - 1 else F.floor(F.col("at") / fanout).cast("bigint")
        out.append(cut(_level(below, up), "merkle-level"))
    return out


def _sides(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' digests of each key, null where a side lacks it."""
    one = lambda i: F.max(F.when(F.col("side") == i, F.col("digest")))
    return nodes.groupBy(*keys).agg(one(0).alias("first_digest"), one(1).alias("second_digest"))


def _differ(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return _sides(nodes, keys).where(~F.col("first_digest").eqNullSafe(F.col("second_digest")))


def audit(first: DataFrame, second: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> dict[str, DataFrame]:
    """``roots``: ``archive, first_digest, second_digest, intact``; ``findings``:
    ``archive, offset, record_id, problem``.

    Both replicas' leaf digests are written once, in one table with a side column,
    so a comparison is one aggregation.  Each level's comparison reads only the
    children of the nodes that mismatched above, and ends where none does."""
    both = leaves(first).withColumn("side", F.lit(0)).unionByName(leaves(second).withColumn("side", F.lit(1)))
    records = cut(both, "merkle-leaves")
    levels = tree(records, leaf_bytes, fanout)
    roots = _sides(levels[-1], ["archive"]).withColumn("intact", F.col("first_digest").eqNullSafe(F.col("second_digest")))
    bad = cut(_differ(levels[-1], ["archive", "node"]).select("archive", "node"), "merkle-bad")
    for level in range(len(levels) - 2, -1, -1):
        up = F.lit(0).cast("bigint") if level == len(levels) - 2 else F.floor(F.col("node") / fanout).cast("bigint")
        under = levels[level].withColumn("up", up).join(bad.withColumnRenamed("node", "up"), ["archive", "up"], "left_semi")
        bad = cut(_differ(under, ["archive", "node"]).select("archive", "node"), "merkle-bad")
    ranged = records.withColumn("node", F.floor(F.col("offset") / leaf_bytes).cast("bigint")).join(bad, ["archive", "node"], "left_semi")
    one = lambda i: F.max(F.when(F.col("side") == i, F.col("digest")))
    found = ranged.groupBy("archive", "offset").agg(one(0).alias("da"), one(1).alias("db"), F.first("record_id", ignorenulls=True).alias("record_id"))
    problem = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("payload")
    findings = found.where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "offset", "record_id", problem.alias("problem"))
    return {"roots": roots, "findings": findings}


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults planted by a checksum of the record's identifier."""
    check = F.crc32(F.coalesce(F.col("record_id").cast("string"), F.lit("")))
    flipped = F.concat(F.encode(F.lit("w"), "utf-8"), F.expr("substring(payload, 2)"))
    return records.where(check % 97 != 5).withColumn("payload", F.when(check % 89 == 3, flipped).otherwise(F.col("payload")))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with planted faults:
    one row per page with its state."""
    records = cut(warc_records(table(spark, sf_dir, "pages")), "warc")
    found = audit(records, damaged(records))["findings"]
    return (
        records.select("archive", "offset", "record_id", "length")
        .join(found.select("archive", "offset", "problem"), ["archive", "offset"], "left")
        .select(F.col("record_id").alias("page_id"), F.col("length").alias("record_bytes"), F.coalesce("problem", F.lit("intact")).alias("state"))
    )


_HEAD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '"
#: DuckDB has no CRC-32, so it is folded from a bit rule over the bytes.
ORACLE_OP2 = f"""
WITH RECURSIVE t(n, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS v FROM t WHERE k = 8),
p AS (SELECT page_id, octet_length(encode({_HEAD})) AS head, octet_length(encode(coalesce(html, ''))) AS body,
  coalesce(CAST(page_id AS VARCHAR), '') AS s FROM pages),
q AS (SELECT page_id, head + length(CAST(body AS VARCHAR)) + 8 + body AS record_bytes,
  xor(list_reduce(list_transform(string_split(s, ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
    lambda a, b: xor(a >> 8, v[CAST(xor(a, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM p, crc)
SELECT page_id, CAST(record_bytes AS BIGINT) AS record_bytes,
  CASE WHEN crc % 97 = 5 THEN 'missing' WHEN crc % 89 = 3 THEN 'payload' ELSE 'intact' END AS state
FROM q
"""

QUERIES = {"op2_warc_fixity": op2_warc_fixity}
ORACLE = {"op2_warc_fixity": ORACLE_OP2}
