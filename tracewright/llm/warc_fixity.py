"""Merkle fixity audit of WARC records against a replica.

Every record is hashed as it would stand in a WARC file. Records lie in order of
their key (id, then URL), which gives each an offset; FANOUT neighbours form an
ordered offset range with a hash over theirs, FANOUT ranges the next, up to one
root. A replica's records take the places that the primary's manifest gives their
keys, and get a tree of the same shape. If the roots differ, only the children of
ranges that differ are compared, level by level, down to the records.

Only hashes and lengths shuffle, never pages. Rows with equal keys are one entry,
hashed as a multiset (number, lengths, sums of the hashes' words), so that a
repeated key is summed where its rows lie. No Python runs on rows.

Defined results: null html is empty; a null id or URL is a key of its own. An
entry is ``ok``, ``corrupt`` (another hash), ``missing`` (only in the primary) or
``extra`` (only in the replica, without offset). An empty primary has no tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import materialise

FANOUT = 16


def record(record_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    ).cast("binary")


def entries(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, n, length, hash) of every key: the hash of its records as a multiset."""
    raw = record(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("sha"))
    words = [F.sum(F.conv(F.substring("sha", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"w{k}") for k in range(4)]
    out = rows.groupBy("id", "url").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.min("sha").alias("record_sha256"), *words)
    return out.select("id", "url", "n", "length", "record_sha256", F.sha2(F.concat_ws("|", "n", "length", "w0", "w1", "w2", "w3").cast("binary"), 256).alias("hash"))


def manifest(pages: DataFrame, **columns: str) -> DataFrame:
    """The entries with their place in order (seq) and byte offset."""
    order = [F.col("id").asc_nulls_first(), F.col("url").asc_nulls_first()]
    # a row's place in its part is fixed once the parts are written
    parts = entries(pages, **columns).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(parts.select("*", F.monotonically_increasing_id().alias("at")), "warc-order").withColumn("part", F.shiftright("at", 33))
    # one row per part: their number is that of the shuffle's partitions
    sums = sorted((r["part"], r["n"], r["bytes"]) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).collect())
    if not sums:
        return parts.select("id", "url", "n", "length", "record_sha256", "hash", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("byte_offset"))
    base, seq, offset = [], 0, 0
    for part, n, size in sums:
        base.append((part, seq, offset))
        seq, offset = seq + n, offset + size
    base_df = pages.sparkSession.createDataFrame(base, "part long, seq0 long, offset0 long")
    from pyspark.sql import Window

    w = Window.partitionBy("part").orderBy("at")
    out = parts.join(F.broadcast(base_df), "part")
    return materialise(
        out.select(
            "id", "url", "n", "length", "record_sha256", "hash",
            (F.col("seq0") + F.row_number().over(w) - 1).cast("long").alias("seq"),
            (F.col("offset0") + F.sum("length").over(w) - F.col("length")).cast("long").alias("byte_offset"),
        ),
        "warc-manifest",
    )


def levels(leaves: DataFrame, n: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree over ``leaves`` (seq, hash, start, end): for each level (seq, hash, start, end), the leaves first, the root last."""
    out = [leaves.select("seq", "hash", "start", "end")]
    while n > 1:
        child = F.array_sort(F.collect_list(F.struct("seq", "hash")))  # fanout rows at most
        up = out[-1].groupBy(F.floor(F.col("seq") / fanout).cast("long").alias("up")).agg(F.sha2(F.array_join(F.transform(child, lambda x: x["hash"]), "").cast("binary"), 256).alias("hash"), F.min("start").alias("start"), F.max("end").alias("end"))
        out.append(materialise(up.withColumnRenamed("up", "seq"), "warc-level"))
        n = -(-n // fanout)
    return out


def differing(primary: list[DataFrame], replica: list[DataFrame], fanout: int = FANOUT) -> tuple[DataFrame, list[int]]:
    """The leaves (seq) that differ, and how many nodes were compared on each level, from the root down."""
    suspects, compared = None, []
    for a, b in zip(reversed(primary), reversed(replica), strict=True):
        b = b.select("seq", F.col("hash").alias("other"))
        if suspects is not None:
            # ranges that agree are not looked into
            a = a.withColumn("up", F.floor(F.col("seq") / fanout).cast("long")).join(suspects.withColumnRenamed("seq", "up"), "up", "left_semi").drop("up")
        pairs = materialise(a.join(b, "seq"), "warc-compare")
        compared.append(pairs.count())
        suspects = pairs.where("hash <> other").select("seq")
        if suspects.isEmpty():
            break
    return suspects, compared


def audit(pages: DataFrame, replica: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fanout: int = FANOUT) -> DataFrame:
    """(id, url, seq, byte_offset, length, record_sha256, range_sha256, status) of every entry of either side."""
    columns = {"id_col": id_col, "url_col": url_col, "html_col": html_col}
    own = manifest(pages, **columns)
    other = materialise(entries(replica, **columns), "warc-replica")
    same_key = own["id"].eqNullSafe(other["id"]) & own["url"].eqNullSafe(other["url"])
    n = own.count()
    extra = other.join(own, same_key, "left_anti").select("id", "url", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("byte_offset"), "length", "record_sha256", F.lit(None).cast("string").alias("range_sha256"), F.lit("extra").alias("status"))
    if not n:
        return extra
    placed = own.join(other.select(F.col("id").alias("id2"), F.col("url").alias("url2"), F.col("hash").alias("hash2")), F.col("id").eqNullSafe(F.col("id2")) & F.col("url").eqNullSafe(F.col("url2")), "left")
    placed = materialise(placed.select("seq", F.coalesce("hash2", F.lit("")).alias("hash"), F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.col("length")).alias("end")), "warc-placed")
    mine = levels(own.select("seq", "hash", F.col("byte_offset").alias("start"), (F.col("byte_offset") + F.col("length")).alias("end")), n, fanout)
    theirs = levels(placed, n, fanout)
    suspects, _ = differing(mine, theirs, fanout)
    status = suspects.join(placed.select("seq", "hash"), "seq").select("seq", F.when(F.col("hash") == "", "missing").otherwise("corrupt").alias("status"))
    ranges = mine[1] if len(mine) > 1 else mine[0].withColumn("seq", F.lit(0).cast("long"))
    out = own.withColumn("range", F.floor(F.col("seq") / fanout).cast("long")).join(ranges.select(F.col("seq").alias("range"), F.col("hash").alias("range_sha256")), "range").join(status, "seq", "left")
    return out.select("id", "url", "seq", "byte_offset", "length", "record_sha256", "range_sha256", F.coalesce("status", F.lit("ok")).alias("status")).unionByName(extra)
