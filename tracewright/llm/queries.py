"""The registered queries of the operators, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language, near_dedup, quality, sentencepiece_lattice, token_counts, toxicity, warc_fixity
from .decontamination import build_index, search
from .exact_dedup import classify_copies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classify(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), dw AS (
  SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT r, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_copies(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), k AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
"""

def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, and again after three edits at places that its id gives."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.char_length(F.coalesce("text", F.lit(""))) + 1
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size).cast("int")
    edit = lambda start, n, new: F.struct(start.alias("start"), (start + n).cast("int").alias("end"), F.lit(new).alias("new"))
    edits = F.array(edit(place(1), 7, ""), edit(place(2), 0, " an inserted phrase"), edit(place(3), 3, "x1\n"))
    return token_counts.count_tokens(docs.withColumn("edits", edits), edits_col="edits")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of all pages against a replica with planted faults: by the id's md5, some records end otherwise and some are gone."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    replica = pages.where(mark != "0b").withColumn("html", F.when(mark == "0a", F.concat("html", F.lit("?"))).otherwise(F.col("html")))
    return warc_fixity.audit(pages, replica).withColumnRenamed("id", "page_id")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
         || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages
), r AS (
  SELECT page_id, url, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS record_sha256 FROM p
), o AS (
  SELECT *, row_number() OVER (ORDER BY page_id, url) - 1 AS seq, CAST(sum(length) OVER (ORDER BY page_id, url) - length AS BIGINT) AS byte_offset,
         sha256('1|' || length || '|' || CAST(('0x' || substr(record_sha256, 1, 16)) AS UBIGINT) || '|' || CAST(('0x' || substr(record_sha256, 17, 16)) AS UBIGINT) || '|'
                || CAST(('0x' || substr(record_sha256, 33, 16)) AS UBIGINT) || '|' || CAST(('0x' || substr(record_sha256, 49, 16)) AS UBIGINT)) AS hash FROM r
), g AS (
  SELECT seq // 16 AS part, sha256(string_agg(hash, '' ORDER BY seq)) AS range_sha256 FROM o GROUP BY 1
)
SELECT page_id, url, seq, byte_offset, length, record_sha256, range_sha256,
       CASE substr(md5(CAST(page_id AS VARCHAR)), 1, 2) WHEN '0a' THEN 'corrupt' WHEN '0b' THEN 'missing' ELSE 'ok' END AS status
FROM o JOIN g ON o.seq // 16 = g.part
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.summarise(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_html": op5_html,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_near_dedup": op10_near_dedup,
}
ORACLE_SQL = {"op4_decontamination": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_warc": OP8_SQL}
