"""Annotations: what predicates said at places of a corpus, as sorted JSON lines with a digest."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SCHEMA = "i string, e string, seq int, pred string, p double, fact string, value boolean, pv int, redaction string, sha string, at bigint"
ORDER = ["i", "e", "seq", "pred"]


def path_of(folder: str, corpus: str, version: int, partial: bool = False) -> Path:
    return Path(folder) / f"{corpus}@{version}{'.partial' if partial else ''}.jsonl"


def sha16(text) -> object:
    """Sixteen hex digits of a text: what an annotation says about the text that was read."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def as_lines(rows: DataFrame) -> DataFrame:
    """(line) in order; a withheld observation is a line with a null value."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return rows.select(*names).orderBy(*ORDER).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))


def write(rows: DataFrame, folder: str, corpus: str, version: int, partial: bool = False) -> tuple[Path, str]:
    """The file and its digest. Lines are sorted by the cluster and streamed into a new file that takes its name when it is whole."""
    target = path_of(folder, corpus, version, partial)
    target.parent.mkdir(parents=True, exist_ok=True)
    digest = hashlib.sha256()
    with tempfile.NamedTemporaryFile("wb", dir=target.parent, delete=False) as f:
        for r in as_lines(rows).toLocalIterator():
            line = r["line"].encode() + b"\n"
            digest.update(line)
            f.write(line)
    os.replace(f.name, target)
    return target, digest.hexdigest()[:16]


def read(spark: SparkSession, folder: str, corpus: str, version: int) -> tuple[DataFrame, bool] | None:
    """The annotations, and whether they are partial: the whole file if there is one, else the partial one, else nothing."""
    for partial in (False, True):
        if (at := path_of(folder, corpus, version, partial)).exists():
            return spark.read.schema(SCHEMA).json(str(at)), partial
    return None


def observed_facts(rows: DataFrame) -> DataFrame:
    """(i, e, seq, facts): the facts of every place; what is withheld is no fact."""
    said = F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("fact", S.boolean(F.col("value").cast("string"))))))
    return rows.groupBy("i", "e", "seq").agg(said.alias("facts"))


def with_observed(events: DataFrame, rows: DataFrame) -> DataFrame:
    """``events`` with a column ``observed``: the facts at their place, an empty map where nothing was observed."""
    facts = observed_facts(rows).select(F.col("i").alias("interaction_id"), F.col("e").alias("episode"), "seq", F.col("facts").alias("observed"))
    out = events.join(facts, ["interaction_id", "episode", "seq"], "left")
    return out.withColumn("observed", F.coalesce("observed", F.create_map().cast(S.SCALARS)))


def missing_facts(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """(i, e, seq, missing): which of the wanted facts no annotation gives at a place."""
    return observed_facts(rows).select("i", "e", "seq", F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), F.map_keys("facts"))).alias("missing"))
