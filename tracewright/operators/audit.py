"""Audit figures over typed, segmented events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.alphabet import Alphabet


def type_figures(events: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Per type: kind of its first occurrence, count, interactions, consequence. What is not declared counts as irreversible."""
    known = events.sparkSession.createDataFrame([(t.id, t.consequence or "none", bool(t.recommendable)) for t in alphabet.types] or [("", "", False)], "type string, consequence string, recommendable boolean")
    out = events.groupBy("type").agg(F.min_by("kind", F.struct("at", "interaction_id", "seq")).alias("kind"), F.count(F.lit(1)).alias("n"), F.countDistinct("interaction_id").alias("interactions"))
    out = out.join(F.broadcast(known), "type", "left")
    return out.select("type", "kind", "n", "interactions", F.coalesce("consequence", F.lit("irreversible")).alias("consequence"), F.coalesce("recommendable", F.lit(False)).alias("recommendable"))


def kinds(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def unknown_rate(events: DataFrame, gate: float = 0.2) -> DataFrame:
    n, u = F.count(F.lit(1)), F.coalesce(F.sum((F.col("type") == "unknown").cast("long")), F.lit(0))
    rate = F.when(n == 0, 0.0).otherwise(u / n)
    return events.agg(n.alias("events"), u.alias("unknown"), rate.alias("rate"), (rate > gate).alias("refused"))


def episode_stats(events: DataFrame, alphabet: Alphabet) -> DataFrame:
    ids = alphabet.consequential()
    per = events.groupBy("interaction_id", "episode").agg(F.max(F.col("type").isin(ids) if ids else F.lit(False)).alias("some"))
    out = per.agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("interaction_id").alias("interactions"), F.sum((~F.col("some")).cast("long")).alias("idle"))
    return out.select("episodes", (F.col("episodes") / F.col("interactions")).alias("per_interaction"), (F.col("idle") / F.col("episodes")).alias("idle_share"))


def subject_floor(events: DataFrame, alphabet: Alphabet, least: int = 5) -> DataFrame:
    rows = events.where(F.col("type").isin(alphabet.consequential()))
    out = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("episode").alias("episodes"))
    return out.withColumn("above_floor", F.col("n") >= least)


def figure_events(events: DataFrame, figure: str) -> DataFrame:
    """The events behind a figure: unknown, type:<id>, subject:<id>, kind:<kind> or interaction:<id>."""
    what, _, value = figure.partition(":")
    test = {
        "unknown": F.col("type") == "unknown",
        "type": F.col("type") == value,
        "subject": F.col("type") == value,
        "kind": F.col("kind") == value,
        "interaction": F.col("interaction_id") == value,
    }
    if what not in test:
        raise ValueError(f"no figure {figure!r}")
    return events.where(test[what])
