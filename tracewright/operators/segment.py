"""Segmenters: registered functions that add an ``episode`` to events, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episode_id(local: Column) -> Column:
    return F.concat("interaction_id", F.lit("#"), local.cast("string"))


def null_segmenter(events: DataFrame) -> DataFrame:
    """One episode per interaction."""
    return events.withColumn("episode", episode_id(F.lit(0)))


def intent_segmenter(events: DataFrame) -> DataFrame:
    """A known intent opens an episode; the records up to the next one belong to it.

    Intents with nothing between them share the episode that follows; a last intent
    joins the episode before it; what precedes the first intent is an episode.
    """
    w = Window.partitionBy("interaction_id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = events.withColumn("_edge", (F.col("kind") == "customer_intent") & (F.col("type") != "unknown"))
    out = out.withColumn("_start", (~F.col("_edge") & F.coalesce(F.lag("_edge").over(w), F.lit(True))).cast("int"))
    out = out.withColumn("_no", F.when(~F.col("_edge"), F.sum("_start").over(so_far) - 1))
    local = F.coalesce("_no", F.first("_no", ignorenulls=True).over(onward), F.max("_no").over(whole), F.lit(0))
    return out.withColumn("episode", episode_id(local)).drop("_edge", "_start", "_no")


SEGMENTERS = {"null": null_segmenter, "intent": intent_segmenter}


def register_segmenter(name: str, segmenter) -> None:
    SEGMENTERS[name] = segmenter


def segment(events: DataFrame, name: str = "intent") -> DataFrame:
    if name not in SEGMENTERS:
        raise KeyError(f"no segmenter {name!r}; there are {', '.join(sorted(SEGMENTERS))}")
    return SEGMENTERS[name](events)
