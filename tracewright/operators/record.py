"""The canonical record: what breaks its rules, and the levels of an actor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.alphabet import KINDS

# The closed sets of the record.
RESULTS = ("ok", "failed", "refused")
ORIGINS = ("in_band", "external")
TYPES = ("s", "n", "b", "z")


class RecordError(ValueError):
    """A record that breaks a rule; the message names the place."""


def _first(*rules: tuple[Column, str, str]) -> Column:
    """The first broken rule as struct<place, message>; null if all hold. A rule is (holds, place, message)."""
    out = F.lit(None).cast("struct<place:string,message:string>")
    for holds, place, message in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(place).alias("place"), F.lit(message).alias("message"))).otherwise(out)
    return out


def _filled(c: str) -> Column:
    return F.length(c) > 0


def _scalars(c: str) -> Column:
    return F.forall(F.map_values(c), lambda v: F.coalesce(v["t"].isin(*TYPES), F.lit(False)))


def event_faults(events: DataFrame) -> DataFrame:
    """(interaction_id, seq, place, message): the first broken rule of every event that has one.

    That numbers run from 0 without gaps is told from a group's least, greatest and
    different ones, so nothing is sorted.
    """
    own = _first(
        (F.col("seq") >= 0, "seq", "must be an integer of 0 or more"),
        (F.col("at").isNotNull() & ~F.isnan(F.col("at").cast("double")), "at", "must be a finite number"),
        (_filled("episode"), "episode", "must not be empty"),
        (F.col("kind").isin(*KINDS), "kind", f"must be one of {', '.join(KINDS)}"),
        (_filled("type"), "type", "must not be empty"),
        (F.col("slots").isNotNull() & _scalars("slots"), "slots", "must be scalars"),
        (F.col("result").isNull() | F.col("result").isin(*RESULTS), "result", f"must be one of {', '.join(RESULTS)}"),
        (F.length("raw.file") > 0, "raw.file", "must not be empty"),
        (F.col("raw.path").isNotNull(), "raw.path", "must be a text"),
    )
    each = events.select("interaction_id", "seq", own.alias("fault")).where("fault is not null").select("interaction_id", "seq", "fault.place", "fault.message")
    runs = events.groupBy("interaction_id").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("different"))
    broken = runs.where("low != 0 or high != n - 1 or different != n")
    return each.unionByName(broken.select("interaction_id", F.lit(None).cast("int").alias("seq"), F.lit("events").alias("place"), F.lit("seq must equal the event's index").alias("message")))


def interaction_faults(interactions: DataFrame) -> DataFrame:
    """(id, place, message): the first broken rule of every interaction that has one."""
    given = F.col("outcome").isNotNull()
    own = _first(
        (_filled("id"), "id", "must not be empty"),
        (_filled("corpus"), "corpus", "must not be empty"),
        (F.length("actor.operatorId") > 0, "actor.operatorId", "must not be empty"),
        (F.col("started_at").isNotNull(), "started_at", "must be a finite number"),
        (~given | (F.length("outcome.label") > 0), "outcome.label", "must not be empty"),
        (~given | F.col("outcome.at").isNotNull(), "outcome.at", "must be a finite number"),
        (~given | F.col("outcome.lag_ms").isNotNull(), "outcome.lag_ms", "must be a finite number"),
        (~given | F.col("outcome.source").isin(*ORIGINS), "outcome.source", f"must be one of {', '.join(ORIGINS)}"),
        (F.col("facts").isNull() | _scalars("facts"), "facts", "must be scalars"),
    )
    return interactions.select("id", own.alias("fault")).where("fault is not null").select("id", "fault.place", "fault.message")


def require_valid(interactions: DataFrame, events: DataFrame) -> None:
    """Raises RecordError with one broken rule, if there is any."""
    if bad := interaction_faults(interactions).first():
        raise RecordError(f"{bad['id']}.{bad['place']}: {bad['message']}")
    if bad := event_faults(events).first():
        raise RecordError(f"{bad['interaction_id']}.events[{bad['seq']}].{bad['place']}: {bad['message']}")


def actor_levels(actor: Column) -> Column:
    """The levels that an actor can be judged at, the most specific first."""
    level = lambda name, c: F.when(F.length(c) > 0, F.struct(F.lit(name).alias("level"), c.alias("id")))
    return F.filter(F.array(level("agent", actor["agentId"]), level("team", actor["teamId"]), level("operator", actor["operatorId"])), lambda x: x.isNotNull())
