"""What every source gives: interactions and their raw events, as two tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOME = "struct<label:string,at:bigint,lag_ms:bigint,source:string>"


@dataclass
class RawCorpus:
    """``interactions``: id, corpus, actor<operatorId,teamId,agentId>, started_at, outcome, facts, hints.
    ``events``: interaction_id, ord, at, features, slots, result, raw<file,path>."""

    interactions: DataFrame
    events: DataFrame
    meta: dict[str, str] = field(default_factory=dict)


def actor(operator: Column, team: Column | None = None, agent: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(operator.alias("operatorId"), (none if team is None else team).alias("teamId"), (none if agent is None else agent).alias("agentId"))


def outcome(label: Column, at: Column, lag_ms: Column, source: str) -> Column:
    """An outcome, null where the label is."""
    return F.when(label.isNotNull(), F.struct(label.alias("label"), at.cast("long").alias("at"), lag_ms.cast("long").alias("lag_ms"), F.lit(source).alias("source"))).cast(OUTCOME)
