"""A corpus: a source's interactions, typed, segmented and checked."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.record import require_valid
from ..operators.segment import segment
from ..sources import RawCorpus, source_for
from . import alphabet as A


class CorpusError(ValueError):
    """A corpus whose parts do not fit together."""


@dataclass
class Corpus:
    name: str
    alphabet: A.Alphabet
    interactions: DataFrame
    events: DataFrame
    unknown_shapes: DataFrame
    segmenter: str
    meta: dict[str, str] = field(default_factory=dict)


def _belongs(family: str, name: str) -> bool:
    return name == family or name.startswith(f"{family}-")


def build(raw: RawCorpus, alphabet: A.Alphabet, name: str, *, segmenter: str = "intent", scope_by: str | None = None, validate: bool = True, store: str | None = None) -> Corpus:
    """The corpus of raw interactions: families must fit, and with ``scope_by`` a hint takes the actor's place.

    With ``store``, a folder that all executors share, typed events and interactions are written
    there once, so that figures read them and not the source.
    """
    if not _belongs(alphabet.corpus, name):
        raise CorpusError(f"the alphabet is for corpus {alphabet.corpus!r}, not {name!r}")
    other = raw.interactions.where(~((F.col("corpus") == name) | F.startswith(F.lit(name), F.concat("corpus", F.lit("-"))))).first()
    if other:
        raise CorpusError(f"{other['id']} is of corpus {other['corpus']!r}, not {name!r}")
    events = segment(A.apply(alphabet, raw.events), segmenter)
    interactions = A.derive_outcomes(alphabet, raw.interactions, events).withColumn("facts", A.redact(alphabet, F.col("facts")))
    if scope_by:
        lacks = interactions.where(F.col("hints")[scope_by]["v"].isNull()).first()
        if lacks:
            raise CorpusError(f"{lacks['id']} has no hint {scope_by!r}")
        none = F.lit(None).cast("string")
        interactions = interactions.withColumn("actor", F.struct(F.col("hints")[scope_by]["v"].alias("operatorId"), none.alias("teamId"), none.alias("agentId")))
    missed = raw.events.where(A.classify(alphabet, F.col("features")).isNull())
    shapes = missed.groupBy(A.shape(F.col("features")).alias("features")).agg(F.count(F.lit(1)).alias("n"))
    if store:
        spark = events.sparkSession
        tables = {}
        for table, df in (("events", events), ("interactions", interactions), ("shapes", shapes)):
            df.write.mode("overwrite").parquet(f"{store}/{table}")
            tables[table] = spark.read.schema(df.schema).parquet(f"{store}/{table}")
        events, interactions, shapes = tables["events"], tables["interactions"], tables["shapes"]
    if validate:
        require_valid(interactions, events)
    return Corpus(name, alphabet, interactions, events, shapes, segmenter, raw.meta)


def load(spark: SparkSession, source: str, path: str, alphabet: str | A.Alphabet, name: str | None = None, **options) -> Corpus:
    """The corpus that a registered source reads at ``path``; ``alphabet`` is one, or its YAML."""
    own = A.parse_alphabet(alphabet) if isinstance(alphabet, str) else alphabet
    return build(source_for(source)(spark, path), own, name or own.corpus, **options)
