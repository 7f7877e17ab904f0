"""Sources by name: functions of (spark, source) that give a RawCorpus. Others can be registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from . import dialogues, transcripts, xes
from .raw import RawCorpus

Source = Callable[[SparkSession, str], RawCorpus]

SOURCES: dict[str, Source] = {
    "synthetic": dialogues.read_planted,
    "abcd": dialogues.read_support,
    "tau2": dialogues.read_simulations,
    "bpic": xes.read,
    "cc": transcripts.read,
}


def register_source(name: str, source: Source) -> None:
    SOURCES[name] = source


def source_for(name: str) -> Source:
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name]
