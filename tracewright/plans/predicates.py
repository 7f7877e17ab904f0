"""Predicates: questions about a text whose probabilities become facts only outside a band, once they are calibrated."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import ArtefactError, _need

# The closed sets of predicates, the step of probabilities and the least width of a band.
STATUSES = ("proposed", "real", "not_real", "retired")
WINDOWS = ("event", "before", "sessionBefore")
QUADRANTS = ("text-unknown", "text-closed", "sequence-closed", "sequence-unknown")
SOURCE = re.compile(r"event\.text|episode\.text|slot\.[A-Za-z_][A-Za-z0-9_]*")
STEP, WIDTH = 0.01, 0.2


@dataclass
class Predicate:
    id: str
    fact: str
    status: str
    quadrant: str
    source: str
    window: str
    question: str
    assert_at: float
    refute_at: float
    criteria: dict | None = None
    calibration: dict | None = None

    @property
    def assert_only(self) -> bool:
        return self.refute_at < 0

    @property
    def inert(self) -> bool:
        """Only a real and calibrated predicate gives facts."""
        return self.status != "real" or self.calibration is None


@dataclass
class PredicateSet:
    corpus: str
    version: int
    model: str
    redaction: str
    predicates: list[Predicate]
    warnings: list[str] = field(default_factory=list)

    def active(self) -> list[Predicate]:
        return [p for p in self.predicates if not p.inert]

    def stale(self, version: int) -> bool:
        """Were annotations of that version made for another wording?"""
        return version != self.version


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def quantised(x: float) -> bool:
    return abs(x * 100 - round(x * 100)) < 1e-9


def validate_bands(name: str, assert_at: float, refute_at: float) -> None:
    """A predicate's thresholds: on the step, in order, and far enough apart; a negative refute threshold refutes nothing."""
    _need(0 < assert_at <= 1, name, f"assertAt must be above 0 and at most 1, not {assert_at}")
    _need(refute_at <= assert_at, name, f"refuteAt ({refute_at}) must not exceed assertAt ({assert_at})")
    _need(quantised(assert_at), name, f"assertAt must be a multiple of {STEP}, not {assert_at}")
    if refute_at >= 0:
        _need(quantised(refute_at), name, f"refuteAt must be a multiple of {STEP}, not {refute_at}")
        _need(assert_at - refute_at >= WIDTH - 1e-9, name, f"assertAt must lie at least {WIDTH} above refuteAt")


def _calibration(c, at: str) -> dict:
    _need(isinstance(c, dict), at, "calibration must be a mapping")
    for k in ("alphabetVersion", "n", "assertPrecision", "withheldFraction"):
        _need(_number(c.get(k)), at, f"calibration.{k} must be a number")
    for k in ("at", "corpusRevision", "reviewer"):
        _need(isinstance(c.get(k), str) and c[k], at, f"calibration.{k} must be a text")
    labels = c.get("labels")
    _need(isinstance(labels, dict) and _number(labels.get("true", labels.get(True))) and _number(labels.get("false", labels.get(False))), at, "calibration.labels needs its numbers of true and false")
    _need(c.get("refutePrecision") is None or _number(c["refutePrecision"]), at, "calibration.refutePrecision must be a number")
    seen = c.get("observed")
    _need(seen is None or (isinstance(seen, dict) and all(isinstance(seen.get(k, seen.get(k == "true")), list) for k in ("true", "false"))), at, "calibration.observed must hold lists for true and false")
    return c


def parse_predicates(source: str | dict) -> PredicateSet:
    raw = yaml.safe_load(source) if isinstance(source, str) else source
    _need(isinstance(raw, dict), "predicates", "must be a mapping")
    for k in ("corpus", "model", "redaction"):
        _need(isinstance(raw.get(k), str) and raw[k], k, "must be a name")
    _need(isinstance(raw.get("version"), int) and raw["version"] >= 1, "version", "must be an integer of 1 or more")
    _need(isinstance(raw.get("predicates"), list), "predicates", "must be a list")
    out, ids, facts = PredicateSet(raw["corpus"], raw["version"], raw["model"], raw["redaction"], []), set(), set()
    for i, p in enumerate(raw["predicates"]):
        at = f"predicates[{i}]"
        _need(isinstance(p, dict) and isinstance(p.get("id"), str) and p["id"], at, "needs an id")
        _need(p["id"] not in ids, at, f"id {p['id']} occurs twice")
        ids.add(p["id"])
        _need("type" not in p, at, "has no type: every predicate is true, false or withheld")
        fact = p.get("fact")
        _need(isinstance(fact, str) and fact.startswith("obs.") and len(fact) > 4, at, "fact must be obs.<name>")
        _need(fact not in facts, at, f"fact {fact} is given by two predicates")
        facts.add(fact)
        _need(p.get("status") in STATUSES, at, f"status must be one of {', '.join(STATUSES)}")
        _need(p.get("quadrant") in QUADRANTS, at, f"quadrant must be one of {', '.join(QUADRANTS)}")
        _need(p["quadrant"] != "sequence-unknown", at, "asks what happened in a world that the record may not mention; ask what the text states")
        _need(isinstance(p.get("source"), str) and SOURCE.fullmatch(p["source"]), at, "source must be event.text, episode.text or slot.<name>")
        _need(p.get("window") in WINDOWS, at, f"window must be one of {', '.join(WINDOWS)}")
        _need(isinstance(p.get("question"), str) and p["question"].strip(), at, "needs a question")
        bands = p.get("bands")
        _need(isinstance(bands, dict) and _number(bands.get("assertAt")) and _number(bands.get("refuteAt")), at, "bands need the numbers assertAt and refuteAt")
        validate_bands(p["id"], bands["assertAt"], bands["refuteAt"])
        criteria = p.get("criteria")
        if criteria is not None:
            criteria = {str(k).lower(): v for k, v in criteria.items()} if isinstance(criteria, dict) else {}
            _need(all(isinstance(criteria.get(k), str) for k in ("true", "false")), at, "criteria need a text for true and one for false")
        calibration = _calibration(p["calibration"], at) if p.get("calibration") is not None else None
        _need(p["status"] != "real" or calibration, at, "a real predicate needs its calibration")
        if p["source"] == "episode.text" or p["window"] != "event":
            out.warnings.append(f"{p['id']}: reads {p['source']} over {p['window']}, so every change of segmentation asks for a new calibration")
        out.predicates.append(Predicate(p["id"], fact, p["status"], p["quadrant"], p["source"], p["window"], p["question"].strip(), bands["assertAt"], bands["refuteAt"], criteria, calibration))
    return out


def emitted(predicates: PredicateSet, predicate: Column, p: Column) -> Column:
    """What a probability says under its predicate's band: true, false, or null where it is withheld or the predicate is not in service."""
    out = F.lit(None).cast("boolean")
    for x in predicates.active():
        out = F.when(predicate == x.id, F.when(p >= x.assert_at, True).when(p <= x.refute_at, False)).otherwise(out)
    return out


def calibration_record(bands, labels: tuple[int, int, int], meta: dict) -> dict:
    """What a predicate set says about a calibration: ``labels`` are the numbers of true, false and unsure items."""
    cut = lambda x: None if x is None else round(x, 2)
    true, false, unsure = labels
    return {
        **{k: meta[k] for k in ("at", "corpusRevision", "alphabetVersion", "reviewer")}, "n": true + false + unsure, "labels": {"true": true, "false": false} | ({"unsure": unsure} if unsure else {}),
        "assertPrecision": cut(bands.assert_precision), "refutePrecision": cut(bands.refute_precision), "withheldFraction": cut(bands.withheld), "labelSeparation": bands.separation,
    }


def blocks_adjudication(record: dict, limits: dict) -> str | None:
    """Why a calibration does not allow a predicate to be real; null if it does."""
    if record["assertPrecision"] < limits["minPredicatePrecision"]:
        return f"assert precision {record['assertPrecision']} is below {limits['minPredicatePrecision']}"
    if record.get("labelSeparation") is not None and record["labelSeparation"] < limits["minLabelSeparation"]:
        return f"labels are {record['labelSeparation']:.3f} apart, less than {limits['minLabelSeparation']}"
    return None


__all__ = ["ArtefactError", "Predicate", "PredicateSet", "blocks_adjudication", "calibration_record", "emitted", "parse_predicates", "validate_bands"]
