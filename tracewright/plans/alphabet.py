"""Alphabets: declarative, versioned rules that type events, parsed from YAML and compiled to Catalyst."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# The closed sets of the data model.
KINDS = ("customer_intent", "customer_utterance", "agent_utterance", "action", "system", "unknown")
CONSEQUENCES = ("none", "reversible", "compensable", "irreversible")
STRATEGIES = ("token", "hash", "drop")
SLOT_PATTERNS = ("email", "phone", "digits")
UNKNOWN = "unknown"


class ArtefactError(ValueError):
    """A declarative artefact that breaks a rule; the message names the place."""


@dataclass
class EventType:
    id: str
    match: dict
    kind: str
    label: str | None = None
    consequence: str | None = None
    recommendable: bool | None = None
    slots: list[str] | None = None
    identity: list[str] = field(default_factory=list)


@dataclass
class Alphabet:
    corpus: str
    version: int
    types: list[EventType]
    outcomes: list[dict]
    redaction: list[dict]
    default_kinds: dict[str, str]

    def consequential(self, floor: str = "compensable") -> list[str]:
        """Ids, as declared, of actions of at least that consequence."""
        least = CONSEQUENCES.index(floor)
        return [t.id for t in self.types if t.consequence and CONSEQUENCES.index(t.consequence) >= least]

    def recommendable(self) -> list[str]:
        declared = set(self.consequential())
        return [t.id for t in self.types if t.id in declared and t.recommendable]


def _need(ok, where: str, what: str) -> None:
    if not ok:
        raise ArtefactError(f"{where}: {what}")


def parse_alphabet(source: str | dict) -> Alphabet:
    raw = yaml.safe_load(source) if isinstance(source, str) else source
    _need(isinstance(raw, dict), "alphabet", "must be a mapping")
    _need(isinstance(raw.get("corpus"), str) and raw["corpus"], "corpus", "must be a name")
    _need(isinstance(raw.get("version"), int) and raw["version"] >= 1, "version", "must be an integer of 1 or more")
    kinds = raw.get("default_kinds") or {}
    types, seen = [], set()
    for i, t in enumerate(raw.get("event_types") or []):
        at = f"event_types[{i}]"
        name = t.get("id")
        _need(isinstance(name, str) and name, at, "needs an id")
        _need(name != UNKNOWN, at, "'unknown' is reserved")
        _need(name not in seen, at, f"id {name} occurs twice")
        seen.add(name)
        _need(isinstance(t.get("match"), dict) and t["match"], at, "needs a match that is not empty")
        _need("consequential" not in t and "reversibility" not in t, at, "consequential and reversibility are no longer read; declare consequence")
        kind = t.get("kind") or kinds.get(t["match"].get("speaker"))
        _need(kind in KINDS, at, f"kind must be one of {', '.join(KINDS)}")
        consequence = t.get("consequence")
        _need(kind != "action" or consequence in CONSEQUENCES, at, "an action must declare its consequence")
        _need(consequence is None or consequence in CONSEQUENCES, at, "unknown consequence")
        _need(consequence != "irreversible" or isinstance(t.get("recommendable"), bool), at, "an irreversible action must declare recommendable")
        slots, identity = t.get("slots"), t.get("identity") or []
        _need(slots is None or isinstance(slots, list), at, "slots must be a list")
        lost = [x for x in identity if slots is not None and x not in slots]
        _need(not lost, at, f"identity names slots that are not kept: {', '.join(lost)}")
        for value in t["match"].values():
            if isinstance(value, dict):
                _need(set(value) == {"pattern"}, at, "a match is a scalar, a list or a pattern")
                re.compile(value["pattern"])
        types.append(EventType(name, t["match"], kind, t.get("label"), consequence, t.get("recommendable"), slots, identity))
    for i, o in enumerate(raw.get("outcomes") or []):
        forms = [f for f in ("any_event", "closed_without", "result", "hint") if f in o]
        _need(len(forms) == 1 and isinstance(o.get("label"), str), f"outcomes[{i}]", "needs a label and one of any_event, closed_without, result, hint")
    for i, r in enumerate(raw.get("redaction") or []):
        at = f"redaction[{i}]"
        _need(r.get("strategy") in STRATEGIES, at, "unknown strategy")
        _need(("slot" in r) != ("pattern" in r), at, "names a slot or a pattern")
        _need("pattern" not in r or r["pattern"] in SLOT_PATTERNS, at, "unknown pattern")
        _need("except" not in r or r.get("slot") == "*", at, "except goes with slot '*' only")
    return Alphabet(raw["corpus"], raw["version"], types, raw.get("outcomes") or [], raw.get("redaction") or [], kinds)


def _holds(features: Column, key: str, wanted) -> Column:
    got = features[key]
    if isinstance(wanted, dict):
        ok = (got["t"] == "s") & got["v"].rlike(wanted["pattern"])
    elif isinstance(wanted, list):
        ok = F.lit(False)
        for w in wanted:
            ok = ok | (got == S.literal(w))
    else:
        ok = got == S.literal(wanted)
    return F.coalesce(ok, F.lit(False))


def classify(alphabet: Alphabet, features: Column) -> Column:
    """Number of the first type all of whose matches hold; null where none does."""
    out = None
    for i, t in enumerate(alphabet.types):
        ok = F.lit(True)
        for key, wanted in t.match.items():
            ok = ok & _holds(features, key, wanted)
        out = F.when(ok, F.lit(i)) if out is None else out.when(ok, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


_SLOT = re.compile(r"\$\{([^}]+)\}")


def type_id(t: EventType, features: Column) -> Column:
    """The id, with features put in; unknown if one is absent or empty."""
    names = _SLOT.findall(t.id)
    if not names:
        return F.lit(t.id)
    parts, last = [], 0
    for m in _SLOT.finditer(t.id):
        parts += [F.lit(t.id[last : m.start()]), F.regexp_replace(F.lower(features[m[1]]["v"]), r"[^a-z0-9_.-]+", "_")]
        last = m.end()
    parts.append(F.lit(t.id[last:]))
    missing = F.lit(False)
    for n in names:
        missing = missing | features[n]["v"].isNull() | (features[n]["v"] == "")
    return F.when(missing, F.lit(UNKNOWN)).otherwise(F.concat(*parts))


def _only(slots: Column, names: list[str]) -> Column:
    return F.map_filter(slots, lambda k, v: k.isin(names) if names else F.lit(False))


def apply(alphabet: Alphabet, raw_events: DataFrame) -> DataFrame:
    """Typed events from raw ones (interaction_id, ord, at, features, slots, result): type, kind, projected and redacted slots, seq."""
    from pyspark.sql import Window

    speaker = F.col("features")["speaker"]["v"]
    kinds = F.lit(None).cast("string")
    for s, k in alphabet.default_kinds.items():
        kinds = F.when(speaker == s, k).otherwise(kinds)
    out = raw_events.withColumn("type_no", classify(alphabet, F.col("features")))
    named, kind, slots = F.lit(UNKNOWN), F.lit(None).cast("string"), F.col("slots")
    for i, t in reversed(list(enumerate(alphabet.types))):
        own = F.col("type_no") == i
        named = F.when(own, type_id(t, F.col("features"))).otherwise(named)
        kind = F.when(own, F.lit(t.kind)).otherwise(kind)
        if t.slots is not None:
            slots = F.when(own, _only(F.col("slots"), t.slots)).otherwise(slots)
    out = out.withColumn("type", named)
    out = out.withColumn("kind", F.coalesce(F.when(F.col("type") != UNKNOWN, kind), kinds, F.lit(UNKNOWN))).withColumn("slots", redact(alphabet, slots))
    order = Window.partitionBy("interaction_id").orderBy("at", "ord")
    return out.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))


def _surrogate(strategy: str, corpus: str, slot: Column, value: Column) -> Column:
    """What stands for a value."""
    if strategy == "token":
        return S.token(corpus, slot, value)
    return S.hashed(value) if strategy == "hash" else F.lit("")


def redact(alphabet: Alphabet, slots: Column) -> Column:
    """Slots with each rule applied: a named rule, else '*'; what no slot rule touches passes the patterns in order."""
    named = {r["slot"]: r for r in alphabet.redaction if "slot" in r}
    patterns = [r for r in alphabet.redaction if "pattern" in r]
    if not named and not patterns:
        return slots
    every = named.pop("*", None)

    def free(key: Column, s: Column) -> Column:
        v = s["v"]
        for r in patterns:
            p = {"email": S.EMAIL, "phone": S.PHONE, "digits": S.digits(r.get("min_digits", 6))}[r["pattern"]]
            v = S.replace_matches(v, p, partial(_surrogate, r["strategy"], alphabet.corpus, key))
        return F.when(s["t"] == "s", F.struct(s["t"].alias("t"), v.alias("v"))).otherwise(s)

    def rule_value(r: dict, key: Column, s: Column) -> Column:
        done = F.lit(None).cast(S.SCALAR) if r["strategy"] == "drop" else F.struct(F.lit("s").alias("t"), _surrogate(r["strategy"], alphabet.corpus, key, s["v"]).alias("v"))
        keep = F.lit(False)
        if r.get("unless"):
            keep = keep | F.lower(s["v"]).isin([str(x).lower() for x in r["unless"]])
        if r.get("unless_pattern"):
            keep = keep | s["v"].rlike(r["unless_pattern"])
        # what a rule exempts was not touched by it, and so passes the patterns
        return F.when(s["v"].isNull(), s).when(F.coalesce(keep, F.lit(False)), free(key, s)).otherwise(done)

    def value(key: Column, s: Column) -> Column:
        out = free(key, s)
        if every is not None:
            out = F.when(key.isin(every["except"]) if every.get("except") else F.lit(False), out).otherwise(rule_value(every, key, s))
        for name, r in named.items():
            out = F.when(key == name, rule_value(r, key, s)).otherwise(out)
        return out

    # a dropped value is no scalar at all; an explicit null is one, and stays
    return F.map_filter(F.transform_values(slots, value), lambda _, v: v.isNotNull())


def derive_outcomes(alphabet: Alphabet, interactions: DataFrame, events: DataFrame) -> DataFrame:
    """``interactions`` with an outcome: their own, else the label of the first rule that their typed events meet."""
    tests, wanted = [], {}
    for i, rule in enumerate(alphabet.outcomes):
        if kind := rule.get("any_event") or rule.get("closed_without"):
            wanted[f"_met{i}"] = F.bool_or(F.col("type") == kind)
            met = F.coalesce(F.col(f"_met{i}"), F.lit(False))
            tests.append((met if rule.get("any_event") else ~met, rule["label"]))
        elif "result" in rule:
            tests.append((F.coalesce(F.col("_result") == rule["result"], F.lit(False)), rule["label"]))
        else:
            tests.append((F.coalesce(F.col("hints")[rule["hint"]] == S.literal(rule.get("equals")), F.lit(False)), rule["label"]))
    per = events.groupBy(F.col("interaction_id").alias("_id")).agg(F.max("at").alias("_last"), F.max_by(F.struct("result"), "seq")["result"].alias("_result"), *(c.alias(n) for n, c in wanted.items()))
    label = F.lit(None).cast("string")
    for ok, name in reversed(tests):
        label = F.when(ok, F.lit(name)).otherwise(label)
    made = F.when(label.isNotNull(), F.struct(label.alias("label"), F.coalesce("_last", "started_at").cast("long").alias("at"), F.lit(0).cast("long").alias("lag_ms"), F.lit("in_band").alias("source")))
    out = interactions.join(per, F.col("id") == F.col("_id"), "left").withColumn("outcome", F.coalesce("outcome", made))
    return out.select(*interactions.columns)


def shape(features: Column) -> Column:
    """An event's features as sorted k=v, for the histogram of what no type matches."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(features)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["v"], F.lit("null")))), " ")
