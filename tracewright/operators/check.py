"""Clauses: which written rules were kept, violated or never exercised.

The guard of a precedence clause need only be the first of its type, so an
instance is compared with one number per scope and guard, never with its events.
"""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.alphabet import Alphabet, ArtefactError


# The operators of a condition.
OPERATORS = ("eq", "neq", "in", "gt", "gte", "lt", "lte")


@dataclass
class Clause:
    id: str
    text: str
    expressible: bool = True
    reason: str | None = None
    shape: str | None = None
    subject: str | None = None
    guard: str | None = None
    window: str = "episode"
    when: dict | None = None


def parse_contracts(source: str | dict) -> list[Clause]:
    raw = yaml.safe_load(source) if isinstance(source, str) else source
    if not isinstance(raw, dict) or not raw.get("name") or not isinstance(raw.get("version"), int):
        raise ArtefactError("contracts: need a name and an integer version")
    if not isinstance(raw.get("clauses"), list):
        raise ArtefactError("contracts: clauses must be a list")
    out = []
    for i, c in enumerate(raw["clauses"]):
        at = f"clauses[{i}]"
        if not c.get("id") or not c.get("text"):
            raise ArtefactError(f"{at}: needs an id and a text")
        if not isinstance(c.get("expressible", True), bool):
            raise ArtefactError(f"{at}: expressible must be true or false")
        if c.get("expressible", True):
            if c.get("shape") not in ("precedence", "at-most-one"):
                raise ArtefactError(f"{at}: shape must be precedence or at-most-one")
            if not c.get("subject") or (c["shape"] == "precedence" and not c.get("guard")):
                raise ArtefactError(f"{at}: needs a subject, and a guard for precedence")
            if c.get("window", "episode") not in ("episode", "interaction"):
                raise ArtefactError(f"{at}: window must be episode or interaction")
            if (when := c.get("when")) is not None:
                if not isinstance(when, dict) or not when.get("fact"):
                    raise ArtefactError(f"{at}: when needs a fact")
                if sum(o in when for o in OPERATORS) != 1:
                    raise ArtefactError(f"{at}: when needs one of {', '.join(OPERATORS)}")
        elif not c.get("reason"):
            raise ArtefactError(f"{at}: an inexpressible clause needs a reason")
        out.append(Clause(c["id"], c["text"], c.get("expressible", True), c.get("reason"), c.get("shape"), c.get("subject"), c.get("guard"), c.get("window", "episode"), c.get("when")))
    return out


def condition(op: str, fact: Column, value) -> Column:
    """Three-valued: null where the fact is absent, null, or of a kind that cannot be compared."""
    known = fact["v"].isNotNull()
    if op in ("eq", "neq"):
        same = fact["v"] == S.literal(value)["v"]
        return F.when(known, same if op == "eq" else ~same)
    if op == "in":
        hit = F.lit(False)
        for v in value:
            hit = hit | (fact == S.literal(v))
        return F.when(known, hit)
    x, y = fact["v"].cast("double"), F.lit(float(value))
    test = {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}[op]
    return F.when(fact["t"] == "n", test)


def last_slot(name: str) -> Column:
    """The last categorical value of a slot strictly before the event in its episode."""
    w = Window.partitionBy("interaction_id", "episode").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    s = F.col("slots")[name]
    return F.last(F.when(S.is_categorical(s), s), ignorenulls=True).over(w)


def episode_intent() -> Column:
    """The episode's intent if it has exactly one known intent type."""
    w = Window.partitionBy("interaction_id", "episode")
    known = F.when((F.col("kind") == "customer_intent") & (F.col("type") != "unknown"), F.col("type"))
    return F.when(F.min(known).over(w) == F.max(known).over(w), S.text(F.min(known).over(w)))


def fact_column(fact: str) -> Column:
    if fact.startswith("slot."):
        return last_slot(fact[5:])
    if fact == "episode.intent":
        return episode_intent()
    s = F.col("facts")[fact]
    return F.when(S.is_categorical(s), s)


def rendered(when: dict) -> str:
    """A condition as text."""
    op = next(o for o in OPERATORS if o in when)
    sign = {"eq": "=", "neq": "!=", "in": "in", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[op]
    value = when[op]
    return f"{when['fact']} {sign} {'{' + ', '.join(map(str, value)) + '}' if isinstance(value, list) else value}"


def conjunction(conditions: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """All of named conditions, three-valued, and the names of those that are unknown."""
    whole = F.lit(True)
    for _, c in conditions:
        whole = whole & c
    return whole, F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in conditions)), lambda x: x.isNotNull())


def violations(events: DataFrame, clauses: list[Clause], alphabet: Alphabet) -> DataFrame:
    """(clause, interaction_id, episode, seq, violated) of every instance that exercises a clause.

    Guards and repeats are one number for each scope, aggregated before they are
    shuffled; only the subjects, with the facts that conditions ask for, meet them.
    """
    subjects = set(alphabet.consequential())
    live = [(k, c) for k, c in enumerate(clauses) if c.expressible and c.subject in subjects]
    if not live:
        return events.where("false").select(F.lit(0).alias("no"), F.lit("").alias("clause"), F.lit("").alias("shape"), F.lit(False).alias("violated"), "interaction_id", "episode", "seq")
    names = {f: f"_fact{i}" for i, f in enumerate(sorted({c.when["fact"] for _, c in live if c.when}))}
    own = F.col("type").isin(sorted({c.subject for _, c in live}))
    rows = events
    if names:
        # facts look back in their episode, at events that can tell one
        telling = own
        for f in names:
            if f.startswith("slot."):
                telling = telling | S.is_categorical(F.col("slots")[f[5:]])
            elif f == "episode.intent":
                telling = telling | (F.col("kind") == "customer_intent")
        rows = rows.where(telling)
        for f, n in names.items():
            rows = rows.withColumn(n, fact_column(f))
    rows = rows.where(own).select("interaction_id", "episode", "seq", "type", *names.values())
    found: dict[tuple, str] = {}
    for window, keys in (("episode", ["interaction_id", "episode"]), ("interaction", ["interaction_id"])):
        guards = sorted({c.guard for _, c in live if c.shape == "precedence" and c.window == window})
        repeats = sorted({c.subject for _, c in live if c.shape == "at-most-one"}) if window == "episode" else []
        if not guards and not repeats:
            continue
        figures = []
        for i, g in enumerate(guards):
            found[window, g] = f"_{window}{i}"
            figures.append(F.min(F.when(F.col("type") == g, F.col("seq"))).alias(f"_{window}{i}"))
        for i, t in enumerate(repeats):
            found["repeats", t] = f"_repeats{i}"
            figures.append(F.sum(F.when(F.col("type") == t, 1)).alias(f"_repeats{i}"))
        rows = rows.join(events.where(F.col("type").isin([*guards, *repeats])).groupBy(*keys).agg(*figures), keys, "left")
    verdicts = []
    for k, c in live:
        applies = F.col("type") == c.subject
        if c.when:
            op = next(o for o in OPERATORS if o in c.when)
            applies = applies & F.coalesce(condition(op, F.col(names[c.when["fact"]]), c.when[op]), F.lit(False))
        bad = ~F.coalesce(F.col(found[c.window, c.guard]) < F.col("seq"), F.lit(False)) if c.shape == "precedence" else F.col(found["repeats", c.subject]) > 1
        verdicts.append(F.when(applies, F.struct(F.lit(k).alias("no"), F.lit(c.id).alias("clause"), F.lit(c.shape).alias("shape"), bad.alias("violated"))))
    out = rows.select("interaction_id", "episode", "seq", F.explode(F.filter(F.array(*verdicts), lambda x: x.isNotNull())).alias("x"))
    return out.select("x.no", "x.clause", "x.shape", "x.violated", "interaction_id", "episode", "seq")


def exercise(events: DataFrame, clauses: list[Clause], alphabet: Alphabet) -> DataFrame:
    """(clause, exercised, violated) of every expressible clause. At-most-one counts violated episodes, precedence violated instances."""
    found = violations(events, clauses, alphabet)
    per = found.groupBy("no", "shape", "episode").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("violated").cast("int")).alias("bad"))
    per = per.groupBy("no").agg(F.sum("k").alias("exercised"), F.sum(F.when(F.col("shape") == "at-most-one", F.least("bad", F.lit(1))).otherwise(F.col("bad"))).alias("violated"))
    declared = events.sparkSession.createDataFrame([(k, c.id) for k, c in enumerate(clauses) if c.expressible], "no int, clause string")
    out = F.broadcast(declared).join(per, "no", "left")
    zero = F.lit(0).cast("long")
    return out.select("no", "clause", F.coalesce("exercised", zero).alias("exercised"), F.coalesce(F.col("violated").cast("long"), zero).alias("violated"))


def buckets(exercised: DataFrame) -> DataFrame:
    """Each clause with its report bucket: kept, violated or never exercised."""
    status = F.when(F.col("exercised") == 0, "never_exercised").when(F.col("violated") == 0, "kept").otherwise("violated")
    return exercised.withColumn("status", status).withColumn("ratio", F.when(F.col("exercised") == 0, 0.0).otherwise(F.col("violated") / F.col("exercised")))


def even_sample(rows: DataFrame, order: list[str], n: int, by: str, prefix: int = 4) -> DataFrame:
    """At most ``n`` rows per ``by``, evenly spaced in ``order``, first and last always.

    ``order`` begins with a text column, whose first ``prefix`` characters cut a group into parts that follow one
    another: rows are numbered within their part, and the parts' sizes, which are few, give where each begins.
    """
    part = F.substring(F.col(order[0]), 1, prefix)
    sizes = rows.groupBy(by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "_part", F.coalesce(F.sum("_k").over(ahead), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy(by)).alias("_n"))
    out = rows.withColumn("_part", part).withColumn("_i", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1)
    out = out.join(sizes, [by, "_part"]).withColumn("_i", F.col("_i") + F.col("_before"))
    if n <= 1:
        return out.where(F.col("_i") < n).drop("_i", "_n", "_part", "_before")
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(n - 1) + 0.5).cast("long"))
    return out.where((F.col("_n") <= n) | F.array_contains(spots, F.col("_i"))).drop("_i", "_n", "_part", "_before")


def inventory(events: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Actions by type: how often, how often failed, consequence. An action failed if it says so or a failed system event follows."""
    w = Window.partitionBy("interaction_id").orderBy("seq")
    failed = (F.col("result") == "failed") | ((F.lead("kind").over(w) == "system") & (F.lead("result").over(w) == "failed"))
    rows = events.withColumn("failed", F.coalesce(failed, F.lit(False))).where("kind = 'action'")
    known = events.sparkSession.createDataFrame([(t.id, t.label, t.consequence or "unknown") for t in alphabet.types] or [("", None, "")], "type string, label string, consequence string")
    out = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("int")).cast("long").alias("failed")).join(F.broadcast(known), "type", "left")
    return out.select("type", F.coalesce("label", S.label_of(F.col("type"))).alias("label"), F.coalesce("consequence", F.lit("unknown")).alias("consequence"), "n", "failed")
