"""The report of a corpus against written clauses, and the audit of a corpus: small figures on the driver, and their text.

Every figure is aggregated where the events are; the driver holds one row for each
type, clause, outcome or shape.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.corpus import Corpus
from . import audit as A
from . import check as C

# How many lines a list of the text shows.
SHOWN = {"irreversible": 6, "compensable": 4, "violations": 4, "unreachable": 5, "shapes": 10}
SAMPLED = 20


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def told_events(corpus: Corpus, clauses: list[C.Clause]) -> DataFrame:
    """The corpus's events, with their interaction's facts if a clause asks for one."""
    asked = any(c.when and not c.when["fact"].startswith("slot.") and c.when["fact"] != "episode.intent" for c in clauses)
    return corpus.events.join(corpus.interactions.select(F.col("id").alias("interaction_id"), "facts"), "interaction_id", "left") if asked else corpus.events


def examples(corpus: Corpus, clauses: list[C.Clause], violated: bool = True, n: int = SAMPLED) -> DataFrame:
    """(clause, interaction_id, episode, seq): at most ``n`` of a clause's instances that broke it, or kept it, evenly spaced."""
    found = C.violations(told_events(corpus, clauses), clauses, corpus.alphabet).where(F.col("violated") == violated)
    return C.even_sample(found, ["interaction_id", "seq"], n, "clause").select("clause", "interaction_id", "episode", "seq")


def coverage(corpus: Corpus) -> dict:
    """Interactions, events, actions, and the events that no type names."""
    e = corpus.events.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum((F.col("kind") == "action").cast("long")), F.lit(0)).alias("actions")).first()
    unknown = corpus.unknown_shapes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return {"interactions": corpus.interactions.count(), "events": e["events"], "actions": e["actions"], "unknown_events": unknown, "unknown_rate": unknown / e["events"] if e["events"] else 0.0}


def report(corpus: Corpus, clauses: list[C.Clause], name: str = "", version: int = 1) -> dict:
    """What was kept, broken, never came up and cannot be checked. The most often broken rule comes first."""
    text = {c.id: c.text for c in clauses}
    verdicts = sorted(_rows(C.buckets(C.exercise(told_events(corpus, clauses), clauses, corpus.alphabet))), key=lambda r: r["no"])
    some: dict[str, list[str]] = {}
    for r in sorted(_rows(examples(corpus, clauses)), key=lambda r: (r["clause"], r["interaction_id"], r["seq"])):
        some.setdefault(r["clause"], []).append(f"{r['interaction_id']}#{r['seq']}")
    broken = sorted((v for v in verdicts if v["violated"]), key=lambda v: (-v["violated"] / v["exercised"], -v["violated"]))
    return {
        "corpus": corpus.name,
        "clauses": {"name": name, "version": version, "total": len(clauses), "checkable": sum(c.expressible for c in clauses)},
        "coverage": coverage(corpus),
        "inventory": sorted(_rows(C.inventory(corpus.events, corpus.alphabet)), key=lambda r: (-r["n"], r["type"])),
        "kept": [{"id": v["clause"], "exercised": v["exercised"]} for v in verdicts if v["status"] == "kept"],
        "violated": [{"id": v["clause"], "text": text[v["clause"]], "violated": v["violated"], "exercised": v["exercised"], "examples": some.get(v["clause"], [])} for v in broken],
        "never_exercised": [{"id": v["clause"], "text": text[v["clause"]]} for v in verdicts if v["status"] == "never_exercised"],
        "unreachable": [{"id": c.id, "text": c.text, "reason": c.reason or ""} for c in clauses if not c.expressible],
    }


def percent(x: float) -> str:
    return f"{100 * x:.1f}%"


def render_report(r: dict) -> str:
    c = r["coverage"]
    out = [
        f"{r['corpus']}, held against {r['clauses']['name'] or 'its clauses'} (version {r['clauses']['version']})", "",
        f"{c['interactions']} interactions, {c['events']} events, {c['actions']} actions",
        f"{c['unknown_events']} events ({percent(c['unknown_rate'])}) have no name in the alphabet; what follows is about the others", "", "ACTIONS TAKEN",
    ]
    for what, note in (("irreversible", "cannot be undone"), ("compensable", "can be made good")):
        own = [a for a in r["inventory"] if a["consequence"] == what]
        out.append(f"  {sum(a['n'] for a in own):>7}  {what}: {note}")
        out += [f"  {a['n']:>11}  {a['label']}" + (f" ({a['failed']} failed)" if a["failed"] else "") for a in own[: SHOWN[what]]]
    out += ["", f"RULES KEPT ({len(r['kept'])})", *(f"  {k['exercised']:>7}  {k['id']}" for k in r["kept"])]
    out += ["", f"RULES BROKEN ({len(r['violated'])})", *(() if r["violated"] else ("  none",))]
    for v in r["violated"]:
        out += [f"  {v['text']}", f"      broken {v['violated']} of {v['exercised']} times ({percent(v['violated'] / v['exercised'])})"]
        out += [f"      for example {' '.join(v['examples'][: SHOWN['violations']])}"] if v["examples"] else []
    if r["never_exercised"]:
        out += ["", f"NEVER CAME UP ({len(r['never_exercised'])}): neither kept nor broken", *(f"  {n['id']}: {n['text']}" for n in r["never_exercised"])]
    out += ["", f"CANNOT BE CHECKED BY ORDER AND NUMBER OF EVENTS ({len(r['unreachable'])} of {r['clauses']['total']})"]
    for u in r["unreachable"][: SHOWN["unreachable"]]:
        out += [f"  {u['text']}", f"      {u['reason']}"]
    if (more := len(r["unreachable"]) - SHOWN["unreachable"]) > 0:
        out.append(f"  and {more} more")
    return "\n".join([*out, "", "Rules that nobody has written down are not looked for."])


def agreement(corpus: Corpus) -> DataFrame:
    """(interactions, agreement): of interactions that say how many episodes they have, the share segmented into as many."""
    n = corpus.events.groupBy("interaction_id").agg(F.count_distinct("episode").alias("n"))
    said = corpus.interactions.select(F.col("id").alias("interaction_id"), F.col("hints")["expected_episodes"].alias("x")).where("x.t = 'n'")
    right = F.coalesce(F.col("n"), F.lit(0)) == F.col("x.v").cast("double")
    return said.join(n, "interaction_id", "left").agg(F.count(F.lit(1)).alias("interactions"), F.avg(right.cast("double")).alias("agreement"))


def outcomes(interactions: DataFrame) -> DataFrame:
    """(outcome, n), without interactions that have none."""
    return interactions.where("outcome is not null").groupBy(F.col("outcome.label").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def actors(interactions: DataFrame) -> DataFrame:
    """Different operators, teams and agents."""
    some = lambda c: F.count_distinct(F.nullif(F.col(f"actor.{c}"), F.lit("")))
    return interactions.agg(some("operatorId").alias("operators"), some("teamId").alias("teams"), some("agentId").alias("agents"))


def audit(corpus: Corpus, gate: float = 0.2, least: int = 5) -> dict:
    """All figures of a corpus. Most frequent first, equal ones by name."""
    e, alphabet = corpus.events, corpus.alphabet
    by = lambda rows, name: sorted(rows, key=lambda r: (-r["n"], r[name]))
    subjects = by(_rows(A.subject_floor(e, alphabet, least)), "type")
    truth = agreement(corpus).first()
    episodes = A.episode_stats(e, alphabet).first().asDict()
    return {
        "corpus": corpus.name, "alphabet_version": alphabet.version, "segmenter": corpus.segmenter,
        "interactions": corpus.interactions.count(), "kinds": {r["kind"]: r["n"] for r in by(_rows(A.kinds(e)), "kind")}, "types": by(_rows(A.type_figures(e, alphabet)), "type"),
        "unknown": _rows(A.unknown_rate(e, gate))[0] | {"gate": gate, "shapes": by(_rows(corpus.unknown_shapes), "features")},
        "episodes": episodes | ({"truth": truth.asDict()} if truth["interactions"] else {}),
        "subjects": [s for s in subjects if s["above_floor"]], "below_floor": [s for s in subjects if not s["above_floor"]],
        "outcomes": {r["outcome"]: r["n"] for r in by(_rows(outcomes(corpus.interactions)), "outcome")}, "actors": _rows(actors(corpus.interactions))[0],
        "nothing_to_say": not any(s["above_floor"] for s in subjects),
    }


def render_audit(a: dict) -> str:
    u = a["unknown"]
    out = [f"{a['corpus']}: {a['interactions']} interactions, {u['events']} events, alphabet version {a['alphabet_version']}, segmenter {a['segmenter']}"]
    out += [f"unnamed events: {u['unknown']} ({percent(u['rate'])}), refused above {percent(u['gate'])}" + (": REFUSED" if u["refused"] else "")]
    out += [f"  {s['n']:>7}  {s['features']}" for s in u["shapes"][: SHOWN["shapes"]]]
    out += ["", "kinds", *(f"  {n:>7}  {k}" for k, n in a["kinds"].items()), "", "types"]
    out += [f"  {t['n']:>7}  {t['type']} ({t['kind']}, {t['consequence']}{', may be advised' if t['recommendable'] else ''}) in {t['interactions']} interactions" for t in a["types"]]
    e = a["episodes"]
    out += ["", f"episodes: {e['episodes']}, of which {percent(e['idle_share'] or 0)} hold no action of consequence"]
    if "truth" in e:
        out.append(f"  as many as stated in {percent(e['truth']['agreement'])} of {e['truth']['interactions']} interactions")
    for name, rows in (("subjects", a["subjects"]), ("too few to judge", a["below_floor"])):
        out += ["", name, *(f"  {s['n']:>7}  {s['type']} in {s['episodes']} episodes" for s in rows)]
    out += ["", "outcomes", *(f"  {n:>7}  {k}" for k, n in a["outcomes"].items()), "", "actors: " + ", ".join(f"{n} {k}" for k, n in a["actors"].items())]
    return "\n".join([*out, *(["", "No action of consequence is frequent enough: there is nothing to say."] if a["nothing_to_say"] else [])])


def as_json(figures: dict) -> str:
    return json.dumps(figures, indent=2, ensure_ascii=False)


