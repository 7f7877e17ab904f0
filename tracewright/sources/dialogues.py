"""Dialogue logs as JSON documents: planted interactions, support dialogues with buttons, and tool-use simulations."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import variants as V
from .raw import RawCorpus, actor, outcome


def _document(spark: SparkSession, source: str) -> DataFrame:
    """(file, doc) of JSON files, whole."""
    return V.whole_files(spark, source).select("file", F.parse_json("text").alias("doc"))


def _items(df: DataFrame, array: Column, no: str, item: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(array.try_cast("array<variant>")).alias(no, item))


def _text(c: Column) -> Column:
    """A text as a scalar, null where it is absent."""
    return F.when(c.isNotNull(), S.text(c))


def read_planted(spark: SparkSession, source: str) -> RawCorpus:
    """One document of interactions and turns; texts of turns are never read."""
    doc = _document(spark, source).withColumn("corpus", V.text_at(F.col("doc"), "$.corpus"))
    i = _items(doc, V.at(F.col("doc"), "$.interactions", "variant"), "no", "i", "file", "corpus")
    v = F.col("i")
    i = i.select("file", "corpus", "no", "i", *(V.text_at(v, f"$.{k}").alias(k) for k in ("id", "operator", "team", "agent", "outcome")), V.at(v, "$.startedAt", "bigint").alias("started_at"))
    t = _items(i, V.at(v, "$.turns", "variant"), "turn", "t", "file", "id", "no", "started_at")
    w = Window.partitionBy("file", "id", "no").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.when(F.col("turn") == 0, 0).otherwise(F.coalesce(V.at(F.col("t"), "$.gapMs", "bigint"), F.lit(1000)))
    features = V.present(**{k: _text(V.text_at(F.col("t"), f"$.{k}")) for k in ("speaker", "intent", "button", "event")})
    events = t.select(
        F.col("id").alias("interaction_id"), F.col("turn").cast("long").alias("ord"), (F.col("started_at") + F.sum(gap).over(w)).alias("at"), features.alias("features"), V.scalars_of(V.at(F.col("t"), "$.slots", "variant")).alias("slots"),
        V.text_at(F.col("t"), "$.result").alias("result"), F.struct("file", F.concat(F.lit("/interactions/"), "no", F.lit("/turns/"), "turn").alias("path")).alias("raw"),
    )
    last = events.groupBy("interaction_id").agg(F.max_by("at", "ord").alias("last"))
    i = i.join(last, i["id"] == last["interaction_id"], "left")
    interactions = i.select("id", "corpus", actor(F.col("operator"), F.col("team"), F.col("agent")).alias("actor"), "started_at", outcome(F.col("outcome"), F.coalesce("last", "started_at"), F.lit(0), "in_band").alias("outcome"), F.lit(None).cast(S.SCALARS).alias("facts"), F.create_map(F.lit("expected_episodes"), S.literal(1)).alias("hints"))
    return RawCorpus(interactions, events)


#: What of a scenario the agent saw, and where it stands.
SCENARIO = (("customer.member_level", "personal.member_level"), ("order.payment_method", "order.payment_method"), ("order.num_products", "order.num_products"), ("order.packaging", "order.packaging"), ("order.state", "order.state"))
SPLITS = ("train", "dev", "test")


def ontology(file: str) -> dict[str, list[str]]:
    """Slot names by button, from ontology.json beside a corpus file; of a button in several groups the last counts."""
    return {button: names for group in json.loads((Path(file).parent / "ontology.json").read_text())["actions"].values() for button, names in group.items()}


def read_support(spark: SparkSession, source: str) -> RawCorpus:
    """Support dialogues in splits; only the delexicalised turns are read."""
    doc = _document(spark, source)
    c = reduce(DataFrame.unionByName, (_items(doc, V.at(F.col("doc"), f"$.{s}", "variant"), "no", "c", "file").withColumn("split", F.lit(s)) for s in SPLITS))
    v = F.col("c")
    c = c.select("file", "split", "no", "c", V.at(v, "$.convo_id", "bigint").alias("convo"), V.text_at(v, "$.scenario.flow").alias("flow"), V.text_at(v, "$.scenario.subflow").alias("subflow"))
    c = c.withColumn("id", F.concat(F.lit("abcd-"), F.col("convo").cast("string"))).withColumn("started_at", F.col("convo") * 1000)
    t = _items(c, V.at(F.col("c"), "$.delexed", "variant"), "turn", "t", "file", "split", "no", "id", "started_at", "flow", "subflow")
    t = t.withColumn("speaker", V.text_at(F.col("t"), "$.speaker")).withColumn("button", F.coalesce(V.text_at(F.col("t"), "$.targets[2]"), F.lit("unknown-action")))
    first = F.min(F.when(F.col("speaker") == "customer", F.col("turn"))).over(Window.partitionBy("file", "split", "no")) == F.col("turn")
    action, opens = F.col("speaker") == "action", (F.col("speaker") == "customer") & first
    known = spark.createDataFrame(list(ontology(source).items()) or [("", [])], "button string, names array<string>")
    values = F.transform(F.coalesce(V.at(F.col("t"), "$.targets[3]", "variant").try_cast("array<variant>"), F.array().cast("array<variant>")), V.scalar_of)
    t = t.join(F.broadcast(known), "button", "left").withColumn("values", values)
    names = F.when(F.size("names") == F.size("values"), F.col("names")).otherwise(F.transform("values", lambda _, k: F.concat(F.lit("value_"), k.cast("string"))))
    slots = F.when(action, F.map_from_arrays(names, "values")).otherwise(V.no_scalars())
    said = F.when(action, "action").when(F.col("speaker") == "customer", "customer").otherwise("agent")
    features = V.present(speaker=S.text(said), button=F.when(action, S.text(F.col("button"))), intent=F.when(opens, S.text(F.col("subflow"))), flow=F.when(opens, S.text(F.col("flow"))))
    events = t.select(
        F.col("id").alias("interaction_id"), F.col("turn").cast("long").alias("ord"), (F.col("started_at") + V.at(F.col("t"), "$.turn_count", "bigint")).alias("at"), features.alias("features"), slots.alias("slots"),
        F.lit(None).cast("string").alias("result"), F.struct("file", F.concat(F.lit("/"), "split", F.lit("/"), "no", F.lit("/delexed/"), "turn").alias("path")).alias("raw"),
    )
    facts = {name.replace(".", "__"): V.scalar_of(V.at(F.col("c"), f"$.scenario.{at}", "variant")) for name, at in SCENARIO}
    facts = V.present(**{k: F.when(~(x["t"].eqNullSafe("z") | x["v"].eqNullSafe("")), x) for k, x in facts.items()})
    hints = V.present(split=S.text(F.col("split")), flow=_text(F.col("flow")), subflow=_text(F.col("subflow")), expected_episodes=S.literal(1))
    interactions = c.select("id", F.lit("abcd").alias("corpus"), actor(F.lit("abcd")).alias("actor"), "started_at", outcome(F.lit(None).cast("string"), F.lit(0), F.lit(0), "in_band").alias("outcome"), facts.alias("facts"), hints.alias("hints"))
    return RawCorpus(interactions, events)


#: The domains that a file name may tell.
_DOMAIN = r"_(airline|retail|telecom(?:-workflow)?|banking_knowledge|mock)_"


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def read_simulations(spark: SparkSession, source: str) -> RawCorpus:
    """Tool-use simulations: one file, or a folder of them, whose ids then tell their model."""
    several = Path(source).is_dir()
    doc = _document(spark, f"{source}/*.json" if several else source)
    d = F.col("doc")
    domain = F.coalesce(_blank(V.text_at(d, "$.info.environment_info.domain_name")), _blank(V.text_at(d, "$.tasks[0].user_scenario.instructions.domain")), _blank(F.regexp_extract("file", _DOMAIN, 1)), F.lit("unknown"))
    doc = doc.select("file", "doc", domain.alias("domain"), F.coalesce(V.text_at(d, "$.info.agent_info.llm"), F.lit("unknown")).alias("model"))
    s = _items(doc, V.at(d, "$.simulations", "variant"), "no", "s", "file", "domain", "model")
    v = F.col("s")
    whole = lambda path: V.scalar_of(V.at(v, path, "variant"))
    s = s.select("file", "domain", "model", "no", "s", whole("$.task_id").alias("task"), whole("$.trial").alias("trial"), V.text_at(v, "$.termination_reason").alias("ended"), V.at(v, "$.reward_info.reward", "double").alias("reward"), F.coalesce(V.epoch_millis(_blank(V.text_at(v, "$.start_time"))), F.col("no").cast("long") * 1_000_000).alias("started_at"))
    base = F.concat(F.lit("tau2-"), "domain", F.lit("-"), F.col("task.v"), F.lit("-"), F.col("trial.v"))
    s = s.withColumn("id", F.concat(base, F.lit("-"), "model") if several else base)
    m = _items(s, V.at(F.col("s"), "$.messages", "variant"), "message", "m", "file", "id", "no", "started_at")
    # a message without a time comes a second after the one before it
    m = m.withColumn("ms", V.epoch_millis(_blank(V.text_at(F.col("m"), "$.timestamp"))))
    w = Window.partitionBy("file", "no").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("known", F.last(F.when(F.col("ms").isNotNull(), F.col("message")), ignorenulls=True).over(w)).withColumn("from", F.coalesce(F.last("ms", ignorenulls=True).over(w), "started_at"))
    m = m.withColumn("at", F.col("from") + (F.col("message") - F.coalesce("known", F.lit(-1))) * 1000)
    role = V.text_at(F.col("m"), "$.role")
    calls = F.when(role == "assistant", V.at(F.col("m"), "$.tool_calls", "variant").try_cast("array<variant>"))
    c = m.withColumn("role", role).withColumn("calls", F.when(F.size(calls) > 0, calls)).select("file", "id", "no", "message", "m", "at", "role", F.posexplode_outer("calls").alias("call", "c"))
    c = c.where("role in ('assistant', 'user', 'tool')")
    acts = F.col("c").isNotNull()
    said = F.when(acts, "action").when(F.col("role") == "assistant", "agent").when(F.col("role") == "user", "customer").otherwise("system")
    tool = F.col("role") == "tool"
    features = V.present(speaker=S.text(said), tool=F.when(acts, S.text(V.text_at(F.col("c"), "$.name"))), event=F.when(tool, S.literal("tool_result")))
    pointer = F.concat(F.lit("/simulations/"), "no", F.lit("/messages/"), "message", F.when(acts, F.concat(F.lit("/tool_calls/"), "call")).otherwise(""))
    failed = F.coalesce(V.at(F.col("m"), "$.error", "boolean"), F.lit(False))
    events = c.select(
        F.col("id").alias("interaction_id"), (F.row_number().over(Window.partitionBy("file", "no").orderBy("message", "call")) - 1).cast("long").alias("ord"), (F.col("at") + F.coalesce("call", F.lit(0))).alias("at"), features.alias("features"),
        F.when(acts, V.scalars_of(V.at(F.col("c"), "$.arguments", "variant"))).otherwise(V.no_scalars()).alias("slots"), F.when(tool, F.when(failed, "failed").otherwise("ok")).alias("result"), F.struct("file", pointer.alias("path")).alias("raw"),
    )
    last = events.groupBy("interaction_id").agg(F.max_by("at", "ord").alias("last"))
    s = s.join(last, s["id"] == last["interaction_id"], "left")
    hints = V.present(task_id=F.col("task"), trial=F.col("trial"), backbone=S.text(F.col("model")), termination=_text(F.col("ended")), expected_episodes=S.literal(1), reward=F.when(F.col("reward").isNotNull(), S.number(F.col("reward"))))
    label = F.when(F.col("reward") >= 1, "resolved").when(F.col("reward").isNotNull(), "failed")
    interactions = s.select("id", F.concat(F.lit("tau2-"), "domain").alias("corpus"), actor(F.concat(F.lit("tau2:"), "domain"), F.col("model")).alias("actor"), "started_at", outcome(label, F.coalesce("last", "started_at"), F.lit(0), "external").alias("outcome"), F.lit(None).cast(S.SCALARS).alias("facts"), hints.alias("hints"))
    return RawCorpus(interactions, events, simulation_meta(doc))


def simulation_meta(doc: DataFrame) -> dict[str, str]:
    """The models, the simulated user, the domain, and the benchmark's commit and seed; of a folder its models and how many files."""
    d = F.col("doc")
    rows = doc.orderBy("file").select("model", "domain", V.text_at(d, "$.info.user_info.llm").alias("user"), V.text_at(d, "$.info.git_commit").alias("commit"), V.scalar_of(V.at(d, "$.info.seed", "variant"))["v"].alias("seed")).collect()
    if not rows:
        return {}
    if len(rows) > 1:
        return {"backbone": "+".join(r["model"] for r in rows), "domain": rows[0]["domain"], "files": str(len(rows))}
    r = rows[0]
    out = {"backbone": r["model"], "userSimulator": r["user"] or "unknown", "domain": r["domain"]}
    return out | {k: r[c] for k, c in (("benchmarkCommit", "commit"), ("benchmarkSeed", "seed")) if r[c]}
