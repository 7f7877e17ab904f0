"""The driver's tables as event logs, with the rules that the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.check import parse_contracts
from ..operators.segment import segment
from ..sources.raw import OUTCOME, RawCorpus, actor
from .alphabet import apply, parse_alphabet
from .corpus import build

EVENTS_ALPHABET = """
corpus: events
version: 1
default_kinds: {customer: customer_utterance, action: action, system: system}
event_types:
  - {id: "intent:signup", match: {speaker: customer, name: signup}, kind: customer_intent}
  - {id: "action:view", match: {speaker: action, name: view}, consequence: none, slots: [k]}
  - {id: "action:click", match: {speaker: action, name: [click, tap]}, consequence: reversible}
  - {id: "action:purchase", match: {speaker: action, name: {pattern: "^purch"}}, consequence: irreversible, recommendable: true, label: buying}
  - {id: "system:${name}", match: {speaker: system}}
outcomes:
  - {label: bought, any_event: "action:purchase"}
  - {label: passed by, closed_without: "action:click"}
  - {label: stuck, result: failed}
  - {label: even, hint: even, equals: true}
"""

EVENTS_CONTRACTS = """
name: shop
version: 1
clauses:
  - {id: view-before-purchase, text: a purchase comes after a view, shape: precedence, subject: "action:purchase", guard: "action:view"}
  - {id: click-before-purchase, text: a purchase comes after a click in the session, shape: precedence, subject: "action:purchase", guard: "action:click", window: interaction}
  - {id: one-purchase, text: one purchase per episode, shape: at-most-one, subject: "action:purchase"}
  - {id: view-after-low-k, text: after a low k a purchase needs a view, shape: precedence, subject: "action:purchase", guard: "action:view", when: {fact: slot.k, lt: 50}}
  - {id: click-first, text: clicks are no subjects, shape: precedence, subject: "action:click", guard: "action:view"}
  - {id: polite, text: be polite, expressible: false, reason: tone is not an event}
"""


REDACTING = """
corpus: shop
version: 1
event_types: []
redaction:
  - {slot: name, strategy: token}
  - {slot: segment, strategy: hash, unless: [building, machinery]}
  - {slot: nation, strategy: drop, unless_pattern: "^[0-9]$"}
  - {slot: gone, strategy: drop}
  - {pattern: digits, strategy: token}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_millis(ts):
    """Milliseconds since 1970 of a timestamp without zone, read as UTC whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: a user is an interaction."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    speaker = F.when(F.col("event_type") == "signup", "customer").when(F.col("event_type") == "error", "system").otherwise("action")
    features = F.create_map(F.lit("speaker"), S.text(speaker), F.lit("name"), S.text(F.col("event_type")))
    slots = F.create_map(F.lit("amount"), S.number(F.col("value")), F.lit("k"), S.number(F.get_json_object("props", "$.k").cast("double")))
    return e.select(
        F.col("user_id").cast("string").alias("interaction_id"), F.struct("ts", "event_id").alias("ord"), epoch_millis(F.col("ts")).alias("at"),
        features.alias("features"), slots.alias("slots"), F.when(F.col("event_type") == "error", "failed").alias("result"), "event_id",
    )


def typed_events(spark: SparkSession, sf_dir: str):
    alphabet = parse_alphabet(EVENTS_ALPHABET)
    return alphabet, apply(alphabet, raw_events(spark, sf_dir))


def episodes(spark: SparkSession, sf_dir: str):
    alphabet, events = typed_events(spark, sf_dir)
    return alphabet, segment(events, "intent")


def corpus(spark: SparkSession, sf_dir: str):
    """events as a corpus: a user is an interaction and its own agent, in one of five teams, and says how many intents it has."""
    e = raw_events(spark, sf_dir).withColumn("raw", F.struct(F.lit("events").alias("file"), F.concat(F.lit("/"), F.col("event_id").cast("string")).alias("path")))
    per = e.groupBy("interaction_id").agg(F.min("at").alias("started_at"), F.sum((F.col("features")["speaker"]["v"] == "customer").cast("int")).alias("intents"))
    user = F.col("interaction_id").cast("long")
    who = actor(F.lit("shop"), F.concat(F.lit("t"), (user % 5).cast("string")), F.concat(F.lit("u"), "interaction_id"))
    hints = F.create_map(F.lit("expected_episodes"), S.number(F.col("intents")), F.lit("even"), S.boolean((user % 2 == 0).cast("string")))
    interactions = per.select(F.col("interaction_id").alias("id"), F.lit("events").alias("corpus"), who.alias("actor"), "started_at", F.lit(None).cast(OUTCOME).alias("outcome"), F.lit(None).cast(S.SCALARS).alias("facts"), hints.alias("hints"))
    return build(RawCorpus(interactions, e), parse_alphabet(EVENTS_ALPHABET), "events", validate=False)


def event_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events written out as transcripts (file, project, text): a user is a session, its events are its lines."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    call = lambda name, **given: F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(name).alias("name"), F.struct(*(F.lit(v).alias(k) for k, v in given.items())).alias("input")))
    content = (
        F.when(F.col("event_type") == "signup", F.lit('"please"'))
        .when(F.col("event_type") == "view", F.to_json(call("Read", file_path="/docs/a.MD"))).when(F.col("event_type") == "purchase", F.to_json(call("Edit", file_path="/docs/b.md")))
        .when(F.col("event_type") == "click", F.to_json(call("Bash", command="git status; git push origin")))
        .otherwise(F.lit('[{"type":"tool_result","is_error":true}]'))
    )
    said = F.col("event_type").isin("signup", "error")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    model = F.when(said, "").otherwise(F.concat(F.lit(',"model":"m-'), (F.col("user_id") % 3).cast("string"), F.lit('"')))
    prompt = F.when(F.col("event_type") == "signup", F.concat(F.lit(',"promptId":"p'), F.col("event_id").cast("string"), F.lit('"'))).otherwise("")
    session = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 7, "0"))
    line = F.concat(
        F.lit('{"type":"'), F.when(said, "user").otherwise("assistant"), F.lit('","sessionId":"'), session, F.lit('","gitBranch":"main","timestamp":"'), iso, F.lit('"'), prompt, F.lit(',"message":{"role":"'),
        F.when(said, "user").otherwise("assistant"), F.lit('"'), model, F.lit(',"content":'), content, F.lit("}}"),
    )
    lines = F.array_sort(F.collect_list(F.struct("ts", "event_id", line.alias("line"))))
    return e.groupBy("user_id").agg(lines.alias("lines")).select(F.concat(F.lit("/shop/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file"), F.lit("shop").alias("project"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def contracts():
    return parse_contracts(EVENTS_CONTRACTS)
