"""Loan applications as an XES process log: traces are cut out of the text, plain or gzipped, without an XML tree."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import variants as V
from .raw import RawCorpus, actor, outcome

# Activities that end an application, and the entities of XML.
OUTCOMES = {"A_Pending": "accepted", "A_Denied": "declined", "A_Cancelled": "cancelled"}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def attribute(xml: Column, key: str) -> Column:
    """The value of the last attribute element with that key; null if there is none."""
    found = F.regexp_extract(xml, rf'(?s).*(<(?:string|date|float|int|boolean) key="{key}" value="[^"]*"/?>)', 1)
    value = F.regexp_replace(F.regexp_extract(found, r'value="([^"]*)"', 1), "&amp;", "&")
    for entity, c in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(c))
    return F.when(found != "", value)


def read(spark: SparkSession, source: str) -> RawCorpus:
    """Traces as interactions; a plain file is cut at the ends of its traces and so read by several tasks."""
    t = spark.read.option("lineSep", "</trace>").text(source).select(V.plain_path(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("mark"), F.regexp_extract("value", r"(?s).*<trace>(.*)$", 1).alias("xml"))
    t = t.where("xml != ''").withColumn("part", F.shiftright("mark", 33))
    # numbers of traces: counted by part, then within it
    sizes = t.groupBy("file", "part").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.join(F.broadcast(sizes.select("file", "part", before.alias("first"))), ["file", "part"])
    t = t.withColumn("no", F.col("first") + F.row_number().over(Window.partitionBy("file", "part").orderBy("mark")) - 1)
    head = F.substring_index("xml", "<event>", 1)
    t = t.withColumn("id", F.coalesce(attribute(head, "concept:name"), F.concat(F.lit("trace-"), F.col("no").cast("string"))))
    e = t.select("file", "id", "no", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<event>(.*?)</event>"), F.lit(1))).alias("k", "x"))
    got = lambda key: attribute(F.col("x"), key)
    e = e.select("file", "id", "no", "k", F.coalesce(V.epoch_millis(got("time:timestamp")), F.lit(0).cast("long")).alias("at"), F.coalesce(got("concept:name"), F.lit("unknown")).alias("name"), F.coalesce(got("lifecycle:transition"), F.lit("")).alias("lifecycle"), F.coalesce(got("EventOrigin"), F.lit("")).alias("origin"), F.nullif(got("org:resource"), F.lit("")).alias("resource"), *(F.nullif(got(a), F.lit("")).alias(a) for a in ("Action", "OfferedAmount", "NumberOfTerms", "Accepted", "Selected")))
    some = lambda c, made: F.when(F.col(c).isNotNull(), made)
    truth = lambda c: some(c, S.boolean((F.col(c) == "true").cast("string")))
    slots = V.present(action=some("Action", S.text(F.col("Action"))), offered_amount=some("OfferedAmount", S.number(F.col("OfferedAmount").try_cast("double"))), number_of_terms=some("NumberOfTerms", S.number(F.col("NumberOfTerms").try_cast("double"))), accepted=truth("Accepted"), selected=truth("Selected"))
    features = V.present(speaker=S.literal("action"), name=S.text(F.col("name")), lifecycle=S.text(F.col("lifecycle")), origin=S.text(F.col("origin")))
    events = e.select(F.col("id").alias("interaction_id"), F.col("k").cast("long").alias("ord"), "at", features.alias("features"), slots.alias("slots"), F.lit(None).cast("string").alias("result"), F.struct("file", F.concat(F.lit("/trace/"), "no", F.lit("/event/"), "k").alias("path")).alias("raw"))
    ends = F.when(F.col("name").isin(*OUTCOMES) & (F.col("lifecycle") == "complete"), F.col("k"))
    per = e.groupBy("file", "no").agg(F.min_by("at", "k").alias("started_at"), F.max_by("name", ends).alias("end"), F.max_by("at", ends).alias("end_at"))
    agent = e.where("resource is not null").groupBy("file", "no", "resource").agg(F.count(F.lit(1)).alias("n")).groupBy("file", "no").agg(F.min_by("resource", F.struct(-F.col("n"), "resource")).alias("agent"))
    i = t.withColumn("head", head).join(per, ["file", "no"], "left").join(agent, ["file", "no"], "left").withColumn("started_at", F.coalesce("started_at", F.lit(0).cast("long")))
    label = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))[F.col("end")]
    fact = lambda key, make: F.when(F.length(F.coalesce(attribute(F.col("head"), key), F.lit(""))) > 0, make(attribute(F.col("head"), key)))
    facts = V.present(application__type=fact("ApplicationType", S.text), application__goal=fact("LoanGoal", S.text), application__requested_amount=fact("RequestedAmount", lambda c: S.number(c.try_cast("double"))))
    interactions = i.select("id", F.lit("bpic2017").alias("corpus"), actor(F.lit("bpic2017"), agent=F.col("agent")).alias("actor"), "started_at", outcome(label, F.col("end_at"), F.col("end_at") - F.col("started_at"), "in_band").alias("outcome"), facts.alias("facts"), F.create_map(F.lit("expected_episodes"), S.literal(1)).alias("hints"))
    return RawCorpus(interactions, events)
