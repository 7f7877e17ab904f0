"""Agent transcripts: one JSON record per line, one file per session, one folder per project.

A session's records become events: a customer's prompt, an agent's text, a tool's
result, and one action per tool call, a shell command giving one for each of its
segments. Lines that are no JSON are skipped; sessions without an action are
dropped. All figures of a session come from aggregates over its records, so that a
session is never gathered beyond its own file.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.text import shell_parts
from . import variants as V
from .raw import RawCorpus, actor, outcome

# What the transcripts themselves say.
INTERRUPT = r"(?i)\[Request interrupted"
DEFAULT_BRANCHES = ("master", "main", "trunk")
SHELLS = ("Bash", "PowerShell")


def project_of(folder: Column) -> Column:
    """A project's name: what follows ``-code-``, else the folder without the user's own path."""
    named = F.regexp_extract(folder, r"-code-(.+)$", 1)
    return F.when(named != "", named).otherwise(F.regexp_replace(folder, r"^-?([A-Za-z]--)?(Users|home)-[^-]+-", ""))


def carried(value: Column, keys: list[str], *order: str) -> Column:
    """The last value that is not null up to and with the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def nudged(at: Column, ordinal: Column, keys: list[str], *order: str) -> Column:
    """Times made strictly increasing: each at least one more than the one before it."""
    return ordinal + F.max(at - ordinal).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def extension(file: Column) -> Column:
    """A file name's extension in lower case; (none) without one, as for names that begin with their only dot."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(file, r"([^/]*)/*$", 1), r"^.+(\.[^.]*)$", 1))
    return F.when(ext == "", "(none)").otherwise(ext)


def records(texts: DataFrame) -> DataFrame:
    """(file, project, line, at, …) of every line that is not empty; ``texts``: file, project, text.

    A line that is no JSON record says nothing, so that no event comes of it; a filter here would parse each line twice.
    """
    lines = texts.select("file", "project", F.posexplode(F.split("text", "\n")).alias("line", "value")).where("value != ''")
    r = lines.withColumn("v", F.try_parse_json("value")).drop("value")
    v = F.col("v")
    r = r.select(
        "file", "project", "line", V.epoch_millis(V.text_at(v, "$.timestamp")).alias("ms"), V.text_at(v, "$.sessionId").alias("session"), V.text_at(v, "$.version").alias("version"),
        V.text_at(v, "$.entrypoint").alias("entrypoint"), V.text_at(v, "$.gitBranch").alias("branch"), F.nullif(V.text_at(v, "$.promptId"), F.lit("")).alias("prompt"),
        F.nullif(V.text_at(v, "$.message.model"), F.lit("")).alias("model"), V.text_at(v, "$.type").alias("kind"), F.coalesce(V.at(v, "$.isMeta", "boolean"), F.lit(False)).alias("meta"),
        V.text_at(v, "$.message.role").alias("role"), V.at(v, "$.message.content", "variant").alias("content"),
    )
    return r.withColumn("at", F.coalesce(carried(F.col("ms"), ["file"], "line"), F.lit(0).cast("long")))


def blocks(r: DataFrame) -> DataFrame:
    """The blocks of ``records``, one at least of each, with what event each is; null if none."""
    is_text = V.kind_of(F.col("content")) == "STRING"
    said = F.when(is_text, F.col("content").try_cast("string"))
    several = F.when(V.kind_of(F.col("content")).startswith("ARRAY"), F.col("content").try_cast("array<variant>"))
    b = r.select(*(c for c in r.columns if c != "content"), said.alias("said"), F.posexplode_outer(several).alias("block", "b"))
    v = F.col("b")
    b = b.select(
        "*", V.text_at(v, "$.type").alias("b_type"), F.nullif(V.text_at(v, "$.name"), F.lit("")).alias("tool"), V.text_at(v, "$.text").alias("b_text"), F.coalesce(V.at(v, "$.is_error", "boolean"), F.lit(False)).alias("failed"),
        V.text_at(v, "$.input.command").alias("command"), F.nullif(F.coalesce(V.text_at(v, "$.input.file_path"), V.text_at(v, "$.input.notebook_path")), F.lit("")).alias("path"),
        V.text_at(v, "$.input.subagent_type").alias("subagent"), V.text_at(v, "$.input.skill").alias("skill"),
    ).drop("b")
    text_event = F.col("said").isNotNull() & ~F.col("meta")
    stopped = F.coalesce(F.col("said").rlike(INTERRUPT), F.lit(False))
    is_result = F.col("b_type") == "tool_result"
    is_agent = (F.col("b_type") == "text") & (F.col("role") == "assistant")
    is_call = (F.col("b_type") == "tool_use") & F.col("tool").isNotNull()
    what = (
        F.when(text_event & stopped, "interrupt").when(text_event & (F.col("kind") == "user"), "customer")
        .when(is_result, "tool_result").when(is_agent, "agent").when(is_call, "action")
    )
    stops = (F.col("what") == "interrupt") | ((F.col("what") == "agent") & F.coalesce(F.col("b_text").rlike(INTERRUPT), F.lit(False)))
    return b.withColumn("what", what).withColumn("stops", stops)


def raw_events(b: DataFrame) -> DataFrame:
    """The events of ``blocks``."""
    b = b.where("what is not null")
    shell = F.coalesce(F.col("tool").isin(*SHELLS) & F.col("command").isNotNull() & (F.col("what") == "action"), F.lit(False))
    # one pass for shell commands and all else: the splitter gets a null for what is no command; a plain explode would have it run again, in a filter on its result
    parts = b.withColumn("shell", shell).withColumn("parts", shell_parts(F.when(F.col("shell"), F.col("command"))))
    e = parts.select("*", F.posexplode_outer(F.when(F.col("shell"), F.col("parts"))).alias("part", "p")).drop("parts").withColumn("part", F.coalesce("part", F.lit(0)))
    speaker = F.when(F.col("what").isin("interrupt", "tool_result"), "system").otherwise(F.col("what"))
    some = lambda c, ok: F.when(ok & c.isNotNull(), S.text(c))
    action = F.col("what") == "action"
    features = V.present(
        speaker=S.text(speaker), event=F.when(F.col("what").isin("interrupt", "tool_result"), S.text(F.col("what"))), tool=some(F.col("tool"), action), verb=some(F.col("p.verb"), action), sub=some(F.col("p.sub"), action),
        skill=some(F.nullif(F.col("skill"), F.lit("")), action & (F.col("tool") == "Skill")),
    )
    plain = action & F.col("p").isNull()
    slots = V.present(file=some(F.col("path"), plain), ext=some(extension(F.col("path")), plain & F.col("path").isNotNull()), subagent_type=some(F.col("subagent"), plain & (F.col("tool") == "Agent")), skill=some(F.col("skill"), plain & (F.col("tool") == "Skill")))
    pointer = F.concat(F.lit("/"), F.col("line").cast("string"), F.coalesce(F.concat(F.lit("/content/"), F.col("block").cast("string")), F.lit("")), F.when(F.coalesce(F.col("p.segment") != "", F.lit(False)), F.concat(F.lit("/segment/"), F.col("part").cast("string"))).otherwise(""))
    order = ["line", "block", "part"]  # of both windows, so that rows are sorted once; a null block comes first
    e = e.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("long") - 1)
    return e.select(
        "file", "project", "ord", "what", nudged(F.col("at"), F.col("ord"), ["file"], *order).alias("at"), features.alias("features"), slots.alias("slots"),
        result_of().alias("result"), F.struct("file", pointer.alias("path")).alias("raw"),
    )


def result_of() -> Column:
    """What a tool's result says, of ``blocks``."""
    return F.when(F.col("what") == "tool_result", F.when(F.col("failed"), "failed").otherwise("ok"))


def sessions(b: DataFrame) -> DataFrame:
    """One interaction for each session with an action, from its ``blocks`` in one pass."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    first_block = F.coalesce("block", F.lit(0)) == 0
    done = F.col("what") == "tool_result"
    s = b.groupBy("file", "project").agg(
        first("session").alias("session"), first("version").alias("version"), first("entrypoint").alias("entrypoint"), first("branch").alias("branch"), F.size(F.collect_set("prompt")).alias("prompts"),
        F.size(F.collect_set("model")).alias("models"), F.mode(F.when(first_block, F.col("model")), True).alias("model"), F.min_by("ms", F.when(F.col("ms") != 0, F.col("line"))).alias("started"),
        F.coalesce(F.max_by("ms", F.when(F.col("ms").isNotNull(), F.col("line"))), F.lit(0).cast("long")).alias("last"), F.bool_or(F.col("what") == "action").alias("acts"), F.bool_or("stops").alias("stopped"),
        F.sum((done & F.col("failed")).cast("long")).alias("errors"), F.max_by(result_of(), F.when(done, F.struct("line", F.coalesce("block", F.lit(-1))))).alias("last_result"),
    ).where("acts")
    name = F.regexp_extract("file", r"([^/]*?)(\.jsonl)?$", 1)
    s = s.withColumn("base", F.concat(F.lit("cc-"), "project", F.lit("-"), F.substring(F.coalesce("session", name), 1, 8)))
    n = F.row_number().over(Window.partitionBy("base").orderBy("file")) - 1
    s = s.withColumn("id", F.when(n > 0, F.concat("base", F.lit("-"), n.cast("string"))).otherwise(F.col("base")))
    started = F.coalesce("started", F.lit(0).cast("long"))
    label = F.when(F.col("stopped"), "interrupted").when(F.col("last_result") == "failed", "failed").otherwise("resolved")
    facts = V.present(project__name=S.text(F.col("project")), git__branch=F.when(F.col("branch").isNotNull(), S.text(F.col("branch"))), git__on_default=F.when(F.col("branch").isNotNull(), S.boolean(F.col("branch").isin(*DEFAULT_BRANCHES).cast("string"))), session__entrypoint=F.when(F.col("entrypoint") != "", S.text(F.col("entrypoint"))))
    hints = V.present(expected_episodes=S.number(F.greatest("prompts", F.lit(1))), models=S.number(F.col("models")), model=F.when(F.col("model").isNotNull(), S.text(F.col("model"))), cliVersion=F.when(F.col("version") != "", S.text(F.col("version"))), errors=S.number(F.col("errors")), interrupted=S.boolean(F.col("stopped").cast("string")))
    ended = F.when(F.col("last") != 0, F.col("last")).otherwise(started)
    return s.select("file", "id", F.lit("cc").alias("corpus"), actor(F.col("project"), agent=F.col("model")).alias("actor"), started.alias("started_at"), outcome(label, ended, F.lit(0), "in_band").alias("outcome"), facts.alias("facts"), hints.alias("hints"))


def scan(texts: DataFrame) -> RawCorpus:
    """The sessions and events of transcripts given as (file, project, text)."""
    r = records(texts)
    b = blocks(r)
    e, s = raw_events(b), sessions(b)
    events = e.join(s.select("file", F.col("id").alias("interaction_id")), "file").select("interaction_id", "ord", "at", "features", "slots", "result", "raw")
    return RawCorpus(s.drop("file"), events)


def read(spark: SparkSession, source: str) -> RawCorpus:
    """A folder ``<project>/<session>.jsonl``, or one file."""
    one = Path(source).is_file()
    texts = V.whole_files(spark, source if one else f"{source}/*/*.jsonl")
    folder = F.regexp_extract("file", r"([^/]*?)(\.jsonl)?$", 1) if one else F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    out = scan(texts.select("file", project_of(folder).alias("project"), "text"))
    out.meta = meta(source)
    return out


def meta(source: str) -> dict[str, str]:
    """How many transcripts there are, and what a SOURCE.json beside them says."""
    root = Path(source)
    out = {"transcripts": str(1 if root.is_file() else len(list(root.glob("*/*.jsonl"))))}
    register = root / "SOURCE.json"
    if root.is_dir() and register.exists():
        said = json.loads(register.read_text())
        out |= {k: str(said[k]) for k in ("takenAt", "projects") if said.get(k) is not None}
    return out
