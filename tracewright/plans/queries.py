"""The registered queries of the event-log engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, calibrate, check, record, report
from ..operators import text as texts
from ..sources import observations, transcripts
from ..sources import texts as raw_texts
from . import bindings as B
from . import predicates
from .alphabet import classify, redact, shape

#: DuckDB's view of the typed, segmented log over events.
_EV = """
WITH ev0 AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS interaction_id, epoch_us(ts) // 1000 AS at_ms, event_type AS name, value AS amount, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE event_type WHEN 'signup' THEN 'customer' WHEN 'error' THEN 'system' ELSE 'action' END AS speaker,
         CASE event_type WHEN 'error' THEN 'failed' END AS result,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM events
), ev1 AS (
  SELECT *, CASE name WHEN 'signup' THEN 'intent:signup' WHEN 'error' THEN 'system:error' ELSE 'action:' || name END AS type,
         CASE name WHEN 'signup' THEN 'customer_intent' WHEN 'error' THEN 'system' ELSE 'action' END AS kind FROM ev0
), ev2 AS (
  SELECT *, kind = 'customer_intent' AS edge, lag(kind = 'customer_intent') OVER (PARTITION BY interaction_id ORDER BY seq) AS before FROM ev1
), ev3 AS (
  SELECT *, CASE WHEN NOT edge THEN sum(CASE WHEN NOT edge AND coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY interaction_id ORDER BY seq) - 1 END AS no FROM ev2
), ev AS (
  SELECT *, interaction_id || '#' || CAST(coalesce(no, first_value(no IGNORE NULLS) OVER (PARTITION BY interaction_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         max(no) OVER (PARTITION BY interaction_id), 0) AS BIGINT) AS episode FROM ev3
)
"""

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(_EV + "SELECT event_id, CAST(list_position(['intent:signup','action:view','action:click','action:purchase','system:error'], type) - 1 AS INTEGER) AS type_no FROM ev")
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet = B.parse_alphabet(B.EVENTS_ALPHABET)
    return B.raw_events(spark, sf_dir).select("event_id", classify(alphabet, F.col("features")).alias("type_no"))


@query(_EV + "SELECT event_id, type, kind FROM ev")
def template_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.typed_events(spark, sf_dir)[1].select("event_id", "type", "kind")


@query(_EV + "SELECT event_id, interaction_id, seq, at_ms FROM ev")
def seq_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.typed_events(spark, sf_dir)[1].select("event_id", "interaction_id", "seq", F.col("at").alias("at_ms"))


@query(_EV + "SELECT event_id, CASE WHEN type = 'action:view' THEN 'k' ELSE 'amount,k' END AS kept, CASE WHEN k = floor(k) THEN CAST(CAST(k AS BIGINT) AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS k FROM ev")
def slot_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.typed_events(spark, sf_dir)[1]
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys("slots")), ",").alias("kept"), F.col("slots")["k"]["v"].alias("k"))


_PARTIAL = """
corpus: events
version: 1
default_kinds: {customer: customer_utterance, action: action, system: system}
event_types:
  - {id: "intent:signup", match: {speaker: customer}, kind: customer_intent}
  - {id: "action:view", match: {name: view}, kind: action, consequence: none}
"""


@query("SELECT 'name=' || event_type || ' speaker=' || CASE event_type WHEN 'error' THEN 'system' ELSE 'action' END AS shape, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'view') GROUP BY 1")
def unknown_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = B.raw_events(spark, sf_dir).where(classify(B.parse_alphabet(_PARTIAL), F.col("features")).isNull())
    return missed.groupBy(shape(F.col("features")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS events, count(*) FILTER (event_type NOT IN ('signup', 'view')) AS unknown, count(*) FILTER (event_type NOT IN ('signup', 'view')) / count(*) AS rate, count(*) FILTER (event_type NOT IN ('signup', 'view')) / count(*) > 0.2 AS refused FROM events")
def unknown_rate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unknown_rate(B.apply(B.parse_alphabet(_PARTIAL), B.raw_events(spark, sf_dir)))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'customer_intent' WHEN 'error' THEN 'system' ELSE 'action' END AS kind FROM events")
def kind_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.apply(B.parse_alphabet(_PARTIAL), B.raw_events(spark, sf_dir)).select("event_id", "kind")


@query(_EV + "SELECT event_id, interaction_id || '#0' AS episode FROM ev")
def segment_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.segment(B.typed_events(spark, sf_dir)[1], "null").select("event_id", "episode")


@query(_EV + "SELECT event_id, episode FROM ev")
def segment_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.episodes(spark, sf_dir)[1].select("event_id", "episode")


@query(_EV + ", q AS (SELECT *, at_ms - seq AS d FROM ev) SELECT event_id, seq + max(d) OVER (PARTITION BY interaction_id ORDER BY seq) AS at_ms FROM q")
def monotone_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.typed_events(spark, sf_dir)[1].select("event_id", transcripts.nudged(F.col("at"), F.col("seq"), ["interaction_id"], "seq").alias("at_ms"))


@query(_EV + "SELECT event_id, coalesce(last_value(CASE WHEN kind = 'action' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY interaction_id ORDER BY seq), 0) AS at_ms FROM ev")
def carry_forward_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("kind") == "action", F.col("at"))
    return B.typed_events(spark, sf_dir)[1].select("event_id", F.coalesce(transcripts.carried(known, ["interaction_id"], "seq"), F.lit(0).cast("long")).alias("at_ms"))


@query(_EV + "SELECT * FROM (SELECT event_id, type, count(*) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (PARTITION BY interaction_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS session_before, count(*) OVER (PARTITION BY interaction_id, episode) AS all_events, count(*) OVER (e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM ev WINDOW e AS (PARTITION BY interaction_id, episode ORDER BY seq)) WHERE type = 'action:purchase'")
def subject_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of an instance's four windows; the events in them are never gathered."""
    alphabet, e = B.episodes(spark, sf_dir)
    episode = Window.partitionBy("interaction_id", "episode")
    w, s = episode.orderBy("seq"), Window.partitionBy("interaction_id").orderBy("seq")
    n = F.count(F.lit(1))
    out = e.select(
        "event_id", "type", n.over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), n.over(s.rowsBetween(Window.unboundedPreceding, -1)).alias("session_before"),
        n.over(episode).alias("all_events"), n.over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    return out.where(F.col("type").isin(alphabet.consequential()))


_CLAUSES = _EV + """, g AS (
  SELECT *, min(CASE WHEN type = 'action:view' THEN seq END) OVER (PARTITION BY interaction_id, episode) AS view_at, min(CASE WHEN type = 'action:click' THEN seq END) OVER (PARTITION BY interaction_id) AS click_at,
         count(*) FILTER (type = 'action:purchase') OVER (PARTITION BY interaction_id, episode) AS n_buy,
         last_value(CASE WHEN k = floor(k) THEN k END IGNORE NULLS) OVER (PARTITION BY interaction_id, episode ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k0 FROM ev
), s AS (SELECT * FROM g WHERE type = 'action:purchase'), v AS (
  SELECT 0 AS no, 'view-before-purchase' AS clause, interaction_id, episode, seq, NOT coalesce(view_at < seq, false) AS violated FROM s
  UNION ALL SELECT 1, 'click-before-purchase', interaction_id, episode, seq, NOT coalesce(click_at < seq, false) FROM s
  UNION ALL SELECT 2, 'one-purchase', interaction_id, episode, seq, n_buy > 1 FROM s
  UNION ALL SELECT 3, 'view-after-low-k', interaction_id, episode, seq, NOT coalesce(view_at < seq, false) FROM s WHERE k0 < 50
), x AS (
  SELECT no, clause, count(*) AS exercised, CAST(CASE WHEN no = 2 THEN count(DISTINCT CASE WHEN violated THEN episode END) ELSE count(*) FILTER (violated) END AS BIGINT) AS violated FROM v GROUP BY 1, 2
  UNION ALL SELECT 4, 'click-first', 0, 0
)
"""


def _exercise(spark, sf_dir):
    alphabet, e = B.episodes(spark, sf_dir)
    return check.exercise(e, B.contracts(), alphabet)


@query(_CLAUSES + "SELECT clause, exercised, violated FROM x WHERE clause = 'view-before-purchase'")
def precedence_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exercise(spark, sf_dir).where("clause = 'view-before-purchase'").select("clause", "exercised", "violated")


@query(_CLAUSES + "SELECT clause, exercised, violated FROM x WHERE clause = 'click-before-purchase'")
def precedence_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exercise(spark, sf_dir).where("clause = 'click-before-purchase'").select("clause", "exercised", "violated")


@query(_CLAUSES + "SELECT clause, exercised, violated FROM x WHERE clause = 'one-purchase'")
def at_most_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exercise(spark, sf_dir).where("clause = 'one-purchase'").select("clause", "exercised", "violated")


@query(_CLAUSES + "SELECT clause, exercised, violated FROM x WHERE clause = 'view-after-low-k'")
def when_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exercise(spark, sf_dir).where("clause = 'view-after-low-k'").select("clause", "exercised", "violated")


@query(_CLAUSES + "SELECT clause, exercised, violated, CASE WHEN exercised = 0 THEN 'never_exercised' WHEN violated = 0 THEN 'kept' ELSE 'violated' END AS status, CASE WHEN exercised = 0 THEN 0.0 ELSE violated / exercised END AS ratio FROM x")
def report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check.buckets(_exercise(spark, sf_dir)).drop("no")


@query(_CLAUSES + ", bad AS (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY interaction_id, seq) - 1 AS i, count(*) OVER (PARTITION BY clause) AS n FROM v WHERE violated) SELECT clause, interaction_id, episode, seq FROM bad WHERE n <= 20 OR i IN (SELECT CAST(floor(j * (n - 1) / 19 + 0.5) AS BIGINT) FROM range(20) t(j))")
def violation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet, e = B.episodes(spark, sf_dir)
    bad = check.violations(e, B.contracts(), alphabet).where("violated")
    return check.even_sample(bad, ["interaction_id", "seq"], 20, "clause").select("clause", "interaction_id", "episode", "seq")


@query(_EV + "SELECT event_id, CASE WHEN min(CASE WHEN kind = 'customer_intent' THEN type END) OVER e = max(CASE WHEN kind = 'customer_intent' THEN type END) OVER e THEN min(CASE WHEN kind = 'customer_intent' THEN type END) OVER e END AS intent, last_value(CASE WHEN k = floor(k) THEN CAST(CAST(k AS BIGINT) AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY interaction_id, episode ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM ev WINDOW e AS (PARTITION BY interaction_id, episode)")
def fact_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.episodes(spark, sf_dir)[1]
    return e.select("event_id", check.episode_intent()["v"].alias("intent"), check.last_slot("k")["v"].alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 AS eq, NOT CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 AS neq, CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 2, 3) AS is_in, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS gt, CAST(NULL AS BOOLEAN) AS absent, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) <= 50 THEN false END AS conj FROM events")
def three_valued_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("slots")["k"], F.col("slots")["none"]
    gt, absent = check.condition("gt", k, 50), check.condition("eq", none, 1)
    return B.raw_events(spark, sf_dir).select("event_id", check.condition("eq", k, 7).alias("eq"), check.condition("neq", k, 7).alias("neq"), check.condition("in", k, [1, 2, 3]).alias("is_in"), gt.alias("gt"), absent.alias("absent"), (gt & absent).alias("conj"))


@query(_EV + ", f AS (SELECT *, coalesce(result = 'failed' OR (lead(kind) OVER w = 'system' AND lead(result) OVER w = 'failed'), false) AS failed FROM ev WINDOW w AS (PARTITION BY interaction_id ORDER BY seq)) SELECT type, CASE type WHEN 'action:purchase' THEN 'buying' ELSE substr(type, 8) END AS label, CASE type WHEN 'action:purchase' THEN 'irreversible' WHEN 'action:click' THEN 'reversible' ELSE 'none' END AS consequence, count(*) AS n, count(*) FILTER (failed) AS failed FROM f WHERE kind = 'action' GROUP BY 1, 2, 3")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet, e = B.typed_events(spark, sf_dir)
    return check.inventory(e, alphabet)


@query(_EV + "SELECT type, arg_min(kind, row(at_ms, interaction_id, seq)) AS kind, count(*) AS n, count(DISTINCT interaction_id) AS interactions, CASE type WHEN 'action:view' THEN 'none' WHEN 'intent:signup' THEN 'none' WHEN 'action:click' THEN 'reversible' ELSE 'irreversible' END AS consequence, type = 'action:purchase' AS recommendable FROM ev GROUP BY type")
def audit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet, e = B.typed_events(spark, sf_dir)
    return audit.type_figures(e, alphabet)


@query(_EV + "SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def audit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.kinds(B.typed_events(spark, sf_dir)[1])


@query(_EV + ", p AS (SELECT interaction_id, episode, max(type = 'action:purchase') AS has_any FROM ev GROUP BY 1, 2) SELECT count(*) AS episodes, count(*) / count(DISTINCT interaction_id) AS per_interaction, count(*) FILTER (NOT has_any) / count(*) AS idle_share FROM p")
def episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet, e = B.episodes(spark, sf_dir)
    return audit.episode_stats(e, alphabet)


@query(_EV + "SELECT type, count(*) AS n, count(DISTINCT episode) AS episodes, count(*) >= 5 AS above_floor FROM ev WHERE type = 'action:purchase' GROUP BY type")
def subject_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphabet, e = B.episodes(spark, sf_dir)
    return audit.subject_floor(e, alphabet)


@query(_EV + "SELECT interaction_id, episode, seq, type FROM ev WHERE type = 'system:error'")
def drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.figure_events(B.episodes(spark, sf_dir)[1], "type:system:error").select("interaction_id", "episode", "seq", "type")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'failed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def audit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("failed")
    return B.table(spark, sf_dir, "orders").groupBy(label.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT r_regionkey) AS operators, count(DISTINCT n_nationkey) AS teams, count(DISTINCT c_custkey) AS agents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def audit_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: B.table(spark, sf_dir, n)
    actors = t("orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    actors = actors.join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").join(t("region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey")
    return actors.agg(F.countDistinct("n_regionkey").alias("operators"), F.countDistinct("c_nationkey").alias("teams"), F.countDistinct("c_custkey").alias("agents"))


@query("SELECT c_custkey, 'name#' || substr(sha256('orders' || chr(0) || 'name' || chr(0) || c_name), 1, 12) AS token, 'h#' || substr(sha256(c_name), 1, 24) AS hash FROM customer")
def token_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "customer").select("c_custkey", S.token("orders", "name", F.col("c_name")).alias("token"), S.hashed(F.col("c_name")).alias("hash"))


@query(r"SELECT doc_id, regexp_replace(text, '\d{6,}', '', 'g') AS text FROM documents")
def pattern_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", S.replace_matches(F.col("text"), S.digits(), lambda m: F.lit("")).alias("text"))


TEXT_PROFILE = """
corpus: documents
version: 1
rules:
  - {pattern: email, strategy: token}
  - {pattern: url, strategy: drop}
  - {pattern: phone, strategy: hash}
  - {pattern: digits, strategy: drop, minDigits: 5, as: number}
"""


@query()
def text_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "documents").select("doc_id", texts.redact_text(F.col("text"), TEXT_PROFILE).alias("r"))
    return rows.select("doc_id", F.col("r.after").alias("text"), *(F.col("r.fired")[k].alias(f"n_{k}") for k in ("email", "url", "phone", "number")))


@query("SELECT conv_id, nullif(string_agg(text, chr(10) ORDER BY turn) FILTER (trim(text) <> ''), '') AS text FROM conversations GROUP BY conv_id")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.joined_text(B.table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


_P = "SELECT doc_id, (doc_id * 37 % 101) / 100 AS p, quality = 1 AS label FROM labels"


def _labelled(spark, sf_dir):
    return B.table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 37 % 101 / 100).alias("p"), (F.col("quality") == 1).alias("label"))


@query(f"WITH q AS ({_P}) SELECT doc_id, CASE WHEN p >= 0.7 THEN true WHEN p <= 0.3 THEN false END AS value FROM q")
def emit_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", S.emit(F.col("p"), 0.7, 0.3).alias("value"))


@query(f"WITH q AS ({_P}) SELECT coalesce(avg(p) FILTER (label) - avg(p) FILTER (NOT label), 0) AS separation FROM q")
def label_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.label_separation(_labelled(spark, sf_dir))


@query(f"WITH q AS ({_P}) SELECT CAST(round(p * 100) AS INTEGER) AS bin, CAST(count(*) FILTER (label) AS BIGINT) AS n_true, CAST(count(*) FILTER (NOT label) AS BIGINT) AS n_false FROM q GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.bins(_labelled(spark, sf_dir))


@query("WITH q AS (SELECT doc_id % 7 AS bin, count(*) AS n FROM labels GROUP BY 1) SELECT CAST(bin AS INTEGER) AS bin, n FROM q WHERE n >= greatest(2, ceil((SELECT sum(n) FROM q) / 20))")
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.modes(B.table(spark, sf_dir, "labels").select((F.col("doc_id") % 7 / 100).alias("p")))


_DIFF_SQL = """
WITH b AS (SELECT doc_id AS i, quality = 1 AS v, (doc_id * 37 % 101) / 100 AS p FROM labels WHERE doc_id % 10 <> 3),
     a AS (SELECT doc_id AS i, CASE WHEN doc_id % 4 = 0 THEN toxic = 1 ELSE quality = 1 END AS v, (doc_id * 37 % 101 + doc_id % 3) / 100 AS p FROM labels WHERE doc_id % 10 <> 6)
SELECT 'q' AS pred, count(*) FILTER (b.i IS NOT NULL AND a.i IS NOT NULL) AS shared, count(*) FILTER (b.i IS NOT NULL AND a.i IS NOT NULL AND b.v <> a.v) AS changed,
       count(*) FILTER (b.v = a.v AND abs(b.p - a.p) > 0.01 + 1e-9) AS moved, count(*) FILTER (a.i IS NULL) AS only_before, count(*) FILTER (b.i IS NULL) AS only_after
FROM b FULL OUTER JOIN a ON b.i = a.i
"""


@query(_DIFF_SQL)
def annotation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "labels")
    d, base = F.col("doc_id"), [F.col("doc_id").alias("i"), F.lit("0").alias("e"), F.lit(0).alias("seq"), F.lit("q").alias("pred")]
    before = rows.where(d % 10 != 3).select(*base, (F.col("quality") == 1).alias("value"), (d * 37 % 101 / 100).alias("p"))
    value = F.when(d % 4 == 0, F.col("toxic") == 1).otherwise(F.col("quality") == 1)
    after = rows.where(d % 10 != 6).select(*base, value.alias("value"), ((d * 37 % 101 + d % 3) / 100).alias("p"))
    return calibrate.diff_annotations(before, after)


@query("WITH q AS (SELECT n_name AS scope, o_orderpriority AS clause, count(*) FILTER (o_orderstatus = 'F') AS holds, count(*) AS \"of\" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT *, CASE WHEN \"of\" = 0 THEN 0 ELSE holds / \"of\" END AS support FROM q), s AS (SELECT *, sum(CASE WHEN support >= 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY clause) - CASE WHEN support >= 0.35 THEN 1 ELSE 0 END AS others FROM r) SELECT scope, clause, holds, \"of\", support, CASE WHEN support >= 0.35 THEN 'own' WHEN others >= 2 THEN 'borrowed' ELSE 'neither' END AS class FROM s")
def provenance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: B.table(spark, sf_dir, n)
    rows = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority").join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    q = rows.groupBy(F.col("n_name").alias("scope"), F.col("o_orderpriority").alias("clause")).agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("holds"), F.count(F.lit(1)).alias("of"))
    return calibrate.provenance(q, own=0.35, borrowed=2)


_SCAN = """
WITH x AS (
  SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS line FROM events
), part AS (
  SELECT x.*, CAST(p AS BIGINT) AS part FROM x, (SELECT unnest(range(2)) AS p) WHERE p = 0 OR event_type = 'click'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY line, part) - 1 AS ord FROM part
), ev AS (
  SELECT user_id, ord, CAST(ord + max(ms - ord) OVER (PARTITION BY user_id ORDER BY ord) AS BIGINT) AS at_ms,
         CASE event_type WHEN 'signup' THEN 'customer' WHEN 'error' THEN 'system' ELSE 'action' END AS speaker,
         CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'click' THEN 'Bash' END AS tool, CASE WHEN event_type = 'click' THEN 'git' END AS verb,
         CASE WHEN event_type = 'click' THEN CASE part WHEN 0 THEN 'status' ELSE 'push' END END AS sub, CASE event_type WHEN 'error' THEN 'failed' END AS result,
         CASE WHEN event_type IN ('view', 'purchase') THEN '.md' END AS ext,
         '/' || line || CASE WHEN event_type = 'signup' THEN '' ELSE '/content/0' END || CASE WHEN event_type = 'click' THEN '/segment/' || part ELSE '' END AS path FROM e
), named AS (
  SELECT DISTINCT user_id, 'cc-shop-' || substr('u' || lpad(CAST(user_id AS VARCHAR), 7, '0'), 1, 8) AS id FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE speaker = 'action')
)
"""


@query(_SCAN + "SELECT id AS interaction_id, ord, at_ms, speaker, tool, verb, sub, ext, result, path FROM ev JOIN named USING (user_id)")
def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of transcripts that events are written out as."""
    e = transcripts.scan(B.event_transcripts(spark, sf_dir)).events
    f = lambda k: F.col("features")[k]["v"].alias(k)
    return e.select("interaction_id", "ord", F.col("at").alias("at_ms"), f("speaker"), f("tool"), f("verb"), f("sub"), F.col("slots")["ext"]["v"].alias("ext"), "result", F.col("raw.path").alias("path"))


@query(_SCAN + """, s AS (
  SELECT user_id, arg_max(result, ord) FILTER (speaker = 'system') AS last_result, count(*) FILTER (result = 'failed') AS errors FROM ev GROUP BY 1
), p AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS prompts, min(ms) AS started_at, arg_max(ms, line) AS ended FROM x GROUP BY 1)
SELECT id, 'shop' AS operator, 'm-' || user_id % 3 AS agent, started_at, CASE WHEN last_result = 'failed' THEN 'failed' ELSE 'resolved' END AS outcome, ended AS outcome_at, CAST(greatest(prompts, 1) AS VARCHAR) AS expected_episodes, CAST(errors AS VARCHAR) AS errors, 'true' AS on_default
FROM named JOIN s USING (user_id) JOIN p USING (user_id)""")
def transcript_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = transcripts.scan(B.event_transcripts(spark, sf_dir)).interactions
    hint = lambda k: F.col("hints")[k]["v"].alias(k)
    return i.select("id", F.col("actor.operatorId").alias("operator"), F.col("actor.agentId").alias("agent"), "started_at", F.col("outcome.label").alias("outcome"), F.col("outcome.at").alias("outcome_at"), hint("expected_episodes"), hint("errors"), F.col("facts")["git.on_default"]["v"].alias("on_default"))


_OUTCOMES = _EV + """, o AS (SELECT interaction_id, CASE WHEN bool_or(type = 'action:purchase') THEN 'bought' WHEN NOT bool_or(type = 'action:click') THEN 'passed by' WHEN arg_max(coalesce(result, ''), seq) = 'failed' THEN 'stuck' WHEN TRY_CAST(interaction_id AS BIGINT) % 2 = 0 THEN 'even' END AS outcome, max(at_ms) AS outcome_at FROM ev GROUP BY 1)
"""


@query(_OUTCOMES + "SELECT interaction_id, outcome, CASE WHEN outcome IS NOT NULL THEN outcome_at END AS outcome_at FROM o")
def outcome_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by all four forms of rule, the first that holds."""
    i = B.corpus(spark, sf_dir).interactions
    return i.select(F.col("id").alias("interaction_id"), F.col("outcome.label").alias("outcome"), F.col("outcome.at").alias("outcome_at"))


@query(_OUTCOMES + "SELECT outcome, count(*) AS n FROM o WHERE outcome IS NOT NULL GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.outcomes(B.corpus(spark, sf_dir).interactions)


@query(_EV + "SELECT 1 AS operators, count(DISTINCT CAST(interaction_id AS BIGINT) % 5) AS teams, count(DISTINCT interaction_id) AS agents FROM ev")
def actor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.actors(B.corpus(spark, sf_dir).interactions)


@query(_EV + ", n AS (SELECT interaction_id, count(DISTINCT episode) AS n, count(*) FILTER (kind = 'customer_intent') AS expected FROM ev GROUP BY 1) SELECT count(*) AS interactions, avg(CASE WHEN n = expected THEN 1.0 ELSE 0.0 END) AS agreement FROM n")
def segmentation_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.agreement(B.corpus(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS id, l.level, CASE l.level WHEN 'agent' THEN 'u' || user_id WHEN 'team' THEN 't' || user_id % 5 ELSE 'shop' END AS level_id FROM (SELECT DISTINCT user_id FROM events), (VALUES ('agent'), ('team'), ('operator')) l(level)")
def actor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.corpus(spark, sf_dir).interactions.select("id", F.explode(record.actor_levels(F.col("actor"))).alias("x")).select("id", "x.level", F.col("x.id").alias("level_id"))


@query(_EV + ", b AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN -1 ELSE seq END AS seq2, event_id % 89 = 0 AS nokind, event_id % 83 = 0 AS odd FROM ev), f AS (SELECT interaction_id, CASE WHEN seq2 < 0 THEN 'seq' WHEN nokind THEN 'kind' WHEN odd THEN 'result' END AS place FROM b), r AS (SELECT interaction_id FROM b GROUP BY 1 HAVING min(seq2) <> 0 OR max(seq2) <> count(*) - 1 OR count(DISTINCT seq2) <> count(*)) SELECT place, count(*) AS n FROM (SELECT place FROM f WHERE place IS NOT NULL UNION ALL SELECT 'events' FROM r) GROUP BY 1")
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults planted by event id, found again by place."""
    e, n = B.corpus(spark, sf_dir).events, F.col("event_id")
    e = e.withColumn("seq", F.when(n % 97 == 0, -1).otherwise(F.col("seq"))).withColumn("kind", F.when(n % 89 == 0, "guess").otherwise(F.col("kind"))).withColumn("result", F.when(n % 83 == 0, "maybe").otherwise(F.col("result")))
    return record.event_faults(e).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query(_EV + ", p AS (SELECT count(*) AS events, count(*) FILTER (kind = 'action') AS actions, count(DISTINCT interaction_id) AS interactions FROM ev) SELECT interactions, events, actions, CAST(0 AS BIGINT) AS unknown_events, CAST(0 AS DOUBLE) AS unknown_rate FROM p")
def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([report.coverage(B.corpus(spark, sf_dir))], "interactions long, events long, actions long, unknown_events long, unknown_rate double")


@query(_CLAUSES + ", s2 AS (SELECT clause, violated, exercised, CAST(row_number() OVER (ORDER BY violated / exercised DESC, violated DESC) AS INTEGER) AS place FROM x WHERE violated > 0) SELECT * FROM s2")
def report_violated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken clauses in the report's order: most often broken first."""
    got = report.report(B.corpus(spark, sf_dir), B.contracts())["violated"]
    return spark.createDataFrame([(v["id"], v["violated"], v["exercised"], k) for k, v in enumerate(got, 1)], "clause string, violated long, exercised long, place int")


_NAME = "'name#' || substr(sha256('shop' || chr(0) || 'name' || chr(0) || c_name), 1, 12)"


@query(rf"""SELECT c_custkey, {_NAME} AS name, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'h#' || substr(sha256(c_mktsegment), 1, 24) END AS segment,
CASE WHEN c_nationkey < 10 THEN CAST(c_nationkey AS VARCHAR) END AS nation, CASE WHEN c_custkey % 3 = 0 THEN 'call ' || 'note#' || substr(sha256('shop' || chr(0) || 'note' || chr(0) || lpad(CAST(c_custkey AS VARCHAR), 8, '7')), 1, 12) ELSE 'none' END AS note, c_custkey % 5 = 0 AS keeps_null FROM customer""")
def slot_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rules with exceptions, a dropped slot, a pattern whose surrogate is named after its slot, and nulls that stay."""
    c = B.table(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("call "), F.lpad(F.col("c_custkey").cast("string"), 8, "7"))).otherwise("none")
    slots = F.create_map(F.lit("name"), S.text(F.col("c_name")), F.lit("segment"), S.text(F.col("c_mktsegment")), F.lit("nation"), S.number(F.col("c_nationkey")), F.lit("note"), S.text(note))
    gone = F.map_filter(F.create_map(F.lit("gone"), S.literal(None)), lambda k, v: F.col("c_custkey") % 5 == 0)
    got = c.select("c_custkey", redact(B.parse_alphabet(B.REDACTING), F.map_concat(slots, gone)).alias("r"))
    value = lambda k: F.col("r")[k]["v"].alias(k)
    return got.select("c_custkey", value("name"), value("segment"), value("nation"), value("note"), F.map_contains_key("r", "gone").alias("keeps_null"))


@query(r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, '\bhttps?://[^\s<>"'')\]]+', '<url>', 'g') AS t2 FROM a)
SELECT doc_id, regexp_replace(t2, '[0-9]{5,}', '<number>', 'g') AS text, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS INTEGER) AS n_email, CAST(len(regexp_extract_all(t1, '\bhttps?://[^\s<>"'')\]]+')) AS INTEGER) AS n_url, CAST(len(regexp_extract_all(t2, '[0-9]{5,}')) AS INTEGER) AS n_number FROM b""")
def text_redaction_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile that only drops: its marks are no surrogates, so each rule sees the text that the one before left."""
    rows = B.table(spark, sf_dir, "documents").select("doc_id", texts.redact_text(F.col("text"), DROPPING).alias("r"))
    return rows.select("doc_id", F.col("r.after").alias("text"), *(F.col("r.fired")[k].alias(f"n_{k}") for k in ("email", "url", "number")))


DROPPING = """
corpus: documents
version: 1
rules:
  - {pattern: email, strategy: drop}
  - {pattern: url, strategy: drop}
  - {pattern: digits, strategy: drop, minDigits: 5, as: number}
"""


PREDICATES = """
corpus: documents
version: 3
model: m-1
redaction: text.documents@1
predicates:
  - {id: q, fact: obs.good, status: real, quadrant: text-closed, source: event.text, window: event, question: "Is it stated?", bands: {assertAt: 0.7, refuteAt: 0.3},
     calibration: {at: "2026-01-01", corpusRevision: abc, alphabetVersion: 1, n: 80, labels: {"true": 40, "false": 40}, assertPrecision: 0.95, refutePrecision: 0.9, withheldFraction: 0.2, reviewer: someone}}
  - {id: r, fact: obs.bad, status: proposed, quadrant: text-closed, source: event.text, window: event, question: "Is it denied?", bands: {assertAt: 0.5, refuteAt: -1}}
"""


def _annotated(spark, sf_dir):
    known = predicates.parse_predicates(PREDICATES)
    d = F.col("doc_id")
    rows = B.table(spark, sf_dir, "labels").select(d.cast("string").alias("i"), F.concat(d.cast("string"), F.lit("#0")).alias("e"), F.lit(0).alias("seq"), F.explode(F.array(F.lit("q"), F.lit("r"))).alias("pred"), (d * 37 % 101 / 100).alias("p"))
    return rows.withColumn("fact", F.when(F.col("pred") == "q", "obs.good").otherwise("obs.bad")).withColumn("value", predicates.emitted(known, F.col("pred"), F.col("p")))


@query("WITH q AS (SELECT doc_id, (doc_id * 37 % 101) / 100 AS p FROM labels) SELECT CAST(doc_id AS VARCHAR) AS i, CASE WHEN p >= 0.7 THEN 'true' WHEN p <= 0.3 THEN 'false' END AS good, CAST(NULL AS VARCHAR) AS bad, CASE WHEN p >= 0.7 OR p <= 0.3 THEN 'obs.bad' ELSE 'obs.bad,obs.good' END AS missing FROM q")
def observed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of annotated places: withheld ones, and those of a predicate that is not in service, are absent."""
    rows = _annotated(spark, sf_dir)
    facts = observations.observed_facts(rows).select("i", F.col("facts")["obs.good"]["v"].alias("good"), F.col("facts")["obs.bad"]["v"].alias("bad"))
    missing = observations.missing_facts(rows, ["obs.good", "obs.bad"]).select("i", F.array_join("missing", ",").alias("missing"))
    return facts.join(missing, "i")


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN text END AS text, substr(sha256(text), 1, 16) AS sha FROM conversations")
def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of raw transcript records, and the digest that an annotation keeps of them."""
    record_of = F.parse_json(F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("role"), F.col("text").alias("content")).alias("message"))))
    rows = B.table(spark, sf_dir, "conversations").withColumn("record", record_of)
    return rows.select("conv_id", "turn", raw_texts.texts_for("cc")(F.col("record")).alias("text"), observations.sha16(F.col("text")).alias("sha"))
