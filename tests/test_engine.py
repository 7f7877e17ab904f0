"""Shell commands, the intent segmenter, text redaction and calibration on small cases worked out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import calibrate, segment, text


def test_shell_segments():
    assert text.segments("cd x && git push; echo 'a;b' || ls\nrm -f y") == ["cd x", "git push", "echo 'a;b'", "ls", "rm -f y"]
    assert text.segments("cat <<'EOF' > f\ngit push\nEOF\ngit status") == ["cat <<'EOF' > f", "git status"]
    assert text.segments('echo "a \\" && b" && c') == ['echo "a \\" && b"', "c"]
    assert text.segments("cat <<< word\nls | wc") == ["cat <<< word", "ls | wc"]
    assert text.segments(" ;; ") == []


@pytest.mark.parametrize(
    ("command", "verb", "sub"),
    [
        ("git -C tmp push", "git", "push"), ("sudo /usr/bin/git commit -m x", "git", "commit"), ("KEY=$(aws secretsmanager get)", "aws", "secretsmanager"), ("A=1 B=2 make all", "make", None),
        ("# note", None, None), ("(cd x", "cd", None), ("python -c code", "python", None), ("node ./run.js", "node", None), ("done", None, None), ("$(x)", None, None), ("A=1", None, None), ("npm run build:all", "npm", "run"),
    ],
)
def test_verbs(command, verb, sub):
    assert text.verb_of(command) == (verb, sub)


def test_shell_parts(spark):
    rows = spark.createDataFrame([("for f in *; do git add $f; done",), ("",), (None,)], "c string").select(text.shell_parts("c").alias("p")).collect()
    assert [[(x["verb"], x["sub"]) for x in r["p"]] for r in rows][1:] == [[(None, None)], [(None, None)]]


@pytest.mark.parametrize("step", [text.shell_parts, lambda t: text.redact_text(t, "{corpus: c, version: 1, rules: [{pattern: email, strategy: token}]}")])
def test_texts_go_to_workers_in_small_batches(spark, step):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")

    @F.pandas_udf("int")
    def rows_of_batch(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    for size, most in ((10, 1024), (4096, 300)):
        rows = spark.range(4000, numPartitions=1).select(F.rpad(F.col("id").cast("string"), size, " x").alias("t"))
        assert rows.select(step(F.col("t")).alias("x"), rows_of_batch("t").alias("n")).agg(F.count("x"), F.max("n")).first()[1] <= most


@pytest.mark.parametrize(("log", "want"), [("AIXIYI", "011222"), ("IXIIY", "00111"), ("I", "0"), ("XY", "00")])
def test_intents_open_episodes(spark, log, want):
    rows = [("a", k, "customer_intent" if c == "I" else "action", c) for k, c in enumerate(log)]
    got = segment.segment(spark.createDataFrame(rows, "interaction_id string, seq int, kind string, type string"), "intent").orderBy("seq").collect()
    assert [r["episode"] for r in got] == [f"a#{k}" for k in want]


def test_redaction_leaves_surrogates_alone():
    profile = "{corpus: c, version: 1, rules: [{pattern: email, strategy: token}, {pattern: digits, strategy: drop, minDigits: 3}]}"
    corpus, _, rules = text.parse_profile(profile)
    after, fired = text.redact_one("mail a.b@x.org or 12345", corpus, rules)
    assert after.startswith("mail email#") and after.endswith(" or <digits>") and fired == {"email": 1, "digits": 1}
    assert text.redact_one(after, corpus, rules)[0].startswith("mail email#")


def test_calibration_refuses_in_order(spark):
    rows = lambda *x: spark.createDataFrame([(lab, p) for lab, p, n in x for _ in range(n)], "label boolean, p double")
    with pytest.raises(calibrate.Refused, match="items"):
        calibrate.derive_bands(rows((True, 0.9, 20), (False, 0.1, 20)))
    with pytest.raises(calibrate.Refused, match="of each"):
        calibrate.derive_bands(rows((True, 0.9, 60), (False, 0.1, 5)))
    with pytest.raises(calibrate.Refused, match="separation"):
        calibrate.derive_bands(rows((True, 0.5, 40), (False, 0.45, 40)))
    assert calibrate.derive_bands(rows((True, 0.95, 40), (False, 0.05, 40))).assert_at == 0.92
