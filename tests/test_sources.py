"""Each source against figures worked out by hand from small files, and what is built on them."""

import json
import random

import pytest

from tracewright import __main__ as cli
from tracewright import sources
from tracewright.operators import calibrate, check, record, report
from tracewright.operators import text as texts
from tracewright.plans import alphabet as A
from tracewright.plans import config, corpus, predicates, thresholds
from tracewright.sources import observations, raw, transcripts
from tracewright.sources import texts as raw_texts


def plain(m):
    return {k: v["v"] for k, v in (m or {}).items()}


def read(spark, name, path):
    c = sources.source_for(name)(spark, str(path))
    events = {}
    for r in sorted(c.events.collect(), key=lambda r: (r["interaction_id"], r["ord"])):
        events.setdefault(r["interaction_id"], []).append(r)
    return {r["id"]: r for r in c.interactions.collect()}, events, c


def line(kind, content, at=None, **more):
    role = "assistant" if kind == "assistant" else "user"
    out = {"type": kind, "message": {"role": role, "content": content, **({"model": more.pop("model")} if "model" in more else {})}, **more}
    return json.dumps(out | ({"timestamp": f"2026-03-01T10:00:{at:02d}.000Z"} if at is not None else {}))


def call(tool, **given):
    return [{"type": "tool_use", "name": tool, "input": given}]


@pytest.fixture(scope="module")
def transcript_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("projects")
    one, two = root / "-home-ann-code-shop", root / "-Users-ben-blog"
    one.mkdir(), two.mkdir()
    (one / "aaaaaaaa1.jsonl").write_text("\n".join([
        "", "{broken", line("user", "fix it", 0, promptId="p1", sessionId="aaaaaaaa1", gitBranch="main", version="9", entrypoint="cli"), line("user", "meta", 1, isMeta=True),
        line("assistant", call("Read", file_path="/w/.env"), 2, model="m1"), line("user", [{"type": "tool_result", "content": "ok"}], 3),
        line("assistant", call("Bash", command="FOO=1 git add -A && for x in a; do\ngit -C /w commit -m 'x; y'\ndone\ncat <<EOF\nrm -rf /\nEOF"), 3, model="m2"),
        line("assistant", [{"type": "text", "text": "done"}, {"type": "thinking", "text": "hm"}], model="m2"), line("assistant", call("Skill", skill="s1"), 4), line("user", [{"type": "text", "text": "no event"}], 5), "[1]",
    ]))
    (one / "aaaaaaaa2.jsonl").write_text("\n".join([line("user", "go", 7, promptId="p1", sessionId="aaaaaaaa2"), line("assistant", call("Bash", command="done"), 7), line("user", [{"type": "tool_result", "is_error": True}], 8), line("user", "again", 9, promptId="p2")]))
    (two / "talk.jsonl").write_text(line("user", "only talk", 1))
    (two / "stop.jsonl").write_text("\n".join([line("assistant", call("Write", file_path="/b/A.TXT")), line("user", "[request interrupted by someone]"), line("user", [{"type": "tool_result", "is_error": True}])]))
    (root / "SOURCE.json").write_text('{"takenAt": "now", "projects": 2}')
    return root


def test_transcripts(spark, transcript_folder):
    sessions, events, c = read(spark, "cc", transcript_folder)
    assert set(sessions) == {"cc-shop-aaaaaaaa", "cc-shop-aaaaaaaa-1", "cc-blog-stop"} and c.meta == {"transcripts": "4", "takenAt": "now", "projects": "2"}
    own = events["cc-shop-aaaaaaaa"]
    said = [" ".join(plain(e["features"]).get(k) or "" for k in ("speaker", "tool", "verb", "sub", "skill", "event")).split() for e in own]
    assert said == [["customer"], ["action", "Read"], ["system", "tool_result"], ["action", "Bash", "git", "add"], ["action", "Bash", "git", "commit"], ["action", "Bash", "cat"], ["agent"], ["action", "Skill", "s1"]]
    assert [e["raw"]["path"] for e in own] == ["/2", "/4/content/0", "/5/content/0", "/6/content/0/segment/0", "/6/content/0/segment/1", "/6/content/0/segment/2", "/7/content/0", "/8/content/0"]
    start = own[0]["at"]
    assert [e["at"] - start for e in own] == [0, 2000, 3000, 3001, 3002, 3003, 3004, 4000]
    assert plain(own[1]["slots"]) == {"file": "/w/.env", "ext": "(none)"} and own[2]["result"] == "ok"
    s = sessions["cc-shop-aaaaaaaa"]
    assert s["actor"].asDict() == {"operatorId": "shop", "teamId": None, "agentId": "m2"} and s["started_at"] == start and s["outcome"]["label"] == "resolved" and s["outcome"]["at"] == start + 5000
    assert plain(s["facts"]) == {"project.name": "shop", "git.branch": "main", "git.on_default": "true", "session.entrypoint": "cli"}
    assert plain(s["hints"]) == {"expected_episodes": "1", "models": "2", "model": "m2", "cliVersion": "9", "errors": "0", "interrupted": "false"}
    other = sessions["cc-shop-aaaaaaaa-1"]
    assert other["outcome"]["label"] == "failed" and plain(other["hints"])["expected_episodes"] == "2" and plain(events["cc-shop-aaaaaaaa-1"][1]["features"]) == {"speaker": "action", "tool": "Bash"}
    stop = sessions["cc-blog-stop"]
    assert stop["outcome"]["label"] == "interrupted" and stop["started_at"] == 0 and [e["at"] for e in events["cc-blog-stop"]] == [0, 1, 2] and plain(events["cc-blog-stop"][0]["slots"])["ext"] == ".txt"
    alone, _, _ = read(spark, "cc", transcript_folder / "-Users-ben-blog" / "stop.jsonl")
    assert set(alone) == {"cc-stop-stop"}


def test_transcripts_are_parsed_once_for_events_and_once_for_sessions(spark):
    talk = [line("user", "go", 1), "{broken", line("assistant", call("Bash", command="git add x; git push"), model="m2"), line("assistant", call("Read") + [{"type": "text", "text": "t"}], 3, model="m3"), line("assistant", [], model="m2"), line("assistant", "x", model="m3"), "", "[1"]
    c = transcripts.scan(spark.createDataFrame([("/p/a.jsonl", "p", "\n".join(talk)), ("/p/b.jsonl", "p", "{broken\n[1"), ("/p/c.jsonl", "p", None)], "file string, project string, text string"))
    for table, splitters, parsers in ((c.events, 1, 2), (c.interactions, 0, 1)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == splitters and plan.count("parseJson") == parsers
    (s,) = c.interactions.collect()
    # each model has two records, one of them with two blocks: the first by name
    assert s["actor"]["agentId"] == "m2" and plain(s["hints"])["models"] == "2" and s["outcome"]["at"] - s["started_at"] == 2000
    events = sorted(c.events.collect(), key=lambda e: e["ord"])
    assert [(e["at"] - s["started_at"], e["raw"]["path"]) for e in events] == [(0, "/0"), (1, "/2/content/0/segment/0"), (2, "/2/content/0/segment/1"), (2000, "/3/content/0"), (2001, "/3/content/1")]


def test_planted(spark, tmp_path):
    doc = {"corpus": "syn", "interactions": [
        {"id": "b", "operator": "o", "startedAt": 5000, "turns": []},
        {"id": "a", "operator": "o", "team": "t", "agent": "x", "startedAt": 1000, "outcome": "good", "turns": [
            {"speaker": "customer", "intent": "refund", "text": "secret", "gapMs": 99}, {"speaker": "action", "button": "pay", "slots": {"n": 20, "f": 2.5, "ok": True, "z": None}, "gapMs": 250}, {"speaker": "system", "event": "ping", "result": "refused"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    i, e, _ = read(spark, "synthetic", tmp_path / "d.json")
    assert [x["at"] for x in e["a"]] == [1000, 1250, 2250] and e["a"][2]["result"] == "refused" and e["a"][1]["raw"]["path"] == "/interactions/1/turns/1"
    assert {k: (v["t"], v["v"]) for k, v in e["a"][1]["slots"].items()} == {"n": ("n", "20"), "f": ("n", "2.5"), "ok": ("b", "true"), "z": ("z", None)}
    assert i["a"]["outcome"].asDict() == {"label": "good", "at": 2250, "lag_ms": 0, "source": "in_band"} and i["a"]["actor"]["teamId"] == "t" and i["b"]["outcome"] is None and "secret" not in str(e)


def test_support(spark, tmp_path):
    turn = lambda speaker, n, *targets: {"speaker": speaker, "text": "t", "turn_count": n, "targets": list(targets)}
    convo = {"convo_id": 12, "scenario": {"personal": {"member_level": "gold", "name": "x"}, "order": {"state": "", "num_products": 2}, "flow": "f", "subflow": "s"}, "delexed": [
        turn("agent", 1, "s", None, None, [], -1), turn("customer", 2, "s", None, None, [], -1), turn("action", 3, "s", "take_action", "look-up", ["v1", "v2"], -1), turn("action", 4, "s", "x", None, ["v3"], -1), turn("customer", 5, "s", None, None, [], -1)]}
    (tmp_path / "c.json").write_text(json.dumps({"dev": [convo], "train": []}))
    (tmp_path / "ontology.json").write_text(json.dumps({"actions": {"a": {"look-up": ["name"]}, "b": {"look-up": ["name", "id"]}}}))
    i, e, _ = read(spark, "abcd", tmp_path / "c.json")
    own = e["abcd-12"]
    assert [x["at"] for x in own] == [12001, 12002, 12003, 12004, 12005] and own[2]["raw"]["path"] == "/dev/0/delexed/2"
    assert [plain(x["slots"]) for x in own[2:4]] == [{"name": "v1", "id": "v2"}, {"value_0": "v3"}] and plain(own[3]["features"]) == {"speaker": "action", "button": "unknown-action"}
    assert plain(own[1]["features"]) == {"speaker": "customer", "intent": "s", "flow": "f"} and plain(own[4]["features"]) == {"speaker": "customer"}
    assert plain(i["abcd-12"]["facts"]) == {"customer.member_level": "gold", "order.num_products": "2"} and plain(i["abcd-12"]["hints"])["split"] == "dev"


def test_simulations(spark, tmp_path):
    sim = lambda task, **more: {"id": "x", "task_id": task, "trial": 0, "termination_reason": "stop", "messages": [{"role": "system"}, {"role": "user"}, {"role": "assistant", "tool_calls": [{"name": "get", "arguments": {"b": 1, "a": {"k": [1, None]}}}, {"name": "put"}]}, {"role": "tool", "error": True, "timestamp": "2026-01-01T00:00:09Z"}, {"role": "assistant", "content": "bye"}], **more}
    doc = lambda model: {"info": {"agent_info": {"llm": model}, "seed": 3}, "tasks": [{"id": "1"}], "simulations": [sim("1", reward_info={"reward": 1}), sim("2", reward_info={"reward": 0.5}), sim("3")]}
    for m in ("m1", "m2"):
        (tmp_path / f"run_retail_{m}.json").write_text(json.dumps(doc(m)))
    i, e, c = read(spark, "tau2", tmp_path / "run_retail_m1.json")
    assert {k: v["outcome"] and v["outcome"]["label"] for k, v in i.items()} == {"tau2-retail-1-0": "resolved", "tau2-retail-2-0": "failed", "tau2-retail-3-0": None} and c.meta == {"backbone": "m1", "userSimulator": "unknown", "domain": "retail", "benchmarkSeed": "3"}
    own = e["tau2-retail-2-0"]
    assert [x["at"] for x in own] == [1_002_000, 1_003_000, 1_003_001, 1767225609000, 1767225610000] and [x["result"] for x in own] == [None, None, None, "failed", None]
    assert plain(own[1]["slots"]) == {"b": "1", "a": '{"k":[1,null]}'} and own[2]["raw"]["path"] == "/simulations/1/messages/2/tool_calls/1"
    several, _, meta = read(spark, "tau2", tmp_path)
    assert set(several) >= {"tau2-retail-1-0-m1", "tau2-retail-1-0-m2"} and meta.meta["backbone"] == "m1+m2" and meta.meta["files"] == "2"


def test_process_log(spark, tmp_path):
    import gzip

    a = lambda kind, key, value: f'<{kind} key="{key}" value="{value}"/>'
    event = lambda name, cycle, at, who, *more: "<event>" + a("string", "concept:name", name) + a("string", "lifecycle:transition", cycle) + a("date", "time:timestamp", at) + a("string", "org:resource", who) + "".join(more) + "</event>"
    xml = "<log><trace>" + a("string", "concept:name", "App&amp;1") + a("string", "LoanGoal", "Car") + a("float", "RequestedAmount", "5000.0") + event("A_Create", "complete", "2016-01-01T00:00:00.500Z", "u2", a("string", "Action", "Created")) + event("A_Denied", "start", "2016-01-01T00:00:01Z", "u1") + event("A_Denied", "complete", "2016-01-01T00:00:02Z", "u1", a("boolean", "Accepted", "true"), a("float", "OfferedAmount", "20.0")) + event("O_X", "complete", "bad", "u2") + "</trace><trace></trace><trace>" + event("A_Pending", "complete", "2016-01-01T00:00:03Z", "") + "</trace></log>"
    (tmp_path / "l.xes").write_text(xml)
    with gzip.open(tmp_path / "l.xes.gz", "wt") as f:
        f.write(xml)
    for file in ("l.xes", "l.xes.gz"):
        i, e, _ = read(spark, "bpic", tmp_path / file)
        own = i["App&1"]
        assert own["outcome"].asDict() == {"label": "declined", "at": 1451606402000, "lag_ms": 1500, "source": "in_band"} and own["actor"]["agentId"] == "u1" and plain(own["facts"]) == {"application.goal": "Car", "application.requested_amount": "5000"}
        assert [x["at"] for x in e["App&1"]][-1] == 0 and {k: v["t"] + v["v"] for k, v in e["App&1"][2]["slots"].items()} == {"accepted": "btrue", "offered_amount": "n20"}
        assert {k for k in i if k.startswith("trace-")} and [x["outcome"]["label"] for k, x in i.items() if k.startswith("trace-") and x["outcome"]] == ["accepted"]


def test_report_and_audit_of_transcripts(spark, transcript_folder, tmp_path):
    out, err = [], []
    (tmp_path / "tracewright.json").write_text(json.dumps({"corpora": {"cc-x": {"adapter": "cc", "source": str(transcript_folder), "alphabet": "alphabet.cc.yaml", "domain": "transcripts", "segmenter": "intent"}}, "thresholds": {"minInstances": 1}}))
    assert cli.main(["cc-x", "--json"], out.append, err.append, str(tmp_path), spark=spark) == 0
    r = json.loads(out.pop())
    assert r["coverage"] == {"interactions": 3, "events": 15, "actions": 7, "unknown_events": 2, "unknown_rate": 2 / 15}
    assert r["kept"] == [] and [(v["id"], v["violated"], v["exercised"]) for v in r["violated"]] == [("look-before-commit", 1, 1), ("test-before-commit", 1, 1)] and r["violated"][0]["examples"] == ["cc-shop-aaaaaaaa#4"]
    assert len(r["unreachable"]) == 3 and len(r["never_exercised"]) == 9
    assert {a["type"]: (a["n"], a["failed"]) for a in r["inventory"]}["unknown"] == (2, 1)
    assert "broken 1 of 1 times (100.0%)" in report.render_report(r)
    assert cli.main(["audit", "cc-x", "--json"], out.append, err.append, str(tmp_path), spark=spark) == 0
    a = json.loads(out.pop())
    assert a["outcomes"] == {"failed": 1, "interrupted": 1, "resolved": 1} and a["actors"] == {"operators": 2, "teams": 0, "agents": 1} and [s["type"] for s in a["subjects"]] == ["action:git-commit"] and not a["nothing_to_say"]
    assert a["episodes"]["truth"]["interactions"] == 3
    assert "unnamed events: 2 (13.3%)" in report.render_audit(a)
    assert cli.main(["nothing"], out.append, err.append, str(tmp_path)) == 1 and "no corpus" in err.pop()
    assert cli.main([], out.append, err.append, str(tmp_path), home=str(tmp_path)) == 1 and cli.main(["--help"], out.append, err.append) == 0
    home = tmp_path / "home"
    (home / ".claude").mkdir(parents=True)
    (home / ".claude" / "projects").symlink_to(transcript_folder)
    assert config.local_corpus(str(home))[1:] == (2, 4)


def test_corpora_must_fit(spark, tmp_path, transcript_folder):
    own = config.shipped("alphabet.cc.yaml").read_text()
    with pytest.raises(corpus.CorpusError, match="alphabet is for"):
        corpus.load(spark, "cc", str(transcript_folder), own, "other")
    with pytest.raises(KeyError, match="no source"):
        sources.source_for("nope")
    with pytest.raises(corpus.CorpusError, match="no hint"):
        corpus.load(spark, "cc", str(transcript_folder), own, "cc", scope_by="nothing")
    scoped = corpus.load(spark, "cc", str(transcript_folder), own, "cc-b", scope_by="errors")
    assert {r["actor"]["operatorId"] for r in scoped.interactions.collect()} == {"0", "1"}
    assert {r["features"]: r["n"] for r in scoped.unknown_shapes.collect()} == {"speaker=action tool=Bash": 1, "speaker=action sub=add tool=Bash verb=git": 1}
    sources.register_source("again", transcripts.read)
    assert sources.source_for("again") is transcripts.read


def test_record_faults(spark):
    good = dict(interaction_id="a", seq=0, at=1, episode="a#0", kind="action", type="x", slots={"k": ("s", "v")}, result=None, raw=("f", "/0"))
    schema = f"interaction_id string, seq int, at bigint, episode string, kind string, type string, slots {record.KINDS and 'map<string,struct<t:string,v:string>>'}, result string, raw struct<file:string,path:string>"
    wrong = [("seq", -1), ("at", None), ("episode", ""), ("kind", "x"), ("type", ""), ("slots", None), ("slots", {"k": ("q", "v")}), ("result", "maybe"), ("raw", ("", "/"))]
    rows = [tuple((good | {"interaction_id": f"w{k}", c: v}).values()) for k, (c, v) in enumerate(wrong)] + [tuple(good.values()), tuple((good | {"interaction_id": "gap", "seq": 2}).values())]
    got = {(r["interaction_id"], r["place"]) for r in record.event_faults(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(f"w{k}", c if c != "raw" else "raw.file") for k, (c, _) in enumerate(wrong)} | {("gap", "events"), ("w0", "events")}
    i = [("a", "c", ("o", "t", None), 1, ("l", 1, 0, "in_band"), None), ("b", "c", ("", None, None), 1, None, None), ("c", "c", ("o", None, None), 1, ("l", 1, 0, "odd"), None)]
    df = spark.createDataFrame(i, f"id string, corpus string, actor struct<operatorId:string,teamId:string,agentId:string>, started_at bigint, outcome {raw.OUTCOME}, facts map<string,struct<t:string,v:string>>")
    assert {(r["id"], r["place"]) for r in record.interaction_faults(df).collect()} == {("b", "actor.operatorId"), ("c", "outcome.source")}
    with pytest.raises(record.RecordError, match="b.actor.operatorId|c.outcome.source"):
        record.require_valid(df, spark.createDataFrame([], schema))


PROFILE = """
corpus: c
version: 4
rules:
  - {pattern: email, strategy: token}
  - {pattern: path, strategy: drop}
  - {pattern: digits, strategy: hash, minDigits: 4}
  - {pattern: literal, match: "secret", strategy: drop, as: word}
"""


def test_text_rules_leave_surrogates_alone():
    c, _, rules = texts.parse_profile(PROFILE)
    once = lambda t: texts.redact_one(t, c, rules)[0]
    assert once("email#123456abcdef h#" + "1" * 24) == "email#123456abcdef h#" + "1" * 24
    for gone in ("docs/spec.md", "~/x", "./notes", r"C:\\Users\\ann", "/a/b", "a/b/c", "../up"):
        assert once(f"see {gone} now") == "see <path> now", gone
    for kept in ("either/or", "24/7", "TCP/IP"):
        assert once(kept) == kept
    assert texts.profile_id(PROFILE) == "text.c@4"
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a@b.co", " ", "12345", "x", "secret", "/p/q", "email#0123456789ab", "#", "h#"]) for _ in range(rng.randint(0, 12)))
        want = t
        for r in rules:  # character by character: no closed place, no change
            closed = {k for m in texts.SURROGATE.finditer(want) for k in range(*m.span())}
            for m in reversed(list(r.regex.finditer(want))):
                if m.group() and not closed & set(range(*m.span())):
                    want = want[: m.start()] + texts._surrogate(r, c, m.group()) + want[m.end() :]
        assert once(t) == want


def test_predicates():
    from tracewright.plans.queries import PREDICATES

    known = predicates.parse_predicates(PREDICATES)
    assert [p.id for p in known.active()] == ["q"] and known.predicates[1].assert_only and known.stale(2) and not known.stale(3)
    import yaml

    def broken(change):
        raw_set = yaml.safe_load(PREDICATES)
        change(raw_set)
        with pytest.raises(A.ArtefactError):
            predicates.parse_predicates(raw_set)

    first = lambda s: s["predicates"][0]
    for change in (
        lambda s: s.pop("model"), lambda s: s.pop("redaction"), lambda s: s.update(version=0), lambda s: first(s).update(type="noul"), lambda s: first(s).update(fact="good"), lambda s: first(s).update(fact="obs.bad"),
        lambda s: first(s).update(status="sure"), lambda s: first(s).update(quadrant="sequence-unknown"), lambda s: first(s).update(source="slot."), lambda s: first(s).update(window="after"), lambda s: first(s).update(question=" "),
        lambda s: first(s).update(bands={"assertAt": 0.5, "refuteAt": 0.4}), lambda s: first(s).update(bands={"assertAt": 0.555, "refuteAt": -1}), lambda s: first(s).pop("calibration"), lambda s: first(s)["calibration"].pop("reviewer"), lambda s: first(s).update(id="r"),
    ):
        broken(change)
    with pytest.raises(ValueError, match="unknown threshold"):
        thresholds.with_thresholds({"x": 1})
    assert thresholds.with_thresholds({"minInstances": 7})["minInstances"] == 7


def test_calibration_refutes_from_the_first_step(spark):
    rows = [(0.0, False)] * 30 + [(0.02, False)] * 5 + [(1.0, True)] * 40
    b = calibrate.derive_bands(spark.createDataFrame(rows, "p double, label boolean"))
    # steps within two hundredths of a frequent value are turned down, and recorded
    assert b.refute_at == 0.05 and b.assert_at == 0.97 and b.rejected[:3] == [1.0, 0.99, 0.98] and b.rejected[3:] == [0.01, 0.02, 0.03, 0.04]
    rec = predicates.calibration_record(b, (40, 35, 0), {"at": "x", "corpusRevision": "r", "alphabetVersion": 1, "reviewer": "y"})
    assert rec["n"] == 75 and predicates.blocks_adjudication(rec, thresholds.THRESHOLDS) is None and "below" in predicates.blocks_adjudication(rec | {"assertPrecision": 0.5}, thresholds.THRESHOLDS)


def test_annotation_files(spark, tmp_path):
    rows = [("b", "b#0", 2, "z", 0.9, "obs.z", True, 1, "t@1", "0" * 16, 5), ("a", "a#0", 1, "z", 0.5, "obs.z", None, 1, "t@1", "0" * 16, 5), ("a", "a#0", 1, "a", 0.1, "obs.a", False, 1, "t@1", "0" * 16, 5)]
    df = spark.createDataFrame(rows, observations.SCHEMA).repartition(3)
    path, digest = observations.write(df, str(tmp_path), "c", 1)
    assert path.name == "c@1.jsonl" and len(digest) == 16 and digest == observations.write(df.repartition(1), str(tmp_path), "d", 1)[1]
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert [(x["i"], x["pred"], x["value"]) for x in lines] == [("a", "a", False), ("a", "z", None), ("b", "z", True)]
    back, partial = observations.read(spark, str(tmp_path), "c", 1)
    assert not partial and back.count() == 3 and observations.read(spark, str(tmp_path), "none", 1) is None
    observations.write(df, str(tmp_path), "p", 2, partial=True)
    assert observations.read(spark, str(tmp_path), "p", 2)[1]
    assert {r["i"]: plain(r["facts"]) for r in observations.observed_facts(back).collect()} == {"a": {"obs.a": "false"}, "b": {"obs.z": "true"}}


def test_raw_texts(spark):
    rows = {
        '{"message": {"content": "hello"}}': "hello", '{"message": {"content": [1]}}': None, '{"type": "text", "text": " "}': None, '{"type": "text", "text": "x"}': "x", '{"type": "tool_result", "content": "r"}': "r",
        '{"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}': "a\nb", '{"type": "tool_use"}': None, "[]": None,
    }
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k,) for k in rows], "j string").withColumn("v", F.parse_json("j"))
    assert {r["j"]: r["t"] for r in df.select("j", raw_texts.texts_for("cc")(F.col("v")).alias("t")).collect()} == rows
    assert raw_texts.annotatable() == ["abcd", "cc", "synthetic"] and df.select(raw_texts.texts_for("bpic")(F.col("v")).alias("t")).where("t is not null").count() == 0
    one = spark.range(1).select(raw_texts.at_pointer(F.parse_json(F.lit('{"a": [{"b": 7}]}')), "/a/0/b").cast("int").alias("x")).first()
    assert one["x"] == 7


def test_contract_rules():
    c = {"id": "a", "text": "t", "shape": "precedence", "subject": "s", "guard": "g"}
    for bad in ({"fact": "x"}, {"fact": "x", "eq": 1, "neq": 2}, {"eq": 1}):
        with pytest.raises(A.ArtefactError):
            check.parse_contracts({"name": "n", "version": 1, "clauses": [c | {"when": bad}]})
    assert check.rendered({"fact": "slot.k", "in": [1, 2]}) == "slot.k in {1, 2}" and check.rendered({"fact": "x", "lte": 3}) == "x <= 3"
    assert len(check.parse_contracts(config.contracts_for("transcripts").read_text())) == 14 and A.parse_alphabet(config.shipped("alphabet.cc.yaml").read_text()).consequential()


def test_manifest(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("1")
    first = config.revision(str(tmp_path / "d"))
    (tmp_path / "d" / "y").write_text("2")
    assert len(first) == 16 and first != config.revision(str(tmp_path / "d")) and config.run_id("mine", 0).startswith("mine-19700101T000000-")
    assert report.percent(0.0625) == "6.2%"
