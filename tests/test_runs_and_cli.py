import json

from lodestone import cli
from lodestone.operators import runs


def test_cli(spark, tmp_path):
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    lines = [{"type": "user", "message": {"role": "user", "content": f"how do joins {k} spill"}, "timestamp": "2024-01-01T00:00:00Z", "sessionId": f"s{k}"} for k in range(3)]
    for k, line in enumerate(lines):
        (logs / f"{k}.jsonl").write_text(json.dumps(line) + "\n")
    go = lambda *a: cli.run(spark, cli.parser().parse_args([*a, *([] if a[0] == "agents" else ["--store", store])]))
    assert go("index", "typed_lines", str(logs)) == [{"sessions": 3, "messages": 3}]
    assert go("index", "typed_lines", str(logs)) == [{"sessions": 3, "messages": 3}]
    assert go("stats") == [{"agent": "typed_lines", "sessions": 3, "messages": 3}]
    assert {r["session_id"] for r in go("search", "joins spill")} == {"s0", "s1", "s2"} and "<<joins>>" in go("search", "joins")[0]["snippet"]
    assert len(go("list")) == 3 and go("show", "typed_lines", "s1")[0]["plain_text"] == "how do joins 1 spill"
    go("share", "typed_lines", "s1", str(tmp_path / "bundle"))
    other = str(tmp_path / "other")
    assert cli.run(spark, cli.parser().parse_args(["ingest", str(tmp_path / "bundle"), "--store", other])) == [{"sessions": 1, "messages": 1}]
    assert {"agent": "markdown"} in go("agents")


def test_runs(spark):
    cases = spark.createDataFrame([(k, 1 + k % 2, k % 2) for k in range(20)], "case int, gold int, hit int")
    assert runs.chosen_cases(cases, "case", 5, 42).count() == 5
    assert runs.chosen_cases(cases, "case", 5, 42).exceptAll(runs.chosen_cases(cases, "case", 5, 42)).count() == 0
    results = spark.createDataFrame([(0, 1.0, None), (1, 99.0, None), (2, 1.0, "x")], "case int, elapsed double, error string")
    got = {r.case: r.state for r in runs.outcomes(cases, results, "case", 10.0).collect()}
    assert (got[0], got[1], got[2], got[3]) == ("succeeded", "timed_out", "failed", "cancelled") and set(got.values()) <= set(runs.DONE)
    metrics = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "run string, f1 double")
    assert runs.run_means(metrics, "run", ["f1"]).first().f1 == 0.75
    delta = {r.metric: (r.delta, r.better) for r in runs.against(spark.createDataFrame([(0.5, 20.0)], "f1 double, wall_time double"), {"f1": 0.4445, "wall_time": 24.72}).collect()}
    assert delta == {"f1": (0.0555, True), "wall_time": (-4.72, True)}
    assert {r.kind: r.hit_rate for r in runs.split_gain(cases, "gold", "hit").collect()} == {"single": 0.0, "multiple": 1.0}
