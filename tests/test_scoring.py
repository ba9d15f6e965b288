import random

from data import DEMO, tools
from pyspark.sql import functions as F

from toolwarden.operators import scoring as S
from toolwarden.operators.metrics import risk_cumulative, risk_histogram, scan_totals


def test_demo_catalog(spark):
    scanned = S.scan_tools(tools(spark, DEMO))
    rows = {r.tool_name: r for r in scanned.collect()}
    for name, _, detectors, score in DEMO:
        assert {d.pattern_name: d.severity for d in rows[name].detections} == detectors, name
        assert rows[name].risk_score == score, name
        assert rows[name].blocked == (score >= 51)
    report = S.scan_report(scanned).first()
    assert (report.total_tools, report.tools_blocked, report.tools_warned, report.tools_safe) == (8, 7, 0, 1)
    assert report.max_risk_score == 100
    assert S.scan_gate(scanned).first().exit_code == 1
    kept = S.filter_catalog(tools(spark, DEMO), scanned)
    assert [r.tool_name for r in kept.collect()] == ["format_text"]
    diff = S.exposure_diff(tools(spark, DEMO), scanned).first()
    assert (diff.direct_tools, diff.protected_tools, diff.hidden_tools) == (8, 1, 7)


def python_score(severities):
    ordered = sorted(severities, reverse=True)
    if not ordered:
        return 0
    total = ordered[0]
    for i, s in enumerate(ordered[1:], start=1):
        total += s * (0.3 / i)
    return min(int(total), 100)


def test_score_equals_python(spark):
    rng = random.Random(5)
    cases = [[rng.choice([20, 25, 30, 40, 45, 60, 70, 75, 80, 85, 90]) for _ in range(rng.randint(0, 6))] for _ in range(300)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, s ARRAY<INT>")
    got = [r.x for r in df.select("i", S.risk_score(F.col("s")).alias("x")).orderBy("i").collect()]
    assert got == [python_score(c) for c in cases]


def test_levels_and_status(spark):
    df = spark.createDataFrame([(s,) for s in (0, 25, 26, 50, 51, 75, 76, 100)], "s INT")
    out = df.select(
        S.risk_level(F.col("s")).alias("level"), S.scan_status(F.col("s"), F.col("s") >= 51).alias("status")
    ).collect()
    assert [r.level for r in out] == ["safe"] * 2 + ["suspicious"] * 2 + ["risky"] * 2 + ["dangerous"] * 2
    assert [r.status for r in out] == ["SAFE"] * 2 + ["WARNING"] * 2 + ["BLOCKED"] * 4


def test_histogram_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0, 25, 26, 50, 51, 100)], "risk_score INT")
    assert {r.bucket: r.tools for r in risk_histogram(df).collect()} == {"0_25": 2, "26_50": 2, "51_75": 1, "76_100": 1}
    cumulative = {r.le: r.cumulative_tools for r in risk_cumulative(risk_histogram(df)).collect()}
    assert cumulative == {"25": 2, "50": 4, "75": 5, "100": 6, "+Inf": 6}


def test_duplicate_and_nameless_tools(spark):
    rows = [("twin", "Clean."), ("twin", "jailbreak"), (None, "jailbreak"), (None, "Clean."), ("solo", "Clean.")]
    catalog = tools(spark, rows)
    scanned = S.scan_tools(catalog)
    for options in ({}, {"write_names": True}):
        kept = S.filter_catalog(catalog, scanned, **options).select("tool_pos").collect()
        assert [r.tool_pos for r in kept] == [4]
    strict = S.filter_catalog(catalog, scanned, strict_names=True).select("tool_pos").collect()
    assert sorted(r.tool_pos for r in strict) == [2, 3, 4]


def test_hot_name_is_spread(spark):
    """One name on one server holds a third of the rows."""
    rows = [("hot", "Clean.")] * 100 + [(f"t{i}", "jailbreak" if i % 2 else "Clean.") for i in range(200)]
    catalog = tools(spark, rows)
    kept = S.filter_catalog(catalog, S.scan_tools(catalog))
    assert kept.count() == 200
    used = kept.where("tool_name = 'hot'").select(F.pmod(F.xxhash64("tool_pos"), F.lit(16)).alias("s")).distinct()
    assert used.count() > 8


def test_written_names_avoid_the_shuffle(spark, monkeypatch):
    from toolwarden.plans import skew

    catalog = tools(spark, DEMO)
    for limit, broadcast in ((100, True), (6, False)):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
        kept = S.filter_catalog(catalog, S.scan_tools(catalog), write_names=True)
        assert ("broadcast" in kept._jdf.queryExecution().logical().toString().lower()) == broadcast
        assert [r.tool_name for r in kept.collect()] == ["format_text"]


def test_empty_catalog(spark):
    scanned = S.scan_tools(tools(spark, []))
    assert scanned.count() == 0 and S.scan_report(scanned).count() == 0
    totals = scan_totals(S.scan_report(scanned)).first()
    assert (totals.scans, totals.tools_scanned) == (0, 0)


def test_thresholds(spark):
    scanned = S.scan_tools(tools(spark, [("t", "x <!-- y")]), block_threshold=45)
    row = scanned.first()
    assert (row.risk_score, row.blocked) == (45, True)
    report = S.scan_report(scanned, warn_threshold=50).first()
    assert (report.tools_blocked, report.tools_warned, report.tools_safe) == (1, 0, 1)


def test_rank(spark):
    ranked = S.severity_rank(S.scan_tools(tools(spark, DEMO))).where("tool_name = 'calculate'").orderBy("severity_rank")
    assert [(r.severity_rank, r.severity) for r in ranked.collect()] == [(1, 90), (2, 85), (3, 80), (4, 80), (5, 70)]


def test_scan_plan_is_narrow(spark):
    """Detection neither shuffles nor runs in Python, and is not copied into filters."""
    plan = (
        S.scan_tools(tools(spark, DEMO)).where("blocked").select("tool_name", "risk_score")
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    assert "Python" not in plan and "Repartition" not in plan
    assert plan.count("+prior") == 1
