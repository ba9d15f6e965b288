import pyarrow as pa
import pytest
from data import DEMO, tools
from pyspark.sql import functions as F

from toolwarden.operators import arrow_detectors as A
from toolwarden.operators import detectors as D
from toolwarden.operators import scoring as S

KEY = "AKq8Zr3Lw0Tn5Yb7Vd1Xc9Ms2Pf4Hj6G"


def shouting():
    """A detector with a NULL for texts it has nothing to say about."""

    def detect(names: pa.Array, descriptions: pa.Array) -> pa.Array:
        pairs = zip(names.to_pylist(), descriptions.to_pylist(), strict=True)
        rows = [{"severity": 20, "matched": t.isupper(), "evidence": n} if t else None for n, t in pairs]
        return pa.array(rows, pa.struct([("severity", pa.int32()), ("matched", pa.bool_()), ("evidence", pa.string())]))

    return detect


def test_entropy():
    assert A.entropy("a" * 30) == 0 and A.entropy("ab" * 12) == pytest.approx(1) and A.entropy(KEY) > 4.5


def test_after_the_native_detectors(spark):
    catalog = tools(spark, [("a", f"uses {KEY} here"), ("b", "ALL LOUD"), (None, None), ("c", "a" * 40)])
    arrow = {"Random Runs": A.random_runs, "Shouting": shouting()}
    rows = {r.tool_pos: r for r in A.with_all_detections(catalog, arrow).collect()}
    plain = {r.tool_pos: r for r in D.with_detections(catalog).collect()}
    for i, row in rows.items():
        assert row.detections[:-2] == plain[i].detections
        assert [d.pattern_name for d in row.detections[-2:]] == list(arrow)
    runs, loud = ({i: r.detections[k] for i, r in rows.items()} for k in (-2, -1))
    assert {i for i, d in runs.items() if d.matched} == {0} and runs[0].evidence == "1 run(s), first of 32" and runs[0].severity == 45
    assert {i for i, d in loud.items() if d.matched} == {1} and loud[1].evidence == "b" and loud[2].severity == 0
    assert set(A.with_all_detections(catalog, arrow).columns) == set(D.with_detections(catalog).columns)


def test_one_pass_of_arrow_batches(spark):
    catalog = tools(spark, DEMO)
    scanned = S.score_detections(A.with_all_detections(catalog, {"Random Runs": A.random_runs, "Shouting": shouting()}))
    used = scanned.where("blocked AND risk_score > 10").select("tool_name", "risk_score", F.size("detections"))
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    assert used.count() == 7


def test_chosen_detectors_and_empty_table(spark):
    catalog = tools(spark, DEMO)
    one = A.with_all_detections(catalog, {"Shouting": shouting()}, enabled=["Dangerous Commands"]).first()
    assert [d.pattern_name for d in one.detections] == ["Dangerous Commands", "Shouting"]
    assert A.with_all_detections(catalog.limit(0), {"Shouting": shouting()}).count() == 0
    none = A.with_all_detections(catalog, {}).first()
    assert len(none.detections) == len(D.DETECTOR_NAMES)
