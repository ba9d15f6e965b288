import hashlib

from data import tools
from pyspark.sql import functions as F

from toolwarden.operators import detectors as D
from toolwarden.operators import scoring as S
from toolwarden.operators import verdicts as V

def replies(spark, rows):
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(rows)], "cache_key STRING, reply STRING")


def test_parse(spark):
    rows = [
        '{"malicious": true, "confidence": 77}',
        '```json\n{"malicious": false, "confidence": 61}\n```',
        '  ```\n{"malicious": true, "severity": 7, "categories": ["A", "B"], "reasoning": "r"}\n```  ',
        "sorry",
        '{"malicious": true',
        None,
    ]
    out = V.parse_replies(replies(spark, rows)).orderBy("cache_key").collect()
    assert [r.parsed for r in out] == [True, True, True, False, False, None]
    assert [r.malicious for r in out] == [True, False, True, False, False, None]
    assert [r.confidence for r in out] == [77, 61, 0, 0, 0, None]
    assert out[2].categories == ["A", "B"] and out[0].categories == [] and out[5].categories is None


def test_threshold(spark):
    df = spark.createDataFrame([(True, 50, 80), (True, 70, 80), (False, 99, 0)], "malicious BOOLEAN, confidence INT, severity INT")
    out = V.apply_confidence(df).collect()
    assert [r.malicious for r in out] == [False, True, False] and out[0].severity == 80


def local_scorer():
    def run(batches):
        for batch in batches:
            reply = batch["description"].map(
                lambda d: None
                if "fail" in d
                else "oops"
                if "garbled" in d
                else '{"malicious": %s, "confidence": 95, "severity": 90, "categories": ["X"], "reasoning": "why"}'
                % str("attack" in d).lower()
            )
            yield batch[["cache_key"]].assign(reply=reply)

    return run


def test_scoring_is_once_per_text(spark):
    rows = [("a", "attack one"), ("a", "attack one"), ("b", "fine"), ("c", "fail"), ("d", "garbled"), ("e", "known")]
    catalog = tools(spark, rows)
    known = V.with_key(tools(spark, [("e", "known")])).select("cache_key")
    texts = V.distinct_texts(catalog, known)
    assert texts.count() == 4
    verdicts = V.apply_confidence(V.parse_replies(V.score_texts(texts, local_scorer(), tasks=2)))
    assert verdicts.where("parsed").count() == 2
    flags = {r.tool_pos: r.cached for r in V.with_cached_flag(catalog, "tool_pos", known).collect()}
    assert flags == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True}

    scanned = S.score_detections(V.with_semantic(D.with_detections(catalog), verdicts))
    out = {r.tool_pos: r for r in scanned.collect()}
    assert [out[i].risk_score for i in range(6)] == [90, 90, 0, 0, 0, 0]
    assert out[0].detections[-1].evidence == "confidence=95%, categories=[X]: why"


def test_detection_states(spark):
    schema = "malicious BOOLEAN, confidence INT, severity INT, categories ARRAY<STRING>, reasoning STRING"
    df = spark.createDataFrame(
        [(None, None, None, None, None), (True, 95, 90, ["P", "Q"], "r"), (True, 95, 90, [], "r"), (False, 95, 0, [], "ok")], schema
    )
    out = [r.d for r in df.select(V.semantic_detection().alias("d")).collect()]
    assert [(d.matched, d.severity) for d in out] == [(False, 0), (True, 90), (True, 90), (False, 0)]
    assert out[0].evidence == "no verdict" and "P, Q" in out[1].evidence and "unknown" in out[2].evidence


def test_key_and_retention(spark):
    row = V.with_key(tools(spark, [("t", "d")])).first()
    assert row.cache_key == hashlib.sha256(b"t:d").hexdigest()
    stored = spark.range(300).select(F.timestamp_seconds("id").alias("first_seen"), F.col("id").cast("string").alias("cache_key"))
    kept = V.retain(stored, 3).select("cache_key").collect()
    assert sorted(r.cache_key for r in kept) == ["297", "298", "299"]


def test_combined(spark):
    df = spark.createDataFrame(
        [(True, "why", True, 90), (True, "why", False, 10), (False, "ok", True, 60), (None, None, False, 0)],
        "malicious BOOLEAN, reasoning STRING, blocked BOOLEAN, risk_score INT",
    )
    out = [(r.combined_malicious, r.combined_reason) for r in V.combined_verdict(df).collect()]
    assert out == [(True, "semantic and rules, score 90"), (True, "semantic: why"), (True, "rules, score 60"), (False, "clean")]


def test_counters(spark):
    df = spark.createDataFrame([(True, False), (False, True)], "malicious BOOLEAN, cached BOOLEAN")
    assert tuple(V.semantic_counters(df).first()) == (2, 1, 1)


def test_loose_replies(spark):
    rows = [
        '{"malicious": true, "confidence": 87.5, "severity": 90.0, "categories": "SPY"}',
        '{"malicious": true, "confidence": "81", "severity": null, "categories": ["A", "B"]}',
        '{"malicious": true, "confidence": "high", "categories": {"a": 1}}',
        '{"malicious": false, "confidence": 99}',
    ]
    out = V.parse_replies(replies(spark, rows)).orderBy("cache_key").collect()
    assert [r.malicious for r in out] == [True, True, True, False] and all(r.parsed for r in out)
    assert [r.confidence for r in out] == [87, 81, 0, 99]
    assert [r.severity for r in out] == [90, 0, 0, 0]
    assert [r.categories for r in out][:2] == [["SPY"], ["A", "B"]]


def test_latest_of_several_verdicts(spark):
    verdicts = spark.createDataFrame(
        [("k", False, 10, 0, [], "old", 1), ("k", True, 90, 80, ["A"], "new", 2)],
        "cache_key STRING, malicious BOOLEAN, confidence INT, severity INT, categories ARRAY<STRING>, reasoning STRING, first_seen LONG",
    )
    rows = V.join_verdicts(spark.createDataFrame([("k", 1), ("x", 2)], "cache_key STRING, id INT"), verdicts).orderBy("id").collect()
    assert [(r.id, r.malicious, r.reasoning) for r in rows] == [(1, True, "new"), (2, None, None)]
