"""Keyed state in streams: sessions, windows and waiting requests over many small batches."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_events import START, replay

from toolwarden.operators import sessions as SE
from toolwarden.streaming import jobs as J
from toolwarden.streaming import state as ST

SCHEMA = "request_id BIGINT, ts TIMESTAMP, session STRING, method STRING"
FAR = START + dt.timedelta(days=400)


def batches(spark, rows, cuts, path, schema=SCHEMA):
    """Rows as one file per batch, in the given order."""
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def arriving(rng, n, disorder, late):
    """Requests in order of arrival: most up to ``disorder`` seconds out of order, some far too late."""
    methods = ["initialize", "close", "tools/list", "tools/call", "tools/call", "tools/call"]
    rows = []
    for i in range(n):
        at = START + dt.timedelta(seconds=20 * i)
        delay = rng.choice([7200, 20000]) if rng.random() < late else rng.randint(0, disorder)
        session = None if rng.random() < 0.05 else f"s{rng.randint(0, 12)}"
        rows.append((at + dt.timedelta(seconds=delay), (i, at, session, rng.choice(methods))))
    return [r for _, r in sorted(rows, key=lambda r: (r[0], r[1][0]))]


def sentinel():
    return [(10**9, FAR, "end", "tools/list"), (10**9 + 1, FAR + dt.timedelta(days=1), "end", "tools/list")]


def judged(spark, rows, tmp_path, salts, cuts):
    source = batches(spark, rows, cuts, str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    ST.session_states(source, "session", out, checkpoint, lateness="10 minutes", salts=salts)
    return {r.row: (r.valid, r.late) for r in ST.session_results(spark, out).where("row < 1000000000").collect()}


def test_sessions_equal_the_batch_rule(spark, tmp_path):
    rng = random.Random(3)
    rows = arriving(rng, 420, 500, 0.04)
    cuts = [*range(0, 421, 70), 422]
    got = judged(spark, rows + sentinel(), tmp_path, 3, cuts)
    assert {i: v for i, (v, _) in got.items()} == replay(rows)
    assert 0 < sum(late for _, late in got.values()) < 60  # late rows were there and few others went with them


def test_late_rows_of_closed_sessions(spark, tmp_path):
    """An opening that comes when its session is closed and forgotten, and requests before and behind it."""
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [
        (1, at(0), "a", "initialize"), (2, at(1), "a", "close"), (3, at(5), "a", "tools/list"), (4, at(200), "b", "tools/list"),
        (5, at(300), "b", "tools/list"), (6, at(301), "c", "tools/list"),
        (7, at(4), "a", "initialize"), (8, at(302), "a", "tools/list"), (9, at(290), "b", "initialize"),
        (10, at(400), "c", "tools/list"), (11, at(401), "a", "tools/call"),
        (12, at(402), "a", "close"), (13, at(403), "a", "tools/call"), (14, at(404), "b", "tools/call"),
    ]
    got = judged(spark, rows + sentinel(), tmp_path, 2, [0, 4, 6, 9, 11, 14, 16])
    assert {i: v for i, (v, _) in got.items()} == replay(rows)
    assert got[3][0] and got[8][0] and got[11][0] and not got[13][0]


def test_late_change_beside_rows_that_wait(spark, tmp_path):
    """A close waits while an opening after it comes late in the batch that lets the watermark pass both."""
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [
        (1, at(0), "a", "initialize"), (2, at(3), "a", "close"), (3, at(60), "b", "tools/list"),
        (4, at(5), "a", "initialize"), (5, at(61), "b", "tools/list"), (6, at(120), "a", "tools/call"), (7, at(200), "b", "tools/list"),
    ]
    got = judged(spark, rows + sentinel(), tmp_path, 2, [0, 3, 5, 7, 9])
    assert {i: v for i, (v, _) in got.items()} == replay(rows)
    assert got[6][0]


def test_state_of_closed_sessions_is_gone(spark, tmp_path):
    """However many sessions came and went, the state holds what is open or waits."""
    rows = []
    for i in range(60):
        at = START + dt.timedelta(hours=i)
        rows += [(10 * i + k, at + dt.timedelta(seconds=k), f"s{i}", m) for k, m in enumerate(["initialize", "tools/list", "tools/call", "close"])]
    rows += [(9000, START + dt.timedelta(hours=70), "open", "initialize")]
    source = batches(spark, rows + sentinel()[:1], [*range(0, 241, 40), 241, 242], str(tmp_path / "in"))
    sizes = []

    def handle(batch, batch_id):
        batch.write.format("noop").mode("overwrite").save()

    with ST.keyed_state(spark):
        query = (
            ST.judged_sessions(source, "session", "request_id", "10 minutes", 2)
            .writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 7
    assert max(sizes) < 40 * 2 * 6 and sizes[-1] <= 20  # one open session in two states, one request that waits


def test_closed_windows(spark, tmp_path):
    rng = random.Random(9)
    rows = arriving(rng, 400, 300, 0.05)
    source = batches(spark, rows + sentinel(), [*range(0, 401, 50), 402], str(tmp_path / "in"))
    ST.closed_windows(source, str(tmp_path / "out"), str(tmp_path / "cp"), "5 minutes", lateness="10 minutes")
    got = {(r.window_start, r.method): (r.on_time, r.late) for r in ST.window_counts(spark, str(tmp_path / "out")).collect() if r.window_start < FAR - dt.timedelta(days=1)}
    want = {}
    for _, at, _, method in rows:
        start = at - dt.timedelta(minutes=at.minute % 5, seconds=at.second)
        want[start, method] = want.get((start, method), 0) + 1
    assert {k: a + b for k, (a, b) in got.items()} == want
    late = sum(b for _, b in got.values())
    assert 5 <= late <= 40


def test_answers_and_requests_of_two_streams(spark, tmp_path):
    rng = random.Random(4)
    schema = "request_id BIGINT, client STRING, ts TIMESTAMP, method STRING, n BIGINT"
    asked, told = [], []
    for i in range(200):
        at = START + dt.timedelta(seconds=60 * i)
        asked.append((rng.randint(0, 30), rng.choice(["a", "b", None]), at, rng.choice(["x", "y"]), i))
        told.append((rng.randint(0, 30), rng.choice(["a", "b", None]), at + dt.timedelta(seconds=rng.randint(0, 59)), "own", i))
    end = [(10**9, "end", FAR, "own", 10**9), (10**9, "end", FAR + dt.timedelta(days=1), "own", 10**9 + 1)]
    requests = batches(spark, asked + end, [*range(0, 201, 40), 202], str(tmp_path / "r"), schema).drop("n")
    answers = batches(spark, told + end, [*range(0, 201, 40), 202], str(tmp_path / "a"), schema)
    pairs = ST.answered_within(requests, answers, ["client"], "30 minutes", "10 minutes")
    query = (
        pairs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.n: (r.method, r.matched) for r in ST.latest_request(spark.read.parquet(str(tmp_path / "out")), ["n"]).collect() if r.n < 10**9}
    want = {}
    for rid, client, at, own, n in told:
        partners = [(t, m) for r, c, t, m, _ in asked if (r, c) == (rid, client) and dt.timedelta(0) <= at - t <= dt.timedelta(minutes=30)]
        want[n] = (max(partners)[1], True) if partners else (own, False)
    assert got == want and 10 < sum(m for _, m in got.values()) < 190
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 5 and sizes[-1] < 20 and max(sizes) < 300


def test_few_partitions_and_files(spark, tmp_path):
    """What a small batch costs follows the cores and the log's buckets, not the session's shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        rows = arriving(random.Random(5), 300, 300, 0.04)
        got = judged(spark, rows + sentinel(), tmp_path, 2, [0, 150, 302])
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {i: v for i, (v, _) in got.items()} == replay(rows)
    states = [p for p in (tmp_path / "cp" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(states) <= 2 * spark.sparkContext.defaultParallelism
    for batch in (tmp_path / "out" / "judged").glob("batch_id=*"):
        for bucket in batch.glob("late=*/bucket=*"):
            assert len(list(bucket.glob("*.parquet"))) <= ST.LOG_PIECES


def test_state_is_per_slot(spark, tmp_path):
    """Values of the state, and so the calls into it, do not grow with the sessions of a batch."""
    rows = []
    for i in range(3000):
        at = START + dt.timedelta(seconds=i % 60)
        rows += [(2 * i, at, f"s{i}", "initialize"), (2 * i + 1, at + dt.timedelta(seconds=1), f"s{i}", "tools/call")]
    source = batches(spark, rows + sentinel(), [0, 6000, 6002], str(tmp_path / "in"))
    with ST.keyed_state(spark):
        query = (
            ST.judged_sessions(source, "session", "request_id", "10 minutes", 2)
            .writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(str(tmp_path / "out")))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(sizes) < 4000
    got = spark.read.parquet(str(tmp_path / "out")).where("row < 1000000000")
    assert got.count() == got.where("valid AND NOT late").select("row").distinct().count() == 6000


def test_sessions_that_share_a_slot(spark, tmp_path):
    """Several sessions in one state, ids that are text."""
    rows = [(f"{i:05d}", *rest) for i, *rest in arriving(random.Random(8), 420, 500, 0.06)]
    source = batches(spark, rows + [("x1", *sentinel()[0][1:]), ("x2", *sentinel()[1][1:])], [*range(0, 421, 60), 422], str(tmp_path / "in"), SCHEMA.replace("request_id BIGINT", "request_id STRING"))
    out = str(tmp_path / "out")
    ST.session_states(source, "session", out, str(tmp_path / "cp"), lateness="10 minutes", salts=2, slots=2)
    got = {r.row: r.valid for r in ST.session_results(spark, out).where("row NOT LIKE 'x%'").collect()}
    assert got == replay(rows)


def test_order_within_a_millisecond(spark, tmp_path):
    """The time of a request counts to the microsecond, before its id."""
    at = lambda m, us: START + dt.timedelta(minutes=m, microseconds=us)
    rows = [
        (5, at(0, 300), "a", "initialize"), (4, at(0, 700), "a", "tools/call"), (3, at(30, 100), "a", "close"), (2, at(30, 101), "a", "tools/call"),
        (7, at(60, 500), "b", "tools/call"), (6, at(60, 900), "b", "initialize"), (8, at(61, 0), "b", "tools/call"),
        (1, at(0, 500), "a", "close"),
    ]
    got = judged(spark, rows + sentinel(), tmp_path, 2, [0, 4, 7, 8, 10])
    assert {i: v for i, (v, _) in got.items()} == replay(rows)
    assert not got[4][0] and got[1][1]


def test_requests_without_a_time(spark, tmp_path):
    """They come before all others of their session, as in the batch rule."""
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [
        (1, at(0), "a", "tools/call"), (2, at(40), "b", "initialize"), (3, at(41), "c", "tools/call"),
        (4, None, "a", "initialize"), (5, None, "a", "tools/call"), (6, at(90), "a", "tools/call"), (7, None, None, "tools/call"),
        (8, None, "b", "close"), (9, at(91), "b", "tools/call"), (10, at(92), "a", "close"), (11, at(93), "a", "tools/call"),
    ]
    got = judged(spark, rows + sentinel(), tmp_path, 2, [0, 3, 7, 11, 13])
    want = SE.with_session_validity(spark.createDataFrame(rows, SCHEMA), "session", "request_id").collect()
    assert {i: v for i, (v, _) in got.items()} == {r.request_id: r.valid for r in want}
    assert got[5][0] and got[6][0] and not got[11][0]


def test_late_rows_settle_what_follows_them(spark, tmp_path):
    """A late row of a long session has the rows since its batch began judged again, by the last change before them."""
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(i, at(i), "a", "initialize" if i in (0, 30) else "close" if i == 20 else "tools/call") for i in range(200)]
    rows += [(1000, at(150), "b", "tools/call"), (1001, at(170) + dt.timedelta(seconds=30), "a", "close"), (1002, at(300), "b", "tools/call")]
    got = judged(spark, rows + sentinel(), tmp_path, 2, [0, 60, 120, 201, 203, 205])
    assert {i: v for i, (v, _) in got.items()} == replay(rows)
    settled = [r.row for r in spark.read.parquet(str(tmp_path / "out" / "settled")).collect()]
    # Rows from 110 on leave the state with the late one, those before stand as they were.
    assert sorted(settled) == [*range(110, 190), 1001]
