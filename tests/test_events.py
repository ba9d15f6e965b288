"""As-of state, correlation and sessions against a replay in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from toolwarden.operators import sessions as SE
from toolwarden.sources import envelopes as EN

START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "request_id BIGINT, ts TIMESTAMP, session BIGINT, method STRING"
    )


def replay(rows):
    open_sessions, valid = set(), {}
    for rid, _, session, method in sorted(rows, key=lambda r: (r[1], r[0])):
        valid[rid] = method in ("initialize", "close") or session is None or session in open_sessions
        if session is None:
            continue
        if method == "initialize":
            open_sessions.add(session)
        elif method == "close":
            open_sessions.discard(session)
    return valid


@pytest.mark.parametrize("bucket", [1, 60, 86400])
def test_sessions(spark, bucket):
    rng = random.Random(7)
    methods = ["initialize", "close", "tools/list", "tools/call", "tools/call"]
    rows = [
        (i, START + dt.timedelta(seconds=rng.randint(0, 900)),
         None if rng.random() < 0.1 else (1 if rng.random() < 0.4 else rng.randint(2, 6)), rng.choice(methods))
        for i in range(400)
    ]
    out = SE.with_session_validity(frame(spark, rows), "session", "request_id", bucket)
    assert {r.request_id: r.valid for r in out.collect()} == replay(rows)


def test_correlation(spark):
    """Ids repeat: the latest unanswered request of the same client counts."""
    at = [START + dt.timedelta(seconds=s) for s in range(0, 400, 20)]
    asked = [(1, "a", at[0], "tools/list"), (1, "b", at[1], "tools/call"), (1, "a", at[4], "tools/call"), (2, "a", at[6], "ping")]
    replies = [
        (1, "a", at[2], "own"), (1, "a", at[3], "own"), (1, "b", at[5], "own"), (1, "a", at[15], "own"),
        (9, "a", at[7], "own"), (2, "a", at[5], "own"),
    ]
    schema = "request_id BIGINT, client STRING, ts TIMESTAMP, method STRING"
    out = SE.correlate(spark.createDataFrame(asked, schema), spark.createDataFrame(replies, schema), ["client"])
    got = {(r.request_id, r.client, r.ts): (r.method, r.matched) for r in out.collect()}
    assert got == {
        (1, "a", at[2]): ("tools/list", True),
        (1, "a", at[3]): ("own", False),
        (1, "b", at[5]): ("tools/call", True),
        (1, "a", at[15]): ("tools/call", True),
        (9, "a", at[7]): ("own", False),
        (2, "a", at[5]): ("own", False),
    }


def test_routes(spark):
    df = spark.createDataFrame([("tools/list",), ("tools/call",), ("initialize",)], "method STRING")
    assert [r.route for r in SE.with_route(df).collect()] == ["catalog", "response", "pass"]


def test_listing_messages(spark):
    values = [
        '{"jsonrpc":"2.0","id":1,"result":{"tools":[{"name":"a","description":"x","inputSchema":{"type":"object"}},{"description":"y"}]}}',
        '{"jsonrpc":"2.0","id":2,"result":{}}',
        '{"jsonrpc":"2.0","id":3,"error":{"code":1}}',
        "not json",
    ]
    out = EN.parse_listings(spark.createDataFrame([(v,) for v in values], "value STRING")).collect()
    assert [(r.message_id, r.tool_pos, r.tool_name, r.description) for r in out] == [("1", 0, "a", "x"), ("1", 1, None, "y")]
    assert out[0].input_schema == '{"type":"object"}'


def test_response_messages(spark):
    value = '{"id":5,"result":{"content":[{"type":"image","text":"i"},{"type":"text","text":""},{"type":"text","text":"hi"},{"type":"text"}]}}'
    out = EN.parse_responses(spark.createDataFrame([(value,)], "value STRING")).collect()
    assert [(r.message_id, r.item_pos, r.content) for r in out] == [("5", 2, "hi")]


def test_identity(spark):
    headers = {
        "X-Gateway-User": "alice@example.com", "X-Gateway-Role": "", "X-Gateway-Target": "srv", "Accept": "*/*",
    }
    df = spark.createDataFrame([(headers,), ({},)], "h MAP<STRING,STRING>")
    identity = EN.gateway_identity(F.col("h"))
    out = df.select(identity.alias("i"), EN.resolve_server_name(identity, F.lit("http://u")).alias("s")).collect()
    assert out[0].i == {"user": "alice@example.com", "target": "srv"} and out[0].s == "srv"
    assert out[1].i == {} and out[1].s == "upstream-http://u"
