"""Rule tables against a loop over all rules."""

import random
import re

from toolwarden.operators import policy as P
from toolwarden.operators import rule_tables as RT

RULES = "list STRING, ord INT, tool_glob STRING, server_glob STRING"


def matches(name, glob):
    return re.fullmatch(".*".join(map(re.escape, glob.lower().split("*"))), name.lower(), re.DOTALL) is not None


def plain(tools, rules):
    out = []
    for tool, server in tools:
        found = {}
        for kind, order, t, s in rules:
            named = "unknown" if tool is None else tool
            if matches(named, t) and (s == "*" if server is None else matches(server, s)):
                found[kind] = min(found.get(kind, order), order)
        out.append((tool, server, found.get("block"), found.get("allow")))
    return sorted(out, key=repr)


def got(spark, tools, rules):
    frame = spark.createDataFrame(tools, "tool_name STRING, server_name STRING")
    out = RT.with_first_rules(frame, spark.createDataFrame(rules, RULES))
    return sorted((tuple(r) for r in out.select("tool_name", "server_name", "block_ord", "allow_ord").collect()), key=repr)


def drawn(rng, n):
    letters = "aB_%!.x"
    word = lambda k: "".join(rng.choices(letters, k=rng.randint(0, k)))
    globs = [lambda: word(4), lambda: word(3) + "*", lambda: "*" + word(3), lambda: "*" + word(2) + "*", lambda: word(2) + "*" + word(2), lambda: "*", lambda: word(30) + "*"]
    glob = lambda: rng.choice(globs)()
    tools = [(rng.choice([None, word(5), word(4), word(40)]), rng.choice([None, word(3)])) for _ in range(n)]
    rules = [(rng.choice(["block", "allow"]), i, glob(), rng.choice(["*", glob()])) for i in range(n)]
    return tools + tools[:10], rules


def test_rules_equal_a_loop(spark):
    for seed in range(3):
        tools, rules = drawn(random.Random(seed), 150)
        assert got(spark, tools, rules) == plain(tools, rules)


def test_rules_equal_the_compiled_lists(spark):
    tools, rules = drawn(random.Random(9), 80)
    tools = [(t if t is not None else "unknown", s) for t, s in tools]
    frame = spark.createDataFrame(tools, "tool_name STRING, server_name STRING")
    block = [r for r in rules if r[0] == "block"]
    compiled = P.first_match(frame.tool_name, frame.server_name, tuple((t, s) for _, _, t, s in block))
    want = sorted(((r.tool_name, r.server_name, None if r.n is None else block[r.n][1]) for r in frame.withColumn("n", compiled).collect()), key=repr)
    assert [r[:3] for r in got(spark, tools, block)] == want


def test_empty_tables_and_clashing_columns(spark):
    assert got(spark, [("a", "b")], []) == [("a", "b", None, None)]
    assert got(spark, [], [("block", 0, "*", "*")]) == []
    clash = spark.createDataFrame([("a", "s", 7, "k")], "tool_name STRING, server_name STRING, ord INT, `list` STRING")
    out = RT.with_first_rules(clash, spark.createDataFrame([("block", 3, "A*", "S")], RULES)).first()
    assert (out.ord, out.list, out.block_ord, out.allow_ord) == (7, "k", 3, None)


def test_cost_follows_candidates(spark):
    """A hundred thousand rules from a table; each name meets the few that share its literal."""
    rules = spark.range(100_000).selectExpr(
        "if(id % 2 = 0, 'block', 'allow') AS list", "CAST(id AS INT) AS ord",
        "CASE id % 3 WHEN 0 THEN concat('tool_', id, '*') WHEN 1 THEN concat('*_', id) ELSE concat('t*l_', id) END AS tool_glob", "'*' AS server_glob",
    )
    names = spark.range(2000).selectExpr("concat('TOOL_', id) AS tool_name", "'s' AS server_name")
    out = RT.with_first_rules(names, rules)
    pairs = names.selectExpr("tool_name AS pair", "lower(tool_name) AS tool", "server_name AS server")
    indexed = RT.indexed_rules(rules)
    assert RT.rule_candidates(pairs, indexed).count() < 12_000
    row = {r.tool_name: (r.block_ord, r.allow_ord) for r in out.collect()}
    assert row["TOOL_1234"] == (12, 123) and len(row) == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" not in plan


def test_common_servers_and_long_literals(spark):
    """Rules of few servers, and literals inside globs that begin alike: a name still meets few of them."""
    rules = spark.range(40_000).selectExpr(
        "'block' AS list", "CAST(id AS INT) AS ord",
        "CASE id % 2 WHEN 0 THEN concat('tool_', id, '*') ELSE concat('*l_', 1000000 + id, '*') END AS tool_glob",
        "CASE id % 4 WHEN 0 THEN 'src1' WHEN 1 THEN 'SRC*' ELSE '*' END AS server_glob",
    )
    names = spark.range(300).selectExpr("concat('tool_', IF(id % 2 = 0, id, 1000000 + id)) AS tool_name", "'src1' AS server_name")
    pairs = names.selectExpr("tool_name AS pair", "tool_name AS tool", "server_name AS server")
    indexed = RT.indexed_rules(rules)
    assert indexed.where("side = 'server'").count() == 0
    assert indexed.groupBy("side", "how", "key").count().agg({"count": "max"}).first()[0] == 1
    found = {r.tool_name: r.block_ord for r in RT.with_first_rules(names, rules).collect()}
    assert len(found) == 300 and found["tool_124"] == 12 and found["tool_1000007"] == 7
    assert RT.rule_candidates(pairs, indexed).count() < 2_000
