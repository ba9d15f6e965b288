"""List rules from a table, of any number, met by an index of their literals.

A rule has a glob for the tool and one for the server.  Most globs begin or end with a literal,
or hold one; the rule is posted under that literal, of the side whose literal fewer rules have (a
server that many rules name tells little of them), or else of the one that says more.  A pair
of names looks up the literals it begins with, ends with or holds, of the lengths that occur in
rules, by an equality join; only the rules it meets there are compared with ``LIKE``.  So nothing
of the rules passes the driver but which lengths occur, and a pair costs its candidates, not the rules.

Names are compared in lower case, ``*`` stands for anything and nothing else is special; a NULL
tool counts as ``unknown``; a NULL server is matched by ``*`` alone.  Equal pairs of names are
looked up once; equal rules of a list count as the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden.plans.workspace import written

#: Code points of a literal that rules are posted under; of a literal inside a glob.
LONGEST, INSIDE = 24, 12
#: How a literal stands in a glob.
WHOLE, BEGINS, ENDS, HOLDS, NOTHING = "whole", "begins", "ends", "holds", "nothing"


def _posting(glob: Column) -> Column:
    """``how, key, weight`` of a lower-case glob: where its best literal stands."""
    parts = F.split(glob, r"\*")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    inside = F.array_max(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]

    def made(how: str, key: Column, weight: Column) -> Column:
        return F.struct(F.lit(how).alias("how"), key.alias("key"), weight.cast("int").alias("weight"))

    return (
        F.when(F.size(parts) == 1, made(WHOLE, glob, F.lit(1000)))
        .when((first != "") & (F.length(first) >= F.length(last)), made(BEGINS, F.left(first, F.lit(LONGEST)), F.length(first)))
        .when(last != "", made(ENDS, F.right(last, F.lit(LONGEST)), F.length(last)))
        .when(inside != "", made(HOLDS, F.left(inside, F.lit(INSIDE)), F.least(F.length(inside), F.lit(INSIDE))))
        .otherwise(made(NOTHING, F.lit(""), F.lit(0)))
    )


def like_pattern(glob: Column) -> Column:
    """The glob for ``LIKE … ESCAPE '!'``."""
    for special in "!%_":
        glob = F.replace(glob, F.lit(special), F.lit("!" + special))
    return F.replace(glob, F.lit("*"), F.lit("%"))


def _sharing(posted: DataFrame) -> DataFrame:
    """``side, how, key, n``: how many rules could be posted under each literal."""
    sides = [F.struct(F.lit(side).alias("side"), F.col(f"{at}.how").alias("how"), F.col(f"{at}.key").alias("key")) for side, at in (("tool", "pt"), ("server", "ps"))]
    literals = posted.select(F.inline(F.array(*sides))).where(F.col("how") != NOTHING)
    return literals.groupBy("side", "how", "key").agg(F.count("*").alias("n"))


def indexed_rules(rules: DataFrame) -> DataFrame:
    """``list, ord, tool_like, server_like, side, how, size, key`` of ``list, ord, tool_glob, server_glob``."""
    lower = rules.select(
        "list", "ord", F.lower(F.coalesce("tool_glob", F.lit(""))).alias("t"), F.lower(F.coalesce("server_glob", F.lit("*"))).alias("s")
    )
    once = lower.groupBy("list", "t", "s").agg(F.min("ord").alias("ord"))
    posted = once.select("*", _posting(F.col("t")).alias("pt"), _posting(F.col("s")).alias("ps"))
    sharing = _sharing(posted)
    for side, at in (("tool", "pt"), ("server", "ps")):
        n = sharing.where(F.col("side") == side).select(F.col("how").alias("_how"), F.col("key").alias("_key"), F.col("n").alias(f"{at}_n"))
        posted = posted.join(n, (F.col(f"{at}.how") == F.col("_how")) & (F.col(f"{at}.key") == F.col("_key")), "left").drop("_how", "_key")
    # A side without a literal is met by every pair: it counts as shared by all rules.
    many = F.lit(2**62)
    tool_n, server_n = F.coalesce("pt_n", many), F.coalesce("ps_n", many)
    tool = (tool_n < server_n) | ((tool_n == server_n) & (F.col("pt.weight") >= F.col("ps.weight")))
    best = F.when(tool, F.col("pt")).otherwise(F.col("ps"))
    return posted.select(
        "list", "ord", like_pattern(F.col("t")).alias("tool_like"), like_pattern(F.col("s")).alias("server_like"),
        F.when(tool, "tool").otherwise("server").alias("side"),
        best["how"].alias("how"), F.length(best["key"]).alias("size"), best["key"].alias("key"),
    )


def _looked_up(pairs: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """The literals under which each pair may meet rules; ``lengths`` says which lengths occur for
    each side and way, at most ``LONGEST`` each."""
    at = {way: F.array(*[F.lit(n) for n in sizes]).cast("array<int>") for way, sizes in lengths.items()}

    def literals(side: str) -> Column:
        name = F.col(side)

        def made(how: str, keys: Column) -> Column:
            return F.transform(keys, lambda k: F.struct(F.lit(side).alias("side"), F.lit(how).alias("how"), F.length(k).alias("size"), k.alias("key")))

        def of(how: str, key) -> Column:
            sizes = F.filter(at[f"{side}_{how}"], lambda n: n <= F.length(name))
            return made(how, F.transform(sizes, key))

        held = F.flatten(F.transform(
            F.filter(at[f"{side}_{HOLDS}"], lambda n: n <= F.length(name)),
            lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n)),
        ))
        every = F.concat(
            made(WHOLE, F.array(name)), of(BEGINS, lambda n: F.left(name, n)), of(ENDS, lambda n: F.right(name, n)),
            made(HOLDS, F.array_distinct(held)), made(NOTHING, F.array(F.lit(""))),
        )
        return F.when(name.isNotNull(), every).otherwise(made(NOTHING, F.array(F.lit(""))))

    return pairs.select("pair", "tool", "server", F.inline(F.array_distinct(F.concat(literals("tool"), literals("server")))))


def rule_candidates(pairs: DataFrame, indexed: DataFrame) -> DataFrame:
    """``pair, list, ord``: the rules that each pair of names meets under a literal and that match it."""
    ways = [(side, how) for side in ("tool", "server") for how in (BEGINS, ENDS, HOLDS)]
    lengths = indexed.agg(
        *[F.array_sort(F.collect_set(F.when((F.col("side") == side) & (F.col("how") == how), F.col("size")))).alias(f"{side}_{how}") for side, how in ways]
    ).first()
    lengths = {f"{side}_{how}": lengths[f"{side}_{how}"] for side, how in ways}
    met = _looked_up(pairs, lengths).join(indexed, ["side", "how", "size", "key"])
    server = F.when(F.col("server").isNull(), F.col("server_like") == "%").otherwise(F.expr("server LIKE server_like ESCAPE '!'"))
    return met.where(F.expr("tool LIKE tool_like ESCAPE '!'") & server).select("pair", "list", "ord")


def with_first_rules(tools: DataFrame, rules: DataFrame, lists: tuple[str, ...] = ("block", "allow")) -> DataFrame:
    """``tools`` with ``<list>_ord`` for each list: the first of its rules that matches, NULL without one."""
    name = F.lower(F.coalesce("tool_name", F.lit("unknown")))
    server = F.lower("server_name")
    key = F.sha2(F.concat(name, F.lit("\x00"), F.coalesce(server, F.lit("\x01"))), 256)
    keyed = tools.withColumn("_pair", key)
    pairs = keyed.select(F.col("_pair").alias("pair"), name.alias("tool"), server.alias("server")).dropDuplicates(["pair"])
    matched = rule_candidates(pairs, written(indexed_rules(rules), "rule-index"))
    first = matched.groupBy("pair").agg(*[F.min(F.when(F.col("list") == kind, F.col("ord"))).alias(f"{kind}_ord") for kind in lists])
    return keyed.join(first, F.col("_pair") == F.col("pair"), "left").drop("_pair", "pair")


def list_action(first: str = "block", then: str = "allow") -> Column:
    """What the lists decide: the first list before the other, ``default`` without a match."""
    return F.when(F.col(f"{first}_ord").isNotNull(), first).when(F.col(f"{then}_ord").isNotNull(), then).otherwise("default")
