"""Policy decisions per tool: block list, allow list, length, server trust.

List rules come from a configuration document and are compiled into the
projection: plain names become hash sets and globs one expression, so matching
is narrow at any rule count.  Server trust is a lookup by
exact server name, broadcast while its row count allows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden.functions.net import in_trusted
from toolwarden.functions.text import IGNORE_CASE, any_of
from toolwarden.plans.skew import lookup_join
from toolwarden.sources.policy_config import ListRule, Policy


# Separate the parts of what a rule is matched against; no name has them.
_BETWEEN, _AFTER, _NO_SERVER = "\x00", "\x02", "\x01"


def _pair(name: Column, server: Column) -> Column:
    return F.concat(name, F.lit(_BETWEEN), F.coalesce(server, F.lit(_NO_SERVER)))


def _pair_regex(rule: ListRule) -> str:
    parts = ("[^\\x00-\\x02]*" + ("\\x01?" if glob == "*" else "") for glob in rule)
    return "\\x00".join(
        any_char.join(re.escape(literal) for literal in glob.split("*")) for any_char, glob in zip(parts, rule, strict=True)
    )


def is_listed(name: Column, server: Column, rules: tuple[ListRule, ...]) -> Column:
    """Do tool and server match a rule of the list?

    Rules without a glob are two hash sets, all others one expression, so a list
    of any length is planned at once."""
    pairs, names, globs = set(), set(), []
    for tool, srv in rules:
        if "*" not in tool and "*" not in srv:
            pairs.add(f"{tool.lower()}{_BETWEEN}{srv.lower()}")
        elif "*" not in tool and srv == "*":
            names.add(tool.lower())
        else:
            globs.append((tool, srv))
    tests = []
    if pairs:
        tests.append(F.lower(_pair(name, server)).isin(sorted(pairs)))
    if names:
        tests.append(F.lower(name).isin(sorted(names)))
    if globs:
        body = "|".join(map(_pair_regex, dict.fromkeys(globs)))
        tests.append(F.rlike(_pair(name, server), F.lit(f"{IGNORE_CASE}\\A(?:{body})\\z")))
    return any_of(tests)


def first_match(name: Column, server: Column, rules: tuple[ListRule, ...]) -> Column:
    """Position of the first matching rule of the list; NULL without one.

    Alternatives of an expression are tried in order, so the rules are one
    expression; each one that matches runs on to its number in a list of all
    numbers.  Only listed tools are tried."""
    if not rules:
        return F.lit(None).cast("int")
    numbers = "#".join(map(str, range(len(rules))))
    subject = F.concat(_pair(name, server), F.lit(f"{_AFTER}#{numbers}#"))
    body = "|".join(f"{_pair_regex(r)}\\x02.*?#{i}(?=#)" for i, r in enumerate(rules))
    found = F.regexp_extract(subject, f"{IGNORE_CASE}\\A(?:{body})", 0)
    number = F.regexp_extract(found, r"#(\d+)\z", 1)
    return F.when(is_listed(name, server, rules), F.when(number != "", number.cast("int")))


def with_server_thresholds(tools: DataFrame, policy: Policy) -> DataFrame:
    """Add the effective ``block_threshold`` and ``warn_threshold`` per server."""
    trust = policy.trust_frame(tools.sparkSession).select(
        "server_name",
        F.col("block_threshold").alias("_block"),
        F.col("warn_threshold").alias("_warn"),
    )
    return (
        lookup_join(tools, trust, ["server_name"], right_rows=len(policy.server_trust))
        .withColumn("block_threshold", F.coalesce("_block", F.lit(R.BLOCK_THRESHOLD)))
        .withColumn("warn_threshold", F.coalesce("_warn", F.lit(R.WARN_THRESHOLD)))
        .drop("_block", "_warn")
    )


def _decision(action: str, reason: Column, rule: str) -> Column:
    return F.struct(
        F.lit(action).alias("action"), reason.alias("reason"), F.lit(rule).alias("rule_name")
    )


def decide(tools: DataFrame, policy: Policy, use_score: bool = True) -> DataFrame:
    """Add the ``policy`` decision: block > allow > length > trust > default.

    Server trust looks at ``risk_score`` if the table has one and ``use_score``
    is set; otherwise the score counts as 0.
    """
    name = F.coalesce("tool_name", F.lit("unknown"))
    server = F.col("server_name")
    size = F.length(F.coalesce("description", F.lit("")))
    score = (
        F.col("risk_score") if use_score and "risk_score" in tools.columns else F.lit(0)
    )
    limit = policy.max_description_length
    trust = policy.trust_frame(tools.sparkSession).select(
        "server_name", F.col("block_threshold").alias("_threshold")
    )
    threshold = F.col("_threshold")
    quoted = F.concat(F.lit("tool '"), name, F.lit("'"))
    vs = F.concat(score.cast("string"), F.lit(" vs server threshold "), threshold.cast("string"))
    decision = (
        F.when(
            is_listed(name, server, policy.blocklist),
            _decision("block", F.concat(quoted, F.lit(" is on the block list")), "blocklist"),
        )
        .when(
            is_listed(name, server, policy.allowlist),
            _decision("allow", F.concat(quoted, F.lit(" is on the allow list")), "allowlist"),
        )
        .when(
            (F.lit(limit) > 0) & (size > limit),
            _decision(
                "block",
                F.concat(F.lit("description length "), size.cast("string"), F.lit(f" > {limit}")),
                "max_description_length",
            ),
        )
        .when(
            threshold.isNotNull() & (score >= threshold),
            _decision("block", F.concat(F.lit("risk score "), vs), "server_trust"),
        )
        .when(
            threshold.isNotNull() & (score > 0),
            _decision("allow", F.concat(F.lit("risk score "), vs), "server_trust"),
        )
        .otherwise(_decision("default", F.lit("no policy applies"), "none"))
    )
    return (
        lookup_join(tools, trust, ["server_name"], right_rows=len(policy.server_trust))
        .withColumn("policy", decision)
        .drop("_threshold")
    )


def trusted_sources(requests: DataFrame, trusted: list[str], address: str = "client_ip") -> DataFrame:
    """Requests from a trusted address."""
    return requests.where(in_trusted(F.col(address), trusted))


def rule_counts(policy: Policy) -> dict[str, int]:
    """Number of rules loaded, by kind."""
    return {
        "blocklist_rules": len(policy.blocklist),
        "allowlist_rules": len(policy.allowlist),
        "server_trust_rules": len(policy.server_trust),
    }
