"""Policy configuration: a small document read on the driver.

``policies:`` holds ``allowlist`` and ``blocklist`` (``tool_name``, ``server``),
``max_description_length``, ``required_patterns`` and ``server_trust``
(``server``, ``trust_level``, ``block_threshold``, ``warn_threshold``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from toolwarden import rules as R

ListRule = tuple[str, str]


@dataclass(frozen=True)
class Trust:
    server: str
    trust_level: str = "normal"
    block_threshold: int = R.BLOCK_THRESHOLD
    warn_threshold: int = R.WARN_THRESHOLD


@dataclass(frozen=True)
class Policy:
    """List rules as (tool glob, server glob) in file order."""

    blocklist: tuple[ListRule, ...] = ()
    allowlist: tuple[ListRule, ...] = ()
    max_description_length: int = 0
    required_patterns: tuple[str, ...] = ()
    server_trust: tuple[Trust, ...] = field(default=())

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        """``policy_rules(list, ord, tool_glob, server_glob)``."""
        rows = [
            (name, i, tool, server)
            for name, rules in (("block", self.blocklist), ("allow", self.allowlist))
            for i, (tool, server) in enumerate(rules)
        ]
        return spark.createDataFrame(
            rows, "list STRING, ord INT, tool_glob STRING, server_glob STRING"
        )

    def trust_frame(self, spark: SparkSession) -> DataFrame:
        """``server_trust``, one row per server."""
        rows = [
            (t.server, t.trust_level, t.block_threshold, t.warn_threshold)
            for t in self.server_trust
        ]
        return spark.createDataFrame(
            rows,
            "server_name STRING, trust_level STRING, block_threshold INT, warn_threshold INT",
        )


def policy_from_dict(config: dict | None) -> Policy:
    """Policy of a parsed document; a later trust entry of a server wins."""
    section = (config or {}).get("policies") or {}

    def rules(name: str) -> tuple[ListRule, ...]:
        return tuple(
            (r.get("tool_name", ""), r.get("server", "*")) for r in section.get(name) or ()
        )

    trust = {}
    for entry in section.get("server_trust") or ():
        known = {k: entry[k] for k in ("trust_level", "block_threshold", "warn_threshold") if k in entry}
        trust[entry.get("server", "")] = Trust(entry.get("server", ""), **known)
    return Policy(
        blocklist=rules("blocklist"),
        allowlist=rules("allowlist"),
        max_description_length=section.get("max_description_length") or 0,
        required_patterns=tuple(section.get("required_patterns") or ()),
        server_trust=tuple(trust.values()),
    )


def load_policy(path: str, spark: SparkSession | None = None) -> Policy:
    """Read a YAML document, or a JSON one: from any store that the session reads, or without a
    session from the driver's disk."""
    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return policy_from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("YAML policies need PyYAML; use a .json file instead") from error
    return policy_from_dict(yaml.safe_load(text))
