"""The registered queries: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden.functions.glob import matches_glob
from toolwarden.operators import arrow_detectors as AD
from toolwarden.operators import counters as CT
from toolwarden.operators import detectors as D
from toolwarden.operators import enforcement as E
from toolwarden.operators import metrics as M
from toolwarden.operators import policy as P
from toolwarden.operators import responses as F_
from toolwarden.operators import rule_tables as RT
from toolwarden.operators import scoring as S
from toolwarden.operators import scoring_log as SL
from toolwarden.operators import sessions as SE
from toolwarden.operators import verdict_store as VST
from toolwarden.operators import verdicts as VD
from toolwarden.plans.workspace import fresh_path, written
from toolwarden.sources import audit as AU
from toolwarden.sources import audit_store as AS
from toolwarden.sources import envelopes as EN
from toolwarden.sources import metrics_text as MT
from toolwarden.sources import reports as RP
from toolwarden.sources.policy_config import Policy, policy_from_dict
from toolwarden.streaming import jobs as J
from toolwarden.streaming import messages as MS
from toolwarden.streaming import state as ST
from workload import views as V

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# --- configuration of the queries ------------------------------------------

POLICY_DOCUMENT = {
    "policies": {
        "blocklist": [
            {"tool_name": "tool_1*", "server": "src1"},
            {"tool_name": "TOOL_7"},
        ],
        "allowlist": [
            {"tool_name": "tool_16", "server": "*"},
            {"tool_name": "*", "server": "src9"},
        ],
        "max_description_length": 5000,
        "required_patterns": ["Prompt Injection", "Dangerous Commands"],
        "server_trust": [
            {"server": "src2", "trust_level": "low", "block_threshold": 30, "warn_threshold": 15},
            {"server": "src3", "trust_level": "high", "block_threshold": 40},
            {"server": "src3", "trust_level": "high", "block_threshold": 95, "warn_threshold": 51},
        ],
    }
}
TRUSTED = ["10.0.0.0/10", "10.100.0.5", "not-an-address/8"]
GLOBS = ("tool_1*", "TOOL_7", "*9", "t*l_2*5", "*")


def policy() -> Policy:
    return policy_from_dict(POLICY_DOCUMENT)


def _scan(spark: SparkSession, sf_dir: str, evidence: bool = False, **options) -> DataFrame:
    return S.scan_tools(V.catalog(spark, sf_dir), evidence=evidence, **options)


def _responses(spark: SparkSession, sf_dir: str, **switches) -> DataFrame:
    return F_.scan_responses(V.responses(spark, sf_dir), **switches)


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kill-switch writes: one per error event."""
    return (
        V.requests(spark, sf_dir)
        .where("method = 'other'")
        .select("request_id", "ts", (F.col("value") > 35).alias("enabled"))
    )


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.requests(spark, sf_dir).select(
        "request_id", "ts", (F.col("value") / 1000).alias("duration_seconds")
    )


# --- sources and sinks -------------------------------------------------------


def listing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list-tools message per document: the tool and a nameless one; every
    seventh carries an error instead of a result."""
    doc = V.catalog(spark, sf_dir)
    ok = F.to_json(
        F.struct(
            F.lit("2.0").alias("jsonrpc"),
            F.col("tool_id").alias("id"),
            F.struct(
                F.array(
                    F.struct(F.col("tool_name").alias("name"), F.col("description")),
                    F.struct(F.lit(None).cast("string").alias("name"), F.lit("Says pong.").alias("description")),
                ).alias("tools")
            ).alias("result"),
        )
    )
    failed = F.to_json(
        F.struct(
            F.lit("2.0").alias("jsonrpc"),
            F.col("tool_id").alias("id"),
            F.struct(F.lit(-32603).alias("code")).alias("error"),
        )
    )
    return doc.select("server_name", F.when(F.col("tool_id") % 7 == 6, failed).otherwise(ok).alias("value"))


@query
def src_tool_catalog(spark, sf_dir):
    tools = EN.parse_listings(listing_messages(spark, sf_dir))
    return tools.select("server_name", "message_id", "tool_pos", "tool_name", "description")


@query
def src_tool_responses(spark, sf_dir):
    messages = V.responses(spark, sf_dir).select(
        F.to_json(
            F.struct(
                F.col("response_id").alias("id"),
                F.struct(
                    F.array(
                        F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")),
                        F.struct(F.lit("text").alias("type"), F.lit("").alias("text")),
                        F.struct(F.lit("text").alias("type"), F.col("content").alias("text")),
                    ).alias("content")
                ).alias("result"),
            )
        ).alias("value"),
        F.col("item_pos").alias("turn"),
    )
    return EN.parse_responses(messages)


@query
def src_policy_config(spark, sf_dir):
    """Loaded thresholds per tool's server, and the rules that apply to it."""
    rules = policy()
    tools = P.with_server_thresholds(V.catalog(spark, sf_dir), rules)
    name, server = F.col("tool_name"), F.col("server_name")
    return tools.groupBy("server_name", "block_threshold", "warn_threshold").agg(
        F.count("*").alias("tools"),
        F.count_if(P.is_listed(name, server, rules.blocklist)).alias("block_listed"),
        F.count_if(P.is_listed(name, server, rules.allowlist)).alias("allow_listed"),
    )


@query
def src_gateway_identity(spark, sf_dir):
    requests = V.requests(spark, sf_dir)
    headers = F.create_map(
        F.lit("X-Gateway-User"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")),
        F.lit("X-Gateway-Role"),
        F.when(F.col("method") == "tools/call", "admin").when(F.col("method") == "close", ""),
        F.lit("X-Gateway-Target"),
        F.when(F.col("user_id") % 2 == 0, "srv"),
        F.lit("Accept"),
        F.lit("*/*"),
    )
    identity = EN.gateway_identity(headers)
    return requests.select("request_id", F.to_json(identity).alias("identity"))


def _audited(spark, sf_dir) -> DataFrame:
    scanned = _scan(spark, sf_dir, evidence=True)
    ts = F.timestamp_seconds(F.lit(1704067200) + (F.col("tool_id") % 3) * 86400)
    # Even servers were asked by a known user, the others without identity.
    known = F.substring("server_name", 4, 9).cast("int") % 2 == 0
    user = F.create_map(F.lit("user"), F.concat(F.lit("u-"), F.col("server_name")))
    identity = F.when(known, user).otherwise(F.create_map().cast("map<string,string>"))
    return scanned.withColumn("timestamp", ts).withColumn("identity", identity).withColumn(
        "scan_id", F.concat(F.col("server_name"), F.lit("-"), F.date_format("timestamp", "yyyyMMdd"))
    )


def _audit_log(spark, sf_dir) -> str:
    path = fresh_path(spark, "audit")
    lines = written(_audited(spark, sf_dir).drop("description"), "audited")
    AU.log_scan(lines, path, F.col("identity"))
    return path


@query
def sink_audit_jsonl(spark, sf_dir):
    reports = AU.read_audit(spark, _audit_log(spark, sf_dir), AU.REPORTS)
    return reports.select(
        "scan_id", "server_name", F.col("date").cast("string").alias("date"), "total_tools",
        "tools_blocked", "tools_warned", "tools_safe", "max_risk_score",
        F.to_json("gateway_identity").alias("identity"),
    )


@query
def sink_audit_store(spark, sf_dir):
    """Audit lines of all scans under one commit, written twice under the same batch: results by day, and their reports."""
    path = fresh_path(spark, "audit-store")
    lines = written(_audited(spark, sf_dir).drop("description"), "audited")
    for _ in range(2):
        AS.log_scan(lines, path, "scans", F.col("identity"))
    results, reports = (AS.read_audit(spark, path, kind) for kind in (AU.RESULTS, AU.REPORTS))
    history = AU.audit_history(results, reports)
    known = reports.groupBy("date").agg(F.count("gateway_identity").alias("with_identity"))
    return history.join(known, "date").withColumn("date", F.col("date").cast("string"))


@query
def src_audit_replay(spark, sf_dir):
    path = _audit_log(spark, sf_dir)
    results = AU.read_audit(spark, path, AU.RESULTS)
    reports = AU.read_audit(spark, path, AU.REPORTS)
    history = AU.audit_history(results, reports)
    return history.withColumn("date", F.col("date").cast("string"))


@query
def sink_metrics_text(spark, sf_dir):
    return MT.metric_lines(_metrics(spark, sf_dir)).select("name", "part", "line")


@query
def sink_markdown_report(spark, sf_dir):
    path = fresh_path(spark, "markdown")
    scanned = written(_scan(spark, sf_dir, evidence=True).drop("description"), "scanned")
    RP.write_markdown(RP.markdown_lines(scanned, "tool_id"), path)
    return spark.read.text(path).select("server_name", F.col("value").alias("line"))


# --- detectors -----------------------------------------------------------------


@query
def det_arrow(spark, sf_dir):
    """A detector over Arrow arrays beside the native ones, and the score of all."""
    detected = AD.with_all_detections(V.catalog(spark, sf_dir), {"Random Runs": AD.random_runs}, evidence=False)
    detected = detected.withColumn("own", F.element_at("detections", -1))
    return S.score_detections(detected).select("tool_id", "risk_score", "own.matched", "own.severity", "own.evidence")


def _detector(name: str) -> Query:
    def run(spark, sf_dir):
        return D.detect(V.catalog(spark, sf_dir), name).select(
            "tool_id", "severity", "matched", "evidence"
        )

    return run


DETECTOR_KEYS = {
    "det_prompt_injection": "Prompt Injection",
    "det_data_exfiltration": "Data Exfiltration",
    "det_cross_tool": "Cross-Tool Manipulation",
    "det_invisible_chars": "Invisible Characters",
    "det_obfuscated": "Obfuscated Payloads",
    "det_anomalies": "Description Anomalies",
    "det_dangerous_cmds": "Dangerous Commands",
    "det_ssrf": "SSRF / Internal Access",
}
for _key, _name in DETECTOR_KEYS.items():
    _QUERIES[_key] = _detector(_name)


@query
def detections_long(spark, sf_dir):
    return D.detections_long(V.catalog(spark, sf_dir)).select(
        "tool_id", "detector_pos", "pattern_name", "severity", "matched"
    )


ENABLED = ("Cross-Tool Manipulation", "Invisible Characters")


@query
def det_enabled_subset(spark, sf_dir):
    return _scan(spark, sf_dir, enabled=ENABLED).select("tool_id", "risk_score")


@query
def required_detectors(spark, sf_dir):
    names = D.enabled_detectors(ENABLED, policy().required_patterns)
    return _scan(spark, sf_dir, enabled=names).select("tool_id", "risk_score")


@query
def evidence_samples(spark, sf_dir):
    """Evidence of the matched detections, cut for printing."""
    return _scan(spark, sf_dir, evidence=True).select(
        "tool_id", F.inline("detections")
    ).select("tool_id", "pattern_name", F.left("evidence", F.lit(80)).alias("evidence"))


# --- scoring ---------------------------------------------------------------------


@query
def risk_score(spark, sf_dir):
    return _scan(spark, sf_dir).select("tool_id", "risk_score")


@query
def risk_level(spark, sf_dir):
    return _scan(spark, sf_dir).groupBy("risk_level").agg(F.count("*").alias("tools"))


@query
def block_decision(spark, sf_dir):
    return _scan(spark, sf_dir, block_threshold=80).select("tool_id", "blocked")


@query
def scan_tools(spark, sf_dir):
    return _scan(spark, sf_dir).select(
        "tool_id", "server_name", "tool_name", "risk_score", "risk_level", "blocked",
        F.array_join("detections.pattern_name", ",").alias("patterns"),
    )


@query
def scan_report(spark, sf_dir):
    return S.scan_report(_scan(spark, sf_dir))


@query
def filter_catalog(spark, sf_dir):
    tools = V.catalog(spark, sf_dir)
    kept = S.filter_catalog(tools, S.scan_tools(tools, evidence=False), write_names=True)
    return kept.select(
        "tool_id", "server_name", "tool_name"
    )


@query
def filter_listings(spark, sf_dir):
    """Every list-tools message filtered by itself."""
    tools = EN.parse_listings(listing_messages(spark, sf_dir))
    listing = ["server_name", "message_id"]
    return S.filter_catalog(tools, S.scan_tools(tools, evidence=False), by=listing).select(*listing, "tool_pos", "tool_name")


@query
def scan_gate(spark, sf_dir):
    return S.scan_gate(_scan(spark, sf_dir, block_threshold=100))


@query
def exposure_diff(spark, sf_dir):
    tools = V.catalog(spark, sf_dir)
    return S.exposure_diff(tools, S.scan_tools(tools, evidence=False))


@query
def scan_status(spark, sf_dir):
    return _scan(spark, sf_dir).select(
        "tool_id", S.scan_status(F.col("risk_score"), F.col("blocked")).alias("status")
    )


@query
def win_severity_rank(spark, sf_dir):
    return S.severity_rank(_scan(spark, sf_dir)).select(
        "tool_id", "severity_rank", "pattern_name", "severity"
    )


# --- policy ------------------------------------------------------------------------


@query
def policy_glob_match(spark, sf_dir):
    name = F.col("tool_name")
    return V.catalog(spark, sf_dir).select(
        "tool_id",
        *[matches_glob(name, g).alias(f"glob_{i}") for i, g in enumerate(GLOBS)],
    )


def _listed(spark, sf_dir, rules) -> DataFrame:
    tools = V.catalog(spark, sf_dir)
    return tools.where(P.is_listed(F.col("tool_name"), F.col("server_name"), rules)).select(
        "tool_id", "tool_name", "server_name"
    )


@query
def policy_blocklist(spark, sf_dir):
    return _listed(spark, sf_dir, policy().blocklist)


@query
def policy_allowlist(spark, sf_dir):
    rules = policy()
    name, server = F.col("tool_name"), F.col("server_name")
    return _listed(spark, sf_dir, rules.allowlist).where(
        ~P.is_listed(name, server, rules.blocklist)
    )


@query
def policy_max_length(spark, sf_dir):
    decided = P.decide(V.catalog(spark, sf_dir), Policy(max_description_length=2000))
    return decided.select("tool_id", "policy.action", "policy.reason")


@query
def policy_server_trust(spark, sf_dir):
    rules = Policy(server_trust=policy().server_trust)
    return P.decide(_scan(spark, sf_dir), rules).select(
        "tool_id", "policy.action", "policy.reason", "policy.rule_name"
    )


@query
def policy_decide(spark, sf_dir):
    return P.decide(_scan(spark, sf_dir), policy()).select(
        "tool_id", "policy.action", "policy.reason", "policy.rule_name"
    )


@query
def server_thresholds(spark, sf_dir):
    return (
        P.with_server_thresholds(V.catalog(spark, sf_dir).select("server_name"), policy())
        .groupBy("server_name", "block_threshold", "warn_threshold")
        .agg(F.count("*").alias("tools"))
    )


@query
def policy_first_match(spark, sf_dir):
    rules = policy()
    name, server = F.col("tool_name"), F.col("server_name")
    return V.catalog(spark, sf_dir).select(
        "tool_id",
        P.first_match(name, server, rules.blocklist).alias("block_rule"),
        P.first_match(name, server, rules.allowlist).alias("allow_rule"),
    )


@query
def enforce_catalog(spark, sf_dir):
    delivered = E.enforce_catalog(
        V.catalog(spark, sf_dir), policy(), write_names=True
    )
    return delivered.select(
        "tool_id", "server_name", "tool_name", "readded"
    )


@query
def enforcement_summary(spark, sf_dir):
    return E.enforcement_summary(E.judge_catalog(V.catalog(spark, sf_dir), policy(), evidence=False))


@query
def enforcement_blocked(spark, sf_dir):
    return E.blocked_tools(E.judge_catalog(V.catalog(spark, sf_dir), policy(), evidence=False))


def _listings(spark, sf_dir) -> DataFrame:
    return V.requests(spark, sf_dir).where("method = 'tools/list'").select("request_id", "ts", "user_id")


@query
def kill_switch_filter(spark, sf_dir):
    """Listings that pass the switch, by its state at their time."""
    state = E.switch_state(_listings(spark, sf_dir), _controls(spark, sf_dir).drop("request_id"))
    return E.kill_switch_filter(state, F.col("kill_switch")).select("request_id", "user_id")


@query
def kill_switch_hidden(spark, sf_dir):
    state = E.switch_state(_listings(spark, sf_dir), _controls(spark, sf_dir).drop("request_id"))
    return state.groupBy("kill_switch").agg(F.count("*").alias("listings"))


@query
def server_name_resolve(spark, sf_dir):
    requests = V.requests(spark, sf_dir)
    identity = F.map_filter(
        F.create_map(F.lit("target"), F.when(F.col("method") == "tools/list", "gateway")),
        lambda k, v: v.isNotNull(),
    )
    url = F.concat(F.lit("http://"), F.col("client_ip"))
    return requests.select("request_id", EN.resolve_server_name(identity, url).alias("server_name"))


@query
def trusted_source(spark, sf_dir):
    return P.trusted_sources(V.requests(spark, sf_dir), TRUSTED).select("request_id", "client_ip")


# --- responses -----------------------------------------------------------------------


def _findings(**switches) -> Query:
    def run(spark, sf_dir):
        return F_.findings_long(_responses(spark, sf_dir, **switches)).select(
            "response_id", "item_pos", "finding_pos", "finding_type", "severity", "redacted_evidence"
        )

    return run


_QUERIES["find_secrets"] = _findings(pii=False, data_leak=False)
_QUERIES["find_pii"] = _findings(secrets=False, data_leak=False)
_QUERIES["find_data_leaks"] = _findings(secrets=False, pii=False)
_QUERIES["scanner_switches"] = _findings(pii=False)


@query
def luhn_valid(spark, sf_dir):
    """Luhn test of every order's padded numbers."""
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    number = F.concat(
        F.lpad(F.col("o_custkey").cast("string"), 7, "4"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    )
    return orders.select("o_orderkey", F_.luhn_valid(number).alias("valid"))


@query
def find_json_dump(spark, sf_dir):
    """Long responses built from the conversations: JSON or almost JSON."""
    text = F.concat(F.lit('{"v":['), F.repeat(F.lit("1,"), 2600), F.lit("1],\"t\":"))
    tail = F.when(F.col("item_pos") % 3 == 0, "}").when(F.col("item_pos") % 3 == 1, "} x").otherwise("")
    content = F.concat(text, F.to_json(F.array("content")), tail)
    dumps = F_.with_json_dump(V.responses(spark, sf_dir).withColumn("content", content), "is_json_dump")
    return dumps.select("response_id", "item_pos", F.coalesce("is_json_dump", F.lit(False)).alias("is_json_dump"))


@query
def scan_responses(spark, sf_dir):
    return _responses(spark, sf_dir).select(
        "response_id", "item_pos", "content_length", "risk_level", "should_redact",
        F.array_join("findings.finding_type", ",").alias("types"),
    )


@query
def mask_evidence(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F_.mask_evidence(F.col("s_name")).alias("masked"),
        F_.mask_evidence(F.left("s_name", F.lit(8))).alias("masked_short"),
    )


@query
def redact_responses(spark, sf_dir):
    return F_.redact_responses(_responses(spark, sf_dir)).select("response_id", "item_pos", "content")


@query
def response_summary(spark, sf_dir):
    return F_.response_summary(_responses(spark, sf_dir)).select(
        "response_id", "item_pos", "findings_count", "risk_level",
        F.array_join("findings.finding_type", ",").alias("types"),
    )


# --- semantic verdicts ------------------------------------------------------------------


def verdict_replies(spark, sf_dir) -> DataFrame:
    """A scorer's reply per labelled document, from its labels."""
    labels = V.table(spark, sf_dir, "labels")
    body = F.concat(
        F.lit('{"malicious": '), F.when(F.col("toxic") == 1, "true").otherwise("false"),
        F.lit(', "confidence": '), (50 + F.col("doc_id") % 50).cast("string"),
        F.lit(', "severity": '), (F.col("toxic") * 90).cast("string"),
        F.lit(', "categories": ['), F.when(F.col("toxic") == 1, '"PROMPT_INJECTION", "OBFUSCATION"').otherwise(""),
        F.lit('], "reasoning": "quality '), F.col("quality").cast("string"), F.lit('"}'),
    )
    kind = F.col("doc_id") % 5
    reply = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.lit("not json"))
        .when(kind == 3, F.lit('{"malicious": true}'))
        .when(kind != 4, body)
    )
    return labels.select("doc_id", reply.alias("reply"))


def _verdicts(spark, sf_dir) -> DataFrame:
    """Verdict per text of the labelled documents (copies share one)."""
    texts = VD.with_key(V.catalog(spark, sf_dir)).select(F.col("tool_id").alias("doc_id"), "cache_key")
    parsed = VD.apply_confidence(VD.parse_replies(verdict_replies(spark, sf_dir)))
    return texts.join(parsed, "doc_id")


@query
def verdict_key(spark, sf_dir):
    return VD.with_key(V.catalog(spark, sf_dir)).select("tool_id", "cache_key")


def _offers(spark, sf_dir) -> DataFrame:
    """Documents as tools named after their server, so that copies share a text."""
    return V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("tool_id"), F.lit("tool").alias("tool_name"), F.col("text").alias("description")
    )


@query
def verdict_dedup(spark, sf_dir):
    return VD.with_cached_flag(_offers(spark, sf_dir), "tool_id").select("tool_id", "cache_key", "cached")


def _stub():
    def score(batches):
        for batch in batches:
            bad = batch["description"].str.contains("Ignore all previous", regex=False)
            reply = bad.map(
                lambda b: '{"malicious": true, "confidence": 90, "severity": 85, "categories": ["PROMPT_INJECTION"]}'
                if b
                else '{"malicious": false, "confidence": 95}'
            )
            yield pd.DataFrame({"cache_key": batch["cache_key"], "reply": reply})

    return score


@query
def verdict_score(spark, sf_dir):
    texts = VD.distinct_texts(V.catalog(spark, sf_dir))
    replies = VD.parse_replies(VD.score_texts(texts, _stub()))
    return replies.select("cache_key", "malicious", "confidence", "severity")


@query
def verdict_score_stored(spark, sf_dir):
    """Only texts that no even tool has are scored: the others have a stored verdict."""
    tools = V.catalog(spark, sf_dir)
    stored = VD.with_key(tools.where("tool_id % 2 = 0")).select("cache_key")
    replies = VD.parse_replies(VD.score_texts(VD.distinct_texts(tools, stored), _stub()))
    return replies.select("cache_key", "malicious", "confidence", "severity")


#: Tasks that ask the scorer, and texts that each has in a wave.
SCORING_TASKS, SCORING_CHUNK = 8, 256


@query
def verdict_score_log(spark, sf_dir):
    """Scoring in two runs over one log, the texts of even tools and then all: every text is asked for once."""
    path, tools = fresh_path(spark, "scoring-log"), V.catalog(spark, sf_dir)
    for some in (tools.where("tool_id % 2 = 0"), tools):
        replies = SL.score_with_progress(VD.distinct_texts(some), _stub(), path, SCORING_TASKS, SCORING_CHUNK)
    return VD.parse_replies(replies).select("cache_key", "malicious", "confidence", "severity", "calls")


@query
def verdict_parse(spark, sf_dir):
    return VD.parse_replies(verdict_replies(spark, sf_dir)).select(
        "doc_id", "parsed", "malicious", "confidence", "severity",
        F.array_join("categories", ",").alias("categories"), "reasoning",
    )


@query
def verdict_threshold(spark, sf_dir):
    verdicts = VD.apply_confidence(VD.parse_replies(verdict_replies(spark, sf_dir)))
    return verdicts.select("doc_id", "malicious", "confidence", "severity")


@query
def verdict_retention(spark, sf_dir):
    stored = V.requests(spark, sf_dir).select(
        F.col("ts").alias("first_seen"), F.sha2(F.col("request_id").cast("string"), 256).alias("cache_key")
    )
    return VD.retain(stored).select("cache_key")


#: Verdicts that the store of the query keeps, and batches that come to it.
STORE_CAPACITY, STORE_BATCHES = 300, 6


@query
def verdict_store(spark, sf_dir):
    """What is stored after all documents came in batches: every text once while it is there, the
    last ones by insertion."""
    store = VST.VerdictStore(spark, fresh_path(spark, "verdict-store"), STORE_CAPACITY)
    documents = V.table(spark, sf_dir, "documents")
    offers = VD.with_key(
        documents.select("doc_id", F.col("lang").alias("tool_name"), F.col("text").alias("description"))
    ).select("doc_id", "cache_key")
    offers = written(offers, "store-offers")
    for batch in range(STORE_BATCHES):
        new = offers.where(F.col("doc_id") % STORE_BATCHES == batch).groupBy("cache_key").agg(F.min("doc_id").alias("first_seen"))
        new = VST.unknown_texts(store, new.withColumn("first_seen", F.col("first_seen") + batch * 10**12))
        store.put(written(new, "store-new"), batch)
    return store.rows().select("cache_key", F.floor(F.col("first_seen") / 10**12).alias("batch"))


@query
def det_semantic(spark, sf_dir):
    tools = VD.with_key(V.catalog(spark, sf_dir)).select("tool_id", "cache_key")
    joined = VD.join_verdicts(tools, _verdicts(spark, sf_dir))
    return joined.withColumn("_d", VD.semantic_detection()).select(
        "tool_id", "_d.severity", "_d.matched", "_d.evidence"
    )


@query
def combined_verdict(spark, sf_dir):
    scanned = VD.with_key(_scan(spark, sf_dir)).select("tool_id", "cache_key", "risk_score", "blocked")
    joined = VD.join_verdicts(scanned, _verdicts(spark, sf_dir))
    return VD.combined_verdict(joined).select("tool_id", "combined_malicious", "combined_reason")


@query
def scan_with_semantic(spark, sf_dir):
    detected = D.with_detections(V.catalog(spark, sf_dir), evidence=False)
    scored = S.score_detections(VD.with_semantic(detected, _verdicts(spark, sf_dir)))
    return scored.select("tool_id", "risk_score", "blocked")


# --- metrics ----------------------------------------------------------------------------


@query
def agg_detections_by_pattern(spark, sf_dir):
    return M.detections_by_pattern(_scan(spark, sf_dir))


@query
def agg_findings_by_type(spark, sf_dir):
    return M.findings_by_type(_responses(spark, sf_dir))


@query
def agg_response_totals(spark, sf_dir):
    return M.response_totals(_responses(spark, sf_dir))


@query
def agg_scan_totals(spark, sf_dir):
    """Totals with policy: what policy blocked counts as scanned and blocked."""
    judged = E.judge_catalog(V.catalog(spark, sf_dir), policy(), server_thresholds=False, evidence=False)
    scanned = ~F.col("policy_blocked")
    score, blocked = F.col("risk_score"), F.col("blocked")
    reports = judged.groupBy("server_name").agg(
        F.count_if(scanned).alias("total_tools"),
        F.count_if(blocked).alias("tools_blocked"),
        F.count_if(scanned & ~blocked & (score >= R.WARN_THRESHOLD)).alias("tools_warned"),
        F.count_if(score < R.WARN_THRESHOLD).alias("tools_safe"),
        F.count_if("policy_blocked").alias("policy_blocked"),
    )
    return M.scan_totals(reports, "policy_blocked")


@query
def overview_totals(spark, sf_dir):
    totals = M.scan_totals(S.scan_report(_scan(spark, sf_dir)))
    return totals.select("scans", "tools_scanned", "tools_blocked", "tools_safe")


@query
def agg_risk_histogram(spark, sf_dir):
    return M.risk_histogram(_scan(spark, sf_dir))


@query
def win_risk_cumulative(spark, sf_dir):
    return M.risk_cumulative(M.risk_histogram(_scan(spark, sf_dir)))


@query
def topk_scan_durations(spark, sf_dir):
    latest = M.latest_durations(_durations(spark, sf_dir))
    return latest.select(
        F.round("avg_seconds", 6).alias("avg_seconds"), F.round("max_seconds", 6).alias("max_seconds"), "samples"
    )


@query
def duration_ms(spark, sf_dir):
    states = M.duration_states(_durations(spark, sf_dir))
    return states.select(
        F.round("avg_ms", 3).alias("avg_ms"), "avg_state", F.round("max_ms", 3).alias("max_ms"), "max_state"
    )


@query
def agg_policy_overrides(spark, sf_dir):
    return E.policy_overrides(P.decide(V.catalog(spark, sf_dir), policy(), use_score=False))


@query
def agg_kill_switch(spark, sf_dir):
    return M.kill_switch_counters(_controls(spark, sf_dir), "request_id")


def _served(spark, sf_dir) -> DataFrame:
    """Verdicts served to all documents, repeated texts from the store; none without a label."""
    labels = V.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("tool_id"), (F.col("toxic") == 1).alias("malicious")
    )
    return VD.with_cached_flag(_offers(spark, sf_dir), "tool_id").join(labels, "tool_id", "left")


@query
def agg_semantic_counters(spark, sf_dir):
    return VD.semantic_counters(_served(spark, sf_dir))


def _metrics(spark, sf_dir) -> DataFrame:
    return M.metrics_table(
        _scan(spark, sf_dir),
        _responses(spark, sf_dir),
        _controls(spark, sf_dir),
        "request_id",
        P.decide(V.catalog(spark, sf_dir), policy(), use_score=False),
        _served(spark, sf_dir),
        _durations(spark, sf_dir),
    )


@query
def metrics_table(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "name",
        F.coalesce(F.array_join(F.map_values("labels"), ","), F.lit("")).alias("label"),
        F.round("value", 6).alias("value"),
    )


@query
def agg_firewall_stats(spark, sf_dir):
    stats = M.overall_stats(
        _scan(spark, sf_dir), _responses(spark, sf_dir), _controls(spark, sf_dir), "request_id"
    )
    return stats.withColumns(
        {
            "detections_by_pattern": F.to_json("detections_by_pattern"),
            "findings_by_type": F.to_json("findings_by_type"),
        }
    )


@query
def agg_policy_rule_counts(spark, sf_dir):
    """Rules per list and the tools each list applies to."""
    rules = policy()
    counts = P.rule_counts(rules)
    name, server = F.col("tool_name"), F.col("server_name")
    trusted = [t.server for t in rules.server_trust]
    applied = V.catalog(spark, sf_dir).agg(
        F.count_if(P.is_listed(name, server, rules.blocklist)).alias("blocklist_rules"),
        F.count_if(P.is_listed(name, server, rules.allowlist)).alias("allowlist_rules"),
        F.count_if(server.isin(trusted)).alias("server_trust_rules"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(n).alias("rules"), F.col(k).alias("tools"))
            for k, n in counts.items()
        ]
    )
    return applied.select(F.inline(rows))


@query
def rate_scans_per_min(spark, sf_dir):
    scans = V.requests(spark, sf_dir).where("method = 'tools/list'").select(
        "ts", F.floor(F.col("value") / 10).alias("tools_blocked")
    )
    return M.rates_per_minute(scans).select(
        F.unix_seconds("scrape_ts").alias("scrape_epoch"), "scans_per_min", "blocked_per_min"
    )


@query
def counter_rates(spark, sf_dir):
    """Rates of cumulative counters, one per kind of event, that are scraped at every event and start
    again every two hours: growth an hour behind every fifth minute."""
    samples = V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("counter"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
    )
    samples = samples.withColumn("value", (F.unix_seconds("ts") % 7200).cast("double"))
    rates = CT.counter_rates(samples, ["counter"], "event_id", 3600, 300)
    return rates.select("counter", F.unix_seconds("at").alias("at"), F.round("rate", 6).alias("rate"))


@query
def policy_rule_table(spark, sf_dir):
    """First block and allow rules of every tool out of a table with a rule per customer."""
    key = F.col("c_custkey")
    text = key.cast("string")
    rules = V.table(spark, sf_dir, "customer").select(
        F.when(key % 2 == 0, "block").otherwise("allow").alias("list"), key.alias("ord"),
        F.when(key % 4 == 0, F.concat(F.lit("tool_"), text, F.lit("*")))
        .when(key % 4 == 1, F.concat(F.lit("TOOL_"), text))
        .when(key % 4 == 2, F.concat(F.lit("*_"), text))
        .otherwise(F.concat(F.lit("*l_"), text, F.lit("*"))).alias("tool_glob"),
        F.when(key % 3 == 0, "*").when(key % 3 == 1, F.concat(F.lit("src"), (key % 40).cast("string")))
        .otherwise(F.concat(F.lit("SRC"), (key % 4).cast("string"), F.lit("*"))).alias("server_glob"),
    )
    tools = V.catalog(spark, sf_dir).select("tool_id", "tool_name", "server_name")
    return RT.with_first_rules(tools, rules).select("tool_id", "block_ord", "allow_ord", RT.list_action().alias("action"))


# --- requests as events, and streams ----------------------------------------------------


def replies(requests: DataFrame) -> DataFrame:
    """A reply 30 s after every request; those of ``other`` carry an unknown id."""
    return requests.select(
        F.when(F.col("method") == "other", -1 - F.col("request_id")).otherwise(F.col("request_id")).alias("request_id"),
        "user_id",
        (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("ts"),
        F.lit("tools/call").alias("method"),
    )


@query
def correlate_replies(spark, sf_dir):
    requests = V.requests(spark, sf_dir).select("request_id", "user_id", "ts", "method")
    return SE.correlate(requests, replies(requests), ["user_id"]).select(
        "request_id", "user_id", "method", "matched"
    )


@query
def session_validity(spark, sf_dir):
    requests = V.requests(spark, sf_dir).select("request_id", "ts", "user_id", "method")
    return SE.with_session_validity(requests, "user_id", "request_id").select("request_id", "valid")


def _stream(spark, sf_dir, name) -> DataFrame:
    """A stream of a table that is one file or a folder of files.  A file stream starts from a
    folder or from a pattern; the braces make the table's own path a pattern, which names both."""
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _text_stream(spark, sf_dir, name) -> DataFrame:
    """A stream of texts, spread like its table: only if its files have fewer parts than there are cores."""
    stream, cores = _stream(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    few = V.table(spark, sf_dir, name).rdd.getNumPartitions() < cores
    return stream.repartition(2 * cores) if few else stream


def _streamed(spark, stream: DataFrame, name: str) -> DataFrame:
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    J.run_to_files(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_scan_catalog(spark, sf_dir):
    tools = V.seed_catalog(_text_stream(spark, sf_dir, "documents"))
    scanned = J.scan_catalog(tools, evidence=False).select("tool_id", "risk_score", "risk_level", "blocked")
    return _streamed(spark, scanned, "stream-scan")


@query
def stream_scan_responses(spark, sf_dir):
    answers = V.seed_responses(_text_stream(spark, sf_dir, "conversations"))
    scanned = J.scan_and_redact(answers).select("response_id", "item_pos", "risk_level", "content")
    return _streamed(spark, scanned, "stream-responses")


@query
def stream_correlate(spark, sf_dir):
    """Requests and answers in one stream; every answer of the table."""
    path, checkpoint = fresh_path(spark, "correlated"), fresh_path(spark, "correlated-checkpoint")
    columns = ["request_id", "user_id", "ts", "method"]
    asked = V.seed_requests(_stream(spark, sf_dir, "events")).select(*columns)
    answered = replies(V.seed_requests(_stream(spark, sf_dir, "events"))).select(*columns)
    messages = asked.withColumn("is_answer", F.lit(False)).union(answered.withColumn("is_answer", F.lit(True)))
    J.correlate_stream(messages, ["user_id"], path, checkpoint)
    return J.latest_results(spark, path, ["user_id", "request_id"]).select("request_id", "method", "matched")


@query
def stream_method_route(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "routes"), fresh_path(spark, "routes-checkpoint")
    events = V.seed_requests(_stream(spark, sf_dir, "events")).select("request_id", "method")
    J.routed_sinks(events, path, checkpoint)
    return spark.read.parquet(path).select("request_id", "method", "route")


@query
def stream_session_validity(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "sessions"), fresh_path(spark, "sessions-checkpoint")
    events = V.seed_requests(_stream(spark, sf_dir, "events")).select("request_id", "ts", "user_id", "method")
    J.session_validity(events, "user_id", path, checkpoint)
    return J.latest_results(spark, path, ["user_id", "alone"]).select("request_id", "valid")


@query
def stream_counters(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "counters"), fresh_path(spark, "counters-checkpoint")
    J.run_counters(
        J.pattern_counters(V.seed_catalog(_text_stream(spark, sf_dir, "documents"))), path, checkpoint
    )
    states = spark.read.parquet(path)
    latest = states.agg(F.max("batch_id").alias("batch_id"))
    return states.join(latest, "batch_id").select("pattern_name", "detections")


@query
def stream_rate_window(spark, sf_dir):
    """Requests per day and method, the open day included."""
    path, checkpoint = fresh_path(spark, "rates"), fresh_path(spark, "rates-checkpoint")
    J.rate_windows(V.seed_requests(_stream(spark, sf_dir, "events")), path, checkpoint, "1 day")
    return J.summed_rates(spark, path).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "method", "requests"
    )


@query
def stream_verdict_dedup(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "texts"), fresh_path(spark, "texts-checkpoint")
    offers = _stream(spark, sf_dir, "documents").select(
        F.lit("tool").alias("tool_name"), F.col("text").alias("description")
    )
    J.new_texts(offers, path, checkpoint)
    return spark.read.parquet(path).select("cache_key")


@query
def stream_enforce_catalog(spark, sf_dir):
    """What every listing delivers, by policy and scan."""
    path, checkpoint = fresh_path(spark, "enforced"), fresh_path(spark, "enforced-checkpoint")
    tools = V.seed_catalog(_text_stream(spark, sf_dir, "documents"))
    J.enforced_catalog(tools, policy(), ["server_name"], path, checkpoint)
    return spark.read.parquet(path).select("tool_id", "server_name", "tool_name", "readded")


@query
def stream_kill_switch(spark, sf_dir):
    """Tools that pass while the latest control write leaves the switch off."""
    path, checkpoint = fresh_path(spark, "switched"), fresh_path(spark, "switched-checkpoint")

    def read_switch() -> bool:
        return M.kill_switch_counters(_controls(spark, sf_dir), "request_id").first()["enabled"]

    tools = V.seed_catalog(_text_stream(spark, sf_dir, "documents")).select("tool_id", "tool_name")
    J.switched_catalog(tools, read_switch, path, checkpoint)
    return spark.read.parquet(path).select("tool_id", "tool_name")


@query
def stream_audit_sink(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "audit-stream"), fresh_path(spark, "audit-checkpoint")
    tools = V.seed_catalog(_text_stream(spark, sf_dir, "documents"))
    stamped = tools.withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1704067200) + (F.col("tool_id") % 3) * 86400)
    ).withColumn("scan_id", F.col("server_name"))
    J.audit_sink(stamped, path, checkpoint)
    lines = spark.read.schema(AU.schemas.AUDIT_RESULT).json(path)
    return lines.select(
        F.col("date").cast("string").alias("date"), "server_name", "tool_name", "risk_score", "blocked"
    )


#: Micro-batches that the events are cut into, in the order of their arrival.
ARRIVALS = 6


def _arriving(spark, rows: DataFrame, name: str) -> tuple[str, DataFrame]:
    """Rows with ``request_id, user_id, ts, method`` as files that arrive one after the other: up to a
    quarter of an hour out of order, one in 50 a day late; at the end rows of a client of their
    own (-1), so late that the watermark passes all others."""
    path = fresh_path(spark, name)
    delay = F.when(F.col("request_id") % 50 == 7, 86400).otherwise(F.abs(F.hash("request_id")) % 900)
    rows = rows.withColumn("_at", F.unix_seconds("ts") + delay)
    span = rows.agg(F.min("_at").alias("a"), F.max("_at").alias("b")).first()
    width = ((span["b"] or 0) - (span["a"] or 0)) // ARRIVALS + 1
    cut = F.least(F.floor((F.col("_at") - (span["a"] or 0)) / width), F.lit(ARRIVALS - 1)).cast("int")
    rows = written(rows.withColumn("_part", cut).drop("_at"), f"{name}-rows")
    for part in range(ARRIVALS):
        # One file is one batch; row groups let several tasks read it.
        mine = rows.where(F.col("_part") == part).drop("_part").coalesce(1)
        mine.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/part={part}")
    for part in range(2):
        end = rows.drop("_part").limit(0).select("request_id", "user_id", "ts", "method")
        far = spark.range(1).select(
            F.lit(-1 - part).cast("long").alias("request_id"), F.lit(-1).cast("long").alias("user_id"),
            F.timestamp_seconds(F.lit((span["b"] or 0) + (part + 1) * 40 * 86400)).alias("ts"), F.lit("other").alias("method"),
        )
        end.unionByName(far).write.parquet(f"{path}/part={ARRIVALS + part}")
    stream = spark.readStream.schema(rows.drop("_part").schema).option("maxFilesPerTrigger", 1)
    return path, stream.parquet(f"{path}/part=*")


@query
def stream_session_state(spark, sf_dir):
    """Session validity by keyed state over many small batches, late rows settled."""
    path, checkpoint = fresh_path(spark, "session-state"), fresh_path(spark, "session-state-checkpoint")
    requests = V.requests(spark, sf_dir).select("request_id", "user_id", "ts", "method")
    _, arriving = _arriving(spark, requests, "session-arrivals")
    ST.session_states(arriving, "user_id", path, checkpoint, lateness="20 minutes", salts=2)
    judged = ST.session_results(spark, path).select(F.col("row").alias("request_id"), "valid")
    return judged.where("request_id >= 0")


@query
def stream_closed_windows(spark, sf_dir):
    """Requests per hour and method: windows closed by the watermark, and what came later."""
    path, checkpoint = fresh_path(spark, "windows"), fresh_path(spark, "windows-checkpoint")
    requests = V.requests(spark, sf_dir).select("request_id", "user_id", "ts", "method")
    _, arriving = _arriving(spark, requests, "window-arrivals")
    ST.closed_windows(arriving.where("user_id >= 0 OR user_id IS NULL OR request_id < 0"), path, checkpoint, "1 hour", lateness="20 minutes")
    ends = F.col("window_start") <= F.lit(requests.agg(F.max("ts")).first()[0])
    return ST.window_counts(spark, path).where(ends).select(
        F.unix_seconds("window_start").alias("hour"), "method", (F.col("on_time") + F.col("late")).alias("requests")
    )


@query
def stream_answers(spark, sf_dir):
    """Two streams that meet: requests, and their answers 30 s later, each in its own order of arrival."""
    path, checkpoint = fresh_path(spark, "answers"), fresh_path(spark, "answers-checkpoint")
    requests = V.requests(spark, sf_dir).select("request_id", "user_id", "ts", "method")
    _, asked = _arriving(spark, requests, "requests-arriving")
    _, told = _arriving(spark, replies(requests), "answers-arriving")
    pairs = ST.answered_within(asked, told, ["user_id"], "10 minutes", "2 days")
    J.run_to_files(pairs, path, checkpoint)
    met = ST.latest_request(spark.read.schema(pairs.schema).parquet(path), ["request_id", "user_id", "ts"])
    return met.where("user_id >= 0 OR user_id IS NULL").select("request_id", "user_id", "method", "matched")


def _messages(documents: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests and answers about all documents (listings; every tenth was not asked for) and all turns."""
    start = 1704067200
    listed = V.seed_catalog(documents).select(
        F.col("tool_id").alias("request_id"), (F.col("tool_id") % 7).alias("user_id"),
        F.timestamp_seconds(F.lit(start) + F.col("tool_id") % 3000).alias("ts"),
        F.when(F.col("tool_id") % 10 == 0, "own").otherwise("tools/list").alias("asked"),
        F.to_json(F.struct(F.col("tool_id").cast("string").alias("id"), F.struct(F.array(F.struct(F.col("tool_name").alias("name"), "description")).alias("tools")).alias("result"))).alias("value"),
    )
    called = V.seed_responses(conversations).select(
        (F.lit(-1000) * (F.col("response_id") + 1) - F.col("item_pos")).alias("request_id"), (F.col("response_id") % 7).alias("user_id"),
        F.timestamp_seconds(F.lit(start) + F.col("response_id") % 3000).alias("ts"), F.lit("tools/call").alias("asked"),
        F.to_json(F.struct(F.col("response_id").cast("string").alias("id"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content")).alias("result"))).alias("value"),
    )
    both = listed.unionByName(called)
    requests = both.where("asked <> 'own'").select("request_id", "user_id", "ts", F.col("asked").alias("method"))
    answers = both.select("request_id", "user_id", (F.col("ts") + F.expr("INTERVAL 5 SECONDS")).alias("ts"), F.lit("own").alias("method"), "value")
    return requests, answers


@query
def stream_message_sinks(spark, sf_dir):
    """Answers to listings, calls and others in one stream: each inspected by the request it
    answers, three sinks with one commit a batch."""
    path, checkpoint = fresh_path(spark, "messages"), fresh_path(spark, "messages-checkpoint")
    requests, answers = _messages(*[_stream(spark, sf_dir, n) for n in ("documents", "conversations")])
    # Messages of the year after let the watermark pass all others.
    end = fresh_path(spark, "messages-end")
    for days in (400, 401):
        spark.range(1).select(F.timestamp_seconds(F.lit(1704067200 + days * 86400)).alias("ts")).coalesce(1).write.mode("append").parquet(end)
    last = spark.readStream.schema("ts TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(end).select(
        F.lit(None).cast("long").alias("request_id"), F.lit(-1).cast("long").alias("user_id"), "ts", F.lit("own").alias("method")
    )
    MS.inspected_messages(
        requests.unionByName(last), answers.unionByName(last.withColumn("value", F.lit(None).cast("string"))),
        ["user_id"], path, checkpoint, evidence=False,
    )
    sinks = {name: MS.committed(spark, path, name) for name in (MS.CATALOG, MS.RESPONSE, MS.PASS)}
    catalog = sinks[MS.CATALOG].select(F.lit(MS.CATALOG).alias("sink"), "request_id", F.concat_ws(":", "risk_level", F.col("risk_score").cast("string"), F.col("blocked").cast("string")).alias("said"))
    response = sinks[MS.RESPONSE].select(F.lit(MS.RESPONSE).alias("sink"), "request_id", F.concat_ws(":", "risk_level", F.sha2("content", 256)).alias("said"))
    passed = sinks[MS.PASS].where("user_id >= 0").select(F.lit(MS.PASS).alias("sink"), "request_id", "method")
    return catalog.union(response).union(passed)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
