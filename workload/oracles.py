"""SQL (DuckDB) that computes the registered queries a second way."""

from __future__ import annotations

from typing import NamedTuple

from toolwarden import rules as R
from workload import queries as Q
from workload import views as V

_ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def extract_all(column: str, rule: R.Rule) -> str:
    flags = ", 'i'" if rule.ignore_case else ", ''"
    return f"regexp_extract_all({column}, {text(rule.pattern)}, {rule.group}{flags})"


def family(rules: tuple[R.Rule, ...]) -> str:
    return "flatten([" + ", ".join(extract_all("d", r) for r in rules) + "])"


def quoted(matches: str) -> str:
    return (
        f"array_to_string(list_transform(list_slice({matches}, 1, 5), "
        "lambda m: concat('''', m, '''')), ', ')"
    )


class Literal(NamedTuple):
    """A rule of the check SQL, written out here so that a wrong value in the engine shows."""

    pattern: str
    ignore_case: bool = True
    group: int = 0


class LiteralFinding(NamedTuple):
    finding_type: str
    severity: int
    rule: Literal


# The rules of one detector and of one response family.
CROSS_TOOL = tuple(
    Literal(p)
    for p in (
        r"(before|after)\s+(using|calling|running|executing)\s+(this|any|another)\s+tool",
        r"(first|always)\s+(call|use|run|execute|invoke)",
        r"must\s+(call|use|run|execute|invoke)\s+\w+\s+(tool|function|method)",
        r"chain\s+with",
        r"pipe\s+(output|result)\s+to",
        r"redirect\s+(output|result)\s+to",
        r"depends\s+on\s+calling",
        r"requires\s+(calling|executing|running)",
        r"trigger\s+the\s+\w+\s+(tool|function|endpoint)",
        r"also\s+(call|invoke|trigger|run)",
    )
)
PERSONAL_DATA = tuple(
    LiteralFinding(kind, severity, Literal(pattern, False))
    for kind, severity, pattern in (
        ("email", 60, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        ("phone_us", 50, r"\b(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"),
        ("phone_intl", 50, r"\b\+[0-9]{1,3}[-.\s]?[0-9]{6,14}\b"),
        ("ssn", 90, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
        ("credit_card", 90, r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
        ("ip_address", 40, r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
        ("iban", 70, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,18})?\b"),
    )
)

_HIDDEN = text(r"[\p{Cf}\p{Co}]")
_B64 = text(R.BASE64_RUN)

# One valid UTF-8 sequence in hex, every byte behind a space.
_UTF8 = (
    "(?: [0-7].| (?:C[2-9A-F]|D.) [89AB].| E0 [AB]. [89AB].| (?:E[1-9ABCEF]) [89AB]. [89AB].| ED [89]. [89AB]."
    "| F0 [9AB]. [89AB]. [89AB].| F[1-3] [89AB]. [89AB]. [89AB].| F4 8. [89AB]. [89AB].)"
)
_PADDED = (
    "CASE (length(rtrim(x, '=')) % 4) WHEN 0 THEN rtrim(x, '=') "
    "WHEN 2 THEN CASE WHEN x LIKE '%==' THEN x END "
    "WHEN 3 THEN CASE WHEN x LIKE '%=' THEN concat(rtrim(x, '='), '=') END END"
)
# Text of a base64 run without its invalid bytes.
_DECODED = (
    "decode(unhex(replace(array_to_string(regexp_extract_all(regexp_replace("
    f"hex(from_base64({_PADDED})), '(..)', ' \\1', 'g'), '{_UTF8}'), ''), ' ', '')))"
)

# Match lists of every text rule, then what was found per detector.
MATCHES = f"""
matches AS (
  SELECT tool_id, server_name, tool_name, description AS d,
    {family(R.PROMPT_INJECTION)} AS injection,
    list_concat({family(R.DATA_EXFILTRATION)}, list_transform(
      list_slice({extract_all('d', R.IMAGE_LINK)}, 1, 1), lambda m: concat('image_link:', left(m, 60)))) AS phrases,
    {extract_all('d', R.EXTERNAL_URL)} AS urls,
    {family(CROSS_TOOL)} AS cross_tool,
    CASE WHEN regexp_matches(description, {_HIDDEN}) THEN
      list_filter(range(0, length(description)), lambda i: regexp_matches(substr(description, i + 1, 1), {_HIDDEN}))
      ELSE [] END AS hidden,
    list_filter(list_transform(regexp_extract_all(description, {_B64}),
      lambda x: {_DECODED}),
      lambda t: t IS NOT NULL AND length(t) > 5 AND NOT regexp_matches(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}\\p{{S}} ]')) AS readable,
    len(regexp_extract_all(description, {text(R.HEX_RUN)})) AS hex_runs,
    len(regexp_extract_all(description, {text(R.UNICODE_ESCAPE)})) AS escapes,
    len(regexp_extract_all(description, {text(R.HTML_ENTITY)})) AS entities,
    len(regexp_extract_all(description, '<!--')) AS comments,
    len(regexp_extract_all(description, {text(R.NEWLINE_BLOCK)})) AS newlines,
    CASE WHEN length(tool_name) > 0 THEN length(description)::DOUBLE / length(tool_name) END AS ratio,
    {family(R.DANGEROUS_COMMANDS)} AS commands,
    {family(R.INTERNAL_ACCESS)} AS internal_access
  FROM catalog
),
parts AS (
  SELECT *, list_concat(
    list_transform(readable, lambda t: concat('base64 of ''', left(t, 50), '...''')),
    list_filter([
      CASE WHEN hex_runs > 0 THEN concat('hex runs: ', hex_runs) END,
      CASE WHEN escapes > 3 THEN concat('unicode escapes: ', escapes) END,
      CASE WHEN entities > 3 THEN concat('html entities: ', entities) END
    ], lambda p: p IS NOT NULL)) AS obfuscated
  FROM matches
)"""


def _counted(column: str) -> str:
    return f"CASE WHEN len({column}) > 0 THEN concat(len({column}), ' match(es): ', {quoted(column)}) ELSE '' END"


# name -> (matched, severity, evidence)
_DETECTORS = {
    "Prompt Injection": ("len(injection) > 0", "85", _counted("injection")),
    "Data Exfiltration": (
        "len(phrases) + len(urls) > 0",
        "CASE WHEN len(phrases) = 0 AND len(urls) > 0 THEN 60 ELSE 90 END",
        "concat_ws('; ', CASE WHEN len(phrases) > 0 THEN concat('phrases: ', "
        + quoted("phrases")
        + ") END, CASE WHEN len(urls) > 0 THEN concat('urls: ', array_to_string(list_slice(urls, 1, 3), ', ')) END)",
    ),
    "Cross-Tool Manipulation": ("len(cross_tool) > 0", "75", _counted("cross_tool")),
    "Invisible Characters": (
        "len(hidden) > 0",
        "80",
        "CASE WHEN len(hidden) > 0 THEN concat(len(hidden), ' character(s): ', array_to_string(list_transform("
        "list_slice(hidden, 1, 5), lambda i: concat('U+', printf('%04X', unicode(substr(d, i + 1, 1))), '@', i)), '; ')) "
        "ELSE '' END",
    ),
    "Obfuscated Payloads": ("len(obfuscated) > 0", "70", "array_to_string(obfuscated, '; ')"),
    "Description Anomalies": (
        "(length(d) > 2000 OR comments > 0 OR newlines > 0 OR coalesce(ratio > 200, FALSE))",
        "45",
        "concat_ws('; ', CASE WHEN length(d) > 2000 THEN concat('length ', length(d)) END, "
        "CASE WHEN comments > 0 THEN concat('html comments: ', comments) END, "
        "CASE WHEN newlines > 0 THEN concat('newline blocks: ', newlines) END, "
        "CASE WHEN ratio > 200 THEN concat('length/name ratio ', round_even(ratio, 0)::BIGINT) END)",
    ),
    "Dangerous Commands": ("len(commands) > 0", "80", _counted("commands")),
    "SSRF / Internal Access": ("len(internal_access) > 0", "85", _counted("internal_access")),
}

_CATALOG = f"WITH catalog AS ({V.CATALOG_SQL}),{MATCHES}"


def _hits(names) -> str:
    rows = ", ".join(
        f"CASE WHEN {_DETECTORS[n][0]} THEN {{'pos': {i}, 'name': {text(n)}, 'severity': {_DETECTORS[n][1]}, "
        f"'evidence': {_DETECTORS[n][2]}}} END"
        for i, n in enumerate(R.DETECTOR_SEVERITY)
        if n in names
    )
    return f"list_filter([{rows}], lambda h: h IS NOT NULL)"


SCORE = (
    "CAST(least(100, trunc(coalesce(list_sum(list_transform(list_reverse_sort(severities), "
    "lambda s, i: CASE WHEN i = 1 THEN s::DOUBLE ELSE s * (0.3::DOUBLE / (i - 1)) END)), 0))) AS INTEGER)"
)
LEVEL = (
    "CASE WHEN risk_score >= 76 THEN 'dangerous' WHEN risk_score >= 51 THEN 'risky' "
    "WHEN risk_score >= 26 THEN 'suspicious' ELSE 'safe' END"
)


def scan(names=tuple(R.DETECTOR_SEVERITY)) -> str:
    """CTEs up to ``scan``: hits, patterns, severities, score and level."""
    return f"""{_CATALOG},
hit_lists AS (SELECT tool_id, server_name, tool_name, d, {_hits(names)} AS hits FROM parts),
scored AS (
  SELECT *, list_transform(hits, lambda h: h.name) AS patterns,
    list_transform(hits, lambda h: h.severity) AS severities FROM hit_lists
),
scan0 AS (SELECT *, {SCORE} AS risk_score FROM scored),
scan AS (SELECT *, {LEVEL} AS risk_level, risk_score >= 51 AS blocked FROM scan0)"""


def oracle(name: str, sql: str) -> None:
    _ORACLES[name] = sql


SCAN = scan()

for _key, _name in Q.DETECTOR_KEYS.items():
    _matched, _severity, _evidence = _DETECTORS[_name]
    oracle(
        _key,
        f"{_CATALOG} SELECT tool_id, CAST({_severity} AS INTEGER) AS severity, {_matched} AS matched, "
        f"{_evidence} AS evidence FROM parts",
    )

oracle(
    "detections_long",
    _CATALOG
    + " "
    + " UNION ALL ".join(
        f"SELECT tool_id, {i} AS detector_pos, {text(n)} AS pattern_name, "
        f"CAST({sev} AS INTEGER) AS severity, {matched} AS matched FROM parts"
        for i, (n, (matched, sev, _)) in enumerate(_DETECTORS.items())
    ),
)
oracle("det_enabled_subset", f"{scan(Q.ENABLED)} SELECT tool_id, risk_score FROM scan")
oracle(
    "required_detectors",
    f"{scan((*Q.ENABLED, 'Prompt Injection', 'Dangerous Commands'))} SELECT tool_id, risk_score FROM scan",
)
oracle(
    "evidence_samples",
    f"{SCAN}, hit_rows AS (SELECT tool_id, unnest(hits) AS h FROM scan) "
    "SELECT tool_id, h.name AS pattern_name, left(h.evidence, 80) AS evidence FROM hit_rows",
)
# Fixed values of the detector over Arrow arrays: runs of 24 signs, more than 3.5 bits a sign, severity 45.
oracle(
    "det_arrow",
    f"{SCAN}, found AS (SELECT tool_id, severities AS own, list_filter(regexp_extract_all(d, '[A-Za-z0-9_+/=-]{{24,}}'), "
    "lambda r: list_aggregate(string_split(r, ''), 'entropy') > 3.5) AS runs FROM scan), "
    "joined AS (SELECT tool_id, runs, CASE WHEN len(runs) > 0 THEN list_append(own, 45) ELSE own END AS severities FROM found) "
    f"SELECT tool_id, {SCORE} AS risk_score, len(runs) > 0 AS matched, 45 AS severity, CASE WHEN len(runs) > 0 "
    "THEN concat(len(runs), ' run(s), first of ', length(runs[1])) ELSE '' END AS evidence FROM joined",
)
oracle("risk_score", f"{SCAN} SELECT tool_id, risk_score FROM scan")
oracle("risk_level", f"{SCAN} SELECT risk_level, count(*) AS tools FROM scan GROUP BY 1")
oracle("block_decision", f"{SCAN} SELECT tool_id, risk_score >= 80 AS blocked FROM scan")
oracle(
    "scan_tools",
    f"{SCAN} SELECT tool_id, server_name, tool_name, risk_score, risk_level, blocked, "
    "array_to_string(patterns, ',') AS patterns FROM scan",
)
_REPORT = (
    "count(*) AS total_tools, count_if(blocked)::BIGINT AS tools_blocked, "
    "count_if(NOT blocked AND risk_score >= 26)::BIGINT AS tools_warned, "
    "count_if(risk_score < 26)::BIGINT AS tools_safe, max(risk_score) AS max_risk_score"
)
oracle("scan_report", f"{SCAN} SELECT server_name, {_REPORT} FROM scan GROUP BY server_name")
_KEPT = (
    "kept AS (SELECT s.* FROM scan s WHERE NOT EXISTS (SELECT 1 FROM scan b WHERE b.blocked "
    "AND b.server_name = s.server_name AND b.tool_name = s.tool_name))"
)
oracle("filter_catalog", f"{SCAN}, {_KEPT} SELECT tool_id, server_name, tool_name FROM kept")
oracle(
    "scan_gate",
    f"{SCAN} SELECT server_name, max(CAST(risk_score >= 100 AS INTEGER)) AS exit_code FROM scan GROUP BY 1",
)
oracle(
    "exposure_diff",
    f"{SCAN}, {_KEPT} SELECT server_name, count(*) AS direct_tools, "
    "(SELECT count(*) FROM kept k WHERE k.server_name = scan.server_name) AS protected_tools, "
    "count(*) - (SELECT count(*) FROM kept k WHERE k.server_name = scan.server_name) AS hidden_tools "
    "FROM scan GROUP BY server_name",
)
_STATUS = "CASE WHEN blocked THEN 'BLOCKED' WHEN risk_score >= 26 THEN 'WARNING' ELSE 'SAFE' END"
oracle("scan_status", f"{SCAN} SELECT tool_id, {_STATUS} AS status FROM scan")
oracle(
    "win_severity_rank",
    f"{SCAN}, hit_rows AS (SELECT tool_id, unnest(hits) AS h FROM scan) "
    "SELECT tool_id, CAST(row_number() OVER (PARTITION BY tool_id ORDER BY h.severity DESC, h.pos) AS INTEGER) "
    "AS severity_rank, h.name AS pattern_name, h.severity AS severity FROM hit_rows",
)

# --- sources and sinks ---------------------------------------------------------

_CAT = f"WITH catalog AS ({V.CATALOG_SQL})"
_RESP = f"WITH responses AS ({V.RESPONSES_SQL})"
_REQ = f"WITH requests AS ({V.REQUESTS_SQL})"

oracle(
    "src_tool_catalog",
    f"{_CAT} SELECT server_name, CAST(tool_id AS VARCHAR) AS message_id, 0 AS tool_pos, tool_name, description "
    "FROM catalog WHERE tool_id % 7 <> 6 UNION ALL "
    "SELECT server_name, CAST(tool_id AS VARCHAR), 1, NULL, 'Says pong.' FROM catalog WHERE tool_id % 7 <> 6",
)
oracle(
    "src_tool_responses",
    f"{_RESP} SELECT CAST(response_id AS VARCHAR) AS message_id, item_pos AS turn, 2 AS item_pos, content FROM responses "
    "WHERE content <> ''",
)
_BLOCK = "((server_name = 'src1' AND lower(tool_name) LIKE 'tool!_1%' ESCAPE '!') OR lower(tool_name) = 'tool_7')"
_ALLOW = "(lower(tool_name) = 'tool_16' OR server_name = 'src9')"
_TBLOCK = "CASE server_name WHEN 'src2' THEN 30 WHEN 'src3' THEN 95 ELSE 51 END"
_TWARN = "CASE server_name WHEN 'src2' THEN 15 WHEN 'src3' THEN 51 ELSE 26 END"
oracle(
    "src_policy_config",
    f"{_CAT} SELECT server_name, {_TBLOCK} AS block_threshold, {_TWARN} AS warn_threshold, count(*) AS tools, "
    f"count_if({_BLOCK})::BIGINT AS block_listed, count_if({_ALLOW})::BIGINT AS allow_listed "
    "FROM catalog GROUP BY server_name",
)
oracle(
    "src_gateway_identity",
    f"""{_REQ} SELECT request_id, concat('{{"user":"user', user_id, '"',
      CASE WHEN method = 'tools/call' THEN ',"role":"admin"' ELSE '' END,
      CASE WHEN user_id % 2 = 0 THEN ',"target":"srv"' ELSE '' END, '}}') AS identity FROM requests""",
)
_DAY = "CAST(DATE '2024-01-01' + CAST(tool_id % 3 AS INTEGER) AS DATE)"
oracle(
    "sink_audit_jsonl",
    f"{SCAN} SELECT concat(server_name, '-', strftime({_DAY}, '%Y%m%d')) AS scan_id, server_name, "
    f"strftime({_DAY}, '%Y-%m-%d') AS date, CASE WHEN CAST(substr(server_name, 4) AS INTEGER) % 2 = 0 "
    f"THEN concat('{{\"user\":\"u-', server_name, '\"}}') END AS identity, {_REPORT} FROM scan GROUP BY 1, 2, 3, 4",
)
oracle(
    "filter_listings",
    f"{SCAN} SELECT server_name, CAST(tool_id AS VARCHAR) AS message_id, 0 AS tool_pos, tool_name FROM scan "
    "WHERE tool_id % 7 <> 6 AND NOT blocked UNION ALL "
    "SELECT server_name, CAST(tool_id AS VARCHAR), 1, NULL FROM scan WHERE tool_id % 7 <> 6",
)
oracle(
    "src_audit_replay",
    f"{SCAN} SELECT strftime({_DAY}, '%Y-%m-%d') AS date, count(DISTINCT server_name) AS total_scans, "
    "count(*) AS total_tools_scanned, count_if(blocked)::BIGINT AS total_tools_blocked, "
    "sum(len(hits))::BIGINT AS detections FROM scan GROUP BY 1",
)
oracle(
    "sink_audit_store",
    f"{SCAN} SELECT strftime({_DAY}, '%Y-%m-%d') AS date, count(DISTINCT server_name) AS total_scans, "
    "count(*) AS total_tools_scanned, count_if(blocked)::BIGINT AS total_tools_blocked, sum(len(hits))::BIGINT AS detections, "
    "count(DISTINCT server_name) FILTER (CAST(substr(server_name, 4) AS INTEGER) % 2 = 0) AS with_identity FROM scan GROUP BY 1",
)


_BOUNDS = "(VALUES ('25', 25), ('50', 50), ('75', 75), ('100', 100), ('+Inf', 1000)) b(le, bound)"


_TO_DO = {
    "Prompt Injection": "Reword texts that address the agent; a description says what its tool does.",
    "Data Exfiltration": "Name the hosts that may receive data, and drop links that carry any.",
    "Cross-Tool Manipulation": "Leave the choice of tools to the agent; strike orders to call others.",
    "Invisible Characters": "Publish plain text without characters that nobody can see.",
    "Obfuscated Payloads": "Write encoded passages out, or leave them away.",
    "Description Anomalies": "Shorten the text; comments and empty blocks do not belong in it.",
    "Dangerous Commands": "Keep commands and names of secrets out of the text.",
    "SSRF / Internal Access": "Point to public addresses only.",
}


def _markdown() -> str:
    head = (
        "[concat('# Tools of ', server_name), '', concat('Worst score ', max_risk_score, ' of 100. ', total_tools, ' tools: ', "
        "tools_blocked, ' withheld, ', tools_warned, ' to look at, ', tools_safe, ' without concern.'), '', "
        "'', '## Evidence', '', '', '## To do', '']"
    )
    tool = (
        f"list_concat([concat('- ', tool_name, ': ', risk_score, ' (', risk_level, ', ', lower({_STATUS}), ')', "
        "CASE WHEN len(hits) > 0 THEN concat(', ', array_to_string(patterns, ', ')) ELSE '' END)], "
        "CASE WHEN len(hits) > 0 THEN list_concat([tool_name], "
        "list_transform(hits, lambda h: concat('  - ', h.name, ', ', h.severity, ': ', h.evidence))) ELSE [] END)"
    )
    to_do = " UNION ALL ".join(
        f"SELECT server_name, {text(f'- {k}: {v}')} FROM scan WHERE list_contains(patterns, {text(k)}) GROUP BY server_name"
        for k, v in _TO_DO.items()
    )
    return (
        f"{SCAN}, reports AS (SELECT server_name, {_REPORT} FROM scan GROUP BY server_name), "
        f"blocks AS (SELECT server_name, {head} AS lines FROM reports UNION ALL SELECT server_name, {tool} FROM scan), "
        f"lines AS (SELECT server_name, unnest(lines) AS line FROM blocks UNION ALL {to_do} UNION ALL "
        "SELECT server_name, 'Nothing.' FROM scan GROUP BY server_name HAVING max(len(hits)) = 0) "
        "SELECT server_name, replace(replace(line, chr(10), '\\n'), chr(13), '\\r') AS line FROM lines"
    )


oracle("sink_markdown_report", _markdown())

# --- policy ------------------------------------------------------------------------

oracle(
    "policy_glob_match",
    f"{_CAT} SELECT tool_id, lower(tool_name) LIKE 'tool!_1%' ESCAPE '!' AS glob_0, "
    "lower(tool_name) = 'tool_7' AS glob_1, tool_name LIKE '%9' AS glob_2, "
    "tool_name LIKE 't%l!_2%5' ESCAPE '!' AS glob_3, TRUE AS glob_4 FROM catalog",
)
oracle("policy_blocklist", f"{_CAT} SELECT tool_id, tool_name, server_name FROM catalog WHERE {_BLOCK}")
oracle(
    "policy_allowlist",
    f"{_CAT} SELECT tool_id, tool_name, server_name FROM catalog WHERE {_ALLOW} AND NOT {_BLOCK}",
)
oracle(
    "policy_max_length",
    f"{_CAT} SELECT tool_id, CASE WHEN length(description) > 2000 THEN 'block' ELSE 'default' END AS action, "
    "CASE WHEN length(description) > 2000 THEN concat('description length ', length(description), ' > 2000') "
    "ELSE 'no policy applies' END AS reason FROM catalog",
)
_TRUST = "CASE server_name WHEN 'src2' THEN 30 WHEN 'src3' THEN 95 END"
_TRUST_COLUMNS = (
    ("WHEN risk_score >= t THEN 'block' WHEN risk_score > 0 AND t IS NOT NULL THEN 'allow'", "'default'"),
    (
        "WHEN t IS NOT NULL AND (risk_score >= t OR risk_score > 0) "
        "THEN concat('risk score ', risk_score, ' vs server threshold ', t)",
        "'no policy applies'",
    ),
    ("WHEN t IS NOT NULL AND (risk_score >= t OR risk_score > 0) THEN 'server_trust'", "'none'"),
)


def _decision(prefix: tuple[str, str, str]) -> str:
    columns = (
        f"CASE {first} {trust} ELSE {other} END AS {name}"
        for first, (trust, other), name in zip(prefix, _TRUST_COLUMNS, ("action", "reason", "rule_name"))
    )
    return ", ".join(columns)


oracle(
    "policy_server_trust",
    f"{SCAN}, trusted AS (SELECT *, {_TRUST} AS t FROM scan) SELECT tool_id, {_decision(('', '', ''))} FROM trusted",
)
oracle(
    "policy_decide",
    f"{SCAN}, trusted AS (SELECT *, {_TRUST} AS t FROM scan) SELECT tool_id, "
    + _decision(
        (
            f"WHEN {_BLOCK} THEN 'block' WHEN {_ALLOW} THEN 'allow' WHEN length(d) > 5000 THEN 'block'",
            f"WHEN {_BLOCK} THEN concat('tool ''', tool_name, ''' is on the block list') "
            f"WHEN {_ALLOW} THEN concat('tool ''', tool_name, ''' is on the allow list') "
            "WHEN length(d) > 5000 THEN concat('description length ', length(d), ' > 5000')",
            f"WHEN {_BLOCK} THEN 'blocklist' WHEN {_ALLOW} THEN 'allowlist' "
            "WHEN length(d) > 5000 THEN 'max_description_length'",
        )
    )
    + " FROM trusted",
)
oracle(
    "server_thresholds",
    f"{_CAT} SELECT server_name, {_TBLOCK} AS block_threshold, {_TWARN} AS warn_threshold, count(*) AS tools "
    "FROM catalog GROUP BY server_name",
)
oracle(
    "policy_first_match",
    f"{_CAT} SELECT tool_id, CASE WHEN server_name = 'src1' AND lower(tool_name) LIKE 'tool!_1%' ESCAPE '!' THEN 0 "
    "WHEN lower(tool_name) = 'tool_7' THEN 1 END AS block_rule, "
    "CASE WHEN lower(tool_name) = 'tool_16' THEN 0 WHEN server_name = 'src9' THEN 1 END AS allow_rule FROM catalog",
)
_JUDGED = f"""{SCAN}, judged AS (
  SELECT *, CASE WHEN {_BLOCK} THEN 'block' WHEN {_ALLOW} THEN 'allow' WHEN length(d) > 5000 THEN 'block'
    ELSE 'default' END AS action, {_TBLOCK} AS block_at, {_TWARN} AS warn_at FROM scan
)"""
oracle(
    "enforce_catalog",
    f"""{_JUDGED}, fallen AS (SELECT DISTINCT server_name, tool_name FROM judged
      WHERE action <> 'block' AND risk_score >= block_at)
    SELECT tool_id, j.server_name, j.tool_name, f.tool_name IS NOT NULL AS readded FROM judged j
    LEFT JOIN fallen f ON f.server_name = j.server_name AND f.tool_name = j.tool_name
    WHERE action <> 'block' AND (f.tool_name IS NULL OR action = 'allow')""",
)
oracle(
    "enforcement_summary",
    f"""{_JUDGED} SELECT server_name, count_if(action = 'block' OR risk_score >= block_at)::BIGINT AS tools_blocked,
      count_if(action = 'block')::BIGINT AS policy_blocked,
      count_if(action <> 'block' AND risk_score < block_at AND risk_score >= warn_at)::BIGINT AS tools_warned,
      coalesce(max(CASE WHEN action <> 'block' THEN risk_score END), 0) AS max_risk_score
    FROM judged GROUP BY server_name HAVING count_if(action = 'block' OR risk_score >= block_at) > 0""",
)
oracle(
    "enforcement_blocked",
    f"""{_JUDGED} SELECT server_name, tool_name, CASE WHEN action = 'block' THEN 'policy' ELSE 'scan' END AS blocked_by,
      CASE WHEN {_BLOCK} THEN concat('tool ''', tool_name, ''' is on the block list')
        WHEN action = 'block' THEN concat('description length ', length(d), ' > 5000')
        ELSE concat('risk score ', risk_score) END AS reason
    FROM judged WHERE action = 'block' OR risk_score >= block_at""",
)
_SWITCH = f"""{_REQ}, listings AS (
  SELECT r.request_id, r.user_id, coalesce((SELECT max_by(c.value > 35, (c.ts, c.request_id)) FROM requests c
    WHERE c.method = 'other' AND c.ts <= r.ts), FALSE) AS kill_switch
  FROM requests r WHERE r.method = 'tools/list'
)"""
_SWITCH = f"""{_REQ}, controls AS (SELECT ts, value > 35 AS enabled FROM requests WHERE method = 'other'),
listings AS (
  SELECT r.request_id, r.user_id, coalesce(c.enabled, FALSE) AS kill_switch
  FROM requests r ASOF LEFT JOIN controls c ON r.ts >= c.ts WHERE r.method = 'tools/list'
)"""
oracle("kill_switch_filter", f"{_SWITCH} SELECT request_id, user_id FROM listings WHERE NOT kill_switch")
oracle("kill_switch_hidden", f"{_SWITCH} SELECT kill_switch, count(*) AS listings FROM listings GROUP BY 1")
oracle(
    "server_name_resolve",
    f"{_REQ} SELECT request_id, CASE WHEN method = 'tools/list' THEN 'gateway' "
    "ELSE concat('upstream-http://', client_ip) END AS server_name FROM requests",
)
oracle(
    "trusted_source",
    f"{_REQ} SELECT request_id, client_ip FROM requests WHERE user_id % 256 < 64 OR client_ip = '10.100.0.5'",
)

# --- responses -----------------------------------------------------------------------

_LUHN = (
    "(length(x) >= 13 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: "
    "CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(substr(x, i, 1) AS INTEGER) "
    "WHEN CAST(substr(x, i, 1) AS INTEGER) > 4 THEN CAST(substr(x, i, 1) AS INTEGER) * 2 - 9 "
    "ELSE CAST(substr(x, i, 1) AS INTEGER) * 2 END)) % 10 = 0)"
)
_MASK = "CASE WHEN length(x) <= 8 THEN repeat('*', length(x)) ELSE concat(left(x, 4), repeat('*', length(x) - 4)) END"


def _found(category: str, rule: R.FindingRule) -> str:
    matches = extract_all("content", rule.rule)
    if rule.finding_type == "credit_card":
        matches = f"list_filter({matches}, lambda x: {_LUHN})"
    if rule.finding_type == "embedded_url":
        plain = R.Rule(r"https?://[^\s\"'<>]{15,}", (), False)
        matches = (
            f"list_filter({extract_all('content', plain)}, "
            "lambda x: NOT regexp_matches(x, '^https?://(example\\.com|localhost)'))"
        )
    shown, evidence = _MASK, "x"
    if category == "data_leak":
        shown = f"concat('[{rule.finding_type}: ', length(x), ' chars]')"
        evidence = "CASE WHEN length(x) > 50 THEN concat(left(x, 50), '...') ELSE x END"
    return (
        f"list_transform({matches}, lambda x: {{'t': '{rule.finding_type}', 's': {rule.severity}, "
        f"'e': {evidence}, 'r': {shown}}})"
    )


def responses(secrets=True, pii=True, data_leak=True) -> str:
    wanted = [
        *([("secret", f) for f in R.SECRETS] if secrets else []),
        *([("pii", f) for f in PERSONAL_DATA] if pii else []),
        *([("data_leak", f) for f in R.DATA_LEAKS] if data_leak else []),
    ]
    lists = [_found(c, f) for c, f in wanted]
    if data_leak:
        lists.append(
            "CASE WHEN length(content) > 5000 AND json_valid(content) THEN [{'t': 'large_json_dump', 's': 55, "
            "'e': concat('JSON of ', length(content), ' chars'), "
            "'r': concat('[large_json_dump: ', length(content), ' chars]')}] ELSE [] END"
        )
    return f"""{_RESP}, found AS (SELECT *, flatten([{', '.join(lists)}]) AS f FROM responses),
worst AS (SELECT *, coalesce(list_max(list_transform(f, lambda x: x.s)), 0) AS w FROM found),
scanned AS (SELECT *, CASE WHEN w >= 80 THEN 'critical' WHEN w >= 50 THEN 'warning' ELSE 'clean' END AS risk_level,
  array_to_string(list_transform(f, lambda x: x.t), ',') AS types FROM worst)"""


def _findings(**switches: bool) -> str:
    return (
        f"{responses(**switches)} SELECT response_id, item_pos, CAST(i - 1 AS INTEGER) AS finding_pos, "
        "f[i].t AS finding_type, f[i].s AS severity, f[i].r AS redacted_evidence "
        "FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM scanned)"
    )


oracle("find_secrets", _findings(pii=False, data_leak=False))
oracle("find_pii", _findings(secrets=False, data_leak=False))
oracle("find_data_leaks", _findings(secrets=False, pii=False))
oracle("scanner_switches", _findings(pii=False))
_RSCAN = responses()
oracle(
    "luhn_valid",
    f"SELECT o_orderkey, {_LUHN} AS valid FROM (SELECT o_orderkey, concat(lpad(CAST(o_custkey AS VARCHAR), 7, '4'), "
    "lpad(CAST(o_orderkey AS VARCHAR), 7, '0')) AS x FROM orders)",
)
oracle(
    "find_json_dump",
    f"""{_RESP} SELECT response_id, item_pos, json_valid(concat('{{"v":[', repeat('1,', 2600), '1],"t":',
      CAST(to_json([content]) AS VARCHAR),
      CASE item_pos % 3 WHEN 0 THEN '}}' WHEN 1 THEN '}} x' ELSE '' END)) AS is_json_dump FROM responses""",
)
oracle(
    "scan_responses",
    f"{_RSCAN} SELECT response_id, item_pos, CAST(length(content) AS INTEGER) AS content_length, risk_level, "
    "w >= 80 AS should_redact, types FROM scanned",
)
oracle(
    "mask_evidence",
    f"SELECT s_suppkey, (SELECT {_MASK} FROM (SELECT s_name AS x)) AS masked, "
    "repeat('*', 8) AS masked_short FROM supplier",
)
_REDACT = (
    "CASE WHEN w >= 80 THEN list_reduce(list_prepend({'t': '', 's': 100, 'e': content, 'r': ''}, "
    "list_filter(f, lambda x: x.s >= 80 AND x.e <> '')), lambda a, x: "
    "{'t': '', 's': 100, 'e': replace(a.e, x.e, concat('[REDACTED:', x.t, ']')), 'r': ''}).e ELSE content END"
)
oracle("redact_responses", f"{_RSCAN} SELECT response_id, item_pos, {_REDACT} AS content FROM scanned")
oracle(
    "response_summary",
    f"{_RSCAN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY item_pos) AS n "
    "FROM scanned WHERE len(f) > 0) SELECT response_id, item_pos, CAST(len(f) AS INTEGER) AS findings_count, "
    "risk_level, types FROM ranked WHERE n = 1",
)

# --- verdicts ------------------------------------------------------------------------

oracle(
    "verdict_key",
    f"{_CAT} SELECT tool_id, sha256(concat(tool_name, ':', description)) AS cache_key FROM catalog",
)
oracle(
    "verdict_dedup",
    "SELECT doc_id AS tool_id, sha256(concat('tool:', text)) AS cache_key, "
    "row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cached FROM documents",
)
oracle(
    "verdict_score",
    f"{_CAT}, keyed AS (SELECT DISTINCT sha256(concat(tool_name, ':', description)) AS cache_key, "
    "contains(description, 'Ignore all previous') AS bad FROM catalog) SELECT cache_key, bad AS malicious, "
    "CASE WHEN bad THEN 90 ELSE 95 END AS confidence, CASE WHEN bad THEN 85 ELSE 0 END AS severity FROM keyed",
)
oracle("verdict_score_log", f"SELECT *, CAST(1 AS BIGINT) AS calls FROM ({_ORACLES['verdict_score']})")
oracle(
    "verdict_score_stored",
    f"{_CAT}, keyed AS (SELECT sha256(concat(tool_name, ':', description)) AS cache_key, tool_id, "
    "contains(description, 'Ignore all previous') AS bad FROM catalog) SELECT DISTINCT cache_key, bad AS malicious, "
    "CASE WHEN bad THEN 90 ELSE 95 END AS confidence, CASE WHEN bad THEN 85 ELSE 0 END AS severity FROM keyed "
    "WHERE cache_key NOT IN (SELECT cache_key FROM keyed WHERE tool_id % 2 = 0)",
)
# Reply kinds: 0 and 1 whole, 2 unparsable, 3 malicious flag only, 4 no reply.
_VERDICTS = """verdicts AS (
  SELECT doc_id, CASE k WHEN 4 THEN NULL ELSE k <> 2 END AS parsed,
    CASE k WHEN 4 THEN NULL WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE toxic = 1 END AS said,
    CASE k WHEN 4 THEN NULL WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE CAST(50 + doc_id % 50 AS INTEGER) END AS confidence,
    CASE k WHEN 4 THEN NULL WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE toxic * 90 END AS severity,
    CASE WHEN k = 4 THEN NULL WHEN k < 2 AND toxic = 1 THEN 'PROMPT_INJECTION,OBFUSCATION' ELSE '' END AS categories,
    CASE k WHEN 4 THEN NULL WHEN 2 THEN 'reply could not be parsed' WHEN 3 THEN ''
      ELSE concat('quality ', quality) END AS reasoning
  FROM (SELECT *, doc_id % 5 AS k FROM labels)
)"""
oracle(
    "verdict_parse",
    f"WITH {_VERDICTS} SELECT doc_id, parsed, said AS malicious, confidence, severity, categories, reasoning FROM verdicts",
)
oracle(
    "verdict_threshold",
    f"WITH {_VERDICTS} SELECT doc_id, said AND confidence >= 70 AS malicious, confidence, severity FROM verdicts",
)
oracle(
    "verdict_retention",
    f"{_REQ}, stored AS (SELECT ts, sha256(CAST(request_id AS VARCHAR)) AS cache_key FROM requests) "
    "SELECT cache_key FROM stored ORDER BY ts DESC, cache_key DESC LIMIT 256",
)
_JOINED = (
    "judged AS (SELECT s.*, v.said AND v.confidence >= 70 AS malicious, v.confidence, v.severity, "
    "replace(v.categories, ',', ', ') AS categories, v.reasoning FROM {left} s LEFT JOIN verdicts v ON v.doc_id = s.tool_id)"
)
oracle(
    "det_semantic",
    f"{_CAT}, {_VERDICTS}, {_JOINED.format(left='catalog')} SELECT tool_id, "
    "CASE WHEN malicious THEN severity ELSE 0 END AS severity, coalesce(malicious, FALSE) AS matched, "
    "CASE WHEN malicious IS NULL THEN 'no verdict' WHEN malicious THEN concat('confidence=', confidence, "
    "'%, categories=[', CASE WHEN categories = '' THEN 'unknown' ELSE categories END, ']: ', reasoning) ELSE '' END AS evidence "
    "FROM judged",
)
oracle(
    "combined_verdict",
    f"{SCAN}, {_VERDICTS}, {_JOINED.format(left='scan')} SELECT tool_id, "
    "coalesce(malicious, FALSE) OR blocked AS combined_malicious, "
    "CASE WHEN malicious AND blocked THEN concat('semantic and rules, score ', risk_score) "
    "WHEN malicious THEN concat('semantic: ', reasoning) WHEN blocked THEN concat('rules, score ', risk_score) "
    "ELSE 'clean' END AS combined_reason FROM judged",
)
oracle(
    "scan_with_semantic",
    f"{SCAN}, {_VERDICTS}, {_JOINED.format(left='(SELECT tool_id, severities AS rules FROM scan)')}, "
    "joined AS (SELECT tool_id, CASE WHEN malicious THEN list_append(rules, severity) ELSE rules END AS severities "
    f"FROM judged), rescored AS (SELECT tool_id, {SCORE} AS risk_score FROM joined) "
    "SELECT tool_id, risk_score, risk_score >= 51 AS blocked FROM rescored",
)

# --- metrics -------------------------------------------------------------------------

oracle(
    "agg_detections_by_pattern",
    f"{SCAN} SELECT pattern_name, count(*) AS detections FROM (SELECT unnest(patterns) AS pattern_name FROM scan) GROUP BY 1",
)
oracle(
    "agg_findings_by_type",
    f"{_RSCAN} SELECT x.t AS finding_type, count(*) AS findings FROM (SELECT unnest(f) AS x FROM scanned) GROUP BY 1",
)
oracle(
    "agg_response_totals",
    f"{_RSCAN} SELECT count(*) AS total_scans, sum(len(f))::BIGINT AS total_findings FROM scanned",
)
oracle(
    "agg_scan_totals",
    f"""{_JUDGED} SELECT count(DISTINCT server_name) AS scans, count(*) AS tools_scanned,
      count_if(action = 'block' OR risk_score >= 51)::BIGINT AS tools_blocked,
      count_if(action <> 'block' AND risk_score < 51 AND risk_score >= 26)::BIGINT AS tools_warned,
      count_if(action <> 'block' AND risk_score < 26)::BIGINT AS tools_safe FROM judged""",
)
oracle(
    "overview_totals",
    f"{SCAN} SELECT count(DISTINCT server_name) AS scans, count(*) AS tools_scanned, "
    "count_if(blocked)::BIGINT AS tools_blocked, count_if(risk_score < 26)::BIGINT AS tools_safe FROM scan",
)
_BUCKET = (
    "CASE WHEN risk_score <= 25 THEN '0_25' WHEN risk_score <= 50 THEN '26_50' "
    "WHEN risk_score <= 75 THEN '51_75' ELSE '76_100' END"
)
oracle(
    "agg_risk_histogram",
    f"{SCAN} SELECT b.bucket, (SELECT count(*) FROM scan WHERE {_BUCKET} = b.bucket) AS tools "
    "FROM (VALUES ('0_25'), ('26_50'), ('51_75'), ('76_100')) b(bucket)",
)
oracle(
    "win_risk_cumulative",
    f"{SCAN} SELECT b.le, (SELECT count(*) FROM scan WHERE risk_score <= b.bound) AS cumulative_tools "
    "FROM (VALUES ('25', 25), ('50', 50), ('75', 75), ('100', 100), ('+Inf', 1000)) b(le, bound)",
)
_LATEST = f"{_REQ}, latest AS (SELECT value / 1000 AS v FROM requests ORDER BY ts DESC, request_id DESC LIMIT 1000)"
oracle(
    "topk_scan_durations",
    f"{_LATEST} SELECT round(avg(v), 6) AS avg_seconds, round(max(v), 6) AS max_seconds, count(*) AS samples FROM latest",
)
oracle(
    "duration_ms",
    f"{_LATEST} SELECT round(avg(v) * 1000, 3) AS avg_ms, CASE WHEN avg(v) >= 0.5 THEN 'red' WHEN avg(v) >= 0.1 "
    "THEN 'yellow' ELSE 'green' END AS avg_state, round(max(v) * 1000, 3) AS max_ms, CASE WHEN max(v) >= 1 THEN 'red' "
    "WHEN max(v) >= 0.2 THEN 'yellow' ELSE 'green' END AS max_state FROM latest",
)
_OVERRIDES = f"(SELECT count(*) FROM catalog WHERE {_BLOCK} OR {_ALLOW} OR length(description) > 5000)"
oracle("agg_policy_overrides", f"{_CAT} SELECT {_OVERRIDES} AS policy_overrides")
oracle(
    "agg_kill_switch",
    f"{_REQ} SELECT arg_max(value > 35, ts) AS enabled, count_if(value > 35)::BIGINT AS activations "
    "FROM requests WHERE method = 'other'",
)
_SERVED = (
    "served AS (SELECT toxic = 1 AS malicious, n > 1 AS cached FROM (SELECT doc_id, row_number() OVER "
    "(PARTITION BY text ORDER BY doc_id) AS n FROM documents) LEFT JOIN labels USING (doc_id))"
)
oracle(
    "agg_semantic_counters",
    f"WITH {_SERVED} SELECT count(*) AS semantic_scans, count_if(malicious)::BIGINT AS semantic_detections, "
    "count_if(cached)::BIGINT AS cache_hits FROM served",
)
_RCTES = _RSCAN[len("WITH "):]
_QCTES = _REQ[len("WITH "):]


def _metrics_table() -> str:
    single = {
        "scans_total": "(SELECT count(DISTINCT server_name) FROM scan)",
        "tools_scanned_total": "(SELECT count(*) FROM scan)",
        "tools_blocked_total": "(SELECT count(*) FROM scan WHERE blocked)",
        "tools_warned_total": "(SELECT count(*) FROM scan WHERE NOT blocked AND risk_score >= 26)",
        "tools_safe_total": "(SELECT count(*) FROM scan WHERE risk_score < 26)",
        "scan_duration_seconds_avg": "(SELECT avg(v) FROM latest)",
        "scan_duration_seconds_max": "(SELECT max(v) FROM latest)",
        "scan_duration_seconds_count": "(SELECT count(*) FROM latest)",
        "kill_switch_enabled": "(SELECT CAST(arg_max(value > 35, ts) AS INTEGER) FROM requests WHERE method = 'other')",
        "kill_switch_activations_total": "(SELECT count(*) FROM requests WHERE method = 'other' AND value > 35)",
        "policy_overrides_total": _OVERRIDES,
        "semantic_scans_total": "(SELECT count(*) FROM served)",
        "semantic_detections_total": "(SELECT count(*) FROM served WHERE malicious)",
        "semantic_cache_hits_total": "(SELECT count(*) FROM served WHERE cached)",
    }
    rows = [f"SELECT '{n}' AS name, '' AS label, round(CAST({e} AS DOUBLE), 6) AS value" for n, e in single.items()]
    rows.append(
        "SELECT 'detections_total', p, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(patterns) AS p FROM scan) GROUP BY p"
    )
    rows.append(
        "SELECT 'response_findings_total', x.t, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(f) AS x FROM scanned) GROUP BY x.t"
    )
    rows.append(
        "SELECT 'risk_score_bucket', b.le, CAST((SELECT count(*) FROM scan WHERE risk_score <= b.bound) AS DOUBLE) "
        "FROM (VALUES ('25', 25), ('50', 50), ('75', 75), ('100', 100), ('+Inf', 1000)) b(le, bound)"
    )
    latest = _LATEST[len(_REQ) + 2:]
    return f"{SCAN}, {_RCTES}, {_QCTES}, {latest}, {_SERVED} " + " UNION ALL ".join(rows)


oracle("metrics_table", _metrics_table())


def _metric_text() -> str:
    help_ = {
        "scans_total": "counter|Catalog scans", "tools_scanned_total": "counter|Tools scanned",
        "tools_blocked_total": "counter|Tools blocked", "tools_warned_total": "counter|Tools with a warning",
        "tools_safe_total": "counter|Safe tools", "detections_total": "counter|Detections by detector",
        "response_findings_total": "counter|Response findings by type",
        "risk_score_bucket": "gauge|Risk scores up to a bound",
        "scan_duration_seconds_avg": "gauge|Average of the latest scan durations",
        "scan_duration_seconds_max": "gauge|Maximum of the latest scan durations",
        "scan_duration_seconds_count": "gauge|Number of the latest scan durations",
        "kill_switch_enabled": "gauge|Whether the kill switch is on",
        "kill_switch_activations_total": "counter|Writes that switched the kill switch on",
        "policy_overrides_total": "counter|Policy decisions to block or allow",
        "semantic_scans_total": "counter|Semantic scans", "semantic_detections_total": "counter|Malicious verdicts",
        "semantic_cache_hits_total": "counter|Verdicts served from the store",
    }
    keys = {"detections_total": "pattern", "response_findings_total": "type", "risk_score_bucket": "le"}
    key = "CASE name " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in keys.items()) + " END"
    texts = " UNION ALL ".join(
        f"SELECT '{n}' AS name, {part} AS part, '# {word} toolwarden_{n} {value}' AS line"
        for n, both in help_.items()
        for part, word, value in ((0, "HELP", both.split("|")[1]), (1, "TYPE", both.split("|")[0]))
    )
    number = (
        "CASE WHEN name IN ('scan_duration_seconds_avg', 'scan_duration_seconds_max') THEN printf('%.6f', value) "
        "ELSE CAST(CAST(value AS BIGINT) AS VARCHAR) END"
    )
    return (
        f"WITH all_metrics AS ({_metrics_table()}) SELECT * FROM ({texts}) WHERE name IN (SELECT name FROM all_metrics) UNION ALL "
        f"SELECT name, 2, concat('toolwarden_', name, CASE WHEN {key} IS NULL THEN '' "
        f"ELSE concat('{{', {key}, '=\"', label, '\"}}') END, ' ', {number}) FROM all_metrics"
    )


oracle("sink_metrics_text", _metric_text())


def _counts_json(rows: str) -> str:
    return (
        "(SELECT concat('{', string_agg(concat('\"', k, '\":', n), ',' ORDER BY k), '}') FROM "
        f"(SELECT k, count(*) AS n FROM ({rows}) GROUP BY k))"
    )


oracle(
    "agg_firewall_stats",
    f"{SCAN}, {_RCTES}, {_QCTES} SELECT (SELECT count(DISTINCT server_name) FROM scan) AS total_scans, "
    "(SELECT count(*) FROM scan) AS total_tools_scanned, (SELECT count(*) FROM scan WHERE blocked) AS total_tools_blocked, "
    + _counts_json("SELECT unnest(patterns) AS k FROM scan")
    + " AS detections_by_pattern, (SELECT count(*) FROM scanned) AS responses_scanned, "
    "(SELECT sum(len(f))::BIGINT FROM scanned) AS response_findings, "
    + _counts_json("SELECT unnest(list_transform(f, lambda x: x.t)) AS k FROM scanned")
    + " AS findings_by_type, (SELECT arg_max(value > 35, ts) FROM requests WHERE method = 'other') AS kill_switch_enabled",
)
oracle(
    "agg_policy_rule_counts",
    f"{_CAT} SELECT 'blocklist_rules' AS kind, 2 AS rules, count_if({_BLOCK})::BIGINT AS tools FROM catalog UNION ALL "
    f"SELECT 'allowlist_rules', 2, count_if({_ALLOW})::BIGINT FROM catalog UNION ALL "
    "SELECT 'server_trust_rules', 2, count_if(server_name IN ('src2', 'src3'))::BIGINT FROM catalog",
)
oracle(
    "rate_scans_per_min",
    f"{_REQ}, ticks AS (SELECT CAST(floor(epoch(ts) / 5) AS BIGINT) * 5 + 5 * unnest(range(1, 13)) AS scrape_epoch, value "
    "FROM requests WHERE method = 'tools/list') SELECT scrape_epoch, count(*) AS scans_per_min, "
    "CAST(sum(floor(value / 10)) AS BIGINT) AS blocked_per_min FROM ticks GROUP BY 1",
)

# --- events and streams ----------------------------------------------------------------

_REPLIES = """merged AS (
  SELECT user_id, request_id, ts, 0 AS answer, method AS stored, method FROM requests UNION ALL
  SELECT user_id, CASE WHEN method = 'other' THEN -1 - request_id ELSE request_id END,
    ts + INTERVAL 30 SECOND, 1, '', 'tools/call' FROM requests
), states AS (
  SELECT *, lag(stored) OVER (PARTITION BY user_id, request_id ORDER BY ts, answer) AS before FROM merged
)"""
oracle(
    "correlate_replies",
    f"{_REQ}, {_REPLIES} SELECT request_id, user_id, coalesce(nullif(before, ''), method) AS method, "
    "coalesce(nullif(before, ''), '') <> '' AS matched FROM states WHERE answer = 1",
)
_SESSIONS = """judged AS (
  SELECT request_id, method IN ('initialize', 'close') OR coalesce(last_value(
    CASE method WHEN 'initialize' THEN TRUE WHEN 'close' THEN FALSE END IGNORE NULLS) OVER (
    PARTITION BY user_id ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS valid
  FROM requests
)"""
oracle("session_validity", f"{_REQ}, {_SESSIONS} SELECT request_id, valid FROM judged")
oracle("stream_session_validity", _ORACLES["session_validity"])
oracle("stream_scan_catalog", f"{SCAN} SELECT tool_id, risk_score, risk_level, blocked FROM scan")
oracle(
    "stream_scan_responses",
    f"{_RSCAN} SELECT response_id, item_pos, risk_level, {_REDACT} AS content FROM scanned",
)
oracle(
    "stream_correlate",
    f"{_REQ} SELECT CASE WHEN method = 'other' THEN -1 - request_id ELSE request_id END AS request_id, "
    "CASE WHEN method = 'other' THEN 'tools/call' ELSE method END AS method, method <> 'other' AS matched FROM requests",
)
oracle(
    "stream_method_route",
    f"{_REQ} SELECT request_id, method, CASE method WHEN 'tools/list' THEN 'catalog' WHEN 'tools/call' THEN 'response' "
    "ELSE 'pass' END AS route FROM requests",
)
oracle(
    "counter_rates",
    """WITH s AS (SELECT event_type AS counter, event_id, epoch_us(ts) AS us, ((epoch_us(ts) // 1000000) % 7200)::DOUBLE AS v FROM events
), p AS (SELECT *, lag(v) OVER (PARTITION BY counter ORDER BY us, event_id) AS was FROM s
), g AS (SELECT counter, event_id, us, v, CASE WHEN was IS NULL THEN 0 WHEN v >= was THEN v - was ELSE v END AS grown,
  (us + 299999999) // 300000000 AS slot FROM p
), e AS (SELECT counter, unnest(range(slot, slot + 12)) AS k, us, event_id, v, grown FROM g
), r AS (SELECT *, row_number() OVER (PARTITION BY counter, k ORDER BY us, event_id) AS i FROM e
), w AS (SELECT counter, k, count(*) AS n, max(us) AS last, min(us) AS first, max(CASE WHEN i = 1 THEN v END) AS start_v,
  sum(CASE WHEN i > 1 THEN grown ELSE 0 END) AS increase FROM r GROUP BY counter, k HAVING count(*) > 1 AND max(us) > min(us)
), m AS (SELECT counter, k, increase, start_v, (last - first) / 1e6 AS covered, (last - first) / 1e6 / (n - 1) AS apart,
  (first - k * 300000000 + 3600000000) / 1e6 AS head, (k * 300000000 - last) / 1e6 AS tail FROM w
), x AS (SELECT *, CASE WHEN head < 1.1 * apart THEN head ELSE apart / 2 END AS h, CASE WHEN tail < 1.1 * apart THEN tail ELSE apart / 2 END AS t FROM m)
SELECT counter, (k * 300)::BIGINT AS at, round(increase * (covered + CASE WHEN increase > 0 THEN least(h, covered * start_v / increase) ELSE h END + t)
  / covered / 3600, 6) AS rate FROM x""",
)
_LIKE = "lower({0}) LIKE replace(replace(replace(replace(lower({1}), '!', '!!'), '%', '!%'), '_', '!_'), '*', '%') ESCAPE '!'"
oracle(
    "policy_rule_table",
    f"""WITH rules AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'block' ELSE 'allow' END AS list,
  CASE c_custkey % 4 WHEN 0 THEN 'tool_' || c_custkey || '*' WHEN 1 THEN 'TOOL_' || c_custkey WHEN 2 THEN '*_' || c_custkey
    ELSE '*l_' || c_custkey || '*' END AS tool_glob,
  CASE c_custkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'src' || c_custkey % 40 ELSE 'SRC' || c_custkey % 4 || '*' END AS server_glob FROM customer
), met AS (SELECT doc_id, list, ord FROM documents JOIN rules ON {_LIKE.format("'tool_' || doc_id", "tool_glob")} AND {_LIKE.format("source", "server_glob")})
SELECT d.doc_id AS tool_id, min(ord) FILTER (list = 'block') AS block_ord, min(ord) FILTER (list = 'allow') AS allow_ord,
  CASE WHEN min(ord) FILTER (list = 'block') IS NOT NULL THEN 'block' WHEN min(ord) IS NOT NULL THEN 'allow' ELSE 'default' END AS action
FROM documents d LEFT JOIN met m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
)
oracle(
    "verdict_store",
    """WITH RECURSIVE o AS (
  SELECT doc_id % 6 AS b, sha256(coalesce(lang, 'unknown') || ':' || coalesce(text, '')) AS k, min(doc_id) AS first FROM documents GROUP BY 1, 2
), l AS (SELECT b, list(k || ':' || b ORDER BY first, k) AS ks FROM o GROUP BY b
), s AS (
  SELECT -1::BIGINT AS b, []::VARCHAR[] AS held
  UNION ALL
  SELECT s.b + 1, (list_concat(s.held, list_filter(coalesce(l.ks, []), lambda x: NOT list_contains(list_transform(s.held, lambda h: left(h, 64)), left(x, 64)))))[-300:]
  FROM s LEFT JOIN l ON l.b = s.b + 1 WHERE s.b < 5
)
SELECT left(x, 64) AS cache_key, substr(x, 66)::BIGINT AS batch FROM (SELECT unnest(held) AS x FROM s WHERE b = 5)""",
)
oracle("stream_session_state", _ORACLES["session_validity"])
oracle(
    "stream_closed_windows",
    f"{_REQ} SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, method, count(*) AS requests FROM requests GROUP BY 1, 2",
)
oracle(
    "stream_answers",
    f"{_REQ} SELECT CASE WHEN method = 'other' THEN -1 - request_id ELSE request_id END AS request_id, user_id, "
    "CASE WHEN method = 'other' THEN 'tools/call' ELSE method END AS method, method <> 'other' AS matched FROM requests",
)
oracle(
    "stream_message_sinks",
    f"SELECT 'catalog' AS sink, tool_id AS request_id, risk_level || ':' || risk_score || ':' || blocked AS said "
    f"FROM ({SCAN} SELECT tool_id, risk_score, risk_level, blocked FROM scan) WHERE tool_id % 10 <> 0 "
    f"UNION ALL SELECT 'response', -1000 * (response_id + 1) - item_pos, risk_level || ':' || sha256(content) "
    f"FROM ({_RSCAN} SELECT response_id, item_pos, risk_level, {_REDACT} AS content FROM scanned) WHERE content <> '' "
    "UNION ALL SELECT 'pass', doc_id, 'own' FROM documents WHERE doc_id % 10 = 0",
)
oracle("stream_enforce_catalog", _ORACLES["enforce_catalog"])
oracle("stream_counters", _ORACLES["agg_detections_by_pattern"])
oracle(
    "stream_rate_window",
    f"{_REQ} SELECT strftime(ts, '%Y-%m-%d') AS day, method, count(*) AS requests FROM requests GROUP BY 1, 2",
)
oracle("stream_verdict_dedup", "SELECT DISTINCT sha256(concat('tool:', text)) AS cache_key FROM documents")
oracle(
    "stream_kill_switch",
    f"{_CAT}, {_QCTES} SELECT tool_id, tool_name FROM catalog "
    "WHERE NOT (SELECT arg_max(value > 35, ts) FROM requests WHERE method = 'other')",
)
oracle(
    "stream_audit_sink",
    f"{SCAN} SELECT strftime({_DAY}, '%Y-%m-%d') AS date, server_name, tool_name, risk_score, blocked FROM scan",
)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
