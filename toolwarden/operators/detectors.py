"""Detectors over a tool catalog (``tool_name``, ``description``).

Every detector is a struct Column built from native expressions, so detection
is one narrow projection: no shuffle, no Python worker.  The registry keeps the
detectors in their fixed order; further ones are added by registering a
function ``(name, description, folded description) -> Column`` or, where native
expressions do not suffice, one that wraps a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden.functions import text as X
from toolwarden.plans.once import compute_once

Detector = Callable[[Column, Column, Column], Column]

_TEXTS = {
    "Prompt Injection": "Text that tries to override the instructions of an agent.",
    "Data Exfiltration": "Text or links that send data to an external place.",
    "Cross-Tool Manipulation": "Text that pushes the agent to call other tools.",
    "Invisible Characters": "Characters that hide content from a reader.",
    "Obfuscated Payloads": "Encoded content that may hide instructions.",
    "Description Anomalies": "Unusual size or structure of the description.",
    "Dangerous Commands": "Dangerous system commands or names of credentials.",
    "SSRF / Internal Access": "Internal networks, cloud metadata or loopback addresses.",
    R.SEMANTIC: "Malicious intent found by a semantic scorer.",
}


def detection(
    name: str, matched: Column, severity: Column | int, evidence: Column
) -> Column:
    """Detection struct; evidence is empty when nothing matched."""
    return F.struct(
        F.lit(name).alias("pattern_name"),
        (severity if isinstance(severity, Column) else F.lit(severity)).cast("int").alias("severity"),
        matched.alias("matched"),
        F.when(matched, evidence).otherwise(F.lit("")).alias("evidence"),
        F.lit(_TEXTS.get(name, name)).alias("description"),
    )


# The built-in detections are written as SQL text over the step columns: one
# expression each, instead of hundreds of calls from the driver per job.


def _detection_sql(name: str, matched: str, evidence: str, severity: str | None = None) -> str:
    severity = severity or str(R.DETECTOR_SEVERITY[name])
    return (
        f"named_struct('pattern_name', {X.sql_text(name)}, 'severity', {severity}, 'matched', {matched}, "
        f"'evidence', CASE WHEN {matched} THEN {evidence} ELSE '' END, "
        f"'description', {X.sql_text(_TEXTS[name])})"
    )


def _samples_sql(matches: str) -> str:
    """First matches as ``'a', 'b'``."""
    quoted = f"transform(slice({matches}, 1, {R.MAX_MATCH_SAMPLES}), m -> concat('\\'', m, '\\''))"
    return f"array_join({quoted}, ', ')"


def _matches_sql(name: str, matches: str) -> str:
    """Evidence: number of matches and the first of them."""
    evidence = f"concat(CAST(size({matches}) AS STRING), ' match(es): ', {_samples_sql(matches)})"
    return _detection_sql(name, f"size({matches}) > 0", evidence)


def _exfiltration_sql() -> str:
    urls = f"array_join(slice(_urls, 1, {R.MAX_URL_SAMPLES}), ', ')"
    return _detection_sql(
        "Data Exfiltration",
        "(size(_phrases) > 0 OR size(_urls) > 0)",
        "concat_ws('; ', "
        f"CASE WHEN size(_phrases) > 0 THEN concat('phrases: ', {_samples_sql('_phrases')}) END, "
        f"CASE WHEN size(_urls) > 0 THEN concat('urls: ', {urls}) END)",
        f"CASE WHEN size(_phrases) = 0 AND size(_urls) > 0 THEN {R.URL_ONLY_SEVERITY} "
        f"ELSE {R.DETECTOR_SEVERITY['Data Exfiltration']} END",
    )


def _exfiltration_phrases(find: X.Anchored) -> Column:
    first_image = F.transform(
        F.slice(find.find_all(R.IMAGE_LINK), 1, 1),
        lambda m: F.concat(F.lit("image_link:"), F.left(m, F.lit(R.MAX_IMAGE_CHARS))),
    )
    return F.concat(find.find_all_rules(R.DATA_EXFILTRATION), first_image)


def _hidden_sql() -> str:
    """Evidence: count, then code point and 0-based position of the first hits.

    The text between hits gives their positions: hit number i comes after the
    first i + 1 pieces and i hits."""
    hidden = X.sql_text(X.hidden_class())
    hits = f"regexp_extract_all(description, {hidden}, 0)"
    pieces = f"split(description, {hidden}, {R.MAX_MATCH_SAMPLES + 1})"
    digits = "hex(ascii(c))"
    label = f"CASE WHEN length({digits}) < 4 THEN lpad({digits}, 4, '0') ELSE {digits} END"
    position = f"aggregate(slice({pieces}, 1, i + 1), 0, (n, piece) -> n + length(piece)) + i"
    places = (
        f"transform(slice({hits}, 1, {R.MAX_MATCH_SAMPLES}), "
        f"(c, i) -> concat('U+', {label}, '@', CAST({position} AS STRING)))"
    )
    return _detection_sql(
        "Invisible Characters",
        "_hidden",
        f"concat(CAST(size({hits}) AS STRING), ' character(s): ', array_join({places}, '; '))",
    )


# The JVM recurses once per repetition of a backtracking group; possessive
# repetition finds the same runs in a loop, whatever the length of a hex dump.
_HEX_RUN = R.HEX_RUN.replace(r"\s*", r"\s*+") + "+"

def _base64_runs(text: Column) -> Column:
    return F.when(
        X.has_base64_run(text, 20), F.regexp_extract_all(text, F.lit(R.BASE64_RUN), F.lit(0))
    ).otherwise(X.empty_strings())


def _count(text: Column, low: Column, anchor: str, pattern: str) -> Column:
    found = F.regexp_count(text, F.lit(X.CASE_SENSITIVE + X.jvm_dialect(pattern)))
    return F.when(F.contains(low, F.lit(anchor)), found).otherwise(0)


def _readable_samples() -> Column:
    """Decoded texts of the base64 runs that are readable; only rows with a run
    pay for decoding."""
    readable = F.filter(
        F.transform("_runs", X.decoded_base64),
        lambda t: t.isNotNull() & (F.length(t) > R.MIN_DECODED_CHARS) & X.is_printable(t),
    )
    samples = F.transform(
        readable,
        lambda t: F.concat(
            F.lit("base64 of '"), F.left(t, F.lit(R.MAX_DECODED_CHARS)), F.lit("...'")
        ),
    )
    return F.when(F.size("_runs") > 0, samples).otherwise(X.empty_strings())


def _obfuscation_sql(evidence: bool = True) -> str:
    found = (
        "concat_ws('; ', _samples, "
        "CASE WHEN _hex > 0 THEN concat('hex runs: ', CAST(_hex AS STRING)) END, "
        f"CASE WHEN _escapes > {R.MIN_ESCAPES} THEN concat('unicode escapes: ', CAST(_escapes AS STRING)) END, "
        f"CASE WHEN _entities > {R.MIN_ESCAPES} THEN concat('html entities: ', CAST(_entities AS STRING)) END)"
    )
    matched = (
        f"(size(_samples) > 0 OR _hex > 0 OR _escapes > {R.MIN_ESCAPES} OR _entities > {R.MIN_ESCAPES})"
    )
    return _detection_sql("Obfuscated Payloads", matched, found if evidence else "''")


def _anomalies_sql(evidence: bool = True) -> str:
    size, ratio = "_size", "_ratio"
    long, tall = f"{size} > {R.MAX_DESCRIPTION_CHARS}", f"{ratio} > {R.MAX_NAME_RATIO}"
    found = (
        "concat_ws('; ', "
        f"CASE WHEN {long} THEN concat('length ', CAST({size} AS STRING)) END, "
        "CASE WHEN _comments > 0 THEN concat('html comments: ', CAST(_comments AS STRING)) END, "
        "CASE WHEN _newlines > 0 THEN concat('newline blocks: ', CAST(_newlines AS STRING)) END, "
        f"CASE WHEN {tall} THEN concat('length/name ratio ', CAST(CAST(bround({ratio}) AS BIGINT) AS STRING)) END)"
    )
    matched = f"({long} OR _comments > 0 OR _newlines > 0 OR coalesce({tall}, false))"
    return _detection_sql("Description Anomalies", matched, found if evidence else "''")


#: Text rules by detector; their anchors are tested once per text.
_RULES: dict[str, tuple[R.Rule, ...]] = {
    "Prompt Injection": R.PROMPT_INJECTION,
    "Data Exfiltration": (*R.DATA_EXFILTRATION, R.EXTERNAL_URL, R.IMAGE_LINK),
    "Cross-Tool Manipulation": R.CROSS_TOOL,
    "Dangerous Commands": R.DANGEROUS_COMMANDS,
    "SSRF / Internal Access": R.INTERNAL_ACCESS,
}

#: Intermediate columns by detector, projected first so that no expression is
#: evaluated twice.
_STEPS: dict[str, dict[str, Callable[[X.Anchored], Column]]] = {
    "Prompt Injection": {"_injection": lambda f: f.find_all_rules(R.PROMPT_INJECTION)},
    "Data Exfiltration": {
        "_phrases": _exfiltration_phrases,
        "_urls": lambda f: f.find_all(R.EXTERNAL_URL),
    },
    "Cross-Tool Manipulation": {"_cross": lambda f: f.find_all_rules(R.CROSS_TOOL)},
    "Invisible Characters": {"_hidden": lambda f: X.has_hidden(f.text)},
    "Obfuscated Payloads": {
        "_runs": lambda f: _base64_runs(f.text),
        "_hex": lambda f: _count(f.text, f.low, "0x", _HEX_RUN),
        "_escapes": lambda f: _count(f.text, f.low, "\\u", R.UNICODE_ESCAPE),
        "_entities": lambda f: _count(f.text, f.low, "&#x", R.HTML_ENTITY),
    },
    "Description Anomalies": {
        "_size": lambda f: F.length(f.text),
        "_ratio": lambda f: F.try_divide(F.length(f.text), F.length("tool_name")),
        "_comments": lambda f: _count(f.text, f.text, R.COMMENT_OPENER, R.COMMENT_OPENER),
        "_newlines": lambda f: _count(f.text, f.text, "\n" * 10, R.NEWLINE_BLOCK),
    },
    "Dangerous Commands": {"_commands": lambda f: f.find_all_rules(R.DANGEROUS_COMMANDS)},
    "SSRF / Internal Access": {"_internal": lambda f: f.find_all_rules(R.INTERNAL_ACCESS)},
}

#: Detection of each detector over its step columns, in registry order.
_REGISTRY: dict[str, str] = {
    "Prompt Injection": _matches_sql("Prompt Injection", "_injection"),
    "Data Exfiltration": _exfiltration_sql(),
    "Cross-Tool Manipulation": _matches_sql("Cross-Tool Manipulation", "_cross"),
    "Invisible Characters": _hidden_sql(),
    "Obfuscated Payloads": _obfuscation_sql(),
    "Description Anomalies": _anomalies_sql(),
    "Dangerous Commands": _matches_sql("Dangerous Commands", "_commands"),
    "SSRF / Internal Access": _matches_sql("SSRF / Internal Access", "_internal"),
}

#: Without evidence a text rule is only tested, not searched for all its matches.
_LEAN_STEPS: dict[str, dict[str, Callable[[X.Anchored], Column]]] = _STEPS | {
    "Prompt Injection": {"_injection": lambda f: f.any_rule(R.PROMPT_INJECTION)},
    "Data Exfiltration": {
        "_phrases": lambda f: f.any_rule((*R.DATA_EXFILTRATION, R.IMAGE_LINK)),
        "_urls": lambda f: f.any_rule((R.EXTERNAL_URL,)),
    },
    "Cross-Tool Manipulation": {"_cross": lambda f: f.any_rule(R.CROSS_TOOL)},
    "Dangerous Commands": {"_commands": lambda f: f.any_rule(R.DANGEROUS_COMMANDS)},
    "SSRF / Internal Access": {"_internal": lambda f: f.any_rule(R.INTERNAL_ACCESS)},
}
_NONE = "''"
_LEAN_REGISTRY: dict[str, str] = {
    "Prompt Injection": _detection_sql("Prompt Injection", "_injection", _NONE),
    "Data Exfiltration": _detection_sql(
        "Data Exfiltration",
        "(_phrases OR _urls)",
        _NONE,
        f"CASE WHEN NOT _phrases AND _urls THEN {R.URL_ONLY_SEVERITY} ELSE {R.DETECTOR_SEVERITY['Data Exfiltration']} END",
    ),
    "Cross-Tool Manipulation": _detection_sql("Cross-Tool Manipulation", "_cross", _NONE),
    "Invisible Characters": _detection_sql("Invisible Characters", "_hidden", _NONE),
    "Obfuscated Payloads": _obfuscation_sql(evidence=False),
    "Description Anomalies": _anomalies_sql(evidence=False),
    "Dangerous Commands": _detection_sql("Dangerous Commands", "_commands", _NONE),
    "SSRF / Internal Access": _detection_sql("SSRF / Internal Access", "_internal", _NONE),
}

DETECTOR_NAMES = tuple(_REGISTRY)


def enabled_detectors(
    enabled: Iterable[str] | None = None, required: Iterable[str] = ()
) -> tuple[str, ...]:
    """Detectors to run, in registry order.  Nothing enabled means all of them;
    required ones cannot be switched off."""
    wanted = set(enabled or ())
    if not wanted:
        return DETECTOR_NAMES
    wanted |= set(required)
    return tuple(n for n in DETECTOR_NAMES if n in wanted)


def normalise_tools(tools: DataFrame) -> DataFrame:
    """Defaults of the catalog contract: nameless tools are ``unknown``."""
    return tools.withColumns(
        {
            "tool_name": F.coalesce("tool_name", F.lit("unknown")),
            "description": F.coalesce("description", F.lit("")),
        }
    )


def with_detections(
    tools: DataFrame,
    enabled: Iterable[str] | None = None,
    extra: dict[str, Detector] | None = None,
    column: str = "detections",
    evidence: bool = True,
) -> DataFrame:
    """Add ``detections``: one struct per enabled detector, matched or not.  Where nobody
    reads the evidence, ``evidence=False`` leaves it empty and saves most of the search."""
    names = list(DETECTOR_NAMES) if enabled is None else enabled_detectors(enabled)
    name, text, low = F.col("tool_name"), F.col("description"), F.col("_low")
    find = X.Anchored("description", "_low", [r for n in names for r in _RULES.get(n, ())])
    flags = find.flags()
    all_steps, registry = (_STEPS, _REGISTRY) if evidence else (_LEAN_STEPS, _LEAN_REGISTRY)
    steps = {step: build(find) for n in names for step, build in all_steps.get(n, {}).items()}
    later = {"_samples": _readable_samples()} if "Obfuscated Payloads" in names else {}
    dets = [F.expr(registry[n]) for n in names]
    dets += [build(name, text, low) for build in (extra or {}).values()]
    prepared = (
        normalise_tools(tools)
        .withColumn("_low", X.folded(text))
        .withColumns(flags)
        .withColumns(steps)
        .withColumns(later)
    )
    return compute_once(
        prepared, {column: F.array(*dets)}, drop=("_low", *flags, *steps, *later)
    )


def detect(tools: DataFrame, detector: str) -> DataFrame:
    """Run one detector; adds its fields as columns."""
    detected = with_detections(tools, [detector], column="_dets")
    kept = [c for c in detected.columns if c != "_dets"]
    return detected.select(*kept, F.inline("_dets"))


def detections_long(tools: DataFrame, **kwargs) -> DataFrame:
    """One row per tool and detector, in registry order; no shuffle."""
    keys = [c for c in tools.columns if c != "description"]
    return (
        with_detections(tools, **kwargs)
        .select(*keys, F.posexplode("detections").alias("detector_pos", "_det"))
        .select(*keys, "detector_pos", "_det.*")
    )
