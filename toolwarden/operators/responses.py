"""Secrets, personal data and data leaks in tool responses; redaction.

Findings of a response are an array in its row: finding, rating and redacting
are one narrow projection in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolwarden import rules as R
from toolwarden import schemas
from toolwarden.functions import text as X
from toolwarden.plans.once import compute_once

CATEGORIES = ("secret", "pii", "data_leak")

# Rules without a literal need digits; these are tested first.
_DIGIT_GATE = {
    "phone_us": r"[0-9]{3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-",
    "credit_card": r"[0-9]{12}",
    "ip_address": r"[0-9]\.[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
}


def luhn_valid(number: Column) -> Column:
    """Luhn checksum of at least 13 digits."""
    return (F.length(number) >= R.CARD_MIN_DIGITS) & F.call_function("luhn_check", number)


def mask_evidence(value: Column) -> Column:
    return X.mask(value, R.MASK_KEEP_CHARS)


def _matches(find: X.Anchored, finding: R.FindingRule) -> Column:
    found = find.find_all(finding.rule)
    gate = _DIGIT_GATE.get(finding.finding_type)
    if finding.finding_type == "large_base64":
        found = F.when(X.has_base64_run(find.text, 100), found).otherwise(X.empty_strings())
    if gate:
        found = F.when(F.rlike(find.text, F.lit(gate)), found).otherwise(X.empty_strings())
    if finding.finding_type == "credit_card":
        found = F.filter(found, luhn_valid)
    return found


def _finding(category: str, finding_type: str, severity: int, evidence: Column, shown: Column):
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(finding_type).alias("finding_type"),
        F.lit(severity).alias("severity"),
        evidence.alias("evidence"),
        shown.alias("redacted_evidence"),
    )


def _value_findings(category: str, finding: R.FindingRule, matches: Column) -> Column:
    return F.transform(
        matches,
        lambda m: _finding(category, finding.finding_type, finding.severity, m, mask_evidence(m)),
    )


def _size_label(finding_type: str, size: Column) -> Column:
    return F.concat(F.lit(f"[{finding_type}: "), size.cast("string"), F.lit(" chars]"))


def _leak_findings(finding: R.FindingRule, matches: Column) -> Column:
    def build(m: Column) -> Column:
        cut = F.when(
            F.length(m) > R.MAX_LEAK_CHARS,
            F.concat(F.left(m, F.lit(R.MAX_LEAK_CHARS)), F.lit("...")),
        ).otherwise(m)
        shown = _size_label(finding.finding_type, F.length(m))
        return _finding("data_leak", finding.finding_type, finding.severity, cut, shown)

    return F.transform(matches, build)


# A JSON document starts like this; nothing else is parsed.
_JSON_START = r"\A[ \t\r\n]*+(?:[\[{\"0-9-]|true|false|null)"
# Strings as JSON writes them; what is left of a document has neither quotes nor control characters.
_JSON_STRING = r'"(?:[^"\\\x00-\x1F]++|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*+"'
_NO_JSON_REST = r"['\"\x00-\x08\x0B\x0C\x0E-\x1F/]|\x{FEFF}"


def is_json(text: Column) -> Column:
    """Is the text one JSON value?

    A value followed by anything would end the array or the object it is put
    into; no rest can end both.  The parser of the engine is more lenient with
    strings, so these are tested on their own."""
    one_item = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    one_field = F.size(F.json_object_keys(F.concat(F.lit('{"a":'), text, F.lit("}")))) == 1
    rest = F.regexp_replace(text, _JSON_STRING, "")
    strict = ~F.rlike(rest, F.lit(_NO_JSON_REST))
    return F.coalesce(strict & one_item & one_field, F.lit(False))


def with_json_dump(responses: DataFrame, column: str = "_json_dump") -> DataFrame:
    """Mark responses that are one long JSON document."""
    content = F.col("content")
    candidate = (F.length(content) > R.JSON_DUMP_MIN_CHARS) & F.rlike(content, F.lit(_JSON_START))
    return responses.withColumn(column, F.when(candidate, is_json(content)).otherwise(False))


def with_findings(
    responses: DataFrame,
    secrets: bool = True,
    pii: bool = True,
    data_leak: bool = True,
) -> DataFrame:
    """Add ``findings``: secrets, then personal data, then data leaks; within a
    category by rule, then by position.  Each category can be switched off."""
    wanted = [
        *([("secret", f) for f in R.SECRETS] if secrets else []),
        *([("pii", f) for f in R.PERSONAL_DATA] if pii else []),
        *([("data_leak", f) for f in R.DATA_LEAKS] if data_leak else []),
    ]
    find = X.Anchored("content", "_low", [f.rule for _, f in wanted])
    flags = find.flags()
    steps = {f"_m_{f.finding_type}": _matches(find, f) for _, f in wanted}
    prepared = responses.withColumn("content", F.coalesce("content", F.lit("")))
    if data_leak:
        prepared = with_json_dump(prepared)
    prepared = (
        prepared.withColumn("_low", X.folded(F.col("content")))
        .withColumns(flags)
        .withColumns(steps)
    )
    parts = [
        _leak_findings(f, F.col(f"_m_{f.finding_type}"))
        if category == "data_leak"
        else _value_findings(category, f, F.col(f"_m_{f.finding_type}"))
        for category, f in wanted
    ]
    if data_leak:
        size = F.length("content")
        dump = _finding(
            "data_leak",
            R.JSON_DUMP,
            R.JSON_DUMP_SEVERITY,
            F.concat(F.lit("JSON of "), size.cast("string"), F.lit(" chars")),
            _size_label(R.JSON_DUMP, size),
        )
        parts.append(F.when(F.col("_json_dump"), F.array(dump)).otherwise(F.array()))
    nothing = F.array().cast(f"array<{schemas.FINDING}>")
    findings = F.concat(nothing, *[p.cast(f"array<{schemas.FINDING}>") for p in parts])
    return compute_once(
        prepared,
        {"findings": findings},
        drop=("_low", "_json_dump", *flags, *steps),
    )


def rate_findings(found: DataFrame) -> DataFrame:
    """Content length, level and whether the response must be redacted."""
    worst = F.coalesce(F.array_max("findings.severity"), F.lit(0))
    return found.withColumns(
        {
            "content_length": F.length("content"),
            "risk_level": F.when(worst >= R.CRITICAL_SEVERITY, "critical")
            .when(worst >= R.WARNING_SEVERITY, "warning")
            .otherwise("clean"),
            "should_redact": worst >= R.CRITICAL_SEVERITY,
        }
    )


def scan_responses(responses: DataFrame, **switches: bool) -> DataFrame:
    """Scan every response (``content``).  Narrow."""
    return rate_findings(with_findings(responses, **switches))


def findings_long(scanned: DataFrame) -> DataFrame:
    """One row per finding; the raw evidence is left behind."""
    keys = [
        c
        for c in scanned.columns
        if c not in ("content", "findings", "content_length", "risk_level", "should_redact")
    ]
    return scanned.select(*keys, F.posexplode("findings").alias("finding_pos", "_f")).select(
        *keys,
        "finding_pos",
        "_f.category",
        "_f.finding_type",
        "_f.severity",
        "_f.redacted_evidence",
    )


def public_findings() -> Column:
    """Findings without the raw evidence, for sinks."""
    return F.transform(
        "findings",
        lambda f: F.struct(
            f.category.alias("category"),
            f.finding_type.alias("finding_type"),
            f.severity.alias("severity"),
            f.redacted_evidence.alias("evidence"),
        ),
    )


def redact_responses(scanned: DataFrame) -> DataFrame:
    """Replace every occurrence of each critical finding, in order, by its type."""
    critical = F.filter(
        "findings", lambda f: (f.severity >= R.CRITICAL_SEVERITY) & (f.evidence != F.lit(""))
    )
    # A value is replaced once, however often it was found.
    values = F.array_distinct(F.transform(critical, lambda f: F.struct(f.evidence, f.finding_type)))
    redacted = F.reduce(
        values,
        F.col("content"),
        lambda text, f: F.replace(
            text, f.evidence, F.concat(F.lit("[REDACTED:"), f.finding_type, F.lit("]"))
        ),
    )
    return scanned.withColumn("content", F.when(F.col("should_redact"), redacted).otherwise(F.col("content")))


def response_summary(scanned: DataFrame, key: str = "response_id") -> DataFrame:
    """Count, level and findings of the first item of a response that has any."""
    first = F.min_by(
        F.struct(
            F.col("item_pos"),
            F.size("findings").alias("findings_count"),
            F.col("risk_level"),
            public_findings().alias("findings"),
        ),
        F.col("item_pos"),
    )
    return (
        scanned.where(F.size("findings") > 0)
        .groupBy(key)
        .agg(first.alias("_first"))
        .select(key, "_first.*")
    )
