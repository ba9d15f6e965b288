"""Rule tables of the catalog detectors and of the response scanner.

A rule is a regular expression plus *anchors*: groups of lower-case literals.
The lower-cased text of every match contains at least one literal of each
group.  These substring tests decide whether the expression is run at all, so a
clean text costs byte comparisons instead of a hundred regex passes.  The first
group is tested on every text and therefore shared between rules and short of
common first letters; the others are tested only behind it.
``tests/test_rules.py`` generates matches of every rule and checks its anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

Anchors = tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Rule:
    """A text rule; ``group`` is the capture that holds the evidence."""

    pattern: str
    anchors: Anchors
    ignore_case: bool = True
    group: int = 0


@dataclass(frozen=True)
class FindingRule:
    """A response rule: finding type and severity around a :class:`Rule`."""

    finding_type: str
    severity: int
    rule: Rule


def _anchors(groups: tuple[str | tuple[str, ...], ...]) -> Anchors:
    return tuple((g,) if isinstance(g, str) else g for g in groups)


def _rules(*rows: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(pattern, _anchors(groups)) for pattern, *groups in rows)


# ---------------------------------------------------------------------------
# Detection expressions, severities and thresholds.  They decide
# which texts are flagged, so they are given literally and in rule order.
# ---------------------------------------------------------------------------

PROMPT_INJECTION = _rules(
    (r"ignore\s+all\s+previous\s+instructions", "vious", "ignore"),
    (r"ignore\s+prior\s+instructions", "gnore", "prior"),
    (r"disregard\s+all\s+previous", "vious", "disregard"),
    (r"forget\s+all\s+previous", "vious", "forget"),
    (r"override\s+all\s+previous", "vious", "override"),
    (r"you\s+must\s+always\s+execute", "ways", "execute"),
    (r"you\s+are\s+now\s+a\b", "now", "you"),
    (r"you\s+are\s+no\s+longer", "you", "longer"),
    (r"system\s*prompt\s*:", "prompt", ":"),
    (r"new\s+instructions\s*:", "uctions", "new", ":"),
    (r"<system>", "<sys"),
    (r"\[INST\]", "]", "[inst]"),
    (r"\[/INST\]", "]", "[/inst]"),
    (r"<<SYS>>", "<sys", "<<sys>>"),
    (r"human:\n", ":\n", "human:"),
    (r"assistant:\n", ":\n", "assistant:"),
    (r"IMPORTANT:\s*always", "ways", "important:"),
    (r"CRITICAL:\s*you\s+must", "must", "critical:"),
    (r"do\s+not\s+tell\s+the\s+user", "user", "tell"),
    (r"hide\s+this\s+from\s+the\s+user", "user", "hide"),
    (r"\bsecretly\b", "cretly"),
    (r"without\s+the\s+user\s+knowing", "user", "knowing"),
    (r"before\s+responding\s+to\s+the\s+user", "spon", "user"),
    (r"after\s+every\s+response", "spon", "every"),
    (r"you\s+are\s+DAN\b", "you", "dan"),
    (r"Do\s+Anything\s+Now", "now", "anything"),
    (r"act\s+as\s+if\s+you\s+have\s+no\s+restrictions", "you", "restrictions"),
    (r"pretend\s+you\s+(are|have)\s+(no|unrestricted)", "you", "pretend"),
    (r"enter\s+(developer|debug|god|admin)\s+mode", "mod", "enter"),
    (r"enable\s+(developer|debug|god|admin)\s+mode", "mod", "enable"),
    (r"jailbreak", "eak", "jailbreak"),
    (r"bypass\s+(your|all|safety|content)\s+(filters?|restrictions?|guidelines?|rules?)", "pass", "bypass", ("filter", "restriction", "guideline", "rule")),
    (r"ignore\s+(your|all|safety|content)\s+(filters?|restrictions?|guidelines?|rules?)", "gnore", ("filter", "restriction", "guideline", "rule")),
    (r"from\s+now\s+on\s+you\s+(will|must|should|are)", "now", "from", "you"),
    (r"respond\s+without\s+(any\s+)?(restrictions?|filters?|limitations?)", "spon", "without"),
)

DATA_EXFILTRATION = _rules(
    (r"send\s+all\s+(data|context|conversation|history|messages?)", "ll", "send"),
    (r"forward\s+all\s+(data|context|conversation|history|messages?)", "ll", "forward"),
    (r"transmit\s+all\s+(data|context|conversation|history|messages?)", "ll", "transmit"),
    (r"post\s+all\s+data\s+to", "ll", "post"),
    (r"upload\s+all\s+data\s+to", "ll", "upload"),
    (r"\bexfiltrat", "xfiltrat"),
    (r"leak\s+the\s+(data|secrets?|keys?|tokens?|credentials?)", "eak", "leak", "the"),
    (r"include\s+all\s+(conversation|context|history)\s+in\s+the\s+(request|body|payload)", "ll", "include", "the"),
    (r"attach\s+all\s+(conversation|context|history)", "ll", "attach"),
    (r"\bwebhook\b", "bhook"),
    (r"callback\s*url", "back", "callback"),
    (r"report\s+back\s+to", "back", "report"),
    (r"phone\s+home", "phone", "home"),
    (r"!\[.*?\]\(https?://", "://", "!["),
    (r"render\s+(this|an?|the)\s+(image|img|markdown)", "render", ("image", "img", "markdown")),
    (r"display\s+(this|an?|the)\s+(image|img|markdown)", "play", ("image", "img", "markdown")),
    (r"include\s+(this|an?|the)\s+(image|img)\s+in\s+(your|the)\s+response", "spon", "include"),
    (r"\?\w*=(data|token|key|secret|session|cookie|credential|password|chat|history|context)", "?", "="),
)
EXTERNAL_URL = Rule(r"https?://[^\s\"\'>]+", (("://",),), ignore_case=False)
IMAGE_LINK = Rule(r"!\[[^\]]*\]\(https?://[^\)]+\)", (("://",), ("](http",)), ignore_case=False)

CROSS_TOOL = _rules(
    (r"(before|after)\s+(using|calling|running|executing)\s+(this|any|another)\s+tool", "tool", ("before", "after")),
    (r"(first|always)\s+(call|use|run|execute|invoke)", ("first", "ways")),
    (r"must\s+(call|use|run|execute|invoke)\s+\w+\s+(tool|function|method)", "must", ("tool", "function", "method")),
    (r"chain\s+with", "chain", "with"),
    (r"pipe\s+(output|result)\s+to", "pipe", ("output", "result")),
    (r"redirect\s+(output|result)\s+to", "redirect", ("output", "result")),
    (r"depends\s+on\s+calling", "ll", "calling", "depends"),
    (r"requires\s+(calling|executing|running)", "quires", ("calling", "executing", "running")),
    (r"trigger\s+the\s+\w+\s+(tool|function|endpoint)", "gger", "trigger"),
    (r"also\s+(call|invoke|trigger|run)", "lso", ("call", "invoke", "trigger", "run")),
)

DANGEROUS_COMMANDS = _rules(
    (r"\brm\s+-rf\b", "-rf"),
    (r"\bcurl\s+.*\|\s*sh\b", "|", "curl"),
    (r"\bwget\s+.*\|\s*sh\b", "|", "wget"),
    (r"\beval\s*\(", "(", "eval"),
    (r"\bexec\s*\(", "(", "exec"),
    (r"\bos\.system\b", ".system"),
    (r"\bsubprocess\b", "bprocess"),
    (r"\b__import__\b", "_", "__import__"),
    (r"\bchmod\s+777\b", "mod", "chmod"),
    (r"\bsudo\s+", "udo"),
    (r"\b/etc/passwd\b", "/etc/", "passwd"),
    (r"\b/etc/shadow\b", "/etc/", "shadow"),
    (r"\benv\s+var", "var", "env"),
    (r"\bAPI_KEY\b", "_", "api_key"),
    (r"\bSECRET_KEY\b", "_", "secret_key"),
    (r"\bACCESS_TOKEN\b", "_", "access_token"),
    (r"\bPASSWORD\b", "pass", "password"),
    (r"\bCREDENTIAL\b", "credential"),
)

INTERNAL_ACCESS = _rules(
    (r"169\.254\.169\.254", ".169.254"),
    (r"metadata\.google\.internal", "metadata.", "google.internal"),
    (r"metadata\.azure\.com", "metadata.", "azure.com"),
    (r"100\.100\.100\.200", ".100.200"),
    (r"https?://localhost[:/]", "://", "://localhost"),
    (r"https?://127\.0\.0\.1", "://", "://127.0.0.1"),
    (r"https?://0\.0\.0\.0", "://", "://0.0.0.0"),
    (r"https?://\[::1\]", "://", "://[::1]"),
    (r"https?://10\.\d{1,3}\.\d{1,3}\.\d{1,3}", "://", "://10."),
    (r"https?://172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}", "://", "://172."),
    (r"https?://192\.168\.\d{1,3}\.\d{1,3}", "://", "://192.168."),
    (
        r"(visit|browse|fetch|access|request|open|navigate\s+to)\s+https?://"
        r"(localhost|127\.0\.0\.1|10\.|172\.(1[6-9]|2\d|3[01])|192\.168|169\.254)",
        "://",
        ("://localhost", "://127.0.0.1", "://10.", "://172.", "://192.168", "://169.254"),
    ),
    (
        r"\b(internal|admin|management)\s+(api|endpoint|service|server|panel|console)\b",
        ("internal", "dmin", "management"),
        ("api", "endpoint", "service", "server", "panel", "console"),
    ),
    (r"/latest/meta-data", "/latest/", "meta-data"),
    (r"/latest/api/token", "/latest/", "api/token"),
    (r"\.internal(\.|\b)", "internal", ".internal"),
)

# Obfuscated payloads.
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
HEX_RUN = r"(?:0x[0-9a-fA-F]{2}\s*){4,}"
UNICODE_ESCAPE = r"\\u[0-9a-fA-F]{4}"
HTML_ENTITY = r"&#x[0-9a-fA-F]+;"
MIN_ESCAPES = 3
MIN_DECODED_CHARS = 5

# Description anomalies.
MAX_DESCRIPTION_CHARS = 2000
COMMENT_OPENER = "<!--"
NEWLINE_BLOCK = r"\n{10,}"
MAX_NAME_RATIO = 200

# Evidence samples kept per detection.
MAX_MATCH_SAMPLES = 5
MAX_URL_SAMPLES = 3
MAX_IMAGE_CHARS = 60
MAX_DECODED_CHARS = 50
MAX_LEAK_CHARS = 50

# Detector names and severities, in registry order.
DETECTOR_SEVERITY = {
    "Prompt Injection": 85,
    "Data Exfiltration": 90,
    "Cross-Tool Manipulation": 75,
    "Invisible Characters": 80,
    "Obfuscated Payloads": 70,
    "Description Anomalies": 45,
    "Dangerous Commands": 80,
    "SSRF / Internal Access": 85,
}
URL_ONLY_SEVERITY = 60
SEMANTIC = "Semantic Analysis"

# Scoring.
BLOCK_THRESHOLD = 51
WARN_THRESHOLD = 26
SCORE_LEVELS = ((76, "dangerous"), (51, "risky"), (26, "suspicious"))
SCORE_DECAY = 0.3
MAX_SCORE = 100
SCORE_BUCKETS = (25, 50, 75, 100)


def _finding(
    finding_type: str,
    pattern: str,
    severity: int,
    anchors: tuple[str | tuple[str, ...], ...],
    ignore_case: bool = False,
    group: int = 0,
) -> FindingRule:
    return FindingRule(finding_type, severity, Rule(pattern, _anchors(anchors), ignore_case, group))


# Response rules: type, expression, severity, anchors, ignore case, evidence group.
SECRETS = (
    _finding("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", 95, ("akia",)),
    _finding(
        "aws_secret_key",
        r"aws[_\-\s]*secret[_\-\s]*(?:access)?[_\-\s]*key\s*[=:]\s*['\"]?([A-Za-z0-9/+=]{40})",
        95, ("secret", "aws", "key"), True, 1,
    ),
    _finding("openai_api_key", r"\bsk-[A-Za-z0-9]{20,}\b", 90, ("sk-",)),
    _finding("github_token", r"\bghp_[A-Za-z0-9]{36}\b", 90, ("_", "ghp_")),
    _finding("github_oauth", r"\bgho_[A-Za-z0-9]{36}\b", 90, ("_", "gho_")),
    _finding("github_pat", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", 90, ("_", "github_pat_")),
    _finding("anthropic_api_key", r"\bsk-ant-[A-Za-z0-9\-]{20,}\b", 90, ("sk-ant-",)),
    _finding("stripe_key", r"\b[sr]k_(live|test)_[A-Za-z0-9]{20,}\b", 90, ("_", ("k_live_", "k_test_"))),
    _finding(
        "private_key",
        r"-----BEGIN\s+(RSA|EC|DSA|OPENSSH|PGP)?\s*PRIVATE\s+KEY-----",
        95, ("-----begin",),
    ),
    _finding(
        "generic_api_key",
        r"(?:api[_\-\s]*key|apikey|api_secret|access_token|auth_token|secret_key)"
        r"\s*[=:]\s*['\"]?([A-Za-z0-9\-_]{20,})",
        75, (("key", "api_secret", "_token"), ("=", ":")), True, 1,
    ),
    _finding(
        "password_in_text",
        r"(?:password|passwd|pwd)\s*[=:]\s*['\"]?([^\s'\"]{8,})",
        80, (("passw", "pwd"), ("=", ":")), True, 1,
    ),
    _finding("bearer_token", r"bearer\s+[A-Za-z0-9\-_\.]{20,}", 85, ("bearer",), True),
    _finding(
        "jwt_token",
        r"\beyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\b",
        85, (".eyj",),
    ),
    _finding("slack_token", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}", 90, ("xox",)),
    _finding(
        "connection_string",
        r"(?:mongodb|postgres|mysql|redis|amqp)://[^\s]{10,}",
        85, ("://", ("mongodb", "postgres", "mysql", "redis", "amqp")), True,
    ),
)

PERSONAL_DATA = (
    _finding("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 60, ("@",)),
    _finding(
        "phone_us",
        r"\b(?:\+1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
        50, (),
    ),
    _finding("phone_intl", r"\b\+[0-9]{1,3}[-.\s]?[0-9]{6,14}\b", 50, ("+",)),
    _finding("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 90, ("-",)),
    _finding(
        "credit_card",
        r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
        90, (),
    ),
    _finding(
        "ip_address",
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
        40, (".",),
    ),
    _finding("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,18})?\b", 70, ()),
)

DATA_LEAKS = (
    _finding("large_base64", r"[A-Za-z0-9+/]{100,}={0,2}", 60, ()),
    _finding(
        "embedded_url",
        r"https?://(?!(?:example\.com|localhost))[^\s\"'<>]{15,}",
        40, ("://",),
    ),
)
JSON_DUMP = "large_json_dump"
JSON_DUMP_SEVERITY = 55
JSON_DUMP_MIN_CHARS = 5000
CARD_MIN_DIGITS = 13

CRITICAL_SEVERITY = 80
WARNING_SEVERITY = 50
MASK_KEEP_CHARS = 4

# Semantic verdicts.
CONFIDENCE_THRESHOLD = 70
VERDICT_CAPACITY = 256

# Metrics.
DURATION_SAMPLES = 1000
