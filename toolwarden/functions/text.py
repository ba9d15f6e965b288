"""Text matching on Column expressions: anchored find-all, quoting, masking."""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolwarden.rules import Rule

#: Unicode classes for \d, and "." that stops at newlines only.
CASE_SENSITIVE = "(?Ud)"
IGNORE_CASE = "(?iUd)"

# Letters outside ASCII that match an ASCII letter when case is ignored:
# long s, dotless i, dotted capital I, Kelvin sign.
_FOLDING_LETTERS = "ſıİ\u212a"
_FOLDED_TO = "siik"


# What Python takes for white space and word characters, which is more and less than the JVM does:
# the four separators count as space, joiners and combining marks do not count as letters.
_SPACE = r"\s\x1C-\x1F"
_WORD = r"\p{L}\p{N}_"
_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_PLAIN = {"s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "w": f"[{_WORD}]", "W": f"[^{_WORD}]", "b": _BOUNDARY}
_IN_CLASS = {"s": _SPACE, "w": _WORD}


def jvm_dialect(pattern: str) -> str:
    """The same matches with the JVM's engine: its shorthand classes are spelled out."""
    out, inside = [], False
    tokens = re.findall(r"\\.|.", pattern, re.DOTALL)
    for token, *after in zip(tokens, [*tokens[1:], ""], [*tokens[2:], "", ""]):
        if token == "\\b" and not inside and re.fullmatch("[A-Za-z_]", after[0]) and after[1] not in set("?*{"):
            # In front of a letter only the sign before it counts, and only where the letter stands.
            out.append(f"(?={after[0]})(?<![{_WORD}])")
            continue
        if token[0] == "\\":
            out.append((_IN_CLASS if inside else _PLAIN).get(token[1], token))
            continue
        if token in "[]":
            inside = token == "["
        out.append(token)
    return "".join(out)


def spark_regex(rule: Rule) -> str:
    """The rule's expression in the dialect of the JVM."""
    return (IGNORE_CASE if rule.ignore_case else CASE_SENSITIVE) + jvm_dialect(rule.pattern)


def code_point_ranges(test: Callable[[str], bool], low: int = 0) -> list[tuple[int, int]]:
    """The code points that pass the test, as ranges; surrogates never do."""
    ranges: list[tuple[int, int]] = []
    for point in range(low, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or not test(chr(point)):
            continue
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1] = (ranges[-1][0], point)
        else:
            ranges.append((point, point))
    return ranges


def _class_body(ranges: Iterable[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" if a < b else rf"\x{{{a:X}}}" for a, b in ranges)


#: Ranges that one plain class may list: the JVM tests them one inside the other, all of them for most characters.
_PLAIN_RANGES = 8


def range_class(ranges: list[tuple[int, int]]) -> str:
    """A class of many ranges that the JVM tests in few steps: a search tree of halves, each
    entered only by the characters within its span."""
    if len(ranges) <= _PLAIN_RANGES:
        return f"[{_class_body(ranges)}]"
    middle = len(ranges) // 2
    halves = (ranges[:middle], ranges[middle:])
    return "[" + "".join(f"[{_class_body([(h[0][0], h[-1][1])])}&&{range_class(h)}]" for h in halves) + "]"


@lru_cache(maxsize=1)
def hidden_ranges() -> list[tuple[int, int]]:
    """Format, private-use and unassigned code points above ASCII, by Python's tables."""
    return code_point_ranges(lambda c: unicodedata.category(c) in ("Cf", "Co", "Cn"), 0x80)


@lru_cache(maxsize=1)
def hidden_class() -> str:
    """The class of the hidden characters."""
    return range_class(hidden_ranges())


def is_ascii(text: Column) -> Column:
    """Has the text as many bytes as characters?"""
    return F.octet_length(text) == F.length(text)


#: Up to here letters are European ones, which most texts beyond ASCII have.
_LATIN_END = 0x24F


def has_hidden(text: Column) -> Column:
    """Is there a hidden character?  ASCII texts have none, and texts of European letters are told by
    one comparison a character; only the others are searched by the whole class."""
    near = [chr(c) for a, b in hidden_ranges() for c in range(a, b + 1) if c <= _LATIN_END]
    far = min(max(a, _LATIN_END + 1) for a, b in hidden_ranges() if b > _LATIN_END)
    some = any_of([F.contains(text, F.lit(c)) for c in near]) | F.rlike(text, F.lit(rf"[^\x00-\x{{{far - 1:X}}}]"))
    return ~is_ascii(text) & some & F.rlike(text, F.lit(hidden_class()))


@lru_cache(maxsize=1)
def unprintable_class() -> str:
    """What ``str.isprintable`` says no to."""
    return range_class(code_point_ranges(lambda c: not c.isprintable()))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def any_of(conditions: list[Column]) -> Column:
    """True if one of them is; a balanced tree, so that any number of them can be planned."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = zip(conditions[::2], conditions[1::2])
        conditions = [a | b for a, b in pairs] + conditions[len(conditions) - len(conditions) % 2 :]
    return conditions[0]


def folded(text: Column) -> Column:
    """Lower-cased text in which every case-insensitive match is plain ASCII."""
    unusual = ~is_ascii(text) & any_of([F.contains(text, F.lit(c)) for c in _FOLDING_LETTERS])
    return F.lower(
        F.when(unusual, F.translate(text, _FOLDING_LETTERS, _FOLDED_TO)).otherwise(text)
    )


def sql_text(value: str) -> str:
    """A string literal for SQL expressions."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Anchored:
    """Find-all of a set of rules over one text column.

    The first anchor group of every rule becomes boolean columns that the rules
    share (:meth:`flags`); the text must have been :func:`folded` to ``low``.
    Rule families are written as one SQL expression each: building them call by
    call would cost the driver more time than a small job takes.
    """

    def __init__(self, text: str, low: str, rules: Iterable[Rule]):
        self.text, self.low = F.col(text), F.col(low)
        self._text, self._low = text, low
        literals = dict.fromkeys(a for r in rules for a in (r.anchors[0] if r.anchors else ()))
        self._flag = {literal: f"{low}_{i}" for i, literal in enumerate(literals)}

    def flags(self) -> dict[str, Column]:
        """The shared boolean columns, by name."""
        return {name: F.expr(self._contains(literal)) for literal, name in self._flag.items()}

    def _contains(self, literal: str) -> str:
        return f"contains({self._low}, {sql_text(literal)})"

    def _may_match(self, rule: Rule) -> str:
        first = [self._flag[a] for a in rule.anchors[0]]
        rest = [[self._contains(a) for a in group] for group in rule.anchors[1:]]
        return " AND ".join(f"({' OR '.join(tests)})" for tests in (first, *rest))

    def _find_all(self, rule: Rule) -> str:
        pattern = sql_text(spark_regex(rule))
        found = f"regexp_extract_all({self._text}, {pattern}, {rule.group})"
        if not rule.anchors:
            return found
        nothing = "CAST(array() AS ARRAY<STRING>)"
        return f"CASE WHEN {self._may_match(rule)} THEN {found} ELSE {nothing} END"

    def any_rule(self, rules: Iterable[Rule]) -> Column:
        """Does a rule of a family match?  Stops at the first one."""
        tests = []
        for rule in rules:
            found = f"rlike({self._text}, {sql_text(spark_regex(rule))})"
            tests.append(f"({self._may_match(rule)} AND {found})" if rule.anchors else found)
        return F.expr(f"coalesce({' OR '.join(tests)}, false)")

    def find_all(self, rule: Rule) -> Column:
        """All matches of one rule, left to right."""
        return F.expr(self._find_all(rule))

    def find_all_rules(self, rules: Iterable[Rule]) -> Column:
        """Matches of a rule family: rule order first, then position."""
        return F.expr(f"flatten(array({', '.join(self._find_all(r) for r in rules)}))")


def mask(value: Column, keep: int) -> Column:
    """Keep the first characters, star the rest; short values are starred whole."""
    size = F.length(value)
    return F.when(size <= keep + 4, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.left(value, F.lit(keep)), F.repeat(F.lit("*"), size - keep))
    )


# Letters and digits one by one: the JVM looks single characters up in one table, but tests ranges
# one after the other.
_ALNUM = string.ascii_letters + string.digits


def has_base64_run(text: Column, size: int) -> Column:
    """Is there a run of at least ``size`` base64 letters?

    Shorter runs are passed one after the other, so every character is tested once."""
    run = rf"[{_ALNUM}+/]"
    shorter = rf"(?:{run}{{0,{size - 1}}}+[^{_ALNUM}+/])*+"
    return F.rlike(text, F.lit(rf"\A{shorter}{run}{{{size}}}+"))


def decoded_base64(run: Column) -> Column:
    """UTF-8 text of a base64 run with invalid bytes dropped; NULL if it is not
    decodable.  A run decodes when its body fills whole quads, or leaves two
    characters padded with two ``=``, or three padded with at least one."""
    body = F.rtrim(run, F.lit("="))
    rest = F.length(body) % 4
    pads = F.length(run) - F.length(body)
    padded = (
        F.when(rest == 0, body)
        .when((rest == 2) & (pads == 2), F.concat(body, F.lit("==")))
        .when((rest == 3) & (pads >= 1), F.concat(body, F.lit("=")))
    )
    text = F.make_valid_utf8(F.unbase64(padded).cast("string"))
    return F.replace(text, F.lit("�"), F.lit(""))


def is_printable(text: Column) -> Column:
    """No control, format, private, unassigned or separator character but space."""
    return ~F.rlike(text, F.lit(unprintable_class()))
