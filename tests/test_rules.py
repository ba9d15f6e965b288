"""Anchors: every match of a rule contains its anchors."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from toolwarden import rules as R

RULES = [
    *R.PROMPT_INJECTION, *R.DATA_EXFILTRATION, R.EXTERNAL_URL, R.IMAGE_LINK, *R.CROSS_TOOL,
    *R.DANGEROUS_COMMANDS, *R.INTERNAL_ACCESS,
    *[f.rule for f in (*R.SECRETS, *R.PERSONAL_DATA, *R.DATA_LEAKS)],
]


def fold(text):
    return text.translate(str.maketrans("ſıİK", "siik")).lower()


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.pattern[:40])
def test_matches_contain_anchors(rule):
    flags = re.IGNORECASE if rule.ignore_case else 0
    compiled = re.compile(rule.pattern, flags)

    # Word bounds are left out of the generator: it cannot aim at them.
    texts = st.from_regex(re.compile(rule.pattern.replace(r"\b", ""), flags))

    @settings(max_examples=25)
    @given(st.data())
    def check(data):
        found = compiled.search("x" + data.draw(texts) + " ")
        if found:
            low = fold(found.group(0))
            assert all(any(a in low for a in group) for group in rule.anchors), low

    check()


def test_anchors_are_lower_case():
    for rule in RULES:
        for group in rule.anchors:
            assert group and all(a == a.lower() and a for a in group)


def test_rule_counts():
    assert [len(x) for x in (R.PROMPT_INJECTION, R.DATA_EXFILTRATION, R.CROSS_TOOL)] == [35, 18, 10]
    assert [len(x) for x in (R.DANGEROUS_COMMANDS, R.INTERNAL_ACCESS)] == [18, 16]
    assert [len(x) for x in (R.SECRETS, R.PERSONAL_DATA, R.DATA_LEAKS)] == [15, 7, 2]
