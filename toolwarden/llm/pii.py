"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Four base kinds come from fixed patterns (email, ip, card, phone).  The random
field adds what the patterns miss: national telephone numbers without a plus
sign, cards written with dots or dashes, social security numbers, bank account
numbers, spelled-out addresses ("name at host dot com") and secrets: long mixed values behind
words such as token, key or password (the value alone is the span; hashes without such a word stay).  It is trained by
gradient ascent on the likelihood of a small labelled table (:data:`SENTENCES`,
filled with seeded digits), once per process, with the same result everywhere.

A token further than ``CONTEXT`` tokens from any hint (a digit, the word "dot", a
bracketed "at" or "dot", a dotted token after "at") is outside by construction,
so only the stretches around hints are decoded, many at once, by Viterbi in
numpy arrays.  All texts
are searched whole; rows stay in their task, so no key can be hot.

Defined results: a NULL or empty text has no spans; spans count code points,
end exclusive; an added span that touches a base span or an earlier added one is
left out; repeated rows are searched one by one; an empty table gives no rows; a
column named as a result is replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, carried, new_text, with_results

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email", "card", "phone", "ssn", "iban", "secret")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: a later start fails as the first one did.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[Span]:
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            spans.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return spans


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind, then start."""
    spans = _emails(text)
    spans += [
        ("ip", m.start(), m.end())
        for m in _IP.finditer(text)
        if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))
    ]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


# ---- the labelled table ---------------------------------------------------------------------------------

#: {kind:pattern}: a labelled span; 9 stands for a digit, § for a hexadecimal one, ¤ for a letter or a digit.
#: Unmarked digits are outside.
SENTENCES = (
    "call me at {phone:(999) 999-9999} before noon", "tel {phone:999-999-9999} or write", "phone: {phone:999.999.9999}",
    "mobile {phone:0999 9999999} today", "ring {phone:099 99 99 99 99} please", "tél {phone:09 99 99 99 99} merci",
    "telefon {phone:0999/9999999} bitte", "fax {phone:(99) 9999-9999} office", "his number is {phone:999 999 9999} now",
    "reach us on {phone:1-999-999-9999} daily", "contact {phone:(999)999-9999} today",
    "the house {phone:(999) 999-9999} was in the", "and {phone:999-999-9999}, or", "le {phone:(999) 999-9999} de la",
    "card {card:9999-9999-9999-9999} expires", "paid with {card:9999.9999.9999.9999} yesterday", "visa {card:9999-999999-99999} charged",
    "ssn {ssn:999-99-9999} on file", "social security {ssn:999-99-9999} ended", "his ssn is {ssn:999-99-9999}.", "the {ssn:999-99-9999} of and",
    "iban {iban:DE99 9999 9999 9999 9999 99} transfer", "account {iban:FR9999999999999999999999999} paid", "konto {iban:DE99999999999999999999} und",
    "to {iban:ES9999999999999999999999} de la", "iban {iban:GB99 AAAA 9999 9999 9999 99} bank", "und {iban:DE99 9999 9999 9999 9999 99} der",
    "mail {email:aaaa at aaaaaa dot com} now", "write to {email:aaaa99 at aaaaaa dot org} please", "write {email:aaa at aaaaaaa dot com} please",
    "his address is {email:aaaa at aaaa dot net} now", "by {email:aaaaaa at aaaaaaaaa dot com} or phone", "to {email:aaaa dot aaaaa at aaaaa dot com} today", "email {email:aaa [at] aaaaaa [dot] net} for",
    "mail {email:Aaaa At Aaaa Dot Com} now", "write to {email:Aaaa At Aaaaaa Dot Org} please",
    "write {email:aaaa[at]aaaa[dot]aaa} please", "mail {email:aaa(at)aaaaaa(dot)aaa} now", "to {email:aaaa[at]aaaaaa.aaa} today",
    "mail {email:aaaa at aaaa.aaa} now", "write {email:aaaa at aaaa.aaaaaaa} please", "buy it at aaaaaa.aaa today", "we met at aaaa.aaa and", "see more at aaaa.aaaaaa now",
    "in 9999 the law changed", "on 99-99-9999 we met", "on 9999-99-99 it rained", "at 99:99 the train left", "version 9.9.9 is out",
    "version 9.9 of the tool", "pages 99-999 of volume 9", "it costs 999.99 dollars", "about 99,999 people came", "see section 9.9.9 for 99 cases",
    "between 9999 and 9999 they grew", "item 99999 of 99999", "order 999999999 shipped", "the 9999-9999 season was", "score 9-9 after 99 minutes",
    "license version 9 of the", "Apache License, Version 9.9.", "GNU General Public License, version 9", "id 9999999999999 stored", "the year 9999.",
    'token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"} with', 'the token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"} and', 'der token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"} und',
    "token={secret:§§§§§§§§§§§§§§§§§§§§§§§§} in the", "token: {secret:¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤} la", 'password = {secret:"¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤"} and', "password={secret:¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤} now",
    "key {secret:AKIA¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤} found", 'key = {secret:"¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤"} de', "secret: {secret:¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤} here", 'secret = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"} le',
    'und$$$ token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"###} die###', 'les&&& token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"***} et', 'the!! token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"###} of%%%', 'que token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"!!} el',
    'les&&& token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"###} aaaa.99@aaaa9.aaaaaaa.aaa### the', 'call +9 999 999 9999 token = {secret:"§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§"} on 99.99.99.99 now',
    "sha §§§§§§§§§§§§ seen", "commit §§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§ merged", "md5 §§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§§ of the file", "file §§§§§§§§§§§§§§§§§§§§§§§§.txt removed", "room 999 on floor 9",
    "token 99 of 999", "key 9 of the list", "password has 99 letters", "secret 9 of 9",
    "99% of 999 samples", "a 9 b 99 c 999", "chapter 9, verse 99", "build 9999.99.99 failed", "port 9999 on host 99", "lat 99.9999 lon -99.9999",
    "the and of that was", "look at the dot com era", "meet at noon", "der die das und nicht", "la de que el en", "le la les des et",
)
COPIES = 6
_DRAWN = {"9": "0123456789", "§": "0123456789abcdef", "¤": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
_SLOT = re.compile(r"\{(\w+):([^}]*)\}")
LABELS = ("O", *(f"{p}-{k}" for k in ADDED_KINDS for p in "BI"))
CUES = frozenset(
    "call tel phone telefon tél fax mobile ring number contact reach card visa ssn social security iban account konto mail email write at dot "
    "com org net version section pages page order item id token password key secret commit sha md5 license in on year [at] [dot]".split()
)

_TOKEN = re.compile(r"[^\s]+")
_DIGIT, _RUN = re.compile(r"\d"), re.compile(r"(a{4}|A{5})[aA]*")
_HINT = re.compile(r"[0-9]")
#: In any case: a free-standing "dot", a bracketed "at" or "dot" also inside a token, and a dotted token after "at".
_HINT_OR_DOT = re.compile(
    r"[0-9]|(?<!\S)[\[(]?dot[\])]?(?!\S)|[\[(](?:at|dot)[\])]|(?:(?<=\sat\s)|(?<=[\[(]at[\])]\s))[\w-]+\.\w", re.I
)
_SPELLED = re.compile(r"dot|[\[(]at[\])]|\sat\s", re.I)
#: Three tokens ("name at host" before a dot), and two more that the features of these look at.
CONTEXT = 3 + 2
#: Tokens (padding included) that go through Viterbi at once.
AT_ONCE = 1 << 16
_TRAIL = ".,;:!?\"'”»"


#: Letters and digits in turn, three times.
_SWITCH = re.compile(r"(?:[a-z]+[0-9]+){3}|(?:[0-9]+[a-z]+){3}", re.I)


def _value(token: str) -> str:
    """The longest run of letters and digits behind the last sign of assignment."""
    return max(re.findall(r"[^\W_]+", re.split("[=:]", token)[-1]), key=len, default="")


def shape(token: str) -> str:
    """Digits as 9, letters as a or A; long runs of letters are cut."""
    s = _DIGIT.sub("9", token)
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in s)
    return _RUN.sub(r"\1", s)


def _names(tokens: list[str]) -> list[list[str]]:
    """The features of each token."""
    shapes = [shape(t.rstrip(_TRAIL)) for t in tokens]
    lows = [t.strip(_TRAIL).lower() for t in tokens]
    out = []
    for i, s in enumerate(shapes):
        digits = s.count("9")
        found = [f"s={s}", f"d={min(digits, 20)}", f"k={re.sub(r'(.)\1+', r'\1', s)}", "1"]
        if digits >= 2 and len(value := _value(lows[i])) >= 12 and _SWITCH.search(value):
            found.append("mixed")
            if before := lows[i].partition(value)[0].rstrip("=:" + _TRAIL):
                found.append(f"mixed={before[-12:]}")
        if lows[i] in CUES or lows[i].rstrip("=:") in CUES:
            found.append(f"w={lows[i].rstrip('=:')}")
        for step in (-2, -1, 1, 2):
            j = i + step
            near = shapes[j] if 0 <= j < len(shapes) else "#"
            if "9" in near or near == "#":
                found.append(f"{step}s={near}")
            if 0 <= j < len(shapes) and lows[j] in CUES:
                found.append(f"{step}w={lows[j]}")
        out.append(found)
    return out


def labelled_table(sentences: tuple[str, ...] = SENTENCES, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Sentences as tokens and label numbers, with digits drawn from a seed."""
    rng = np.random.default_rng(seed)

    def drawn(s: str) -> str:
        return re.sub("[9§¤]", lambda m: _DRAWN[m[0]][rng.integers(len(_DRAWN[m[0]]))], s)

    rows = []
    for _ in range(COPIES):
        for sentence in sentences:
            tokens, labels, last = [], [], 0
            pieces = [(m.start(), m.end(), m[1], m[2]) for m in _SLOT.finditer(sentence)]
            for start, end, kind, pattern in [*pieces, (len(sentence), len(sentence), "", "")]:
                outside = sentence[last:start].split()
                glued = bool(last and tokens and outside and sentence[last : last + 1].strip())
                if glued:
                    tokens[-1] += outside.pop(0)
                tokens += [drawn(t) for t in outside]
                labels += [0] * len(outside)
                for i, t in enumerate(pattern.split()):
                    tokens.append(drawn(t))
                    labels.append(LABELS.index(f"{'I' if i else 'B'}-{kind}"))
                last = end
            rows.append((tokens, labels))
    return rows


class Field:
    """Weights of the random field: ``names`` numbers the features."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i, found in enumerate(_names(tokens)):
            known = [self.names[f] for f in found if f in self.names]
            out[i] = self.emit[known].sum(axis=0)
        return out

    def decode(self, stretches: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each stretch; stretches of like length go through Viterbi together."""
        best: list[np.ndarray] = [np.zeros(0, int)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        while order:
            many = max(1, AT_ONCE // max(1, len(stretches[order[-1]])))
            part, order = order[-many:], order[:-many]
            sizes = np.array([len(stretches[i]) for i in part])
            longest = sizes.max()
            emit = np.zeros((len(part), longest, len(LABELS)))
            for row, i in enumerate(part):
                emit[row, : sizes[row]] = self.scores(stretches[i])
            value = emit[:, 0] + self.move[-1]
            back = np.zeros((len(part), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                paths = value[:, :, None] + self.move[None, :-1, :]
                back[:, t] = paths.argmax(axis=1)
                stepped = paths.max(axis=1) + emit[:, t]
                value = np.where((t < sizes)[:, None], stepped, value)
            tags = np.zeros((len(part), longest), int)
            rows = np.arange(len(part))
            now = value.argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                inside = t < sizes
                tags[:, t] = np.where(inside, now, 0)
                now = np.where(inside & (t > 0), back[rows, t, now], now)
            for row, i in enumerate(part):
                best[i] = tags[row, : sizes[row]]
        return best


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def trained(sentences: tuple[str, ...] = SENTENCES, rounds: int = 60, rate: float = 0.15, decay: float = 0.002) -> Field:
    """Forward-backward over the padded table and Adam steps on the mean log likelihood."""
    table = labelled_table(sentences)
    names: dict[str, int] = {}
    found = [_names(tokens) for tokens, _ in table]
    for f in (f for row in found for token in row for f in token):
        names.setdefault(f, len(names))
    sizes = np.array([len(tokens) for tokens, _ in table])
    n, longest, y = len(table), sizes.max(), len(LABELS)
    at = np.array([(r, t, names[f]) for r, row in enumerate(found) for t, token in enumerate(row) for f in token])
    gold = np.zeros((n, longest), int)
    for r, (_, labels) in enumerate(table):
        gold[r, : sizes[r]] = labels
    inside = np.arange(longest)[None, :] < sizes[:, None]
    emit_w, move = np.zeros((len(names), y)), np.zeros((y + 1, y))
    first, second = [np.zeros_like(emit_w), np.zeros_like(move)], [np.zeros_like(emit_w), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        emit = np.zeros((n, longest, y))
        np.add.at(emit, (at[:, 0], at[:, 1]), emit_w[at[:, 2]])
        ahead = np.zeros((n, longest, y))
        ahead[:, 0] = emit[:, 0] + move[-1]
        for t in range(1, longest):
            ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + move[None, :-1], 1) + emit[:, t]
        behind = np.zeros((n, longest, y))
        for t in range(longest - 2, -1, -1):
            new = _logsum(move[None, :-1] + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t + 1 < sizes)[:, None], new, 0.0)
        total = _logsum(ahead[np.arange(n), sizes - 1], 1)
        chance = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
        want = np.eye(y)[gold] * inside[:, :, None]
        slope = want - chance
        g_emit = np.zeros_like(emit_w)
        np.add.at(g_emit, at[:, 2], slope[at[:, 0], at[:, 1]])
        g_move = np.zeros_like(move)
        g_move[-1] = slope[:, 0].sum(axis=0)
        for t in range(1, longest):
            on = inside[:, t]
            pair = np.exp(
                ahead[on, t - 1][:, :, None] + move[None, :-1] + (emit[on, t] + behind[on, t])[:, None, :] - total[on, None, None]
            )
            g_move[:-1] += np.einsum("ni,nj->ij", want[on, t - 1], want[on, t]) - pair.sum(axis=0)
        for i, (weights, slope_w) in enumerate(((emit_w, g_emit / n), (move, g_move / n))):
            slope_w = slope_w - decay * weights
            first[i] = 0.9 * first[i] + 0.1 * slope_w
            second[i] = 0.99 * second[i] + 0.01 * slope_w**2
            weights += rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Field(names, emit_w, move)


# ---- searching texts ------------------------------------------------------------------------------------


def _stretches(text: str) -> list[list[tuple[int, int]]]:
    """Token spans around the tokens that may be personal data, ``CONTEXT`` neighbours on both sides included."""
    find = (_HINT_OR_DOT if _SPELLED.search(text) else _HINT).search
    out: list[list[tuple[int, int]]] = []
    done = 0
    hint = find(text)
    while hint:
        start = hint.start()
        for _ in range(CONTEXT + 1):  # to the start of the token, then over CONTEXT tokens
            token = start
            while token > done and not text[token - 1].isspace():
                token -= 1
            start = token
            while start > done and text[start - 1].isspace():
                start -= 1
        # Hints that share neighbours, or whose neighbours touch, are in one stretch.
        tokens, after = [], 0
        for m in _TOKEN.finditer(text, token):
            tokens.append(m.span())
            if m.end() <= hint.start():
                continue
            again = m.start() <= hint.start() or find(text, *m.span())
            after = 0 if again else after + 1
            if after == 2 * CONTEXT:
                break
        del tokens[len(tokens) - max(0, after - CONTEXT) :]
        done = tokens[-1][1]
        out.append(tokens)
        hint = find(text, done)
    return out


_VALID = {
    "email": lambda s: bool(re.search(r"\bat\b", s, re.I) and re.search(r"\bdot\b|\.", s, re.I)),
    "card": lambda s: 13 <= len(d := _DIGITS.sub("", s)) <= 19 and luhn(d),
    "phone": lambda s: 7 <= len(_DIGITS.sub("", s)) <= 15 and not re.search(r"[^\W\d_]|%|=", s),
    "ssn": lambda s: len(_DIGITS.sub("", s)) == 9,
    "secret": lambda s: len(s) >= 12 and s.isalnum() and bool(re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s)),
    "iban": lambda s: bool(re.match(r"[A-Za-z]{2}\d{2}", s)) and 14 <= len(re.sub(r"\s", "", s)) <= 34,
}


def added_spans(texts: list[str], taken: list[list[Span]], model: Field) -> list[list[Span]]:
    """For each text the spans that the random field adds to those already taken."""
    spots = [(i, s) for i, text in enumerate(texts) for s in _stretches(text)]
    tags = model.decode([[texts[i][a:b] for a, b in s] for i, s in spots])
    out: list[list[Span]] = [[] for _ in texts]
    for (i, s), labels in zip(spots, tags, strict=True):
        t = 0
        while t < len(s):
            if not labels[t]:
                t += 1
                continue
            prefix, kind = LABELS[labels[t]].split("-")
            end = t + 1
            while end < len(s) and LABELS[labels[end]] == f"I-{kind}":
                end += 1
            a, b = s[t][0], s[end - 1][1]
            while b > a and texts[i][b - 1] in _TRAIL:
                b -= 1
            if kind == "secret":  # the value alone
                value = _value(texts[i][a:b])
                a = a + texts[i][a:b].rindex(value) if value else b
                b = a + len(value)
            free = all(b <= x or a >= y for _, x, y in [*taken[i], *out[i]])
            if b > a and free and _VALID[kind](texts[i][a:b]):
                out[i].append((kind, a, b))
            t = end
    return out


def joined(spans: list[Span]) -> str:
    """``kind:start:end``, comma-joined, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping ones the union."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


#: Results per text.
FOUND = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("redacted_text", T.StringType()),
])


def _found(docs: DataFrame, text: str, redact: bool) -> tuple[DataFrame, list[str]]:
    fields = FOUND.fields if redact else FOUND.fields[:-1]

    def compute(batch: pa.RecordBatch) -> list:
        texts = [t or "" for t in batch.column("body").to_pylist()]
        base = [base_spans(t) for t in texts]
        added = added_spans(texts, base, trained())
        columns: list[list] = [[sum(s[0] == k for s in b) for b in base] for k in BASE_KINDS]
        columns.append([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
        columns.append([joined(b + a) for b, a in zip(base, added, strict=True)])
        if redact:
            columns.append([redacted(t, b + a) for t, b, a in zip(texts, base, added, strict=True)])
        return columns

    held = docs.select(*carried(docs.columns), F.col(f"`{text}`").alias("body"))
    return appended(held, T.StructType(fields), compute), [f.name for f in fields]


def find(docs: DataFrame, text: str = "text", redact: bool = True) -> DataFrame:
    """``docs`` with base counts, the digest of the base spans, all spans, and the redacted text."""
    done, results = _found(docs, text, redact)
    return done.select(*with_results(docs.columns, {n: F.col(n) for n in results}))


def redact(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts without personal data; a NULL text stays NULL."""
    done, _ = _found(docs, "text", True)
    clean = F.when(F.col("body").isNotNull(), F.col("redacted_text"))
    return done.select(*with_results(docs.columns, new_text(docs.columns, clean)))
