"""Personal data: base spans against the plain patterns, the random field on held-out sentences, edge rows."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from toolwarden.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return spans


@given(st.text(alphabet="ab0149.@-_+ ()é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize(
    "text",
    ["a@b.c_d@e.f", "x@y@z.org", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111 1111-1111 1111", "+1 (319) 555-5132+44 20 7946 0958", "0" * 4000 + ".0.0.0"],
)
def test_base_cases(text):
    assert pii.base_spans(text) == plain(text)


def test_field_on_unseen_sentences():
    texts = [
        "you may dial (212) 555-0187 at any time",
        "her ssn 219-09-9999 was stolen",
        "pay to iban DE44 5001 0517 5407 3249 31 soon",
        "we met on 12-11-2019 at 10:30 and paid 1,200.50 for version 3.1.4",
        "pages 12-18 of volume 3, chapter 9, in 1987",
    ]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, pii.trained())
    found = [[(k, t[a:b]) for k, a, b in spans] for t, spans in zip(texts, added)]
    assert found == [[("phone", "(212) 555-0187")], [("ssn", "219-09-9999")], [("iban", "DE44 5001 0517 5407 3249 31")], [], []]


def found(text):
    base = pii.base_spans(text)
    return [(k, text[a:b]) for k, a, b in pii.added_spans([text], [base], pii.trained())[0]]


@pytest.mark.parametrize("between", ["", "please ", "please do ", "please do now ", "please do now and "])
@pytest.mark.parametrize("number", ["12:", "in 1987", "page 4,"])
def test_a_number_before_a_spelled_out_address(number, between):
    text = f"Room {number} {between}write jane at corp dot com now"
    assert found(text) == [("email", "jane at corp dot com")]
    assert pii.redacted(text, pii.added_spans([text], [[]], pii.trained())[0]).endswith("write [EMAIL] now")


@given(st.lists(st.sampled_from(["7", "a", "dot"]), max_size=40))
def test_stretches_hold_all_neighbours(words):
    """Every token near a hint is in exactly one stretch, the others in none."""
    hints = [i for i, w in enumerate(words) if w != "a"]
    near = [i for i in range(len(words)) if any(abs(i - h) <= pii.CONTEXT for h in hints)]
    starts = [sum(len(w) + 1 for w in words[:i]) for i in near]
    stretches = pii._stretches(" ".join(words))
    assert [a for s in stretches for a, _ in s] == starts
    where = {a: n for n, s in enumerate(stretches) for a, _ in s}
    for i, start in zip(near, starts):
        assert i - 1 not in near or where[start] == where[starts[near.index(i - 1)]]


@pytest.mark.parametrize(
    "address",
    ["Jane At Corp Dot Com", "JANE AT CORP DOT COM", "jane[at]corp[dot]com", "jane(at)corp(dot)org", "jane at corp.example", "jane [AT] corp [Dot] net"],
)
def test_spelled_out_addresses_in_other_forms(address):
    assert found(f"you may mail {address} now") == [("email", address)]
    assert found("the dot product of a and b") == found("they met at noon. Then") == found("look at example.com for more") == []


def test_held_out_accuracy_of_the_field():
    """Trained without every fifth sentence, the field labels most tokens of these as they are."""
    held = pii.SENTENCES[::5]
    model = pii.trained(tuple(x for i, x in enumerate(pii.SENTENCES) if i % 5))
    rows = pii.labelled_table(held, seed=99)
    tags = model.decode([tokens for tokens, _ in rows])
    right = sum(int((t == labels).sum()) for t, (_, labels) in zip(tags, rows))
    assert right / sum(len(labels) for _, labels in rows) > 0.85
    again = pii.labelled_table(seed=99)
    tags = pii.trained().decode([tokens for tokens, _ in again])
    assert sum((t == labels).all() for t, (_, labels) in zip(tags, again)) / len(again) > 0.97


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "mail a@b.org", "c"), (3, "mail a@b.org", "c"), (None, "1.2.3.4 " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "spans")) for r in pii.find(docs).collect()), key=repr)
    assert [g[:3] for g in got] == [(1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (None, 0, 20000)]
    assert got[2][3] == "email:5:12"
    assert pii.find(docs.limit(0)).collect() == []
    kept = pii.redact(docs.select("doc_id", "text")).where("doc_id = 3").first()
    assert kept["text"] == "mail [EMAIL]"


def test_long_digit_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + "@") == []
    assert pii.added_spans(["12 " * 30_000], [[]], pii.trained()) is not None


SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.mark.parametrize(
    "before, after",
    [('token = "', '" with'), ('and token = "', '"### nicht### ene'), ('TOKEN = "', '"!! THE'), ("token=", " now"), ('the token: "', '", then'), ("secret: ", " here")],
)
def test_secrets_by_their_context(before, after):
    text = f"some words {before}{SECRET}{after} and others"
    assert found(text) == [("secret", SECRET)]
    assert SECRET not in pii.redacted(text, pii.added_spans([text], [[]], pii.trained())[0])


@pytest.mark.parametrize("text", [f"commit {SECRET} merged", f"sha {SECRET} seen", "token 12 of 400", "the key 7 of the list", "a password has 12 letters"])
def test_hashes_and_plain_words_are_no_secrets(text):
    assert found(text) == []


def test_decode_against_all_label_sequences():
    """Viterbi finds the best of all sequences of labels, counted out one by one."""
    import itertools

    import numpy as np

    rng, n = np.random.default_rng(3), len(pii.LABELS)
    model = pii.trained()
    for tokens in (["a"], ["call", "99", "now"], ["token", "=", f'"{SECRET}"']):
        emit = model.scores(tokens)
        few = sorted(rng.choice(np.arange(1, n), 4, replace=False).tolist() + [0])  # labels of the count
        labels = model.decode([tokens])[0].tolist()
        few = sorted({*few, *labels})

        def total(path):
            return sum(emit[i, k] for i, k in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(few, repeat=len(tokens)), key=total)
        assert list(best) == labels and total(best) >= max(total((k,) * len(tokens)) for k in range(n))


def test_the_field_adds_spans_on_the_given_documents(spark):
    """Every planted secret of the table is found by the field, and documents without digits are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    planted = [(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)]
    assert planted and all(f"secret:{a}:{b}" in spans[i].split(",") for i, a, b in planted)
    assert all(not spans[i] for i, t in texts.items() if not re.search("[0-9@]", t))
