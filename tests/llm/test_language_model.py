"""The language model against a plain count, a step-by-step network and finite differences."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from toolwarden.llm import language_model as L


def plain_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def is_held_out(doc):
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5 == 1


def plain_base(docs):
    counts = Counter(t for d, text in docs if not is_held_out(d) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {
        (d, text): (
            is_held_out(d), len(plain_tokens(text)), sum(counts[t] > 0 for t in plain_tokens(text)), n,
            sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in plain_tokens(text)),
        )
        for d, text in docs
    }


def two_languages(rng, n):
    """Each text is in one of two made-up languages; a tenth of the words occur once."""
    docs = []
    for i in range(n):
        lang = rng.choice(["a", "o"])
        words = [f"{lang}{rng.randint(0, 40)}{lang}" if rng.random() < 0.9 else f"{lang}x{rng.randint(0, 10**9)}{lang}{lang}" for _ in range(rng.randint(0, 90))]
        docs.append((i, rng.choice([" ", "\n", "  ", "  "]).join(words).replace("a1", "A1")))
    return docs


@pytest.mark.parametrize("known", [131_072, 12, 0])
def test_counts_and_likelihood(spark, monkeypatch, known):
    monkeypatch.setattr(L, "KNOWN", known)
    monkeypatch.setattr(L, "CHUNK", 3000)
    docs = two_languages(random.Random(known), 400)
    docs += [(None, "a1a of"), (1001, None), (1002, ""), (1006, " \t\n"), (1003, "étÉ " * 5), docs[5], docs[5], (1004, "w" * 100 + " a1a"), (1005, "a2a o2o " * 4000)]
    frame = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    got = L.score(frame).collect()
    want = plain_base(docs)
    assert len(got) == len(docs)
    by_doc = {}
    for d, t in docs:
        by_doc.setdefault(d, (d, t))
    for r in got:
        w = want[by_doc[r.doc_id]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    unseen = [r for r in got if r.held_out and r.n_tokens > 20]
    gain = sum(r.score - r.base_score for r in unseen) / sum(r.n_tokens for r in unseen)
    if known:
        assert gain > 0.05  # which of two languages a text is in is worth up to 0.3 a token


def small(monkeypatch, words=30, classes=4):
    for name, value in dict(MODELLED=words, CLASSES=classes, ENDINGS=3, HIDDEN=5, LANES=3, STEPS=4, SCORE_LANES=2, SEGMENT=11).items():
        monkeypatch.setattr(L, name, value)
    H = 5
    monkeypatch.setattr(L, "SHAPES", {
        "inputs": (words + 3, 3 * H), "gates": (H, 2 * H), "memory": (H, H), "classes": (H, classes + 3),
        "class_bias": (classes + 3,), "outputs": (words, H), "output_bias": (words,),
    })
    monkeypatch.setattr(L, "NUMBERS", sum(math.prod(s) for s in L.SHAPES.values()))
    monkeypatch.setattr(L, "ROWS", sum(s[0] for s in L.SHAPES.values()))
    rng = np.random.default_rng(0)
    layout = L.laid_out(rng.random(words) * 50)
    return L.Network(rng.standard_normal(L.NUMBERS) * 0.4, layout)


def step_by_step(network, doc):
    """The log-likelihood of each token from whole distributions, one step at a time."""
    w, lay, H = network.w, network.layout, L.HIDDEN
    state, before, logs = np.zeros(H), 0, []
    for token in doc:
        x = w["inputs"][before]
        gates = 1 / (1 + np.exp(-(x[: 2 * H] + state @ w["gates"])))
        new = np.tanh(x[2 * H :] + (gates[H:] * state) @ w["memory"])
        state = (1 - gates[:H]) * new + gates[:H] * state
        classes = np.exp(state @ w["classes"] + w["class_bias"])
        classes /= classes.sum()
        everything = np.zeros(L.MODELLED + L.ENDINGS)
        for c in range(L.CLASSES):
            members = [i for i in range(L.MODELLED) if lay.kind[i] == c]
            inner = np.exp([w["outputs"][lay.place[i]] @ state + w["output_bias"][lay.place[i]] for i in members])
            everything[members] = classes[c] * inner / inner.sum()
        everything[L.MODELLED :] = classes[L.CLASSES :]
        assert everything.sum() == pytest.approx(1)
        logs.append(math.log(everything[token]))
        before = token
    return logs


def documents(seed):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, L.MODELLED + L.ENDINGS, n), 0).astype("<u2") for n in (0, 3, 17, 1, 40, 8, 8)]


def test_state_is_carried_through_whole_documents(monkeypatch):
    network = small(monkeypatch)
    docs = documents(1)
    want = [sum(step_by_step(network, d.tolist())) for d in docs]
    assert network.score(docs) == pytest.approx(want, rel=1e-4)


def test_gradients(monkeypatch):
    network = small(monkeypatch)
    lanes = L.Lanes(documents(2), 3)
    t1 = min(12, len(lanes.target))

    def value(net):
        states, _, _ = net.steps(lanes, 0, t1, np.zeros((3, L.HIDDEN)), False)
        real = (np.arange(t1)[:, None] < lanes.lengths[None, :]).ravel()
        return net.logs(states.astype(np.float64).reshape(-1, L.HIDDEN)[real], lanes.target[:t1].ravel()[real])[0].sum()

    grads = {k: np.zeros_like(v) for k, v in network.w.items() if k != "inputs"}
    _, (rows, by_row), _, _ = network.gradients(lanes, 0, t1, np.zeros((3, L.HIDDEN)), grads)
    whole = np.zeros_like(network.w["inputs"])
    whole[rows] = by_row
    flat = np.concatenate([whole.ravel(), *[grads[k].ravel() for k in L.SHAPES if k != "inputs"]])
    rng = random.Random(0)
    for i in [*rng.sample(range(L.NUMBERS), 60), *range(L.NUMBERS - 20, L.NUMBERS)]:
        moved = []
        for step in (0.01, -0.01):
            shifted = network.flat.copy()
            shifted[i] += step
            moved.append(value(L.Network(shifted, network.layout)))
        assert flat[i] == pytest.approx((moved[0] - moved[1]) / 0.02, rel=0.03, abs=0.01)


def test_training_learns(monkeypatch):
    network = small(monkeypatch)
    docs = [np.array([*[1 + (i + k) % 7 for i in range(20)], 0], "<u2") for k in range(7)] * 6
    squares = np.zeros(L.ROWS)
    first = network.train(docs, squares)[0]
    for _ in range(20):
        last = network.train(docs, squares)[0]
    assert last > 0.6 * first  # both are negative


def test_words_are_cut_as_stated():
    parents, coded = L.tokens(pa.array(["A\x1cb c\x0bD", None, "", "\x85x \x1f"]))
    assert list(zip(parents.tolist(), coded.to_pylist())) == [(0, "a\x1cb c"), (0, "d"), (3, "\x85x"), (3, "\x1f")]


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(none).count() == 0
    alone = next(d for d in range(100) if is_held_out(d))
    r = L.score(spark.createDataFrame([(alone, "never seen")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
