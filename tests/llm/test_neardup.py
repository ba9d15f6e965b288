"""Near duplicates against brute force over all pairs."""

import random
import re

import pytest

from toolwarden.llm import common as C
from toolwarden.llm import neardup as N

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)
            if linked and rows[i][0] is not None and rows[j][0] is not None:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted(
        ((d, len(s), smallest.get(root(i)), d == smallest.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([4, 30, 120, 300]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(3, 40))) for _ in range(40)]
    texts += ["", None, "  \n", "one two", "One  TWO", "É a b c d", "é a b c d"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((tuple(r) for r in N.find(docs).collect()), key=repr)


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    rows += [rows[0], rows[3], (None, rows[0][1]), (None, None)]  # repeated rows, rows without id
    assert found(spark, rows) == brute(rows)


def test_long_lists_in_blocks(spark, monkeypatch):
    """Many near copies with short limits: blocks and short lists both take part."""
    monkeypatch.setattr(N, "LONG", 3)
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus(2, groups=8)
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("shingles", [1 << 20, 900])
def test_strays_of_long_lists_and_long_texts(spark, monkeypatch, shingles):
    """Several groups of near copies around one text, some far longer than others."""
    monkeypatch.setattr(N, "LONG", 3)
    monkeypatch.setattr(N, "BLOCK", 6)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", shingles)
    rng = random.Random(11)
    base, texts = [f"w{i}" for i in range(400)], []
    for share in (0.0, 0.03, 0.06, 0.09):  # groups a little apart from each other
        center = [f"x{rng.random()}" if rng.random() < share else w for w in base]
        for _ in range(rng.choice([3, 12, 20])):
            words = list(center)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"y{rng.random()}"
            texts.append(" ".join(words))
    long = [f"z{i}" for i in range(30_000)]
    texts += [" ".join(long), " ".join(long[:-300]), " ".join(long[400:]), " ".join(long[:15_000])]
    rows = list(enumerate(texts))
    assert found(spark, rows) == brute(rows)


def test_forest_keeps_components(spark, monkeypatch):
    monkeypatch.setattr(C, "FOREST", 50)
    rng = random.Random(0)
    edges = [(rng.randint(0, 3), rng.randint(0, 300)) for _ in range(900)] + [(rng.randint(400, 900), rng.randint(400, 900)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.node: r.component for r in C.components(frame).collect()} == {n: root(n) for e in edges for n in e}
    assert C.spanning(frame).count() < len(edges)


def test_large_group_of_copies(spark):
    words = " ".join(f"v{i}" for i in range(40))
    rows = [(i, words) for i in range(3000)] + [(5000, words + " tail"), (6000, "other text altogether here now")]
    got = found(spark, rows)
    assert {g[2] for g in got} == {0, 6000} and sum(g[3] for g in got) == 2


def test_empty_and_stage(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.find(docs).collect() == []
    rows = [(3, "a b c d e f", "p"), (3, "a b c d e f", "p"), (7, "a b c d e f", "q"), (None, "a b c d e f", "n"), (9, None, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = sorted((tuple(r) for r in N.keep_one(docs).collect()), key=repr)
    assert kept == [(3, "a b c d e f", "p"), (9, None, "r"), (None, "a b c d e f", "n")]


def test_signatures_estimate_the_similarity():
    texts = [" ".join(f"t{i}" for i in range(400)), " ".join(f"t{i}" for i in range(40, 440))]
    sets = [N.Shingler().hashes(t) for t in texts]
    agree = (lambda s: (s[0] == s[1]).mean())(N.signatures(sets))
    both = len(set(sets[0].tolist()) & set(sets[1].tolist()))
    assert abs(agree - both / (len(sets[0]) + len(sets[1]) - both)) < 0.15
