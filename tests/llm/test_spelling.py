"""Spelling variants against comparisons of all pairs and a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from toolwarden.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [(-counts[v], v) for v in counts if one_edit(w, v)]
        best = min(near) if near and -min(near)[0] >= 2 * n else None
        out[w] = [best[1] if best else None, None, n, len(near), -best[0] if best else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def vocabulary(rng, size, letters="abé", longest=12):
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(size)}
    for w in list(words):
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:]} - {""}
    return sorted(words)


def test_scan_equals_all_pairs():
    rng = random.Random(2)
    for letters in ("ab", "abcdefgé", "a"):
        words = vocabulary(rng, 150, letters)
        found = S.scan(S.Sorted(words), words)
        got = sorted((words[q], words[w]) for q, w in zip(*found))
        want = sorted(
            (a, b) for a in words for b in words
            if one_edit(a, b) and len(b) in (len(a), len(a) + 1) and a[: len(a) // 2] == b[: len(a) // 2]
        )
        assert got == want


def test_blocks_reached():
    rng = random.Random(4)
    words = vocabulary(rng, 400, "abc")
    for size in (1, 3, 20):
        cut = [words[i : i + size] for i in range(0, len(words), size)]
        blocks = S.Blocks([(i, c[0], c[-1]) for i, c in enumerate(cut)])
        where = {w: i for i, c in enumerate(cut) for w in c}
        for a in words:
            reached = blocks.reached(a)
            assert len(reached) == len(set(reached))
            for b in words:
                if one_edit(a, b) and len(b) >= len(a) and a[: len(a) // 2] == b[: len(a) // 2]:
                    assert where[b] in reached
    # A prefix that all words share does not send each word to each block.
    hot = sorted({"prefix" + "".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)})
    cut = [hot[i : i + 20] for i in range(0, len(hot), 20)]
    blocks = S.Blocks([(i, c[0], c[-1]) for i, c in enumerate(cut)])
    assert sum(len(blocks.reached(w)) for w in hot) / len(hot) < 60 < len(cut)


def test_joined_checksum():
    rng = random.Random(0)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.randint(0, 40))
        import numpy as np

        table = S.joined_crc32(np.array([zlib.crc32(a)]), 40)
        assert int(table[len(b), 0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [400_000, 60])
def test_variants(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    counts = {w: rng.choice([3, 3, 4, 6, 8, 12, 24, 50]) for w in vocabulary(rng, 120, "abçd", 9)}
    counts |= {"x" * 90: 9, "x" * 91: 3, "y" * 5000: 4, "y" * 4999 + "z": 8, "a" * 40: 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in S.variants(frame).collect()}
    assert got == plain_variants(counts)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 200)
    monkeypatch.setattr(S, "HELD", 50)
    rng = random.Random(8)
    words = vocabulary(rng, 60, "Abcéß×", 8) + ["zebra" * 80, "q" * 300]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)) + ["1st", "don't", "naïveāx"])) for i in range(150)]
    docs += [(None, "Zebra zebra ZEBRA"), (7, None), (8, ""), (9, " ".join(words * 20)), docs[3], docs[3]]
    frame = spark.createDataFrame([(d, t, "w") for d, t in docs], "doc_id long, text string, word string").repartition(2)
    want = plain_counts(docs)
    assert {r.word: r.n for r in S.word_counts(frame).collect()} == want and len(want) > 50


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n long")
    assert S.variants(S.word_counts(none)).collect() == []
    one = spark.createDataFrame([(1, "single single single")], "doc_id long, text string")
    assert [tuple(r) for r in S.variants(S.word_counts(one)).collect()] == [("single", None, "single", 3, 0, None)]
