"""Encoding, length histogram and packing against the tokenizer libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from toolwarden.llm import bpe, lengths, packing, tokens

RANKS = "byte_bpe_50k.tiktoken"
TEXTS = [
    "Hello world, it's 12:30!", "", None, " leading", "trailing ", "two  spaces", "tabs\tand\nlines \n mixed", "naïve café 日本語 👩‍🔬", "x" * 3000,
    "a \x1c b", "\x00a b \x00a", "a\x00 b", "  ", "\n", "I'LL we've don't", "<|endoftext|> text", "1²½٣", "é", "é x", "ΑΣ ΣΑΣ.", "İstanbul",
    "word " * 5000, "the same text twice", "the same text twice",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_byte_bpe_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 4000)
    path = tokens.public(RANKS)
    encoder = tokens.byte_bpe(path)
    got = {r.doc_id: r for r in bpe.digests(docs(spark), path).collect()}
    for i, text in enumerate(TEXTS):
        ids = encoder.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest(), text
    coded = bpe.encode(docs(spark), path)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(coded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digests(docs(spark).limit(0), path).collect() == []


def test_positions_of_a_block_are_not_shuffled(spark, monkeypatch):
    """The written positions are read where the ids arrive; blocks without a word keep their documents."""
    monkeypatch.setattr(bpe, "BLOCK", 1)
    path = tokens.public(RANKS)
    before = {t.name for t in spark.catalog.listTables()}
    found = bpe.digests(docs(spark, ["a b", "", None, "b"]), path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = "".join(line for line in plan.splitlines() if line.lstrip().startswith(":"))
    assert "Bucketed: true" in left and "Exchange" not in left
    nothing = hashlib.sha256(b"").hexdigest()
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in found.collect()}
    assert got[1] == got[2] == (0, nothing)
    assert [got[i][1] for i in (0, 3)] == [hashlib.sha256(t).hexdigest() for t in (b"a b", b"b")]
    assert {t.name for t in spark.catalog.listTables()} == before


@given(st.lists(st.text(st.sampled_from("ab ,'s1\n\t é²!"), max_size=30), max_size=8))
def test_blocks_cut_texts_like_the_pattern(texts):
    import public_tokenizers
    import regex

    block = bpe.Block(public_tokenizers.PATTERN)
    for i, t in enumerate(texts):
        block.add(i, t)
    if not texts:
        return
    rows = list(block.rows(0, 3))
    words = {}
    for row in rows[1:]:
        words.update(zip(bpe.unpacked(row["numbers"]).tolist(), bpe.unpacked_words(row["payload"])))
    numbers = np.split(bpe.unpacked(rows[0]["payload"]), np.cumsum(rows[0]["counts"])[:-1])
    got = [[words[i].decode() for i in own] for own in numbers]
    assert got == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


@given(st.lists(st.text(st.sampled_from("abZÉß ,.'s1\n\t é²!Σσ日<|"), max_size=30), min_size=1, max_size=8))
def test_word_encoder_equals_the_library(texts):
    path = tokens.public("word_bpe_49k.json")
    got = tokens.WordEncoder(path).encode(texts)
    want = tokens.word_bpe(path).encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(lengths, "RANGE", 3)
    path = tokens.public(RANKS)
    sizes = [len(tokens.byte_bpe(path).encode_ordinary(t or "")) for t in TEXTS]
    hist = lengths.histogram(lengths.encoded_lengths(docs(spark), path))
    rows = {r.n_tokens: r for r in hist.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == dict(Counter(sizes))
    for k, r in rows.items():
        assert r.docs_at_least == sum(s >= k for s in sizes) and r.tokens_at_least == sum(s for s in sizes if s >= k)
        assert r.truncated_tokens == sum(min(s, k) for s in sizes) and r.n_fit == sum(s <= k for s in sizes)
    totals = {r.limit: r.truncated_tokens for r in lengths.totals(hist, [0, 3, 10**6]).collect()}
    assert totals == {0: 0, 3: sum(min(s, 3) for s in sizes), 10**6: sum(sizes)}
    median = lengths.quantiles(hist, [0.5, 1.0]).orderBy("share").collect()
    assert [r.n_tokens for r in median] == [sorted(sizes)[(len(sizes) - 1) // 2], max(sizes)]
    assert lengths.histogram(lengths.encoded_lengths(docs(spark).limit(0), path)).collect() == []


def check_pieces(pieces, want):
    """Every id in one piece, sequences gapless and within their window, little padding."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, ids in want.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            own = np.array(ids[at : at + p.length], "<u4")
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes()))
            at += p.length
        assert at == len(ids)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.window in packing.TIERS
            at += p.length
        assert at <= own[0].window
        padded += at & (at - 1) != 0
    assert padded <= 1 and sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing(spark):
    path = tokens.public("word_bpe_49k.json")
    texts = TEXTS + [f"paragraph {i} " * (i * 7 % 900) for i in range(120)]
    library = tokens.word_bpe(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    want = {i: [*e.ids, packing.END_ID] for i, e in enumerate(library)}
    pieces = packing.pack(docs(spark, texts), path).collect()
    check_pieces(pieces, want)
    for p in pieces:
        assert p.ids == want[p.doc_id][p.start : p.start + p.length]
    assert packing.pack(docs(spark).limit(0), path).collect() == []


@given(st.dictionaries(st.integers(1, 4095), st.integers(1, 300), max_size=40))
def test_plan_places_every_piece(histogram):
    plan = packing.plan(histogram, 5)
    filled = Counter()
    windows = {}
    for length, count in histogram.items():
        for rank in range(count):
            parts = packing._cut(plan, length, rank)
            assert sum(p[1] for p in parts) == length and parts[0][0] == 0
            for _, size, sequence, offset, window in parts:
                filled.update((sequence, offset + k) for k in range(size))
                windows[sequence] = window
    assert not filled or max(filled.values()) == 1
    assert sorted(windows) == list(range(5, plan.sequences))
    used = Counter(s for s, _ in filled)
    assert sum(used[s] != windows[s] for s in windows) <= 1


@pytest.mark.parametrize("rows", [[(1, "a b"), (1, "a b"), (None, "c")]])
def test_repeated_rows_and_rows_without_id(spark, rows):
    path = tokens.public("word_bpe_49k.json")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, path, with_ids=False).collect()
    assert sum(p.length for p in pieces) == 3 + 3 + 2 and "ids" not in pieces[0].asDict()
    assert len(bpe.digests(df, tokens.public(RANKS)).collect()) == 3


@pytest.mark.parametrize(
    "text",
    ["a <|endoftext|> text", "<|startoftext|>a<|endoftext|>", "end.<|endoftext|>, New <|endoftext|>!", "<|endoftext|>\n<|endoftext|> x", "<|ENDOFTEXT|> <|endoftext"],
)
def test_special_tokens_are_the_librarys(text):
    from tokenizers import Tokenizer

    path = tokens.public("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    assert tokens.word_encoder(path).encode([text, "a"])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
