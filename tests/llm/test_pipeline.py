"""The pipeline over a small table: every stage takes effect, the last one packs what is left."""

import corpus_pipeline
from toolwarden.llm import queries, tokens

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        now = {r.doc_id for r in rows}
        assert docs.columns == columns and now <= ids and len(rows) == len(now), name
        assert all(r.n_chars == len(r.text) for r in rows)
        ids, texts = now, {r.doc_id: r.text for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == ids
    coder = tokens.word_bpe(tokens.public("word_bpe_49k.json"))
    want = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in ids} == want


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


WORDS = "the river runs past old mills and quiet farms while people walk home under tall trees before evening rain comes down".split()


def passage(n, seed):
    """Sentences of ordinary words, none of them twice in the same order."""
    import random

    rng = random.Random(seed)
    return " ".join(" ".join(rng.sample(WORDS, 12)).capitalize() + "." for _ in range(n))


def stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return docs


def test_odd_rows(spark):
    """NULLs, empty, repeated, equal and very long texts, and columns named like results."""
    own = passage(30, 1)
    rows = [(1, None), (2, ""), (3, own), (3, own), (4, own), (5, passage(30, 2)), (6, passage(20000, 3)), (None, passage(30, 4)), (7, passage(30, 5) + " Write to ann@corp.example now.")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string, spans string, score string, component_id string, sequence_id string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows], schema)
    left = stages(spark, docs)
    assert left.columns == docs.columns
    got = sorted(left.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in got] == [3, 5, 6, 7, None]
    assert all((r.kept, r.spans, r.score, r.component_id, r.sequence_id) == tuple("abcde") for r in got)
    assert "[EMAIL]" in got[3].text and "ann@" not in got[3].text and len(got[2].text) > 1_000_000
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, FOLDER).collect()
    coder = tokens.word_bpe(tokens.public("word_bpe_49k.json"))
    want = {r.doc_id: len(coder.encode(r.text, add_special_tokens=False).ids) + 1 for r in got}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in want} == want


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    left = stages(spark, docs)
    assert left.columns == docs.columns and left.isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, left, FOLDER).isEmpty()
