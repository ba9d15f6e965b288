"""Line-first cleaning against plain Python, and edge rows."""

import random
import re
from collections import Counter

import pytest

from toolwarden.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base,
    )


def counts(rows):
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_counts_equal_plain_python(spark):
    rng = random.Random(4)
    alphabet = ["a", "b", "cd", "é", "x|y", "#", " ", "\n", "\t", "\x0b", " ", "👩"]
    texts = [" ".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(150)]
    texts += ["one two three four five six seven eight nine ten " * 3, "same line here\n" * 5, "\n\n \n", "w" * 50_000, "a " * 30_000]
    rows = Q.judge(frame(spark, texts)).orderBy("doc_id").collect()
    assert counts(rows) == [plain(t) for t in texts]


GOOD = "The ferry leaves the small harbour at nine and comes back before the sun goes down over the hills.\n"
OTHER = "A baker in the upper town still heats his oven with beech wood, which his father cut and stacked each autumn behind the school.\n"


@pytest.mark.parametrize(
    "junk",
    [
        "home | news | shop | help | more | less | up | down",
        "THIS LINE SHOUTS AT EVERY READER WHO COMES ALONG",
        "win### big%%% cash$$$ now*** and&&& more<<< again>>>",
        "wow!! yes!! no!! what??",
        "We use cookies to improve this site",
        "Read more",
    ],
)
def test_failed_lines_go_and_documents_that_lose_much(spark, junk):
    kept = GOOD + junk + "\n" + OTHER
    lost = GOOD + "\n".join([junk] * 40)
    rows = Q.judge(frame(spark, [kept, GOOD + OTHER, lost])).orderBy("doc_id").collect()
    assert rows[0].clean_text == GOOD + OTHER and rows[0].kept and rows[0].n_lost_words > 0
    assert rows[1].n_lost_words == 0 and rows[1].kept
    assert not rows[2].kept


def test_edge_rows(spark):
    rows = [(1, None, "x", 9), (1, None, "x", 9), (None, "", None, None), (2, GOOD + OTHER, "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = Q.judge(docs)
    assert dict(out.dtypes)["kept"] == "boolean" and out.columns[:4] == docs.columns
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in out.collect())
    assert got == [(0, 0, False), (1, 0, False), (1, 0, False), (2, 43, True)]
    assert Q.judge(docs.limit(0)).collect() == []
    stage = Q.keep_clean(docs.select("doc_id", "text"))
    assert [tuple(r) for r in stage.collect()] == [(2, rows[3][1])]


def test_plan_is_native(spark):
    plan = Q.judge(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
