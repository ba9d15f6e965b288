"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features describe a whole text: densities of a lexicon, lexicon words near
second-person words, capitals, punctuation and obfuscated spellings.  The
lexicon (words and word beginnings) is learned from labelled documents by the
odds of a token in toxic ones.  Labelled documents are dealt into folds by
``crc32(doc_id) mod 5``: fold 0 is never learned from; folds 1 and 2 give the
lexicon, folds 2 and 3 the trees, fold 4 the calibration.  Of the labelled rows
at most ``MAX_LABELLED`` are learned from, those with the smallest hash of
their id; every document is scored.

Defined results: a NULL or empty text has all features 0 and gets the score of
that point; a NULL label is no label; of several labels of a document the
largest counts; without labels of both classes every score is the share of
toxic ones (0 without labels); a NULL ``doc_id`` is scored and never learned
from; repeated rows get equal scores; an empty table gives no rows; a column
named ``score`` or ``predicted`` is replaced.  The lexicon has at most
``LEXICON`` tokens, so it travels with the code of the tasks; nothing else
leaves the executors but the trees.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, carried, stored, with_results

FOLDS = 5
#: Bound of the labelled sample.
MAX_LABELLED = 20_000
LEXICON = 400
#: A lexicon token occurs in this share of the toxic documents and in this many.
MIN_SHARE, MIN_DOCUMENTS = 0.01, 4
#: and its odds in toxic documents are this many times those in others (natural log).
MIN_LOG_ODDS = 1.5
PREFIXES = (4, 5)
TREES, DEPTH, STEP, BINS = 24, 3, 0.25, 32
#: Words to either side of a second-person word that count as near it.
NEAR = 3
LOCAL = 50
#: Words remembered by a task, and code points described at a time.
CACHE, AT_ONCE = 300_000, 1 << 20

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split()
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_MARKS = re.compile(r"[*._\-'’]+")
_REPEATS = re.compile(r"(.)\1{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGES = "\"'“”‘’«»()[]{}<>.,;:!?…-–—*_#~|"

FEATURES = (
    "log_words", "hit_density", "weight_density", "log_hits", "max_weight", "log_distinct_hits",
    "second_person", "near_second_person", "capital_words", "capital_letters", "exclamations",
    "questions", "punctuation", "obfuscated", "hidden_hits", "word_length", "local_hits",
)


def tokens(word: str) -> list[str]:
    """The lexicon tokens of a word: itself and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


class Describer:
    """Features of texts; remembers what it found out about a word."""

    COLUMNS = 8

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.codes: dict[str, int] = {}
        self.table = np.zeros((0, self.COLUMNS))

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in tokens(word)), default=0.0)

    def look(self, raw: str) -> tuple[float, ...]:
        """Weight, is a hit, second person, capitals, obfuscated, hidden hit, length, is a word."""
        word = bare(raw)
        found = self.weight(word) if word else 0.0
        letters = sum(map(str.isalpha, word))
        odd = 0 < letters < len(word) and any(c.isdigit() or c in "*@$!|_." for c in word[1:])
        odd = odd or bool(_REPEATS.search(word)) and letters > 0
        hidden = 0.0
        if not found and odd:
            plain = _REPEATS.sub(r"\1", _MARKS.sub("", word).translate(_LEET))
            hidden = self.weight(plain)
        shouted = len(word) > 1 and raw.isupper()
        return (
            found or hidden, float(found > 0 or hidden > 0), float(word in SECOND_PERSON), float(shouted),
            float(odd), float(hidden > 0), float(len(word)), float(letters > 0),
        )

    def codes_of(self, words: list[str]) -> np.ndarray:
        """Rows of the table, new words looked at first."""
        found = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        if (unknown := np.flatnonzero(found < 0)).size:
            new = list({words[i] for i in unknown.tolist()})
            self.codes.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.array([self.look(w) for w in new])])
            found[unknown] = [self.codes[words[i]] for i in unknown.tolist()]
        return found

    def describe(self, texts: list[str | None]) -> list[list[float]]:
        """The features of each text."""
        out, first = [], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < AT_ONCE):
                size += len(texts[last] or "")
                last += 1
            if len(self.codes) > CACHE:
                self.codes, self.table = {}, np.zeros((0, self.COLUMNS))
            split = [(t or "").split() for t in texts[first:last]]
            codes = self.codes_of(list(chain.from_iterable(split)))
            cuts = np.cumsum([len(s) for s in split])[:-1]
            out += [self.features(t, c) for t, c in zip(texts[first:last], np.split(codes, cuts), strict=True)]
            first = last
        return out

    def features(self, text: str | None, codes: np.ndarray) -> list[float]:
        n = len(codes)
        if not n:
            return [0.0] * len(FEATURES)
        seen = self.table[codes]
        weight, hit, you = seen[:, 0], seen[:, 1], seen[:, 2]
        hits = hit.sum()
        near = local = 0.0
        if hits:
            at = np.flatnonzero(hit)
            if you.any():
                summed = np.concatenate([[0.0], np.cumsum(you)])
                near = float((summed[np.minimum(at + NEAR + 1, n)] > summed[np.maximum(at - NEAR, 0)]).sum())
            # The most hits of any stretch of LOCAL words begin with a hit.
            local = float((np.searchsorted(at, at + LOCAL) - np.arange(len(at))).max())
        chars = len(text)
        mean = seen.mean(axis=0)
        bangs, asks = text.count("!"), text.count("?")
        points = bangs + asks + sum(map(text.count, ".,;:*#%&$|"))
        return [
            math.log1p(n), mean[1], mean[0], math.log1p(hits), float(weight.max()),
            math.log1p(len(np.unique(codes[hit > 0]))), mean[2], near / n, mean[3],
            float((seen[:, 3] * seen[:, 6]).sum()) / chars,
            bangs / chars, asks / chars, points / chars, mean[4], mean[5], mean[6], local,
        ]


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str, name: str) -> DataFrame:
    """``docs`` with an array of :data:`FEATURES` in column ``name``."""
    state: dict[str, Describer] = {}

    def compute(batch: pa.RecordBatch) -> list:
        if "it" not in state:
            state["it"] = Describer(lexicon)
        return [state["it"].describe(batch.column(text).to_pylist())]

    return appended(docs, T.StructType().add(name, T.ArrayType(T.DoubleType())), compute)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of the sample that may be learned from."""
    marks = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("fold", fold(F.col("doc_id")))
        .where("fold <> 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    # The sample's ids are bounded, so no text moves to meet them.
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Tokens that toxic documents have far more often, with their log odds."""
    schema = T.StructType().add("token", "string").add("toxic", "long").add("clean", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {t for w in set((text or "").split()) if (b := bare(w)) and _LETTERS.fullmatch(b) for t in tokens(b)}
                sums[1 if toxic else 0].update(found)
                sums[1 if toxic else 0][""] += 1
            if len(sums[0]) + len(sums[1]) > CACHE:
                yield table(sums)
                sums = (Counter(), Counter())
        yield table(sums)

    def table(sums: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(sums[0].keys() | sums[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([sums[1][k] for k in keys], pa.int64()), pa.array([sums[0][k] for k in keys], pa.int64())],
            names=["token", "toxic", "clean"],
        )

    counts = (
        rows.where("fold IN (1, 2)").select("text", "toxic").mapInArrow(count, schema)
        .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    counts = stored(counts, "toxic-tokens")
    total = counts.where("token = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    p, n = total["toxic"], total["clean"]
    odds = F.log((F.col("toxic") + 0.5) / (p - F.col("toxic") + 0.5)) - F.log(
        (F.col("clean") + 0.5) / (n - F.col("clean") + 0.5)
    )
    best = (
        counts.where((F.col("token") != "") & (F.col("toxic") >= max(MIN_DOCUMENTS, MIN_SHARE * p)))
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy((F.col("odds") * F.col("toxic")).desc(), "token")
        .limit(LEXICON)
    )
    return {r["token"]: float(r["odds"]) for r in best.collect()}


@dataclass
class Scorer:
    """A lexicon, trees and their calibration; or one constant score."""

    lexicon: dict[str, float] = field(default_factory=dict)
    trees: Model | None = None
    calibration: Model | None = None
    constant: float = 0.0

    def scored(self, docs: DataFrame, text: str) -> DataFrame:
        """The carried columns with ``score`` and ``predicted``."""
        held = docs.select(*carried(docs.columns), F.col(f"`{text}`").alias("body"))
        value = F.lit(self.constant)
        if self.trees is not None:
            found = with_features(held, self.lexicon, "body", "seen").drop("body")
            raw = self.trees.transform(found.withColumn("features", array_to_vector("seen")))
            raw = raw.drop("seen", "features").withColumn("margin", vector_to_array("margins")[1])
            held = self.calibration.transform(raw.drop("margins", "chances", "guess"))
            value = F.least(F.greatest(F.coalesce("calibrated", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return held.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
        results = {"score": F.col("score"), "predicted": F.col("predicted")}
        return self.scored(docs, text).select(*with_results(docs.columns, results))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from the documents of ``docs`` that ``labels`` marks."""
    rows = stored(labelled(docs, labels), "toxic-sample")
    lexicon = learn_lexicon(rows)
    data = stored(
        with_features(rows.where("fold > 1"), lexicon, "text", "seen").select("fold", "toxic", "seen"),
        "toxic-features",
    )
    parts = {(r["tree"], r["toxic"]): r["n"] for r in data.groupBy((F.col("fold") < 4).alias("tree"), "toxic").agg(F.count("*").alias("n")).collect()}
    if any(not parts.get((tree, toxic)) for tree in (True, False) for toxic in (0, 1)):
        share = rows.agg(F.avg("toxic").alias("share")).first()["share"]
        return Scorer(constant=float(share or 0.0))
    data = data.withColumn("features", array_to_vector("seen")).withColumn("label", F.col("toxic").cast("double")).drop("toxic", "seen")
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=BINS, seed=7, checkpointInterval=-1,
        minInstancesPerNode=4, predictionCol="guess",
    ).setRawPredictionCol("margins").setProbabilityCol("chances").fit(data.where("fold < 4").coalesce(4))
    margins = trees.transform(data.where("fold = 4")).select("label", vector_to_array("margins")[1].alias("margin"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(margins)
    return Scorer(lexicon, trees, calibration)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that are not predicted toxic, unchanged."""
    scored = train(docs, labels).scored(docs, "text")
    return scored.where("predicted = 0").select(*with_results(docs.columns, {}))
