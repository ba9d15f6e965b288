"""Log-likelihood of whole documents under a gated recurrent language model, and under counts.

Learning documents are those whose ``crc32(doc_id) % 5`` is not 1; all of them
are counted and all of them train the network.

The network is a gated recurrent unit in numpy with an output softmax factored
by class.  The most frequent words (and the end of a text) have their own
inputs and outputs, in classes of about equal weight; every other word belongs
to a class by its ending, within which it has its share of the counts (half a
count for every word never seen), so any text has a likelihood.  Training is
truncated backpropagation: documents lie one behind the other in lanes, a window
of steps is learned from at a time, and the state goes on into the next window
until its document, or ``SEGMENT`` tokens of it, end.  Scoring carries the state
from the first token to the last, so a score is that of the complete document
whatever its length.

At scale: words are combined per task before they are shuffled.  Tasks get the
words of the highest counts only (at most ``KNOWN``, cut at a count, of bounded
length); the few tokens of all other words meet their counts in a join, once
per document and word.  Training passes over all learning documents once, in
``ROUNDS`` rounds: every task trains the same weights on its part, and weighted
averages of the results begin the next round; they are added in groups, then
over groups, as rows of parts of the weights, and only their sum comes to the
driver.  Each table is written once below ``spark.checkpoint.dir``.

Defined results: a NULL or empty text is the end alone; a NULL ``doc_id`` counts
as an empty one (and is learned from); texts are read whole; repeated rows are
counted and scored again; without learning documents every token of the counts
model has probability 1, and the network its first weights; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .spelling import HELD, combined, slices

FOLDS, HELD_OUT = 5, 1
#: Words that tasks know the counts of, and bytes of the longest of them.
KNOWN, LONGEST = 262_144, 64
#: Words with outputs of their own (the end among them), their classes, and classes by ending.
MODELLED, CLASSES, ENDINGS = 2048, 24, 40
HIDDEN = 16
LANES, STEPS, SCORE_LANES = 256, 16, 512
#: Tokens laid into lanes at a time, tokens of a document after which training begins a new state,
#: and tokens that a task trains on in a round at least.
CHUNK, SEGMENT, TASK_TOKENS = 1 << 22, 2048, 1 << 20
ROUNDS, RATE = 2, 0.1
#: Numbers of one part of the weights, and groups that are added first.
PART, GROUPS = 1 << 16, 64
END = 0


def held_out(doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def ending(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % ENDINGS).cast("int")


def endings(words: pa.Array) -> np.ndarray:
    """The class by ending of each word."""
    tails = pc.dictionary_encode(pc.utf8_slice_codeunits(words, -2))
    numbers = np.array([zlib.crc32(t.encode()) % ENDINGS for t in tails.dictionary.to_pylist()], np.int64)
    return numbers[tails.indices.to_numpy(zero_copy_only=False)] if len(numbers) else np.zeros(0, np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts, A-Z lower-cased: the text each belongs to, and the word."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(values, "")
    return pc.filter(parents, some).to_numpy(zero_copy_only=False), pc.dictionary_encode(pc.filter(values, some))


def counted(docs: DataFrame) -> DataFrame:
    """``word, n`` of all rows of ``text``; the NULL word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = known = ends = 0
        for batch in batches:
            texts = batch.column(0)
            ends += len(texts)
            for start, end in slices(texts):
                _, coded = tokens(texts.slice(start, end - start))
                often = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
                parts.append(pa.table({"word": coded.dictionary.cast(pa.string()), "n": often.astype(np.int64)}))
                rows += len(often)
                if rows > known + HELD:
                    parts = [combined(parts)]
                    rows = known = parts[0].num_rows
                    if known > HELD:
                        yield from parts[0].to_batches(max_chunksize=50_000)
                        parts, rows, known = [], 0, 0
        if parts:
            yield from combined(parts).to_batches(max_chunksize=50_000)
        if ends:
            yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.string()), "n": pa.array([ends], pa.int64())})

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What tasks know of the counts."""

    #: Known words, their counts, and their number in the network; the end is apart.
    words: pa.Array
    counts: np.ndarray
    ids: np.ndarray
    ends: int
    #: All learning tokens and distinct ones.
    total: int
    distinct: int
    #: Tokens and distinct words of each class by ending, words with outputs of their own left out.
    ending_tokens: np.ndarray
    ending_words: np.ndarray
    #: Words of a smaller count, and longer ones, are not known.
    least: int

    @property
    def base_log(self) -> float:
        return math.log10(self.total + 0.5 * (self.distinct + 1))

    @property
    def ending_log(self) -> np.ndarray:
        return np.log10(self.ending_tokens + 0.5 * (self.ending_words + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, and the words of the highest counts as far as ``KNOWN`` goes."""
    words = counts.where("word IS NOT NULL")
    end = counts.where("word IS NULL").first()
    ends = int(end["n"]) if end else 0
    # A level holds counts that differ by less than a fiftieth, so there are few levels.
    level = F.floor(F.log2(F.col("n").cast("double")) * 50)
    levels = words.where(F.octet_length("word") <= LONGEST).groupBy(level.alias("level")).agg(
        F.count("*").alias("words"), F.min("n").alias("least")
    )
    least, room = None, KNOWN
    for row in sorted(levels.collect(), key=lambda r: -r["level"]):
        room -= row["words"]
        if room < 0:
            break
        least = row["least"]
    known = []
    if least is not None:
        known = words.where((F.col("n") >= least) & (F.octet_length("word") <= LONGEST)).collect()
    known.sort(key=lambda r: (-r["n"], r["word"]))
    modelled = [r["word"] for r in known[: MODELLED - 1]]
    per_ending = words.groupBy(ending(F.col("word")).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens_of, words_of = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in per_ending:
        tokens_of[row["e"]], words_of[row["e"]] = row["n"], row["v"]
    table = pa.array([r["word"] for r in known], pa.string())
    number = np.array([r["n"] for r in known], np.int64)
    kind = endings(table)
    ids = MODELLED + kind
    ids[: len(modelled)] = np.arange(1, len(modelled) + 1)
    np.subtract.at(tokens_of, kind[: len(modelled)], number[: len(modelled)])
    np.subtract.at(words_of, kind[: len(modelled)], 1)
    return Vocabulary(
        table, number, ids, ends,
        ends + int(sum(r["n"] for r in per_ending)), int(sum(r["v"] for r in per_ending)) + (1 if ends else 0),
        tokens_of, words_of, least if least is not None else 1 << 62,
    )


ENCODED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("known_tokens", T.LongType()), T.StructField("known_log", T.DoubleType()),
    T.StructField("fixed_log", T.DoubleType()), T.StructField("ids", T.BinaryType()),
    T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("rare_n", T.ArrayType(T.IntegerType())),
])


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``doc_id`` and what :data:`ENCODED` says of every text.

    ``known_log`` sums log10(count + 0.5) of known tokens; ``fixed_log`` sums what the
    network adds for words by ending as far as it is known here; ``rare`` holds the distinct
    words that are not known, and ``rare_n`` how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        log_count, ending_log = np.log10(v.counts + 0.5), v.ending_log
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, end in slices(batch.column(1)):
                size = end - start
                parents, coded = tokens(batch.column(1).slice(start, size))
                words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                place = pc.fill_null(pc.index_in(words, value_set=v.words), -1).to_numpy(zero_copy_only=False)
                known = place >= 0
                number = MODELLED + endings(words)
                log, fixed = np.zeros(len(words)), -ending_log[number - MODELLED]
                if known.any():
                    number[known] = v.ids[place[known]]
                    log[known] = log_count[place[known]]
                fixed = np.where(number < MODELLED, 0.0, fixed + log)
                per = np.bincount(parents, minlength=size)
                bounds = np.concatenate([[0], np.cumsum(per)])
                flat = number[codes].astype("<u2")
                ids = [flat[a:b].tobytes() + b"\0\0" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                strange = ~known[codes]
                pairs, often = np.unique(parents[strange].astype(np.int64) * max(len(words), 1) + codes[strange], return_counts=True)
                rare_at = np.concatenate([[0], np.cumsum(np.bincount(pairs // max(len(words), 1), minlength=size))]).astype(np.int32)
                n_known = np.bincount(parents[~strange], minlength=size) + (1 if v.ends else 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, size), pa.array(np.arange(row, row + size)), pa.array(per + 1),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(np.bincount(parents, weights=log[codes], minlength=size) + math.log10(v.ends + 0.5)),
                        pa.array(np.bincount(parents, weights=fixed[codes], minlength=size)),
                        pa.array(ids, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(rare_at), words.take(pa.array(pairs % max(len(words), 1)))),
                        pa.ListArray.from_arrays(pa.array(rare_at), pa.array(often.astype(np.int32))),
                    ],
                    names=["doc_id", *ENCODED.names],
                )
                row += size

    schema = T.StructType([docs.schema["doc_id"], *ENCODED.fields])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def rare_sums(rows: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """Of each row: log10(count + 0.5) over its tokens that tasks do not know, and how many were counted."""
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("times")
    )
    others = counts.where((F.col("n") < least) | (F.octet_length("word") > LONGEST))
    return asked.join(others, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )


@dataclass
class Layout:
    """Where the outputs are: word i of the network is output ``place[i]``, of class ``kind[i]``;
    class c has the outputs from ``start[c]`` to ``start[c + 1]``."""

    place: np.ndarray
    kind: np.ndarray
    start: np.ndarray


def laid_out(weight: np.ndarray) -> Layout:
    """Words by falling count, cut into classes of about equal sums of the square roots."""
    order = np.argsort(-weight, kind="stable")
    mass = np.cumsum(np.sqrt(weight[order]))
    kind = np.minimum((mass - np.sqrt(weight[order])) * CLASSES / max(mass[-1], 1e-9), CLASSES - 1).astype(np.int64)
    place, kind_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order], kind_of[order] = np.arange(len(order)), kind
    return Layout(place, kind_of, np.searchsorted(kind, np.arange(CLASSES + 1)))


SHAPES = {
    "inputs": (MODELLED + ENDINGS, 3 * HIDDEN), "gates": (HIDDEN, 2 * HIDDEN), "memory": (HIDDEN, HIDDEN),
    "classes": (HIDDEN, CLASSES + ENDINGS), "class_bias": (CLASSES + ENDINGS,),
    "outputs": (MODELLED, HIDDEN), "output_bias": (MODELLED,),
}
NUMBERS = sum(math.prod(s) for s in SHAPES.values())
ROWS = sum(s[0] for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights as matrices over one array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        out[name] = flat[at : at + math.prod(shape)].reshape(shape)
        at += math.prod(shape)
    return out


def first_weights(vocab: Vocabulary) -> tuple[np.ndarray, Layout]:
    """Biases from the counts, so that the first model is that of the counts; the rest small and random."""
    weight = np.full(MODELLED, 0.5)
    weight[END] += vocab.ends
    own = vocab.ids < MODELLED
    weight[vocab.ids[own]] += vocab.counts[own]
    layout = laid_out(weight)
    rng = np.random.default_rng(1)
    flat = (rng.standard_normal(NUMBERS) * 0.1).astype(np.float32)
    w = views(flat)
    w["gates"] *= 2
    w["memory"] *= 2
    mass = np.concatenate([np.bincount(layout.kind, weights=weight, minlength=CLASSES), vocab.ending_tokens + 0.5 * (vocab.ending_words + 1)])
    w["class_bias"][:] = np.log(np.maximum(mass, 0.5) / max(mass.sum(), 1))
    w["output_bias"][layout.place] = np.log(weight / max(weight.sum(), 1))
    return flat, layout


class Lanes:
    """Documents one behind the other in lanes, the longest lanes first."""

    def __init__(self, docs: list[np.ndarray], lanes: int) -> None:
        queue = [(0, lane) for lane in range(min(lanes, len(docs)))]
        content: list[list[int]] = [[] for _ in queue]
        for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            length, lane = heapq.heappop(queue)
            content[lane].append(d)
            heapq.heappush(queue, (length + len(docs[d]), lane))
        content.sort(key=lambda c: -sum(len(docs[d]) for d in c))
        self.lengths = np.array([sum(len(docs[d]) for d in c) for c in content])
        shape = (int(self.lengths[0]), len(content))
        self.target = np.zeros(shape, np.uint16)
        self.input = np.zeros(shape, np.uint16)
        self.doc = np.zeros(shape, np.int32)
        starts = np.zeros(shape, bool)
        for lane, members in enumerate(content):
            at = 0
            for d in members:
                n = len(docs[d])
                self.target[at : at + n, lane] = docs[d]
                self.input[at + 1 : at + n, lane] = docs[d][:-1]
                starts[at, lane] = True
                self.doc[at : at + n, lane] = d
                at += n
        #: The lanes in which a document starts, step by step.
        steps, lane = np.nonzero(starts)
        self.starts = np.split(lane, np.searchsorted(steps, np.arange(1, shape[0])))


class Network:
    """The recurrent network over weights in one array."""

    def __init__(self, flat: np.ndarray, layout: Layout) -> None:
        self.flat, self.layout, self.w = flat, layout, views(flat)

    def steps(self, lanes: Lanes, t0: int, t1: int, state: np.ndarray, keep: bool):
        """States of lanes over a window, and what backpropagation needs of it."""
        w, H, n = self.w, HIDDEN, state.shape[0]
        states = np.empty((t1 - t0, n, H), np.float32)
        inputs = w["inputs"][lanes.input[t0:t1, :n]]
        # sigmoid(x) is (tanh(x / 2) + 1) / 2
        inputs[:, :, : 2 * H] *= 0.5
        half_gates, memory = 0.5 * w["gates"], w["memory"]
        kept = []
        for t in range(t1 - t0):
            starting = lanes.starts[t0 + t]
            before = state
            if len(starting):
                before = state.copy()
                before[starting[starting < n]] = 0
            x = inputs[t]
            gates = before @ half_gates
            gates += x[:, : 2 * H]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            seen = gates[:, H:] * before
            new = seen @ memory
            new += x[:, 2 * H :]
            np.tanh(new, out=new)
            state = states[t]
            np.subtract(before, new, out=state)
            state *= gates[:, :H]
            state += new
            if keep:
                kept.append((before, gates[:, :H], gates[:, H:], seen, new))
        return states, state, kept

    def logs(self, states: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """Natural log-likelihood of each target; with ``grads``, also the gradient by state
        of the sum, adding those by the weights to it."""
        w, lay = self.w, self.layout
        # States are between -1 and 1; exponents far below the limit of floats need no shift.
        low = max(np.abs(w["classes"]).sum(0).max() + np.abs(w["class_bias"]).max(), np.abs(w["outputs"]).sum(1).max() + np.abs(w["output_bias"]).max()) < 60
        own = target < MODELLED
        kind = np.where(own, lay.kind[np.minimum(target, MODELLED - 1)], CLASSES - MODELLED + target.astype(np.int64))
        rows = np.arange(len(target))
        logits = states @ w["classes"]
        logits += w["class_bias"]
        if not low:
            logits -= logits.max(1, keepdims=True)
        chosen = logits[rows, kind]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        log = chosen - np.log(total)
        back = None
        if grads is not None:
            logits *= (-1 / total)[:, None]
            logits[rows, kind] += 1
            back = logits @ w["classes"].T
            grads["classes"] += states.T @ logits
            grads["class_bias"] += logits.sum(0)
        mine = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[mine], np.arange(CLASSES + 1))
        mine = mine[: cuts[-1]]
        sorted_states, sorted_place = states[mine], lay.place[target[mine]]
        more = np.zeros(len(mine), log.dtype)
        sorted_back = np.zeros_like(sorted_states) if grads is not None else None
        for c in range(CLASSES):
            here = slice(cuts[c], cuts[c + 1])
            a, b = lay.start[c], lay.start[c + 1]
            if cuts[c] == cuts[c + 1] or b - a < 2:
                continue
            h, at = sorted_states[here], sorted_place[here] - a
            inner = h @ w["outputs"][a:b].T
            inner += w["output_bias"][a:b]
            if not low:
                inner -= inner.max(1, keepdims=True)
            local = np.arange(len(at))
            chosen = inner[local, at]
            np.exp(inner, out=inner)
            total = inner @ np.ones(b - a, inner.dtype)
            more[here] = chosen - np.log(total)
            if grads is not None:
                inner *= (-1 / total)[:, None]
                inner[local, at] += 1
                sorted_back[here] = inner @ w["outputs"][a:b]
                grads["outputs"][a:b] += inner.T @ h
                grads["output_bias"][a:b] += inner.sum(0)
        log[mine] += more
        if grads is not None:
            back[mine] += sorted_back
        return log, back

    def gradients(self, lanes: Lanes, t0: int, t1: int, state: np.ndarray, grads: dict[str, np.ndarray]):
        """One window: the state behind it, gradients of the likelihood by the input rows that
        occur (rows, gradients), the others added to ``grads``, the log-likelihood, and tokens."""
        w, H, n = self.w, HIDDEN, state.shape[0]
        states, last, kept = self.steps(lanes, t0, t1, state, True)
        real = (np.arange(t0, t1)[:, None] < lanes.lengths[None, :n]).ravel()
        log, back = self.logs(states.reshape(-1, H)[real], lanes.target[t0:t1, :n].ravel()[real], grads)
        by_state = np.zeros((len(real), H), np.float32)
        by_state[real] = back
        by_state = by_state.reshape(t1 - t0, n, H)
        by_input = np.empty((t1 - t0, n, 3 * H), np.float32)
        carry = np.zeros((n, H), np.float32)
        memory_t, gates_t = w["memory"].T.copy(), w["gates"].T.copy()
        for i in range(t1 - t0 - 1, -1, -1):
            before, update, reset, seen, new = kept[i]
            d = by_state[i]
            d += carry
            stays = d * update
            d_new = d - stays
            d_new *= 1 - new * new
            d_seen = d_new @ memory_t
            out = by_input[i]
            np.multiply(stays, (before - new) * (1 - update), out=out[:, :H])
            out[:, H : 2 * H] = d_seen * seen * (1 - reset)
            out[:, 2 * H :] = d_new
            carry = out[:, : 2 * H] @ gates_t
            carry += stays
            d_seen *= reset
            carry += d_seen
            starting = lanes.starts[t0 + i]
            if len(starting):
                carry[starting[starting < n]] = 0
        flat_input = by_input.reshape(-1, 3 * H)
        grads["memory"] += np.concatenate([k[3] for k in kept]).T @ flat_input[:, 2 * H :]
        grads["gates"] += np.concatenate([k[0] for k in kept]).T @ flat_input[:, : 2 * H]
        ids = lanes.input[t0:t1, :n].ravel()[real]
        order = np.argsort(ids, kind="stable")
        rows, at = np.unique(ids[order], return_index=True)
        by_row = np.add.reduceat(by_input.reshape(-1, 3 * H)[real][order], at, axis=0) if len(ids) else np.zeros((0, 3 * H), np.float32)
        return last, (rows, by_row), float(log.sum()), len(ids)

    def train(self, docs: list[np.ndarray], squares: np.ndarray) -> tuple[float, int]:
        """One pass over documents; ``squares`` are the sums that scale the steps of each row."""
        lanes = Lanes([d[a : a + SEGMENT] for d in docs for a in range(0, len(d), SEGMENT)], LANES)
        state = np.zeros((lanes.target.shape[1], HIDDEN), np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.w.items() if k != "inputs"}
        log = count = 0
        sums, at = {}, 0
        for name, weights in self.w.items():
            sums[name], at = squares[at : at + len(weights)], at + len(weights)
        for t0 in range(0, len(lanes.target), STEPS):
            t1 = min(t0 + STEPS, len(lanes.target))
            state = state[: int((lanes.lengths > t0).sum())]
            state, (rows, by_row), more, n = self.gradients(lanes, t0, t1, state, grads)
            log, count = log + more, count + n
            for name, g in grads.items():
                g *= 1 / n
                self.w[name] += self._step(sums[name], slice(None), g)
                g[:] = 0
            by_row *= 1 / n
            self.w["inputs"][rows] += self._step(sums["inputs"], rows, by_row)
        return log, count

    @staticmethod
    def _step(sums: np.ndarray, rows, gradient: np.ndarray) -> np.ndarray:
        """How far rows of weights move: against the mean square of all gradients of their row."""
        sums[rows] += (gradient * gradient).mean(1) if gradient.ndim == 2 else gradient * gradient
        scale = RATE / (np.sqrt(sums[rows]) + 1e-7)
        return gradient * (scale[:, None] if gradient.ndim == 2 else scale)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """The natural log-likelihood of each document, words by ending only as their class."""
        lanes = Lanes(docs, SCORE_LANES)
        out = np.zeros(len(docs))
        state = np.zeros((lanes.target.shape[1], HIDDEN), np.float32)
        for t0 in range(0, len(lanes.target), STEPS):
            t1 = min(t0 + STEPS, len(lanes.target))
            n = int((lanes.lengths > t0).sum())
            states, state, _ = self.steps(lanes, t0, t1, state[:n], False)
            real = (np.arange(t0, t1)[:, None] < lanes.lengths[None, :n]).ravel()
            log, _ = self.logs(states.reshape(-1, HIDDEN)[real], lanes.target[t0:t1, :n].ravel()[real])
            out += np.bincount(lanes.doc[t0:t1, :n].ravel()[real], weights=log, minlength=len(docs))
        return out


def chunks(ids: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Documents of about ``CHUNK`` tokens together, with the place of the first."""
    start = size = 0
    for i, raw in enumerate(ids):
        size += len(raw) // 2
        if size >= CHUNK or i + 1 == len(ids):
            yield start, [np.frombuffer(r, "<u2") for r in ids[start : i + 1]]
            start, size = i + 1, 0


def trained(rows: DataFrame, flat: np.ndarray, layout: Layout, tokens: int) -> np.ndarray:
    """Weights after all rounds over ``row, ids`` of the learning documents."""
    squares = np.zeros(ROWS, np.float32)
    tasks = max(1, math.ceil(tokens / (ROUNDS * TASK_TOKENS)))
    for number in range(ROUNDS):
        both = np.concatenate([flat, squares])
        now = rows.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == number).select("ids").coalesce(tasks)
        added = one_round(now, both, layout).collect()
        tokens_seen = sum(r["n"] for r in added if r["part"] == 0)
        if tokens_seen:
            total = np.concatenate([np.frombuffer(r["sums"], "<f4") for r in sorted(added, key=lambda r: r["part"])])
            both = (total / tokens_seen).astype(np.float32)
            flat, squares = both[:NUMBERS].copy(), both[NUMBERS:].copy()
    return flat


def one_round(rows: DataFrame, both: np.ndarray, layout: Layout) -> DataFrame:
    """``part, n, sums``: weights (and their squares) of all tasks, times tokens, added up."""
    shared = rows.sparkSession.sparkContext.broadcast((both, layout))
    schema = "part int, pile int, n long, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, lay = shared.value
        flat, squares, count = start[:NUMBERS].copy(), start[NUMBERS:].copy(), 0
        network = Network(flat, lay)
        waiting: list[bytes] = []
        size = 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                waiting.append(raw)
                size += len(raw) // 2
                if size >= CHUNK:
                    count += network.train([np.frombuffer(r, "<u2") for r in waiting], squares)[1]
                    waiting, size = [], 0
        if waiting:
            count += network.train([np.frombuffer(r, "<u2") for r in waiting], squares)[1]
        if count:
            total = np.concatenate([flat, squares]) * np.float32(count)
            parts = range(0, len(total), PART)
            pile = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(len(parts)), pa.int32()), "pile": pa.array([pile] * len(parts), pa.int32()),
                "n": pa.array([count] * len(parts), pa.int64()),
                "sums": pa.array([total[a : a + PART].tobytes() for a in parts], pa.binary()),
            })

    def add(table: pa.Table) -> pa.Table:
        total, n = 0.0, 0
        for raw, more in zip(table.column("sums"), table.column("n")):
            total = total + np.frombuffer(raw.as_buffer(), "<f4").astype(np.float64)
            n += more.as_py()
        return pa.table({
            "part": table.column("part").slice(0, 1), "pile": pa.array([0], pa.int32()),
            "n": pa.array([n], pa.int64()), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary()),
        })

    tasks = rows.mapInArrow(run, schema)
    return tasks.groupBy("part", "pile").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).select("part", "n", "sums")


def network_scores(rows: DataFrame, flat: np.ndarray, layout: Layout) -> DataFrame:
    """All columns but the long ones, and ``network_log``: log10 of what the network says."""
    names = ["doc_id", "row", "n_tokens", "known_tokens", "known_log", "fixed_log"]
    shared = rows.sparkSession.sparkContext.broadcast((flat, layout))
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("network_log", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(*shared.value)
        for batch in batches:
            logs = np.empty(batch.num_rows)
            for start, docs in chunks(batch.column(len(names)).to_pylist()):
                logs[start : start + len(docs)] = network.score(docs)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(logs / math.log(10))], names=schema.names)

    return rows.select(*names, "ids").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = stored(counted(docs.where(~held_out(F.col("doc_id")))), "lm-counts")
    vocab = vocabulary(counts)
    rows = stored(encoded(docs, vocab), "lm-tokens")
    rare = rare_sums(rows, counts.where("word IS NOT NULL"), vocab.least)
    flat, layout = first_weights(vocab)
    flat = trained(rows.where(~held_out(F.col("doc_id"))).select("row", "ids"), flat, layout, vocab.total)
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return network_scores(rows, flat, layout).join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("known_tokens") + rare_known).cast("long").alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("known_log") + rare_log - F.col("n_tokens") * vocab.base_log).alias("base_score"),
        (F.col("network_log") + F.col("fixed_log") + rare_log).alias("score"),
    )
