"""Spelling variants: each word's near words, the form it varies and the root of its chain.

Two words are near if one inserted, deleted or replaced code point makes one the
other.  The vocabulary is sorted and cut into blocks of bounded size; a query
scans a sorted block as a dynamic programme over edits whose banded rows (three
cells: with one edit no other cell is below two) are kept for the prefix that
adjacent words share, so a row is computed once per distinct prefix, and the
whole range of a prefix whose row already exceeds one edit is skipped.  Blocks
that no edit of a query falls into are skipped by their first and last words.
Many queries go through a block at once, one array element each.

Of two near words the shorter (or equal) one, of length n, agrees with the other
in its first n // 2 code points or in its last.  So the list is sorted twice, by
the words and by the words read backwards, and a query starts at the range of its
half: it never meets words that differ in both halves.  A pair that agrees in its
first half is reported by the forward list alone, so no pair comes twice.

Skew: words are distinct, so blocks are even whatever their prefixes are; a block
that gets many queries is copied for parts of them by their measured number; a
word has at most as many near words as there are edits of it.  Counting combines
per task before it shuffles, and the parts of a task's table are given on when
they grow.

Defined results: a NULL text has no words; a NULL ``doc_id`` is an empty one in
the damage; texts of any length are read whole, words of any length are kept;
repeated rows count again; ties of the form go to the smallest word; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: One in so many runs of a document is damaged, found by ``crc32(doc_id:run)``.
DAMAGED = 97
#: Words have at least this many code points and occurrences.
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: Code points of the words of a block, queries that one copy of it gets, and queries scanned at once.
BLOCK, PART, AT_ONCE = 400_000, 200_000, 20_000
#: Bytes of text cut into words at a time, and words that a task counts before it gives them on.
SLICE, HELD = 4 << 20, 400_000
#: Depths of a block whose jumps are kept in tables; deeper prefixes are passed word by word.
TABLED = 64
_END = chr(0x10FFFF)
_NO_LETTERS = r"[^A-Za-z\x{00C0}-\x{00FF}]+"

_POLYNOMIAL = 0xEDB88320
_ZERO_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _ZERO_BYTE = np.where(_ZERO_BYTE & 1, (_ZERO_BYTE >> 1) ^ np.uint32(_POLYNOMIAL), _ZERO_BYTE >> 1).astype(np.uint32)


def joined_crc32(first: np.ndarray, longest: int) -> np.ndarray:
    """Row n: the part of ``crc32(a + b)`` that ``crc32(a)`` (``first``) gives for a ``b`` of n bytes; the
    whole is this xor ``crc32(b)``, as the checksum is linear."""
    rows = [first.astype(np.uint32)]
    for _ in range(longest):
        rows.append(_ZERO_BYTE[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.stack(rows)


def runs(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The letter runs of texts, A-Z lower-cased: the text each belongs to, and the run."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), _NO_LETTERS, " ")
    lists = pc.ascii_split_whitespace(spaced)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.not_equal(values, "")
    return pc.filter(parents, some).to_numpy(zero_copy_only=False), pc.dictionary_encode(pc.filter(values, some))


def damaged_counts(names: list[str], texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of some documents and how often each occurs, damage done, short ones left out.

    ``names`` are the documents' ids as text; occurrences of a run in a document share its damage."""
    parents, coded = runs(texts)
    words = coded.dictionary
    if len(words) == 0:
        return words, np.zeros(0, np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, often = np.unique(parents.astype(np.int64) * len(words) + codes, return_counts=True)
    document, code = pairs // len(words), pairs % len(words)
    raw = words.cast(pa.binary()).to_pylist()
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    starts = np.fromiter((zlib.crc32(f"{n}:".encode()) for n in names), np.uint32, len(names))
    longest = int(min(size.max(), 255))
    table = joined_crc32(starts, longest)
    sum32 = table[np.minimum(size[code], longest), document] ^ own[code]
    for i in np.flatnonzero(size[code] > longest):
        sum32[i] = zlib.crc32(raw[code[i]], int(starts[document[i]]))
    hit = sum32 % DAMAGED == 0
    counts = np.bincount(code[~hit], weights=often[~hit], minlength=len(words)).astype(np.int64)
    keep = (pc.utf8_length(words).to_numpy(zero_copy_only=False) >= MIN_LENGTH) & (counts > 0)
    changed: dict[str, int] = {}
    for i in np.flatnonzero(hit):
        word = raw[code[i]].decode()
        at = int(sum32[i]) % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= MIN_LENGTH:
            changed[word] = changed.get(word, 0) + int(often[i])
    kept = pc.filter(words, pa.array(keep))
    return (
        pa.concat_arrays([kept.cast(pa.string()), pa.array(list(changed), pa.string())]),
        np.concatenate([counts[keep], np.fromiter(changed.values(), np.int64, len(changed))]),
    )


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        before = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield start, end
        start = end


def combined(parts: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(parts)
    return table.group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of all documents, damage done: words of enough code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = known = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for start, end in slices(texts):
                words, counts = damaged_counts(names[start:end], texts.slice(start, end - start))
                parts.append(pa.table({"word": words, "n": counts}))
                rows += len(counts)
                if rows > known + HELD:
                    parts = [combined(parts)]
                    rows = known = parts[0].num_rows
                    if known > HELD:
                        yield from parts[0].to_batches(max_chunksize=50_000)
                        parts, rows, known = [], 0, 0
        if parts:
            yield from combined(parts).to_batches(max_chunksize=50_000)

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("string"))
    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Sorted:
    """Words in code-point order with the prefix lengths that neighbours share."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.codes, self.start, self.length = flat(words)
        m = len(words)
        #: What a word shares with the one before it.
        self.shared = np.zeros(m, np.int32)
        alive, depth = np.arange(1, m), 0
        while len(alive):
            alive = alive[(self.length[alive] > depth) & (self.length[alive - 1] > depth)]
            alive = alive[self.codes[self.start[alive] + depth] == self.codes[self.start[alive - 1] + depth]]
            depth += 1
            self.shared[alive] = depth
        self._jumps: dict[int, np.ndarray] = {}

    def jumps(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first word behind ``at`` that does not begin with its first ``depth + 1`` code points."""
        out = at + 1
        for d in np.unique(depth):
            if d < TABLED:
                table = self._jumps.get(int(d))
                if table is None:
                    stop = np.where(self.shared <= d, np.arange(len(self.words)), len(self.words))
                    least = np.minimum.accumulate(stop[::-1])[::-1]
                    table = self._jumps[int(d)] = np.append(least[1:], len(self.words)).astype(np.int32)
                here = depth == d
                out[here] = table[at[here]]
        return out


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points one after the other (two zeros behind them), where each word starts, and lengths."""
    length = np.fromiter(map(len, words), np.int32, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    start = np.concatenate([[0], np.cumsum(length[:-1], dtype=np.int64)]).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    return np.append(codes, np.zeros(2, np.uint32)), start, length


def scan(block: Sorted, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the block) one edit apart that share the first half of the query, where
    the word is as long as the query or longer by one."""
    words, end = block.words, len(block.words)
    codes, start, length = flat(queries)
    half = length // 2
    low = np.fromiter((bisect_left(words, q[:h]) for q, h in zip(queries, half.tolist())), np.int32, len(queries))
    high = np.fromiter((bisect_right(words, q[:h] + _END) if h else end for q, h in zip(queries, half.tolist())), np.int32, len(queries))
    query = np.flatnonzero(low < high)
    lo, hi, depth = low[query], high[query], half[query]
    # Cells of the row at a depth: against one code point of the query less, as many, and one more.
    less = np.where(depth > 0, 1, 2).astype(np.int8)
    same = np.zeros(len(query), np.int8)
    more = np.where(depth < length[query], 1, 2).astype(np.int8)
    found_q, found_w = [], []
    last = len(codes) - 1
    while len(query):
        own = length[query]
        over = block.length[lo] == depth
        hit = over & (((own == depth) & (same == 1)) | ((own == depth - 1) & (less == 1)))
        found_q.append(query[hit])
        found_w.append(lo[hit])
        lo = lo + over
        keep = lo < hi
        if not keep.all():
            query, lo, hi, depth, less, same, more, own = (a[keep] for a in (query, lo, hi, depth, less, same, more, own))
            if not len(query):
                break
        # A word that ended is passed; the next one of the range is longer.
        code = block.codes[block.start[lo] + depth]
        at = start[query] + depth
        a = np.where(depth > 0, codes[np.maximum(at - 1, 0)], 0)
        b = codes[np.minimum(at, last)]
        c = codes[np.minimum(at + 1, last)]
        n_less = np.minimum(less + (code != a), same + 1)
        n_less[depth > own] = 2
        n_same = np.minimum(np.minimum(same + (code != b), more + 1), n_less + 1)
        n_same[depth + 1 > own] = 2
        n_more = np.minimum(more + (code != c), n_same + 1)
        n_more[depth + 2 > own] = 2
        after = np.minimum(block.jumps(lo, depth), hi)
        live = np.minimum(np.minimum(n_less, n_same), n_more) <= 1
        rest = after < hi
        query, lo, hi, depth, less, same, more = (
            np.concatenate([x[live], y[rest]])
            for x, y in (
                (query, query), (lo, after), (after, hi), (depth + 1, depth),
                (np.minimum(n_less, 2).astype(np.int8), less), (np.minimum(n_same, 2).astype(np.int8), same),
                (np.minimum(n_more, 2).astype(np.int8), more),
            )
        )
    none = np.zeros(0, np.int64)
    return np.concatenate(found_q or [none]), np.concatenate(found_w or [none])


class Blocks:
    """First and last word of every block, to tell which blocks a query may have near words in."""

    def __init__(self, bounds: list[tuple[int, str, str]]) -> None:
        bounds = sorted(bounds, key=lambda b: b[1])
        self.block = [b[0] for b in bounds]
        self.low = [b[1] for b in bounds]
        self.high = [b[2] + _END for b in bounds]

    def reached(self, query: str) -> list[int]:
        """The blocks that may hold a word which the query becomes by one insertion or replacement
        behind its first half.  While the range of what agrees before the edit spans several blocks,
        the two words of each edit there are looked up; once one block holds the range, it is that one."""
        found: set[int] = set()
        for i in range(len(query) // 2, len(query) + 1):
            prefix = query[:i]
            first, last = bisect_left(self.high, prefix), bisect_right(self.low, prefix + _END)
            if last - first <= 1:
                found.update(range(first, last))
                break
            while first < last:
                low, high = self.low[first], self.high[first]
                c = low[i] if len(low) > i and low.startswith(prefix) else ""
                if c and high.startswith(prefix + c):
                    for word in (prefix + c + query[i + 1 :], prefix + c + query[i:]):
                        found.update(range(bisect_left(self.high, word), bisect_right(self.low, word)))
                    # On to the first block that holds another code point here.
                    first = max(first + 1, bisect_left(self.high, prefix + c + _END))
                else:
                    found.add(first)
                    first += 1
        return [self.block[at] for at in sorted(found)]


#: Bounds are cut to so many code points; a cut upper bound stands for all that begins with it.
_BOUND = 256


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, other, other_n`` for every two near words of ``word, n``, both ways."""
    total = words.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("size")).first()
    blocks = max(1, math.ceil((total["size"] or 0) / BLOCK))
    both = None
    for backwards in (False, True):
        key = F.reverse("word") if backwards else F.col("word")
        block = words.select(key.alias("key"), "n").repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id())
        block = stored(block, "spelling-blocks")
        bounds = block.groupBy("block").agg(F.min(F.left("key", F.lit(_BOUND))).alias("low"), F.max(F.left("key", F.lit(_BOUND))).alias("high"))
        found = searched(block, Blocks([tuple(r) for r in bounds.collect()]), backwards)
        both = found if both is None else both.unionByName(found)
    return both


def searched(block: DataFrame, blocks: Blocks, backwards: bool) -> DataFrame:
    """The near pairs of one sorted list."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [blocks.reached(k) for k in batch.column(0).to_pylist()]
            times = np.fromiter(map(len, to), np.int64, len(to))
            rows = np.repeat(np.arange(len(to)), times)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for bs in to for b in bs], pa.int32()), batch.column(0).take(rows), batch.column(1).take(rows)],
                names=["block", "key", "n"],
            )

    routed = stored(block.select("key", "n").mapInArrow(route, "block int, key string, n long"), "spelling-queries")
    parts = routed.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asked = routed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    held = block.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(queries: pa.Table, members: pa.Table) -> pa.Table:
        members = members.sort_by("key")
        words, counts = members.column("key").to_pylist(), members.column("n").to_numpy()
        ordered = Sorted(words)
        keys, often = queries.column("key").to_pylist(), queries.column("n").to_numpy()
        word, other, other_n = [], [], []
        for at in range(0, len(keys), AT_ONCE):
            now = keys[at : at + AT_ONCE]
            q, w = scan(ordered, now)
            for i, j in zip(q.tolist(), w.tolist()):
                a, b = now[i], words[j]
                if backwards:
                    # What agrees in the first half as well is found forwards.
                    half = len(a) // 2
                    if half == 0 or a[len(a) - half :] == b[len(b) - half :]:
                        continue
                    a, b = a[::-1], b[::-1]
                word.append(a)
                other.append(b)
                other_n.append(counts[j])
                if len(a) != len(b):  # the longer one does not look for shorter ones
                    word.append(b)
                    other.append(a)
                    other_n.append(often[at + i])
        return pa.table({"word": pa.array(word, pa.string()), "other": pa.array(other, pa.string()), "other_n": pa.array(other_n, pa.int64())})

    columns = ["block", "part", "key", "n"]
    return (
        asked.select(*columns).groupBy("block", "part").cogroup(held.select(*columns).groupBy("block", "part"))
        .applyInArrow(search, "word string, other string, other_n long")
    )


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: where following forms ends.  A form occurs at least twice as
    often as its variant, so chains end within the logarithm of the largest count; only words
    whose chain goes on take part in the next round."""
    ends = None
    now = links.select("word", F.col("form").alias("root"))
    steps = links.select(F.col("word").alias("root"), F.col("form").alias("next"))
    while True:
        now = stored(now.join(steps, "root", "left"), "spelling-chains")
        ended = now.where("next IS NULL").select("word", "root")
        ends = ended if ends is None else ends.unionByName(ended)
        now = now.where("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if now.isEmpty():
            return ends


def variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table of ``word, n``."""
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best")
    )
    enough = -F.col("best.m") >= RATIO * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.m")).alias("form_n"),
    )
    judged = stored(judged, "spelling-forms")
    found = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
