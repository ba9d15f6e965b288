"""Streaming jobs that keep keyed state: sessions, event-time windows, requests that wait for answers.

State lives in the RocksDB state store, keyed and partitioned by Spark; what a batch costs
depends on its rows and on the timers that end in it, not on how many batches came before.
The watermark says how long rows may be out of order.  Rows that come later than that are not
dropped: they leave with ``late`` set, and what they change is settled outside the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from toolwarden.operators.sessions import CLOSE_METHOD, OPEN_METHOD, with_session_validity
from toolwarden.streaming.jobs import run_batches, run_to_files

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Folders by hash of the session, so that settling late rows reads the touched ones only.
LOG_BUCKETS = 32
#: Files at most of a batch's bucket, so that a session with a third of all rows is no single task.
LOG_PIECES = 4
_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state and timers need, for queries started inside, with at most
    two partitions per core.

    Every batch opens and commits the store of every partition, however few rows it has, and
    nothing merges small partitions of a stream with state.  A checkpoint keeps the number of
    partitions that it began with."""
    before = {key: spark.conf.get(key, None) for key in (_PROVIDER, _PARTITIONS)}
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set(_PROVIDER, _ROCKSDB)
    spark.conf.set(_PARTITIONS, min(int(spark.conf.get(_PARTITIONS)), 2 * cores))
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _timed(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """The stream with a watermark, and its time also in microseconds.

    The state reads the copy: a column that is derived from the watermarked one is not
    filtered by it, so late rows arrive and can be told apart."""
    return stream.withWatermark(ts, lateness).withColumn("at_us", F.unix_micros(F.col(ts)))


# --- sessions ---------------------------------------------------------------------------

#: States that the sessions are dealt over by hash, times the salts.
SESSION_SLOTS = 512
#: Rows at most that a task bundles at once, and bytes after which it bundles what it has.
BUNDLE_ROWS, BUNDLE_BYTES = 500_000, 64 << 20
#: Rows at most of one value of the state and of one frame of results.
PIECE_ROWS = 100_000
_NEVER = -(1 << 63)
# Threads cost far more than the small tables that are packed.
_WRITE = pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)
_READ = pa.ipc.IpcReadOptions(use_threads=False)


def _packed(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=_WRITE) as writer:
        writer.write(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p, options=_READ).read_all() for p in packed])


def _pieces(rows: pa.Table) -> Iterator[pa.Table]:
    for start in range(0, rows.num_rows, PIECE_ROWS):
        yield rows.slice(start, PIECE_ROWS)


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each slot and salt as one value, so that a state takes a few values of many
    rows, not rows one by one."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BUNDLE_ROWS or size >= BUNDLE_BYTES:
            yield _bundle(held)
            held, rows, size = [], 0, 0
    if held:
        yield _bundle(held)


def _bundle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    order = np.lexsort((table["salt"].to_numpy(), table["slot"].to_numpy()))
    table = table.take(pa.array(order)).combine_chunks()
    slot, salt = table["slot"].to_numpy(), table["salt"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (salt[1:] != salt[:-1])])
    ends = np.r_[starts[1:], len(slot)]
    rows = table.select(["session", "us", "row", "method"])
    packed = [_packed(rows.slice(a, b - a)) for a, b in zip(starts.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(slot[starts]), pa.array(salt[starts]), pa.array(packed, pa.binary())], ["slot", "salt", "rows"]
    )


def _is_change(rows: pa.Table) -> np.ndarray:
    return pc.is_in(rows["method"], pa.array([OPEN_METHOD, CLOSE_METHOD])).to_numpy()


class _Told:
    """What is known of the sessions, then rows of theirs, by session in the order of time.

    A change is followed if it is newer than what was known of its session before."""

    def __init__(self, known: pa.Table | None, rows: pa.Table) -> None:
        parts = [rows] if known is None else [known, rows]
        table = pa.concat_tables(parts, promote_options="default")
        held = 0 if known is None else known.num_rows
        code = table["session"].combine_chunks().dictionary_encode().indices
        given = pa.array(np.arange(table.num_rows) >= held)
        keys = pa.table({"code": code, "given": given, "us": table["us"], "row": table["row"]})
        order = pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names], null_placement="at_start")
        self.table = table = table.take(order).combine_chunks()
        self.count = n = table.num_rows
        at = np.arange(n)
        code = code.take(order).to_numpy()
        first = np.r_[True, code[1:] != code[:-1]] if n else np.zeros(0, bool)
        #: Of each row the first of its session.
        self.start = np.maximum.accumulate(np.where(first, at, 0)) if n else at
        self.last = np.r_[first[1:], True] if n else first
        self.held = order.to_numpy() < held
        self.change = _is_change(table)
        self.us = table["us"].to_numpy()
        self.opens = np.where(self.held, self._flag("open"), pc.equal(table["method"], OPEN_METHOD).fill_null(False).to_numpy())
        self.sure = np.where(self.held, self._flag("sure"), True)
        self.base = self.held.copy()

    def _flag(self, name: str) -> np.ndarray:
        if name not in self.table.column_names:
            return np.zeros(self.count, bool)
        return self.table[name].fill_null(False).to_numpy()

    def follow(self) -> np.ndarray:
        """Of each row the row that says what is known of its session after it; -1 if nothing does."""
        at, start = np.arange(self.count), self.start
        newer = ~self.base[start] | (self.us > self.us[start])
        tie = np.flatnonzero(~newer & (self.us == self.us[start]) & (at != start))
        if len(tie):
            row = self.table["row"]
            # NULL ids come first, as in the order of the batch rule.
            said, was = row.take(pa.array(tie)), row.take(pa.array(start[tie]))
            later = pc.if_else(pc.is_null(was), pc.is_valid(said), pc.greater(said, was).fill_null(False))
            newer[tie] = later.to_numpy()
        says = np.maximum.accumulate(np.where(self.base | (self.change & newer), at, -1)) if self.count else at
        return np.where(says >= start, says, -1)

    def known(self, says: np.ndarray, kept: pa.Array | None = None) -> pa.Table:
        """What is known of each session after all rows: what is open or unsure, and if closed what ``kept`` names."""
        ends = np.flatnonzero(self.last & (says >= 0))
        source = says[ends]
        opens, sure = self.opens[source], self.sure[source]
        table = self.table.select(["session", "us", "row"]).take(pa.array(source))
        table = table.append_column("open", pa.array(opens)).append_column("sure", pa.array(sure))
        if kept is None:
            return table
        waits = pc.is_in(table["session"], kept).to_numpy()
        return table.filter(pa.array(opens | ~sure | waits))


class SessionState(StatefulProcessor):
    """Judges the requests of the sessions of a slot in the order of their time.

    A slot holds the sessions of one hash value: calls into the state cost far more than rows, and so
    are made per slot, not per session.  Rows wait until the watermark has passed them.  ``known`` has
    of each session what the last change said; it is given up when the session is closed and nothing
    of it waits.  A row that comes behind the watermark leaves as late.  If it is a change, the state
    follows it unless a newer one is known; if the state of its session is gone, nothing can be said
    of the session until its next change, and its rows leave as late, too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Tables of ``session, us, row, method``.
        self.waiting = handle.getListState("waiting", "rows BINARY")
        #: Open or not, the time and row of the change that said so, whether that is certain.
        self.known = handle.getValueState("known", "rows BINARY")
        self.timer = handle.getValueState("timer", "ms LONG")

    def close(self) -> None:
        pass

    def _results(self, rows: pa.Table, valid, late) -> Iterator[pd.DataFrame]:
        n = rows.num_rows
        columns = [rows["session"], rows["row"], rows["us"], rows["method"]]
        flags = [pa.array(np.broadcast_to(f, n)) for f in (valid, late)]
        out = pa.table([*columns, *flags], ["session", "row", "us", "method", "valid", "late"])
        for piece in _pieces(out):
            yield piece.combine_chunks().to_pandas(types_mapper=pd.ArrowDtype)

    def _known(self) -> pa.Table | None:
        known = self.known.get()
        return None if known is None else _unpacked([known[0]])

    def _keep(self, known: pa.Table) -> None:
        if known.num_rows:
            self.known.update((_packed(known),))
        else:
            self.known.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, salt = key
        passed = timerValues.getCurrentWatermarkInMs()
        given = _unpacked(packed for frame in rows for packed in frame["rows"])
        alone = pc.is_null(given["session"])
        yield from self._results(given.filter(alone), True, False)
        given = given.filter(pc.invert(alone))
        # A row without a time is behind every watermark.
        behind = pc.less(given["us"], (passed + 1) * 1000).fill_null(True)
        late, wait = given.filter(behind), given.filter(pc.invert(behind))
        if late.num_rows:
            change = _is_change(late)
            if change.any():
                self._follow_late(late.filter(pa.array(change)))
            yield from self._results(late if salt == 0 else late.filter(pa.array(~change)), True, True)
        if wait.num_rows:
            self._wait(wait, append=True)

    def _follow_late(self, changes: pa.Table) -> None:
        us = changes["us"].fill_null(_NEVER)
        told = _Told(self._known(), changes.set_column(1, "us", us))
        # Of a session without state its first late change says nothing but when it was.
        unknown = ~told.held[told.start]
        first = unknown & (told.start == np.arange(told.count))
        told.base |= first
        told.opens &= ~first
        told.sure = told.held[told.start] & told.sure[told.start]
        self._keep(told.known(told.follow()))

    def _wait(self, rows: pa.Table, append: bool) -> None:
        pieces = [(_packed(piece),) for piece in _pieces(rows)]
        if append:
            self.waiting.appendList(pieces)
        else:
            self.waiting.put(pieces)
        self._wake(pc.min(rows["us"]).as_py() // 1000)

    def _wake(self, ms: int) -> None:
        """One timer per slot, for the first row that waits."""
        set_for = self.timer.get()
        if set_for is not None:
            if set_for[0] <= ms:
                return
            self.handle.deleteTimer(set_for[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, salt = key
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = _unpacked(packed for (packed,) in self.waiting.get())
        due = pc.less(rows["us"], (passed + 1) * 1000)
        rest = rows.filter(pc.invert(due))
        # A late change of the same batch may be newer than one that waited.
        told = _Told(self._known(), rows.filter(due))
        says = told.follow()
        self._keep(told.known(says, rest["session"].combine_chunks()))
        if rest.num_rows:
            self._wait(rest, append=False)
        else:
            self.waiting.clear()
        before = np.r_[-1, says[:-1]]
        before = np.where(before >= told.start, before, -1)
        valid = told.change | ((before >= 0) & told.opens[before])
        late = ~told.change & (before >= 0) & ~told.sure[before]
        shown = ~told.held if salt == 0 else ~told.held & ~told.change
        yield from self._results(told.table.filter(pa.array(shown)), valid[shown], late[shown])


def judged_sessions(
    requests: DataFrame, session: str, row_id: str, lateness: str, salts: int = 4, slots: int = SESSION_SLOTS
) -> DataFrame:
    """A stream of ``session, row, us, method, valid, late`` of all ``requests``, each once.

    The sessions are dealt over ``slots`` by hash, requests without one by their id.  The requests of
    a session are dealt over ``salts`` states by their id, and its openings and closings go to each of
    them, so a session with a third of all requests is no single task.  A batch costs its rows and
    what is open or waits in the slots that it touches: more slots for more sessions that stay open."""
    change = F.coalesce(F.col("method").isin(OPEN_METHOD, CLOSE_METHOD), F.lit(False)) & F.col(session).isNotNull()
    own = F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)).cast("int")
    everywhere = F.array(*[F.lit(i) for i in range(salts)])
    row_type = dict(requests.dtypes)[row_id]
    name = F.col(session).cast("string")
    slot = F.xxhash64(F.coalesce(name, F.col(row_id).cast("string")))
    rows = _timed(requests, "ts", lateness).select(
        name.alias("session"), F.col("at_us").alias("us"),
        F.col(row_id).alias("row"),
        F.coalesce("method", F.lit("")).alias("method"),
        F.pmod(slot, F.lit(slots)).cast("int").alias("slot"),
        F.explode(F.when(change, everywhere).otherwise(F.array(own))).alias("salt"),
    )
    return rows.mapInArrow(_bundled, "slot INT, salt INT, rows BINARY").groupBy("slot", "salt").transformWithStateInPandas(
        SessionState(), f"session STRING, row {row_type}, us LONG, method STRING, valid BOOLEAN, late BOOLEAN",
        "Append", "EventTime",
    )


def session_states(
    requests: DataFrame, session: str, path: str, checkpoint: str, row_id: str = "request_id",
    lateness: str = "10 minutes", salts: int = 4, slots: int = SESSION_SLOTS,
) -> None:
    """Judge a stream of requests by keyed state, as :func:`toolwarden.operators.sessions.with_session_validity`
    judges a table.

    Every request is written once, in the batch in which the watermark passes it.  The sessions
    of late rows are judged again from the first row of the batch on, by the batch rule over what is
    written of them since and the last change before.  Read with
    :func:`session_results`.  Requests behind the watermark at the end of a stream that stops
    wait for later rows."""
    bucket = F.pmod(F.xxhash64("session"), F.lit(LOG_BUCKETS)).cast("int")
    at = F.coalesce("us", F.lit(_NEVER))

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written once for several readers of this batch; the next batch replaces it."""
        df.write.mode("overwrite").parquet(f"{path}/late/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/late/{name}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"{path}/judged/batch_id={batch_id}"
        # A few files a bucket: as they come from the state, every task would write to every bucket.
        piece = F.pmod(F.xxhash64("row"), F.lit(LOG_PIECES))
        dealt = batch.withColumn("bucket", bucket).repartition("late", "bucket", piece)
        dealt.write.mode("overwrite").partitionBy("late", "bucket").parquet(here)
        schema = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])
        # What was said of rows before the first of this batch stands.
        touched = spark.read.schema(schema).parquet(here).groupBy("session", "bucket").agg(
            F.min(at).alias("since"), F.bool_or("late").alias("settle")
        )
        touched = kept(touched.where("settle").drop("settle"), "sessions")
        spans = touched.groupBy("bucket").agg(F.min("since").alias("since")).collect()
        if not spans:
            return
        known = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{path}/judged")
        known = known.where(F.col("bucket").isin([r["bucket"] for r in spans]) & (F.col("batch_id") <= batch_id))
        known = known.select("session", "us", "row", "method")
        since = min(r["since"] for r in spans)
        recent = known if since == _NEVER else known.where(F.col("us") >= since)
        touched = touched.select("session", "since")
        again = recent.join(touched, "session").where(at >= F.col("since")).drop("since").withColumn("again", F.lit(True))
        changes = known.where(F.col("method").isin(OPEN_METHOD, CLOSE_METHOD)).join(touched, "session").where(at < F.col("since"))
        before = changes.groupBy("session").agg(F.max(F.struct("us", "row", "method")).alias("last"))
        again = again.unionByName(before.select("session", "last.*", F.lit(False).alias("again")))
        rows = kept(again, "rows").withColumn("ts", F.timestamp_micros("us"))
        with_session_validity(rows, "session", "row").where("again").select("row", "valid").write.mode("overwrite").parquet(
            f"{path}/settled/batch_id={batch_id}"
        )

    with keyed_state(requests.sparkSession):
        run_batches(judged_sessions(requests, session, row_id, lateness, salts, slots), handle, checkpoint)


def session_results(spark: SparkSession, path: str) -> DataFrame:
    """``row, valid, late`` of all requests so far, late rows settled."""
    judged = spark.read.parquet(f"{path}/judged").select("row", "valid", F.col("late").cast("boolean").alias("late"))
    # A folder of settled rows is there only once a row came late.
    if not _exists(spark, f"{path}/settled"):
        return judged
    settled = spark.read.parquet(f"{path}/settled")
    last = settled.groupBy("row").agg(F.max_by("valid", "batch_id").alias("again"))
    return judged.join(last, "row", "left").select("row", F.coalesce("again", "valid").alias("valid"), "late")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# --- windows ----------------------------------------------------------------------------


class WindowState(StatefulProcessor):
    """Counts a window until the watermark passes its end; what comes later leaves as late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n LONG")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, name = key
        n = int(sum(frame["n"].sum() for frame in rows))
        if end <= timerValues.getCurrentWatermarkInMs():
            yield pd.DataFrame([(start, name, n, True)], columns=["start", "method", "requests", "late"])
            return
        if self.count.exists():
            n += self.count.get()[0]
        else:
            self.handle.registerTimer(end)
        self.count.update((n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, _, name = key
        (n,) = self.count.get()
        self.count.clear()
        yield pd.DataFrame([(start, name, n, False)], columns=["start", "method", "requests", "late"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each window and method in a batch of rows, so that a window with a third of
    all rows sends few rows to its state."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by(["start", "end", "method"]).aggregate([([], "count_all")])
            yield from table.rename_columns(["start", "end", "method", "n"]).combine_chunks().to_batches()


def closed_windows(
    requests: DataFrame, path: str, checkpoint: str, window: str = "1 minute", slide: str | None = None,
    lateness: str = "10 minutes",
) -> None:
    """Requests per window and method, written once when the watermark passes the window's end.

    Requests of windows that are closed are counted in a side table (``late=true``): they add to
    the windows when read with :func:`window_counts`.  Windows that are open when a stream stops
    stay in the state for its next run."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = _timed(requests, "ts", lateness).select(span.alias("_w"), F.coalesce("method", F.lit("")).alias("method"))
    rows = rows.select(F.unix_millis("_w.start").alias("start"), F.unix_millis("_w.end").alias("end"), "method")
    counts = rows.mapInArrow(_counted, "start LONG, end LONG, method STRING, n LONG")
    closed = counts.groupBy("start", "end", "method").transformWithStateInPandas(
        WindowState(), "start LONG, method STRING, requests LONG, late BOOLEAN", "Append", "EventTime"
    )
    closed = closed.withColumn("window_start", F.timestamp_millis("start")).drop("start")
    with keyed_state(requests.sparkSession):
        run_to_files(closed, path, checkpoint, ("late",))


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """``window_start, method, on_time, late``: closed windows, and what came behind their end."""
    rows = spark.read.schema("method STRING, requests LONG, window_start TIMESTAMP, late BOOLEAN").parquet(path)

    def total(wanted: Column) -> Column:
        return F.coalesce(F.sum(F.when(wanted, F.col("requests"))), F.lit(0))

    return rows.groupBy("window_start", "method").agg(total(~F.col("late")).alias("on_time"), total(F.col("late")).alias("late"))


# --- requests and answers ---------------------------------------------------------------


def answered_within(
    requests: DataFrame, answers: DataFrame, client: list[str], within: str = "10 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """A stream of all ``answers`` with the requests of their client and id that were asked at most
    ``within`` before them; an answer without one leaves, with ``asked_ts`` NULL, when the
    watermarks say that none can come.

    Both sides have watermarks, so rows are kept only while partners may come: requests for
    ``within`` and the lateness, answers until the requests' watermark has passed them."""
    key = [*client, "request_id"]
    asked = requests.select(*[F.col(k).alias(f"_r_{k}") for k in key], F.col("ts").alias("asked_ts"), F.col("method").alias("asked_method"))
    asked, told = asked.withWatermark("asked_ts", lateness), answers.withWatermark("ts", lateness)
    meets = (F.col("asked_ts") <= F.col("ts")) & (F.col("asked_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}"))
    for k in key:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return told.join(asked, meets, "leftOuter").drop(*[f"_r_{k}" for k in key])


def latest_request(pairs: DataFrame, answer: list[str]) -> DataFrame:
    """Of each answer (``answer`` tells them apart) the latest request, and whether there is one."""
    return pairs.groupBy(*answer).agg(
        F.coalesce(F.max_by("asked_method", "asked_ts"), F.max("method")).alias("method"),
        (F.max("asked_ts").isNotNull()).alias("matched"),
    )
