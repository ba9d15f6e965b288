"""The audit log as a data source: reports and results of a scan under one commit.

``log_scan`` writes both kinds of lines in one write.  Rows are dealt by kind and UTC day and
rebalanced by size, so a day has one file of lines a write, and more only where its lines
exceed the advisory size of a partition.  Files lie under ``<kind>/write=<id>/date=<day>/``; nobody
reads a write before its manifest is there.  The commit removes what failed or repeated tasks have
left, then makes the manifest appear by a rename.  An abort removes all files of the write and marks
it, so that what its tasks wrote while they were being stopped goes with the next commit or
abort.  A manifest is named after the batch, so a batch that is written again adds nothing.

``write`` and ``date`` are partition columns: a reader's filter on committed writes and on days
prunes folders.  Paths are those that ``pyarrow.fs`` knows (shared mounts, ``hdfs://``, ``s3://``,
``gs://``).

Null fields are left out of a line; a scan without rows writes a manifest and no line; a line whose
timestamp is NULL goes to the folder of days that Spark names for NULL.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from toolwarden import schemas
from toolwarden.sources.audit import REPORTS, RESULTS, audit_reports, audit_results

FORMAT = "audit_lines"
COMMITS = "_commits"
LINES = "kind STRING, date DATE, line STRING"
#: Marks of aborted writes among the manifests, which readers pass over.
_ABORTED = ".aborted-"
#: The folder of rows without a day, as Spark names it.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Files(WriterCommitMessage):
    """The files that a task has written, relative to the log."""

    names: list[str]


class AuditWriter(DataSourceArrowWriter):
    """Line files of all tasks, visible by one manifest."""

    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch, self.id = path.rstrip("/"), batch, uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        """Runs in a task: rows come sorted by kind and day, so one file is open at a time."""
        system, root = self._root()
        task, names = TaskContext.get(), []
        held, out = None, None
        try:
            for batch in iterator:
                keys = pa.table({"kind": batch["kind"], "date": batch["date"].cast(pa.string())})
                for key in keys.group_by(["kind", "date"], use_threads=False).aggregate([]).to_pylist():
                    rows = pc.equal(keys["kind"], key["kind"])
                    same = pc.is_null(keys["date"]) if key["date"] is None else pc.fill_null(pc.equal(keys["date"], key["date"]), False)
                    lines = batch["line"].filter(pc.and_(rows, same).combine_chunks())
                    if key != held:
                        if out is not None:
                            out.close()
                        folder = f"{key['kind']}/write={self.id}/date={key['date'] or NO_DAY}"
                        system.create_dir(f"{root}/{folder}", recursive=True)
                        names.append(f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(names)}.jsonl")
                        held, out = key, system.open_output_stream(f"{root}/{names[-1]}")
                    out.write("".join(f"{line}\n" for line in lines.to_pylist()).encode())
        finally:
            if out is not None:
                out.close()
        return Files(names)

    @staticmethod
    def _remove(system: fs.FileSystem, root: str, write: str, kept: set[str]) -> bool:
        """Remove the files of a write that are not kept; whether there were any."""
        some = False
        for kind in (REPORTS, RESULTS):
            folder = f"{root}/{kind}/write={write}"
            found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
            lost = [i.path for i in found if i.is_file and i.path.removeprefix(root).lstrip("/") not in kept]
            some = some or bool(lost)
            if not kept and found:
                system.delete_dir(folder)
                continue
            for path in lost:
                system.delete_file(path)
        return some

    def _sweep(self, system: fs.FileSystem, root: str) -> None:
        """Remove what aborted writes have left; a mark goes when nothing was left."""
        for info in system.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True)):
            if info.base_name.startswith(_ABORTED) and not self._remove(system, root, info.base_name.removeprefix(_ABORTED), set()):
                system.delete_file(info.path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._root()
        manifest = f"{root}/{COMMITS}/{self.batch}.json"
        if system.get_file_info(manifest).type != fs.FileType.NotFound:
            self._remove(system, root, self.id, set())
            return
        names = {name for message in messages if message is not None for name in message.names}
        self._remove(system, root, self.id, names)
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        waiting = f"{root}/{COMMITS}/.{self.id}"
        with system.open_output_stream(waiting) as out:
            out.write(json.dumps({"batch": self.batch, "write": self.id, "files": len(names)}).encode())
        system.move(waiting, manifest)
        self._sweep(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._root()
        self._sweep(system, root)
        system.create_dir(f"{root}/{COMMITS}", recursive=True)
        system.open_output_stream(f"{root}/{COMMITS}/{_ABORTED}{self.id}").close()
        self._remove(system, root, self.id, set())


class AuditLines(DataSource):
    """``df.write.format("audit_lines").option("batch", …).save(path)`` of ``kind, date, line``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def writer(self, schema, overwrite: bool) -> AuditWriter:
        if overwrite:
            raise ValueError("an audit log is only appended to")
        return AuditWriter(self.options["path"], self.options.get("batch") or uuid.uuid4().hex)


def audit_lines(scanned: DataFrame, identity: Column | None = None) -> DataFrame:
    """``kind, date, line`` of a scan's reports and results."""
    both = {RESULTS: audit_results(scanned), REPORTS: audit_reports(scanned, identity=identity)}
    rows = [
        lines.select(F.lit(kind).alias("kind"), "date", F.to_json(F.struct(*[c for c in lines.columns if c != "date"])).alias("line"))
        for kind, lines in both.items()
    ]
    return rows[0].unionByName(rows[1])


def append_lines(lines: DataFrame, path: str, batch: str | None = None) -> None:
    """Append ``kind, date, line`` rows under one commit; a batch that is there already is left as it is."""
    lines.sparkSession.dataSource.register(AuditLines)
    dealt = lines.hint("rebalance", F.col("kind"), F.col("date")).sortWithinPartitions("kind", "date")
    writer = dealt.write.format(FORMAT).mode("append")
    if batch is not None:
        writer = writer.option("batch", batch)
    writer.save(path)


def log_scan(scanned: DataFrame, path: str, batch: str | None = None, identity: Column | None = None) -> None:
    """Append reports and results of a scan (``scan_id``, ``timestamp`` in the input): both or neither."""
    append_lines(audit_lines(scanned, identity), path, batch)


def read_audit(spark: SparkSession, path: str, kind: str = REPORTS) -> DataFrame:
    """The committed lines of a kind; a filter on ``date`` prunes day folders."""
    schema = schemas.AUDIT_REPORT if kind == REPORTS else schemas.AUDIT_RESULT
    # The names of one manifest a commit, for a filter that prunes folders.
    manifests = spark.read.schema("write STRING, files BIGINT").option("pathGlobFilter", "*.json").json(f"{path}/{COMMITS}")
    writes = [r["write"] for r in manifests.where("files > 0").collect()]
    if not writes:
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(f"{schema}, write STRING").json(f"{path}/{kind}")
    return lines.where(F.col("write").isin(writes)).drop("write")
