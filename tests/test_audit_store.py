from pathlib import Path

import pytest
from data import DEMO, tools
from pyspark.sql import functions as F

from toolwarden.operators import scoring as S
from toolwarden.sources import audit as AU
from toolwarden.sources import audit_store as AS


def stamped(spark, day="2024-01-05"):
    scanned = S.scan_tools(tools(spark, DEMO))
    return scanned.withColumn("timestamp", F.to_timestamp(F.lit(day + " 23:59:59"))).withColumn("scan_id", F.lit("s-" + day))


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*.jsonl"))


def both(spark, path):
    return [sorted(map(str, AS.read_audit(spark, path, kind).select(*columns).collect())) for kind, columns in (
        (AU.REPORTS, ["scan_id", "timestamp", "server_name", "total_tools", "tools_blocked", "max_risk_score", "gateway_identity", "date"]),
        (AU.RESULTS, ["scan_id", "timestamp", "tool_name", "risk_score", "risk_level", "blocked", "detections", "date"]),
    )]


def test_equal_to_the_plain_log(spark, tmp_path):
    one, two = str(tmp_path / "plain"), str(tmp_path / "store")
    identity = F.create_map(F.lit("user"), F.lit("bob@corp.test"))
    for day in ("2024-01-05", "2024-01-06"):
        AU.log_scan(stamped(spark, day), one, identity)
        AS.log_scan(stamped(spark, day), two, day, identity)
    for kind in (AU.REPORTS, AU.RESULTS):
        want, got = AU.read_audit(spark, one, kind), AS.read_audit(spark, two, kind)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # One file per day and kind of a write.
    assert len(files(two)) == 4
    line = (Path(two) / files(two)[0]).read_text().splitlines()[0]
    assert line.startswith("{") and '"date"' not in line
    pruned = AS.read_audit(spark, two).where("date = DATE '2024-01-06'")
    assert len(pruned.inputFiles()) and pruned.count() == 1
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_days_of_one_write(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = stamped(spark).withColumn("timestamp", F.timestamp_seconds(F.lit(1704067200) + F.col("tool_pos") % 3 * 86400))
    rows = rows.withColumn("timestamp", F.when(F.col("tool_pos") != 7, F.col("timestamp"))).repartition(7)
    AS.log_scan(rows.withColumn("scan_id", F.col("tool_pos").cast("string")), path)
    assert AS.read_audit(spark, path, AU.RESULTS).count() == AS.read_audit(spark, path).count() == 8
    assert AS.read_audit(spark, path, AU.RESULTS).where("date IS NULL").count() == 1
    assert len(files(path)) == 2 * 4


def test_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    AS.log_scan(stamped(spark), path, "7")
    before, kept = both(spark, path), files(path)
    AS.log_scan(stamped(spark), path, "7")
    assert both(spark, path) == before and files(path) == kept
    AS.log_scan(stamped(spark), path, "8")
    assert len(files(path)) == 2 * len(kept)


def test_aborted_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    AS.log_scan(stamped(spark), path, "1")
    before, kept = both(spark, path), files(path)
    lines = AS.audit_lines(stamped(spark, "2024-01-07")).repartition(4)
    broken = lines.withColumn("line", F.when(F.col("line").contains("format_text"), F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format(AS.FORMAT).mode("append").option("batch", "2").save(path)
    assert both(spark, path) == before
    # Tasks that were still being stopped may have left files; they go with the next commit.
    AS.append_lines(lines, path, "2")
    assert AS.read_audit(spark, path).count() == 2
    writes = {f.split("/")[1] for f in files(path)}
    assert len(writes) == 2 and set(kept) < set(files(path))


def test_sweep_after_an_abort(spark, tmp_path):
    path = tmp_path / "store"
    writer = AS.AuditWriter(str(path), "1")
    late = path / "reports" / f"write={writer.id}" / "date=2024-01-05"
    late.mkdir(parents=True)
    (late / "0.jsonl").write_text("{}\n")
    writer.abort([])
    assert files(path) == []
    late.mkdir(parents=True)
    (late / "1.jsonl").write_text("{}\n")  # by a task that was not stopped yet
    marks = lambda: [p.name for p in (path / "_commits").iterdir() if ".aborted" in p.name]
    AS.log_scan(stamped(spark), str(path), "2")
    assert len(files(path)) == 2 and len(marks()) == 1
    AS.log_scan(stamped(spark), str(path), "3")
    assert len(files(path)) == 4 and marks() == []


def test_uncommitted_and_stray_files_are_not_read(spark, tmp_path):
    path = tmp_path / "store"
    AS.log_scan(stamped(spark), str(path), "1")
    before = both(spark, str(path))
    other = path / "reports" / "write=abc" / "date=2024-01-05"
    other.mkdir(parents=True)
    (other / "0.jsonl").write_text('{"scan_id": "lost"}\n')
    assert both(spark, str(path)) == before
    # What a repeated task has left goes with the commit.
    writer = AS.AuditWriter(str(path), "2")
    for n in ("kept", "stray"):
        folder = path / "reports" / f"write={writer.id}" / "date=2024-01-08"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{n}.jsonl").write_text('{"scan_id": "%s"}\n' % n)
    writer.commit([AS.Files([f"reports/write={writer.id}/date=2024-01-08/kept.jsonl"]), None])
    got = AS.read_audit(spark, str(path)).where("date = DATE '2024-01-08'").collect()
    assert [r.scan_id for r in got] == ["kept"]


def test_empty_scan(spark, tmp_path):
    path = str(tmp_path / "store")
    AS.log_scan(stamped(spark).limit(0), path, "1")
    assert AS.read_audit(spark, path).isEmpty() and AS.read_audit(spark, path, AU.RESULTS).isEmpty()
    with pytest.raises(Exception, match="only appended"):
        AS.audit_lines(stamped(spark)).write.format(AS.FORMAT).mode("overwrite").save(path)
