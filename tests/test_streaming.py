import pytest
from pyspark.sql import Row

from keelson.config import LogAudit, LogRule, LogSource, Selector
from keelson.plans.logs import scan_lines
from keelson.schemas import AUDIT_LINES, LOG_LINES
from keelson.sinks.baseline import write_baseline
from keelson.streaming import logs as live_logs
from keelson.streaming.audit import forward_audit, parquet_sink
from keelson.streaming.logs import LogState, RunningReport, live_events, merged, stream_text
from keelson.streaming.snapshots import ARRIVING, LiveDiff
from rows import file_row, snapshot

RULE = LogRule("slow", (
    Selector("contains", "slow call", ("Slow",), risk="medium"),
    Selector("contains", "very slow", ("Very",), risk="high"),
))
SOURCE = LogSource("app", ("slow",), "table", top=50, reset="restart", group_by=r"\w+\.java")
AUDIT = LogAudit((RULE,), (SOURCE,))


def lines(n, start, file="f"):
    out = []
    for i in range(start, start + n):
        text = "restart" if i in (9, 33) else f"Slow {'Very ' if i % 4 == 0 else ''}in C{i % 3}.java {i}"
        out.append(("app", file, i + 1, text))
    return out


def test_live_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("Slow x\nfine\nVery Slow y\n")
    plain = LogAudit((RULE,), (LogSource("app", ("slow",), "table"),))
    stream = stream_text(spark, str(tmp_path / "in"), "app")
    events = live_events(stream, plain, plain.source("app"))
    query = (
        events.writeStream.format("memory").queryName("live").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.line for r in spark.table("live").collect()) == ["Slow x", "Very Slow y", "Very Slow y"]


def same(left, right):
    columns = sorted(left.columns)
    return sorted(map(str, left.select(*columns).collect())) == sorted(map(str, right.select(*columns).collect()))


def test_running_report_equals_a_batch_scan(spark, tmp_path):
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    running = RunningReport(AUDIT, SOURCE, str(tmp_path / "state"), parts=3)
    stream = spark.readStream.schema(LOG_LINES).parquet(source)
    everything, files = None, ["f", "g"]
    for batch, (n, start) in enumerate([(6, 0), (10, 6), (20, 16), (5, 36)]):
        rows = [r for f in files for r in lines(n, start, f)]
        part = spark.createDataFrame(rows, LOG_LINES)
        part.coalesce(1).write.mode("append").parquet(source)
        everything = part if everything is None else everything.unionByName(part)
        running.start(stream).awaitTermination()
        found, summary = running.report(spark)
        whole = scan_lines(everything, AUDIT, SOURCE)
        assert same(found, whole.rows)
        names = ["line_count", "match_count", "reset_occurred"]
        assert same(summary.select(*names), whole.summary.select(*names))
        if batch == 0:
            early = [r.asDict() for r in found.collect()]
        files = ["f", "g"] if batch < 2 else ["g"]  # the last batch holds one log only
    assert [r.asDict() for r in running.report(spark, batch=0)[0].collect()] == early
    changes = spark.read.parquet(str(tmp_path / "state" / "changes"))
    assert changes.filter("file = 'f'").agg({"last_at": "max"}).first()[0][0] <= 36  # nothing of it was written again
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_repeated_batch_changes_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    running = RunningReport(AUDIT, SOURCE, str(tmp_path / "state"), parts=2)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LOG_LINES).parquet(source)
    for n, start in ((5, 0), (3, 5)):
        spark.createDataFrame(lines(n, start), LOG_LINES).coalesce(1).write.mode("append").parquet(source)
        running.start(stream).awaitTermination()
    once = [r.asDict() for r in running.report(spark)[0].orderBy("position").collect()]
    changes = spark.read.parquet(str(tmp_path / "state" / "changes")).count()
    for name in ("1", ".1.crc"):  # as if the last batch had not been committed
        (tmp_path / "state" / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    running.start(stream).awaitTermination()
    assert [r.asDict() for r in running.report(spark)[0].orderBy("position").collect()] == once
    assert spark.read.parquet(str(tmp_path / "state" / "changes")).count() == changes


def test_only_wide_logs_are_cut_into_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_logs, "WIDE_LINES", 9, raising=False)
    monkeypatch.setattr(live_logs, "LINE_BLOCK", 2)
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    running = RunningReport(AUDIT, SOURCE, str(tmp_path / "state"), parts=3)
    stream = spark.readStream.schema(LOG_LINES).parquet(source)
    everything = spark.createDataFrame([], LOG_LINES)
    # f is wide from its second batch on, g never; the resets in lines 10 and 34 come in the second and fourth batch.
    for n, start, parts in ((7, 0, 1), (12, 7, 3), (8, 19, 3), (8, 27, 3)):
        rows = lines(n, start, "f") + lines(4, start, "g")
        part = spark.createDataFrame(rows, LOG_LINES)
        part.coalesce(1).write.mode("append").parquet(source)
        everything = everything.unionByName(part)
        running.start(stream).awaitTermination()
        found, summary = running.report(spark)
        whole = scan_lines(everything, AUDIT, SOURCE)
        assert same(found, whole.rows)
        names = ["line_count", "match_count", "reset_occurred"]
        assert same(summary.select(*names), whole.summary.select(*names))
        used = running.state(spark, "totals").groupBy("key.file").count().collect()
        assert dict(map(tuple, used)) == {"f": parts, "g": 1}


def test_groups_merge_in_any_order():
    old = ("a", 1, 2, [3, 0, 1], "x", [9, 0, 0], "y")
    new = ("b", 4, 1, [3, 0, 0], "z", [3, 0, 0], "z")
    assert merged(old, new) == merged(new, old) == ("b", 4, 3, [3, 0, 0], "z", [9, 0, 0], "y")


class _Held:
    """A state variable of one part, kept in memory."""

    def __init__(self):
        self.value, self.map = None, {}

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def iterator(self):
        return iter(self.map.items())

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


def test_a_part_takes_its_rows_one_by_one():
    state = LogState()
    state.totals, state.groups = _Held(), _Held()
    names = ["lines", "reset", "key", "description", "risk", "line", "line_no", "rule_idx", "selector_idx"]
    row = Row(*names)
    event = lambda n, key, risk=1: row(0, None, key, "d", risk, f"line {n}", n, 0, 0)
    nothing = [None] * 7

    def run(*rows):
        return [r.asDict() for r in state.handleInputRows(("app", "f", 0), iter(rows), None)]

    got = run(event(9, "b"), event(4, "a", 3), row(12, 3, *nothing), event(2, "a"), event(7, "a"))
    assert {(r["key"], r["count"], r["risk"], r["first_line"], r["last_line"]) for r in got} == {
        ("a", 2, 3, "line 4", "line 7"), ("b", 1, 1, "line 9", "line 9")}
    assert state.totals.value == (12, 3)
    assert run(row(2, 8, *nothing)) == [] and set(state.groups.map) == {("b",)}
    assert run(event(8, "b"), event(11, "b"))[0]["count"] == 2 and state.totals.value == (14, 8)


def test_a_task_counts_each_log_once(spark):
    running = RunningReport(AUDIT, SOURCE, "unused", parts=3)
    rows = spark.createDataFrame([r for k in range(5) for f in "fg" for r in lines(10, 10 * k, f)], LOG_LINES).coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        found = running._totals(rows).collect()
    finally:
        spark.conf.set(name, before)
    assert len(found) == 2 * 3 and {(r.part, r.lines, r.reset) for r in found} == {(0, 50, 34), (1, 0, 34), (2, 0, 34)}


def arriving(spark, *scans):
    """Rows of (host, scan, size of the scan, files)."""
    rows = [(*file_row(path, digest, host), scan, n) for host, scan, n, files in scans for path, digest in files]
    return spark.createDataFrame(rows, ARRIVING)


def test_live_diff_waits_for_whole_scans(spark, tmp_path):
    base = str(tmp_path / "base")
    old = snapshot(spark, file_row("/a", "1"), file_row("/b", "2"), *[file_row(f"/{p}", p, "other") for p in "xyz"])
    write_baseline(old, base)
    live = LiveDiff(base, str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(ARRIVING).parquet(str(tmp_path / "in"))
    batches = [
        arriving(spark, ("h", "s1", 2, [("/a", "9"), ("/c", "2")]), ("other", "s1", 3, [("/x", "x")])),
        arriving(spark, ("other", "s1", 3, [("/y", "new")])),
        arriving(spark, ("other", "s1", 3, [("/z", "z")]), ("h", "s2", 1, [("/a", "1")])),
    ]
    found = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
        found.append({(r.batch_id, r.host, r.kind, r.path) for r in live.findings(spark).collect()})
    first = {(0, "h", "modified", "/a"), (0, "h", "moved", "/c")}
    assert found[0] == found[1] == first
    assert found[2] == first | {(2, "other", "modified", "/y"), (2, "h", "deleted", "/b")}
    live.process(batches[2], 2)  # repeated after a failure
    assert {(r.batch_id, r.host, r.kind, r.path) for r in live.findings(spark).collect()} == found[2]
    with pytest.raises(ValueError, match="missing"):
        live.process(batches[2], 9)


def broken(batch, batch_id):
    raise OSError("sink is down")


def test_audit_forwarding(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], AUDIT_LINES).coalesce(1).write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema(AUDIT_LINES).parquet(str(tmp_path / "in"))
    kept = parquet_sink(str(tmp_path / "out"))
    forward_audit(stream, [broken, kept], str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out") + "/batch=*").count() == 2
    with pytest.raises(Exception, match="audit forwarding failed"):
        forward_audit(stream, [broken], str(tmp_path / "c2"), required=True).awaitTermination()
