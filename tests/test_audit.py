import hashlib
import json

import pytest
from pyspark.sql import functions as F

from keelson.operators import audit as A
from keelson.schemas import AUDIT_EVENTS, AUDIT_LINES
from keelson.sources.snapshots import read_audit


def events(spark, n, log="a", start=0):
    rows = [
        (log, i, 1000 + i, "scan", 7, [("issues", str(i)), ("note", 'a "b"\\c\n\t\x01\x7f')])
        for i in range(start, start + n)
    ]
    return spark.createDataFrame(rows, AUDIT_EVENTS)


def verdict(lines):
    return A.verify_audit(lines).first()


def edited(lines, seq, old, new):
    return lines.withColumn(
        "line", F.when(F.col("seq") == seq, F.replace("line", F.lit(old), F.lit(new)))
        .otherwise(F.col("line")),
    )


def test_chain_links_and_hashes(spark):
    lines = [r.line for r in A.chain_audit(events(spark, 3)).orderBy("seq").collect()]
    previous = A.GENESIS
    for line in lines:
        record = json.loads(line)
        assert record["previous_hash"] == previous
        body = line[: line.rindex(',"hash":"')] + "}"
        assert record["hash"] == hashlib.sha256(body.encode()).hexdigest()
        previous = record["hash"]
    assert json.loads(lines[0])["note"] == 'a "b"\\c\n\t\x01\x7f'
    assert "\\u0001" in lines[0] and "\\u007f" in lines[0]


def test_intact_chain(spark):
    lines = A.chain_audit(events(spark, 5).unionByName(events(spark, 2, "b")))
    rows = {r.log_id: r for r in A.verify_audit(lines).collect()}
    assert (rows["a"].events, rows["b"].events) == (5, 2)
    assert rows["a"].bad_line is None
    last = lines.filter("log_id = 'a' and seq = 4").first().line
    assert rows["a"].last_hash == json.loads(last)["hash"]


def test_chain_continues(spark):
    first = A.chain_audit(events(spark, 3))
    heads = A.verify_audit(first).select("log_id", "last_hash")
    more = A.chain_audit(events(spark, 2, start=3), heads)
    assert verdict(first.unionByName(more)).events == 5
    fresh = A.chain_audit(events(spark, 2, "new"), heads)
    assert verdict(fresh).bad_line is None


@pytest.mark.parametrize("block", [2, 65_536])
def test_edited_line(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_LINES", block)
    lines = edited(A.chain_audit(events(spark, 9)), 5, '"issues":"5"', '"issues":"6"')
    row = verdict(lines)
    assert (row.events, row.bad_line, row.cause) == (5, 5, "hash mismatch")


@pytest.mark.parametrize("block", [2, 65_536])
def test_lost_line(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_LINES", block)
    row = verdict(A.chain_audit(events(spark, 9)).filter("seq not in (3, 4)"))
    assert (row.events, row.bad_line, row.cause) == (3, 5, "chain mismatch")


@pytest.mark.parametrize(
    "old, new, cause",
    [
        ('"previous_hash"', '"before"', "missing previous_hash"),
        (',"hash":"', ',"sum":"', "missing hash"),
        ('"}', '"} ', "unsupported hash layout"),
    ],
)
def test_broken_layouts(spark, old, new, cause):
    row = verdict(edited(A.chain_audit(events(spark, 4)), 2, old, new))
    assert (row.events, row.bad_line, row.cause) == (2, 2, cause)


def test_forged_start(spark):
    row = verdict(A.chain_audit(events(spark, 4)).filter("seq > 0"))
    assert (row.events, row.bad_line, row.cause, row.last_hash) == (0, 1, "chain mismatch", A.GENESIS)


def test_blank_lines_keep_their_number(spark, tmp_path):
    lines = [r.line for r in A.chain_audit(events(spark, 3)).orderBy("seq").collect()]
    (tmp_path / "audit.log").write_text("\n".join([lines[0], "", lines[1], "x"]) + "\n")
    row = verdict(read_audit(spark, str(tmp_path / "audit.log"), "a"))
    assert (row.events, row.bad_line, row.cause) == (2, 4, "missing previous_hash")


def test_unescaping(spark):
    df = spark.createDataFrame(
        [(r'{"k":"a\"b\\n\n\/","x":"1"}',), ('{"k":"open',), ("{}",), ('{"k":""}',)], "line string"
    )
    assert [r[0] for r in df.select(A.json_text("line", "k")).collect()] == [
        'a"b\\n\n/', None, None, ""
    ]


def test_task_functions_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from keelson.sources import tree
    from keelson.streaming import logs

    event = {"timestamp_unix_ms": 1, "action": "a", "pid": 2, "fields": None}
    shipped = cloudpickle.dumps((A._seal, tree.TreeSource, tree.plan_folders, logs.LogState))
    code = (
        "import pickle, sys; seal, *rest = pickle.load(sys.stdin.buffer);"
        f"print(seal({event!r}, 'x')[1]); assert 'keelson' not in sys.modules"
    )
    done = subprocess.run([sys.executable, "-c", code], input=shipped, cwd=tmp_path,
                          capture_output=True, check=True)
    assert done.stdout.decode().strip() == A._seal(event, "x")[1]


def test_blocks_of_one_log_are_verified_by_many_tasks(spark):
    lines = spark.createDataFrame([], AUDIT_LINES)
    plan = A.verify_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan.split("Window")[1]
    # Lines were read once, into a table of hashes, and that table is dealt out once as a whole.
    assert "regexp" not in plan and "sha2" not in plan
    assert sum("previous_hash" in x for x in plan.split("Exchange hashpartitioning")[1:]) <= 2


@pytest.mark.parametrize("local", [True, False])
def test_every_log_is_a_file(spark, tmp_path, monkeypatch, local):
    from keelson.sinks import logs

    if not local:
        monkeypatch.setattr(logs, "_local", lambda spark, path: None)
    sizes = {str(k): k % 7 + 1 for k in range(40)} | {"a/b=c d": 3}
    every = None
    for n in set(sizes.values()):
        named = F.explode(F.array(*[F.lit(k) for k, m in sizes.items() if m == n]))
        some = events(spark, n).withColumn("log_id", named)
        every = some if every is None else every.unionByName(some)
    chained = A.chain_audit(every)
    path = str(tmp_path / "logs")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4")
        logs.write_logs(chained, path)
    finally:
        spark.conf.set(name, before)
    lines = read_audit(spark, path)
    assert lines.select("log_id").distinct().count() == len(sizes)
    found = lines.withColumn("log_id", F.regexp_extract("log_id", "/log_id=([^/.]+)[/.]", 1)).filter("log_id RLIKE '^[0-9]+$'")
    assert {(r.log_id, r.events, r.bad_line) for r in A.verify_audit(found).collect()} == {
        (k, n, None) for k, n in sizes.items() if k.isdigit()}
    expected = chained.select("log_id", (F.col("seq") + 1).alias("seq"), "line").filter("log_id RLIKE '^[0-9]+$'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    assert not any(p.name.startswith("_") and p.name != "_SUCCESS" for p in (tmp_path / "logs").rglob("*"))
