import pytest
from pyspark.sql import functions as F

from keelson.config import ConfigError, LogAudit, LogRule, LogSource, Selector
from keelson.functions import text as X
from keelson.operators import logreport as R
from keelson.operators.rules import match_events, register_selector, selector_test
from keelson.plans.logs import scan_all_logs, scan_lines, scan_logs
from keelson.sources.logs import read_journal, read_log
from rows import log

ERRORS = LogRule("errors", (Selector("contains", "Error found", ("Error",), risk="high",
                                     proceed=False),), "Error rule.")
WARNINGS = LogRule("warnings", (Selector("contains", "Warning found", ("Warning",)),), "Warning rule.")
CARDS = LogRule("creditcard", (Selector("creditcard", "cc"),), "Cards.")


def scan(spark, lines, rules, **options):
    source = LogSource("app", tuple(r.name for r in rules), "table", **options)
    return scan_lines(log(spark, *lines), LogAudit(tuple(rules), (source,)), source)


def hits(spark, selector, *lines):
    rows = log(spark, *lines).filter(selector_test(selector)).orderBy("line_no").collect()
    return [r.line for r in rows]


def test_errors_and_masked_cards(spark):
    result = scan(spark, ["ok", "Error here", "card 4111111111111111"], [ERRORS, CARDS])
    summary = result.report.first()
    assert (summary.line_count, summary.match_count) == (3, 2)
    assert "card XXXX XXXX XXXX XXXX" in summary.report
    assert "4111111111111111" not in summary.report


def test_simple_report_follows_rule_order(spark):
    text = scan(spark, ["Error and Warning"], [WARNINGS, ERRORS]).report.first().report
    assert text.index("Rule: warnings - Warning rule.") < text.index("Rule: errors - Error rule.")


def test_no_match_report(spark):
    result = scan(spark, ["fine"], [ERRORS], description="my log")
    assert result.report.first().report == "No failures for my log"


def test_regex_and_one_of(spark):
    rule = LogRule("mixed", (
        Selector("regex", "r", (r"^ERR[0-9]+",), ("ignored",)),
        Selector("one_of", "o", ("alpha", "beta")),
    ))
    result = scan(spark, ["ERR12 alpha", "beta", "ERR1 ignored"], [rule])
    assert result.summary.first().match_count == 3


def test_contains_needs_all_and_no_excluded(spark):
    lock = Selector("contains", "", ("Locker",), ("Locker Key",))
    assert hits(spark, lock, "Locker open", "Locker Key", "locker") == ["Locker open"]
    both = Selector("contains", "", ("a", "b"), ("c",))
    assert hits(spark, both, "ab", "a", "abc") == ["ab"]


def test_insensitive_folds_needles_and_line(spark):
    lock = Selector("contains", "", ("Locker",), ("locker key",), insensitive=True)
    assert hits(spark, lock, "LOCKER", "LOCKER KEY") == ["LOCKER"]


def test_cards(spark):
    card = Selector("creditcard")
    lines = [
        "4111111111111111", "4111111111111112", "41111111111111111",
        "4111-1111.1111 1111", "order 12 4111111111111111", "x4111111111111111y",
        "٤١١١١١١١١١١١١١١١",
    ]
    assert hits(spark, card, *lines) == [lines[0], lines[3], lines[5]]
    shown = log(spark, *lines).select(X.mask_cards("line").alias("l")).collect()
    assert [r.l for r in shown][2:4] == ["XXXX XXXX XXXX XXXX", "4111-1111.1111 1111"]


def test_terminating_selector_ends_its_rule_only(spark):
    first = LogRule("first", (
        Selector("contains", "one", ("x",), proceed=False),
        Selector("contains", "two", ("x",)),
    ))
    second = LogRule("second", (Selector("contains", "three", ("x",), risk="none"),))
    result = scan(spark, ["x"], [first, second])
    assert [r.selector_desc for r in result.events.orderBy("rule_idx").collect()] == ["one", "three"]


def test_trim_prefix(spark):
    def trimmed(line, pattern):
        return log(spark, line).select(X.trim_prefix("line", pattern).alias("l")).first().l

    assert trimmed("[123] payload", r"^\[[0-9]+\] ") == "payload"
    assert trimmed("12:30 INFO x INFO y", "INFO ") == "x INFO y"
    assert trimmed("nothing", "zzz") == "nothing"
    assert trimmed("same", "(") == "same"
    assert trimmed("same", "") == "same"


def test_trimmed_before_grouping_and_reset(spark):
    rule = LogRule("slow", (Selector("contains", "Slow call", ("Slow",), risk="medium"),))
    result = scan(
        spark,
        ["WARN [001] (Old.java:1) Slow before restart", "INFO Service restarted",
         "WARN [002] (New.java:2) Slow after restart", "WARN [003] (New.java:2) Slow again"],
        [rule], top=10, reset="Service restarted", trim_prefix=r"^\w+ \[[0-9]+\] ",
        group_by=r"\(.*?\.java\:.*?\)",
    )
    row = result.report.first()
    assert (row.line_count, row.match_count, row.reset_occurred) == (4, 2, True)
    assert row.report == (
        "Encountered reset marker in logs, discarded prior logs.\n\n"
        "Slow call (New.java:2) (occurred: 2)\n"
        "  FIRST line: 3 (New.java:2) Slow after restart\n"
        "  LAST 4 (New.java:2) Slow again\n"
    )


def test_reset_without_matches_behind_it(spark):
    rule = LogRule("slow", (Selector("contains", "Slow call", ("Slow",)),), group_by="x")
    row = scan(spark, ["Slow", "restart"], [rule], reset="restart").report.first()
    assert (row.report, row.match_count) == ("No problems found", 0)


def test_stored_events_give_the_same_results(spark):
    test_trimmed_before_grouping_and_reset(spark)
    test_errors_and_masked_cards(spark)
    test_reset_without_matches_behind_it(spark)


def test_grouping_of_the_first_rule_that_has_one(spark):
    rule = LogRule("frequency", (Selector("contains", "Java line", (".java",), risk="low"),),
                   group_by=r"\(.*?\.java\:.*?\)")
    lines = ["INFO (Worker.java:10) .java first", "INFO (Worker.java:10) .java second",
             "INFO (Other.java:20) .java third"]
    text = scan(spark, lines, [ERRORS, rule]).report.first().report
    assert "Java line (Worker.java:10) (occurred: 2)" in text
    assert "Java line (Other.java:20) (occurred: 1)" in text
    assert text.index("Worker") < text.index("Other")


def test_group_key_may_be_empty_or_the_description(spark):
    rule = LogRule("r", (Selector("contains", "desc", ("a",)),))
    rows = scan(spark, ["ab", "a1"], [rule], group_by="[0-9]*$").rows.collect()
    assert sorted(r.key for r in rows) == ["", "1"]
    rows = scan(spark, ["ab"], [rule], group_by="[0-9]").rows.collect()
    assert rows[0].key == "desc" and rows[0]["last"] is None


def test_top_keeps_the_first_events_and_lists_them_by_risk(spark):
    rule = LogRule("r", (
        Selector("contains", "high", ("H",), risk="high"),
        Selector("contains", "low", ("L",), risk="low"),
    ))
    result = scan(spark, ["H1", "L1", "H2", "L2"], [rule], top=3)
    assert [r.line for r in result.rows.orderBy("position").collect()] == ["L1", "H1", "H2"]
    assert result.summary.first().match_count == 4


def test_large_top_is_numbered_in_ranges(spark, monkeypatch):
    from keelson.operators import ranking

    monkeypatch.setattr(ranking, "PART_ROWS", 1000)
    events = spark.range(6000).select(
        F.lit("s").alias("source"), F.lit("f").alias("file"), F.col("id").alias("line_no"),
        F.lit(0).alias("rule_idx"), F.lit(0).alias("selector_idx"),
    )
    kept = R.first_rows(events, ["source"], [F.col(c) for c in R.ARRIVAL], 2500)
    assert kept.agg(F.count("*"), F.max("line_no"), F.max("position")).first()[:] == (2500, 2499, 2500)


def test_rejected_configurations():
    with pytest.raises(ConfigError):
        LogAudit((ERRORS,), (LogSource("a", ("nope",), "table"),))
    twice = LogSource("a", ("errors",), "table")
    with pytest.raises(ConfigError):
        LogAudit((ERRORS,), (twice, twice))
    for bad in ({"kind": "file"}, {"kind": "docker", "path": "/x"}, {"kind": "table", "name": "a b"}):
        with pytest.raises(ConfigError):
            LogSource(**{"name": "a", **bad})
    with pytest.raises(ConfigError):
        Selector("contains", risk="awful")


def test_choosing_a_source():
    app = LogSource("app", ("errors",), path="/var/log/app.log")
    audit = LogAudit((ERRORS, WARNINGS), (app,))
    assert audit.choose("app") == app
    assert audit.choose("app", "/tmp/x").path == "/tmp/x"
    assert audit.choose(path="/tmp/x").rules == ("errors",)
    virtual = audit.choose("warnings", "/tmp/x")
    assert (virtual.name, virtual.rules, virtual.top, virtual.reset) == ("Virtual", ("warnings",), 1000, None)
    for wrong in ({"name": "warnings"}, {"name": "none"}, {}):
        with pytest.raises(ConfigError):
            audit.choose(**wrong)
    several = LogAudit((ERRORS,), (app, LogSource("b", ("errors",), path="/b")))
    with pytest.raises(ConfigError):
        several.choose(path="/tmp/x")


@pytest.mark.parametrize("pattern", [r"a(?=b)", r"(a)\1", r"(?<!x)y", r"a++", "(", r"\Qa\E", "(?-u)a"])
def test_patterns_outside_the_dialect(spark, pattern):
    with pytest.raises(X.PatternError):
        X.java_pattern(pattern)


def test_pattern_dialect(spark):
    def found(pattern, line):
        return log(spark, line).select(X.matches("line", pattern).alias("m")).first().m

    assert found(r"^\d+$", "٤١")
    assert found(r"(?P<word>\w+)é", "caféé")
    assert found("[[:alpha:]]+", "ab") and not found("[[:alpha:]]", "é")
    assert found(r"(?i)ÉA", "éa")
    assert found("a.b", "a\rb")
    assert found(r"^[*+]+$", "*+") and found(r"a\++", "a++") and found(r"f\(?=", "f=")
    assert found("[^[:space:]]x", "yx") and not found("[^[:space:]]x", " x")


def test_registered_selector(spark):
    register_selector("longer", lambda s, line: F.length(line) > int(s.match[0]),
                      lambda line: F.substring(line, 1, 3))
    rule = LogRule("long", (Selector("longer", "long line", ("5",)),))
    assert [r.line for r in scan(spark, ["abc", "abcdefgh"], [rule]).events.collect()] == ["abc"]


def test_text_lines_are_numbered_across_splits(spark, tmp_path):
    total = 23_000
    with open(tmp_path / "a.log", "w", newline="") as out:
        for i in range(1, total + 1):
            out.write(f"line {i}" + ("\r\n" if i % 3 else "\n"))
    (tmp_path / "b.log").write_text("line 1\nline 2\rstill 2\nline 3")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        lines = read_log(spark, str(tmp_path), "s")
        wrong = lines.filter(
            F.regexp_extract("line", "^line ([0-9]+)", 1).cast("long") != F.col("line_no")
        )
        assert lines.count() == total + 3
        assert wrong.count() == 0
        assert lines.filter(F.col("line").endswith("\r")).count() == 0
        assert lines.filter("line = 'line 2\rstill 2'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "app.log").write_text("Error 1\nfine\nWarning\n")
    audit = LogAudit((ERRORS, WARNINGS), (
        LogSource("app", ("errors", "warnings"), path=str(tmp_path / "app.log")),
        LogSource("absent", ("errors",), path=str(tmp_path / "absent.log")),
    ))
    reports = scan_all_logs(spark, audit).collect()
    assert [(r.source, r.line_count, r.match_count) for r in reports] == [("app", 3, 2)]
    one = scan_logs(spark, audit, "warnings", str(tmp_path / "app.log")).summary.first()
    assert (one.source, one.match_count) == ("Virtual", 1)


def test_journal(spark, tmp_path):
    (tmp_path / "j.json").write_text(
        '{"MESSAGE":"b","_SYSTEMD_UNIT":"u","_HOSTNAME":"h","__REALTIME_TIMESTAMP":"1700000002000000"}\n'
        '{"MESSAGE":"a","_SYSTEMD_UNIT":"u","_HOSTNAME":"h","__REALTIME_TIMESTAMP":"1700000001000000"}\n'
        '{"MESSAGE":"c","_SYSTEMD_UNIT":"v","_HOSTNAME":"h","__REALTIME_TIMESTAMP":"1700000003000000"}\n'
        '{"MESSAGE":"d","CONTAINER_NAME":"web","_HOSTNAME":"h","__REALTIME_TIMESTAMP":"1700000004000000"}\n'
    )
    path = str(tmp_path / "j.json")

    def lines(**options):
        rows = read_journal(spark, path, "j", **options).orderBy("line_no").collect()
        return [(r.line_no, r.line) for r in rows]

    assert lines() == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert lines(unit="u") == [(1, "a"), (2, "b")]
    assert lines(container="web") == [(1, "d")]
    assert lines(since="2023-11-14 22:13:22") == [(1, "b"), (2, "c"), (3, "d")]


def test_journal_of_a_large_host(spark, tmp_path, monkeypatch):
    from keelson.operators import ranking

    monkeypatch.setattr(ranking, "PART_ROWS", 3)
    test_journal(spark, tmp_path)


def test_matching_does_not_shuffle(spark):
    source = LogSource("app", ("errors", "creditcard"), "table")
    events = match_events(log(spark, "x"), source, [ERRORS, CARDS])
    assert "Exchange" not in events._jdf.queryExecution().executedPlan().toString()


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    from keelson.sources.logs import read_log

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for k in range(40):
        (tmp_path / f"source={k}").mkdir()
        (tmp_path / f"source={k}" / "a.txt").write_text(f"first {k}\nsecond\n")
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        assert read_log(spark, str(tmp_path), "s").count() == 80
        assert int(spark.conf.get(name)) == 8 * spark.sparkContext.defaultParallelism
        spark.conf.set(name, "5")  # a user's own value stays
        read_log(spark, str(tmp_path), "s")
        assert spark.conf.get(name) == "5"
    finally:
        spark.conf.set(name, before)


def test_small_files_are_numbered_as_they_are_read(spark, tmp_path):
    from keelson.sources.logs import joined_parts

    contents = [b"a\nb\r\n\n\nc", b"one\n", b"\n", b"\r\nx\ry\n\n", b"\xef\xbb\xbfmarked\nodd \xff\xfe\n", b"", "\u00e9\u20ac\n".encode()]
    for k in range(70):
        (tmp_path / f"{k:02d}.log").write_bytes(contents[k % len(contents)] + b"".join(b"%d\n" % i for i in range(k // 7)))
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.files.openCostInBytes": None}
    before = {n: spark.conf.get(n) for n in names}

    def read(cost):
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        rows = read_log(spark, str(tmp_path), "s").select("file", "line_no", F.hex("line"))
        return sorted(map(tuple, rows.collect()))

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        counted = read("1")  # every file counts as one that may be split
        assert read("4m") == counted
        assert len(counted) > 300
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a part for each file
        files = joined_parts(spark.read.text(str(tmp_path)))
        assert files.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism < 70
        assert files.count() == spark.read.text(str(tmp_path)).count()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
