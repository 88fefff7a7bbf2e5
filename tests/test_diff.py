import random

import pytest
from pyspark.sql import Window, functions as F

from keelson.config import ConfigError, Policy
from keelson.operators import diff as D, ranking
from keelson.operators.scope import monitored
from keelson.plans.integrity import integrity_scan
from keelson.schemas import MOUNTS
from keelson.session import materialise
from rows import file_row, folder_row, plan, snapshot


def kinds(findings):
    return sorted((r.kind, r.previous_path, r.path) for r in findings.collect())


def reasons(spark, before, after, policy=Policy()):
    rows = D.snapshot_changes(snapshot(spark, before), snapshot(spark, after), policy).collect()
    return list(rows[0].reasons) if rows else []


def test_unchanged_tree_is_clean(spark):
    tree = snapshot(spark, file_row("/a/x"), file_row("/a/y"), folder_row("/a"))
    scan = integrity_scan(tree, tree, Policy(("/a",)))
    assert scan.findings.count() == 0
    row = scan.summary.first()
    assert (row.directories, row.files, row.clean) == (1, 2, True)


def test_altered_new_deleted(spark):
    old = snapshot(spark, file_row("/a/x", "1"), file_row("/a/gone", "2"))
    new = snapshot(spark, file_row("/a/x", "3"), file_row("/a/new", "4"))
    assert kinds(D.integrity_diff(old, new)) == [
        ("added", None, "/a/new"), ("deleted", None, "/a/gone"), ("modified", None, "/a/x")
    ]


def test_reasons_only_compare_what_both_sides_know(spark):
    before = file_row("/f", size=1, mtime_ns=1, mode=1, uid=1, security_hash=None)
    after = file_row("/f", size=2, mtime_ns=2, mode=2, uid=2, security_hash="x")
    assert reasons(spark, before, after) == ["size", "modified_time", "permissions", "owner"]
    before = file_row("/f", security_hash="y", btime_ns=1, ctime_ns=1, gid=None)
    after = file_row("/f", security_hash="x", btime_ns=2, ctime_ns=2, gid=4)
    assert reasons(spark, before, after) == [
        "created_time", "metadata_change_time", "security_metadata"
    ]


def test_directory_size_and_times_do_not_count(spark):
    before, after = folder_row("/d", size=1, mtime_ns=1), folder_row("/d", size=9, mtime_ns=9)
    assert reasons(spark, before, after) == []
    after = folder_row("/d", size=9)[:5] + (16832,) + folder_row("/d", size=9)[6:]
    assert reasons(spark, before, after) == ["permissions"]


def test_metadata_only_ignores_content_now(spark):
    policy = Policy(metadata_rules=("/m",))
    assert reasons(spark, file_row("/m/f", "1"), file_row("/m/f", None), policy) == []
    # A path that is no longer metadata-only reports its new digest.
    assert reasons(spark, file_row("/m/f", None), file_row("/m/f", "1")) == ["checksum"]


def test_kind_change(spark):
    assert reasons(spark, file_row("/f"), file_row("/f", kind="symlink")) == ["kind"]


def move_case(spark, hosts=3, contents=4, files=60):
    """Random deletions and additions of a few contents, with the pairs by brute force."""
    rng = random.Random(7)
    old, new, expected = [], [], []
    for h in range(hosts):
        gone, fresh = {}, {}
        for i in range(files):
            name = f"/{rng.choice(['a', 'a-b', 'a/b', 'z'])}/{i:03d}"
            content = "hot" if rng.random() < 0.6 else f"c{rng.randrange(contents)}"
            side = rng.choice(["old", "new"])
            path = f"/{side}{name}"
            (old if side == "old" else new).append(file_row(path, content, f"h{h}"))
            (gone if side == "old" else fresh).setdefault(content, []).append(path)
        for content in {*gone, *fresh}:
            left = sorted(gone.get(content, []), key=lambda p: p.split("/"))
            right = sorted(fresh.get(content, []), key=lambda p: p.split("/"))
            pairs = min(len(left), len(right))
            expected += [(f"h{h}", "moved", a, b) for a, b in zip(left, right)]
            expected += [(f"h{h}", "deleted", None, p) for p in left[pairs:]]
            expected += [(f"h{h}", "added", None, p) for p in right[pairs:]]
    return snapshot(spark, *old), snapshot(spark, *new), sorted(expected, key=str)


def moves(findings):
    return sorted(
        ((r.host, r.kind, r.previous_path, r.path) for r in findings.collect()), key=str
    )


def test_moves_pair_in_path_order(spark):
    old, new, expected = move_case(spark)
    assert moves(D.integrity_diff(old, new)) == expected


def test_moves_of_hot_contents_are_the_same(spark):
    old, new, expected = move_case(spark)
    assert moves(D.integrity_diff(old, new, hot_rows=10)) == expected


def test_pairing_shuffles_its_rows_once_by_path(spark):
    old, new, _ = move_case(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = plan(D.pair_moves(materialise(D.snapshot_changes(old, new)), True)).split("\n\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in steps if x.startswith("(") and ") Exchange" in x.split("\n")[0]]
    by_path = [x for x in dealt if "after#" in x or "before#" in x]
    assert len(by_path) == 3  # added rows once, deleted rows to their pair and to their mate


def test_rows_without_checksum_never_move(spark):
    old, new = snapshot(spark, folder_row("/a")), snapshot(spark, folder_row("/b"))
    assert kinds(D.integrity_diff(old, new)) == [("added", None, "/b"), ("deleted", None, "/a")]


def test_ranks_in_ranges_equal_a_window(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
        .alias("key"),
        F.md5(F.col("id").cast("string")).alias("name"),
    )
    for keys in (["key"], []):
        for order in ("name", [F.col("name").desc()]):
            columns = [F.col(order)] if isinstance(order, str) else order
            own = F.row_number().over(Window.partitionBy(*keys).orderBy(*columns)).cast("long")
            plain = df.withColumn("rank", own)
            for part_rows in (100, 700, None):
                ranked = ranking.rank_in_groups(df, keys, order, part_rows=part_rows).select("key", "name", "rank")
                assert ranked.exceptAll(plain).isEmpty() and ranked.count() == 5000


def test_a_hot_group_spreads_over_its_ranges(spark):
    df = spark.range(4000).select(F.lit("hot").alias("key"), F.md5(F.col("id").cast("string")).alias("name"))
    ranked = ranking.rank_in_groups(df, ["key"], "name", part_rows=500)
    steps = plan(ranked)
    windows = [x for x in steps.split("\n\n") if ") Window" in x.split("\n")[0]]
    assert any("_part#" in x for x in windows)  # numbered part by part, not as one group


def test_duplicate_rows_count_once(spark):
    old = snapshot(spark, file_row("/a"), file_row("/a"))
    assert D.integrity_diff(old, snapshot(spark, file_row("/a"))).count() == 0


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    old, _, _ = move_case(spark)
    assert D.integrity_diff(old, old).isEmpty()


def test_scope_limits_both_sides(spark):
    old = snapshot(spark, file_row("/a/x"), file_row("/ab/y"))
    found = D.integrity_diff(old, snapshot(spark), scope="/a")
    assert kinds(found) == [("deleted", None, "/a/x")]


def test_policy_change_is_a_finding_or_an_error(spark):
    tree = snapshot(spark, file_row("/a"))
    config = snapshot(spark, file_row("/etc/policy.yaml", "new"))
    options = {"stored_config_hash": "old", "config_rows": config}
    scan = integrity_scan(tree, tree, **options)
    row = scan.findings.first()
    assert (row.kind, row.path, row.reasons) == ("modified", "/etc/policy.yaml", ["policy"])
    assert row.before.checksum == "old" and row.before.size is None
    assert row.after.checksum == "new"
    same = integrity_scan(tree, tree, stored_config_hash="new", config_rows=config)
    assert same.findings.isEmpty()
    with pytest.raises(ConfigError):
        integrity_scan(tree, tree, strict=True, **options)


def test_inspection_verdicts(spark):
    old = snapshot(spark, file_row("/same"), file_row("/changed", "1"), file_row("/gone"))
    new = snapshot(spark, file_row("/same"), file_row("/changed", "2"), file_row("/new"))
    asked = spark.createDataFrame(
        [("h", p) for p in ("/same", "/changed", "/gone", "/new", "/none")], "host string, path string"
    )
    rows = {r.path: r.verdict for r in D.inspect_paths(old, new, asked).collect()}
    assert rows == {
        "/same": "intact", "/changed": "compromised", "/gone": "not on disk",
        "/new": "not baselined", "/none": "unknown",
    }


def test_sweep(spark):
    old = snapshot(spark, file_row("/a"), file_row("/b"))
    assert [r.path for r in D.deleted_sweep(old, snapshot(spark, file_row("/a"))).collect()] == ["/b"]


def test_details_are_limited(spark):
    from keelson.operators.alerts import capped_details

    messages = spark.range(1002).select(
        F.lit("h").alias("host"), F.format_string("/%05d", "id").alias("path"),
        F.lit("ADDED").alias("message"),
    )
    row = capped_details(messages).first()
    assert (len(row.details), row.omitted) == (1000, 2)


def test_walk_prunes_below_excluded_mounts(spark):
    paths = ["/", "/data", "/data/m", "/data/m/ext", "/data/m/ext/f", "/data/ok", "/cache",
             "/cache/keep", "/cache/keep/f", "/cache/x"]
    tree = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    mounts = spark.createDataFrame(
        [("h", "/", "ext4"), ("h", "/data/m", "proc"), ("h", "/data/m/ext", "ext4")], MOUNTS
    )
    policy = Policy(exclusions=("/cache",), metadata_rules=("/cache/", "/cache/keep/"))
    kept = [r.path for r in monitored(tree, policy, mounts).collect()]
    assert sorted(kept) == ["/", "/cache", "/data", "/data/ok"]
    # A walk that starts below the excluded mountpoint is not pruned by it.
    inside = Policy(scan_paths=("/data/m/ext", "/cache/keep"), exclusions=("/cache",),
                    metadata_rules=("/cache/keep/",))
    kept = [r.path for r in monitored(tree, inside, mounts).collect()]
    assert sorted(kept) == ["/cache/keep", "/data/m/ext", "/data/m/ext/f"]


def test_metadata_rule_forms():
    policy = Policy(metadata_rules=("/p/*", "/q/", "/r", "/", "C:\\"))
    assert policy.metadata_roots == ["/p", "/r"]
    assert policy.metadata_directories == ["/q", "/", "C:\\"]
    with pytest.raises(ConfigError):
        Policy(exclusions=("",))


def test_only_keys_of_movable_rows_are_ranked(spark):
    before = [file_row("/a/old", "m"), file_row("/a/gone", "g"), file_row("/a/x", "1"), file_row("/a/none", None)]
    after = [file_row("/a/new", "m"), file_row("/a/come", "c"), file_row("/a/x", "2")]
    changes = D.snapshot_changes(snapshot(spark, *before), snapshot(spark, *after))
    paired = D.pair_moves(changes)
    got = {(r.kind, r.previous_path, r.path, r.before is None, r.after is None) for r in paired.collect()}
    assert got == {
        ("moved", "/a/old", "/a/new", False, False), ("deleted", None, "/a/gone", False, True),
        ("added", None, "/a/come", True, False), ("modified", None, "/a/x", False, False),
        ("deleted", None, "/a/none", False, True),
    }
    windows = [step for step in plan(paired).split("\n\n") if ") Window" in step]
    assert windows
    for step in windows:
        read = next(line for line in step.splitlines() if line.startswith("Input"))
        assert "before#" not in read and "after#" not in read and "reasons#" not in read
