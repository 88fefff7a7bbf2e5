import json

import pytest
from pyspark.sql import functions as F

from keelson.config import Policy
from keelson.operators import fingerprint as P
from keelson.operators.diff import integrity_diff, policy_finding
from keelson.schemas import BASELINE_MANIFEST
from keelson.plans.review import accept_stored, apply_stored
from keelson.sinks import baseline as B, review as W
from keelson.sources.tree import read_tree
from rows import file_row, plan, snapshot


def test_generations(spark, tmp_path):
    path = str(tmp_path / "base")
    with pytest.raises(FileNotFoundError):
        B.read_baseline(spark, path)
    assert B.write_baseline(snapshot(spark, file_row("/a"), file_row("/a"), file_row("/b")), path) == 1
    assert B.write_baseline(snapshot(spark, file_row("/c")), path, "cc", 7) == 2
    assert [r.path for r in B.read_baseline(spark, path, verify=True).collect()] == ["/c"]
    assert B.read_baseline(spark, path, generation=1, verify=True).count() == 2
    manifest = B.read_manifests(spark, path).orderBy("generation").collect()
    assert [(m.generation, m.records, m.scan_byte_limit, m.config_hash) for m in manifest] == [
        (1, 2, 0, None), (2, 1, 7, "cc")]
    with pytest.raises(FileNotFoundError):
        B.read_baseline(spark, path, generation=9)
    with pytest.raises(Exception, match="older than the required 5"):
        B.read_baseline(spark, path, minimum=5)


def test_next_baseline_from_the_stored_one(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark, file_row("/a")), path)
    grown = B.read_baseline(spark, path).unionByName(snapshot(spark, file_row("/b")))
    assert B.write_baseline(grown, path) == 2
    assert B.read_baseline(spark, path, verify=True).count() == 2


def test_accept_and_apply_to_the_stored_baseline(spark, tmp_path):
    path = str(tmp_path / "base")
    with pytest.raises(FileNotFoundError):
        accept_stored(spark, path, snapshot(spark), "/a")
    B.write_baseline(snapshot(spark, file_row("/a/x"), file_row("/a/y"), file_row("/b/z")), path, "c1", 8)
    now = snapshot(spark, file_row("/a/x", "new"), file_row("/b/z", "new"), file_row("/b/w"))
    limit = Policy(scan_byte_limit=8)
    with pytest.raises(ValueError, match="scan_byte_limit 8"):
        accept_stored(spark, path, now, "/a")
    assert accept_stored(spark, path, now, "/a", limit) == 2
    rows = {(r.path, r.checksum) for r in B.read_baseline(spark, path, verify=True).collect()}
    assert rows == {("/a/x", "new"), ("/b/z", "aa")}
    assert B.newest_manifest(spark, path)["config_hash"] == "c1"

    def reviewed(*paths):
        found = integrity_diff(B.read_baseline(spark, path), now).unionByName(policy)
        sure = F.col("path").isin(*paths)
        return found.withColumns({
            "state": F.when(sure, "approved").otherwise("unreviewed"),
            "action": F.when(sure, "approve").otherwise("none")})

    policy = policy_finding(snapshot(spark, file_row("/etc/policy", "c2")), "c1")
    with pytest.raises(ValueError, match="scan_byte_limit 8"):
        apply_stored(spark, path, now, reviewed("/b/z"), "c2")
    assert apply_stored(spark, path, now, reviewed("/b/z"), "c2", limit) == 3
    rows = {(r.path, r.checksum) for r in B.read_baseline(spark, path, verify=True).collect()}
    assert rows == {("/a/x", "new"), ("/b/z", "new")}
    assert B.newest_manifest(spark, path)["config_hash"] == "c1"
    with pytest.raises(ValueError, match="configuration hash is not given"):
        apply_stored(spark, path, now, reviewed("/etc/policy"), None, limit)
    assert apply_stored(spark, path, now, reviewed("/etc/policy", "/b/w"), "c2", limit) == 4
    last = B.newest_manifest(spark, path)
    assert (last["config_hash"], last["scan_byte_limit"], last["records"]) == ("c2", 8, 3)


def test_uncommitted_generation_is_invisible(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark, file_row("/a")), path)
    snapshot(spark, file_row("/torn")).write.parquet(f"{path}/records/generation=2")
    assert [r.path for r in B.read_baseline(spark, path).collect()] == ["/a"]
    assert B.write_baseline(snapshot(spark, file_row("/b")), path) == 2
    assert [r.path for r in B.read_baseline(spark, path, verify=True).collect()] == ["/b"]


def test_tampered_records_are_noticed(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark, file_row("/a"), file_row("/b")), path, "cc")
    snapshot(spark, file_row("/a"), file_row("/b", "changed")).write.mode("overwrite").parquet(
        f"{path}/records/{B.newest_manifest(spark, path)['folder']}/bucket=7")
    with pytest.raises(ValueError, match="content_hash"):
        B.read_baseline(spark, path, verify=True)
    one = snapshot(spark, file_row("/a")).withColumn("generation", F.lit(1).cast("long"))
    rows = P.verify_baseline(one, B.read_manifests(spark, path), ["generation"], 9, "dd").first()
    assert rows.mismatches == ["record_count", "scan_byte_limit", "config_hash", "content_hash"]


def test_fingerprint_ignores_order_and_counts_repeats(spark):
    def mark(*rows):
        return P.fingerprint(snapshot(spark, *rows)).first()

    a, b = file_row("/a"), file_row("/b", None)
    assert mark(a, b) == mark(b, a)
    assert mark(a, b) != mark(a, b, b)
    assert mark(file_row("/a", None)) != mark(file_row("/a", ""))
    assert mark().records == 0


def test_fingerprint_shuffles_sums_only(spark):
    rows = snapshot(spark, *[file_row(f"/{i}") for i in range(40)])
    steps = plan(P.fingerprint(rows)).split("\n\n")
    dealt = [x for x in steps if "Exchange" in x.split("\n")[0] and "Input" in x]
    assert dealt and all("digest" not in x.split("Arguments")[0].lower() for x in dealt)
    whole = P.fingerprint(rows).first()
    assert P.fingerprint(rows.repartition(7)).first() == whole
    added = rows.withColumn("_digest", P.row_digest()).agg(*[c.alias(n) for n, c in P.sums().items()]).first().asDict()
    assert P.content_hash(added) == whole.content_hash and P.EMPTY == P.fingerprint(rows.limit(0)).first().content_hash


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "base")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: B.write_baseline(snapshot(spark, file_row(f"/{i}")), path), range(4)))
    assert sorted(got) == [1, 2, 3, 4]
    assert {r.path for g in got for r in B.read_baseline(spark, path, g, verify=True).collect()} == {"/0", "/1", "/2", "/3"}
    assert not B.claim(spark, path, 4, "another") and B.claim(spark, path, 9, "another")
    assert B.write_baseline(snapshot(spark, file_row("/a")), path) == 10  # 9 was claimed and never published
    assert B.newest_manifest(spark, path)["generation"] == 10


def test_a_lookup_of_hosts_reads_their_folders(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark, *[file_row(f"/{i}", host=f"h{i % 40}") for i in range(400)]), path)
    asked = spark.createDataFrame([("h3",), ("h7",), ("none",)], "host string")
    found = B.read_baseline(spark, path, hosts=asked)
    assert {r.host for r in found.collect()} == {"h3", "h7"} and found.count() == 20
    read = {f for f in found.inputFiles()}
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 40
    scan = plan(found)
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("\n")[0]


def test_empty_baseline_agrees_with_its_manifest(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark), path)
    assert B.read_baseline(spark, path, verify=True).isEmpty()


def test_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark, *[file_row(f"/{i:05d}") for i in range(500)]), path)
    found = B.read_baseline(spark, path).filter("host = 'h' and path = '/00042'").select("checksum")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(path,/00042)" in plan and "EqualTo(host,h)" in plan
    assert "security_hash" not in plan


def test_manifest_without_a_field_fails(spark, tmp_path):
    path = str(tmp_path / "base")
    broken = spark.sql("select 1L generation, 2L records").write
    broken.parquet(f"{path}/manifest/1")
    with pytest.raises(Exception, match="manifest without"):
        B.read_manifests(spark, path).collect()


def test_next_generation_starts_at_one_and_never_wraps(spark):
    def following(*values):
        rows = [(v, 0, 0, 0, None, "") for v in values]
        return B.next_generation(spark.createDataFrame(rows, BASELINE_MANIFEST)).first()[0]

    assert (following(), following(4, 2), following(2**63 - 1)) == (1, 5, 2**63 - 1)


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "base")
    B.write_baseline(snapshot(spark, file_row("/a")), path, "cc")
    record = json.loads(B.checkpoint(B.read_manifests(spark, path), path).first().checkpoint)
    assert (record["records"], record["generation"], record["config_hash"]) == (1, 1, "cc")
    assert record["created_utc"].endswith(" UTC") and len(record["manifest_hash"]) == 64


def test_config_drift(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "host string, config_hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "host string, current_config_hash string")
    drift = B.config_drift(stored, now)
    assert {r.host: r.status for r in drift.collect()} == {"a": "ok", "b": "drift", "c": "unrecorded"}
    with pytest.raises(Exception, match="changed since the baseline on b"):
        B.strict_drift(drift).collect()


def test_review_sessions(spark, tmp_path):
    path = str(tmp_path / "reviews")
    assert W.latest_session(spark, path) is None
    found = integrity_diff(snapshot(spark, file_row("/a", "1")), snapshot(spark, file_row("/a", "2")))
    W.write_review(found, path, "2024-01-01")
    W.write_review(found.limit(0), path, "2024-01-02")
    assert [(r.session_id, r.status, r.modified) for r in W.list_sessions(spark, path).collect()] == [
        ("2024-01-01", "in_progress", 1), ("2024-01-02", "clean", 0)]
    latest, actions = W.read_review(spark, path)
    assert latest.isEmpty() and actions.isEmpty()
    first, _ = W.read_review(spark, path, "2024-01-01")
    row = first.first()
    assert (row.path, row.before.checksum, row.after.checksum) == ("/a", "1", "2")
    W.export_review(spark, path, "2024-01-01", str(tmp_path / "out"))
    exported = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert "created_ns" not in exported["before"]


def test_findings_list(spark, tmp_path):
    old = snapshot(spark, file_row("/m", "1"), file_row("/d", "2"), file_row("/old", "7"))
    new = snapshot(spark, file_row("/m", "9"), file_row("/a", "3"), file_row("/new", "7"))
    target = str(tmp_path / "list")
    W.write_findings_tsv(integrity_diff(old, new), target)
    back = sorted((r.kind, r.path) for r in W.read_findings_tsv(spark, target).collect())
    assert back == [("added", "/a"), ("added", "/new"), ("deleted", "/d"), ("deleted", "/old"),
                    ("modified", "/m")]
    lines = spark.createDataFrame([("# note",), ("",), ("ADDED\t/x",)], "value string")
    assert W.parse_findings_tsv(lines).first()[:] == ("added", "/x")
    for bad in ("NEW\t/x", "ADDED /x"):
        with pytest.raises(Exception, match="finding kind|expected KIND"):
            W.parse_findings_tsv(spark.createDataFrame([(bad,)], "value string")).collect()


def test_tree(spark, tmp_path):
    import hashlib

    root = tmp_path / "root"
    for name, text in {"a/one.txt": "1", "a/b/two.txt": "22", "skip/x": "x", "meta/m": "mm",
                       "big.bin": "0123456789"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "link").symlink_to("a/one.txt")
    policy = Policy(
        scan_paths=(str(root), str(root / "absent")), exclusions=(str(root / "skip"),),
        metadata_rules=(str(root / "meta"), f"{root}/skip/"), scan_byte_limit=4,
    )
    scan = read_tree(spark, policy, "h")
    rows = {r.path[len(str(root)):]: r for r in scan.snapshot.collect()}
    assert set(rows) == {"", "/a", "/a/one.txt", "/a/b", "/a/b/two.txt", "/meta", "/meta/m", "/big.bin",
                         "/link", "/skip"}
    assert rows["/big.bin"].checksum == hashlib.sha256(b"0123").hexdigest()
    assert (rows["/big.bin"].size, rows["/big.bin"].processed_bytes) == (10, 4)
    assert rows["/meta/m"].checksum is None and rows["/meta/m"].processed_bytes == 0
    assert rows["/link"].kind == "symlink"
    assert rows["/link"].checksum == hashlib.sha256(b"a/one.txt").hexdigest()
    assert rows["/a"].kind == "directory" and rows["/a"].checksum is None
    assert [r.path for r in scan.failures.collect()] == [str(root / "absent")]

    before = scan.snapshot
    (root / "a/one.txt").write_text("changed")
    (root / "a/b/two.txt").rename(root / "a/b/three.txt")
    found = integrity_diff(before, read_tree(spark, policy, "h").snapshot, policy)
    changes = {(r.kind, r.path[len(str(root)):]) for r in found.collect()}
    assert ("modified", "/a/one.txt") in changes and ("moved", "/a/b/three.txt") in changes


def test_bucketed_store_needs_no_shuffle_of_the_baseline(spark):
    rows = snapshot(spark, *[file_row(f"/{i}") for i in range(50)])
    B.write_bucketed(rows, "stored_baseline", 8)
    stored = spark.table("stored_baseline")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from keelson.operators.diff import snapshot_changes

        changes = snapshot_changes(stored, rows, distinct=True, colocated=True)
        assert changes.isEmpty()
        plan = changes._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tree_of_any_shape_is_read_once(spark, tmp_path, monkeypatch):
    import hashlib
    import random

    from keelson.sources import tree

    rng, folders = random.Random(1), [tmp_path / "top"]
    folders[0].mkdir()
    for i in range(60):
        folders.append(rng.choice(folders[-4:]) / f"d{i}")
        folders[-1].mkdir()
    for i in range(150):  # one large folder, the others small
        (folders[7] if i % 3 else rng.choice(folders)).joinpath(f"f{i}").write_text(f"text {i}" * (i % 5))
    (folders[3] / "link").symlink_to("f1")
    expected = {str(p) for p in (tmp_path / "top").rglob("*")} | {str(tmp_path / "top")}
    policy = Policy(scan_paths=(str(tmp_path / "top"),))
    for options in ({}, {"entries": 10, "spread": 4}, {"entries": 1, "spread": 1}):
        scan = tree.read_tree(spark, policy, "h", **options)
        rows = scan.snapshot.collect()
        assert len(rows) == len(expected) and {r.path for r in rows} == expected
        for r in rows:
            if r.kind == "file":
                with open(r.path, "rb") as content:
                    assert r.checksum == hashlib.sha256(content.read()).hexdigest()
        assert scan.failures.count() == 0
        listed = tree.list_tree(spark, policy, **options)
        assert "checksum" not in listed.columns and {r.path for r in listed.collect()} == expected


def test_partitions_follow_entry_counts(tmp_path):
    from keelson.sources import tree

    for name, n in (("big", 95), ("a", 3), ("b", 4), ("c", 5)):
        (tmp_path / name).mkdir()
        for i in range(n):
            (tmp_path / name / str(i)).write_text("")
    rules = tree.Rules(*[frozenset()] * 4)
    parts = tree.plan_folders([str(tmp_path)], False, rules, 10, 100)
    shares = [p for p in parts if p.tasks[0][1].endswith("big")]
    assert len(shares) == 10 and all(p.tasks[0][3] == 10 for p in shares)
    assert sum(len(p.tasks) for p in parts) == 1 + 10 + 4 and len(parts) < 15
    deep = tree.plan_folders([str(tmp_path)], True, rules, 10, 2)
    assert {t[0] for p in deep for t in p.tasks} == {"flat", "deep"}


def test_listing_reads_no_content(spark, tmp_path, monkeypatch):
    from keelson.sources import tree

    monkeypatch.setattr(tree, "_file_digest", None)
    (tmp_path / "x").write_text("a")
    policy = Policy(scan_paths=(str(tmp_path),))
    assert tree.list_tree(spark, policy).filter("failed").count() == 0
    with pytest.raises(Exception, match="NoneType"):
        tree.read_tree(spark, policy).snapshot.collect()
