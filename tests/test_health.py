import datetime as dt

import pytest
from pyspark.sql import functions as F

from keelson.config import VIRTUAL_FILESYSTEMS, AlertPolicy, Policy
from keelson.functions import digests as G, formats as N, paths as P
from keelson.operators import alerts as L, health as H, rates as T, scope as S
from keelson.schemas import MOUNTS, SCAN_SAMPLES
from keelson.sources.mounts import parse_mountinfo
from rows import file_row, folder_row, plan, snapshot


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return df.select(column.alias("r")).first().r


def test_ancestors(spark):
    cases = {
        "/a/b/c": ["/a/b/c", "/a/b", "/a", "/"], "/a": ["/a", "/"], "/": ["/"], "a/b": ["a/b", "a"],
        "registry://R/x": ["registry://R/x", "registry://R", "registry:"],
    }
    for path, expected in cases.items():
        assert one(spark, P.ancestors("p", include_root=True), p=path) == expected
        above = one(spark, P.ancestors("p", include_self=False, include_root=True), p=path)
        assert above == expected[1:]


def test_parent(spark):
    assert [one(spark, P.parent("p"), p=p) for p in ("/a/b", "/a", "/", "a")] == ["/a", "/", None, None]


def test_prefix_is_by_component(spark):
    cover = {("/a/b", "/a/b"): True, ("/a/bc", "/a/b"): False, ("/a/b/c", "/a/b/"): True, ("/x", "/"): True}
    for (path, root), expected in cover.items():
        assert one(spark, P.path_under("p", root), p=path) is expected
        assert one(spark, P.path_under("p", F.lit(root)), p=path) is expected
        many = [root] + [f"/none{i}" for i in range(50)]
        assert one(spark, P.under_any("p", many), p=path) is expected


def test_component_order(spark):
    paths = ["/a-b", "/a/b", "/a", "/a/b-c", "/a/b/c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(P.component_order("p"))
    assert [r.p for r in df.collect()] == sorted(paths, key=lambda p: p.split("/"))


def test_path_helpers(spark):
    assert one(spark, P.normalised("p"), p="a\\b") == "a/b"
    assert one(spark, P.without_private_alias("p"), p="/private/var") == "/var"
    assert one(spark, P.without_private_alias("p"), p="/privateer") == "/privateer"
    moved = one(spark, P.decode_move(P.encode_move("a", "b")), a="/new", b="/old")
    assert moved[:] == ("/new", "/old")
    assert one(spark, P.decode_move("a"), a="/new")[:] == ("/new", None)


def reference_text(value, units):
    unit, scaled = 0, max(float(value), 0.0)
    while scaled >= 1000 and unit + 1 < len(units):
        scaled, unit = scaled / 1000, unit + 1
    places = 0 if unit == 0 else 2 if scaled < 10 else 1 if scaled < 100 else 0
    return f"{scaled:.{places}f}{units[unit]}"


def test_scaled_numbers_round_exactly(spark):
    values = [0, 1, 999, 1000, 1005, 1015, 1115, 1125, 1135, 9995, 9999, 10_050, 12_250, 99_950,
              100_500, 999_500, 999_999, 1_005_000, 2_675_000_000, 10**15 * 1234, 2**62]
    values += [v * 5 + 1000 for v in range(0, 3000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for units, column in ((N.BYTE_UNITS, N.format_bytes("v")), (N.COUNT_UNITS, N.format_count("v"))):
        got = {r.v: r.t for r in df.select("v", column.alias("t")).collect()}
        assert got == {v: reference_text(v, units) for v in values}


def test_rates(spark):
    assert one(spark, N.format_byte_rate("a", "b"), a=1500, b=500) == "3.00KB/s"
    assert one(spark, N.format_file_rate("a", "b"), a=1500, b=0) == "0f/s"


def test_times(spark):
    for ms in (0, 1_700_000_000_123, 951_782_399_999):
        shown = dt.datetime.fromtimestamp(ms // 1000, dt.UTC).strftime("%Y-%m-%d %H:%M:%S UTC")
        assert one(spark, N.utc_text("a"), a=ms) == shown
    assert one(spark, N.filetime_ns("a"), a=116444736000000001) == 100
    assert one(spark, N.filetime_ns("a"), a=2**62) == 2**63 - 1
    assert one(spark, N.clamp_long(F.lit("99999999999999999999").cast("decimal(38,0)"))) == 2**63 - 1
    assert one(spark, N.octal("a"), a=33188) == "100644"


def test_digests(spark):
    import hashlib

    data = "abcdef"
    assert one(spark, G.content_digest("d", 3), d=data) == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, G.content_digest("d"), d=data) == hashlib.sha256(b"abcdef").hexdigest()
    assert [one(spark, G.processed_bytes("s", n), s=10) for n in (0, 4, 99)] == [10, 4, 10]
    assert one(spark, G.parse_digest("d"), d="zz") is None
    assert one(spark, G.hex_digest(G.parse_digest("d")), d="Ab" * 32) == "ab" * 32


def test_security_digest(spark):
    def digest(kind="file", nlink=1, flags=0, error=None, x="v"):
        return one(
            spark,
            G.security_hash(F.lit(1), F.lit(2), F.lit(nlink), F.lit(kind), F.lit(flags),
                            F.create_map(F.lit("n"), F.lit(x)), F.lit(error).cast("string")),
        )

    assert digest() == digest()
    assert len({digest(), digest(nlink=2), digest(flags=1), digest(error="EIO"), digest(x="w"),
                digest("directory")}) == 6
    assert digest("directory", 1) == digest("directory", 9)


def test_mountinfo(spark):
    lines = [
        r"36 35 98:0 / / rw - ext4 /dev/a rw", r"37 35 98:0 / /mnt/my\040disk rw shared:1 - nfs x rw",
        r"38 35 98:0 / /back\134slash rw - tmpfs x", "broken", r"39 35 98:0 / /odd\9zz rw - ext4 x",
    ]
    df = spark.createDataFrame([("h", line) for line in lines], "host string, line string")
    assert {(r.mountpoint, r.fs_type) for r in parse_mountinfo(df).collect()} == {
        ("/", "ext4"), ("/mnt/my disk", "nfs"), ("/back\\slash", "tmpfs"), ("/odd\\9zz", "ext4")}


def test_most_specific_mount_wins(spark):
    mounts = spark.createDataFrame(
        [("h", "/", "ext4"), ("h", "/mnt", "nfs"), ("h", "/mnt/a", "tmpfs"), ("x", "/", "zfs")], MOUNTS)
    paths = spark.createDataFrame(
        [("h", "/mnt/a/f"), ("h", "/mnt/ab"), ("h", "/f"), ("x", "/mnt"), ("y", "/")],
        "host string, path string")
    got = [r.fs_type for r in S.with_fs_type(paths, mounts).orderBy("host", "path").collect()]
    assert got == ["ext4", "tmpfs", "nfs", "zfs", None]


def test_risky_mounts(spark):
    mounts = spark.createDataFrame(
        [("h", "/proc", "proc"), ("h", "/srv/snap", "squashfs"), ("h", "/srv", "ext4"), ("h", "/", "sysfs")],
        MOUNTS)
    policy = Policy(scan_paths=("/srv",), excluded_filesystems=())
    found = S.risky_mounts(mounts, policy, VIRTUAL_FILESYSTEMS)
    assert {r.mountpoint for r in found.collect()} == {"/srv/snap", "/"}


def test_trust(spark):
    tree = snapshot(
        spark, folder_row("/"), folder_row("/etc"), folder_row("/opt")[:5] + (16895,) + folder_row("/opt")[6:],
        file_row("/etc/ok"), file_row("/etc/open", mode=0o100666), file_row("/etc/mine", uid=5),
        file_row("/etc/link", kind="symlink", mode=0o120777), file_row("/opt/app"),
    )
    targets = tree.filter("kind <> 'directory'").select("host", "path").unionByName(
        spark.createDataFrame([("h", "/etc/none"), ("h", "/etc")], "host string, path string"))
    got = {(r.target, r.path, r.issue) for r in H.trust_issues(tree, targets).collect()}
    assert got == {
        ("/etc/open", "/etc/open", "group/world writable, mode 666"),
        ("/etc/mine", "/etc/mine", "not owned by root"), ("/etc/link", "/etc/link", "symlink"),
        ("/opt/app", "/opt", "group/world writable, mode 777"), ("/etc/none", "/etc/none", "not found"),
        ("/etc", "/etc", "not a file"),
    }
    relaxed = H.trust_issues(tree, targets, privileged=False, must_exist=False).collect()
    assert {r.issue.split(",")[0] for r in relaxed} == {"group/world writable", "symlink", "not a file"}


def test_trust_reads_only_targets_and_their_parents(spark):
    tree = snapshot(spark, folder_row("/"), file_row("/etc/ok"))
    targets = spark.createDataFrame([("h", "/etc/ok")], "host string, path string")
    steps = plan(H.trust_issues(tree, targets)).split("\n\n")
    judged = [s for s in steps if ") Project" in s and "not a " in s]
    assert judged and sum("LeftSemi" in s for s in steps) >= 2


def test_trust_of_data_directory(spark):
    tree = snapshot(
        spark, folder_row("/"), folder_row("/var", uid=3), folder_row("/var/db", uid=7),
        file_row("/var/db/records", mode=0o100662), file_row("/var/db/manifest"),
        file_row("/var/db/link", kind="symlink", mode=0o120777), file_row("/var/dbx", uid=9),
        folder_row("/var/db/inner", uid=9), file_row("/var/db/inner/deep", uid=9),
    )
    folders = spark.createDataFrame([("h", "/var/db"), ("h", "/srv/none")], "host string, path string")
    got = {(r.target, r.path, r.issue) for r in H.data_trust_issues(tree, folders).collect()}
    assert got == {
        ("/var/db", "/var/db", "not owned by root"), ("/var/db", "/var", "not owned by root"),
        ("/var/db", "/var/db/records", "group/world writable, mode 662"),
        ("/var/db", "/var/db/link", "symlink"),
    }
    wrong = H.data_trust_issues(tree, spark.createDataFrame([("h", "/var/dbx")], "host string, path string"))
    assert "not a directory" in {r.issue for r in wrong.collect()}


def test_mounts_are_looked_up_by_equality(spark):
    mounts = spark.createDataFrame(
        [("h", "/", "ext4"), ("h", "/a/", "xfs"), ("h", "/a/b", "proc"), ("h", "/a/b", "nfs"), ("g", "/q", "tmpfs")],
        MOUNTS)
    paths = ["/", "/a", "/ab", "/a/x", "/a/b", "/a/b/c/d", "/a/bc", "rel/x", "bare"]
    df = spark.createDataFrame([("h", p) for p in paths] + [("g", "/q/r"), ("g", "/z"), ("n", "/a")], "host string, path string")
    typed = S.with_fs_type(df, mounts)
    got = {(r.host, r.path): r.fs_type for r in typed.collect()}
    assert got == {
        ("h", "/"): "ext4", ("h", "/a"): "xfs", ("h", "/ab"): "ext4", ("h", "/a/x"): "xfs", ("h", "/a/b"): "nfs",
        ("h", "/a/b/c/d"): "nfs", ("h", "/a/bc"): "xfs", ("h", "rel/x"): None, ("h", "bare"): None,
        ("g", "/q/r"): "tmpfs", ("g", "/z"): None, ("n", "/a"): None,
    }
    assert "_mounts" not in plan(typed)


def test_targets_above_paths(spark):
    df = spark.createDataFrame(
        [("h", p) for p in ("/a", "/a/b", "/a/b/c", "/ab", "/x/y", "/")] + [("g", "/a/b")], "host string, path string")
    targets = spark.createDataFrame([("h", "/a/"), ("h", "/x/y"), ("h", "/a/b"), ("g", "/")], "host string, target string")
    got = sorted((r.host, r.path) for r in S.under_targets(df, targets, ["host"]).collect())
    assert got == [("g", "/a/b"), ("h", "/a"), ("h", "/a/b"), ("h", "/a/b/c"), ("h", "/x/y")]


def brute_rate(samples, window):
    out = []
    for i, (t, files) in enumerate(samples):
        older = [s for s in samples[: i + 1] if s[0] <= t - window]
        base = older[-1] if older else samples[0]
        out.append((t, files - base[1], t - base[0]))
    return out


@pytest.mark.parametrize("bucket", [6_000, 20_000, 3_600_000])
def test_rate_over_bucket_borders(spark, monkeypatch, bucket):
    monkeypatch.setattr(T, "BUCKET_MS", bucket)
    times = [0, 900, 1000, 4999, 5000, 5900, 6000, 10_999, 11_000, 11_001, 17_999, 18_000, 50_000,
             50_001, 56_000, 61_000, 300_000, 304_999, 305_000]
    samples = [(t, 10 * i) for i, t in enumerate(times)]
    df = spark.createDataFrame([("r", t, f, f * 7) for t, f in samples], SCAN_SAMPLES)
    got = T.scan_rate(df).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.recent_files, r.recent_elapsed_ms) for r in got] == brute_rate(samples, 5000)
    assert [r.recent_bytes for r in got] == [7 * r.recent_files for r in got]


def test_alert_routing(spark):
    report = spark.createDataFrame(
        [("good", 5, 0, ""), ("bad", 5, 2, "lines")], "source string, line_count long, match_count long, report string")

    def sent(report_to=None, **policy):
        rows = L.log_alerts(report, AlertPolicy(**policy), report_to).collect()
        return {r.source: (r.recipient, r.error) for r in rows}

    both = {"send_on_fail": True, "send_on_success": True, "from_address": "me"}
    assert sent(from_address="me", fail_to="f") == {}
    assert sent(send_on_fail=True, from_address="me", fail_to="f") == {"bad": ("f", None)}
    assert sent(**both, fail_to="f", success_to="s") == {"good": ("s", None), "bad": ("f", None)}
    assert sent(**both, fail_to="f") == {"good": ("f", None), "bad": ("f", None)}
    assert sent("own", **both, fail_to="f") == {"good": ("own", None), "bad": ("own", None)}
    assert sent(**both)["bad"] == (None, L.NO_RECIPIENT)
    assert sent(send_on_fail=True, fail_to="f")["bad"] == ("f", L.NO_SENDER)


def test_config_pin(spark):
    df = spark.createDataFrame([("a", "ab" * 32), ("b", "cd" * 32)], "host string, config_hash string")
    assert {r.host: r.status for r in H.config_pin(df, "AB" * 32).collect()} == {"a": "ok", "b": "mismatch"}
    with pytest.raises(ValueError):
        H.config_pin(df, "short")


def test_scan_paths_on_an_excluded_filesystem_start_no_walk(spark):
    from keelson.config import Policy
    from keelson.operators.scope import monitored

    rows = [(h, p) for h in ("a", "b") for p in ("/proc/sys/x", "/proc/disk/y", "/etc/z", "/proc/1")]
    df = spark.createDataFrame(rows, "host string, path string")
    mounts = spark.createDataFrame(
        [("a", "/", "ext4"), ("a", "/proc", "proc"), ("a", "/proc/disk", "ext4"), ("b", "/", "ext4")],
        "host string, mountpoint string, fs_type string",
    )
    policy = Policy(scan_paths=("/etc", "/proc/sys", "/proc/disk"), excluded_filesystems=("proc",))
    got = {(r.host, r.path) for r in monitored(df, policy, mounts).collect()}
    assert got == {("a", "/proc/disk/y"), ("a", "/etc/z"), ("b", "/proc/sys/x"), ("b", "/proc/disk/y"), ("b", "/etc/z")}


def test_rates_over_a_window_longer_than_a_minute(spark):
    from keelson.operators.rates import scan_rate

    times = [0, 500, 59_000, 61_000, 119_500, 120_000, 181_000, 400_000, 401_000]
    samples = spark.createDataFrame([("r", t, t // 10, t) for t in times], "run_id string, ts_ms bigint, files bigint, bytes bigint")
    got = {r.ts_ms: r.recent_elapsed_ms for r in scan_rate(samples, 120_000).collect()}
    want = {t: t - max([u for u in times if u <= t - 120_000], default=times[0]) for t in times}
    assert got == want
