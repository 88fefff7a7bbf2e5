import random

import pytest
from pyspark.sql import functions as F

from keelson.functions import labels as L
from keelson.operators import diff as D, review as V
from keelson.schemas import REVIEW_ACTIONS
from rows import file_row, snapshot

FINDING = "session_id string, finding_id long, host string, path string, kind string, state string, action string"


def findings(spark, *paths, state="unreviewed", session="s"):
    return spark.createDataFrame(
        [(session, i + 1, "h", p, "added", state, "none") for i, p in enumerate(paths)], FINDING
    )


def actions(spark, *rows, session="s"):
    return spark.createDataFrame(
        [(session, i + 1, kind, target, affected, undone, False)
         for i, (kind, target, affected, undone) in enumerate(rows)], REVIEW_ACTIONS,
    )


def states(df):
    return {r.path: r.state for r in df.collect()}


def test_exclude_and_undo(spark):
    found = findings(spark, "/var/cache/app", "/var/cache/app/x", "/var/cache/apple")
    excluded = actions(spark, ("exclude", "/var/cache/app", [], False))
    assert states(V.replay_actions(found, excluded)) == {
        "/var/cache/app": "excluded", "/var/cache/app/x": "excluded", "/var/cache/apple": "unreviewed"
    }
    undone = V.undo_last(excluded)
    assert set(states(V.replay_actions(found, undone)).values()) == {"unreviewed"}


def simulate(paths, history):
    """Step by step: marks set, exclusion takes the unreviewed, undo restores."""
    state, done, rows = {i + 1: "unreviewed" for i in range(len(paths))}, [], []
    for step in history:
        if step[0] == "undo":
            if done:
                before, row = done.pop()
                state = before
                rows[row][3] = True
            continue
        before = dict(state)
        kind, target = step
        if kind == "exclude":
            hit = [i for i in state if state[i] == "unreviewed"
                   and (paths[i - 1] == target or paths[i - 1].startswith(target + "/"))]
            if not hit:
                continue
            for i in hit:
                state[i] = "excluded"
            rows.append([kind, target, [], False])
        else:
            state[target] = "approved" if kind == "approve" else "flagged"
            rows.append([kind, paths[target - 1], [target], False])
        done.append((before, len(rows) - 1))
    return state, [tuple(r) for r in rows]


def test_replay_equals_a_simulation(spark):
    rng = random.Random(3)
    paths = [f"/{a}/{b}/{c}" for a in "xy" for b in "pq" for c in "12"]
    every, acts, expected = None, None, {}
    for n in range(40):
        history = []
        for _ in range(rng.randrange(1, 14)):
            kind = rng.choice(["approve", "flag", "exclude", "undo"])
            if kind == "undo":
                history.append(("undo",))
            elif kind == "exclude":
                history.append((kind, rng.choice(["/x", "/y", "/x/p", "/y/q", "/x/p/1"])))
            else:
                history.append((kind, rng.randrange(1, len(paths) + 1)))
        state, rows = simulate(paths, history)
        expected.update({(f"s{n}", i): s for i, s in state.items()})
        f = findings(spark, *paths, session=f"s{n}")
        every = f if every is None else every.unionByName(f)
        if rows:
            a = actions(spark, *rows, session=f"s{n}")
            acts = a if acts is None else acts.unionByName(a)
    got = {(r.session_id, r.finding_id): r.state for r in V.replay_actions(every, acts).collect()}
    assert got == expected


def test_directory_impact(spark):
    found = findings(
        spark, "/var/lib/docker/overlay2/a", "/var/lib/docker/overlay2/b/c", "/var/lib/docker",
        "/etc/x",
    )
    impact = {r.directory: r.affects for r in V.directory_impact(found).collect()}
    assert impact == {
        "/var": 3, "/var/lib": 3, "/var/lib/docker": 3, "/var/lib/docker/overlay2": 2,
        "/var/lib/docker/overlay2/b": 1, "/etc": 1,
    }
    targets = V.exclusion_targets(found).filter("path = '/var/lib/docker/overlay2/b/c'")
    assert [(r.target, r.affects) for r in targets.orderBy("level").collect()] == [
        ("/var/lib/docker/overlay2/b/c", 1), ("/var/lib/docker/overlay2/b", 1),
        ("/var/lib/docker/overlay2", 2), ("/var/lib/docker", 3), ("/var/lib", 3), ("/var", 3),
    ]


def test_reviewed_findings_have_no_impact(spark):
    found = findings(spark, "/a/b", state="approved")
    assert [(r.directory, r.affects) for r in V.directory_impact(found).collect()] == [("/a", 0)]


def test_sparse_ids(spark):
    row = spark.sql("select array(100L,1L,1000000L,101L,9L,9L) as ids").select(V.sparse_ids("ids"))
    assert row.first()[0] == [1, 9, 100, 101, 1000000]


def test_history_is_limited(spark):
    many = actions(spark, *[("flag", "/x", [1], False)] * 130)
    kept = V.retained_actions(many)
    assert (kept.count(), kept.agg(F.min("action_id")).first()[0]) == (100, 31)


def approve_all(found):
    return found.withColumns({"state": F.lit("approved"), "action": F.lit("approve")})


def test_approved_move_replaces_the_old_path(spark):
    old = snapshot(spark, file_row("/a/old", "1"), file_row("/a/same", "2"))
    new = snapshot(spark, file_row("/a/new", "1"), file_row("/a/same", "2"))
    found = D.integrity_diff(old, new)
    assert [r.kind for r in found.collect()] == ["moved"]
    stored = V.apply_review(old, new, approve_all(found))
    assert sorted(r.path for r in stored.collect()) == ["/a/new", "/a/same"]
    assert D.integrity_diff(stored, new).isEmpty()


def test_approving_everything_makes_the_next_scan_clean(spark):
    rng = random.Random(11)
    def tree():
        return [file_row(f"/t/{rng.randrange(40)}", str(rng.randrange(6)), f"h{rng.randrange(2)}")
                for _ in range(60)]
    old, new = (D.one_per_path(snapshot(spark, *tree())) for _ in range(2))
    found = D.integrity_diff(old, new)
    n = D.integrity_summary(found, []).first()
    assert new.count() - old.count() == n.added - n.deleted
    stored = V.apply_review(old, new, approve_all(found))
    assert D.integrity_diff(stored, new).isEmpty()


def test_unapproved_findings_change_nothing(spark):
    old, new = snapshot(spark, file_row("/a", "1")), snapshot(spark, file_row("/a", "2"))
    found = D.integrity_diff(old, new).withColumn("action", F.lit("approve"))
    assert V.apply_review(old, new, found).exceptAll(old).isEmpty()


def test_accept_scope(spark):
    old = snapshot(spark, file_row("/s/changed", "1"), file_row("/s/gone", "2"), file_row("/k", "3"))
    new = snapshot(spark, file_row("/s/changed", "9"), file_row("/s/new", "4"), file_row("/k", "8"))
    stored = {r.path: r.checksum for r in V.accept(old, new, "/s").collect()}
    assert stored == {"/s/changed": "9", "/s/new": "4", "/k": "3"}
    row = V.accept_counts(old, new, "/s").first()
    assert (row.preserved, row.removed, row.accepted, row.records) == (1, 2, 2, 3)


def test_byte_limits_must_agree():
    V.check_byte_limits(0, 0)
    with pytest.raises(ValueError):
        V.check_byte_limits(0, 10)


def test_plan_counts_policy_approvals(spark):
    rows = spark.createDataFrame(
        [("h", "/p", None, ["policy"], "approved", "approve"),
         ("h", "/n", "/o", [], "approved", "approve"),
         ("h", "/m", None, ["size"], "approved", "approve"),
         ("h", "/x", None, ["size"], "flagged", "flag")],
        "host string, path string, previous_path string, reasons array<string>, state string, action string",
    )
    plan = V.plan_apply(rows).first()
    assert (plan.approved_add, plan.approved_remove, plan.config_hash_updated, plan.approvals) == (
        2, 2, True, 3)
    changes = {(r.change, r.path) for r in V.approval_paths(rows).collect()}
    assert changes == {("add", "/n"), ("remove", "/o"), ("add", "/m"), ("remove", "/m")}


def test_exclusions_merge_in_order():
    assert V.merge_exclusions(["/b", "/a"], ["/a", "/c", "/c"]) == ["/b", "/a", "/c"]


def test_reason_codec(spark):
    row = spark.sql("select 'acl, size,  ,checksum' as t").select(L.parse_reasons("t").alias("r"))
    assert row.first().r == ["checksum", "size", "security_metadata"]
    with pytest.raises(Exception, match="unknown finding reason colour"):
        spark.sql("select 'colour' as t").select(L.parse_reasons("t")).collect()
    text = spark.sql("select array('kind') as r").select(L.review_text(F.lit("modified"), "r"))
    assert text.first()[0] == "metadata or content changed"


def test_flag_codec(spark):
    df = spark.sql("select 'moved' k, 'flagged' s, 'flag' a, array('policy', 'size') r")
    packed = df.select(L.pack_flags("k", "s", "a", "r").alias("f"))
    assert packed.first().f == 3 | 3 << 2 | 3 << 4 | (1 << 9 | 1 << 1) << 8
    back = packed.select(L.unpack_flags("f").alias("u")).first().u
    assert (back.kind, back.state, back.action, back.reasons) == ("moved", "flagged", "flag", ["size", "policy"])
