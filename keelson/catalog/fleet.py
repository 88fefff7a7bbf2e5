"""Registered queries over whole hosts: health from its real parts, sources, sinks and live triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog import inputs as I, logs, review
from keelson.catalog.register import Register
from keelson.catalog.review import CREATED, TAMPERED, TRUST, loose_tree, manifest_of
from keelson.catalog.stored import fresh
from keelson.config import LogAudit, LogRule, LogSource, Policy, Selector
from keelson.functions import digests as G
from keelson.functions.digests import text_digest
from keelson.operators import audit as A, diff as D, health as H, review as V, rules as U
from keelson.operators.fingerprint import verify_baseline
from keelson.operators.logreport import group_events
from keelson.operators.scope import coverage_gaps
from keelson.plans.integrity import integrity_scan
from keelson.plans.logs import scan_all_logs, scan_lines, scan_logs
from keelson.session import materialise
from keelson.sinks import review as W
from keelson.sinks.baseline import config_drift
from keelson.sources.snapshots import read_snapshot
from keelson.streaming.audit import forward_audit, parquet_sink
from keelson.streaming.logs import RunningReport

query = Register()

DIFF = I.diff_ctes()


# --- health -------------------------------------------------------------------------------

POLICY = Policy(scan_paths=("/srv",), exclusions=("/srv/moved",), excluded_filesystems=("proc",))

FOLDERS = """sha256(string_agg(DISTINCT '/srv/' || string_split(path, '/')[3], ','
         ORDER BY '/srv/' || string_split(path, '/')[3]))"""

HEALTH_SQL = TAMPERED + ", " + TRUST.removeprefix("WITH ") + f""",
mounts AS ({I.MOUNTS_SQL}),
hosts AS (SELECT DISTINCT host FROM current_rows),
made AS (SELECT host, count(*) AS records, {FOLDERS} AS config_hash FROM baseline WHERE host <> 'host3' GROUP BY host),
present AS (
  SELECT host, {FOLDERS} AS config_hash FROM current_rows WHERE NOT starts_with(path, '/srv/moved/') GROUP BY host),
stops AS (
  SELECT log_id, min(seq) AS bad_line, arg_min(cause, seq) AS cause FROM judged WHERE cause IS NOT NULL GROUP BY log_id),
logs AS (
  SELECT log_id, count(*) FILTER (bad_line IS NULL OR seq < bad_line) AS events, any_value(bad_line) AS bad_line,
         any_value(s.cause) AS cause FROM judged j LEFT JOIN stops s USING (log_id) GROUP BY log_id),
audits AS (
  SELECT 'host' || log_id::BIGINT % 4 AS host, sum(events)::BIGINT AS events,
         arg_min(bad_line, log_id) FILTER (bad_line IS NOT NULL) AS bad_line,
         arg_min(cause, log_id) FILTER (bad_line IS NOT NULL) AS cause FROM logs GROUP BY 1),
wrong AS (
  SELECT DISTINCT b.host FROM baseline b JOIN current_rows c USING (host, path)
  WHERE b.checksum <> c.checksum AND host = 'host2'),
gaps AS (SELECT host, count(*) AS n FROM current_rows WHERE starts_with(path, '/srv/moved/') GROUP BY host),
risky AS (SELECT host, count(*) AS n FROM mounts WHERE fs_type = 'squashfs' GROUP BY host),
procs AS (SELECT DISTINCT host FROM mounts WHERE fs_type = 'proc'),
trusts AS (
  SELECT w.host, count(*) AS n FROM baseline w JOIN issues i ON i.host = w.host
     AND ((NOT i.folder AND i.path = w.path) OR (i.folder AND (i.path = '/' OR starts_with(w.path, i.path || '/'))))
  GROUP BY w.host
  UNION ALL SELECT host, count(*) FROM baseline w WHERE NOT EXISTS (
    SELECT 1 FROM current_rows c WHERE c.host = w.host AND c.path = w.path) GROUP BY host)
SELECT host, 'baseline' AS "check",
       CASE WHEN records IS NULL OR w.host IS NOT NULL THEN 'fail' ELSE 'ok' END AS status,
       CASE WHEN records IS NULL THEN 'missing' WHEN w.host IS NOT NULL THEN 'content_hash' ELSE 'ok' END AS detail
FROM hosts LEFT JOIN made USING (host) LEFT JOIN wrong w USING (host)
UNION ALL SELECT host, 'records', 'ok', coalesce(records, 0)::VARCHAR FROM hosts LEFT JOIN made USING (host)
UNION ALL SELECT host, 'generation', 'ok', CASE WHEN records IS NULL THEN '0' ELSE '3' END
FROM hosts LEFT JOIN made USING (host)
UNION ALL SELECT host, 'created', 'ok', CASE WHEN records IS NULL THEN ''
  ELSE strftime(make_timestamp(({CREATED} + records) * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' END
FROM hosts LEFT JOIN made USING (host)
UNION ALL SELECT host, 'scan_byte_limit', 'ok', 'whole file' FROM hosts
UNION ALL SELECT host, 'config_drift', CASE WHEN m.config_hash <> p.config_hash THEN 'fail' ELSE 'ok' END,
  CASE WHEN m.config_hash <> p.config_hash THEN 'drift' ELSE 'ok' END FROM made m JOIN present p USING (host)
UNION ALL SELECT host, 'config_pin', CASE WHEN p.config_hash <> o.pinned THEN 'fail' ELSE 'ok' END,
  CASE WHEN p.config_hash <> o.pinned THEN 'mismatch' ELSE 'ok' END
FROM present p, (SELECT config_hash AS pinned FROM present WHERE host = 'host0') o
UNION ALL SELECT host, 'audit_chain', CASE WHEN bad_line IS NOT NULL THEN 'fail' ELSE 'ok' END,
  CASE WHEN bad_line IS NOT NULL THEN 'line ' || bad_line || ': ' || cause ELSE coalesce(events, 0) || ' events' END
FROM hosts LEFT JOIN audits USING (host)
UNION ALL SELECT host, 'risky_mounts', CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END, coalesce(n, 0)::VARCHAR
FROM hosts LEFT JOIN risky USING (host)
UNION ALL SELECT host, 'policy', 'fail', CASE WHEN p.host IS NULL THEN '2' ELSE '1' END
FROM hosts LEFT JOIN procs p USING (host)
UNION ALL SELECT host, 'coverage', CASE WHEN n > 0 THEN 'fail' ELSE 'ok' END, coalesce(n, 0)::VARCHAR
FROM hosts LEFT JOIN gaps USING (host)
UNION ALL SELECT host, 'trust', CASE WHEN n > 0 THEN 'fail' ELSE 'ok' END, coalesce(n, 0)::BIGINT::VARCHAR
FROM hosts LEFT JOIN (SELECT host, sum(n) AS n FROM trusts GROUP BY host) USING (host)"""


def _folders(rows):
    """Per host the folders of its rows, as its scan paths, and their digest as configuration hash."""
    folder = F.concat(F.lit("/srv/"), F.split("path", "/")[2])
    listed = rows.groupBy("host").agg(F.array_sort(F.collect_set(folder)).alias("scan_paths"))
    return listed.withColumn("config_hash", text_digest(F.array_join("scan_paths", ",")))


def health_rows(spark, sf_dir):
    """All parts come from their operators: manifests verified against records some of which were
    changed, drift and pin of hashes over the hosts' folders, verified audit logs, trust of files."""
    old, new = I.baseline(spark, sf_dir), I.current(spark, sf_dir)
    host = F.col("host")
    hosts = new.select("host").distinct()
    before, after = _folders(old), _folders(new.filter(~F.col("path").startswith("/srv/moved/")))
    made = manifest_of(old.filter(host != "host3"), 3, ["host"]).drop("config_hash").join(
        before.select("host", "config_hash"), "host"
    )
    # The store holds host2's files as they are now, not as they were fingerprinted.
    newer = new.filter(host == "host2").select("host", "path", F.col("checksum").alias("_now"))
    store = old.join(newer, ["host", "path"], "left")
    store = store.withColumn("checksum", F.coalesce("_now", "checksum")).drop("_now")
    manifests = verify_baseline(store, made, ["host"])
    present = after.select("host", F.col("config_hash").alias("current_config_hash"))
    pinned = after.filter(host == "host0").first()["config_hash"]
    audits = A.verify_audit(I.tampered_lines(spark, sf_dir))
    number = (F.col("log_id").cast("long") % 4).cast("string")
    named = audits.select("log_id", F.concat(F.lit("host"), number).alias("host"))
    mounts = I.mounts(spark, sf_dir)
    left_out = mounts.filter("fs_type = 'proc'").groupBy("host").agg(
        F.collect_set("fs_type").alias("excluded_filesystems")
    )
    no_texts = F.array().cast("array<string>")
    policies = before.join(left_out, "host", "left").select(
        "host", "scan_paths", F.col("scan_paths")[0].alias("db_path"), no_texts.alias("exclusions"),
        "excluded_filesystems", no_texts.alias("metadata_rules"), F.lit(0).cast("long").alias("scan_byte_limit"),
    )
    return H.health_report(
        hosts, manifests, config_drift(manifests, present), H.audits_of_hosts(audits, named), mounts, policies,
        coverage_gaps(new.select("host", "path"), POLICY), POLICY,
        trust=H.trust_issues(loose_tree(spark, sf_dir), old), pins=H.config_pin(after, pinned),
    )


@query("health_report", HEALTH_SQL)
def health_report(spark, sf_dir):
    return health_rows(spark, sf_dir)


@query("health_verdict", f"""
SELECT host, count(*) FILTER (status = 'fail') AS failures,
       count(*) FILTER (status = 'fail') = 0 AS healthy FROM ({HEALTH_SQL}) GROUP BY host""")
def health_verdict(spark, sf_dir):
    return H.health_verdict(health_rows(spark, sf_dir))


# --- scans --------------------------------------------------------------------------------


@query("drifted_scan", DIFF + """,
counted AS (
  SELECT host, count(*) FILTER (kind = 'modified') AS modified, count(*) AS total FROM findings GROUP BY host),
hosts AS (SELECT host, min(checksum) AS least FROM current_rows GROUP BY host),
told AS (SELECT host, least <> (SELECT least FROM hosts WHERE host = 'host0') AS drifted FROM hosts)
SELECT host, coalesce(modified, 0) + drifted::INT AS modified, coalesce(total, 0) + drifted::INT AS total,
       coalesce(total, 0) + drifted::INT = 0 AS clean FROM told LEFT JOIN counted USING (host)""")
def drifted_scan(spark, sf_dir):
    """A scan that knows the configuration's hash: hosts with another one have a finding more."""
    new = I.current(spark, sf_dir)
    least = new.groupBy("host").agg(F.min("checksum").alias("checksum"))
    known = least.filter("host = 'host0'").first()["checksum"]
    config = new.join(least, ["host", "checksum"], "left_semi").dropDuplicates(["host"])
    config = config.withColumn("path", F.lit("/etc/keelson.conf"))
    scan = integrity_scan(I.baseline(spark, sf_dir), new, stored_config_hash=known, config_rows=config)
    return scan.summary.select("host", "modified", "total", "clean")


@query("repeated_rows", DIFF + "SELECT host, path, previous_path, kind FROM findings")
def repeated_rows(spark, sf_dir):
    """Every row stands twice on both sides, and once more with a lesser payload: each path counts once."""

    def thrice(rows):
        lesser = rows.withColumns({"checksum": F.lit(""), "size": F.lit(0).cast("long")})
        return rows.unionByName(rows).unionByName(lesser)

    found = D.integrity_diff(thrice(I.baseline(spark, sf_dir)), thrice(I.current(spark, sf_dir)))
    return found.select("host", "path", "previous_path", "kind")


@query("read_inventory", DIFF + "SELECT host, path, checksum, size, mode, processed_bytes FROM current_rows")
def read_inventory(spark, sf_dir):
    """What agents collected and wrote, read with the fixed schema."""
    path = fresh(spark, "inventory")
    I.current(spark, sf_dir).withColumn("agent", F.lit("x")).write.parquet(path)
    return read_snapshot(spark, path).select("host", "path", "checksum", "size", "mode", "processed_bytes")


@query("symlink_digests", """
SELECT doc_id, sha256('/srv/' || source || '/' || doc_id) AS checksum FROM documents""")
def symlink_digests(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    target = F.concat(F.lit("/srv/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", G.symlink_digest(target).alias("checksum"))


# --- reviews ------------------------------------------------------------------------------


@query("exported_review", I.REVIEW_CTES + """
SELECT host, path, previous_path, kind, state, action, finding_id FROM replayed WHERE session_id = 'host1'""")
def exported_review(spark, sf_dir):
    """One session of a replayed review as portable JSON, read back."""
    path = fresh(spark, "review")
    found = I.review_findings(spark, sf_dir)
    replayed = V.replay_actions(found, I.review_actions(found))
    for session in ("host0", "host1"):
        W.write_review(replayed.filter(F.col("session_id") == session).drop("session_id"), path, session)
    W.export_review(spark, path, "host1", f"{path}/export")
    return spark.read.json(f"{path}/export").select(
        "host", "path", "previous_path", "kind", "state", "action", "finding_id"
    )


@query("merged_exclusions", review.REVIEW + """,
listed AS (SELECT DISTINCT target FROM actions WHERE kind = 'exclude' AND NOT undone)
SELECT row_number() OVER (ORDER BY old DESC, target) AS place, target FROM (
  SELECT '/srv/src4' AS target, true AS old UNION SELECT '/srv/zzz', true
  UNION SELECT target, false FROM listed WHERE target <> '/srv/src4')""")
def merged_exclusions(spark, sf_dir):
    """The exclusions of a review behind those of the configuration, each once."""
    wanted = V.exclusion_list(I.review_actions(I.review_findings(spark, sf_dir)))
    rows = wanted.select("target").distinct().orderBy("target").collect()  # a policy's list
    merged = V.merge_exclusions(["/srv/src4", "/srv/zzz"], [r.target for r in rows])
    return spark.createDataFrame(list(enumerate(merged, 1)), "place bigint, target string")


# --- logs ---------------------------------------------------------------------------------


def written_lines(spark, sf_dir):
    """The folder of text files that hold all event lines."""
    path = fresh(spark, "logs")
    I.event_lines(spark, sf_dir).select(F.col("line").alias("value")).write.text(path)
    return path


@query("chosen_source", logs.EVENT_LINES + """
SELECT 'Virtual' AS source, CASE WHEN contains(line, 'ERROR') THEN 'failed request'
       ELSE 'bought or viewed' END AS selector_desc, count(*) AS events
FROM lines WHERE regexp_matches(line, 'ERROR|PURCHASE|VIEW') GROUP BY ALL""")
def chosen_source(spark, sf_dir):
    """A rule named with a path makes a source of its own."""
    scan = scan_logs(spark, I.AUDIT, "events", written_lines(spark, sf_dir))
    return scan.events.groupBy("source", "selector_desc").agg(F.count(F.lit(1)).alias("events"))


@query("all_sources", logs.EVENT_LINES + """
SELECT 'requests' AS source, count(*) AS line_count,
       count(*) FILTER (regexp_matches(line, 'ERROR|PURCHASE|VIEW')) AS match_count FROM lines
UNION ALL SELECT 'signups', count(*), count(*) FILTER (contains(line, 'SIGNUP')) FROM lines""")
def all_sources(spark, sf_dir):
    """Every configured source that exists; the third one does not."""
    path = written_lines(spark, sf_dir)
    signups = LogRule("signups", (Selector("contains", "new user", ("SIGNUP",)),))
    audit = LogAudit(
        (I.EVENTS, signups),
        (LogSource("requests", ("events",), path=path), LogSource("signups", ("signups",), path=path),
         LogSource("absent", ("events",), path=f"{path}-absent")),
    )
    return scan_all_logs(spark, audit).select("source", "line_count", "match_count")


@query("own_selector", logs.EVENT_LINES + """
SELECT source, count(*) AS events FROM lines WHERE len(line) > 60 GROUP BY source""")
def own_selector(spark, sf_dir):
    """A selector kind that a user adds."""
    kind = "longer_than"
    if kind not in U.selector_kinds():
        U.register_selector(kind, lambda selector, line: F.length(line) > int(selector.match[0]))
    rule = LogRule("long", (Selector(kind, "long line", ("60",)),))
    audit = LogAudit((rule,), (LogSource("long", ("long",), "table"),))
    scan = scan_lines(I.event_lines(spark, sf_dir), audit, audit.source("long"))
    return scan.events.groupBy("source").agg(F.count(F.lit(1)).alias("events"))


@query("chained_steps", logs.RESET_GROUPS + """
SELECT source, count(*) AS keys, sum(count)::BIGINT AS events FROM groups WHERE risk > 1 GROUP BY source""")
def chained_steps(spark, sf_dir):
    """Results are DataFrames: a scan's groups go through the steps of any other table."""
    scan = scan_lines(I.event_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("restarts"))
    groups = group_events(scan.events, I.AUDIT.group_pattern(scan.source))
    return groups.filter("risk > 1").groupBy("source").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("count").alias("events")
    )


# --- streams ------------------------------------------------------------------------------


@query("live_report_periodic", logs.RESET_GROUPS + """
SELECT source, key, risk, count, position FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY risk DESC, count DESC, key)
            AS position FROM groups) WHERE position <= 10""")
def live_report_periodic(spark, sf_dir):
    """The running report under a trigger with a period, stopped when all input is taken."""
    target = fresh(spark, "running")
    lines = I.event_lines(spark, sf_dir)
    lines.write.parquet(f"{target}/in")
    running = RunningReport(I.AUDIT, I.AUDIT.source("restarts"), target, parts=4)
    arriving = spark.readStream.schema(lines.schema).parquet(f"{target}/in")
    live = running.start(arriving, every="1 second")
    live.processAllAvailable()
    live.stop()
    rows, _ = running.report(spark)
    return rows.select("source", "key", "risk", "count", "position")


@query("forwarded_audit", "SELECT user_id::VARCHAR AS log_id, event_id AS seq FROM events")
def forwarded_audit(spark, sf_dir):
    """Audit lines streamed to a durable sink that is required."""
    target = fresh(spark, "audit")
    lines = materialise(A.chain_audit(I.audit_events(spark, sf_dir)))
    lines.write.parquet(f"{target}/in")
    arriving = spark.readStream.schema(lines.schema).parquet(f"{target}/in")
    sinks = [parquet_sink(f"{target}/out")]
    forward_audit(arriving, sinks, f"{target}/checkpoint", required=True).awaitTermination()
    return spark.read.parquet(f"{target}/out/batch=*").select("log_id", "seq")


QUERIES, ORACLES = query.queries, query.oracles
