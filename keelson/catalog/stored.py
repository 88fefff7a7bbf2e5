"""Registered queries that write to the shared folder, read back, or stream."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from keelson.catalog import inputs as I, integrity, logs
from keelson.catalog.review import APPROVALS, replayed
from keelson.catalog.register import Register
from keelson.config import LogAudit, LogSource, Policy
from keelson.functions import digests as G, labels as L, paths as P
from keelson.operators import diff as D, health as H, review as V
from keelson.operators.audit import chain_audit, verify_audit
from keelson.operators.fingerprint import generation_guard
from keelson.operators.rules import selector_test
from keelson.plans.review import accept_stored, apply_stored
from keelson.session import work_dir
from keelson.sinks import baseline as B, review as W
from keelson.sinks.logs import write_logs
from keelson.sources.logs import read_journal, read_log
from keelson.sources.snapshots import read_audit
from keelson.sources.tree import list_tree, read_tree
from keelson.streaming.logs import RunningReport, live_events
from keelson.streaming.snapshots import ARRIVING, LiveDiff

query = Register()

DIFF = I.diff_ctes()


def fresh(spark, name):
    """A folder of its own for each run."""
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stream(spark, sf_dir, name):
    schema = I.table(spark, sf_dir, name).schema
    only = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return only.parquet(sf_dir)


@query("stored_baseline", DIFF + """
SELECT host, path, checksum, size, mode, mtime_ns FROM current_rows""")
def stored_baseline(spark, sf_dir):
    path = fresh(spark, "baseline")
    B.write_baseline(I.baseline(spark, sf_dir), path)
    B.write_baseline(I.current(spark, sf_dir), path, "0" * 64)
    return B.read_baseline(spark, path, minimum=2, verify=True).select(
        "host", "path", "checksum", "size", "mode", "mtime_ns"
    )


def generations(spark, path):
    """Records of the newest generation with what its manifest says."""
    row = B.newest_manifest(spark, path)
    said = [F.lit(row[c]).alias(c) for c in ("generation", "config_hash", "scan_byte_limit")]
    return B.read_baseline(spark, path, verify=True).select(
        "host", "path", "checksum", "size", "mode", *said
    )


NEXT = ", 2 AS generation, repeat('0', 64) AS config_hash, 0 AS scan_byte_limit"


@query("apply_stored", APPROVALS + f"""
SELECT host, path, checksum, size, mode{NEXT} FROM baseline b WHERE NOT EXISTS (
  SELECT 1 FROM changes c WHERE c.change = 'remove' AND c.host = b.host AND c.path = b.path)
UNION ALL SELECT host, path, checksum, size, mode{NEXT} FROM current_rows r WHERE EXISTS (
  SELECT 1 FROM changes c WHERE c.change = 'add' AND c.host = r.host AND c.path = r.path)""")
def applied(spark, sf_dir):
    path = fresh(spark, "baseline")
    B.write_baseline(I.baseline(spark, sf_dir), path, "0" * 64)
    apply_stored(spark, path, I.current(spark, sf_dir), replayed(spark, sf_dir), "1" * 64)
    return generations(spark, path)


@query("accept_stored", DIFF + f"""
SELECT host, path, checksum, size, mode{NEXT} FROM baseline
WHERE NOT starts_with(path, '/srv/src1/')
UNION ALL SELECT host, path, checksum, size, mode{NEXT} FROM current_rows
WHERE starts_with(path, '/srv/src1/')""")
def accepted(spark, sf_dir):
    path = fresh(spark, "baseline")
    B.write_baseline(I.baseline(spark, sf_dir), path, "0" * 64)
    accept_stored(spark, path, I.current(spark, sf_dir), "/srv/src1")
    return generations(spark, path)


@query("baseline_manifests", DIFF + """
SELECT 1 AS generation, count(*) AS records, 0 AS scan_byte_limit, NULL AS config_hash FROM baseline
UNION ALL SELECT 2, count(*), 4096, repeat('0', 64) FROM current_rows""")
def baseline_manifests(spark, sf_dir):
    path = fresh(spark, "baseline")
    B.write_baseline(I.baseline(spark, sf_dir), path)
    B.write_baseline(I.current(spark, sf_dir), path, "0" * 64, 4096)
    return generation_guard(B.read_manifests(spark, path), 1).select(
        "generation", "records", "scan_byte_limit", "config_hash"
    )


@query("baseline_of_hosts", DIFF + """
SELECT host, path, checksum, size FROM current_rows WHERE host IN ('host1', 'host3')""")
def baseline_of_hosts(spark, sf_dir):
    """Two writers one after the other; the newest generation's records of two hosts."""
    path = fresh(spark, "baseline")
    B.write_baseline(I.baseline(spark, sf_dir), path)
    B.write_baseline(I.current(spark, sf_dir), path)
    hosts = I.current(spark, sf_dir).filter("host IN ('host1', 'host3')").select("host")
    return B.read_baseline(spark, path, hosts=hosts).select("host", "path", "checksum", "size")


@query("review_session", DIFF + """
SELECT host, path, previous_path, kind, reasons, state FROM (
  SELECT *, 'unreviewed' AS state FROM findings)""")
def review_session(spark, sf_dir):
    path = fresh(spark, "review")
    W.write_review(integrity.findings(spark, sf_dir), path, "2024-01-01T00:00:00")
    found, _ = W.read_review(spark, path)
    return found.select(
        "host", "path", "previous_path", "kind", F.array_join("reasons", ", ").alias("reasons"),
        "state",
    )


@query("review_sessions", DIFF + """
SELECT '2024-01-01' AS session_id, 'in_progress' AS status,
       count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'added') AS added,
       count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'moved') AS moved
FROM findings UNION ALL SELECT '2024-01-02', 'clean', 0, 0, 0, 0""")
def review_sessions(spark, sf_dir):
    path = fresh(spark, "review")
    W.write_review(integrity.findings(spark, sf_dir), path, "2024-01-01")
    same = I.baseline(spark, sf_dir)
    W.write_review(D.integrity_diff(same, same), path, "2024-01-02")
    return W.list_sessions(spark, path)


@query("findings_list", DIFF + """
SELECT kind, path FROM findings WHERE kind <> 'moved'
UNION ALL SELECT 'added', path FROM findings WHERE kind = 'moved'
UNION ALL SELECT 'deleted', previous_path FROM findings WHERE kind = 'moved'""")
def findings_list(spark, sf_dir):
    path = fresh(spark, "findings")
    W.write_findings_tsv(integrity.findings(spark, sf_dir), path)
    return W.read_findings_tsv(spark, path)


@query("live_events", logs.EVENT_LINES + r"""
SELECT source, line_no, CASE WHEN contains(line, 'ERROR') THEN 'failed request'
       ELSE 'bought or viewed' END AS selector_desc, regexp_replace(line, '^\[[0-9]+\] ', '') AS line
FROM lines WHERE regexp_matches(line, 'ERROR|PURCHASE|VIEW')""")
def live(spark, sf_dir):
    source = LogSource("live", ("events",), "table", trim_prefix=r"^\[[0-9]+\] ")
    audit = LogAudit((I.EVENTS,), (source,))
    lines = I.lines_of_events(stream(spark, sf_dir, "events"))
    target = fresh(spark, "live")
    writer = (
        live_events(lines, audit, source)
        .select("source", "line_no", "selector_desc", "line")
        .writeStream.format("parquet")
        .option("path", f"{target}/events")
        .option("checkpointLocation", f"{target}/checkpoint")
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{target}/events")


@query("live_grouped_report", logs.RESET_GROUPS + """
SELECT source, key, risk, count, position FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY risk DESC, count DESC, key)
            AS position FROM groups) WHERE position <= 10""")
def live_grouped_report(spark, sf_dir):
    """Three batches of lines, in order of their numbers; most resets come in a later one."""
    target = fresh(spark, "running")
    running = RunningReport(I.AUDIT, I.AUDIT.source("restarts"), target)
    lines = I.event_lines(spark, sf_dir)
    last = F.max("line_no")
    upto = lines.agg((last / 3).cast("long").alias("a"), (2 * last / 3).cast("long").alias("b")).first()
    number = F.col("line_no")
    for batch in (number <= upto.a, (number > upto.a) & (number <= upto.b), number > upto.b):
        lines.filter(batch).write.mode("append").parquet(f"{target}/in")
        running.start(spark.readStream.schema(lines.schema).parquet(f"{target}/in")).awaitTermination()
    rows, _ = running.report(spark)
    return rows.select("source", "key", "risk", "count", "position")


@query("live_diff", DIFF + "SELECT host, path, previous_path, kind FROM findings")
def live_diff(spark, sf_dir):
    """Three batches, each with a part of every host's scan: only the last completes them."""
    target = fresh(spark, "live")
    B.write_baseline(I.baseline(spark, sf_dir), f"{target}/baseline")
    rows = I.current(spark, sf_dir)
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("scan_rows"))
    rows = rows.join(sizes, "host").withColumn("scan_id", F.lit("scan-1"))
    differ = LiveDiff(f"{target}/baseline", f"{target}/found")
    turn = F.pmod(F.xxhash64("path"), F.lit(3))
    for batch in range(3):
        rows.filter(turn == batch).write.mode("append").parquet(f"{target}/in")
        arriving = spark.readStream.schema(ARRIVING).parquet(f"{target}/in")
        differ.start(arriving, f"{target}/checkpoint").awaitTermination()
    return differ.findings(spark).select("host", "path", "previous_path", "kind")


@query("log_files", """
SELECT user_id::VARCHAR AS source, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no,
       '[' || event_id || '] ' || upper(event_type) || ' user=' || user_id || ' ' || props AS line
FROM events""")
def log_files(spark, sf_dir):
    """Every log is written as a text file in its order and read back with line numbers."""
    path = fresh(spark, "logs")
    lines = I.event_lines(spark, sf_dir)
    ordered = lines.repartition("source").sortWithinPartitions("source", "line_no")
    ordered.select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)
    return read_log(spark, path, "files").select(
        F.regexp_extract("file", "/source=([0-9]+)/", 1).alias("source"), "line_no", "line"
    )


WRITTEN = """WITH files AS (
  SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, text FROM documents
), folders AS (
  SELECT DISTINCT lang AS path FROM documents UNION SELECT DISTINCT lang || '/' || source FROM documents UNION SELECT ''
)
"""


def written_tree(spark, sf_dir):
    """The folder of a tree that holds every document as a file, written by the tasks."""
    base = fresh(spark, "tree").removeprefix("file:")
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.lit(base), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )

    def write(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write(content)
            yield batch.select(["path"])

    docs.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    return base


def below(base):
    return F.expr(f"ltrim('/', substring(path, {len(base) + 1}))")


@query("tree_scan", WRITTEN + """
SELECT path, 'file' AS kind, sha256(text) AS checksum, octet_length(encode(text))::BIGINT AS size,
       octet_length(encode(text))::BIGINT AS processed_bytes FROM files
UNION ALL SELECT path, 'directory', NULL, NULL, 0 FROM folders""")
def tree_scan(spark, sf_dir):
    """Every document written as a file, the tree read back with digests."""
    base = written_tree(spark, sf_dir)
    scan = read_tree(spark, Policy(scan_paths=(base,)))
    return scan.snapshot.select(
        below(base).alias("path"), "kind", "checksum", F.when(F.col("kind") == "file", F.col("size")).alias("size"),
        "processed_bytes",
    )


@query("tree_listing", WRITTEN + """
SELECT path, 'file' AS kind, octet_length(encode(text))::BIGINT AS size FROM files WHERE NOT starts_with(path, 'de/')
UNION ALL SELECT path, 'directory', NULL FROM folders WHERE NOT starts_with(path, 'de/') AND path <> 'de'""")
def tree_listing(spark, sf_dir):
    """The tree's metadata without an excluded folder; no content is read."""
    base = written_tree(spark, sf_dir)
    rows = list_tree(spark, Policy(scan_paths=(base,), exclusions=(f"{base}/de",)))
    return rows.filter("NOT failed").select(
        below(base).alias("path"), "kind", F.when(F.col("kind") == "file", F.col("size")).alias("size")
    )


@query("journal_lines", """
SELECT 'host' || user_id % 4 AS file, row_number() OVER (PARTITION BY user_id % 4
         ORDER BY event_id) AS line_no, event_type || ' ' || event_id AS line
FROM events WHERE event_type <> 'view' AND event_id >= 100""")
def journal_lines(spark, sf_dir):
    path = fresh(spark, "journal")
    event = F.col("event_id")
    start = 1_700_000_000_000_000  # 2023-11-14 22:13:20 UTC
    rows = I.table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit(" "), event.cast("string")).alias("MESSAGE"),
        F.when(F.col("event_type") == "view", "viewer").otherwise("shop").alias("_SYSTEMD_UNIT"),
        F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("_HOSTNAME"),
        (F.lit(start) + event * 1_000_000).cast("string").alias("__REALTIME_TIMESTAMP"),
    )
    rows.write.json(path)
    return read_journal(spark, path, "j", unit="shop", since="2023-11-14 22:15:00").select(
        "file", "line_no", "line"
    )


@query("audit_files", """
SELECT user_id::VARCHAR AS log_id, count(*) AS events, NULL AS bad_line, NULL AS cause
FROM events GROUP BY user_id""")
def audit_files(spark, sf_dir):
    path = fresh(spark, "audit")
    write_logs(chain_audit(I.audit_events(spark, sf_dir)), path)
    lines = read_audit(spark, path).withColumn(
        "log_id", F.regexp_extract("log_id", "/log_id=([0-9]+)[/.]", 1)
    )
    return verify_audit(lines).select("log_id", "events", "bad_line", "cause")


@query("policy_findings", DIFF + """
SELECT host, path, 'modified' AS kind, 'policy' AS reasons, sha256('old policy') AS before_checksum,
       checksum AS after_checksum, size FROM current_rows""")
def policy_findings(spark, sf_dir):
    found = D.policy_finding(I.current(spark, sf_dir), hashlib.sha256(b"old policy").hexdigest())
    return found.select(
        "host", "path", "kind", F.array_join("reasons", ", ").alias("reasons"),
        F.col("before.checksum").alias("before_checksum"),
        F.col("after.checksum").alias("after_checksum"), "size",
    )


# --- small functions over whole tables ----------------------------------------------------


@query("path_keys", DIFF + "SELECT host, path, md5(path) AS key FROM baseline")
def path_keys(spark, sf_dir):
    return I.baseline(spark, sf_dir).select("host", "path", P.path_key("path").alias("key"))


@query("path_texts", DIFF + """
SELECT host, path, replace('C:' || replace(path, '/', '\\'), '\\', '/') AS normalised,
       path AS compared FROM baseline""")
def path_texts(spark, sf_dir):
    windows = F.concat(F.lit("C:"), F.replace("path", F.lit("/"), F.lit("\\")))
    return I.baseline(spark, sf_dir).select(
        "host", "path", P.normalised(windows).alias("normalised"),
        P.without_private_alias(F.concat(F.lit("/private"), "path")).alias("compared"),
    )


@query("log_insensitive", logs.LINES + """
SELECT source, file, line_no FROM lines
WHERE contains(lower(line), 'license') AND NOT contains(lower(line), 'the')""")
def log_insensitive(spark, sf_dir):
    from keelson.config import Selector

    selector = Selector("contains", "", ("LICENSE",), ("The",), insensitive=True)
    return I.log_lines(spark, sf_dir).filter(selector_test(selector)).select(
        "source", "file", "line_no"
    )


@query("security_hashes", """
SELECT doc_id, sha256('security-metadata|dev=1|inode=' || doc_id || CASE WHEN doc_id % 5 = 0 THEN ''
   ELSE '|nlink=' || (doc_id % 3 + 1) END || '|flags=0|xattrs=' || upper(hex('user.lang')) || '='
   || upper(hex(lang)) || ',' || upper(hex('user.source')) || '=' || upper(hex(source))
   || CASE WHEN doc_id % 7 = 0 THEN '|error=EACCES' ELSE '' END) AS security_hash,
   CASE WHEN doc_id % 5 = 0 THEN 'directory' ELSE 'file' END AS kind
FROM documents""")
def security_hashes(spark, sf_dir):
    doc = F.col("doc_id")
    kind = L.kind_label(doc % 5 == 0, F.lit(False), F.lit(False))
    xattrs = F.create_map(F.lit("user.source"), "source", F.lit("user.lang"), "lang")
    return I.table(spark, sf_dir, "documents").select(
        "doc_id",
        G.security_hash(F.lit(1), doc, doc % 3 + 1, kind, F.lit(0), xattrs,
                        F.when(doc % 7 == 0, "EACCES")).alias("security_hash"),
        kind.alias("kind"),
    )


@query("digest_codec", DIFF + """
SELECT host, path, checksum, CASE WHEN size % 2 = 0 THEN checksum END AS parsed FROM baseline""")
def digest_codec(spark, sf_dir):
    shown = F.when(F.col("size") % 2 == 0, F.upper("checksum")).otherwise(
        F.concat("checksum", F.lit("0")))
    return I.baseline(spark, sf_dir).select(
        "host", "path", "checksum", G.hex_digest(G.parse_digest(shown)).alias("parsed")
    )


@query("config_pin", """
SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ok' ELSE 'mismatch' END AS status
FROM customer""")
def config_pin(spark, sf_dir):
    pinned = hashlib.sha256(b"BUILDING").hexdigest()
    rows = I.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), G.text_digest("c_mktsegment").alias("config_hash")
    )
    return H.config_pin(rows, pinned).select("id", "status")


@query("sparse_ids", """
SELECT o_custkey AS id, array_to_string(list_sort(list_distinct(list(o_orderkey % 50))), ',') AS ids
FROM orders GROUP BY o_custkey""")
def sparse_ids(spark, sf_dir):
    grouped = I.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.collect_set(F.col("o_orderkey") % 50).alias("ids")
    )
    return grouped.select("id", F.array_join(V.sparse_ids("ids"), ",").alias("ids"))


QUERIES, ORACLES = query.queries, query.oracles
