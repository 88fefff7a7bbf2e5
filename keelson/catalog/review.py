"""Registered queries over reviews, stored baselines, audit trails and host health."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog import inputs as I
from keelson.catalog.register import Register
from keelson.config import AlertPolicy, Policy
from keelson.functions import formats as N, paths as P
from keelson.functions.digests import content_digest, processed_bytes, text_digest
from keelson.functions.labels import parse_reasons, reason_text
from keelson.operators import audit as A, diff as D, health as H, review as V
from keelson.operators.alerts import capped_details, scan_alerts
from keelson.operators.fingerprint import fingerprint, verify_baseline
from keelson.operators.rates import scan_rate
from keelson.plans.integrity import integrity_scan
from keelson.sinks.baseline import checkpoint, config_drift, next_generation
from keelson.sources.mounts import parse_mountinfo
from keelson.sources.registry import registry_rows

query = Register()

REVIEW = I.REVIEW_CTES


def replayed(spark, sf_dir):
    found = I.review_findings(spark, sf_dir)
    return V.replay_actions(found, I.review_actions(found))


@query("replay_actions", REVIEW + "SELECT session_id, finding_id, path, state, action FROM replayed")
def replay_actions(spark, sf_dir):
    return replayed(spark, sf_dir).select("session_id", "finding_id", "path", "state", "action")


@query("state_counts", REVIEW + """
SELECT host, state, count(*) AS count FROM replayed GROUP BY host, state""")
def state_counts(spark, sf_dir):
    return V.state_counts(replayed(spark, sf_dir))


IMPACT = REVIEW + """, above AS (
  SELECT host, path, state, unnest(list_transform(
    range(2, len(string_split(path, '/'))),
    lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS directory FROM replayed),
impact AS (SELECT host, directory, count(*) FILTER (state = 'unreviewed') AS affects
           FROM above GROUP BY host, directory)
"""


@query("directory_impact", IMPACT + "SELECT host, directory, affects FROM impact")
def directory_impact(spark, sf_dir):
    return V.directory_impact(replayed(spark, sf_dir))


@query("exclusion_targets", IMPACT + """
SELECT host, path, path AS target, false AS directory, 1 AS affects, 0 AS level FROM replayed
UNION ALL
SELECT a.host, a.path, a.directory, true, i.affects,
       len(string_split(a.path, '/')) - len(string_split(a.directory, '/'))
FROM above a JOIN impact i ON i.host = a.host AND i.directory = a.directory""")
def exclusion_targets(spark, sf_dir):
    return V.exclusion_targets(replayed(spark, sf_dir))


@query("filter_findings", REVIEW + """
SELECT host, path, kind, state FROM replayed
WHERE state = 'approved' AND (contains(lower(path), 'src1') OR contains(kind, 'src1'))""")
def filter_findings(spark, sf_dir):
    return V.filter_findings(replayed(spark, sf_dir), "approved", "SRC1").select(
        "host", "path", "kind", "state"
    )


@query("affected_counts", REVIEW + """
SELECT session_id, action_id, kind, (kind <> 'exclude')::INT AS affected FROM actions""")
def affected_counts(spark, sf_dir):
    return V.affected_counts(I.review_actions(I.review_findings(spark, sf_dir)))


@query("retained_actions", REVIEW + """
SELECT session_id, action_id FROM (SELECT *, row_number() OVER (
  PARTITION BY session_id ORDER BY action_id DESC) AS age FROM actions WHERE NOT undone)
WHERE age <= 20""")
def retained_actions(spark, sf_dir):
    actions = I.review_actions(I.review_findings(spark, sf_dir))
    return V.retained_actions(actions, 20).select("session_id", "action_id")


@query("undo_last", REVIEW + """
SELECT session_id, action_id, undone OR action_id = max(action_id) FILTER (NOT undone)
       OVER (PARTITION BY session_id) AS undone FROM actions""")
def undo_last(spark, sf_dir):
    actions = I.review_actions(I.review_findings(spark, sf_dir))
    return V.undo_last(actions).select("session_id", "action_id", "undone")


@query("exclusion_list", REVIEW + """
SELECT DISTINCT session_id, target FROM actions WHERE kind = 'exclude' AND NOT undone""")
def exclusion_list(spark, sf_dir):
    return V.exclusion_list(I.review_actions(I.review_findings(spark, sf_dir)))


APPROVALS = REVIEW + """, changes AS (
  SELECT DISTINCT host, 'add' AS change, path FROM replayed
  WHERE state = 'approved' AND action = 'approve'
  UNION SELECT DISTINCT host, 'remove', coalesce(previous_path, path) FROM replayed
  WHERE state = 'approved' AND action = 'approve')
"""


@query("approval_paths", APPROVALS + "SELECT host, change, path FROM changes")
def approval_paths(spark, sf_dir):
    return V.approval_paths(replayed(spark, sf_dir))


@query("plan_apply", APPROVALS + """,
n AS (SELECT host, count(*) FILTER (change = 'add') AS approved_add,
             count(*) FILTER (change = 'remove') AS approved_remove FROM changes GROUP BY host),
x AS (SELECT session_id AS host, count(DISTINCT target) AS exclusions FROM actions
      WHERE kind = 'exclude' AND NOT undone GROUP BY session_id)
SELECT h.host, coalesce(approved_add, 0) AS approved_add,
       coalesce(approved_remove, 0) AS approved_remove, false AS config_hash_updated,
       greatest(coalesce(approved_add, 0), coalesce(approved_remove, 0)) AS approvals,
       coalesce(exclusions, 0) AS exclusions
FROM (SELECT DISTINCT host FROM replayed) h LEFT JOIN n USING (host) LEFT JOIN x USING (host)""")
def plan_apply(spark, sf_dir):
    found = I.review_findings(spark, sf_dir)
    actions = I.review_actions(found)
    exclusions = V.exclusion_list(actions).withColumnRenamed("session_id", "host")
    return V.plan_apply(V.replay_actions(found, actions), exclusions)


@query("apply_review", APPROVALS + """
SELECT host, path, checksum, size, mode FROM baseline b WHERE NOT EXISTS (
  SELECT 1 FROM changes c WHERE c.change = 'remove' AND c.host = b.host AND c.path = b.path)
UNION ALL SELECT host, path, checksum, size, mode FROM current_rows r WHERE EXISTS (
  SELECT 1 FROM changes c WHERE c.change = 'add' AND c.host = r.host AND c.path = r.path)""")
def apply_review(spark, sf_dir):
    return V.apply_review(
        I.baseline(spark, sf_dir), I.current(spark, sf_dir), replayed(spark, sf_dir)
    ).select("host", "path", "checksum", "size", "mode")


@query("reason_codec", I.diff_ctes() + "SELECT host, path, reasons AS text FROM diff WHERE reasons <> ''")
def reason_codec(spark, sf_dir):
    changes = D.snapshot_changes(I.baseline(spark, sf_dir), I.current(spark, sf_dir))
    written = changes.filter("kind = 'modified'").select(
        "host", "path", reason_text("reasons").alias("text")
    )
    return written.withColumn("text", reason_text(parse_reasons("text")))


@query("move_codec", I.diff_ctes() + """
SELECT host, path, previous_path, kind FROM findings""")
def move_codec(spark, sf_dir):
    found = D.integrity_diff(I.baseline(spark, sf_dir), I.current(spark, sf_dir))
    encoded = found.select(
        "host", "kind",
        F.coalesce(P.encode_move("path", "previous_path"), F.col("path")).alias("encoded"),
    )
    return encoded.select("host", "kind", P.decode_move("encoded").alias("d")).select("host", "kind", "d.*")


# --- stored baselines ---------------------------------------------------------------------

ROW_TEXT = """concat_ws(chr(31), '=' || host, '=' || path, '=' || kind,
  '=' || checksum, '=' || size, '=' || mode, '=' || uid, '=' || gid, '=' || mtime_ns,
  '-', '-', '-', '=' || processed_bytes)"""


def fingerprint_ctes(name, rows, by=""):
    """The count and the hash of the digests' sums, in all or per host."""
    limbs = ", ".join(
        f"sum(('0x' || substr(digest, {at}, 5))::BIGINT)::VARCHAR" for at in range(1, 129, 5)
    )
    return f"""{name}_rows AS (SELECT {by} sha256('0' || t) || sha256('1' || t) AS digest
  FROM (SELECT *, {ROW_TEXT} AS t FROM {rows})),
{name} AS (SELECT {by} count(*) AS records, sha256(concat_ws(':', count(*)::VARCHAR, {limbs})) AS content_hash
  FROM {name}_rows GROUP BY ALL)"""


def host_marks(name, rows):
    return fingerprint_ctes(name, rows, "host,")


@query("baseline_fingerprint", I.diff_ctes() + ", " + fingerprint_ctes("mark", "baseline")
       + " SELECT records, content_hash FROM mark")
def baseline_fingerprint(spark, sf_dir):
    return fingerprint(I.baseline(spark, sf_dir))


CREATED = 1_700_000_000_000


def manifest_of(snapshot, generation, by=()):
    return fingerprint(snapshot, by).select(
        *by,
        F.lit(generation).cast("long").alias("generation"), "records",
        F.lit(0).cast("long").alias("scan_byte_limit"),
        (F.lit(CREATED) + F.col("records")).alias("created_unix_ms"),
        text_digest(F.lit("policy")).alias("config_hash"), "content_hash",
    )


@query("baseline_verify", I.diff_ctes() + ", " + host_marks("mark", "baseline") + ", "
       + host_marks("other", "current_rows") + """
SELECT host, 1 AS generation, '' AS mismatches FROM mark
UNION ALL SELECT host, 2, CASE WHEN m.records <> o.records THEN 'record_count, ' ELSE '' END
  || 'scan_byte_limit, config_hash' || CASE WHEN m.content_hash <> o.content_hash
     THEN ', content_hash' ELSE '' END FROM mark m JOIN other o USING (host)""")
def baseline_verify(spark, sf_dir):
    old, new = I.baseline(spark, sf_dir), I.current(spark, sf_dir)
    good = verify_baseline(old, manifest_of(old, 1, ["host"]), scan_byte_limit=0)
    bad = verify_baseline(
        new, manifest_of(old, 2, ["host"]), scan_byte_limit=4096, config_hash="0" * 64
    )
    return good.unionByName(bad).select(
        "host", "generation", F.array_join("mismatches", ", ").alias("mismatches")
    )


@query("checkpoint", I.diff_ctes() + ", " + fingerprint_ctes("mark", "baseline") + f"""
SELECT 7 AS generation, '{{"format":"keelson-baseline-checkpoint-v1","records":' || records
  || ',"generation":7,"created_unix_ms":' || ({CREATED} + records) || ',"created_utc":"'
  || strftime(make_timestamp(({CREATED} + records) * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC"'
  || ',"manifest_path":"/baselines/manifest","manifest_hash":"' || sha256(
     'generation: 7' || chr(10) || 'records: ' || records || chr(10) || 'scan_byte_limit: 0'
     || chr(10) || 'created_unix_ms: ' || ({CREATED} + records) || chr(10) || 'config_hash: '
     || sha256('policy') || chr(10) || 'content_hash: ' || content_hash)
  || '","config_hash":"' || sha256('policy') || '","min_generation":7}}' AS checkpoint FROM mark""")
def checkpoint_record(spark, sf_dir):
    return checkpoint(manifest_of(I.baseline(spark, sf_dir), 7), "/baselines")


@query("next_generation", """
SELECT max(o_orderkey) + 1 AS generation FROM orders""")
def generation(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders")
    return next_generation(orders.select(F.col("o_orderkey").alias("generation")))


@query("config_drift", """
SELECT 'host' || c_custkey AS host, CASE WHEN c_custkey % 13 = 0 THEN 'unrecorded'
       WHEN c_custkey % 5 = 0 THEN 'drift' ELSE 'ok' END AS status FROM customer""")
def drift(spark, sf_dir):
    key = F.col("c_custkey")
    host = F.concat(F.lit("host"), key.cast("string"))
    customers = I.table(spark, sf_dir, "customer")
    stored = customers.select(
        host.alias("host"), F.when(key % 13 != 0, text_digest("c_name")).alias("config_hash")
    )
    present = customers.select(
        host.alias("host"),
        text_digest(F.concat("c_name", F.when(key % 5 == 0, "+").otherwise(""))).alias(
            "current_config_hash"),
    )
    return config_drift(stored, present).select("host", "status")


# --- audit trails -------------------------------------------------------------------------


@query("audit_chain", f"WITH RECURSIVE {I.AUDIT_CHAIN_SQL} SELECT log_id, seq, line FROM audit_lines")
def audit_chain(spark, sf_dir):
    return A.chain_audit(I.audit_events(spark, sf_dir))


TAMPERED = f"""WITH RECURSIVE {I.AUDIT_CHAIN_SQL},
kept AS (
  SELECT log_id, seq, hash, previous,
         log_id::BIGINT % 3 = 2 AND seq % 89 = 7 AS edited,
         lag(hash) OVER (PARTITION BY log_id ORDER BY seq) AS before
  FROM audit_lines WHERE NOT (log_id::BIGINT % 3 = 1 AND seq % 97 = 13)),
judged AS (
  SELECT *, CASE WHEN previous <> coalesce(before, repeat('0', 64)) THEN 'chain mismatch'
                 WHEN edited THEN 'hash mismatch' END AS cause FROM kept)
"""


@query("audit_lines_verified", TAMPERED + "SELECT log_id, seq, hash, cause FROM judged")
def audit_lines_verified(spark, sf_dir):
    return A.verify_lines(I.tampered_lines(spark, sf_dir)).drop("_block")


@query("audit_verify", TAMPERED + """,
stops AS (SELECT log_id, min(seq) AS bad_line, arg_min(cause, seq) AS cause
          FROM judged WHERE cause IS NOT NULL GROUP BY log_id)
SELECT log_id, count(*) FILTER (bad_line IS NULL OR seq < bad_line) AS events,
       coalesce(arg_max(hash, seq) FILTER (bad_line IS NULL OR seq < bad_line), repeat('0', 64))
       AS last_hash, any_value(bad_line) AS bad_line, any_value(s.cause) AS cause
FROM judged j LEFT JOIN stops s USING (log_id) GROUP BY log_id""")
def audit_verify(spark, sf_dir):
    return A.verify_audit(I.tampered_lines(spark, sf_dir))


@query("audit_fields", """
SELECT user_id::VARCHAR AS log_id, event_id AS seq, event_type AS action, props
FROM events""")
def audit_fields(spark, sf_dir):
    return A.chain_audit(I.audit_events(spark, sf_dir)).select(
        "log_id", "seq", A.json_text("line", "action").alias("action"),
        A.json_text("line", "props").alias("props"),
    )


# --- health -------------------------------------------------------------------------------


TRUST = I.diff_ctes() + """,
tree AS (
  SELECT host, path, mode, uid, false AS folder FROM current_rows UNION ALL
  SELECT DISTINCT host, unnest(['/', '/srv', '/srv/' || string_split(path, '/')[3],
         '/srv/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[4]]),
         16877, 0, true FROM current_rows),
bad_tree AS (
  SELECT host, path, folder,
         CASE WHEN folder AND ends_with(path, '/en') THEN 16895
              WHEN folder AND path = '/srv/src6' THEN 16893 ELSE mode END AS mode, uid FROM tree),
issues AS (
  SELECT host, path, folder, 'group/world writable, mode ' || printf('%o', mode & 511) AS issue
  FROM bad_tree WHERE mode & 18 <> 0
  UNION ALL SELECT host, path, folder, 'not owned by root' FROM bad_tree WHERE uid <> 0)"""


def loose_tree(spark, sf_dir):
    """The current rows and their folders, some of them with a mode that is not trusted."""
    folder = F.col("kind") == "directory"
    return I.with_folders(I.current(spark, sf_dir)).withColumn(
        "mode",
        F.when(folder & F.col("path").endswith("/en"), 16895)
        .when(folder & (F.col("path") == "/srv/src6"), 16893)
        .otherwise(F.col("mode"))
        .cast("long"),
    )


@query("trust_issues", TRUST + """,
wanted AS (SELECT host, path FROM baseline)
SELECT w.host, w.path AS target, i.path, i.issue FROM wanted w JOIN issues i
  ON i.host = w.host AND NOT i.folder AND i.path = w.path
UNION ALL SELECT w.host, w.path, i.path, i.issue FROM wanted w JOIN issues i
  ON i.host = w.host AND i.folder AND starts_with(w.path, i.path || '/')
UNION ALL SELECT w.host, w.path, w.path, 'not found' FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM current_rows c WHERE c.host = w.host AND c.path = w.path)""")
def trust_issues(spark, sf_dir):
    return H.trust_issues(loose_tree(spark, sf_dir), I.baseline(spark, sf_dir))


@query("data_trust", TRUST + """,
data AS (SELECT DISTINCT host, '/srv/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[4] AS path
         FROM baseline)
SELECT d.host, d.path AS target, i.path, i.issue FROM data d JOIN issues i
  ON i.host = d.host AND i.folder AND (i.path = d.path OR starts_with(d.path, i.path || '/'))
UNION ALL SELECT d.host, d.path, i.path, i.issue FROM data d JOIN issues i
  ON i.host = d.host AND NOT i.folder AND regexp_replace(i.path, '/[^/]*$', '') = d.path""")
def data_trust(spark, sf_dir):
    folders = I.baseline(spark, sf_dir).select("host", P.parent("path").alias("path")).distinct()
    return H.data_trust_issues(loose_tree(spark, sf_dir), folders)


def fleet_policies(spark, sf_dir):
    key = F.col("c_custkey")
    no_texts = F.array().cast("array<string>")
    return I.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("host"), key.cast("string")).alias("host"),
        F.when(key % 11 == 0, no_texts)
        .when(key % 7 == 0, F.array(F.lit("/etc"), F.lit("/var/lib/db/old")))
        .otherwise(F.array(F.lit("/etc")))
        .alias("scan_paths"),
        F.lit("/var/lib/db").alias("db_path"),
        F.when(key % 17 == 0, F.array(F.lit("/"), F.lit("/tmp"))).otherwise(
            F.array(F.lit("/tmp"))).alias("exclusions"),
        F.when(key % 19 == 0, no_texts).otherwise(F.array(F.lit("proc"))).alias(
            "excluded_filesystems"),
        F.when(key % 23 == 0, F.array(F.lit("C:\\*"), F.lit("/"))).otherwise(no_texts).alias(
            "metadata_rules"),
        F.when(key % 3 == 0, key * 1125).otherwise(0).cast("long").alias("scan_byte_limit"),
    )


def bytes_sql(value):
    """Scaled text with DuckDB's own exact rounding."""
    units = ["KB", "MB", "GB", "TB", "PB"]
    arms, step = [f"WHEN {value} < 1000 THEN printf('%.0fB', {value}::DOUBLE)"], f"{value}::DOUBLE"
    for i, unit in enumerate(units):
        step = f"({step} / 1000.0::DOUBLE)"
        last = i == len(units) - 1
        form = (f"CASE WHEN {step} < 10 THEN printf('%.2f{unit}', {step}) WHEN {step} < 100 "
                f"THEN printf('%.1f{unit}', {step}) ELSE printf('%.0f{unit}', {step}) END")
        arms.append(f"ELSE {form}" if last else f"WHEN {step} < 1000 THEN {form}")
    return f"(CASE {' '.join(arms)} END)"


POLICY_SQL = f"""
SELECT host, 'no_scan_paths' AS warning, '' AS detail FROM p WHERE k % 11 = 0
UNION ALL SELECT host, 'partial_hashing', {bytes_sql('(k * 1125)')} FROM p
  WHERE k % 3 = 0 AND k > 0
UNION ALL SELECT host, 'no_excluded_filesystems', '' FROM p WHERE k % 19 = 0
UNION ALL SELECT host, 'scan_path_in_db_path', '/var/lib/db/old' FROM p
  WHERE k % 7 = 0 AND k % 11 <> 0
UNION ALL SELECT host, 'root_excluded', '/' FROM p WHERE k % 17 = 0
UNION ALL SELECT host, 'root_metadata_only', '/' FROM p WHERE k % 23 = 0
"""
POLICIES = "WITH p AS (SELECT 'host' || c_custkey AS host, c_custkey AS k FROM customer)"


@query("policy_warnings", POLICIES + POLICY_SQL)
def policy_warnings(spark, sf_dir):
    return H.policy_warnings(fleet_policies(spark, sf_dir))


@query("issue_preview", POLICIES + f""", w AS ({POLICY_SQL})
SELECT host, warning, detail, position, total, greatest(total - 2, 0) AS omitted FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY warning, detail) AS position,
         count(*) OVER (PARTITION BY host) AS total FROM w) WHERE position <= 2""")
def issue_preview(spark, sf_dir):
    warnings = H.policy_warnings(fleet_policies(spark, sf_dir))
    return H.preview(warnings, ["warning", "detail"], shown=2)


@query("duplicate_sources", """
SELECT 'host' || (p_partkey % 10) AS host, 'log' || (p_partkey % 70) % 37 AS name, count(*) AS count
FROM part GROUP BY ALL HAVING count(*) > 1""")
def duplicate_sources(spark, sf_dir):
    return H.duplicate_sources(log_sources(spark, sf_dir), ["host"])


def log_sources(spark, sf_dir):
    part = F.col("p_partkey")
    return I.table(spark, sf_dir, "part").select(
        F.concat(F.lit("host"), (part % 10).cast("string")).alias("host"),
        F.concat(F.lit("log"), (part % 70 % 37).cast("string")).alias("name"),
        F.concat(F.lit("rule"), (part % 41).cast("string")).alias("rule_name"),
    )


@query("unknown_rules", """
SELECT 'host' || (p_partkey % 10) AS host, 'log' || (p_partkey % 70) % 37 AS name,
       'rule' || (p_partkey % 41) AS rule_name
FROM part WHERE NOT ('rule' || (p_partkey % 41)) IN (
  SELECT 'rule' || s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)""")
def unknown_rules(spark, sf_dir):
    rules = I.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(
        F.concat(F.lit("rule"), F.col("s_suppkey").cast("string")).alias("name")
    )
    return H.unknown_rules(log_sources(spark, sf_dir), rules)


@query("mountinfo", f"""WITH mounts AS ({I.MOUNTS_SQL})
SELECT host, CASE WHEN mountpoint LIKE '/srv/src%' THEN replace(mountpoint, 'src', 'my src\\')
       ELSE mountpoint END AS mountpoint, fs_type FROM mounts""")
def mountinfo(spark, sf_dir):
    shown = F.replace("mountpoint", F.lit("src"), F.lit("my\\040src\\134"))
    line = F.concat(F.lit("36 35 98:0 /mnt1 "), shown, F.lit(" rw,noatime master:1 - "), "fs_type",
                    F.lit(" /dev/root rw,errors=continue"))
    lines = I.mounts(spark, sf_dir).select("host", F.explode(
        F.array(line, F.lit("not a mount line"), F.lit("too few - fields"))).alias("line"))
    return parse_mountinfo(lines)


# --- numbers, texts and small codecs ------------------------------------------------------


RATE = "(CASE WHEN {ms} <= 0 THEN '0{unit}/s' ELSE {text} || '/s' END)"


def file_rate_sql(amount, ms):
    value = f"({amount}::DOUBLE / ({ms}::DOUBLE / 1000.0::DOUBLE))"
    text = bytes_sql(value)
    for unit in ("KB", "MB", "GB"):
        text = text.replace(f"f{unit}'", f"f{unit[0].replace('G', 'B')}f'")
    return RATE.format(ms=ms, unit="f", text=text.replace("%.0fB'", "%.0ff'"))


@query("scan_rate", f"""WITH s AS ({I.SAMPLES_SQL}),
starts AS (SELECT run_id, min(ts_ms) AS ts0, arg_min(files, ts_ms) AS files0,
                  arg_min(bytes, ts_ms) AS bytes0 FROM s GROUP BY run_id),
looked AS (
  SELECT s.*, s.ts_ms - ts0 AS average_elapsed_ms, s.files - coalesce(p.files, files0) AS recent_files,
         s.bytes - coalesce(p.bytes, bytes0) AS recent_bytes,
         s.ts_ms - coalesce(p.ts_ms, ts0) AS recent_elapsed_ms
  FROM s JOIN starts USING (run_id)
  ASOF LEFT JOIN s p ON p.run_id = s.run_id AND s.ts_ms - 5000 >= p.ts_ms)
SELECT *, {file_rate_sql('recent_files', 'recent_elapsed_ms')} AS recent_file_rate,
  {RATE.format(ms='recent_elapsed_ms', unit='B',
   text=bytes_sql('(recent_bytes::DOUBLE / (recent_elapsed_ms::DOUBLE / 1000.0::DOUBLE))'))}
  AS recent_byte_rate,
  {file_rate_sql('files', 'average_elapsed_ms')} AS average_file_rate,
  {RATE.format(ms='average_elapsed_ms', unit='B',
   text=bytes_sql('(bytes::DOUBLE / (average_elapsed_ms::DOUBLE / 1000.0::DOUBLE))'))}
  AS average_byte_rate FROM looked""")
def rates(spark, sf_dir):
    return scan_rate(I.samples(spark, sf_dir))


@query("scan_rate_long", f"""WITH s AS ({I.SAMPLES_SQL}),
starts AS (SELECT run_id, min(ts_ms) AS ts0, arg_min(files, ts_ms) AS files0 FROM s GROUP BY run_id)
SELECT s.run_id, s.ts_ms, s.files - coalesce(p.files, files0) AS recent_files,
       s.ts_ms - coalesce(p.ts_ms, ts0) AS recent_elapsed_ms
FROM s JOIN starts USING (run_id)
ASOF LEFT JOIN s p ON p.run_id = s.run_id AND s.ts_ms - 150000 >= p.ts_ms""")
def long_rates(spark, sf_dir):
    """The same over two and a half minutes, more than a bucket."""
    found = scan_rate(I.samples(spark, sf_dir), 150_000)
    return found.select("run_id", "ts_ms", "recent_files", "recent_elapsed_ms")


@query("format_bytes", f"""WITH v AS (SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey * 1005
       WHEN 2 THEN o_orderkey * 1000005 ELSE o_orderkey * 98765432101 END AS value FROM orders)
SELECT id, value, {bytes_sql('value')} AS text FROM v""")
def format_bytes(spark, sf_dir):
    key = F.col("o_orderkey")
    value = (
        F.when(key % 4 == 0, key).when(key % 4 == 1, key * 1005)
        .when(key % 4 == 2, key * 1_000_005).otherwise(key * 98_765_432_101)
    )
    rows = I.table(spark, sf_dir, "orders").select(key.alias("id"), value.alias("value"))
    return rows.withColumn("text", N.format_bytes("value"))


@query("utc_text", """
SELECT o_orderkey AS id, strftime(o_orderdate + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S')
       || ' UTC' AS text FROM orders""")
def utc_texts(spark, sf_dir):
    orders = I.table(spark, sf_dir, "orders")
    since = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    at = since + F.col("o_orderkey")
    return orders.select(F.col("o_orderkey").alias("id"), N.utc_text(at * 1000).alias("text"))


@query("registry_rows", """
WITH keys AS (
  SELECT 'host' || (p_partkey % 4) AS host, 'Software\\Vendor' || p_partkey AS subkey, p_partkey AS k
  FROM part)
SELECT host, 'registry://HKLM/' || replace(subkey, '\\', '/') AS path, 'special' AS kind,
       sha256('registry-key|3|1|' || (k * 1000000100)) AS checksum, 0 AS size,
       k * 1000000100 AS mtime_ns FROM keys
UNION ALL SELECT host, 'registry://HKLM/' || replace(subkey, '\\', '/') || '#a%2Fb%23' || k, 'special',
       sha256('registry-value|1|' || len('part' || k) || '|' || upper(hex('part' || k))),
       len('part' || k), 0 FROM keys""")
def registry(spark, sf_dir):
    part = F.col("p_partkey").cast("long")
    base = I.table(spark, sf_dir, "part").select(
        F.concat(F.lit("host"), (part % 4).cast("string")).alias("host"),
        F.lit("HKLM").alias("root"),
        F.concat(F.lit("Software\\Vendor"), part.cast("string")).alias("subkey"),
        part.alias("k"),
    )
    ticks = F.lit(N.FILETIME_EPOCH_SECONDS * N.FILETIME_TICKS) + F.col("k") * 10_000_001
    keys = base.withColumns(
        {"subkeys": F.lit(3), "values": F.lit(1), "last_write": ticks}
    )
    values = base.withColumns(
        {
            "name": F.concat(F.lit("a/b#"), F.col("k").cast("string")),
            "value_kind": F.lit(1),
            "data": F.concat(F.lit("part"), F.col("k").cast("string")).cast("binary"),
        }
    )
    return registry_rows(keys, values).select(
        "host", "path", "kind", "checksum", "size", "mtime_ns"
    )


@query("content_digests", """
SELECT doc_id, sha256(text) AS whole, octet_length(encode(text)) AS bytes,
       least(octet_length(encode(text)), 4096) AS processed FROM documents""")
def content_digests(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    data = F.encode("text", "utf-8")
    size = F.octet_length(data).cast("long")
    return docs.select(
        "doc_id", content_digest(data).alias("whole"), size.alias("bytes"),
        processed_bytes(size, 4096).alias("processed"),
    )


@query("limited_digests", """
SELECT event_id, sha256(substr(props, 1, 4)) AS checksum FROM events""")
def limited_digests(spark, sf_dir):
    return I.table(spark, sf_dir, "events").select(
        "event_id", content_digest(F.encode("props", "utf-8"), 4).alias("checksum")
    )


@query("path_ancestors", I.diff_ctes() + """
SELECT host, path, '/srv/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[4]
       AS parent, path || '|/srv/' || string_split(path, '/')[3] || '/'
       || string_split(path, '/')[4] || '|/srv/' || string_split(path, '/')[3] || '|/srv|/'
       AS ancestors FROM baseline""")
def path_ancestors(spark, sf_dir):
    return I.baseline(spark, sf_dir).select(
        "host", "path", P.parent("path").alias("parent"),
        F.array_join(P.ancestors("path", include_root=True), "|").alias("ancestors"),
    )


@query("scan_alerts", I.diff_ctes() + """,
totals AS (SELECT host, count(*) AS n FROM findings GROUP BY host),
stats AS (SELECT host, count(*) AS files FROM current_rows GROUP BY host),
placed AS (SELECT host, path, row_number() OVER (PARTITION BY host ORDER BY path, kind) AS k
           FROM findings),
lists AS (SELECT host, string_agg(path || chr(10), '' ORDER BY k) AS body FROM placed
          WHERE k <= 3 GROUP BY host)
SELECT host, false AS success, 'a@example.com' AS sender, 'b@example.com' AS recipient,
       'ALERT: File Integrity Monitor detected problems' AS subject,
       'The file Integrity monitor File Integrity Scan scanned 0 directories and ' || files
       || ' files.' || chr(10) || chr(10) || 'Detected ' || n
       || ' problems with the following files.' || chr(10) || chr(10) || body
       || CASE WHEN n > 3 THEN (n - 3) || ' additional findings omitted from email details'
          || chr(10) ELSE '' END AS body, NULL AS error
FROM totals JOIN stats USING (host) JOIN lists USING (host)""")
def scan_alert_rows(spark, sf_dir):
    scan = integrity_scan(I.baseline(spark, sf_dir), I.current(spark, sf_dir))
    messages = scan.findings.select("host", "path", F.col("path").alias("message"))
    policy = AlertPolicy(True, False, "a@example.com", "b@example.com")
    return scan_alerts(scan.summary, capped_details(messages, 3), policy)


QUERIES, ORACLES = query.queries, query.oracles
