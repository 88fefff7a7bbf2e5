"""Registered queries over snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog import inputs as I
from keelson.catalog.register import Register
from keelson.config import Policy
from keelson.functions.labels import finding_message, pack_flags, review_text
from keelson.functions.paths import component_order
from keelson.operators import diff as D, review as V, scope as S
from keelson.operators.alerts import capped_details
from keelson.plans.integrity import integrity_scan
from keelson.sinks.review import findings_tsv
from keelson.sources.snapshots import apply_content_policy

query = Register()

DIFF = I.diff_ctes()


def findings(spark, sf_dir, **options):
    return D.integrity_diff(I.baseline(spark, sf_dir), I.current(spark, sf_dir), **options)


def flat(found):
    return found.select(
        "host", "path", "previous_path", "kind", F.array_join("reasons", ", ").alias("reasons"),
        "size", "modified_ns", F.col("before.checksum").alias("before_checksum"),
        F.col("after.checksum").alias("after_checksum"),
    )


FLAT_SQL = """
SELECT host, path, previous_path, kind, reasons, size, modified_ns, before_checksum,
       after_checksum FROM findings"""


@query("integrity_findings", DIFF + FLAT_SQL)
def integrity_findings(spark, sf_dir):
    return flat(findings(spark, sf_dir))


SUMMARY_SQL = """
SELECT host, count(*) FILTER (kind = 'modified') AS modified,
       count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'deleted') AS deleted,
       count(*) FILTER (kind = 'moved') AS moved, count(*) AS total
FROM findings GROUP BY host"""


@query("integrity_summary", DIFF + SUMMARY_SQL)
def integrity_summary(spark, sf_dir):
    return D.integrity_summary(findings(spark, sf_dir))


@query("modification_reasons", DIFF + """
SELECT host, path, reasons FROM diff WHERE reasons <> ''""")
def modification_reasons(spark, sf_dir):
    changes = D.snapshot_changes(I.baseline(spark, sf_dir), I.current(spark, sf_dir))
    return changes.filter("kind = 'modified'").select(
        "host", "path", F.array_join("reasons", ", ").alias("reasons")
    )


@query("moved_files", DIFF + """
SELECT host, previous_path, path, size FROM findings WHERE kind = 'moved'""")
def moved_files(spark, sf_dir):
    return findings(spark, sf_dir).filter("kind = 'moved'").select(
        "host", "previous_path", "path", "size"
    )


@query("deleted_sweep", DIFF + """
SELECT host, path, size FROM baseline b
WHERE NOT EXISTS (SELECT 1 FROM current_rows c WHERE c.host = b.host AND c.path = b.path)""")
def deleted_sweep(spark, sf_dir):
    return D.deleted_sweep(I.baseline(spark, sf_dir), I.current(spark, sf_dir)).select(
        "host", "path", "size"
    )


@query("inspect_paths", DIFF + """,
wanted AS (SELECT host, path FROM baseline UNION SELECT host, path FROM current_rows
           UNION SELECT host, path || '.bak' FROM baseline)
SELECT w.host, w.path, d.b_checksum AS stored_checksum, d.c_checksum AS present_checksum,
       coalesce(d.reasons, '') AS reasons,
       CASE WHEN d.path IS NULL THEN 'unknown' WHEN d.b_path IS NULL THEN 'not baselined'
            WHEN d.c_path IS NULL THEN 'not on disk' WHEN d.reasons <> '' THEN 'compromised'
            ELSE 'intact' END AS verdict
FROM wanted w LEFT JOIN diff d ON d.host = w.host AND d.path = w.path""")
def inspect_paths(spark, sf_dir):
    old, new = I.baseline(spark, sf_dir), I.current(spark, sf_dir)
    wanted = old.select("host", "path").unionByName(new.select("host", "path")).unionByName(
        old.select("host", F.concat("path", F.lit(".bak")).alias("path"))
    )
    return D.inspect_paths(old, new, wanted).select(
        "host", "path", F.col("before.checksum").alias("stored_checksum"),
        F.col("after.checksum").alias("present_checksum"),
        F.array_join("reasons", ", ").alias("reasons"), "verdict",
    )


@query("scoped_diff", I.diff_ctes(base="old_scope", cur="new_scope", extra=""",
old_scope AS (SELECT * FROM baseline WHERE path = '/srv/src1' OR path LIKE '/srv/src1/%'),
new_scope AS (SELECT * FROM current_rows WHERE path = '/srv/src1' OR path LIKE '/srv/src1/%')
""") + FLAT_SQL)
def scoped_diff(spark, sf_dir):
    return flat(findings(spark, sf_dir, scope="/srv/src1"))


METADATA_POLICY = Policy(scan_paths=("/srv",), metadata_rules=("/srv/src1", "/srv/src2/*"))


@query("metadata_only_diff", I.diff_ctes(
    content="NOT (starts_with(c.path, '/srv/src1/') OR starts_with(c.path, '/srv/src2/'))")
    + FLAT_SQL)
def metadata_only_diff(spark, sf_dir):
    return flat(findings(spark, sf_dir, policy=METADATA_POLICY))


@query("scan_stats", DIFF + """,
folders AS (
  SELECT DISTINCT host, unnest(['/', '/srv', '/srv/' || string_split(path, '/')[3],
         '/srv/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[4]]) AS path
  FROM current_rows),
both_kinds AS (
  SELECT host, 'directory' AS kind, 4096 AS size, 0 AS processed_bytes FROM folders
  UNION ALL SELECT host, kind, size, processed_bytes FROM current_rows)
SELECT host, count(*) FILTER (kind = 'directory') AS directories,
       count(*) FILTER (kind <> 'directory') AS files,
       sum(size) FILTER (kind <> 'directory')::BIGINT AS bytes,
       sum(processed_bytes)::BIGINT AS processed_bytes,
       (SELECT count(*) FROM baseline b WHERE b.host = k.host AND NOT EXISTS (
          SELECT 1 FROM current_rows c WHERE c.host = b.host AND c.path = b.path)) AS failed
FROM both_kinds k GROUP BY host""")
def scan_stats(spark, sf_dir):
    """Paths of the baseline that the scan no longer met count as failures."""
    current = I.current(spark, sf_dir)
    lost = D.deleted_sweep(I.baseline(spark, sf_dir), current).select("host", "path")
    return D.scan_stats(I.with_folders(current), lost)


@query("content_policy", DIFF + """
SELECT host, path,
       CASE WHEN starts_with(path, '/srv/src1/') OR starts_with(path, '/srv/src2/') THEN NULL
            ELSE checksum END AS checksum,
       CASE WHEN starts_with(path, '/srv/src1/') OR starts_with(path, '/srv/src2/') THEN 0
            ELSE least(size, 1000) END AS processed_bytes
FROM current_rows""")
def content_policy(spark, sf_dir):
    policy = Policy(metadata_rules=METADATA_POLICY.metadata_rules, scan_byte_limit=1000)
    return apply_content_policy(I.current(spark, sf_dir), policy).select(
        "host", "path", "checksum", "processed_bytes"
    )


EXCLUSIONS = ("/srv/src3", "/srv/src4/en", "/srv/src5/")


@query("excluded_paths", DIFF + """
SELECT host, path FROM current_rows
WHERE starts_with(path, '/srv/src3/') OR starts_with(path, '/srv/src4/en/')
   OR starts_with(path, '/srv/src5/')""")
def excluded_paths(spark, sf_dir):
    policy = Policy(exclusions=EXCLUSIONS)
    return I.current(spark, sf_dir).filter(S.is_excluded("path", policy)).select("host", "path")


@query("excluded_by_many_roots", DIFF + """
SELECT host, path FROM current_rows
WHERE list_contains(list_transform(range(0, 100), lambda n: 'src' || n), string_split(path, '/')[3])
  AND string_split(path, '/')[4] = 'de'""")
def excluded_by_many_roots(spark, sf_dir):
    policy = Policy(exclusions=tuple(f"/srv/src{n}/de" for n in range(100)))
    return I.current(spark, sf_dir).filter(S.is_excluded("path", policy)).select("host", "path")


@query("monitored_paths", DIFF + f""",
mounts AS ({I.MOUNTS_SQL}),
tree AS (
  SELECT host, path FROM current_rows UNION ALL
  SELECT DISTINCT host, unnest(['/', '/srv', '/srv/' || string_split(path, '/')[3],
         '/srv/' || string_split(path, '/')[3] || '/' || string_split(path, '/')[4]])
  FROM current_rows)
SELECT host, path FROM tree t
WHERE (path = '/srv' OR starts_with(path, '/srv/'))
  AND NOT EXISTS (SELECT 1 FROM mounts m WHERE m.host = t.host
                  AND m.fs_type IN ('proc', 'squashfs')
                  AND starts_with(m.mountpoint, '/srv')
                  AND (t.path = m.mountpoint OR starts_with(t.path, m.mountpoint || '/')))
  AND (path = '/srv/src4'
       OR NOT (path = '/srv/src1' OR starts_with(path, '/srv/src1/')
               OR path = '/srv/src4' OR starts_with(path, '/srv/src4/')))""")
def monitored_paths(spark, sf_dir):
    policy = Policy(
        scan_paths=("/srv",), exclusions=("/srv/src1", "/srv/src4"),
        metadata_rules=("/srv/src4/", "/srv/src1/en/"),
    )
    tree = I.with_folders(I.current(spark, sf_dir)).select("host", "path")
    return S.monitored(tree, policy, I.mounts(spark, sf_dir))


@query("fs_type_longest_prefix", DIFF + f""",
mounts AS ({I.MOUNTS_SQL})
SELECT c.host, c.path, arg_max(m.fs_type, length(m.mountpoint)) AS fs_type
FROM current_rows c LEFT JOIN mounts m ON m.host = c.host
 AND (m.mountpoint = '/' OR c.path = m.mountpoint OR starts_with(c.path, m.mountpoint || '/'))
GROUP BY c.host, c.path""")
def fs_type_longest_prefix(spark, sf_dir):
    rows = S.with_fs_type(I.current(spark, sf_dir), I.mounts(spark, sf_dir))
    return rows.select("host", "path", "fs_type")


@query("excluded_filesystems", DIFF + """
SELECT host, path FROM current_rows
WHERE try_cast(substr(string_split(path, '/')[3], 4) AS INT) % 7 IN (3, 5)
  AND starts_with(string_split(path, '/')[3], 'src')""")
def excluded_filesystems(spark, sf_dir):
    return S.excluded_by_filesystem(
        I.current(spark, sf_dir), Policy(), I.mounts(spark, sf_dir)
    ).select("host", "path")


@query("risky_mounts", f"""WITH mounts AS ({I.MOUNTS_SQL})
SELECT host, mountpoint, fs_type FROM mounts
WHERE fs_type IN ('proc', 'squashfs') AND mountpoint <> '/srv/src10'""")
def risky_mounts(spark, sf_dir):
    from keelson.config import VIRTUAL_FILESYSTEMS

    policy = Policy(
        scan_paths=("/srv",), exclusions=("/srv/src10",), excluded_filesystems=("nfs",)
    )
    return S.risky_mounts(I.mounts(spark, sf_dir), policy, VIRTUAL_FILESYSTEMS)


@query("coverage_gaps", DIFF + """
SELECT host, path, CASE WHEN NOT starts_with(path, '/srv/src') OR starts_with(path, '/srv/src3/')
                        THEN 'not_covered' ELSE 'metadata_only' END AS problem
FROM current_rows
WHERE NOT starts_with(path, '/srv/src') OR starts_with(path, '/srv/src3/')
   OR starts_with(path, '/srv/src1/')""")
def coverage_gaps(spark, sf_dir):
    policy = Policy(
        scan_paths=tuple(f"/srv/src{n}" for n in range(60)), exclusions=("/srv/src3",),
        metadata_rules=("/srv/src1",),
    )
    return S.coverage_gaps(I.current(spark, sf_dir).select("host", "path"), policy)


@query("under_targets", DIFF + """,
targets AS (SELECT DISTINCT host, '/srv/' || string_split(path, '/')[3] AS target FROM baseline
            WHERE size > 5000)
SELECT c.host, c.path FROM current_rows c
WHERE EXISTS (SELECT 1 FROM targets t WHERE t.host = c.host
              AND starts_with(c.path, t.target || '/'))""")
def under_targets(spark, sf_dir):
    targets = I.baseline(spark, sf_dir).filter("size > 5000").select(
        "host", F.concat(F.lit("/srv/"), F.split("path", "/")[2]).alias("target")
    )
    return S.under_targets(I.current(spark, sf_dir), targets, ["host"]).select("host", "path")


@query("stable_rows", DIFF + """
SELECT c.host, c.path, (c.size = b.size AND c.mtime_ns = b.mtime_ns) AS stable
FROM current_rows c JOIN baseline b ON b.host = c.host AND b.path = c.path""")
def stable_rows(spark, sf_dir):
    keep = ["host", "path"]

    def measured(df, when):
        return df.select(
            *keep, F.lit(1).alias(f"{when}_dev"), F.lit(1).alias(f"{when}_inode"),
            F.col("size").alias(f"{when}_size"), F.col("mtime_ns").alias(f"{when}_mtime_ns"),
        )

    both = measured(I.baseline(spark, sf_dir), "before").join(
        measured(I.current(spark, sf_dir), "after"), keep
    )
    good, bad = D.stable_rows(both)
    return good.select(*keep, F.lit(True).alias("stable")).unionByName(
        bad.select(*keep, F.lit(False).alias("stable"))
    )


@query("latest_snapshot", DIFF + """
SELECT host, path, checksum, size FROM current_rows
UNION ALL SELECT host, path, checksum, size FROM baseline b
WHERE NOT EXISTS (SELECT 1 FROM current_rows c WHERE c.host = b.host AND c.path = b.path)""")
def latest_snapshot(spark, sf_dir):
    history = I.baseline(spark, sf_dir).withColumn("scan_ts", F.lit(1)).unionByName(
        I.current(spark, sf_dir).withColumn("scan_ts", F.lit(2))
    )
    return D.latest_snapshot(history).select("host", "path", "checksum", "size")


@query("accept_scope", DIFF + """
SELECT host, path, checksum, size FROM baseline WHERE NOT starts_with(path, '/srv/src1/')
UNION ALL SELECT host, path, checksum, size FROM current_rows
WHERE starts_with(path, '/srv/src1/')""")
def accept_scope(spark, sf_dir):
    return V.accept(I.baseline(spark, sf_dir), I.current(spark, sf_dir), "/srv/src1").select(
        "host", "path", "checksum", "size"
    )


@query("accept_counts", DIFF + """,
old AS (SELECT host, count(*) FILTER (NOT starts_with(path, '/srv/src1/')) AS preserved,
               count(*) FILTER (starts_with(path, '/srv/src1/')) AS removed
        FROM baseline GROUP BY host),
new AS (SELECT host, count(*) AS accepted FROM current_rows
        WHERE starts_with(path, '/srv/src1/') GROUP BY host)
SELECT host, coalesce(preserved, 0) AS preserved, coalesce(removed, 0) AS removed,
       coalesce(accepted, 0) AS accepted,
       coalesce(preserved, 0) + coalesce(accepted, 0) AS records
FROM old FULL JOIN new USING (host)""")
def accept_counts(spark, sf_dir):
    return V.accept_counts(I.baseline(spark, sf_dir), I.current(spark, sf_dir), "/srv/src1")


@query("finding_ids", I.REVIEW_CTES + "SELECT host, path, kind, finding_id FROM numbered")
def finding_ids(spark, sf_dir):
    return I.review_findings(spark, sf_dir).select("host", "path", "kind", "finding_id")


@query("path_order", DIFF + """
SELECT host, path, row_number() OVER (PARTITION BY host ORDER BY string_split(path, '/'))
       AS place FROM current_rows""")
def path_order(spark, sf_dir):
    from keelson.operators.ranking import rank_in_groups

    ordered = I.current(spark, sf_dir).select(
        "host", "path", component_order("path").alias("_order")
    )
    return rank_in_groups(ordered, ["host"], "_order", "place").select("host", "path", "place")


@query("finding_messages", DIFF + """
SELECT host, CASE kind WHEN 'moved' THEN 'MOVED    ' || previous_path || ' -> ' || path
       WHEN 'modified' THEN 'MODIFIED ' || path || ' (' || reasons || ')'
       WHEN 'added' THEN 'ADDED    ' || path ELSE 'DELETED  ' || path END AS message
FROM findings""")
def finding_messages(spark, sf_dir):
    return findings(spark, sf_dir).select(
        "host", finding_message("kind", "path", "previous_path", "reasons").alias("message")
    )


@query("capped_details", DIFF + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY path, kind) AS n
           FROM findings)
SELECT host, string_agg(path, '|' ORDER BY n) FILTER (n <= 7) AS shown,
       greatest(count(*) - 7, 0) AS omitted FROM placed GROUP BY host""")
def details_cap(spark, sf_dir):
    rows = findings(spark, sf_dir).select("host", "path", F.col("path").alias("message"))
    return capped_details(rows, 7).select(
        "host", F.array_join("details", "|").alias("shown"), "omitted"
    )


@query("findings_tsv", DIFF + """
SELECT upper(kind) || chr(9) || path AS value FROM findings WHERE kind <> 'moved'
UNION ALL SELECT 'ADDED' || chr(9) || path FROM findings WHERE kind = 'moved'
UNION ALL SELECT 'DELETED' || chr(9) || previous_path FROM findings WHERE kind = 'moved'""")
def tsv(spark, sf_dir):
    return findings_tsv(findings(spark, sf_dir))


@query("reason_text", DIFF + """
SELECT host, path, kind, CASE kind WHEN 'added' THEN 'new file' WHEN 'deleted' THEN 'deleted file'
       WHEN 'moved' THEN 'moved or renamed file' ELSE reasons END AS text FROM findings""")
def reason_texts(spark, sf_dir):
    return findings(spark, sf_dir).select(
        "host", "path", "kind", review_text("kind", "reasons").alias("text")
    )


PACK_SQL = """
SELECT host, path, (CASE kind WHEN 'added' THEN 0 WHEN 'modified' THEN 1 WHEN 'deleted' THEN 2
                    ELSE 3 END
   + CASE state WHEN 'unreviewed' THEN 0 WHEN 'approved' THEN 4 WHEN 'excluded' THEN 8
     ELSE 12 END
   + CASE action WHEN 'none' THEN 0 WHEN 'approve' THEN 16 WHEN 'exclude' THEN 32 ELSE 48 END
   + CASE WHEN contains(reasons, 'checksum') THEN 256 ELSE 0 END
   + CASE WHEN contains(reasons, 'size') THEN 512 ELSE 0 END
   + CASE WHEN contains(reasons, 'modified_time') THEN 1024 ELSE 0 END
   + CASE WHEN contains(reasons, 'permissions') THEN 2048 ELSE 0 END)::INT AS flags
FROM replayed"""


@query("pack_flags", I.REVIEW_CTES + PACK_SQL)
def packed_flags(spark, sf_dir):
    found = I.review_findings(spark, sf_dir)
    replayed = V.replay_actions(found, I.review_actions(found))
    return replayed.select(
        "host", "path", pack_flags("kind", "state", "action", "reasons").alias("flags")
    )


@query("unpack_flags", I.REVIEW_CTES + "SELECT host, path, kind, state, action, reasons FROM replayed")
def unpacked_flags(spark, sf_dir):
    from keelson.functions.labels import unpack_flags

    flags = packed_flags(spark, sf_dir)
    return flags.select("host", "path", unpack_flags("flags").alias("f")).select(
        "host", "path", "f.kind", "f.state", "f.action",
        F.array_join("f.reasons", ", ").alias("reasons"),
    )


@query("evidence", DIFF + """
SELECT host, path, printf('%o', before_mode) AS before_mode, printf('%o', after_mode) AS after_mode
FROM findings""")
def evidence_modes(spark, sf_dir):
    return findings(spark, sf_dir).select(
        "host", "path", F.col("before.permissions_octal").alias("before_mode"),
        F.col("after.permissions_octal").alias("after_mode"),
    )


@query("integrity_scan", I.diff_ctes(cur="reached", extra=""",
reached AS (SELECT * FROM current_rows WHERE NOT starts_with(path, '/srv/src7/'))""") + f""",
counted AS ({SUMMARY_SQL}),
stats AS (SELECT host, 0::BIGINT AS directories, count(*) AS files, sum(size)::BIGINT AS bytes,
                 sum(processed_bytes)::BIGINT AS processed_bytes FROM reached GROUP BY host)
SELECT host, directories, files, bytes, processed_bytes, total AS failed, modified, added, deleted,
       moved, total, total = 0 AS clean
FROM stats JOIN counted USING (host)""")
def whole_scan(spark, sf_dir):
    policy = Policy(scan_paths=("/srv",), exclusions=("/srv/src7",))
    return integrity_scan(I.baseline(spark, sf_dir), I.current(spark, sf_dir), policy).summary


QUERIES, ORACLES = query.queries, query.oracles
