"""Inputs of the registered queries, derived by Spark from the given tables.

Each derivation has a SQL twin (a common table expression) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.config import LogAudit, LogRule, LogSource, Policy, Selector
from keelson.functions.digests import text_digest
from keelson.operators.audit import chain_audit
from keelson.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _snapshot(docs: DataFrame, text, path, mtime, mode) -> DataFrame:
    size = F.octet_length(F.encode(text, "utf-8")).cast("long")
    none = F.lit(None).cast("long")
    return docs.select(
        F.concat(F.lit("host"), (F.col("doc_id") % 4).cast("string")).alias("host"),
        path.alias("path"),
        F.lit("file").alias("kind"),
        text_digest(text).alias("checksum"),
        size.alias("size"),
        mode.cast("long").alias("mode"),
        F.when(F.col("doc_id") % 23 == 0, 1000).otherwise(0).cast("long").alias("uid"),
        F.lit(0).cast("long").alias("gid"),
        mtime.alias("mtime_ns"),
        none.alias("btime_ns"),
        none.alias("ctime_ns"),
        F.lit(None).cast("string").alias("security_hash"),
        size.alias("processed_bytes"),
    )


def _parts():
    doc = F.col("doc_id")
    folder = F.col("source")
    mtime = F.lit(1_700_000_000_000_000_000) + doc * 1000
    mode = F.lit(33188) + F.when(doc % 19 == 0, 18).otherwise(0)
    return doc, folder, mtime, mode


def _path(folder):
    return F.concat(
        F.lit("/srv/"), folder, F.lit("/"), F.col("lang"), F.lit("/"),
        F.col("doc_id").cast("string"), F.lit(".txt"),
    )


def baseline(spark, sf_dir) -> DataFrame:
    doc, folder, mtime, mode = _parts()
    docs = table(spark, sf_dir, "documents").filter(doc % 10 != 9)
    return _snapshot(docs, F.col("text"), _path(folder), mtime, mode)


def current(spark, sf_dir) -> DataFrame:
    return current_of(table(spark, sf_dir, "documents"))


def current_of(documents: DataFrame) -> DataFrame:
    doc, folder, mtime, mode = _parts()
    edited = doc % 10 == 5
    return _snapshot(
        documents.filter(doc % 10 != 7),
        F.when(edited, F.concat("text", F.lit("!"))).otherwise(F.col("text")),
        _path(F.when(doc % 10 == 3, F.lit("moved")).otherwise(folder)),
        mtime + F.when(edited, 1).otherwise(0),
        mode - F.when(doc % 29 == 0, 4).otherwise(0),
    )


_SNAPSHOT_SQL = """
  SELECT 'host' || (doc_id % 4)::VARCHAR AS host,
         '/srv/' || {folder} || '/' || lang || '/' || doc_id::VARCHAR || '.txt' AS path,
         'file' AS kind, sha256({text}) AS checksum,
         octet_length(encode({text}))::BIGINT AS size,
         (33188 + CASE WHEN doc_id % 19 = 0 THEN 18 ELSE 0 END{mode})::BIGINT AS mode,
         (CASE WHEN doc_id % 23 = 0 THEN 1000 ELSE 0 END)::BIGINT AS uid, 0::BIGINT AS gid,
         1700000000000000000 + doc_id * 1000{mtime} AS mtime_ns,
         octet_length(encode({text}))::BIGINT AS processed_bytes
  FROM documents WHERE doc_id % 10 <> {skip}
"""

BASELINE_SQL = _SNAPSHOT_SQL.format(folder="source", text="text", mode="", mtime="", skip=9)
CURRENT_SQL = _SNAPSHOT_SQL.format(
    folder="CASE WHEN doc_id % 10 = 3 THEN 'moved' ELSE source END",
    text="CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END",
    mode=" - CASE WHEN doc_id % 29 = 0 THEN 4 ELSE 0 END",
    mtime=" + CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END",
    skip=7,
)

# The comparison as SQL: reasons as text, moves by rank in component order.
DIFF_SQL = """
  SELECT coalesce(b.host, c.host) AS host, coalesce(b.path, c.path) AS path,
         b.path AS b_path, c.path AS c_path, b.checksum AS b_checksum, c.checksum AS c_checksum,
         b.size AS b_size, c.size AS c_size, b.mode AS b_mode, c.mode AS c_mode,
         b.uid AS b_uid, c.uid AS c_uid, b.gid AS b_gid, c.gid AS c_gid,
         b.mtime_ns AS b_mtime, c.mtime_ns AS c_mtime,
         CASE WHEN b.path IS NULL OR c.path IS NULL THEN '' ELSE array_to_string(list_filter([
           CASE WHEN {content} AND b.checksum <> c.checksum THEN 'checksum' END,
           CASE WHEN b.size <> c.size THEN 'size' END,
           CASE WHEN b.mtime_ns <> c.mtime_ns THEN 'modified_time' END,
           CASE WHEN b.mode <> c.mode THEN 'permissions' END,
           CASE WHEN b.uid <> c.uid THEN 'owner' END,
           CASE WHEN b.gid <> c.gid THEN 'group' END], lambda x: x IS NOT NULL), ', ') END
         AS reasons
  FROM {base} b FULL JOIN {cur} c ON b.host = c.host AND b.path = c.path
"""


def diff_ctes(base="baseline", cur="current_rows", content="true", extra="") -> str:
    """``findings`` and what it is made of."""
    return f"""WITH baseline AS ({BASELINE_SQL}), current_rows AS ({CURRENT_SQL}){extra},
diff AS ({DIFF_SQL.format(base=base, cur=cur, content=content)}),
gone AS (SELECT *, row_number() OVER (PARTITION BY host, b_checksum, b_size
                                      ORDER BY string_split(path, '/')) AS rn
         FROM diff WHERE c_path IS NULL),
fresh AS (SELECT *, row_number() OVER (PARTITION BY host, c_checksum, c_size
                                       ORDER BY string_split(path, '/')) AS rn
          FROM diff WHERE b_path IS NULL),
paired AS (
  SELECT coalesce(f.host, g.host) AS host, coalesce(f.path, g.path) AS path,
         CASE WHEN f.path IS NOT NULL THEN g.path END AS previous_path,
         CASE WHEN f.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added'
              ELSE 'moved' END AS kind,
         '' AS reasons, coalesce(f.c_size, g.b_size) AS size,
         coalesce(f.c_mtime, g.b_mtime) AS modified_ns,
         g.b_checksum AS before_checksum, f.c_checksum AS after_checksum,
         g.b_mode AS before_mode, f.c_mode AS after_mode
  FROM fresh f FULL JOIN gone g ON f.host = g.host AND f.c_checksum = g.b_checksum
       AND f.c_size = g.b_size AND f.rn = g.rn),
findings AS (
  SELECT * FROM paired UNION ALL
  SELECT host, path, NULL, 'modified', reasons, c_size, c_mtime, b_checksum, c_checksum,
         b_mode, c_mode
  FROM diff WHERE reasons <> '')
"""


POLICY = Policy(scan_paths=("/srv",), metadata_rules=("/srv/src1", "/srv/src2/*"))


def with_folders(snapshot: DataFrame) -> DataFrame:
    """A snapshot plus a row for each directory above its files."""
    from keelson.functions.paths import ancestors

    folders = snapshot.select(
        "host", F.explode(ancestors("path", include_self=False, include_root=True)).alias("path")
    ).distinct()
    rows = folders.select(
        "host", "path", F.lit("directory").alias("kind"),
        F.lit(None).cast("string").alias("checksum"), F.lit(4096).cast("long").alias("size"),
        F.lit(16877).cast("long").alias("mode"), F.lit(0).cast("long").alias("uid"),
        F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("mtime_ns"),
        F.lit(None).cast("long").alias("btime_ns"), F.lit(None).cast("long").alias("ctime_ns"),
        F.lit(None).cast("string").alias("security_hash"),
        F.lit(0).cast("long").alias("processed_bytes"),
    )
    return snapshot.unionByName(rows)


def mounts(spark, sf_dir) -> DataFrame:
    """Per host: /, /srv and one mount per source, with types by its number."""
    docs = table(spark, sf_dir, "documents")
    host = F.concat(F.lit("host"), (F.col("doc_id") % 4).cast("string"))
    number = F.substring("source", 4, 9).cast("int")
    kind = (
        F.when(number % 7 == 3, "proc").when(number % 7 == 5, "squashfs")
        .when(number % 7 == 6, "nfs").otherwise("ext4")
    )
    own = docs.select(
        host.alias("host"), F.concat(F.lit("/srv/"), "source").alias("mountpoint"),
        kind.alias("fs_type"),
    ).distinct()
    base = docs.select(
        host.alias("host"),
        F.explode(
            F.array(
                F.struct(F.lit("/").alias("mountpoint"), F.lit("xfs").alias("fs_type")),
                F.struct(F.lit("/srv").alias("mountpoint"), F.lit("btrfs").alias("fs_type")),
            )
        ).alias("m"),
    ).select("host", "m.*").distinct()
    return own.unionByName(base)


MOUNTS_SQL = """
  SELECT DISTINCT 'host' || (doc_id % 4)::VARCHAR AS host, '/srv/' || source AS mountpoint,
         CASE substr(source, 4)::INT % 7 WHEN 3 THEN 'proc' WHEN 5 THEN 'squashfs'
              WHEN 6 THEN 'nfs' ELSE 'ext4' END AS fs_type FROM documents
  UNION SELECT DISTINCT 'host' || (doc_id % 4)::VARCHAR, '/', 'xfs' FROM documents
  UNION SELECT DISTINCT 'host' || (doc_id % 4)::VARCHAR, '/srv', 'btrfs' FROM documents
"""


# --- logs ---------------------------------------------------------------------------------

def log_lines(spark, sf_dir) -> DataFrame:
    """Lines of the documents: the document is the file, its source the log source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "source", F.col("doc_id").cast("string").alias("file"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).select("source", "file", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


LINES_SQL = """
  SELECT source, file, line_no, line FROM (
    SELECT source, doc_id::VARCHAR AS file,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no,
           unnest(string_split(text, chr(10))) AS line FROM documents)
"""


def event_lines(spark, sf_dir) -> DataFrame:
    """One log per user; a line's number is its place in the common event order."""
    return lines_of_events(table(spark, sf_dir, "events"))


def lines_of_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("source"),
        F.lit("events").alias("file"),
        (F.col("event_id") + 1).alias("line_no"),
        F.concat(
            F.lit("["), F.col("event_id").cast("string"), F.lit("] "), F.upper("event_type"),
            F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), F.col("props"),
        ).alias("line"),
    )


EVENT_LINES_SQL = """
  SELECT user_id::VARCHAR AS source, 'events' AS file, event_id + 1 AS line_no,
         '[' || event_id || '] ' || upper(event_type) || ' user=' || user_id || ' ' || props
         AS line FROM events
"""

CARDS = LogRule(
    "cards", (Selector("creditcard", "card number", risk="critical"),), "payment cards"
)
WORDS = LogRule(
    "words",
    (
        Selector("contains", "the without over", ("the", "and"), ("over",), "low", proceed=False),
        Selector("one_of", "noted word", ("token", "LICENSE", "Éa"), ("###",), "high",
                 insensitive=True),
        Selector("regex", "address", (r"\d{1,3}(\.\d{1,3}){3}|\w+@\w+",), (r"^The ",), "medium"),
    ),
    "words worth a look",
)
QUIET = LogRule("quiet", (Selector("contains", "short", ("st",), (), "none"),), "no risk at all")
EVENTS = LogRule(
    "events",
    (
        Selector("contains", "failed request", ("ERROR",), (), "high"),
        Selector("one_of", "bought or viewed", ("PURCHASE", "VIEW"), (), "low"),
    ),
    "requests", group_by="user=[0-9]+",
)
AUDIT = LogAudit(
    rules=(CARDS, WORDS, QUIET, EVENTS),
    sources=(
        LogSource("text", ("words", "cards"), "table", "document lines", top=5,
                  trim_prefix="^[A-Z][a-z]+ "),
        LogSource("plain", ("cards", "quiet"), "table", "cards and short words", top=20),
        LogSource("keyed", ("words",), "table", "grouped words", top=10,
                  group_by="[a-z]*tion|[0-9]+"),
        LogSource("restarts", ("events",), "table", "requests by user", top=10, reset="SIGNUP",
                  trim_prefix=r"^\[[0-9]+\] ", group_by="[A-Z]+ user=[0-9]+"),
        LogSource("requests", ("events", "events"), "table", "requests by rule", top=7,
                  trim_prefix=r"^\[[0-9]+\] "),
    ),
)


# --- audit trails -------------------------------------------------------------------------

def audit_events(spark, sf_dir) -> DataFrame:
    """One audit log per user."""
    events = table(spark, sf_dir, "events")
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    return events.select(
        F.col("user_id").cast("string").alias("log_id"),
        F.col("event_id").alias("seq"),
        (F.lit(1_700_000_000_000) + F.col("event_id")).alias("timestamp_unix_ms"),
        F.col("event_type").alias("action"),
        (F.col("event_id") % 1000).alias("pid"),
        F.array(field("props", F.col("props")), field("user", F.col("user_id").cast("string")))
        .alias("fields"),
    )


AUDIT_CHAIN_SQL = """ordered AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         '{"timestamp_unix_ms":' || (1700000000000 + event_id) || ',"action":"' || event_type
         || '","pid":' || (event_id % 1000) || ',"previous_hash":"' AS head,
         '","props":"' || replace(props, '"', '\\"') || '","user":"' || user_id || '"' AS tail
  FROM events),
chained AS (
  SELECT user_id, n, event_id, repeat('0', 64) AS previous,
         sha256(head || repeat('0', 64) || tail || '}') AS hash FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.n, o.event_id, c.hash, sha256(o.head || c.hash || o.tail || '}')
  FROM chained c JOIN ordered o ON o.user_id = c.user_id AND o.n = c.n + 1),
audit_lines AS (
  SELECT o.user_id::VARCHAR AS log_id, o.event_id AS seq,
         o.head || c.previous || o.tail || ',"hash":"' || c.hash || '"}' AS line, c.previous,
         c.hash
  FROM chained c JOIN ordered o USING (user_id, n))
"""


def tampered_lines(spark, sf_dir) -> DataFrame:
    """Of three logs one is intact, one has edited lines and one has lost lines."""
    lines = materialise(chain_audit(audit_events(spark, sf_dir)))
    log = F.col("log_id").cast("long") % 3
    return lines.filter(~((log == 1) & (F.col("seq") % 97 == 13))).withColumn(
        "line",
        F.when((log == 2) & (F.col("seq") % 89 == 7),
               F.replace("line", F.lit('"user":"'), F.lit('"user":"x')))
        .otherwise(F.col("line")),
    )


# --- progress samples ---------------------------------------------------------------------

def samples(spark, sf_dir) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (event % 2).cast("string").alias("run_id"),
        (event * 1370 + F.floor(event / 500) * 20_000).cast("long").alias("ts_ms"),
        (event * 3 + 1).alias("files"),
        (event * 98_765).alias("bytes"),
    )


SAMPLES_SQL = """
  SELECT (event_id % 2)::VARCHAR AS run_id, event_id * 1370 + (event_id // 500) * 20000 AS ts_ms,
         event_id * 3 + 1 AS files, event_id * 98765 AS bytes FROM events
"""


# --- review -------------------------------------------------------------------------------

def review_findings(spark, sf_dir) -> DataFrame:
    """Findings with ids per host, stored as a review session is; the host is the session."""
    from keelson.operators.diff import integrity_diff, number_findings

    found = number_findings(integrity_diff(baseline(spark, sf_dir), current(spark, sf_dir)))
    return materialise(found.withColumn("session_id", F.col("host")))


def review_actions(findings: DataFrame) -> DataFrame:
    """Marks of every third and fifth finding, some undone, and excluded folders."""
    fid = F.col("finding_id")

    def mark(every, kind, action_id, undone):
        return findings.filter(fid % every == 0).select(
            "session_id", action_id.alias("action_id"), F.lit(kind).alias("kind"),
            F.col("path").alias("target"), F.array(fid).alias("affected"),
            undone.alias("undone"), F.lit(False).alias("applied"),
        )

    folder = F.concat(F.lit("/srv/"), F.split("path", "/")[2])
    number = F.regexp_extract("path", "^/srv/src([0-9]+)/", 1)
    excluded = (
        findings.filter((number != "") & (F.try_to_number(number, F.lit("99")) % 4 == 0))
        .select("session_id", folder.alias("target"), number.cast("long").alias("n"))
        .distinct()
        .select(
            "session_id", (F.lit(10_000_000) + F.col("n")).alias("action_id"),
            F.lit("exclude").alias("kind"), "target",
            F.array().cast("array<long>").alias("affected"), (F.col("n") % 8 == 0).alias("undone"),
            F.lit(False).alias("applied"),
        )
    )
    return (
        mark(3, "approve", fid * 2, fid % 7 == 0)
        .unionByName(mark(5, "flag", fid * 2 + 1, fid % 11 == 0))
        .unionByName(excluded)
    )


REVIEW_CTES = diff_ctes() + """, numbered AS (
  SELECT *, host AS session_id,
         row_number() OVER (PARTITION BY host ORDER BY string_split(path, '/'), kind) AS finding_id
  FROM findings),
actions AS (
  SELECT session_id, finding_id * 2 AS action_id, 'approve' AS kind, path AS target, finding_id,
         finding_id % 7 = 0 AS undone FROM numbered WHERE finding_id % 3 = 0
  UNION ALL
  SELECT session_id, finding_id * 2 + 1, 'flag', path, finding_id, finding_id % 11 = 0
  FROM numbered WHERE finding_id % 5 = 0
  UNION ALL
  SELECT DISTINCT session_id, 10000000 + n, 'exclude', '/srv/src' || n, NULL, n % 8 = 0
  FROM (SELECT session_id, try_cast(regexp_extract(path, '^/srv/src([0-9]+)/', 1) AS INT) AS n
        FROM numbered) WHERE n % 4 = 0),
marks AS (
  SELECT session_id, finding_id, arg_max(kind, action_id) AS mark FROM actions
  WHERE NOT undone AND kind <> 'exclude' GROUP BY ALL),
replayed AS (
  SELECT f.*, CASE WHEN m.mark = 'approve' THEN 'approved' WHEN m.mark = 'flag' THEN 'flagged'
                   WHEN x.hit THEN 'excluded' ELSE 'unreviewed' END AS state,
         CASE WHEN m.mark IS NOT NULL THEN m.mark WHEN x.hit THEN 'exclude' ELSE 'none' END
         AS action
  FROM numbered f LEFT JOIN marks m USING (session_id, finding_id)
  LEFT JOIN (SELECT DISTINCT n.session_id, n.finding_id, true AS hit
             FROM numbered n JOIN actions a ON a.session_id = n.session_id AND NOT a.undone
              AND a.kind = 'exclude' AND starts_with(n.path, a.target || '/')) x
    USING (session_id, finding_id))
"""
