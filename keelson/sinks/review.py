"""Review sessions, findings lists and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelson.functions.digests import _col
from keelson.functions.labels import TSV_LABELS, _lookup
from keelson.schemas import FINDINGS, REVIEW_ACTIONS
from keelson.sources.logs import path_exists


def session_status(findings: DataFrame) -> str:
    return "clean" if findings.isEmpty() else "in_progress"


def write_review(findings: DataFrame, path: str, session_id: str) -> DataFrame:
    """Store the findings of a session; its status row is written last."""
    columns = [F.col(f.name).cast(f.dataType) for f in FINDINGS.fields]
    target = f"{path}/findings/session_id={session_id}"
    findings.select(*columns).write.mode("overwrite").parquet(target)
    spark = findings.sparkSession
    stored = spark.read.schema(FINDINGS).parquet(target)
    kinds = [
        F.count_if(F.col("kind") == k).alias(k) for k in ("modified", "added", "deleted", "moved")
    ]
    total = F.count(F.lit(1))
    session = stored.agg(
        F.lit(session_id).alias("session_id"),
        F.when(total == 0, "clean").otherwise("in_progress").alias("status"),
        *kinds,
    )
    session.coalesce(1).write.mode("append").json(f"{path}/sessions")
    return session


SESSION = "session_id string, status string, modified long, added long, deleted long, moved long"


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions in order; the last one is the latest."""
    return spark.read.schema(SESSION).json(f"{path}/sessions").orderBy("session_id")


def latest_session(spark: SparkSession, path: str) -> str | None:
    if not path_exists(spark, f"{path}/sessions"):
        return None
    return list_sessions(spark, path).agg(F.max("session_id")).first()[0]


def read_review(
    spark: SparkSession, path: str, session_id: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Findings and actions of a session, by default the latest."""
    session_id = session_id or latest_session(spark, path)
    if session_id is None:
        raise FileNotFoundError(f"there are no review sessions in {path}")
    findings = (
        spark.read.schema(FINDINGS)
        .parquet(f"{path}/findings/session_id={session_id}")
        .withColumn("session_id", F.lit(session_id))
    )
    stored = f"{path}/actions"
    if path_exists(spark, stored):
        actions = spark.read.schema(REVIEW_ACTIONS).parquet(stored).filter(
            F.col("session_id") == session_id
        )
    else:
        actions = spark.createDataFrame([], REVIEW_ACTIONS)
    return findings, actions


def write_actions(actions: DataFrame, path: str) -> None:
    columns = [F.col(f.name).cast(f.dataType) for f in REVIEW_ACTIONS.fields]
    actions.select(*columns).write.mode("append").parquet(f"{path}/actions")


def export_review(spark: SparkSession, path: str, session_id: str, target: str) -> None:
    """Portable JSON copy of one session; absent evidence fields are left out."""
    findings, _ = read_review(spark, path, session_id)
    findings.write.json(target)


def findings_tsv(findings: DataFrame) -> DataFrame:
    """Lines ``KIND<TAB>PATH`` of modified, added and deleted paths; a move is both of the last."""

    def line(label, path):
        return F.concat_ws("\t", label, path)

    moved = F.array(
        line(F.lit(TSV_LABELS["added"]), "path"),
        line(F.lit(TSV_LABELS["deleted"]), "previous_path"),
    )
    plain = F.array(line(_lookup("kind", TSV_LABELS), "path"))
    return findings.select(
        F.explode(F.when(F.col("kind") == "moved", moved).otherwise(plain)).alias("value")
    )


def write_findings_tsv(findings: DataFrame, path: str) -> None:
    findings_tsv(findings).write.mode("overwrite").text(path)


def parse_findings_tsv(lines: DataFrame, column="value") -> DataFrame:
    """Findings of such lines; comments and blank lines are skipped, anything else fails."""
    text = F.trim(_col(column))
    at = F.instr(text, "\t")
    label = F.substring(text, F.lit(1), at - 1)
    kind = None
    for name, shown in TSV_LABELS.items():
        kind = (F if kind is None else kind).when(label == shown, F.lit(name))
    bad = F.when(at == 0, F.concat(F.lit("expected KIND<TAB>PATH: "), text)).otherwise(
        F.concat(F.lit("unknown finding kind "), label)
    )
    return lines.filter((text != "") & ~text.startswith("#")).select(
        F.coalesce(kind, F.raise_error(bad).cast("string")).alias("kind"),
        F.substring(text, at + 1, F.length(text)).alias("path"),
    )


def read_findings_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_findings_tsv(spark.read.text(path))
