"""Stored baselines: one folder per writer, made visible as a generation by its manifest row."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from keelson.functions.formats import utc_text
from keelson.operators.diff import one_per_path
from keelson.operators.fingerprint import (
    content_hash, generation_guard, row_digest, sums, verify_baseline,
)
from keelson.schemas import BASELINE_MANIFEST, FILE_SNAPSHOT
from keelson.sources.logs import path_exists

# Fixed value: name of the checkpoint format.
CHECKPOINT_FORMAT = "keelson-baseline-checkpoint-v1"


# Folders of the records by a hash of the host: a reader of some hosts lists and reads theirs only.
HOST_BUCKETS = 1024
STORED = T.StructType([*FILE_SNAPSHOT.fields, T.StructField("bucket", T.IntegerType())])
#: A manifest row also names the folder of its records.
MANIFEST = T.StructType([*BASELINE_MANIFEST.fields, T.StructField("folder", T.StringType(), False)])


def host_bucket(host="host"):
    return F.pmod(F.xxhash64(host), F.lit(HOST_BUCKETS)).cast("int")


def next_generation(manifests: DataFrame) -> DataFrame:
    """One row: the greatest generation plus one, 1 if there is none; it never wraps."""
    last = F.max("generation")
    return manifests.agg(
        F.when(last.isNull(), F.lit(1).cast("long"))
        .when(last == 2**63 - 1, last)
        .otherwise(F.coalesce(last, F.lit(0)) + 1)
        .alias("generation")
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows, each in a folder of its own, as writers may come at once.

    A row without a required field fails the query.
    """
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*")
    required = [f for f in MANIFEST.fields if not f.nullable]
    return rows.withColumns(
        {
            f.name: F.coalesce(
                f.name, F.raise_error(F.lit(f"manifest without {f.name}")).cast(f.dataType)
            )
            for f in required
        }
    )


def _current_manifest(spark, path, generation=None) -> DataFrame:
    rows = read_manifests(spark, path)
    if generation is not None:
        return rows.filter(F.col("generation") == generation)
    return rows.orderBy(F.col("generation").desc()).limit(1)


def newest_manifest(spark: SparkSession, path: str):
    """The manifest row of the newest generation."""
    row = _current_manifest(spark, path).first() if path_exists(spark, f"{path}/manifest") else None
    if row is None:
        raise FileNotFoundError(f"there is no baseline in {path}")
    return row


def _filesystem(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def claim(spark: SparkSession, path: str, generation: int, owner: str) -> bool:
    """Put the owner's name into the file of a generation, unless there is one; whether it is ours.

    The file system creates it without overwriting, and it is read back, in case the file system
    lets two writers through.
    """
    jvm = spark._jvm
    fs, target = _filesystem(spark, f"{path}/claims/{generation:019d}")
    try:
        out = fs.create(target, False)
    except Exception as error:  # the JVM's FileAlreadyExistsException, wrapped
        if fs.exists(target):
            return False
        raise error
    out.write(owner.encode())
    out.close()
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode() == owner
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, row: dict) -> int:
    """Write the manifest row of the next generation that no other writer has claimed."""
    fs, claims = _filesystem(spark, f"{path}/claims")
    generation = 1
    if path_exists(spark, f"{path}/manifest"):
        generation = next_generation(read_manifests(spark, path)).first()["generation"]
    if fs.exists(claims):  # claimed, but perhaps not published yet
        names = [f.getPath().getName() for f in fs.listStatus(claims)]
        generation = max([generation, *(min(int(n), 2**63 - 2) + 1 for n in names if n.isdigit())])
    while not claim(spark, path, generation, row["folder"]):
        generation += 1
    manifest = spark.createDataFrame([tuple({**row, "generation": generation}[f.name] for f in MANIFEST.fields)], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifest/{generation:019d}")
    return generation


def write_baseline(
    snapshot: DataFrame, path: str, config_hash: str | None = None, scan_byte_limit: int = 0
) -> int:
    """Store a snapshot as the next generation and return its number.

    Each writer has a folder of its own; its manifest row, written last, names it. The generation
    is claimed by a file that is created only if absent, so of several writers at once each gets
    its own number and none is lost; a failed run leaves nothing visible. The records are dealt by
    the host's bucket, large buckets split, and sorted by (host, path), so a lookup reads its host's
    folder and skips row groups by their statistics. The fingerprint adds up while they are written.
    """
    spark = snapshot.sparkSession
    folder = uuid.uuid4().hex
    columns = [F.col(f.name).cast(f.dataType) for f in FILE_SNAPSHOT.fields]
    rows = one_per_path(snapshot).select(*columns).withColumns(
        {"bucket": host_bucket(), "_digest": row_digest()}
    )
    seen = Observation(f"baseline-{folder}")
    added = [column.alias(name) for name, column in sums().items()]
    (
        rows.observe(seen, *added)
        .drop("_digest")
        .hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "host", "path")
        .write.partitionBy("bucket")
        .parquet(f"{path}/records/{folder}")
    )
    found = seen.get
    return publish(
        spark, path,
        {
            "records": found["records"], "scan_byte_limit": scan_byte_limit,
            "created_unix_ms": int(time.time() * 1000), "config_hash": config_hash,
            "content_hash": content_hash(found), "folder": folder,
        },
    )


def read_baseline(
    spark: SparkSession,
    path: str,
    generation: int | None = None,
    minimum: int | None = None,
    verify: bool = False,
    hosts: DataFrame | None = None,
) -> DataFrame:
    """The records of a generation, by default the newest, of all hosts or of those in ``hosts``.

    Of the named hosts (a column ``host``) only the folders are read. Fails for an absent baseline,
    for a generation below ``minimum`` and, with ``verify``, for records that do not agree with the
    manifest.
    """
    if not path_exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"there is no baseline in {path}")
    manifest = _current_manifest(spark, path, generation)
    if minimum is not None:
        manifest = generation_guard(manifest, minimum)
    row = manifest.first()
    if row is None:
        raise FileNotFoundError(f"there is no generation {generation} in {path}")
    stored = spark.read.schema(STORED).parquet(f"{path}/records/{row['folder']}")
    if verify:
        numbered = stored.drop("bucket").withColumn("generation", F.lit(row["generation"]))
        one = read_manifests(spark, path).filter(F.col("generation") == row["generation"])
        wrong = verify_baseline(numbered, one, ["generation"]).first()["mismatches"]
        if wrong:
            raise ValueError(f"baseline {path} does not match its manifest: {', '.join(wrong)}")
    if hosts is not None:
        hosts = hosts.select("host").distinct()
        asked = [r[0] for r in hosts.select(host_bucket()).distinct().collect()]  # HOST_BUCKETS at most
        stored = stored.filter(F.col("bucket").isin(asked)).join(hosts, "host", "left_semi")
    return stored.select(*[f.name for f in FILE_SNAPSHOT.fields])


def manifest_digest():
    """Digest of a manifest row, to be kept elsewhere."""
    fields = [
        F.concat(F.lit(f"{f.name}: "), F.coalesce(F.col(f.name).cast("string"), F.lit("")))
        for f in BASELINE_MANIFEST.fields
    ]
    return F.sha2(F.encode(F.concat_ws("\n", *fields), "utf-8"), 256)


def checkpoint(manifest: DataFrame, path: str) -> DataFrame:
    """JSON record per manifest row, for keeping off the host as proof of a generation."""
    record = F.to_json(
        F.struct(
            F.lit(CHECKPOINT_FORMAT).alias("format"),
            "records",
            "generation",
            "created_unix_ms",
            utc_text("created_unix_ms").alias("created_utc"),
            F.lit(f"{path}/manifest").alias("manifest_path"),
            manifest_digest().alias("manifest_hash"),
            "config_hash",
            F.col("generation").alias("min_generation"),
        )
    )
    return manifest.select("generation", record.alias("checkpoint"))


def config_drift(manifest: DataFrame, current: DataFrame, keys=("host",)) -> DataFrame:
    """Compare stored and current configuration hashes per host.

    ``status``: ok, drift, or unrecorded where the baseline holds no hash.
    """
    status = (
        F.when(F.col("config_hash").isNull(), "unrecorded")
        .when(F.col("config_hash") == F.col("current_config_hash"), "ok")
        .otherwise("drift")
    )
    return manifest.join(current, list(keys), "inner").withColumn("status", status)


def strict_drift(drift: DataFrame) -> DataFrame:
    """Fail the query where the configuration drifted."""
    message = F.concat(F.lit("configuration changed since the baseline on "), F.col("host"))
    return drift.withColumn(
        "status",
        F.when(F.col("status") == "drift", F.raise_error(message).cast("string")).otherwise(
            F.col("status")
        ),
    )


def write_bucketed(snapshot: DataFrame, table: str, buckets: int) -> None:
    """Store a snapshot as a table bucketed by (host, path).

    A comparison with it (``distinct=True, colocated=True``) then shuffles the current side only.
    """
    (
        one_per_path(snapshot)
        .select(*[F.col(f.name).cast(f.dataType) for f in FILE_SNAPSHOT.fields])
        .repartition(buckets, "host", "path")
        .write.bucketBy(buckets, "host", "path")
        .sortBy("host", "path")
        .mode("overwrite")
        .saveAsTable(table)
    )
