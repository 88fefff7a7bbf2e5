"""Times the headline queries, four comparison shapes, a store and a file tree; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_ROWS the size of the generated
snapshots, which are compared in full: identical, moved, mixed, and hot (a third of the files moved
with one and the same content). The tree holds every document as a file; it is listed, and read with
digests. Making snapshots and the tree is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import functions as F

from keelson.catalog import QUERIES
from keelson.catalog.stored import written_tree
from keelson.config import Policy
from keelson.operators.diff import integrity_diff
from keelson.schemas import FILE_SNAPSHOT
from keelson.session import build_session, materialise, work_dir
from keelson.sinks.baseline import write_baseline
from keelson.sources.tree import list_tree, read_tree

HEADLINE = [
    "integrity_findings",
    "integrity_scan",
    "monitored_paths",
    "fs_type_longest_prefix",
    "log_events",
    "log_grouped",
    "log_grouped_reset",
    "log_report_simple",
    "log_creditcard",
    "replay_actions",
    "directory_impact",
    "apply_review",
    "baseline_fingerprint",
    "audit_verify",
    "trust_issues",
    "scan_rate",
]


def generated(spark, rows, root="/synthetic/tree", edited=0, alike=0):
    """``rows`` files spread over folders; every ``edited``-th has other content, every ``alike``-th the same."""
    i = F.col("id")
    changed = (i % edited == 0) if edited else F.lit(False)
    own = F.when(i % alike == 0, 0).otherwise(i) if alike else i
    given = {
        "host": F.lit("bench"),
        "path": F.format_string(f"{root}/%03d/%03d/%09d.dat", i % 1000, (i / 1000).cast("int") % 1000, i),
        "kind": F.lit("file"),
        "checksum": F.sha2(F.concat(own.cast("string"), F.when(changed, "x").otherwise("")), 256),
        "size": F.lit(128), "mode": F.lit(0o100600), "uid": F.lit(1000), "gid": F.lit(1000),
        "mtime_ns": i, "processed_bytes": F.lit(128),
    }
    return spark.range(rows).select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FILE_SNAPSHOT.fields]
    )


def stored(df):
    """Snapshots are read from tables, so making them up is not part of the time."""
    return materialise(df)


def run(df):
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_ROWS", "1000000"))
    spark = build_session(
        "keelson-bench", f"local[{cpus}]", int(cpus),
        **{"spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["integrity_findings"](spark, sf_dir))  # start the session's machinery

    timings = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)

    base = stored(generated(spark, rows))
    hot = stored(generated(spark, rows, alike=3))
    shapes = {
        "identical": (base, stored(generated(spark, rows))),
        "moved": (base, stored(generated(spark, rows, "/synthetic/new"))),
        "mixed": (base, stored(generated(spark, rows, edited=10))),
        "hot": (hot, stored(generated(spark, rows, "/synthetic/new", alike=3))),
    }
    for shape, (before, current) in shapes.items():
        name = f"compare_{shape}_{rows}"
        started = time.perf_counter()
        run(integrity_diff(before, current, distinct=True))
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr)
    started = time.perf_counter()
    write_baseline(base, os.path.join(work_dir(spark), f"baseline-{uuid.uuid4().hex}"))
    timings[f"write_baseline_{rows}"] = round(time.perf_counter() - started, 3)

    policy = Policy(scan_paths=(written_tree(spark, sf_dir),))
    for name, scan in (("list_tree", lambda: list_tree(spark, policy)), ("read_tree", lambda: read_tree(spark, policy).snapshot)):
        started = time.perf_counter()
        entries = scan().count()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]} ({entries} entries)", file=sys.stderr)

    compared = timings[f"compare_identical_{rows}"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "files_per_second": round(rows / compared),
                "tree_files_per_second": round(entries / timings["read_tree"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
