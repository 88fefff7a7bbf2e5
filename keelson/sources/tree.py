"""File trees on a mount that all executors see, as snapshot rows.

``keelson_tree`` is a Python data source. Its partitions are directories: planning lists directories
from the top until there are SPREAD of them to share out, and no more. A directory listed then is
read by entry count, a large one in shares of its names; those below are walked by their tasks. A task
that has read WALK times its share hands the directories left back as rows of their own, and these are
the roots of the next round, so that a subtree of any size spreads. Content is read and hashed with the
listing, in the same task, and only where the asked schema holds ``checksum``.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
import sys
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from keelson.config import Policy
from keelson.functions.digests import security_hash
from keelson.functions.paths import under_any
from keelson.operators.scope import is_metadata_only
from keelson.schemas import FILE_SNAPSHOT
from keelson.session import materialise

# Executors need not have this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
ENTRIES = 20_000  # entries of a partition
SPREAD = 1024  # directories that planning shares out
WALK = 8
ROUND = 10_000  # directories handed to the next round at once

META = (
    "path string, kind string, target string, size bigint, mode bigint, uid bigint, gid bigint, "
    "mtime_ns bigint, ctime_ns bigint, dev bigint, inode bigint, nlink bigint, state string"
)
TREE = f"{META}, checksum string"


@dataclass(frozen=True)
class TreeScan:
    snapshot: DataFrame
    failures: DataFrame  # host and path of what could not be read


# ---- one path


def _kind(mode: int) -> str:
    if stat.S_ISDIR(mode):
        return "directory"
    if stat.S_ISLNK(mode):
        return "symlink"
    return "file" if stat.S_ISREG(mode) else "special"


def _entry(path: str) -> dict | None:
    """Metadata of one path; None when it vanished meanwhile."""
    try:
        info = os.lstat(path)
        kind = _kind(info.st_mode)
        target = os.readlink(path) if kind == "symlink" else None
    except FileNotFoundError:
        return None
    except OSError:
        return {"path": path, "state": "failed"}
    return {
        "path": path, "state": "read", "kind": kind, "target": target, "size": info.st_size, "mode": info.st_mode,
        "uid": info.st_uid, "gid": info.st_gid, "mtime_ns": info.st_mtime_ns, "ctime_ns": info.st_ctime_ns,
        "dev": info.st_dev, "inode": info.st_ino, "nlink": info.st_nlink,
    }


def _file_digest(path: str, limit: int) -> str:
    """Digest read in chunks, so that no file is too large; stops after ``limit`` bytes."""
    digest, left = hashlib.sha256(), limit or None
    with open(path, "rb", buffering=0) as content:
        while left is None or left > 0:
            chunk = content.read(CHUNK if left is None else min(CHUNK, left))
            if not chunk:
                break
            digest.update(chunk)
            left = None if left is None else left - len(chunk)
    return digest.hexdigest()


def _hashed(row: dict, limit: int) -> dict:
    """The row with its file's digest; failed where it cannot be read or changed meanwhile."""
    try:
        checksum, after = _file_digest(row["path"], limit), os.lstat(row["path"])
    except OSError:
        return {**row, "state": "failed"}
    now = (after.st_dev, after.st_ino, after.st_size, after.st_mtime_ns)
    same = now == (row["dev"], row["inode"], row["size"], row["mtime_ns"])
    return {**row, "checksum": checksum, "state": "read" if same else "failed"}


# ---- directories


def _above(path: str) -> Iterator[str]:
    """The path and its ancestors."""
    path = path.rstrip("/") or "/"
    while True:
        yield path
        if path in ("/", ""):
            return
        path = os.path.dirname(path)


@dataclass(frozen=True)
class Rules:
    """What a walk leaves out, and which files it does not read."""

    excluded: frozenset
    shown: frozenset  # directories that are listed although excluded
    bare: frozenset
    hidden: frozenset  # mountpoints of excluded filesystems

    def leaves_out(self, path: str) -> bool:
        return path in self.hidden or any(p in self.excluded for p in _above(path)) and path not in self.shown

    def enters(self, path: str) -> bool:
        return not any(p in self.excluded for p in _above(path))

    def reads(self, path: str) -> bool:
        return path not in self.shown and not any(p in self.bare for p in _above(path))


def _names(folder: str, share: int = 0, shares: int = 1) -> Iterator[tuple[str, bool]]:
    """Path and whether it is a directory of each entry of a directory, or of a share of its names."""
    with os.scandir(folder) as entries:
        for entry in entries:
            if shares == 1 or zlib.crc32(os.fsencode(entry.name)) % shares == share:
                yield entry.path, entry.is_dir(follow_symlinks=False)


class Folders(InputPartition):
    """Tasks of a partition: (how, path, share, shares), how one of self, flat and deep."""

    def __init__(self, tasks):
        self.tasks = tasks


def plan_folders(roots: list[str], again: bool, rules: Rules, entries: int, spread: int) -> list[Folders]:
    """The directories at the top, each read by itself, and those below, walked whole.

    The roots' own rows are read unless they were before (``again``). A directory that cannot be
    listed is left to its task, which reports it.
    """
    flat, waiting = [], deque()
    for root in roots:
        if os.path.isdir(root) and not os.path.islink(root) and rules.enters(root):
            waiting.append(root)
    while waiting and len(waiting) < spread:
        folder, n = waiting.popleft(), 0
        try:
            for path, is_folder in _names(folder):
                n += 1
                if is_folder and not rules.leaves_out(path) and rules.enters(path):
                    waiting.append(path)
        except OSError:
            pass
        flat.append((folder, n))
    parts = [Folders([("self", root, 0, 1) for root in roots])] if roots and not again else []
    held, n_held = [], 0
    for folder, n in flat:
        shares = max(1, -(-n // entries))
        if shares > 1:
            parts += [Folders([("flat", folder, share, shares)]) for share in range(shares)]
            continue
        held.append(("flat", folder, 0, 1))
        n_held += n + 1
        if n_held >= entries:
            parts.append(Folders(held))
            held, n_held = [], 0
    if held:
        parts.append(Folders(held))
    deep = [("deep", folder, 0, 1) for folder in waiting]
    step = -(-len(deep) // (4 * spread)) or 1
    return parts + [Folders(deep[i : i + step]) for i in range(0, len(deep), step)]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.names = [f.name for f in schema.fields]
        kinds = {"string": pa.string(), "bigint": pa.int64()}
        self.types = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
        self.roots, self.again = json.loads(options["paths"]), options.get("again") == "true"
        self.entries, self.spread = int(options.get("entries", ENTRIES)), int(options.get("spread", SPREAD))
        self.limit = int(options.get("limit", 0))
        self.rules = Rules(*(frozenset(x) for x in json.loads(options.get("rules", "[[], [], [], []]"))))

    def partitions(self):
        # An empty plan would be read as one partition without a value.
        return plan_folders(self.roots, self.again, self.rules, self.entries, self.spread) or [Folders([])]

    def read(self, partition):
        held = []
        for row in self._rows(partition.tasks):
            held.append(row)
            if len(held) >= 5_000:
                yield pa.RecordBatch.from_pylist(held, self.types)
                held = []
        yield pa.RecordBatch.from_pylist(held, self.types)

    def _shown(self, path: str) -> dict | None:
        """The row of a path, hashed where that is asked for."""
        row = None if self.rules.leaves_out(path) else _entry(path)
        if row and row.get("kind") == "file" and "checksum" in self.names and self.rules.reads(path):
            return _hashed(row, self.limit)
        return row

    def _rows(self, tasks):
        done = 0
        for how, path, share, shares in tasks:
            if how == "self":
                if not self.rules.leaves_out(path):
                    yield self._shown(path) or {"path": path, "state": "failed"}
                continue
            stack = [path]
            while stack:
                if done >= WALK * self.entries and how == "deep":
                    yield from ({"path": p, "state": "left"} for p in stack)
                    break
                folder = stack.pop()
                try:
                    for child, is_folder in _names(folder, share, shares):
                        done += 1
                        row = self._shown(child)
                        if row is not None:
                            yield row
                        if how == "deep" and is_folder and row is not None and self.rules.enters(child):
                            stack.append(child)
                except FileNotFoundError:
                    pass
                except OSError:
                    if share == 0:
                        yield {"path": folder, "state": "failed"}


class TreeSource(DataSource):
    """Rows of a file tree. Options: paths (JSON list), rules, limit, entries, spread, again."""

    @classmethod
    def name(cls):
        return "keelson_tree"

    def schema(self):
        return TREE

    def reader(self, schema):
        return TreeReader(dict(self.options), schema)


# ---- scans


def _stems(paths) -> list[str]:
    return [p.rstrip("/") or "/" for p in paths]


def _walked(spark: SparkSession, policy: Policy, mounts, schema: str, options: dict) -> DataFrame:
    """All rounds of a walk; each is stored, so a lost executor repeats one round's part at most."""
    spark.dataSource.register(TreeSource)
    rules = [_stems(policy.excluded_roots), _stems(policy.metadata_directories), _stems(policy.metadata_roots), _stems(mounts)]
    asked = {"rules": json.dumps(rules), "limit": policy.scan_byte_limit, **options}

    def read(paths, **more):
        rows = spark.read.format("keelson_tree").schema(schema).options(**asked, **more, paths=json.dumps(paths))
        return materialise(rows.load())

    roots = spark.createDataFrame([(p,) for p in policy.scan_paths], "path string")
    rounds = [read([r.path for r in roots.filter(~under_any("path", mounts)).collect()])]
    left = rounds[-1].filter("state = 'left'")
    while not left.isEmpty():
        news, held = [], []
        for row in left.select("path").distinct().toLocalIterator():
            held.append(row.path)
            if len(held) >= ROUND:
                news.append(read(held, again="true"))
                held = []
        if held:
            news.append(read(held, again="true"))
        rounds += news
        left = reduce(DataFrame.unionByName, news).filter("state = 'left'")
    return reduce(DataFrame.unionByName, rounds).filter("state <> 'left'")


def list_tree(spark: SparkSession, policy: Policy, mounts=(), **options) -> DataFrame:
    """Metadata of all entries the policy reaches, without reading content.

    ``mounts`` are the mountpoints of excluded filesystems; a scan path on or below one starts no
    walk. ``options`` are those of the data source.
    """
    rows = _walked(spark, policy, mounts, META, options)
    return rows.withColumn("failed", F.col("state") == "failed").drop("state")


def read_tree(
    spark: SparkSession, policy: Policy, host: str = "localhost", mounts=(), **options
) -> TreeScan:
    """Snapshot of a file tree with content digests.

    Files that change while they are read are failures. Overlapping scan paths give repeated
    rows, which every consumer reduces to one per path.
    """
    entries = _walked(spark, policy, mounts, TREE, options)
    size = F.col("size")
    is_file = (F.col("kind") == "file") & ~is_metadata_only("path", policy)
    read = F.least(size, F.lit(policy.scan_byte_limit)) if policy.scan_byte_limit else size
    link = F.when(F.col("kind") == "symlink", F.sha2(F.encode("target", "utf-8"), 256))
    given = {
        "host": F.lit(host), "checksum": F.coalesce("checksum", link), "processed_bytes": F.when(is_file, read).otherwise(0),
        "btime_ns": F.lit(None), "security_hash": security_hash("dev", "inode", "nlink", "kind"),
    }
    snapshot = entries.filter("state = 'read'").select(
        *[given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in FILE_SNAPSHOT.fields]
    )
    failed = entries.filter("state = 'failed'")
    return TreeScan(snapshot, failed.select(F.lit(host).alias("host"), "path"))
