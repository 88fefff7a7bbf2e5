"""Small snapshot and log rows, and the text of a plan."""

import contextlib
import io

from keelson.schemas import FILE_SNAPSHOT, LOG_LINES


def file_row(path, checksum="aa", host="h", **fields):
    row = {
        "host": host, "path": path, "kind": "file", "checksum": checksum, "size": 1, "mode": 33188,
        "uid": 0, "gid": 0, "mtime_ns": 1, "btime_ns": None, "ctime_ns": None,
        "security_hash": None, "processed_bytes": 1,
    }
    row.update(fields)
    return tuple(row[f.name] for f in FILE_SNAPSHOT.fields)


def folder_row(path, **fields):
    return file_row(path, None, kind="directory", mode=16877, processed_bytes=0, **fields)


def snapshot(spark, *rows):
    return spark.createDataFrame(list(rows), FILE_SNAPSHOT)


def log(spark, *lines, source="app", file="app.log"):
    return spark.createDataFrame(
        [(source, file, i + 1, line) for i, line in enumerate(lines)], LOG_LINES
    )


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()
