"""Path expressions: prefixes by whole component, ancestors, component order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# More roots than this are looked up among a path's ancestors instead of OR-ed one by one.
MANY_ROOTS = 32

MOVE_SEPARATOR = "\u001f"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def depth(path) -> Column:
    path = _col(path)
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + F.lit(1)


def ancestors(path, include_self=True, include_root=False) -> Column:
    """Self, then each parent, the nearest first; ``/`` itself only on request."""
    path = _col(path)
    top = F.when(path.startswith("/"), F.lit(2)).otherwise(F.lit(1))
    first = depth(path) - F.lit(0 if include_self else 1)
    prefixes = F.transform(
        F.sequence(first, top, F.lit(-1)),
        lambda i: F.call_function("substring_index", path, F.lit("/"), i),
    )
    empty = F.array().cast("array<string>")
    found = F.when(first >= top, F.filter(prefixes, lambda p: ~p.endswith("/") | (p == "/")))
    if not include_self:
        found = F.when(path == "/", empty).otherwise(found)
    found = F.coalesce(found, empty)
    if include_root:
        root = F.when(path.startswith("/") & ((path != "/") | F.lit(not include_self)),
                      F.array(F.lit("/"))).otherwise(empty)
        if not include_self:
            root = F.when(path == "/", empty).otherwise(root)
        found = F.concat(found, root)
    return found


def parent(path) -> Column:
    """Parent directory; null for ``/`` and for a bare name."""
    path = _col(path)
    head = F.call_function("substring_index", path, F.lit("/"), depth(path) - F.lit(1))
    return F.when((path == "/") | (depth(path) < 2), F.lit(None).cast("string")).when(
        head == "", F.lit("/")
    ).otherwise(head)


def path_under(path, root) -> Column:
    """Component-wise prefix test: ``/a/b`` covers itself and ``/a/b/c`` but not ``/a/bc``."""
    path = _col(path)
    if isinstance(root, Column):
        stem = F.rtrim(root, F.lit("/"))
        return (path == stem) | path.startswith(F.concat(stem, F.lit("/")))
    stem = root.rstrip("/")
    return (path == F.lit(stem)) | path.startswith(stem + "/")


def under_any(path, roots) -> Column:
    """True where some root covers the path; the cost per row does not grow with many roots."""
    path = _col(path)
    roots = list(roots)
    if not roots:
        return F.lit(False)
    if len(roots) > MANY_ROOTS:
        stems = [r.rstrip("/") or "/" for r in roots]
        return F.exists(ancestors(path, include_root=True), lambda a: a.isin(stems))
    test = path_under(path, roots[0])
    for root in roots[1:]:
        test = test | path_under(path, root)
    return test


def component_order(path) -> Column:
    """Sort key that orders paths component by component (``/a/b`` before ``/a-b``)."""
    return F.replace(_col(path), F.lit("/"), F.lit("\u0000"))


def normalised(path) -> Column:
    return F.replace(_col(path), F.lit("\\"), F.lit("/"))


def without_private_alias(path) -> Column:
    """Drop a leading ``/private`` component, for comparing macOS aliases."""
    return F.regexp_replace(_col(path), "^/private(?=/)", "")


def path_key(path) -> Column:
    """Opaque 128-bit key of a path as 32 hex digits; never used as an identity."""
    return F.md5(_col(path).cast("binary"))


def encode_move(path, previous_path) -> Column:
    return F.concat(_col(path), F.lit(MOVE_SEPARATOR), _col(previous_path))


def decode_move(encoded) -> Column:
    """struct(path, previous_path); previous_path is null when nothing was moved."""
    encoded = _col(encoded)
    at = F.instr(encoded, MOVE_SEPARATOR)
    return F.struct(
        F.when(at > 0, F.substring(encoded, F.lit(1), at - 1)).otherwise(encoded).alias("path"),
        F.when(at > 0, F.substring(encoded, at + 1, F.length(encoded)))
        .alias("previous_path"),
    )
