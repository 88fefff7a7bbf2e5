"""Labels and codecs of findings: kinds, states, actions, reasons, evidence and messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keelson.functions.digests import _col
from keelson.functions.formats import octal

# code = position in the list (kind bits 0-1, state bits 2-3, action bits 4-5).
FINDING_KINDS = ["added", "modified", "deleted", "moved"]
FINDING_STATES = ["unreviewed", "approved", "excluded", "flagged"]
ACTION_KINDS = ["none", "approve", "exclude", "flag"]
STATE_SHIFT, ACTION_SHIFT, REASON_SHIFT = 2, 4, 8

# Reason bits from bit 8 upwards, which is also the canonical order of the text.
REASONS = [
    "checksum",
    "size",
    "modified_time",
    "permissions",
    "owner",
    "group",
    "created_time",
    "metadata_change_time",
    "security_metadata",
    "policy",
]

# Older spellings still accepted on input.
REASON_ALIASES = {"acl": "security_metadata"}

# Labels of the plain findings list and messages.
TSV_LABELS = {"modified": "MODIFIED", "added": "ADDED", "deleted": "DELETED"}
MESSAGE_LABELS = {**TSV_LABELS, "moved": "MOVED"}

# What a reviewer reads for findings without reasons of their own.
REVIEW_TEXTS = {
    "added": "new file",
    "deleted": "deleted file",
    "moved": "moved or renamed file",
}
REVIEW_TEXT_FALLBACK = "metadata or content changed"


def _lookup(value, mapping) -> Column:
    found = None
    for key, label in mapping.items():
        found = (F if found is None else found).when(_col(value) == key, F.lit(label))
    return found


def kind_label(is_directory, is_symlink, is_special) -> Column:
    return (
        F.when(_col(is_directory), "directory")
        .when(_col(is_symlink), "symlink")
        .when(_col(is_special), "special")
        .otherwise("file")
    )


def evidence(row: Column) -> Column:
    """Evidence struct of a snapshot struct; null for a null row."""
    built = F.struct(
        row["checksum"].alias("checksum"),
        row["kind"].alias("kind"),
        row["size"].alias("size"),
        octal(row["mode"]).alias("permissions_octal"),
        row["uid"].alias("owner"),
        row["gid"].alias("group"),
        row["mtime_ns"].alias("modified_ns"),
        row["btime_ns"].alias("created_ns"),
        row["ctime_ns"].alias("metadata_changed_ns"),
        row["security_hash"].alias("security_metadata_hash"),
    )
    return F.when(row.isNotNull(), built)


def reason_text(reasons) -> Column:
    """Known reasons in canonical order, joined by a comma and a blank."""
    reasons = _col(reasons)
    ordered = F.filter(
        F.array(*[F.lit(r) for r in REASONS]), lambda r: F.array_contains(reasons, r)
    )
    return F.array_join(ordered, ", ")


def parse_reasons(text) -> Column:
    """Reason list of its text form; an unknown name fails the query."""
    names = F.filter(
        F.transform(F.split(_col(text), ","), lambda n: F.trim(n)), lambda n: n != ""
    )
    for old, new in REASON_ALIASES.items():
        names = F.transform(names, lambda n: F.when(n == old, F.lit(new)).otherwise(n))
    unknown = F.filter(names, lambda n: ~n.isin(REASONS))
    canonical = F.filter(
        F.array(*[F.lit(r) for r in REASONS]), lambda r: F.array_contains(names, r)
    )
    return F.when(
        F.size(unknown) > 0,
        F.raise_error(F.concat(F.lit("unknown finding reason "), unknown[0])).cast(
            "array<string>"
        ),
    ).otherwise(canonical)


def reason_bits(reasons) -> Column:
    reasons = _col(reasons)
    bits = F.lit(0)
    for i, name in enumerate(REASONS):
        bits = bits + F.when(F.array_contains(reasons, name), F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def reasons_from_bits(bits) -> Column:
    bits = _col(bits)
    return F.array_compact(
        F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, F.lit(r)) for i, r in enumerate(REASONS)])
    )


def _code(value, names) -> Column:
    return _lookup(value, {n: i for i, n in enumerate(names)})


def pack_flags(kind, state, action, reasons) -> Column:
    """One integer holding kind, state, action and reasons."""
    return (
        _code(kind, FINDING_KINDS)
        + F.shiftleft(_code(state, FINDING_STATES), STATE_SHIFT)
        + F.shiftleft(_code(action, ACTION_KINDS), ACTION_SHIFT)
        + F.shiftleft(reason_bits(reasons), REASON_SHIFT)
    )


def unpack_flags(flags) -> Column:
    flags = _col(flags).cast("int")

    def name(shift, names):
        code = F.shiftright(flags, shift).bitwiseAND(3)
        return F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)

    return F.struct(
        name(0, FINDING_KINDS).alias("kind"),
        name(STATE_SHIFT, FINDING_STATES).alias("state"),
        name(ACTION_SHIFT, ACTION_KINDS).alias("action"),
        reasons_from_bits(F.shiftright(flags, REASON_SHIFT)).alias("reasons"),
    )


def review_text(kind, reasons) -> Column:
    named = _lookup(kind, REVIEW_TEXTS)
    text = reason_text(reasons)
    return F.coalesce(named, F.when(text != "", text).otherwise(F.lit(REVIEW_TEXT_FALLBACK)))


def finding_message(kind, path, previous_path, reasons) -> Column:
    """One line per finding: padded label and path, with the reasons or the move."""
    label = F.rpad(_lookup(kind, MESSAGE_LABELS), 8, " ")
    listed = F.array_join(_col(reasons), ", ")
    return (
        F.when(
            _col(kind) == "moved",
            F.concat(label, F.lit(" "), _col(previous_path), F.lit(" -> "), _col(path)),
        )
        .when(
            (_col(kind) == "modified") & (listed != ""),
            F.concat(label, F.lit(" "), _col(path), F.lit(" ("), listed, F.lit(")")),
        )
        .otherwise(F.concat(label, F.lit(" "), _col(path)))
    )
