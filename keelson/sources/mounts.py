"""Mount tables out of collected mountinfo lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unescape_octal(text: Column) -> Column:
    """Decode ``\\ooo`` escapes; a backslash before anything else stays."""
    # Cut in front of each escape: only the first four characters of a later piece can be one.
    pieces = F.split(text, r"(?=\\[0-3][0-7]{2})")

    def decode(piece):
        code = F.conv(F.substring(piece, 2, 3), 8, 10).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 2, "0")), "ISO-8859-1")
        return F.when(
            piece.rlike(r"\A\\[0-3][0-7]{2}"),
            F.concat(char, F.substring(piece, F.lit(5), F.length(piece))),
        ).otherwise(piece)

    return F.array_join(F.transform(pieces, decode), "")


def parse_mountinfo(lines: DataFrame, column="line") -> DataFrame:
    """(host, mountpoint, fs_type) of lines (host, line); malformed lines are skipped.

    The mountpoint is the fifth field before the separator, the type the first one behind it.
    """
    line = F.col(column)
    at = F.instr(line, " - ")
    words = r"\S+"
    left = F.regexp_extract_all(F.substring(line, F.lit(1), at - 1), F.lit(words), F.lit(0))
    right = F.regexp_extract_all(
        F.substring(line, at + 3, F.length(line)), F.lit(words), F.lit(0)
    )
    return lines.filter((at > 0) & (F.size(left) >= 5) & (F.size(right) >= 1)).select(
        "host",
        unescape_octal(left[4]).alias("mountpoint"),
        right[0].alias("fs_type"),
    )
