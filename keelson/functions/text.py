"""Log-line expressions: regular-expression dialect, prefix trimming, payment cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

from keelson.functions.digests import _col

# Card digits, ignored separators and the replacement of a masked run.
CARD_RUN = r"(?U)(\d{16}\d*)"
CARD_SEPARATORS = ".- "
CARD_CANDIDATE = r"(?U)\d(?:[.\- ]*\d){15}"
CARD_MASK = "XXXX XXXX XXXX XXXX"

# ASCII classes that may appear inside brackets.
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": r"0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# Constructs that linear-time dialects do not have, or that Java reads differently. The first
# list is looked for outside of escapes and brackets, the second one everywhere.
_REJECTED_SYNTAX = [
    (r"\(\?<?[=!]", "look-around"),
    (r"\(\?>", "an atomic group"),
    (r"[*+?}]\+", "a possessive quantifier"),
]
_REJECTED_ANYWHERE = [
    (r"\\[1-9]|\\k<", "a back-reference"),
    (r"\\[<>ZGhHRXKQE]|\\b\{", "this escape"),
    (r"\(\?[a-zA-Z]*[uUR][a-zA-Z]*(?:-[a-zA-Z]*)?[:)]|\(\?[a-zA-Z]*-[a-zA-Z]*[uUR]",
     "one of the flags u, U and R"),
    (r"\[:\^", "a negated POSIX class"),
]
_BRACKETS = r"\[\^?\]?(?:\[:\w+:\]|[^\]])*\]"


class PatternError(ValueError):
    """The pattern is not valid in the rule dialect."""


def java_pattern(pattern: str) -> str:
    """Translate a rule pattern (Unicode classes, ``\\n`` as only line end) to Java's dialect."""
    bare = re.sub(r"\\\\", "  ", pattern)
    syntax = re.sub(_BRACKETS, "C", re.sub(r"\\.", "E", bare))
    for text, rejected in ((syntax, _REJECTED_SYNTAX), (bare, _REJECTED_ANYWHERE)):
        for shape, name in rejected:
            if re.search(shape, text):
                raise PatternError(f"{name} cannot be used in a pattern: {pattern}")
    out = re.sub(r"(?<!\\)\(\?P?<[A-Za-z_][\w.\[\]]*>", "(", pattern)
    out = re.sub(r"\[:(\w+):\]", lambda m: _posix(m.group(1), pattern), out)
    out = "(?Ud)" + out
    _compile(out, pattern)
    return out


def _posix(name, pattern):
    if name not in POSIX_CLASSES:
        raise PatternError(f"unknown class {name} in {pattern}")
    return POSIX_CLASSES[name]


def _compile(java: str, pattern: str) -> None:
    """Let the JVM judge the pattern while it is still on the driver."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as error:
        raise PatternError(f"invalid pattern {pattern}") from error


def matches(line, pattern: str) -> Column:
    return _col(line).rlike(java_pattern(pattern))


def first_match(line, pattern: str) -> Column:
    """Whole text of the first match, null where there is none."""
    java = java_pattern(pattern)
    line = _col(line)
    return F.when(line.rlike(java), F.regexp_extract(line, java, 0))


def trim_prefix(line, pattern: str | None) -> Column:
    """Cut the line after the first match; no pattern, no match or a bad pattern changes nothing."""
    line = _col(line)
    if not pattern:
        return line
    try:
        java = java_pattern(pattern)
    except PatternError:
        return line
    body = java[len("(?Ud)"):]
    return F.regexp_replace(line, f"(?Ud)(?s:\\A.*?)(?:{body})", "")


def fold_case(line) -> Column:
    return F.lower(_col(line))


def compact_digits(line) -> Column:
    return F.translate(_col(line), CARD_SEPARATORS, "")


def is_card_number(digits) -> Column:
    """Exactly 16 ASCII digits that pass the Luhn check."""
    digits = _col(digits)
    return digits.rlike(r"\A[0-9]{16}\z") & F.call_function("luhn_check", digits)


def has_card_number(line) -> Column:
    """Some maximal digit run of the line without separators is a card number.

    Few lines hold 16 digits in a row at all, so that is asked first, on the line as it is.
    """
    runs = F.regexp_extract_all(compact_digits(line), F.lit(CARD_RUN), F.lit(1))
    return _col(line).rlike(CARD_CANDIDATE) & F.exists(runs, is_card_number)


def mask_cards(line) -> Column:
    """Mask every run of 16 or more digits as written, card or not."""
    return F.regexp_replace(_col(line), CARD_RUN, CARD_MASK)


def filled(template: str, **columns) -> Column:
    """Fill a template such as ``{count} events`` with columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))
