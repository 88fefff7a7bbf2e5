"""Human-readable numbers and times, and clamped conversions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit labels of scaled numbers, base 1000.
COUNT_UNITS = ["", "K", "M", "B", "T"]
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
FILE_RATE_UNITS = ["f", "Kf", "Mf", "Bf"]

# Seconds between 1601-01-01 and 1970-01-01, and 100 ns ticks per second.
FILETIME_EPOCH_SECONDS = 11_644_473_600
FILETIME_TICKS = 10_000_000

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rounded(value: Column, scale: Column) -> Column:
    """``value * scale`` as a whole number, half to even on the exact binary value.

    Java's formatter rounds the shortest decimal text of a double, which differs on values such
    as 1.015. The double is cut into two parts whose products with a small integer are exact, so
    the sign of the remainder against one half is exact too.
    """
    upper = value * F.lit(513.0)
    head = upper - (upper - value)
    twice = scale * F.lit(2.0)
    return _let(
        F.floor(value * scale),
        lambda floor: _let(
            (head * twice - (floor.cast("double") * 2 + 1)) + (value - head) * twice,
            lambda rest: floor
            + F.when((rest > 0) | ((rest == 0) & (floor % 2 == 1)), 1).otherwise(0),
        ),
    )


def scaled(value, units: list[str]) -> Column:
    """Base-1000 text: no decimals in the first unit, then 2 below 10, 1 below 100, else 0."""
    step = F.greatest(_col(value).cast("double"), F.lit(0.0))
    chosen = None
    for i, unit in enumerate(units):
        here = F.struct(step.alias("value"), F.lit(unit).alias("unit"), F.lit(i).alias("place"))
        if i == len(units) - 1:
            chosen = here if chosen is None else chosen.otherwise(here)
        else:
            chosen = (F if chosen is None else chosen).when(step < 1000, here)
        step = step / F.lit(1000.0)

    def text(s):
        decimals = (
            F.when((s["place"] == 0) | (s["value"] >= 100), 0)
            .when(s["value"] < 10, 2)
            .otherwise(1)
        )
        scale = F.when(decimals == 2, 100.0).when(decimals == 1, 10.0).otherwise(1.0)
        return _let(
            F.struct(_rounded(s["value"], scale).alias("n"), decimals.alias("d")),
            lambda r: F.concat(
                F.when(r["d"] == 0, r["n"].cast("string"))
                .when(r["d"] == 1, F.concat(F.floor(r["n"] / 10).cast("string"), F.lit("."),
                                            (r["n"] % 10).cast("string")))
                .otherwise(F.concat(F.floor(r["n"] / 100).cast("string"), F.lit("."),
                                    F.lpad((r["n"] % 100).cast("string"), 2, "0"))),
                s["unit"],
            ),
        )

    return _let(chosen, text)


def format_count(value) -> Column:
    return scaled(value, COUNT_UNITS)


def format_bytes(value) -> Column:
    return scaled(value, BYTE_UNITS)


def _rate(amount, elapsed_ms, units) -> Column:
    seconds = _col(elapsed_ms).cast("double") / F.lit(1000.0)
    value = F.try_divide(_col(amount).cast("double"), seconds)
    return F.when(seconds > 0, F.concat(scaled(value, units), F.lit("/s"))).otherwise(
        F.lit(f"0{units[0]}/s")
    )


def format_byte_rate(amount, elapsed_ms) -> Column:
    return _rate(amount, elapsed_ms, BYTE_UNITS)


def format_file_rate(files, elapsed_ms) -> Column:
    return _rate(files, elapsed_ms, FILE_RATE_UNITS)


def utc_text(epoch_ms) -> Column:
    """``YYYY-MM-DD hh:mm:ss UTC`` without consulting the session time zone."""
    seconds = F.floor(_col(epoch_ms) / F.lit(1000))
    days = F.floor(seconds / F.lit(86400)).cast("int")
    rest = F.pmod(seconds, F.lit(86400))

    def two(value):
        return F.lpad(value.cast("long").cast("string"), 2, "0")

    return F.concat(
        F.date_from_unix_date(days).cast("string"), F.lit(" "),
        two(F.floor(rest / 3600)), F.lit(":"),
        two(F.floor(rest % 3600 / 60)), F.lit(":"),
        two(rest % 60), F.lit(" UTC"),
    )


def clamp_long(value) -> Column:
    """Clamp a wide integer to the signed 64-bit range."""
    wide = _col(value).cast("decimal(38,0)")
    low, high = (F.lit(str(v)).cast("decimal(38,0)") for v in (LONG_MIN, LONG_MAX))
    return F.least(F.greatest(wide, low), high).cast("long")


def filetime_ns(ticks) -> Column:
    """Unix nanoseconds of a count of 100 ns ticks since 1601."""
    since_epoch = _col(ticks).cast("decimal(20,0)") - F.lit(
        FILETIME_EPOCH_SECONDS * FILETIME_TICKS
    ).cast("decimal(20,0)")
    return clamp_long(since_epoch * F.lit(100).cast("decimal(3,0)"))


def octal(mode) -> Column:
    return F.lower(F.conv(_col(mode).cast("string"), 10, 8))
