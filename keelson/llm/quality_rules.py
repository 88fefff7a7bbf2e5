"""Quality rules with thresholds learned per language and source. DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated five-word windows. The verdict on top
compares four ratios with fences learned from the data: each group of lang and source has a
mergeable quantile sketch per ratio, a table of counts in buckets of at most 1/32 relative width,
so sketches add up in any order and to the same result.

A fence is the median plus REACH times the spread, the distance of the quartiles, which less than a
quarter of junk does not move. Groups are settled from the widest to the narrowest: all documents, a
language, a source of a language. Median and spread of a group are means of its own, weighted by its
documents, and its wider group's, which counts as BLEND documents. A spread is at least the ratio's
SPREADS, so equal documents leave room for noise, and at most twice the wider group's; a median is at
most the wider group's fence. So a source that is mostly junk cannot make its junk the rule. No fence is
above what a ratio can reach. An even group loses nothing, however large.

Null text has no words and fails the base rule. Null lang or source is a group of its own. Each
repeated row is judged alike. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from keelson.llm.common import materialise, slim

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words

FINE = 5  # leading bits of a value that tell its bucket
REACH = 4  # spreads above the median
BLEND = 200  # documents as which the wider group counts
#: Least spread of each ratio, and the highest fence that can reject anything. In a short text one
#: line in three, or one window of five words, may come again.
SPREADS = {"symbols": 20, "dup_lines": 90, "repeats": 35, "word_length": 500}
MOST = {"symbols": 999, "dup_lines": 999, "repeats": 999, "word_length": 1 << 40}


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once instead of at each element."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _windows(ws: Column, window: Callable) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), window)


def _repeat_words(ws: Column) -> Column:
    """Words inside five-word windows found twice or more.

    Hashes of windows tell texts without any repeat, which is most; where some are equal, the
    windows themselves are compared.
    """
    at = [lambda i, k=k: F.get(ws, i + k) for k in range(WINDOW)]
    hashes = _windows(ws, lambda i: F.xxhash64(*[f(i) for f in at]))

    def covered(pairs):
        """``pairs``: sorted (window, position)."""
        size = F.size(pairs)

        def repeated(p, i):
            before = (i > 0) & (F.get(pairs, i - 1)["w"] == p["w"])
            after = (i < size - 1) & (F.get(pairs, i + 1)["w"] == p["w"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        starts = F.array_sort(F.transform(F.filter(pairs, repeated), lambda p: p["i"]))
        return _bound(
            starts,
            lambda s: F.aggregate(
                F.transform(
                    s,
                    lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW))),
                ),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    def text_of(i):
        return F.concat_ws(" ", *[f(i) for f in at])

    exact = _bound(
        F.array_sort(_windows(ws, lambda i: F.struct(text_of(i).alias("w"), i.alias("i")))), covered
    )
    some = _bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(ws) <= WINDOW, 0).when(some, exact).otherwise(0)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counts = _bound(
        words(body),
        lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("repeats")),
    )
    line_counts = _bound(
        lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("own"))
    )
    out = docs.withColumns(
        {
            "_w": counts,
            "_l": line_counts,
            "word_chars": _without(body, SPACES).cast("long"),
            "n_symbols": (F.length(body) - _without(body, SYMBOLS)).cast("long"),
        }
    ).withColumns(
        {
            "n_words": F.col("_w.n").cast("long"),
            "n_repeat_words": F.col("_w.repeats").cast("long"),
            "n_lines": F.col("_l.n").cast("long"),
            "n_dup_lines": (F.col("_l.n") - F.col("_l.own")).cast("long"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")
    )
    return out.withColumn("base_failed", failed).drop("_w", "_l")


def ratios() -> dict[str, Column]:
    """Whole numbers per thousand, so that buckets are exact."""
    per = lambda a, b: F.expr(f"1000 * {a} div greatest({b}, 1)")
    return {
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared: the lowest value of its bucket."""
    shift = F.greatest(F.length(F.bin(value)) - (FINE + 1), F.lit(0))
    low = F.call_function("shiftright", value, shift)
    return F.call_function("shiftleft", low, shift)


def sketches(counted: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bucket, n): adding up n merges sketches."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in ratios().items()])
    )
    return counted.select(*groups, pairs.alias("_p")).groupBy(
        *groups, F.col("_p.ratio").alias("ratio"), F.col("_p.bucket").alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, rows, mid, wide): documents, median and distance of the quartiles."""
    keys = [*groups, "ratio"]
    merged = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bucket")
    ranked = merged.withColumns(
        {"upto": F.sum("n").over(upto), "rows": F.sum("n").over(Window.partitionBy(*keys))}
    )
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bucket")))
    return ranked.groupBy(*keys).agg(
        F.first("rows").alias("rows"), at(2).alias("mid"), (at(3) - at(1)).alias("wide")
    )


def _of_ratio(values: dict[str, int]) -> Column:
    """The value of the row's ratio."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))]
    return F.element_at(F.create_map(*pairs), F.col("ratio"))


def _fenced(df: DataFrame) -> DataFrame:
    return df.withColumn("fence", F.least(F.col("mid") + REACH * F.col("wide"), _of_ratio(MOST)))


def settle(own: DataFrame, wider: DataFrame | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """The groups' median, spread and fence, blended with and bounded by their wider groups'."""
    least = _of_ratio(SPREADS)
    if wider is None:
        return _fenced(own.withColumn("wide", F.greatest("wide", least)))
    names = {c: f"w_{c}" for c in (*on, "ratio", "mid", "wide", "fence")}
    wider = wider.select(*names).withColumnsRenamed(names)
    same = F.col("ratio") == F.col("w_ratio")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    mean = lambda c: F.expr(f"(rows * {c} + {BLEND} * w_{c}) div (rows + {BLEND})")
    met = own.join(wider, same, "left").withColumns(
        {
            "mid": F.least(mean("mid"), F.col("w_fence")),
            "wide": F.least(F.greatest(mean("wide"), least), 2 * F.col("w_wide")),
        }
    )
    return _fenced(met.drop(*names.values()))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and kept."""
    counted = materialise(
        base_counts(slim(docs, "doc_id", "text", "lang", "source")).drop("text")
    )
    sketch = materialise(sketches(counted.filter(~F.col("base_failed")), ["lang", "source"]))
    of_all = settle(quartiles(sketch, []))
    by_lang = settle(quartiles(sketch, ["lang"]), of_all)
    fine = settle(quartiles(sketch, ["lang", "source"]), by_lang, ("lang",))
    rules = fine.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(
        *[F.max(F.when(F.col("ratio") == k, F.col("fence"))).alias(f"_max_{k}") for k in SPREADS]
    )
    joined = counted.join(
        rules, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    within = F.lit(True)
    for name, value in ratios().items():
        within = within & (value <= F.coalesce(F.col(f"_max_{name}"), value))
    return joined.withColumn("kept", ~F.col("base_failed") & within).select(*counted.columns, "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass."""
    verdict = judge(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["_id"]), "left_semi")
