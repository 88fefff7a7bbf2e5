"""Rule evaluation: selectors as boolean columns, matches as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keelson.config import ConfigError, LogRule, LogSource, Selector
from keelson.functions.text import fold_case, has_card_number, mask_cards, matches, trim_prefix


@dataclass(frozen=True)
class SelectorKind:
    """How a selector tests a line, and how it cleans the lines its rule reports."""

    test: Callable[[Selector, Column], Column]
    sanitise: Callable[[Column], Column] | None = None
    needs_match: bool = True


def _any(tests):
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests):
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _needles(selector, line):
    """The line to search, the needles and the excluded texts, in one case if asked."""
    if not selector.insensitive:
        return line, selector.match, selector.exclude
    return (
        fold_case(line),
        [n.lower() for n in selector.match],
        [n.lower() for n in selector.exclude],
    )


def _contains(selector, line):
    text, wanted, unwanted = _needles(selector, line)
    return _all(text.contains(n) for n in wanted) & ~_any(text.contains(n) for n in unwanted)


def _one_of(selector, line):
    text, wanted, unwanted = _needles(selector, line)
    return _any(text.contains(n) for n in wanted) & ~_any(text.contains(n) for n in unwanted)


def _regex(selector, line):
    return _all(matches(line, p) for p in selector.match) & ~_any(
        matches(line, p) for p in selector.exclude
    )


_KINDS = {
    "contains": SelectorKind(_contains),
    "one_of": SelectorKind(_one_of),
    "regex": SelectorKind(_regex),
    "creditcard": SelectorKind(lambda s, line: has_card_number(line), mask_cards, False),
}


def register_selector(
    name: str,
    test: Callable[[Selector, Column], Column],
    sanitise: Callable[[Column], Column] | None = None,
) -> None:
    """Add a selector kind: ``test(selector, line)`` gives a boolean column."""
    if name in _KINDS:
        raise ConfigError(f"selector {name} exists already")
    _KINDS[name] = SelectorKind(test, sanitise, needs_match=False)


def selector_kinds() -> list[str]:
    """The selector kinds that exist."""
    return list(_KINDS)


def _kind(selector: Selector) -> SelectorKind:
    if selector.kind not in _KINDS:
        raise ConfigError(f"invalid selector type {selector.kind}")
    kind = _KINDS[selector.kind]
    if kind.needs_match and not selector.match:
        raise ConfigError(f"selector {selector.kind} has nothing to match")
    return kind


def selector_test(selector: Selector, line="line") -> Column:
    return _kind(selector).test(selector, F.col(line) if isinstance(line, str) else line)


def rule_hits(rule: LogRule, line="line") -> list[Column]:
    """One boolean per selector; selectors after a matching terminating one do not count."""
    hits, ended = [], F.lit(False)
    for selector in rule.selectors:
        test = selector_test(selector, line)
        hits.append(~ended & test if hits else test)
        if not selector.proceed:
            ended = ended | test
    return hits


def clean_line(rule: LogRule, trimmed: Column) -> Column:
    """The trimmed line as the rule's selectors allow it to be shown."""
    for sanitise in dict.fromkeys(_kind(s).sanitise for s in rule.selectors):
        if sanitise is not None:
            trimmed = sanitise(trimmed)
    return trimmed


def match_events(lines: DataFrame, source: LogSource, rules: list[LogRule]) -> DataFrame:
    """One row per (line, rule, selector) that matched, in columns of ``lines`` plus the match.

    A narrow transformation. Each test is a column, evaluated once per line; a filter on them
    would be pushed below and run them twice, so lines without a match leave in the explode.
    Only matching lines are cleaned, and the reset marker's own lines are never evaluated.
    """
    if source.reset:
        lines = lines.filter(~F.col("line").contains(source.reset))
    names, tests, plan = [], [], []
    for rule_idx, rule in enumerate(rules):
        for selector_idx, (selector, hit) in enumerate(zip(rule.selectors, rule_hits(rule))):
            name = f"_hit_{rule_idx}_{selector_idx}"
            names.append(name)
            tests.append(hit.alias(name))
            plan.append((name, rule_idx, rule, selector_idx, selector))
    if not plan:
        raise ConfigError(f"log source {source.name} has no selectors")
    tested = lines.select("*", *tests)
    trimmed = tested.withColumn(
        "_trimmed", F.when(_any(F.col(n) for n in names), trim_prefix("line", source.trim_prefix))
    )
    events = [
        F.when(
            F.col(name),
            F.struct(
                F.lit(rule.name).alias("rule_name"),
                F.lit(rule.description).alias("rule_description"),
                F.lit(rule_idx).alias("rule_idx"),
                F.lit(selector_idx).alias("selector_idx"),
                F.lit(selector.description).alias("selector_desc"),
                F.lit(selector.risk_level).alias("risk"),
                clean_line(rule, F.col("_trimmed")).alias("line"),
            ),
        )
        for name, rule_idx, rule, selector_idx, selector in plan
    ]
    kept = [c for c in lines.columns if c != "line"]
    return trimmed.select(
        *kept, F.explode(F.array_compact(F.array(*events))).alias("_event")
    ).select(*kept, "_event.*")
