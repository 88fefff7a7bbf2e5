"""Registered queries over log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.catalog import inputs as I
from keelson.catalog.register import Register
from keelson.config import AlertPolicy, LogRule, LogSource, Selector
from keelson.functions import text as X
from keelson.operators import logreport as R
from keelson.operators.alerts import log_alerts
from keelson.operators.rules import match_events, selector_test
from keelson.plans.logs import scan_lines

query = Register()

LINES = f"WITH lines AS ({I.LINES_SQL})"
EVENT_LINES = f"WITH lines AS ({I.EVENT_LINES_SQL})"

# Luhn over 16 characters; digits at even 0-based places count twice.
LUHN_SQL = """(regexp_full_match({0}, '[0-9]{{16}}') AND list_sum(list_transform(range(0, 16),
  lambda i: CASE WHEN i % 2 = 0
    THEN (CASE WHEN substr({0}, i::BIGINT + 1, 1)::INT > 4
               THEN substr({0}, i::BIGINT + 1, 1)::INT * 2 - 9
               ELSE substr({0}, i::BIGINT + 1, 1)::INT * 2 END)
    ELSE substr({0}, i::BIGINT + 1, 1)::INT END)) % 10 = 0)"""


def has_card(line):
    """A maximal run of exactly 16 digits that passes; runs are split off first."""
    return f"""len(list_filter(regexp_extract_all(translate({line}, '.- ', ''), '[0-9]{{16,}}'),
      lambda d: CASE WHEN len(d) = 16 THEN {LUHN_SQL.format('d')} ELSE false END)) > 0"""


CARD_TEST = has_card("line")
THE_TEST = "(contains(line, 'the') AND contains(line, 'and') AND NOT contains(line, 'over'))"
WORD_TEST = """((contains(lower(line), 'token') OR contains(lower(line), 'license')
   OR contains(lower(line), 'éa')) AND NOT contains(lower(line), '###'))"""
ADDRESS_TEST = r"""(regexp_matches(line, '[0-9]{1,3}(\.[0-9]{1,3}){3}|[\pL\pM\pN_]+@[\pL\pM\pN_]+')
   AND NOT regexp_matches(line, '^The '))"""
MASKED = "regexp_replace({0}, '[0-9]{{16,}}', 'XXXX XXXX XXXX XXXX', 'g')"


def tested(name, selector, sql):
    @query(name, LINES + f" SELECT source, file, line_no FROM lines WHERE {sql}")
    def run(spark, sf_dir):
        lines = I.log_lines(spark, sf_dir)
        return lines.filter(selector_test(selector)).select("source", "file", "line_no")


tested("log_contains", I.WORDS.selectors[0], THE_TEST)
tested("log_one_of", I.WORDS.selectors[1], WORD_TEST)
tested("log_regex", I.WORDS.selectors[2], ADDRESS_TEST)
tested("log_creditcard", I.CARDS.selectors[0], CARD_TEST)


@query("log_sanitise", LINES + f"""
SELECT source, file, line_no, {MASKED.format('line')} AS line FROM lines""")
def log_sanitise(spark, sf_dir):
    lines = I.log_lines(spark, sf_dir)
    return lines.withColumn("line", X.mask_cards("line"))


@query("card_numbers", LINES + f"""
SELECT source, file, line_no, d AS digits, {LUHN_SQL.format('d')} AS valid
FROM (SELECT source, file, line_no,
             unnest(regexp_extract_all(translate(line, '.- ', ''), '[0-9]{{16,}}')) AS d FROM lines)""")
def card_numbers(spark, sf_dir):
    runs = F.regexp_extract_all(X.compact_digits("line"), F.lit(X.CARD_RUN), F.lit(1))
    return (
        I.log_lines(spark, sf_dir)
        .select("source", "file", "line_no", F.explode(runs).alias("digits"))
        .withColumn("valid", X.is_card_number("digits"))
    )


@query("trim_prefix", LINES + """
SELECT source, file, line_no,
       CASE WHEN regexp_matches(line, '[0-9]+ |, ')
            THEN substr(line, strpos(line, regexp_extract(line, '[0-9]+ |, '))
                              + len(regexp_extract(line, '[0-9]+ |, ')))
            ELSE line END AS line
FROM lines""")
def trimmed(spark, sf_dir):
    return I.log_lines(spark, sf_dir).withColumn("line", X.trim_prefix("line", "[0-9]+ |, "))


TRIMMED = "regexp_replace(line, '^[A-Z][a-z]+ ', '')"


def text_events(shown):
    return f"""
SELECT source, file, line_no, 'words' AS rule_name, 0 AS rule_idx, 0 AS selector_idx,
       'the without over' AS selector_desc, 1 AS risk, {shown} AS line FROM lines WHERE {THE_TEST}
UNION ALL SELECT source, file, line_no, 'words', 0, 1, 'noted word', 3, {shown}
FROM lines WHERE {WORD_TEST} AND NOT {THE_TEST}
UNION ALL SELECT source, file, line_no, 'words', 0, 2, 'address', 2, {shown}
FROM lines WHERE {ADDRESS_TEST} AND NOT {THE_TEST}"""


CARD_EVENTS = f"""
UNION ALL SELECT source, file, line_no, 'cards', 1, 0, 'card number', 4,
       {MASKED.format(TRIMMED)} FROM lines WHERE {CARD_TEST}"""
EVENT_COLUMNS = [
    "source", "file", "line_no", "rule_name", "rule_idx", "selector_idx", "selector_desc",
    "risk", "line",
]


def events_of(lines, name):
    source = I.AUDIT.source(name)
    return match_events(lines, source, I.AUDIT.rules_of(source))


@query("log_events", LINES + text_events(TRIMMED) + CARD_EVENTS)
def log_events(spark, sf_dir):
    return events_of(I.log_lines(spark, sf_dir), "text").select(*EVENT_COLUMNS)


@query("log_terminate", LINES + f"""
SELECT source, file, line_no, 'first' AS selector_desc FROM lines WHERE contains(line, 'the')
UNION ALL SELECT source, file, line_no, 'second' FROM lines
WHERE contains(line, 'and') AND NOT contains(line, 'the')""")
def log_terminate(spark, sf_dir):
    rule = LogRule("stop", (
        Selector("contains", "first", ("the",), proceed=False),
        Selector("contains", "second", ("and",)),
    ))
    source = LogSource("stopping", ("stop",), "table")
    return match_events(I.log_lines(spark, sf_dir), source, [rule]).select(
        "source", "file", "line_no", "selector_desc"
    )


GROUPED_SQL = """,
keyed AS (SELECT *, CASE WHEN regexp_matches(line, '{pattern}')
                    THEN regexp_extract(line, '{pattern}') ELSE selector_desc END AS key
          FROM events),
groups AS (
  SELECT source, key, arg_min(selector_desc, place) AS description, max(risk) AS risk,
         count(*) AS count, arg_min(line_no, place) AS first_line_no,
         arg_min(line, place) AS first_line,
         CASE WHEN count(*) > 1 THEN arg_max(line_no, place) END AS last_line_no,
         CASE WHEN count(*) > 1 THEN arg_max(line, place) END AS last_line
  FROM (SELECT *, row_number() OVER (PARTITION BY source
                                     ORDER BY file, line_no, rule_idx, selector_idx) AS place
        FROM keyed) GROUP BY source, key)
"""


def flat_groups(groups):
    return groups.select(
        "source", "key", "description", "risk", "count",
        F.col("first.line_no").alias("first_line_no"), F.col("first.line").alias("first_line"),
        F.col("last.line_no").alias("last_line_no"), F.col("last.line").alias("last_line"),
    )


KEYED = LINES + ", events AS (" + text_events("line") + ")" + GROUPED_SQL.format(
    pattern="[a-z]*tion|[0-9]+"
)


@query("log_grouped", KEYED + "SELECT * FROM groups")
def log_grouped(spark, sf_dir):
    events = events_of(I.log_lines(spark, sf_dir), "keyed")
    return flat_groups(R.group_events(events, I.AUDIT.source("keyed").group_by))


@query("log_grouped_top", KEYED + """
SELECT * FROM (SELECT source, key, risk, count,
  row_number() OVER (PARTITION BY source ORDER BY risk DESC, count DESC, key) AS position
  FROM groups) WHERE position <= 10""")
def log_grouped_top(spark, sf_dir):
    scan = scan_lines(I.log_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("keyed"))
    return scan.rows.select("source", "key", "risk", "count", "position")


RESET_EVENTS = EVENT_LINES + r""",
resets AS (SELECT source, file, max(line_no) AS last_reset FROM lines
           WHERE contains(line, 'SIGNUP') GROUP BY ALL),
events AS (
  SELECT l.source, l.file, l.line_no, 0 AS rule_idx,
         CASE WHEN contains(l.line, 'ERROR') THEN 0 ELSE 1 END AS selector_idx,
         CASE WHEN contains(l.line, 'ERROR') THEN 'failed request' ELSE 'bought or viewed' END
         AS selector_desc,
         CASE WHEN contains(l.line, 'ERROR') THEN 3 ELSE 1 END AS risk,
         regexp_replace(l.line, '^\[[0-9]+\] ', '') AS line
  FROM lines l LEFT JOIN resets r USING (source, file)
  WHERE (r.last_reset IS NULL OR l.line_no > r.last_reset)
    AND regexp_matches(l.line, 'ERROR|PURCHASE|VIEW'))"""
RESET_GROUPS = RESET_EVENTS + GROUPED_SQL.format(pattern="[A-Z]+ user=[0-9]+")


@query("log_grouped_reset", RESET_GROUPS + "SELECT * FROM groups")
def log_grouped_reset(spark, sf_dir):
    scan = scan_lines(I.event_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("restarts"))
    groups = R.group_events(scan.events, I.AUDIT.group_pattern(scan.source))
    return flat_groups(groups)


@query("log_summary_reset", RESET_EVENTS + """
SELECT source, count(*) AS line_count,
       coalesce(any_value(m.n), 0) AS match_count, bool_or(contains(line, 'SIGNUP')) AS reset_occurred
FROM lines l LEFT JOIN (SELECT source, count(*) AS n FROM events GROUP BY source) m USING (source)
GROUP BY source""")
def log_summary_reset(spark, sf_dir):
    return scan_lines(I.event_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("restarts")).summary


@query("log_last_resets", EVENT_LINES + """
SELECT source, file, max(line_no) AS last_reset FROM lines
WHERE contains(line, 'SIGNUP') GROUP BY source, file""")
def log_last_resets(spark, sf_dir):
    totals = R.log_totals(I.event_lines(spark, sf_dir), "SIGNUP")
    return totals.filter("last_reset IS NOT NULL").select("source", "file", "last_reset")


GROUP_REPORT = RESET_GROUPS + r""",
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY risk DESC, count DESC, key)
                  AS position FROM groups),
bodies AS (
  SELECT source, string_agg(description || ' ' || key || ' (occurred: ' || count || ')' || chr(10)
    || '  FIRST line: ' || first_line_no || ' ' || first_line || chr(10)
    || coalesce('  LAST ' || last_line_no || ' ' || last_line || chr(10), ''), ''
    ORDER BY position) AS body FROM placed WHERE position <= 10 GROUP BY source),
summary AS (SELECT source, count(*) AS line_count,
                   bool_or(contains(line, 'SIGNUP')) AS reset_occurred FROM lines GROUP BY source)
SELECT source, line_count, CASE WHEN body IS NULL THEN 'No problems found'
       ELSE CASE WHEN reset_occurred
            THEN 'Encountered reset marker in logs, discarded prior logs.' || chr(10) || chr(10)
            ELSE '' END || body END AS report
FROM summary LEFT JOIN bodies USING (source)"""


@query("log_report_grouped", GROUP_REPORT)
def log_report_grouped(spark, sf_dir):
    scan = scan_lines(I.event_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("restarts"))
    return scan.report.select("source", "line_count", "report")


PLAIN_EVENTS = LINES + f""", events AS (
  SELECT source, file, line_no, 'cards' AS rule_name, 0 AS rule_idx, 0 AS selector_idx, 4 AS risk,
         {MASKED.format('line')} AS line FROM lines WHERE {CARD_TEST}
  UNION ALL SELECT source, file, line_no, 'quiet', 1, 0, 0, line FROM lines
  WHERE contains(line, 'st')),
arrived AS (SELECT *, row_number() OVER (PARTITION BY source
                      ORDER BY file, line_no, rule_idx, selector_idx) AS arrival FROM events),
listed AS (SELECT *, row_number() OVER (PARTITION BY source
                     ORDER BY rule_idx, risk, arrival) AS position
           FROM arrived WHERE arrival <= 20)
"""


@query("log_top_simple", PLAIN_EVENTS + """
SELECT source, rule_name, line_no, line, risk, arrival, position FROM listed""")
def log_top_simple(spark, sf_dir):
    scan = scan_lines(I.log_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("plain"))
    return scan.rows.select(
        "source", "rule_name", "line_no", "line", "risk", "arrival", "position"
    )


@query("log_report_simple", PLAIN_EVENTS + """,
parts AS (
  SELECT source, position, CASE WHEN position = 1 OR rule_name <> lag(rule_name) OVER (
           PARTITION BY source ORDER BY position) THEN 'Rule: ' || rule_name || ' - '
           || CASE rule_name WHEN 'cards' THEN 'payment cards' ELSE 'no risk at all' END || chr(10)
           ELSE '' END || line || chr(10) AS part FROM listed),
bodies AS (SELECT source, string_agg(part, '' ORDER BY position) AS body FROM parts
           GROUP BY source),
counts AS (SELECT source, count(*) AS match_count FROM events GROUP BY source),
totals AS (SELECT source, count(*) AS line_count FROM lines GROUP BY source)
SELECT source, line_count, coalesce(match_count, 0) AS match_count,
       CASE WHEN match_count IS NULL THEN 'No failures for cards and short words'
       ELSE match_count || ' events were detected in cards and short words' || chr(10) || body
       END AS report
FROM totals LEFT JOIN counts USING (source) LEFT JOIN bodies USING (source)""")
def log_report_simple(spark, sf_dir):
    scan = scan_lines(I.log_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("plain"))
    return scan.report.select("source", "line_count", "match_count", "report")


@query("log_repeated_rule", EVENT_LINES + r""", hits AS (
  SELECT source, line_no, n AS rule_idx, CASE WHEN contains(line, 'ERROR') THEN 3 ELSE 1 END AS risk
  FROM lines, unnest([0, 1]) u(n) WHERE regexp_matches(line, 'ERROR|PURCHASE|VIEW'))
SELECT source, rule_idx, risk, count(*) AS events FROM hits GROUP BY ALL""")
def log_repeated_rule(spark, sf_dir):
    events = events_of(I.event_lines(spark, sf_dir), "requests")
    return events.groupBy("source", "rule_idx", "risk").agg(F.count(F.lit(1)).alias("events"))


@query("log_summary", LINES + f""", n AS (
  SELECT source, CASE WHEN {THE_TEST} THEN 1 ELSE {WORD_TEST}::INT + {ADDRESS_TEST}::INT END
                 + ({CARD_TEST})::INT AS matches FROM lines)
SELECT source, count(*) AS line_count, sum(matches)::BIGINT AS match_count,
       false AS reset_occurred FROM n GROUP BY source""")
def log_summary(spark, sf_dir):
    return scan_lines(I.log_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("text")).summary


SIMPLE_REPORT = """,
parts AS (
  SELECT source, position, CASE WHEN position = 1 OR rule_name <> lag(rule_name) OVER (
           PARTITION BY source ORDER BY position) THEN 'Rule: ' || rule_name || ' - '
           || CASE rule_name WHEN 'cards' THEN 'payment cards' ELSE 'no risk at all' END || chr(10)
           ELSE '' END || line || chr(10) AS part FROM listed),
bodies AS (SELECT source, string_agg(part, '' ORDER BY position) AS body FROM parts GROUP BY source),
counts AS (SELECT source, count(*) AS n FROM events GROUP BY source),
totals AS (SELECT source, count(*) AS line_count FROM lines GROUP BY source)"""


@query("log_alerts", PLAIN_EVENTS + SIMPLE_REPORT + """
SELECT source, n IS NULL AS success, 'scanner@example.com' AS sender, 'ops@example.com' AS recipient,
       'The log scan ''' || source || ''' checked ' || line_count || ' log lines and matched '
       || coalesce(n, 0) || ' problems.' || chr(10) || chr(10) || 'Source: '
       || CASE source WHEN 'src0' THEN '/logs/src0.log' ELSE source END || chr(10) || chr(10)
       || CASE WHEN n IS NULL THEN 'No problems found.' || chr(10)
          ELSE n || ' events were detected in cards and short words' || chr(10) || body END AS body,
       CASE WHEN n IS NULL THEN 'Log scan succeeded: ' || source
            ELSE 'ALERT: Log scan detected problems: ' || source END AS subject
FROM totals LEFT JOIN counts USING (source) LEFT JOIN bodies USING (source)""")
def alerts(spark, sf_dir):
    scan = scan_lines(I.log_lines(spark, sf_dir), I.AUDIT, I.AUDIT.source("plain"))
    policy = AlertPolicy(True, True, "scanner@example.com", "ops@example.com")
    found = log_alerts(scan.report, policy, labels={"src0": "/logs/src0.log"})
    return found.select("source", "success", "sender", "recipient", "subject", "body")


QUERIES, ORACLES = query.queries, query.oracles
