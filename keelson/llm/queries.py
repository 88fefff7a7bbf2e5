"""The registered queries of these operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from keelson.catalog.register import Register
from keelson.llm import (
    collocations, decontaminate, jaccard_join, langid, masked_lm, near_dedup, packing, pii, quality_model,
    quality_rules, ranked_search, sharding, suffix_dedup,
)
from keelson.llm.common import fold, table

register = Register()
QUERIES, ORACLES = register.queries, register.oracles

SHARD_BYTES = 1 << 20
VOCABULARY = "word_bpe_49k.json"


@register(
    "op1_shards",
    f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS w
  FROM documents
), n AS (
  SELECT doc_id, n_bytes, depth, w >> (60 - depth) AS prefix,
         sum(n_bytes) OVER b AS shard_bytes, count(*) OVER b AS shard_rows
  FROM d, range(0, 41) r(depth)
  WINDOW b AS (PARTITION BY depth, w >> (60 - depth))
)
SELECT doc_id, n_bytes, depth || '-' || prefix || '-0-0' AS shard, depth AS shard_depth,
       shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM n WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
""",
)
def op1_shards(spark, sf_dir):
    """Every document's shard of at most SHARD_BYTES of text."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return sharding.shard(docs, "doc_id", F.col("n_bytes"), SHARD_BYTES)


_SPACES = r"[\x20\x09-\x0D]"
_RATIOS = {
    "symbols": "1000 * n_symbols // greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
    "word_length": "1000 * word_chars // greatest(n_words, 1)",
}


def _per_ratio(values):
    return "CASE ratio " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _quartiles_sql(groups):
    keys = "".join(f"{g}, " for g in groups)
    return f"""(
  SELECT {keys}ratio, n, min(bucket) FILTER (4 * upto >= 2 * n) AS mid,
         min(bucket) FILTER (4 * upto >= 3 * n) - min(bucket) FILTER (4 * upto >= n) AS wide
  FROM (
    SELECT {keys}ratio, bucket, count(*) OVER (PARTITION BY {keys}ratio ORDER BY bucket) AS upto,
           count(*) OVER (PARTITION BY {keys}ratio) AS n FROM b
  ) GROUP BY {keys}ratio, n)"""


def _settled_sql(name, wider, groups, on):
    """The group's fences after its wider group's."""
    keys = "".join(f"q.{g}, " for g in groups)
    same = "".join(f" AND q.{g} IS NOT DISTINCT FROM w.{g}" for g in on)
    mean = lambda c: f"(q.n * q.{c} + {quality_rules.BLEND} * w.{c}) // (q.n + {quality_rules.BLEND})"
    return f"""{name}_0 AS (
  SELECT {keys}q.ratio, least({mean("mid")}, w.fence) AS mid,
         {mean("wide")} AS own, w.wide AS w_wide
  FROM {_quartiles_sql(groups)} q JOIN {wider} w ON q.ratio = w.ratio{same}
), {name}_1 AS (
  SELECT *, least(greatest(own, {_per_ratio(quality_rules.SPREADS)}), 2 * w_wide) AS wide FROM {name}_0
), {name} AS (
  SELECT *, least(mid + {quality_rules.REACH} * wide, {_per_ratio(quality_rules.MOST)}) AS fence FROM {name}_1
)"""


@register(
    "op5_quality_rules",
    rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(body, '{_SPACES}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
  ) GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(body, '{_SPACES}', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         {", ".join(f"({v})::BIGINT AS r_{k}" for k, v in _RATIOS.items())}
  FROM c
), v AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, r_{k} AS v FROM f WHERE NOT base_failed" for k in _RATIOS)}
), b AS (
  SELECT lang, source, ratio, greatest(length(ltrim(bin(v), '0')) - {quality_rules.FINE + 1}, 0)::INT AS s,
         ((v >> s) << s) AS bucket FROM v
), a_0 AS (
  SELECT ratio, mid, greatest(wide, {_per_ratio(quality_rules.SPREADS)}) AS wide FROM {_quartiles_sql([])}
), a AS (
  SELECT *, least(mid + {quality_rules.REACH} * wide, {_per_ratio(quality_rules.MOST)}) AS fence FROM a_0
), {_settled_sql("l", "a", ["lang"], [])}, {_settled_sql("o", "l", ["lang", "source"], ["lang"])}, rules AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{k}' THEN fence END) AS max_{k}" for k in _RATIOS)}
  FROM o GROUP BY lang, source
)
SELECT f.doc_id, f.lang, f.source, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines,
       f.n_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed {" ".join(f"AND r_{k} <= coalesce(max_{k}, r_{k})" for k in _RATIOS)} AS kept
FROM f LEFT JOIN rules o
  ON f.lang IS NOT DISTINCT FROM o.lang AND f.source IS NOT DISTINCT FROM o.source
""",
)
def op5_quality_rules(spark, sf_dir):
    """Base counts of every document and whether it passes its group's fences."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@register(
    "op4_decontaminate",
    rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (
    SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i
    FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM (
    SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
    FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)
), h AS (
  SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, gram)
), p AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
""",
)
def op4_decontaminate(spark, sf_dir):
    """How much of every document stands in benchmark items."""
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return decontaminate.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@register("op2_packing")
def op2_packing(spark, sf_dir):
    """The pieces of all documents with their place in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=False)
    return packed.drop("ids")


@register("op9_pii")
def op9_pii(spark, sf_dir):
    """Personal data in every document: the patterns' counts and all spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(pii.of_kind("base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
    )


@register("op7_quality_model")
def op7_quality_model(spark, sf_dir):
    """A quality score for every document, learned from labels outside the held-out fold."""
    labels = quality_model.learnable(table(spark, sf_dir, "labels"))
    rated = quality_model.rate(table(spark, sf_dir, "documents"), labels)
    return rated.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@register("op8_langid")
def op8_langid(spark, sf_dir):
    """The language of every document, learned from documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learnable(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@register("op10_masked_lm")
def op10_masked_lm(spark, sf_dir):
    """The masked pseudo-likelihood of every document."""
    return masked_lm.score_words(table(spark, sf_dir, "documents"))


@register("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    """The near-duplicate class of every document, named by its least doc_id."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@register("op6_suffix_dedup")
def op6_suffix_dedup(spark, sf_dir):
    """What is left of every document without the 100-byte strings that occurred before."""
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op11_ranked_search",
    rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM documents
), f AS (
  SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
), c AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id
), s AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM c
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark
), p AS (
  SELECT item_id, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN c USING (doc_id), s GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM p WHERE score > 0
) WHERE rank <= {ranked_search.TOP}
""",
)
def op11_ranked_search(spark, sf_dir):
    """The highest-scoring documents of every benchmark item."""
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register(
    "op12_jaccard_join",
    rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '{_SPACES}+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
""",
)
def op12_jaccard_join(spark, sf_dir):
    """The number of shingles of every document and its component of linked documents."""
    return jaccard_join.components(table(spark, sf_dir, "documents"))


_CUTS = " UNION ALL ".join(
    f"SELECT p.lang, p.ws, p.a, {k} AS cut, x.a AS l, y.a AS r FROM p JOIN p x ON x.lang = p.lang AND x.ws = p.ws[:{k}] "
    f"JOIN p y ON y.lang = p.lang AND y.ws = p.ws[{k + 1}:] WHERE len(p.ws) > {k}"
    for k in range(1, collocations.LONGEST)
)
_INSIDE = " UNION ALL ".join(
    f"SELECT lang, ws[{i}:{i + n - 1}] AS ws, a FROM p WHERE len(ws) > {n} AND len(ws) >= {i + n - 1}"
    for n in range(2, collocations.LONGEST) for i in range(1, collocations.LONGEST - n + 2)
)


@register(
    "op13_collocations",
    rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), t AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  {" UNION ALL ".join(f"SELECT lang, ws[i:i + {k - 1}] AS ws FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})" for k in range(1, collocations.LONGEST + 1))}
), p AS (
  SELECT lang, ws, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= {collocations.LEAST}
), c AS (
  SELECT *, (2000000::HUGEINT * a // (l + r))::BIGINT AS score FROM ({_CUTS})
), s AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1
), m AS (
  SELECT lang, ws, max(a) AS most FROM ({_INSIDE}) GROUP BY lang, ws
), k AS (
  SELECT s.lang, array_to_string(s.ws, ' ') AS phrase, s.a, l, r, score FROM s LEFT JOIN m ON m.lang = s.lang AND m.ws = s.ws
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM k JOIN t USING (lang) QUALIFY rank <= {collocations.TOP}
""",
)
def op13_collocations(spark, sf_dir):
    """The phrases of every language whose words occur together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
