"""Named queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as T
from textloom.operators import align, evaluation, inference, metrics, segment, tokens
from textloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(_table(spark, sf_dir, "documents"))


# A small glossary for the driver's prose, and illustrative prices a million words.
GLOSSARY = (("the", "article"), ("and|or", "conjunction"), ("license", "legal-term"), ("released", "name"), ("worthless|idiot", "insult"))
TERMS = (("the", ("the", "The"), "article"), ("and|or", ("and", "und"), "conjunction"), ("of", ("of", "de"), "legal-term"), ("to", ("into", "to"), "name"))
PRICES = (("small", 0.5, 1.5), ("large", 2.0, 5.0))
WORDS_SQL = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, conv_id, turn, src, ref, hyp, score: three ways to shorten the turns of conversations, scored by the share of characters kept."""
    earlier = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(earlier, "text").alias("src"), F.col("text").alias("ref"), F.split("text", " ").alias("w"))
    kept = {"identity": F.col("ref"), "every_fourth_dropped": F.array_join(F.filter("w", lambda x, i: i % 4 != 3), " "), "first_part": F.array_join(F.slice("w", F.lit(1), F.ceil(F.size("w") * 0.6).cast("int")), " ")}
    systems = F.explode(F.array(*(F.struct(F.lit(name).alias("system"), hyp.alias("hyp")) for name, hyp in kept.items()))).alias("s")
    rows = rows.select("conv_id", "turn", "src", "ref", systems).select("s.system", "conv_id", "turn", "src", "ref", "s.hyp")
    return rows.withColumn("score", F.least(100.0 * T.length_ratio(F.col("hyp"), F.col("ref")), F.lit(100.0)))


_SYSTEMS = r"""
WITH c AS (SELECT conv_id, turn, text AS ref, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), text) AS src, string_split(text, ' ') AS w FROM conversations),
u AS (SELECT 'identity' AS system, conv_id, turn, src, ref, ref AS hyp FROM c
  UNION ALL SELECT 'every_fourth_dropped', conv_id, turn, src, ref, array_to_string(list_filter(w, lambda x, i: i % 4 <> 0), ' ') FROM c
  UNION ALL SELECT 'first_part', conv_id, turn, src, ref, array_to_string(w[1:CAST(ceil(len(w) * 0.6) AS BIGINT)], ' ') FROM c),
v AS (SELECT *, length(regexp_replace(hyp, '\s', '', 'g')) AS hc, length(regexp_replace(ref, '\s', '', 'g')) AS rc, len(list_filter(string_split_regex(src, '\s+'), lambda x: x <> '')) AS words FROM u),
s AS (SELECT *, CASE WHEN rc > 0 THEN hc / rc WHEN hc = 0 THEN 1.0 ELSE 'inf'::DOUBLE END AS ratio FROM v),
p AS (SELECT *, least(100.0 * ratio, 100.0) AS score FROM s),
g(term, v1, v2, category) AS (VALUES """ + ", ".join(f"('{t}', '{v[0]}', '{v[1]}', '{c}')" for t, v, c in TERMS) + r"""),
hits AS (SELECT system, conv_id, turn, term, category, CASE WHEN contains(ref, v1) THEN v1 ELSE v2 END AS ref_variant, contains(hyp, v1) OR contains(hyp, v2) AS hit_any,
  CASE WHEN contains(ref, v1) THEN contains(hyp, v1) ELSE contains(hyp, v2) END AS hit_ref
  FROM p JOIN g ON regexp_matches(src, '(?i)\b(?:' || term || ')\b') AND (contains(ref, v1) OR contains(ref, v2))),
d AS (SELECT x.system AS a, y.system AS b, y.conv_id, y.turn, y.score - x.score AS delta, y.words FROM p x JOIN p y USING (conv_id, turn) WHERE (x.system, y.system) IN (('identity', 'first_part'), ('every_fourth_dropped', 'first_part'))),
o AS (SELECT *, CASE WHEN delta > 2 THEN 'win' WHEN delta < -2 THEN 'loss' ELSE 'tie' END AS outcome, CASE WHEN words <= 20 THEN '<=20' WHEN words <= 40 THEN '21-40' ELSE '>40' END AS bucket FROM d)
"""
COMPARISONS = (("identity", "first_part"), ("every_fourth_dropped", "first_part"))
_KEYS = ["conv_id", "turn"]

_LINES = r"""
WITH raw AS (SELECT doc_id, i, regexp_replace(list_extract(string_split(text, chr(10)), i), '^\s+|\s+$', '', 'g') AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
kept AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY i) = '', false) AS gap FROM raw WHERE NOT regexp_matches(line, '^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$')),
solid AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM kept WHERE line <> ''),
started AS (SELECT *, coalesce(prev IS NOT NULL AND (regexp_matches(line, '^(?:\d{1,3}(?:\.\d{1,3})*\.(?:\s|$)|\d{1,3}(?:\.\d{1,3})+(?:\s|$)|\(?[ivxlc]{1,6}[.)](?:\s|$)|\([a-zA-Z]\)(?:\s|$)|[a-z]\)(?:\s|$))') OR gap AND right(prev, 1) IN ('.','?','!',':',';','।','"','”','’')), false) AS starts FROM solid),
numbered AS (SELECT *, CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS seg_idx,
  CASE WHEN starts OR prev IS NULL THEN '' WHEN ends_with(prev, '-') AND regexp_matches(line, '^[a-z]') THEN '' ELSE ' ' END AS glue FROM started),
segments AS (SELECT doc_id, seg_idx, trim(regexp_replace(string_agg(glue || line, '' ORDER BY i), '\s+', ' ', 'g')) AS segment FROM numbered GROUP BY 1, 2)
"""


@query(_LINES + "SELECT doc_id, seg_idx, segment FROM segments")
def unwrap_segments(spark, sf_dir):
    return segment.unwrap(_docs(spark, sf_dir))


@query(_LINES + r"""
SELECT lang, CAST(count(*) AS BIGINT) AS segments, CAST(sum(len(list_filter(string_split_regex(segment, '\s+'), lambda w: w <> ''))) AS BIGINT) AS words,
  CAST(sum(length(regexp_replace(segment, '\s', '', 'g'))) AS BIGINT) AS chars FROM segments JOIN documents USING (doc_id) GROUP BY lang""")
def sentence_stats(spark, sf_dir):
    s = F.col("segment")
    return segment.unwrap(_docs(spark, sf_dir), ("doc_id", "lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("segments"), F.sum(T.count_words(s)).alias("words"), F.sum(T.count_chars(s)).alias("chars"))


@query(_LINES + r""", t AS (SELECT doc_id, seg_idx, i, string_split(segment, ' ') AS w FROM segments, LATERAL (SELECT unnest(range(1, len(string_split(segment, ' ')) + 1)) AS i)),
e AS (SELECT doc_id, seg_idx, i, w[i] AS word, lower(regexp_extract(w[i], '([A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*)[.?!]["”’)\]]*$', 1)) AS core,
  regexp_matches(w[i], '[.?!]["”’)\]]*$') AND regexp_matches(coalesce(w[i + 1], ''), '^[A-Z0-9"“‘''(\[]') AND NOT (i = 1 AND regexp_matches(w[i], '""" + segment.MARKER + r"""')) AS may FROM t),
f AS (SELECT *, may AND NOT (regexp_matches(core, '^[a-z](\.[a-z])*$') OR core IN (""" + ", ".join(f"'{w}'" for w in segment.ABBREVIATIONS_EN) + r""")) AS ends FROM e),
n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id, seg_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_idx FROM f)
SELECT doc_id, seg_idx, CAST(sent_idx AS INT) AS sent_idx, string_agg(word, ' ' ORDER BY i) AS sentence FROM n GROUP BY doc_id, seg_idx, sent_idx""")
def sentences(spark, sf_dir):
    return segment.split_sentences(segment.unwrap(_docs(spark, sf_dir)))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^([ \t]*\(?)[li]{3,}([.)])', '\1iii\2', 'g'), '(?m)^([ \t]*\(?)[li]{2}([.)])', '\1ii\2', 'g'), '(?m)^([ \t]*\(?)[li]([.)])', '\1i\2', 'g') AS cleaned
FROM (SELECT doc_id, translate(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), chr(160) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173), ' ') AS t FROM documents)""")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean(F.col("text"), F.lit("en")).alias("cleaned"))


@query(r"""SELECT lang, source, sum(w)::BIGINT AS words, sum(c)::BIGINT AS chars, sum(b)::BIGINT AS bytes, round(sum(c) / sum(w), 6) AS chars_per_word, round(100.0 * count(*) FILTER (w > 256) / count(*), 6) AS pct_over_256
FROM (SELECT lang, source, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w, length(regexp_replace(text, '\s', '', 'g')) AS c, strlen(text) AS b FROM documents) GROUP BY 1, 2""")
def corpus_ratios(spark, sf_dir):
    t = F.col("text")
    rows = _docs(spark, sf_dir).select("lang", "source", T.count_words(t).alias("w"), T.count_chars(t).alias("c"), F.octet_length(t).cast("long").alias("b"))
    w, c = F.sum("w"), F.sum("c")
    over = F.round(100.0 * F.count_if(F.col("w") > 256) / F.count(F.lit(1)), 6)
    return rows.groupBy("lang", "source").agg(w.alias("words"), c.alias("chars"), F.sum("b").alias("bytes"), F.round(c / w, 6).alias("chars_per_word"), over.alias("pct_over_256"))


@query(r"""SELECT name, lang, round(sum(w) * input / 1e6 + sum(w) * output / 1e6, 6) AS usd
FROM (SELECT lang, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w FROM documents), (VALUES ('small', 0.5::DOUBLE, 1.5::DOUBLE), ('large', 2.0, 5.0)) p(name, input, output) GROUP BY name, lang, input, output""")
def cost_model(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy("lang").agg(F.sum(T.count_words(F.col("text"))).alias("w"))
    prices = spark.createDataFrame(list(PRICES), "name string, input double, output double")
    return counts.crossJoin(F.broadcast(prices)).select("name", "lang", F.round(F.col("w") * F.col("input") / 1e6 + F.col("w") * F.col("output") / 1e6, 6).alias("usd"))


@query(r"""SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:[./,\-]\d+)*')) AS number FROM documents""")
def numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.numbers(F.col("text"))).alias("number"))


@query(r"""WITH t AS (SELECT doc_id, text AS src, array_to_string(string_split(text, ' ')[1:CAST(ceil(len(string_split(text, ' ')) * 0.6) AS BIGINT)], ' ') AS hyp FROM documents),
n AS (SELECT doc_id, unnest(regexp_extract_all(src, '\d+(?:[./,\-]\d+)*')) AS x, 1 AS a, 0 AS b FROM t UNION ALL SELECT doc_id, unnest(regexp_extract_all(hyp, '\d+(?:[./,\-]\d+)*')), 0, 1 FROM t),
k AS (SELECT doc_id, sum(a) AS a, sum(b) AS b FROM n GROUP BY doc_id, trim(regexp_replace(x, '[^0-9]+', ' ', 'g')))
SELECT doc_id, CAST(coalesce(sum(a), 0) AS BIGINT) AS total, CAST(coalesce(sum(least(a, b)), 0) AS BIGINT) AS preserved FROM t LEFT JOIN k USING (doc_id) GROUP BY 1""")
def number_fidelity(spark, sf_dir):
    w = F.split("text", " ")
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("src"), F.array_join(F.slice(w, F.lit(1), F.ceil(F.size(w) * 0.6).cast("int")), " ").alias("hyp"))
    return evaluation.number_fidelity(rows, ["doc_id"], "src", "hyp")


_CITED = "SELECT o_orderkey, concat('see (', 1950 + o_custkey % 70, ') ', 1 + o_orderkey % 12, ' SCC ', o_custkey, ' and AIR ', 1950 + o_orderkey % 70, ' SC ', o_orderkey, '.') AS src, concat('cf. ', 1950 + o_custkey % 70, ' ', 1 + o_orderkey % 12, CASE WHEN o_orderkey % 3 = 0 THEN ' SCC ' ELSE ' S.C.C. ' || o_custkey END, ' AIR ', o_orderkey, ' ', 1950 + o_orderkey % 70) AS hyp FROM orders"


@query(f"WITH t AS ({_CITED}), " + r"""c AS (SELECT o_orderkey, hyp, unnest(list_concat(regexp_extract_all(src, '\(\d{4}\)\s*\d+\s*[A-Z][A-Za-z.]{0,8}\s*\d+'), regexp_extract_all(src, 'AIR\s*\d{4}\s*[A-Z]{1,5}\s*\d+'))) AS c FROM t)
SELECT o_orderkey, count(*) AS total, CAST(count(*) FILTER (regexp_matches(hyp, '(?s)' || array_to_string(regexp_extract_all(c, '[0-9]+'), '.*'))) AS BIGINT) AS preserved FROM c GROUP BY 1""")
def citations(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    year, other, volume = 1950 + cust % 70, 1950 + key % 70, 1 + key % 12
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    src = text("see (", year, ") ", volume, " SCC ", cust, " and AIR ", other, " SC ", key, ".")
    hyp = text("cf. ", year, " ", volume, F.when(key % 3 == 0, " SCC ").otherwise(text(" S.C.C. ", cust)), " AIR ", key, " ", other)
    return evaluation.citation_fidelity(_table(spark, sf_dir, "orders").select("o_orderkey", src.alias("src"), hyp.alias("hyp")), ["o_orderkey"], "src", "hyp")


@query("""SELECT category, CAST(count(*) AS BIGINT) AS hits FROM documents JOIN (VALUES """ + ", ".join(f"('{e}', '{c}')" for e, c in GLOSSARY) + r""") g(en, category)
ON regexp_matches(text, '(?i)\b(?:' || en || ')\b') GROUP BY category""")
def glossary_hits(spark, sf_dir):
    return evaluation.glossary_hits(_docs(spark, sf_dir), ["doc_id"], GLOSSARY, "text").groupBy("category").agg(F.count(F.lit(1)).alias("hits"))


@query(_SYSTEMS + "SELECT * FROM hits")
def term_hits(spark, sf_dir):
    return evaluation.term_hits(_systems(spark, sf_dir), ["system", *_KEYS], TERMS)


@query(_SYSTEMS + """SELECT system, category, CAST(count(*) AS BIGINT) AS terms, round(count(*) FILTER (hit_any) / count(*), 6) AS hit_any_rate, round(count(*) FILTER (hit_ref) / count(*), 6) AS hit_ref_rate
FROM hits GROUP BY GROUPING SETS ((system, category), (system))""")
def term_rates(spark, sf_dir):
    return evaluation.fidelity(_systems(spark, sf_dir), _KEYS, TERMS).select("system", "category", "terms", F.round("hit_any_rate", 6).alias("hit_any_rate"), F.round("hit_ref_rate", 6).alias("hit_ref_rate"))


@query(_SYSTEMS + """SELECT system, CAST(count(*) AS BIGINT) AS n_segments, CAST(count(*) FILTER (ratio < 0.6) AS BIGINT) AS omission, CAST(count(*) FILTER (ratio > 1.6) AS BIGINT) AS addition, round(avg(ratio), 6) AS mean_length_ratio FROM p GROUP BY system""")
def system_fidelity(spark, sf_dir):
    rows = evaluation.fidelity(_systems(spark, sf_dir), _KEYS, TERMS).where("category IS NULL")
    return rows.select("system", "n_segments", "omission", "addition", F.round("mean_length_ratio", 6).alias("mean_length_ratio"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
g AS (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])) AS g FROM w),
k AS (SELECT conv_id, turn, g, count(*) AS n FROM g GROUP BY 1, 2, 3),
r AS (SELECT conv_id, turn, bool_or(n >= 3 OR g[1] = g[2] AND g[2] = g[3] AND g[3] = g[4]) AS repeated FROM k GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(repeated, false) AS repeated FROM conversations LEFT JOIN r USING (conv_id, turn)""")
def repetition(spark, sf_dir):
    return evaluation.repetition_flags(_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


_RATIO = r"""WITH t AS (SELECT conv_id, turn, length(regexp_replace(text, '\s', '', 'g')) AS h, length(regexp_replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '\s', '', 'g')) AS r FROM conversations),
q AS (SELECT conv_id, turn, CASE WHEN r > 0 THEN h / r WHEN h = 0 THEN 1.0 ELSE 'inf'::DOUBLE END AS ratio FROM t WHERE r IS NOT NULL) """


@query(_RATIO + "SELECT conv_id, turn, round(ratio, 6) AS ratio, ratio < 0.6 AS omission, ratio > 1.6 AS addition FROM q")
def length_flags(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumn("ref", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("ref IS NOT NULL")
    rows = turns.select("conv_id", "turn", T.length_ratio(F.col("text"), F.col("ref")).alias("r"))
    return rows.select("conv_id", "turn", F.round("r", 6).alias("ratio"), T.omission(F.col("r")).alias("omission"), T.addition(F.col("r")).alias("addition"))


def _compared(spark, sf_dir):
    return evaluation.compared(_systems(spark, sf_dir), _KEYS, COMPARISONS)


@query(_SYSTEMS + """, k AS (SELECT a, b, 'overall' AS kind, '' AS name, outcome FROM o UNION ALL SELECT a, b, 'bucket', bucket, outcome FROM o
  UNION ALL SELECT a, b, 'bucket', n, NULL FROM (SELECT DISTINCT a, b FROM o), (VALUES ('<=20'), ('21-40'), ('>40')) t(n)
  UNION ALL SELECT a, b, 'category', category, outcome FROM o JOIN hits ON hits.system = o.b AND hits.conv_id = o.conv_id AND hits.turn = o.turn)
SELECT a, b, kind, name, CAST(count(*) FILTER (outcome = 'win') AS BIGINT) AS win, CAST(count(*) FILTER (outcome = 'tie') AS BIGINT) AS tie, CAST(count(*) FILTER (outcome = 'loss') AS BIGINT) AS loss FROM k GROUP BY a, b, kind, name""")
def outcome_pivot(spark, sf_dir):
    return evaluation.outcome_counts(_compared(spark, sf_dir), _KEYS, TERMS)


@query(_SYSTEMS + """, r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY delta DESC, conv_id, turn) AS up, row_number() OVER (PARTITION BY a, b ORDER BY delta, conv_id, turn) AS down FROM o)
SELECT a, b, 'gain' AS side, CAST(up AS INT) AS place, conv_id, turn, round(delta, 6) AS delta FROM r WHERE up <= 10 UNION ALL SELECT a, b, 'loss', CAST(down AS INT), conv_id, turn, round(delta, 6) FROM r WHERE down <= 10""")
def top_changes(spark, sf_dir):
    return evaluation.top_changes(_compared(spark, sf_dir), _KEYS).withColumn("delta", F.round("delta", 6))


@query(_SYSTEMS + r""", f AS (SELECT system, conv_id, turn, list_filter(string_split_regex(hyp, '\s+'), lambda x: x <> '') AS w, src, ratio FROM p),
q AS (SELECT system, conv_id, turn, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])) AS q FROM f), k AS (SELECT system, conv_id, turn, q, count(*) AS n FROM q GROUP BY ALL),
r AS (SELECT system, conv_id, turn, bool_or(n >= 3 OR q[1] = q[2] AND q[2] = q[3] AND q[3] = q[4]) AS rep FROM k GROUP BY ALL),
b AS (SELECT conv_id, turn, bool_or(coalesce(rep, false) OR ratio < 0.6 OR ratio > 1.6) AS bad FROM f LEFT JOIN r USING (system, conv_id, turn) GROUP BY ALL),
x AS (SELECT conv_id, turn, src, bad, list_filter(string_split_regex(src, '\s+'), lambda x: x <> '') AS w FROM b JOIN c USING (conv_id, turn)),
z AS (SELECT conv_id, turn, [CASE WHEN regexp_matches(src, '(?i)\b(?:of)\b') THEN 'legal-term' END,
  CASE WHEN regexp_matches(src, '""" + T.ARCHAIC + r"""') THEN 'archaic/formulaic' END, CASE WHEN len(w) > 45 THEN 'long-sentence' END,
  CASE WHEN regexp_matches(src, '""" + T.DATE + r"""') OR regexp_matches(src, '""" + T.SECTION + r"""') OR regexp_matches(src, '""" + T.CITATIONS[0] + r"""') OR regexp_matches(src, '""" + T.CITATIONS[1] + r"""') THEN 'citation/section/date' END,
  CASE WHEN regexp_matches(src, '""" + T.CASE_NAME.replace("'", "''") + r"""') OR len(list_filter(range(2, len(w)), lambda i: NOT regexp_matches(w[i - 1], '[.!?]$') AND regexp_matches(trim(w[i], '(),;:"'), '^[A-Z][a-zA-Z''.]*$')
    AND regexp_matches(trim(w[i + 1], '(),;:"'), '^[A-Z][a-zA-Z''.]*$') AND trim(w[i], '(),;:"') NOT IN ('The', 'This', 'Court', 'High', 'Supreme', 'Act', 'Section', 'State') AND trim(w[i + 1], '(),;:"') NOT IN ('The', 'This', 'Court', 'High', 'Supreme', 'Act', 'Section', 'State'))) > 0 THEN 'named-entity' END,
  CASE WHEN bad THEN 'omission/hallucination' END] AS t FROM x)
SELECT conv_id, turn, array_to_string(list_filter(t, lambda y: y IS NOT NULL), ',') AS tags FROM z""")
def tags(spark, sf_dir):
    return evaluation.tagged(_systems(spark, sf_dir), _KEYS, TERMS).select(*_KEYS, F.array_join("tags", ",").alias("tags"))


@query(_SYSTEMS + "SELECT conv_id, turn, system, round(score, 6) AS score FROM p")
def per_segment(spark, sf_dir):
    rows = metrics.per_segment(_systems(spark, sf_dir), _KEYS)
    return rows.select(*_KEYS, F.explode("scores").alias("system", "score")).withColumn("score", F.round("score", 6))


@query(_SYSTEMS + """SELECT conv_id, turn, round(y.score - x.score, 6) AS delta, x.hyp AS baseline, y.hyp AS adapted FROM p x JOIN p y USING (conv_id, turn) WHERE x.system = 'identity' AND y.system = 'first_part'""")
def candidates(spark, sf_dir):
    rows = evaluation.candidates(_systems(spark, sf_dir), _KEYS, "identity", "first_part", TERMS)
    return rows.select(*_KEYS, F.round("delta", 6).alias("delta"), "baseline", "adapted")


@query(_SYSTEMS + "SELECT CAST(n AS INT) AS min_words, system, CAST(count(*) AS BIGINT) AS n FROM p, (VALUES (0), (5), (10)) t(n) WHERE words >= n GROUP BY 1, 2")
def robustness_sizes(spark, sf_dir):
    return metrics.robustness(_systems(spark, sf_dir)).select("min_words", "system", "n")


@query()
def robustness(spark, sf_dir):
    return metrics.robustness(_systems(spark, sf_dir))


@query("SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, unnest(list_transform(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.75, 0.95]), lambda x: round(x, 4))) AS v FROM lineitem")
def score_quantiles(spark, sf_dir):
    return evaluation.quantiles(_table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.05, 0.25, 0.5, 0.75, 0.95)).select("q", F.round("v", 4).alias("v"))


@query("SELECT bin, CAST(count(l_tax) AS BIGINT) AS n FROM range(10) r(bin) LEFT JOIN (SELECT l_tax, CAST(floor(least(greatest(l_tax, 0.0), 0.999999) / 0.1) AS BIGINT) AS b FROM lineitem) ON b = bin GROUP BY bin")
def histogram(spark, sf_dir):
    return evaluation.histogram(_table(spark, sf_dir, "lineitem"), "l_tax")


@query("""WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, n, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round(least(1, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS high FROM c""")
def audit_precision(spark, sf_dir):
    counts = _table(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return counts.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""SELECT CAST(grouping(lang) AS BIGINT) AS total, lang, CAST(count(*) AS BIGINT) AS docs, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS dropped, round(count(*) FILTER (quality = 0) / count(*), 6) AS drop_rate
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""")
def align_stats(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "lang").join(_table(spark, sf_dir, "labels"), "doc_id")
    dropped = F.count_if(F.col("quality") == 0)
    return rows.rollup("lang").agg(F.grouping("lang").cast("long").alias("total"), F.count(F.lit(1)).alias("docs"), dropped.alias("dropped"), F.round(dropped / F.count(F.lit(1)), 6).alias("drop_rate"))


_HASH = "(concat('0x', substr(md5('13:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


@query(f"SELECT doc_id, CASE WHEN {_HASH} < 0.1 THEN 'dev' WHEN {_HASH} < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents")
def split_assign(spark, sf_dir):
    return evaluation.hash_split(_docs(spark, sf_dir), 13, 0.1, 0.1)


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY doc_id HAVING count(*) > 1")
def split_check(spark, sf_dir):
    both = (evaluation.hash_split(_table(spark, sf_dir, name), 13 + k, 0.1, 0.1) for k, name in enumerate(("documents", "labels")))
    return evaluation.overlapping(next(both).union(next(both)))


@query("SELECT doc_id, quality FROM labels ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 20")
def audit_sample(spark, sf_dir):
    return evaluation.hash_sample(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 7, 20)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_PIECES = """WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS piece FROM documents), b AS (SELECT DISTINCT piece FROM w WHERE lang = 'en'),
n AS (SELECT count(*) AS n FROM b), x AS (SELECT DISTINCT piece FROM w WHERE lang = 'fr' AND regexp_matches(piece, '^[a-zà-ÿ]+$') AND piece NOT IN (SELECT piece FROM b)),
m AS (SELECT piece, CAST(n + row_number() OVER (ORDER BY encode(piece)) - 1 AS BIGINT) AS new_id FROM x, n) """


def _merged(spark, sf_dir):
    pieces = _docs(spark, sf_dir).select("lang", F.explode(F.split("text", " ")).alias("piece")).distinct()
    base, extra = (evaluation.numbered(pieces.where(F.col("lang") == lang).select("piece"), ["piece"], F.ascii("piece"), "piece_id") for lang in ("en", "fr"))
    return evaluation.vocabulary_merge(base, extra, F.col("piece").rlike("^[a-zà-ÿ]+$"))


@query(_PIECES + "SELECT piece, new_id FROM m")
def vocab_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(_PIECES + "SELECT new_id, CAST(length(piece) AS BIGINT) AS n, CAST(ord(piece) AS BIGINT) AS first_id FROM m")
def init_map(spark, sf_dir):
    return tokens.init_map(_merged(spark, sf_dir), tokens.CHARACTERS.ids).select("new_id", F.size("old_ids").cast("long").alias("n"), F.get("old_ids", F.lit(0)).alias("first_id"))


_COUNTED = r"""WITH k AS (SELECT source AS doc, lang, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, length(regexp_replace(text, '\s', '', 'g')) AS chars, strlen(text) AS bytes FROM documents),
t AS (SELECT doc, lang, words, chars, unnest(['words', 'characters', 'bytes']) AS tokenizer, unnest([words, chars, bytes]) AS tokens FROM k) """
_TOKENIZERS = (tokens.WORDS, tokens.CHARACTERS, tokens.BYTES)


def _counted(spark, sf_dir):
    return tokens.counted(_docs(spark, sf_dir), ["source", "lang"], _TOKENIZERS)


@query(_COUNTED + "SELECT tokenizer, lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(words) AS BIGINT) AS words, CAST(sum(chars) AS BIGINT) AS chars, round(sum(tokens) / sum(words), 6) AS fertility, round(sum(chars) / sum(tokens), 6) AS chars_per_token FROM t GROUP BY 1, 2")
def token_stats(spark, sf_dir):
    return tokens.corpus_stats(_counted(spark, sf_dir)).select("tokenizer", "lang", "tokens", "words", "chars", F.round("fertility", 6).alias("fertility"), F.round("chars_per_token", 6).alias("chars_per_token"))


@query(_COUNTED + 'SELECT tokenizer, lang, CAST(n AS INT) AS "limit", round(100.0 * count(*) FILTER (tokens > n) / count(*), 6) AS pct_over FROM t, (VALUES (128), (256), (512)) l(n) GROUP BY 1, 2, 3')
def token_limits(spark, sf_dir):
    return tokens.over_limits(_counted(spark, sf_dir), (128, 256, 512)).withColumn("pct_over", F.round("pct_over", 6))


@query(_COUNTED + "SELECT tokenizer, lang, round(avg(n), 4) AS tokens_per_document FROM (SELECT tokenizer, lang, doc, sum(tokens) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2")
def tokens_per_source(spark, sf_dir):
    return tokens.tokens_per_document(_counted(spark, sf_dir), "source").withColumn("tokens_per_document", F.round("tokens_per_document", 4))


@query(_COUNTED + """, f AS (SELECT tokenizer, lang, sum(tokens) / sum(words) AS fertility FROM t GROUP BY 1, 2) SELECT f.tokenizer, f.lang, round(100 * (1 - f.fertility / b.fertility), 6) AS reduction_pct FROM f JOIN f b ON b.lang = f.lang AND b.tokenizer = 'bytes'""")
def fertility_reduction(spark, sf_dir):
    return tokens.fertility_reduction(tokens.corpus_stats(_counted(spark, sf_dir)), "bytes").select("tokenizer", "lang", F.round("reduction_pct", 6).alias("reduction_pct"))


def _turn_pairs(spark, sf_dir):
    """pair_id, lang, text: each turn as hi, the turn before it as en."""
    rows = _systems(spark, sf_dir).where("system = 'identity'").select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.col("src").alias("en"), F.col("ref").alias("hi"))
    return rows.select("pair_id", F.explode(F.create_map(F.lit("en"), "en", F.lit("hi"), "hi")).alias("lang", "text"))


@query(_SYSTEMS + r""", k AS (SELECT words AS en_w, len(list_filter(string_split_regex(ref, '\s+'), lambda x: x <> '')) AS hi_w, length(regexp_replace(src, '\s', '', 'g')) AS en_c, rc AS hi_c, strlen(src) AS en_b, strlen(ref) AS hi_b FROM p WHERE system = 'identity'),
t AS (SELECT unnest(['words', 'characters', 'bytes']) AS tokenizer, unnest([en_w, en_c, en_b]) AS a, unnest([hi_w, hi_c, hi_b]) AS b FROM k)
SELECT tokenizer, round(sum(b) / sum(a), 6) AS ratio, round(median(CASE WHEN a > 0 THEN b / a END), 6) AS median_ratio FROM t GROUP BY 1""")
def pair_ratios(spark, sf_dir):
    counts = tokens.counted(_turn_pairs(spark, sf_dir), ["pair_id", "lang"], _TOKENIZERS)
    return tokens.pair_ratios(counts, "pair_id").select("tokenizer", F.round("ratio", 6).alias("ratio"), F.round("median_ratio", 6).alias("median_ratio"))


@query()
def tokenizer_study(spark, sf_dir):
    pairs = _turn_pairs(spark, sf_dir)
    documents = pairs.select(F.get(F.split("pair_id", "-"), F.lit(0)).alias("doc_id"), "lang", "text")
    return tokens.study(pairs, pairs, documents, [tokens.WORDS, tokens.CHARACTERS, replace(tokens.BYTES, price=(0.5, 1.5), max_length=512)])


@query(r"""WITH k AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n, contains(text, 'the') OR contains(text, 'and') AS has FROM documents),
r AS (SELECT *, CASE WHEN has AND n BETWEEN 10 AND 14 THEN 0 WHEN has AND n BETWEEN 6 AND 20 THEN 1 ELSE 2 END AS tier FROM k)
SELECT doc_id, text FROM r ORDER BY tier, CASE tier WHEN 0 THEN n WHEN 1 THEN abs(n - 12) ELSE -n END, doc_id LIMIT 1""")
def example_pick(spark, sf_dir):
    return tokens.example(_docs(spark, sf_dir).select("doc_id", "text"), ("the", "and"), "doc_id")


@query("""WITH s AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(event_id % 40) AS BIGINT) AS total_tokens, CAST(sum(event_id % 7) AS BIGINT) AS total_new_tokens, CAST(sum(event_id % 200) AS BIGINT) AS total_chars, sum(CAST(event_id % 90 AS DOUBLE)) AS total_nll FROM events GROUP BY 1)
SELECT event_type, round(total_tokens / n_sentences, 6) AS mean_tokens_per_sentence, round(total_nll / ln(2) / total_chars, 6) AS bits_per_char, round(exp(total_nll / total_tokens), 6) AS perplexity, round(total_new_tokens / total_tokens, 6) AS new_token_share FROM s""")
def perplexity(spark, sf_dir):
    i = F.col("event_id")
    sums = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(i % 40).alias("total_tokens"), F.sum(i % 7).alias("total_new_tokens"), F.sum(i % 200).alias("total_chars"), F.sum((i % 90).cast("double")).alias("total_nll"))
    names = ("mean_tokens_per_sentence", "bits_per_char", "perplexity", "new_token_share")
    return tokens.language_model_metrics(sums).select("event_type", *(F.round(c, 6).alias(c) for c in names))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS sentences, round(count(*) / nullif(max(epoch(ts)) - min(epoch(ts)), 0), 8) AS sents_per_sec, round(CAST(sum(event_id % 40) AS BIGINT) / nullif(max(epoch(ts)) - min(epoch(ts)), 0), 8) AS tokens_out_per_sec FROM events GROUP BY 1""")
def throughput(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    totals = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("event_id") % 40).alias("tokens_out"), (F.max(t) - F.min(t)).alias("seconds"))
    return inference.throughput(totals).select("event_type", "sentences", F.round("sents_per_sec", 8).alias("sents_per_sec"), F.round("tokens_out_per_sec", 8).alias("tokens_out_per_sec"))


@query(r"""SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY role ORDER BY len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), conv_id, turn) - 1) // 16 AS BIGINT) AS batch FROM conversations""")
def length_batches(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("n_words", T.count_words(F.col("text")))
    return inference.batches(rows, 16, ["n_words", "conv_id", "turn"], "role").select("conv_id", "turn", "batch")


@query(r"""WITH k AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), lambda x: length(x)) AS ids FROM conversations)
SELECT conv_id, turn, CAST(len(list_filter(ids, lambda x: x <> 1)) AS BIGINT) AS tokens_in, CAST(len(list_filter(ids, lambda x: x NOT IN (1, 2, 3))) AS BIGINT) AS tokens_out FROM k""")
def model_tokens(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(T.words(F.col("text")), F.length).alias("ids"))
    return rows.select("conv_id", "turn", inference.input_tokens(F.col("ids"), 1).alias("tokens_in"), inference.output_tokens(F.col("ids"), 1, (2, 3)).alias("tokens_out"))


@query("SELECT doc_id, CASE (row_number() OVER (ORDER BY doc_id) - 1) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM documents")
def round_robin(spark, sf_dir):
    rows = evaluation.numbered(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], F.floor(F.col("doc_id") / evaluation.GROUP_ROWS), "place")
    return rows.select("doc_id", F.when(F.col("place") % 3 == 0, "train").when(F.col("place") % 3 == 1, "dev").otherwise("test").alias("split"))


@query("""WITH k AS (SELECT doc_id, quality FROM labels WHERE quality = 1), s AS (SELECT doc_id FROM labels ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 20) SELECT doc_id FROM labels WHERE toxic = 0 AND doc_id IN (SELECT doc_id FROM k) AND doc_id NOT IN (SELECT doc_id FROM s)""")
def supplementary(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    sample = evaluation.hash_sample(labels.select("doc_id"), "doc_id", 7, 20)
    return evaluation.supplementary(labels.where("toxic = 0").select("doc_id"), sample, labels.where("quality = 1"), "doc_id")


@query("""WITH v AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'correct' WHEN quality = 1 THEN 'partial' WHEN doc_id % 5 = 0 THEN NULL ELSE 'wrong' END AS v FROM labels),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(count(v) AS BIGINT) AS judged, CAST(count(*) FILTER (v = 'correct') AS BIGINT) AS correct, CAST(count(*) FILTER (v IN ('correct', 'partial')) AS BIGINT) AS lenient FROM v)
SELECT n_items, judged, correct, lenient, round(correct / judged, 6) AS "precision", round(lenient / judged, 6) AS lenient_precision FROM c""")
def audit(spark, sf_dir):
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    verdict = F.when(good & clean, "correct").when(good, "partial").when(F.col("doc_id") % 5 == 0, None).otherwise("wrong")
    rows = evaluation.audit(_table(spark, sf_dir, "labels"), verdict)
    return rows.select("n_items", "judged", "correct", "lenient", F.round("precision", 6).alias("precision"), F.round("lenient_precision", 6).alias("lenient_precision"))


@query("""WITH e AS (SELECT vec_id % 10 AS new_id, vec_id FROM embeddings), d AS (SELECT new_id, unnest(range(64)) AS dim, unnest(embedding) AS x FROM e JOIN embeddings USING (vec_id))
SELECT CAST(new_id AS BIGINT) AS new_id, CAST(dim AS BIGINT) AS dim, round(avg(x::DOUBLE), 6) AS value FROM d GROUP BY 1, 2""")
def mean_init(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    edges = vectors.select((F.col("vec_id") % 10).alias("new_id"), F.col("vec_id").alias("old_id"))
    out = evaluation.mean_vectors(edges, vectors)
    return out.select("new_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("e").alias("x")).join(v.select(F.col("vec_id").alias("b"), F.col("e").alias("y")), "b")
    return pairs.select("a", "b", F.round(F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z), 4).alias("cosine"))


@query("""WITH h AS (SELECT user_id % 25 AS run, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) - 1 AS epoch, round(value, 1) AS score FROM events), c AS (SELECT * FROM h WHERE epoch > 0),
f AS (SELECT *, score > coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better FROM c),
l AS (SELECT *, coalesce(max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) AS last FROM f), z AS (SELECT run, coalesce(min(CASE WHEN epoch - last >= 3 THEN epoch END), max(epoch)) AS stopped_at FROM l GROUP BY run)
SELECT CAST(run AS BIGINT) AS run, CAST(max(CASE WHEN better AND epoch <= stopped_at THEN epoch END) AS BIGINT) AS best_epoch, CAST(stopped_at AS BIGINT) AS stopped_at FROM l JOIN z USING (run) GROUP BY run, stopped_at""")
def early_stop(spark, sf_dir):
    run = (F.col("user_id") % 25).alias("run")
    rows = _table(spark, sf_dir, "events").select(run, "event_id", F.round("value", 1).alias("score"))
    epoch = (F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1).cast("long")
    return evaluation.early_stop(rows.select("run", epoch.alias("epoch"), "score"), 3)


def _aligned(spark, sf_dir):
    """Each document's vectors, those of odd vec_id a blend of their neighbours, aligned with the even ones."""
    place = F.row_number().over(Window.partitionBy("doc", "side").orderBy("vec_id")) - 1
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    order = Window.partitionBy("doc").orderBy("vec_id")
    near = F.zip_with("v", F.coalesce(F.lead("v", 1).over(order), "v"), lambda x, y: x + 0.3 * y)
    both = v.select("vec_id", "doc", F.lit(0).alias("side"), "v").where("vec_id % 7 <> 3").union(v.select("vec_id", "doc", F.lit(1).alias("side"), near.alias("v")).where("vec_id % 5 <> 2"))
    both = both.withColumn("idx", place)
    src, tgt = (both.where(F.col("side") == s).select("doc", "idx", "v", F.lit(None).cast("int").alias("number")) for s in (0, 1))
    return align.align_vectors(src, tgt), src, tgt


@query()
def align_embeddings(spark, sf_dir):
    return _aligned(spark, sf_dir)[0]


@query()
def alignment_report(spark, sf_dir):
    pairs, src, tgt = _aligned(spark, sf_dir)
    judged = align.keep(pairs.withColumn("en", F.repeat(F.lit("x"), F.size("src_idx") * 10)).withColumn("hi", F.repeat(F.lit("x"), F.size("tgt_idx") * 10)))
    splits = src.select("doc").distinct().withColumn("split", F.when(F.col("doc") % 3 == 0, "dev").otherwise("train"))
    stats = align.alignment_stats(judged, align.sizes(src, tgt), splits)
    return stats.select("doc", "n_src", "n_tgt", "src_skipped", "tgt_skipped", "n_pairs", "n_kept", *(F.to_json(c).alias(c) for c in ("dropped", "types", "splits")))


@query()
def corpus_scores(spark, sf_dir):
    docs = files.dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = segment.split_sentences(segment.unwrap(docs)).select(F.col("sentence").alias("ref"), F.split("sentence", " ").alias("w"))
    kept = {"identity": F.col("ref"), "every_fourth_dropped": F.array_join(F.filter("w", lambda x, i: i % 4 != 3), " "), "first_part": F.array_join(F.slice("w", F.lit(1), F.ceil(F.size("w") * 0.6).cast("int")), " ")}
    systems = F.explode(F.array(*(F.struct(F.lit(name).alias("system"), hyp.alias("hyp")) for name, hyp in kept.items()))).alias("s")
    return metrics.corpus_scores(said.select("ref", systems).select("s.system", "s.hyp", "ref"))


@query()
def sentence_scores(spark, sf_dir):
    return _systems(spark, sf_dir).select("system", *_KEYS, metrics.sentence_chrf("hyp", "ref").alias("chrf"))


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, value FROM events), n AS (SELECT count(*) AS n FROM e),
d AS (SELECT i // n AS sample, concat('0x', substr(md5(i::VARCHAR), 1, 8))::BIGINT % n AS pos FROM n, LATERAL (SELECT unnest(range(20 * n)) AS i))
SELECT CAST(sample AS BIGINT) AS sample, round(avg(value), 8) AS mean FROM d JOIN e USING (pos) GROUP BY 1""")
def bootstrap_md5(spark, sf_dir):
    return metrics.hash_bootstrap(_table(spark, sf_dir, "events"), "event_id", "value", 20).select("sample", F.round("mean", 8).alias("mean"))
