"""Queries opN_<name> of the corpus operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout import spread
from . import bpe_count, hmm, langid, packing, pii, quality, secrets, simhash, spiece, vafile


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op3_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_docs(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode(_docs(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_docs(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    return vafile.nearest(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), asks=F.col("vec_id") % 20 == 0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_docs(spark, sf_dir))


_L = langid.Settings()


def _level(n: int, gram: str, context: str, source: str) -> str:
    """CTEs of one order: counts, contexts, discount."""
    key = f"lang, {context}" if context else "lang"
    return f"""c{n} AS ({source}),
x{n} AS (SELECT {key}, sum(k) AS total, count(*) AS followers FROM c{n} GROUP BY {key}),
d{n} AS (SELECT lang, CASE WHEN one = 0 THEN 0.5 ELSE one / (one + 2 * two) END AS d FROM (SELECT lang, count(*) FILTER (WHERE k = 1) AS one, count(*) FILTER (WHERE k = 2) AS two FROM c{n} GROUP BY lang))"""


# an order-3 model; a language with fewer than 2 * hold_out labelled texts trains and calibrates on all of them
OP1_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, * FROM documents),
samp AS (SELECT rid, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, text) - 1 AS i, count(*) OVER (PARTITION BY lang) < {2 * _L.hold_out} AS few, text FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, text NULLS LAST) AS k FROM docs WHERE lang IS NOT NULL AND doc_id IS NOT NULL)
  WHERE k <= {_L.per_language} AND text IS NOT NULL),
letters AS (SELECT c, CAST(row_number() OVER (ORDER BY unicode(c)) + 1 AS INTEGER) AS sym FROM (
  SELECT c FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^\p{{L}}]+', '', 'g'), '')) AS c FROM samp) WHERE c <> '' GROUP BY c HAVING count(*) >= {_L.min_letter})),
size AS (SELECT count(*) + 2 AS a FROM letters),
flat AS (SELECT rid, unnest(l) AS c, generate_subscripts(l, 1) AS j FROM (
  SELECT rid, string_split(s, '') AS l FROM (SELECT rid, trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' ') AS s FROM docs) WHERE s <> '')),
sym AS (SELECT rid, j, CASE WHEN c = ' ' THEN 0 ELSE coalesce(sym, 1) END AS z FROM flat LEFT JOIN letters USING (c)),
gram AS (SELECT rid, coalesce(lag(z, 2) OVER w, 0) AS x, coalesce(lag(z, 1) OVER w, 0) AS y, z FROM sym WINDOW w AS (PARTITION BY rid ORDER BY j)),
{_level(3, "x, y, z", "x, y", f"SELECT lang, x, y, z, count(*) AS k FROM gram JOIN samp USING (rid) WHERE few OR i % {_L.hold_out} <> 0 GROUP BY lang, x, y, z")},
{_level(2, "y, z", "y", "SELECT lang, y, z, count(*) AS k FROM c3 GROUP BY lang, y, z")},
{_level(1, "z", "", "SELECT lang, z, count(*) AS k FROM c2 GROUP BY lang, z")},
g AS (SELECT DISTINCT x, y, z FROM gram),
p1 AS (SELECT g.*, x1.lang, greatest(coalesce(c1.k, 0) - d1.d, 0) / x1.total + d1.d * x1.followers / x1.total / (SELECT a FROM size) AS p
  FROM g, x1 JOIN d1 USING (lang) LEFT JOIN c1 ON c1.lang = x1.lang AND c1.z = g.z),
p2 AS (SELECT p1.x, p1.y, p1.z, p1.lang, CASE WHEN x2.total IS NULL THEN p ELSE greatest(coalesce(c2.k, 0) - d2.d, 0) / x2.total + d2.d * x2.followers / x2.total * p END AS p
  FROM p1 JOIN d2 USING (lang) LEFT JOIN x2 ON x2.lang = p1.lang AND x2.y = p1.y LEFT JOIN c2 ON c2.lang = p1.lang AND c2.y = p1.y AND c2.z = p1.z),
p3 AS (SELECT p2.x, p2.y, p2.z, p2.lang, -log2(CASE WHEN x3.total IS NULL THEN p ELSE greatest(coalesce(c3.k, 0) - d3.d, 0) / x3.total + d3.d * x3.followers / x3.total * p END) AS bits
  FROM p2 JOIN d3 USING (lang) LEFT JOIN x3 ON x3.lang = p2.lang AND x3.x = p2.x AND x3.y = p2.y LEFT JOIN c3 ON c3.lang = p2.lang AND c3.x = p2.x AND c3.y = p2.y AND c3.z = p2.z),
h AS (SELECT rid, p3.lang AS model, count(*) AS n, sum(bits) AS total, sum(bits * bits) AS square FROM gram JOIN p3 USING (x, y, z) GROUP BY rid, p3.lang),
held AS (SELECT lang, model, sum(total) / sum(n) AS mean, sum(square) / sum(n) - (sum(total) / sum(n)) ** 2 AS variance FROM h JOIN samp USING (rid) WHERE few OR i % {_L.hold_out} = 0 GROUP BY lang, model),
cal AS (SELECT model, max(mean) FILTER (WHERE lang = model) AS mean, max(variance) FILTER (WHERE lang = model) AS variance,
  coalesce(avg(mean) FILTER (WHERE lang <> model), (SELECT log2(a) FROM size)) AS foreign_mean FROM held GROUP BY model),
best AS (SELECT rid, model, n, total / n AS bits FROM h QUALIFY row_number() OVER (PARTITION BY rid ORDER BY total / n, model) = 1)
SELECT doc_id, model AS language, round(bits, 6) AS bits, coalesce(n, 0) AS n_symbols,
  coalesce(bits <= mean + {_L.cut} * greatest(foreign_mean - mean, 0) + {_L.max_z} * sqrt(variance / n), false) AS accepted
FROM docs LEFT JOIN best USING (rid) LEFT JOIN cal USING (model)
"""

OP2_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{packing.TOKEN}') AS t FROM documents),
n AS (SELECT doc_id, t, len(t) AS n FROM t WHERE len(t) > 0),
p AS (
  SELECT doc_id, t, list_concat(
    list_transform(range(0, n // {1 << packing.MAX_POWER}), lambda i: {{'s': i * {1 << packing.MAX_POWER}, 'k': CAST({packing.MAX_POWER} AS BIGINT)}}),
    list_filter(list_transform(range({packing.MAX_POWER - 1}, -1, -1), lambda k: {{'s': n - n % CAST(2 ** (k + 1) AS BIGINT), 'k': k}}), lambda x: (n // CAST(2 ** x.k AS BIGINT)) % 2 = 1)
  ) AS l FROM n),
u AS (SELECT doc_id, t, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS piece, CAST(x.s AS INTEGER) AS start, CAST(x.k AS INTEGER) AS power, CAST(2 ** x.k AS INTEGER) AS n_tokens,
  array_to_string(t[x.s + 1 : x.s + CAST(2 ** x.k AS BIGINT)], '') AS text
FROM u
"""

_S = secrets.Rules()
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '[A-Za-z0-9+/_-]+|[^A-Za-z0-9+/_-]+') AS l FROM documents),
u AS (SELECT rid, doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS k FROM d),
o AS (SELECT rid, doc_id, s, k, sum(length(s)) OVER (PARTITION BY rid ORDER BY k) - length(s) AS start FROM u),
r AS (SELECT doc_id, s AS run, start, length(regexp_extract(s, '^[/_+-]*(?:{secrets.KNOWN}[/_+-]+)*')) AS ahead FROM o WHERE length(s) >= {_S.min_length} AND regexp_matches(s, '^[A-Za-z0-9+/_-]')),
q AS (SELECT doc_id, run, start + ahead AS start, regexp_extract(substr(run, CAST(ahead AS BIGINT) + 1), '^(.*?)(?:[/_+-]+{secrets.KNOWN})*[/_+-]*$', 1) AS s FROM r),
c AS (SELECT row_number() OVER () AS cid, * FROM q
  WHERE length(s) >= {_S.min_length} AND regexp_matches(s, '[A-Za-z]') AND NOT regexp_full_match(s, '{secrets.KNOWN}')
    AND NOT regexp_full_match(run, '{_UUID}') AND NOT regexp_full_match(s, '{_UUID}')
    AND NOT regexp_matches(s, '{"|".join(secrets.PLACEHOLDERS)}')
    AND 2 * list_sum(list_transform(string_split_regex(s, '[/_+-]'), lambda x: CASE WHEN regexp_full_match(x, '{secrets.KNOWN}') THEN 0 ELSE length(x) END)) >= length(s)),
w AS (SELECT cid, i, substr(s, i, {_S.window}) AS w FROM (SELECT cid, s, unnest(range(1, length(s) - {_S.window - 2})) AS i FROM c)),
n AS (SELECT cid, i, ch, count(*) AS n FROM (SELECT cid, i, unnest(string_split(w, '')) AS ch FROM w) GROUP BY cid, i, ch),
h AS (SELECT cid, i, sum(n * log2(n)) AS t FROM n GROUP BY cid, i),
e AS (SELECT cid, round(log2({_S.window}) - min(t) / {_S.window}, 6) AS entropy FROM h GROUP BY cid),
k AS (SELECT c.*, entropy, CASE WHEN regexp_full_match(s, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(s, '[A-Z]?[a-z]+') THEN 'letters' WHEN regexp_full_match(s, '[0-9A-Za-z]+') THEN 'alnum' ELSE 'base64' END AS kind FROM c JOIN e USING (cid))
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(length(s) AS BIGINT) AS length, kind, entropy FROM k
WHERE entropy >= CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _S.limits.items())} END
"""

OP9_SQL = f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id AS query_id, b.id AS neighbour_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS s FROM e AS a JOIN e AS b ON a.id % 20 = 0 AND a.id <> b.id),
r AS (SELECT query_id, neighbour_id, round(sqrt(s), 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sqrt(s), neighbour_id) AS INTEGER) AS rank FROM d)
SELECT * FROM r WHERE rank <= {vafile.K}
"""

_Q = quality.Rules()
_PUNCT = ".,;:!?''\"()-"
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(lang, '') AS lang FROM documents),
c AS (SELECT rid, lang, length(text) AS n,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS c0, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS c1,
  length(regexp_replace(text, '[^\p{{N}}]', '', 'g')) AS c3, length(regexp_replace(text, '[^\t\n\f\r ]', '', 'g')) AS c4,
  length(regexp_replace(text, '[^{_PUNCT}]', '', 'g')) AS c5 FROM d WHERE text IS NOT NULL),
cl AS (SELECT rid, lang, n AS total, unnest([c0, c1, letters - c0 - c1, c3, c4, c5, n - letters - c3 - c4 - c5]) AS k, unnest(range(7)) AS bin FROM c),
cr AS (SELECT lang, bin, sum(k) AS k, sum(sum(k)) OVER (PARTITION BY lang) AS total FROM cl GROUP BY lang, bin),
cp AS (SELECT rid, cl.total, cl.k / greatest(cl.total, 1) AS p, cr.k / greatest(cr.total, 1) AS q FROM cl JOIN cr USING (lang, bin)),
cd AS (SELECT rid, total AS n_chars, CASE WHEN total = 0 THEN 0 ELSE round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) END AS dist FROM cp GROUP BY rid, total),
w AS (SELECT rid, lang, lower(unnest(regexp_extract_all(text, '\p{{L}}+'))) AS w FROM d),
wl AS (SELECT lang, w, count(*) AS k FROM w GROUP BY lang, w),
wk AS (SELECT lang, w, k, count(*) OVER (PARTITION BY lang ORDER BY k DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, sum(k) OVER (PARTITION BY lang) AS total FROM wl),
common AS (SELECT * FROM wk WHERE r <= {_Q.top}),
wr AS (SELECT lang, w, k, total FROM common UNION ALL SELECT lang, NULL, total - coalesce(sum(k) FILTER (WHERE r <= {_Q.top}), 0), total FROM wk GROUP BY lang, total),
wd AS (SELECT rid, w.lang, common.w AS w, count(*) AS k FROM w LEFT JOIN common ON w.lang = common.lang AND w.w = common.w GROUP BY rid, w.lang, common.w),
wt AS (SELECT rid, lang, count(*) AS n FROM w GROUP BY rid, lang),
wp AS (SELECT wt.rid, wt.n, coalesce(wd.k, 0) / wt.n AS p, wr.k / wr.total AS q FROM wt JOIN wr ON wt.lang = wr.lang LEFT JOIN wd ON wd.rid = wt.rid AND wd.w IS NOT DISTINCT FROM wr.w),
wj AS (SELECT rid, n AS n_words, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS dist FROM wp GROUP BY rid, n)
SELECT doc_id, CAST(cd.dist AS DOUBLE) AS class_distance, CASE WHEN text IS NULL THEN NULL ELSE coalesce(wj.dist, 0.0) END AS word_distance,
  text IS NOT NULL AND NOT (coalesce(cd.dist > {_Q.max_class} AND n_chars >= {_Q.min_chars}, false)
    OR coalesce(wj.dist > {_Q.max_words} + {_Q.word_noise} / sqrt(n_words) AND n_words >= {_Q.min_words}, false)) AS keep
FROM d LEFT JOIN cd USING (rid) LEFT JOIN wj USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op1_language_id": OP1_SQL, "op2_packing": OP2_SQL, "op5_secret_scan": OP5_SQL, "op9_exact_top_k": OP9_SQL, "op10_quality_rules": OP10_SQL}
