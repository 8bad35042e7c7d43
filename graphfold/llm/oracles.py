"""The queries' results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from graphfold.llm.near import NearRule
from graphfold.llm.quality import LOW, RATES, Thresholds
from graphfold.llm.urls import Reputation

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SEARCH = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def urls_sql(rule: Reputation) -> str:
    suffixes = ", ".join(f"'{s}'" for s in rule.long_suffixes)
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    rules = (("example.com", "/de/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("net", "/", "block"))
    over, most = "sum((b - n * m) * (b - n * m) - n * m * (1 - m))", "sum(n * (n - 1) * m * (1 - m))"
    strength = f"CASE WHEN coalesce({most}, 0) <= 0 THEN {rule.unfitted} WHEN {over} / {most} <= 0 THEN {rule.most_strength} ELSE least(greatest({most} / {over} - 1, {rule.least_strength}), {rule.most_strength}) END"

    def level(name: str, groups: str) -> str:
        """Groups with the strength s that is fitted to their scatter, and their posterior mean."""
        return f"{name}_raw AS MATERIALIZED ({groups}), {name} AS MATERIALIZED (SELECT r.*, f.s, (b + f.s * m) / (n + f.s) AS mean FROM {name}_raw r, (SELECT {strength} AS s FROM {name}_raw) f)"

    def total(begin: str, end: str) -> str:
        """The bell's sum from one place to another, at the middles of equal steps."""
        t = f"(centre + spread * ({begin} + ({end} - {begin}) * (i + 0.5) / {rule.places}))"
        return f"({end} - {begin}) * list_sum(list_transform(range({rule.places}), lambda i: exp(x * {t} - (x + y) * ln(1 + exp({t})) - peak)))"

    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(h, p, v)}'" for h, p, v in rules) + " END"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, regexp_extract(coalesce(r, ''), '^[^/?#]*') AS h, coalesce(r, '') AS r FROM rest),
p AS MATERIALIZED (SELECT page_id, {lower("h")} AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosts),
l AS (SELECT doc_id AS page_id, max(greatest(CAST(quality = 0 AS INT), CAST(toxic = 1 AS INT))) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
byhost AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM p LEFT JOIN l USING (page_id) GROUP BY 1),
parts AS (SELECT *, string_split(host, '.') AS s FROM byhost),
two AS (SELECT *, array_to_string(s[greatest(len(s) - 1, 1):], '.') AS d2, array_to_string(s[greatest(len(s) - 2, 1):], '.') AS d3 FROM parts),
dom AS (SELECT host, n, b, CASE WHEN d2 IN ({suffixes}) THEN d3 ELSE d2 END AS domain FROM two),
suf AS MATERIALIZED (SELECT *, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM dom),
a AS (SELECT (sum(b) + 1.0) / (sum(n) + 2.0) AS m FROM suf),
{level("suffixes", "SELECT suffix, sum(n) AS n, sum(b) AS b, any_value(a.m) AS m FROM suf, a GROUP BY 1")},
{level("domains", "SELECT domain, sum(suf.n) AS n, sum(suf.b) AS b, any_value(u.mean) AS m FROM suf JOIN suffixes u USING (suffix) GROUP BY 1")},
{level("hosted", "SELECT host, suf.n, suf.b, u.mean AS m FROM suf JOIN domains u USING (domain)")},
beta AS (SELECT host, b + s * m AS x, n - b + s * (1 - m) AS y FROM hosted),
bell AS (SELECT *, ln(x / y) AS centre, sqrt(1 / x + 1 / y) AS spread FROM beta),
cut AS (SELECT *, least(greatest((ln({rule.limit} / (1 - {rule.limit})) - centre) / spread, -{rule.wide}), {rule.wide}) AS cut, x * centre - (x + y) * ln(1 + exp(centre)) AS peak FROM bell),
rated AS MATERIALIZED (SELECT host, above / (below + above) AS certainty FROM (SELECT host, {total(f"-{rule.wide}", "cut")} AS below, {total("cut", str(rule.wide))} AS above FROM cut))
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule,
  coalesce({case(lambda h, p, v: v)}, CASE WHEN certainty >= {rule.certainty} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN rated USING (host)
"""


def quality_sql(rule: Thresholds) -> str:
    text = "coalesce(text, '')"
    gram = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]"
    values = " UNION ALL ".join(f"SELECT lang, source, {i} AS measure, {c} AS bucket FROM rated WHERE NOT base_failed" for i, c in enumerate(RATES))
    smooth = ", ".join(f"CAST(floor(ln(CAST(2 * {n} + 1 AS DOUBLE) / CAST(2 * {size} + 2 AS DOUBLE)) / ln({rule.growth})) AS INT) AS {c}" for c, (n, size) in RATES.items())

    def fences(name: str, keys: str) -> str:
        """Fences of merged sketches: the buckets at which the counts so far reach the quantiles."""
        by = f"{keys}, " if keys else ""
        group = f"{by}measure"
        quantile = lambda q: f"CAST(min(bucket) FILTER (seen >= ceil({q} * n_all)) AS DOUBLE)"
        return f"""
{name}_sum AS (SELECT {group}, bucket, sum(n) AS n FROM sketch GROUP BY {group}, bucket),
{name}_seen AS (SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {group}) AS n_all FROM {name}_sum),
{name}_q AS (SELECT {group}, max(n_all) AS rows, {quantile(rule.low)} AS low, {quantile(0.5)} AS mid, {quantile(rule.high)} AS high FROM {name}_seen GROUP BY {group}),
{name}_raw AS (SELECT {group}, rows, mid - {rule.reach} * greatest(mid - low, 1) AS lo, mid + {rule.reach} * greatest(high - mid, 1) AS hi FROM {name}_q)"""

    mixed = ", ".join(f"(x.rows * x.{s} + {rule.prior_rows} * y.{s}) / (x.rows + {rule.prior_rows}) AS {s}" for s in ("lo", "hi"))
    columns = ", ".join(f"max({s}) FILTER (measure = {i}) AS {c}_{s}" for i, c in enumerate(RATES) for s in ("lo", "hi"))
    beyond = " OR ".join([f"r.{c} > own.{c}_hi" for c in RATES] + [f"r.{c} < own.{c}_lo" for c in LOW])
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang, source, {text} AS t, {WORDS.format(text)} AS w FROM documents),
g AS (SELECT k, i, {gram} AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
under AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT x) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY k),
m AS MATERIALIZED (SELECT k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(under.n, 0) AS n_repeat_words
  FROM d LEFT JOIN under USING (k) LEFT JOIN lines USING (k)),
rated AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {smooth} FROM m),
sketch AS MATERIALIZED (SELECT lang, source, measure, bucket, count(*) AS n FROM ({values}) GROUP BY ALL),
{fences("own", "lang, source")}, {fences("lan", "lang")}, {fences("whole", "")},
lan AS (SELECT x.lang, x.measure, {mixed} FROM lan_raw x JOIN whole_raw y USING (measure)),
mixed AS (SELECT x.lang, x.source, x.measure, {mixed} FROM own_raw x JOIN lan y ON x.measure = y.measure AND x.lang IS NOT DISTINCT FROM y.lang),
own AS MATERIALIZED (SELECT lang, source, {columns} FROM mixed GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce({beyond}, true)) AS kept
FROM rated r LEFT JOIN own ON r.lang IS NOT DISTINCT FROM own.lang AND r.source IS NOT DISTINCT FROM own.source
"""


def near_sql(rule: NearRule) -> str:
    k = rule.shingle
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {WORDS.format(lowered)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM d WHERE len(w) >= {k})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {k - 1})),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {rule.percent} * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS r FROM both_ways UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.node WHERE reach.r < e.b),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON node = doc_id
"""


ORACLES = {"op3_pivot_search": SEARCH, "op4_url_reputation": urls_sql(Reputation()), "op6_quality_rules": quality_sql(Thresholds()), "op8_near_duplicates": near_sql(NearRule())}
