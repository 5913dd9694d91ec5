"""The operators' queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import suffix_dedup as S
from . import url_reputation as U

_SECOND = "|".join(U.SECOND_LEVEL)

#: Parsing, the rules, and the beta-binomial shrinkage, with the strengths by moments at each level.
URL_FILTER = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{U.UPPER}', '{U.LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
worst AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
hosts AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(w.bad) AS n, coalesce(sum(w.bad), 0) AS bad
  FROM seen LEFT JOIN worst w USING (page_id) GROUP BY host),
ends AS (SELECT *, CASE WHEN regexp_extract(name, '(?:^|\\.)((?:{_SECOND})\\.[a-z]{{2}})$', 1) <> '' THEN regexp_extract(name, '(?:^|\\.)((?:{_SECOND})\\.[a-z]{{2}})$', 1) ELSE list_last(string_split(name, '.')) END AS suffix FROM hosts),
named AS (SELECT *, array_to_string(list_slice(string_split(name, '.'), greatest(1, len(string_split(name, '.')) - CASE WHEN contains(suffix, '.') THEN 2 ELSE 1 END), len(string_split(name, '.'))), '.') AS domain FROM ends),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
units AS (SELECT 1 AS level, n, bad FROM suffixes UNION ALL SELECT 2, n, bad FROM domains UNION ALL SELECT 3, n, bad FROM named),
sums AS (SELECT level, count(*) AS m, sum(n)::DOUBLE AS t, sum(bad)::DOUBLE AS b, sum(n * n)::DOUBLE AS n2, sum(n * (bad / n) * (bad / n)) AS r2, sum(n * (bad / n) * (1 - bad / n)) AS within FROM units WHERE n > 0 GROUP BY level),
spread AS (SELECT level, m, t, (r2 - t * (b / t) * (b / t)) / (m - 1) AS between_, within / (t - m) AS inside, (t - n2 / t) / (m - 1) AS size FROM sums WHERE m >= 2 AND t > m),
rhos AS (SELECT level, CASE WHEN between_ + (size - 1) * inside > 0 THEN (between_ - inside) / (between_ + (size - 1) * inside) ELSE {U.DEFAULT_RHO} END AS rho FROM spread),
strength AS (SELECT l.level, 1 / least({U.MOST_RHO}, greatest({U.LEAST_RHO}, coalesce(rho, {U.DEFAULT_RHO}))) - 1 AS k FROM (VALUES (1), (2), (3)) l(level) LEFT JOIN rhos USING (level)),
whole AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate FROM suffixes),
suffix_mean AS (SELECT suffix, (bad + rate * k) / (n + k) AS mean FROM suffixes, whole, strength WHERE level = 1),
domain_mean AS (SELECT domain, (bad + mean * k) / (n + k) AS mean FROM domains JOIN suffix_mean USING (suffix), strength WHERE level = 2),
beta AS (SELECT host, bad + mean * k AS a, n - bad + (1 - mean) * k AS b FROM named JOIN domain_mean USING (domain), strength WHERE level = 3),
rated AS (SELECT host, a / (a + b) - {U.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower FROM beta),
rules(rh, rp, says) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(says, length(rh || rp)) AS says FROM seen, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN lower > {U.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM seen JOIN rated USING (host) LEFT JOIN fits USING (page_id)
"""

#: Windows of 13 words (or a whole shorter item), the document words that any occurrence covers, and the longest run of windows of one item.
DECONTAMINATE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U.UPPER}', '{U.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{U.UPPER}', '{U.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(13, len(words)) AS n FROM b WHERE len(words) > 0),
windows AS (SELECT item_id, n, i AS place, array_to_string(list_slice(words, i, i + n - 1), ' ') AS key FROM sized, unnest(generate_series(1, len(words) - n + 1)) t(i)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT d.doc_id, d.i, d.n, x.item_id, d.i - x.place AS shift
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS key FROM w, lengths, unnest(generate_series(1, len(words) - n + 1)) t(i) WHERE len(words) >= n) d
  JOIN windows x ON d.key = x.key AND d.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(generate_series(i, i + n - 1)) t(p) GROUP BY doc_id),
runs AS (SELECT doc_id, n, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS run, item_id, shift FROM found),
longest AS (SELECT doc_id, max(words) AS words FROM (SELECT doc_id, count(*) + n - 1 AS words FROM runs GROUP BY doc_id, item_id, shift, run, n) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM found GROUP BY doc_id)
SELECT doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.words) AS contaminated, coalesce(longest.words, 0)::BIGINT AS longest_match
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


def _runs(length: int) -> str:
    """Maximal runs of bytes under strings of some length that start twice or more."""
    return f"""SELECT id, min(i) AS lo, max(i) + {length} AS hi FROM (
  SELECT id, i, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM (
    SELECT id, i, CASE WHEN i > lag(i) OVER (PARTITION BY id ORDER BY i) + {length} THEN 1 ELSE 0 END AS new FROM (
      SELECT id, i, count(*) OVER (PARTITION BY k) AS n
      FROM (SELECT id, i, md5(body[i + 1:i + {length}]) AS k FROM d, unnest(range(0, n_bytes - {length - 1})) t(i) WHERE n_bytes >= {length})
    ) WHERE n > 1)) GROUP BY id, run"""


#: Every string of the two lengths, the runs that repeated ones cover, and what lies between the runs.
SUFFIX_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS body, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
runs AS ({_runs(S.LENGTH)}),
passages AS ({_runs(S.PASSAGE)}),
pieces AS (
  SELECT id, lo, coalesce(lag(hi) OVER (PARTITION BY id ORDER BY lo), 0) AS after FROM runs
  UNION ALL SELECT id, n_bytes, coalesce((SELECT max(hi) FROM runs r WHERE r.id = d.id), 0) FROM d),
kept AS (SELECT id, sha256(unhex(coalesce(string_agg(hex(body[after + 1:lo]), '' ORDER BY lo) FILTER (lo > after), ''))) AS kept_sha256 FROM pieces JOIN d USING (id) GROUP BY id)
SELECT doc_id, n_bytes, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, kept_sha256, coalesce(p.n, 0)::BIGINT AS n_repeated
FROM d JOIN kept USING (id) LEFT JOIN (SELECT id, sum(hi - lo) AS n, count(*) AS spans FROM runs GROUP BY id) r USING (id)
LEFT JOIN (SELECT id, sum(hi - lo) AS n FROM passages GROUP BY id) p USING (id)
"""

#: Shingles of different texts, all pairs that share one, and what links reach.
JACCARD_JOIN = f"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS id, coalesce(text, '') AS body FROM documents GROUP BY 2),
w AS (SELECT id, regexp_extract_all(translate(body, '{U.UPPER}', '{U.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM t),
sh AS (SELECT DISTINCT id, array_to_string(list_slice(words, i, i + 2), ' ') AS s FROM w, unnest(generate_series(1, greatest(1, len(words) - 2))) g(i) WHERE len(words) > 0),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
links AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
  JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM t UNION SELECT r.id, ways.b FROM reach r JOIN ways ON r.other = ways.a),
root AS (SELECT id, min(other) AS root FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE root END AS component_id
FROM documents JOIN t ON body = coalesce(text, '') JOIN root USING (id) LEFT JOIN n USING (id)
"""

#: The exact nearest, which the operator finds all where its recall is 1, as on tables of few vectors.
NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""
