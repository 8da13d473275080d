"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_MIX = """
WITH sources AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM sources),
means AS (SELECT source, greatest(ceil(rate / 16), 1) AS draws, rate / greatest(ceil(rate / 16), 1) AS mean FROM rates),
terms AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM means, range(0, 97) AS r(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
keyed AS (SELECT *, md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')))) AS key
          FROM documents),
drawn AS (SELECT DISTINCT key, keyed.source AS src, i, CAST('0x' || substr(md5(key || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
          FROM keyed JOIN means ON means.source IS NOT DISTINCT FROM keyed.source, range(0, (SELECT max(draws)::BIGINT FROM means)) AS r(i) WHERE i < draws),
times AS (SELECT key, src, count(*) FILTER (WHERE c <= u) AS n
          FROM drawn JOIN cdf ON cdf.source IS NOT DISTINCT FROM src GROUP BY key, src)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(r.copy AS INTEGER) AS copy,
       md5(d.key || ':place:' || r.copy) AS place
FROM keyed d JOIN times t ON d.key = t.key AND d.source IS NOT DISTINCT FROM t.src,
     range(0, (SELECT max(n) FROM times)) AS r(copy) WHERE r.copy < t.n
"""

_AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                     regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                  || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
           FROM docs LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS letter, substr(filter_order, 1, s - 1) AS before
          FROM orders, range(1, 6) AS r(s)),
states AS (SELECT *, contains(fails, letter) AS failing,
                  fails <> '' AND before <> '' AND regexp_matches(before, '[' || fails || 'z]') AS gone
           FROM cells, steps),
counts AS (SELECT part, filter_order, step, letter,
                  coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS kept,
                  coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS removed,
                  coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS redundant,
                  coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
                  coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0) AS good_lost,
                  coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0) AS toxic_lost
           FROM states GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counts
"""

_EXACT = """
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM lowered
"""

ORACLE: dict[str, str] = {"op3_mixing": _MIX, "op11_filter_audit": _AUDIT, "op12_exact_dedup": _EXACT}
