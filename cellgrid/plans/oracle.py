"""DuckDB SQL for each registered query (same keys and column names).

Written independently of the Spark plans: plain windows and quantiles over
cell-level rows, which is fine for a checker at small scale.
"""

from __future__ import annotations

# Shared views as CTE text ------------------------------------------------------
M1_CELLS = """
m1_cells AS (
  SELECT o_orderkey AS cell_idx,
         'C' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '-1' AS cell_id,
         o_orderstatus AS status, o_totalprice AS price, o_orderdate AS ordered_at,
         (o_orderpriority = '1-URGENT') AS urgent
  FROM orders)"""

M1_X = """
m1_x AS (
  SELECT l_orderkey AS cell_idx, l_partkey AS gene_idx, sum(l_quantity) AS value
  FROM lineitem GROUP BY l_orderkey, l_partkey HAVING sum(l_quantity) <> 0)"""

M1_GENES = """
m1_genes AS (
  SELECT p_partkey AS gene_idx,
         CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN p_name
              ELSE p_name || '-' || CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS VARCHAR)
         END AS gene_id,
         'G' || CAST(p_partkey AS VARCHAR) AS gene_ids,
         p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, p_retailprice AS retail
  FROM part)"""

M1_TOTALS = """
m1_totals AS (
  SELECT c.*, coalesce(t.total, 0.0) AS total_umis
  FROM m1_cells c LEFT JOIN (SELECT cell_idx, sum(value) AS total FROM m1_x GROUP BY cell_idx) t
    USING (cell_idx))"""

BASE = "WITH " + ",".join([M1_CELLS, M1_X, M1_GENES, M1_TOTALS])

# sorted totals with 0-based descending position
SORTED = """,
sorted AS (SELECT total_umis, row_number() OVER (ORDER BY total_umis DESC) - 1 AS pos FROM m1_totals)"""

ORACLE: dict[str, str] = {}

ORACLE["a01_total_umis"] = BASE + "\nSELECT cell_id, total_umis FROM m1_totals"

ORACLE["a02_totals_histogram"] = BASE + """
SELECT total, n, cum, CAST(cum - n AS BIGINT) AS cum_before FROM (
  SELECT total_umis AS total, count(*) AS n,
         CAST(sum(count(*)) OVER (ORDER BY total_umis DESC) AS BIGINT) AS cum
  FROM m1_totals GROUP BY total_umis)"""

ORACLE["a03_kth_total"] = BASE + SORTED + """
SELECT (SELECT total_umis FROM sorted WHERE pos = 299) AS kth_total,
       (SELECT count(*) FROM m1_totals) AS n_cells"""

ORACLE["a04_cr_thresholds"] = BASE + SORTED + """
SELECT (SELECT total_umis FROM sorted WHERE pos = 30) AS upper_total,
       (SELECT total_umis FROM sorted WHERE pos = 30) * 0.1 AS retain,
       CASE WHEN (SELECT count(*) FROM sorted) >= 45000
            THEN (SELECT total_umis FROM sorted WHERE pos = 44999) ELSE 1.0 END AS lower"""

ORACLE["a05_classic"] = BASE + SORTED + """
SELECT cell_id, total_umis FROM m1_totals
WHERE total_umis >= (SELECT total_umis FROM sorted WHERE pos = 30) * 0.1"""

ORACLE["a06_default_drops"] = BASE + SORTED + """
SELECT cell_id, total_umis,
       total_umis > (SELECT quantile_cont(total_umis, 0.99) FROM sorted WHERE pos < 3000) * 0.1 AS is_cell
FROM m1_totals"""

ORACLE["a07_shape"] = BASE + """
SELECT (SELECT count(*) FROM m1_cells) AS n_cells, (SELECT count(*) FROM m1_genes) AS n_genes,
       count(*) AS nnz, sum(value) AS sum_value FROM m1_x"""

ORACLE["s10_make_unique"] = BASE + "\nSELECT gene_idx, gene_id FROM m1_genes"

# ----------------------------------------------------------------- F / J
M2 = """,
m2 AS (
  SELECT 'C' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '-1' AS cell_id,
         'B' || CAST(o_custkey % 4 AS VARCHAR) AS batch,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 1000 END AS score
  FROM orders WHERE o_orderstatus <> 'P'
  UNION ALL SELECT 'X' || n_name, 'BX', 1.0 FROM nation),
fcells AS (SELECT t.*, m2.batch, m2.score FROM m1_totals t LEFT JOIN m2 USING (cell_id))"""

FBASE = BASE + M2


def _c(pred: str) -> str:
    return f"coalesce({pred}, false)"


F_SQL = {
    "f01_select_cells": "total_umis > 100 AND status = 'F'",
    "f03_eq": _c("batch = 'B1'"),
    "f04_ne": "NOT " + _c("batch = 'B1'"),
    "f05_lt": "score < 100",
    "f06_le": "score <= 100.5",
    "f07_gt": "score > 200",
    "f08_ge": "score >= 200",
    "f09_is_regex": _c("regexp_full_match(batch, 'B[12]')"),
    "f09b_regex_prefix": _c("regexp_matches(batch, '^B')"),
    "f10_is_not_regex": "NOT " + _c("regexp_full_match(batch, 'B[12]')"),
    "f13_and": "score > 100 AND batch = 'B0' AND urgent = true",
    "f14_or": f"{_c('score > 300')} OR {_c(chr(98) + 'atch = ' + chr(39) + 'B3' + chr(39))} OR {_c('total_umis < 10')}",
    "f15_not": "NOT " + _c("score > 100"),
    "f16_negative": "score > -1 AND NOT " + _c("score <= -500") + " AND NOT " + _c("score > 150"),
    "f18_quoted_name": "total_umis > 150 AND status = 'F'",
    "f19_bool_number": f"{_c('urgent = true')} OR ({_c('urgent = false')} AND {_c('score < 10')})",
    "f19b_bool_text": "urgent = true AND NOT " + _c("urgent = false"),
    "f20_category_literal": "NOT " + _c("status = '1'"),
    "f21_nested": (f"({_c(chr(98) + 'atch = ' + chr(39) + 'B0' + chr(39))} OR {_c('batch = ' + chr(39) + 'B1' + chr(39))})"
                   f" AND NOT ({_c('score < 50')} OR {_c('status = ' + chr(39) + 'P' + chr(39))})"),
    "f11_in_list": _c("status IN (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O'))"),
    "f12_not_in_list": ("NOT " + _c("status IN (SELECT DISTINCT o_orderstatus FROM orders "
                                    "WHERE o_orderstatus IN ('F', 'O'))") + " OR " + _c("score > 400")),
}
for _k, _p in F_SQL.items():
    ORACLE[_k] = FBASE + f"\nSELECT cell_id FROM fcells WHERE {_p}"

ORACLE["f02_select_genes"] = BASE + """
SELECT gene_idx, gene_id FROM m1_genes WHERE retail > 950 AND NOT coalesce(brand = 'Brand#13', false)"""

ORACLE["f17_gene_name"] = BASE + """
SELECT gene_idx, gene_id FROM m1_genes
WHERE regexp_full_match(gene_id, '(red|hot) .*') AND NOT coalesce(regexp_full_match(gene_id, '.*-[0-9]+'), false)"""

ORACLE["f11b_in_list_genes"] = BASE + """
SELECT gene_idx, gene_id FROM m1_genes
WHERE brand IN (SELECT p_brand FROM part WHERE p_size <= 2) AND size > 20"""

ORACLE["f01b_matrix_follows"] = BASE + """
SELECT x.gene_idx, count(*) AS n_cells, sum(x.value) AS umis
FROM m1_x x
JOIN m1_totals c ON c.cell_idx = x.cell_idx AND c.total_umis > 100 AND c.urgent = false
JOIN m1_genes g ON g.gene_idx = x.gene_idx AND g.size >= 25
GROUP BY x.gene_idx"""

ORACLE["f22_removed_count"] = FBASE + """
SELECT count(*) AS n_before,
       count(*) FILTER (WHERE coalesce(score > 150, false) OR coalesce(batch = 'B2', false)) AS n_kept,
       count(*) FILTER (WHERE NOT (coalesce(score > 150, false) OR coalesce(batch = 'B2', false))) AS n_removed
FROM fcells"""

ORACLE["j01_annotate_cells"] = FBASE + "\nSELECT cell_id, status, total_umis, batch, score FROM fcells"

ORACLE["j02_annotate_genes"] = BASE + """
SELECT g.gene_id, g.brand, a.double_size, a.kind
FROM m1_genes g LEFT JOIN (SELECT gene_id, size * 2 AS double_size, type AS kind FROM m1_genes WHERE size < 25) a
USING (gene_id)"""

ORACLE["j03_id_column_last"] = FBASE + """
SELECT t.cell_id, m2.batch AS grp, m2.score AS value FROM m1_totals t LEFT JOIN m2 USING (cell_id)"""

ORACLE["j04_replace_cells"] = """
WITH c AS (SELECT o_orderkey AS cell_idx, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders),
     r AS (SELECT 'R' || CAST(o_orderkey AS VARCHAR) AS cell_id, o_orderpriority AS priority,
                  row_number() OVER (ORDER BY o_orderkey DESC) AS pos FROM orders)
SELECT c.cell_idx, r.cell_id, r.priority FROM c JOIN r USING (pos)"""

ORACLE["j05_drop_annotation"] = FBASE + """
SELECT cell_idx, cell_id, status, price, urgent, total_umis, batch FROM fcells"""

ORACLE["j07_promote"] = """
WITH m AS (SELECT max(p_partkey) AS mx FROM part)
SELECT o_orderkey AS cell_idx, (SELECT mx FROM m) + 1 AS gene_idx, 'price' AS gene_id, o_totalprice AS value
FROM orders WHERE o_totalprice <> 0
UNION ALL
SELECT o_orderkey, (SELECT mx FROM m) + 2, 'urgent', 1.0 FROM orders WHERE o_orderpriority = '1-URGENT'"""

# ----------------------------------------------------------------- W
XT = """,
xt AS (SELECT cell_idx, sum(value) AS total FROM m1_x GROUP BY cell_idx)"""

ORACLE["w01_barcode_ranks"] = BASE + XT + """
SELECT c.cell_id, xt.total,
       rank() OVER (ORDER BY xt.total DESC) + (count(*) OVER (PARTITION BY xt.total) - 1) / 2.0 AS rank
FROM xt JOIN m1_cells c USING (cell_idx) WHERE xt.total > 0"""


def _knee_ctes(lower: float, exclude_from: float) -> str:
    return XT + f""",
h AS (SELECT total, count(*) AS n FROM xt WHERE total > 0 GROUP BY total),
r AS (SELECT total, sum(n) OVER (ORDER BY total DESC) - (n - 1) / 2.0 AS rank,
             row_number() OVER (ORDER BY total DESC) AS i FROM h),
p AS (SELECT i, total, log10(rank) AS x, log10(total) AS y FROM r WHERE total > {lower}),
mk AS (SELECT count(*) AS m, count(*) FILTER (WHERE x <= log10({exclude_from})) AS k FROM p),
d AS (SELECT a.i, (b.y - a.y) / (b.x - a.x) AS d FROM p a JOIN p b ON b.i = a.i + 1
      WHERE a.i > (SELECT least(m - 2, k) FROM mk)),
re AS (SELECT i FROM d ORDER BY d, i LIMIT 1),
le AS (SELECT i FROM d WHERE i <= (SELECT i FROM re) ORDER BY d DESC, i LIMIT 1),
pl AS (SELECT * FROM p WHERE i = (SELECT i FROM le)),
pr AS (SELECT * FROM p WHERE i = (SELECT i FROM re)),
inner_pts AS (
  SELECT p.i, p.total,
         p.y - (pl.y + (pr.y - pl.y) * (p.x - pl.x) / (pr.x - pl.x)) AS dist
  FROM p, pl, pr WHERE p.i > pl.i AND p.i < pr.i),
kn AS (SELECT total FROM inner_pts ORDER BY dist DESC, i LIMIT 1),
kv AS (SELECT coalesce((SELECT total FROM kn), (SELECT total FROM pl)) AS knee, (SELECT total FROM pr) AS infl)"""


def _knee_sql(lower: float, exclude_from: float) -> str:
    return BASE + _knee_ctes(lower, exclude_from) + """
SELECT (SELECT knee FROM kv) AS knee, (SELECT infl FROM kv) AS inflection,
       (SELECT total FROM pl) AS left_total, (SELECT m FROM mk) AS n_points"""


ORACLE["w02_knee_inflection"] = _knee_sql(100, 50)
ORACLE["w03_knee_low_lower"] = _knee_sql(20, 10)

CLASSIC_THR = "(SELECT total_umis FROM sorted WHERE pos = 30) * 0.1"

ORACLE["w05_rank_plot_classic"] = BASE + SORTED + XT + f""",
rk AS (SELECT c.cell_id, xt.total,
              rank() OVER (ORDER BY xt.total DESC) + (count(*) OVER (PARTITION BY xt.total) - 1) / 2.0 AS rank
       FROM xt JOIN m1_cells c USING (cell_idx) WHERE xt.total > 0)
SELECT cell_id, total, rank, 'retained' AS segment FROM rk WHERE total >= {CLASSIC_THR}
UNION ALL
SELECT cell_id, total, rank, 'discarded' AS segment FROM rk WHERE total <= {CLASSIC_THR}"""

ORACLE["w06_rank_plot_unfiltered"] = BASE + XT + """
SELECT c.cell_id, xt.total,
       rank() OVER (ORDER BY xt.total DESC) + (count(*) OVER (PARTITION BY xt.total) - 1) / 2.0 AS rank,
       'all' AS segment
FROM xt JOIN m1_cells c USING (cell_idx) WHERE xt.total > 0"""

ORACLE["w08_rank_plot_summary"] = BASE + SORTED + _knee_ctes(50, 50) + f"""
SELECT 'classic' AS algorithm,
       (SELECT count(*) FROM m1_totals WHERE total_umis >= {CLASSIC_THR}) AS passing,
       (SELECT knee FROM kv) AS knee, (SELECT infl FROM kv) AS inflection,
       (SELECT max(rank) FROM r WHERE total >= (SELECT knee FROM kv)) AS knee_rank,
       (SELECT min(total) FROM r WHERE total >= (SELECT knee FROM kv)) AS knee_total,
       (SELECT max(rank) FROM r WHERE total >= (SELECT infl FROM kv)) AS inflection_rank,
       (SELECT min(total) FROM r WHERE total >= (SELECT infl FROM kv)) AS inflection_total"""

# ----------------------------------------------------------------- P
ORACLE["p01_brief"] = """
SELECT 'count' AS section, 'cells' AS name, CAST(count(*) AS VARCHAR) AS value FROM orders
UNION ALL SELECT 'count', 'genes', CAST(count(*) AS VARCHAR) FROM part
UNION ALL SELECT * FROM (VALUES ('cell annotation', 'status', 'string'), ('cell annotation', 'price', 'double'),
  ('cell annotation', 'ordered_at', 'timestamp_ntz'), ('cell annotation', 'urgent', 'boolean'),
  ('cell annotation', 'total_umis', 'double'), ('cell annotation', 'batch', 'string'),
  ('cell annotation', 'score', 'double'), ('gene annotation', 'gene_ids', 'string'),
  ('gene annotation', 'brand', 'string'), ('gene annotation', 'type', 'string'),
  ('gene annotation', 'size', 'bigint'), ('gene annotation', 'retail', 'double')) v(section, name, value)"""


def _num(col: str) -> str:
    return (f"SELECT '{col}' AS annotation, count({col}) AS count, min({col}) AS min, max({col}) AS max, "
            f"round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS sd, "
            f"round(quantile_cont({col}, 0.5), 9) AS median, "
            f"round(quantile_cont({col}, 0.25), 9) AS q1, round(quantile_cont({col}, 0.75), 9) AS q3 FROM fcells")


ORACLE["p02_numeric_summary"] = FBASE + "\n" + "\nUNION ALL ".join(
    _num(c) for c in ("price", "total_umis", "score"))


def _cat(cols: list[str], src: str) -> str:
    unp = "\nUNION ALL ".join(f"SELECT '{c}' AS annotation, CAST({c} AS VARCHAR) AS value FROM {src}" for c in cols)
    return f""",
lng AS ({unp}),
cnt AS (SELECT annotation, value, count(*) AS count FROM lng WHERE value IS NOT NULL GROUP BY annotation, value),
pc AS (SELECT annotation, CAST(sum(count) AS BIGINT) AS non_null, count(*) AS distinct FROM cnt GROUP BY annotation),
rk AS (SELECT *, row_number() OVER (PARTITION BY annotation ORDER BY count DESC, value) AS rank FROM cnt)
SELECT rk.annotation, pc.non_null, pc.distinct, rk.rank, rk.value, rk.count
FROM rk JOIN pc USING (annotation) WHERE rank <= 5"""


ORACLE["p03_categorical_summary"] = FBASE + _cat(["status", "ordered_at", "urgent", "batch"], "fcells")
ORACLE["p03b_events_summary"] = "WITH dummy AS (SELECT 1)" + _cat(["event_type", "ts"], "events")

ORACLE["p04_name_sample"] = BASE + "\nSELECT gene_idx, gene_id FROM m1_genes ORDER BY gene_idx LIMIT 5"

ORACLE["p05_array_summary"] = """
SELECT 'embedding' AS name, 'float' AS element_type, count(*) AS n_rows, max(len(embedding)) AS width
FROM embeddings"""

ORACLE["p06_matrix_line"] = BASE + """
SELECT (SELECT count(*) FROM m1_cells) AS n_cells, (SELECT count(*) FROM m1_genes) AS n_genes,
       'double' AS dtype, true AS sparse, count(*) AS nnz FROM m1_x"""

# ----------------------------------------------------------------- T
def _dna(s: str, n: int) -> str:
    return (f"substr(translate(md5({s}) || md5({s} || '*'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {n})")


def _mut(s: str, ks: list[int]) -> str:
    for k in ks:
        s = f"(substr({s}, 1, {k - 1}) || translate(substr({s}, {k}, 1), 'ACGT', 'CGTA') || substr({s}, {k + 1}))"
    return s


R1 = f"""
WITH lib14 AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, 'a' || CAST(n_nationkey AS VARCHAR) AS tag_id,
                      {_dna("'a' || CAST(n_nationkey AS VARCHAR)", 14)} AS seq FROM nation WHERE n_nationkey < 5),
lib30 AS (SELECT CAST(n_nationkey AS BIGINT) AS pos, 'b' || CAST(n_nationkey AS VARCHAR) AS tag_id,
                 {_dna("'b' || CAST(n_nationkey AS VARCHAR)", 30)} AS seq FROM nation),
ev AS (SELECT event_id, user_id, user_id % 5 AS p14,
              CASE WHEN user_id % 4 = 0 AND event_id % 10 = 1 THEN (user_id + 1) % 25 ELSE user_id % 25 END AS p30
       FROM events),
reads AS (
  SELECT ev.event_id AS read_no,
         {_dna("'cell' || CAST(ev.user_id AS VARCHAR)", 16)} || {_dna("'umi' || CAST(ev.event_id AS VARCHAR)", 10)}
           || CASE WHEN ev.event_id % 13 = 0 THEN 'TTGTTTTTTT' ELSE 'TTTTTTTTTT' END AS r1,
         CASE WHEN ev.event_id % 7 = 0 THEN {_mut("l14.seq", [3])} ELSE l14.seq END
           || CASE WHEN ev.event_id % 17 = 0 THEN 'TCGT' ELSE 'TGGT' END
           || CASE WHEN ev.event_id % 11 = 0 THEN {_mut("l30.seq", [2, 9, 20])}
                   WHEN ev.event_id % 5 = 0 THEN {_mut("l30.seq", [4, 17])} ELSE l30.seq END AS r2
  FROM ev JOIN lib14 l14 ON l14.pos = ev.p14 JOIN lib30 l30 ON l30.pos = ev.p30),
cells AS (SELECT DISTINCT user_id AS cell_idx, {_dna("'cell' || CAST(user_id AS VARCHAR)", 16)} || '-1' AS cell_id
          FROM events),
p1 AS (SELECT read_no, substr(r1, 1, 16) AS cell, substr(r1, 17, 10) AS umi, r2 FROM reads
       WHERE substr(r1, 27, 4) = 'TTTT'),
pairs AS (SELECT read_no, cell, umi, substr(r2, 1, 14) AS bc14, substr(r2, 19, 30) AS bc30 FROM p1
          WHERE substr(r2, 15, 4) = 'TGGT'),
wl AS (SELECT DISTINCT regexp_replace(cell_id, '-[^-]*$', '') AS cell FROM cells),
wpairs AS (SELECT * FROM pairs WHERE cell IN (SELECT cell FROM wl)),
m14 AS (SELECT s.seq, (SELECT l.tag_id FROM lib14 l WHERE length(l.seq) = length(s.seq)
                        AND hamming(l.seq, s.seq) < 3 ORDER BY hamming(l.seq, s.seq) > 0, l.pos LIMIT 1) AS tag_id
        FROM (SELECT DISTINCT bc14 AS seq FROM pairs) s),
m30 AS (SELECT s.seq, (SELECT l.tag_id FROM lib30 l WHERE length(l.seq) = length(s.seq)
                        AND hamming(l.seq, s.seq) < 3 ORDER BY hamming(l.seq, s.seq) > 0, l.pos LIMIT 1) AS tag_id
        FROM (SELECT DISTINCT bc30 AS seq FROM pairs) s),
counts AS (SELECT w.cell, m14.tag_id || ':' || m30.tag_id AS tag, count(*) AS n_reads
           FROM wpairs w JOIN m14 ON m14.seq = w.bc14 JOIN m30 ON m30.seq = w.bc30
           WHERE m14.tag_id IS NOT NULL AND m30.tag_id IS NOT NULL GROUP BY ALL),
calls AS (SELECT cell, count(*) AS n_tags, max(tag) AS tag FROM counts WHERE n_reads > 1 GROUP BY cell)"""

ORACLE["t01_parse_r1"] = R1 + "\nSELECT read_no, substr(r1, 1, 16) AS cell, substr(r1, 17, 10) AS umi FROM reads WHERE substr(r1, 27, 4) = 'TTTT'"
ORACLE["t02_parse_r2"] = R1 + "\nSELECT read_no, substr(r2, 1, 14) AS bc14, substr(r2, 19, 30) AS bc30 FROM reads WHERE substr(r2, 15, 4) = 'TGGT'"
ORACLE["t03_pair_filter"] = R1 + "\nSELECT read_no, cell, umi, bc14, bc30 FROM pairs"
ORACLE["j08_whitelist"] = R1 + """,
busy AS (SELECT user_id FROM events GROUP BY user_id
         HAVING count(*) > (SELECT count(*) * 1.0 / count(DISTINCT user_id) FROM events))
SELECT read_no, cell FROM pairs
WHERE cell IN (SELECT regexp_replace(cell_id, '-[^-]*$', '') FROM cells WHERE cell_idx IN (SELECT user_id FROM busy))"""
ORACLE["t04_exact_match"] = R1 + "\nSELECT DISTINCT p.bc14 AS seq, l.tag_id FROM pairs p JOIN lib14 l ON l.seq = p.bc14"
ORACLE["t05_corrected_match"] = R1 + """
SELECT seq, tag_id, seq IN (SELECT seq FROM lib14) AS exact, 14 AS lib FROM m14 WHERE tag_id IS NOT NULL
UNION ALL
SELECT seq, tag_id, seq IN (SELECT seq FROM lib30) AS exact, 30 AS lib FROM m30 WHERE tag_id IS NOT NULL"""
ORACLE["t06_kmer_nearest"] = R1 + """,
obs AS (SELECT DISTINCT bc30 AS seq FROM pairs),
ko AS (SELECT seq, substr(seq, i, 3) AS kmer, count(*) AS c FROM obs, range(1, 29) t(i)
       WHERE regexp_full_match(substr(seq, i, 3), '[ACGT]{3}') GROUP BY ALL),
kl AS (SELECT pos, tag_id, substr(seq, i, 3) AS kmer, count(*) AS c FROM lib30, range(1, 29) t(i)
       WHERE regexp_full_match(substr(seq, i, 3), '[ACGT]{3}') GROUP BY ALL),
no AS (SELECT seq, sqrt(sum(c * c)) AS n FROM ko GROUP BY seq),
nl AS (SELECT pos, sqrt(sum(c * c)) AS n FROM kl GROUP BY pos),
sims AS (SELECT ko.seq, kl.pos, kl.tag_id, 1 - sum(ko.c * kl.c) / (min(no.n) * min(nl.n)) AS distance
         FROM ko JOIN kl USING (kmer) JOIN no ON no.seq = ko.seq JOIN nl ON nl.pos = kl.pos GROUP BY ko.seq, kl.pos, kl.tag_id)
SELECT seq, arg_min(tag_id, (distance, pos)) AS tag_id, round(min(distance), 9) AS distance FROM sims GROUP BY seq"""
ORACLE["t07_tag_counts"] = R1 + "\nSELECT cell, tag, n_reads FROM counts"
ORACLE["t08_confident"] = R1 + "\nSELECT cell, tag, n_reads FROM counts WHERE n_reads > 1"
ORACLE["t09_assign"] = R1 + """
SELECT c.cell_id, coalesce(k.n_tags > 1, false) AS doublet,
       coalesce(CASE WHEN k.n_tags = 1 THEN k.tag END, '') AS tags
FROM cells c LEFT JOIN calls k ON k.cell || '-1' = c.cell_id"""
ORACLE["s07_fastq_files_to_tags"] = ORACLE["t09_assign"]
ORACLE["s07b_fastq_blocked_lanes"] = ORACLE["t09_assign"]
ORACLE["s06_value_file"] = ORACLE["f11_in_list"]
ORACLE["t10_tag_summary"] = R1 + """
SELECT count(*) FILTER (WHERE n_tags = 1) AS assigned, count(*) FILTER (WHERE n_tags > 1) AS doublets FROM calls"""

# ----------------------------------------------------------------- E
AMB = XT + """,
amb AS (SELECT x.gene_idx, sum(x.value) AS s FROM m1_x x JOIN xt USING (cell_idx) WHERE xt.total <= 50 GROUP BY 1),
prof AS (SELECT g.gene_idx, coalesce(a.s, 0.0) AS count FROM (SELECT DISTINCT gene_idx FROM m1_x) g
         LEFT JOIN amb a USING (gene_idx))"""

ORACLE["e01_ambient_set"] = BASE + XT + "\nSELECT c.cell_id, xt.total FROM xt JOIN m1_cells c USING (cell_idx) WHERE xt.total <= 100"
ORACLE["e02_ambient_profile"] = BASE + AMB + "\nSELECT gene_idx, count FROM prof"

GT = AMB + """,
ff AS (SELECT count AS r, count(*)::DOUBLE AS n FROM prof WHERE count > 0 GROUP BY 1),
ffo AS (SELECT r, n, row_number() OVER (ORDER BY r) AS i,
               coalesce(lag(r) OVER (ORDER BY r), 0) AS q, lead(r) OVER (ORDER BY r) AS t,
               lead(n) OVER (ORDER BY r) AS n_next FROM ff),
z AS (SELECT *, ln(2 * n / (coalesce(t, 2 * r - q) - q)) AS lz, ln(r) AS lr FROM ffo),
fit AS (SELECT regr_slope(lz, lr) AS b FROM z),
est AS (SELECT i, r, n, (r + 1) * pow((r + 1) / r, (SELECT b FROM fit)) AS y,
               CASE WHEN t = r + 1 THEN (r + 1) * n_next / n END AS x,
               CASE WHEN t = r + 1 THEN sqrt(pow(r + 1, 2) * n_next / pow(n, 2) * (1 + n_next / n)) END AS sd
        FROM z),
sw AS (SELECT min(i) AS s FROM est WHERE x IS NULL OR abs(x - y) <= 1.96 * sd),
rs AS (SELECT r, n, CASE WHEN i < coalesce((SELECT s FROM sw), 1e18) THEN x ELSE y END AS rstar FROM est),
cst AS (SELECT (SELECT sum(r * n) FROM ff) AS big_n, coalesce((SELECT n FROM ff WHERE r = 1), 0) AS n1,
               (SELECT sum(n * rstar) FROM rs) AS norm, (SELECT count(*) FROM prof WHERE count = 0) AS n0),
gt AS (SELECT p.gene_idx, p.count,
              CASE WHEN p.count = 0 THEN (cst.n1 / cst.big_n) / cst.n0
                   ELSE (1 - cst.n1 / cst.big_n) * rs.rstar / cst.norm END AS prop
       FROM prof p CROSS JOIN cst LEFT JOIN rs ON rs.r = p.count)"""

ORACLE["e03_good_turing"] = BASE + GT + "\nSELECT gene_idx, count, round(prop * 1e6, 6) AS prop_ppm FROM gt"


def _ll_sql(alpha: str) -> str:
    if alpha == "inf":
        term, const = "x.value * ln(gt.prop) - lgamma(x.value + 1)", "lgamma(total + 1)"
    else:
        a = alpha
        term = f"lgamma(x.value + {a} * gt.prop) - lgamma(x.value + 1) - lgamma({a} * gt.prop)"
        const = f"lgamma(total + 1) + lgamma({a}) - lgamma(total + {a})"
    return BASE + GT + f""",
pc AS (SELECT x.cell_idx, sum({term}) AS s, sum(x.value) AS total
       FROM m1_x x JOIN gt USING (gene_idx) WHERE x.cell_idx IN (SELECT cell_idx FROM xt WHERE total > 50)
       GROUP BY x.cell_idx)
SELECT cell_idx, total, round({const} + s, 4) AS loglik FROM pc"""


ORACLE["e05_loglik_multinomial"] = _ll_sql("inf")
ORACLE["e05b_loglik_dirichlet"] = _ll_sql("25.0")

def _alpha_ctes(grid: int = 24, steps: int = 8) -> str:
    """Concentration: the best of a grid by the log-gamma likelihood, then Newton
    steps in its logarithm on draw-by-draw sums (one CTE a step)."""
    sql = f""",
ent AS (SELECT x.value, gt.prop, count(*) AS n FROM m1_x x JOIN gt USING (gene_idx)
        WHERE x.cell_idx IN (SELECT cell_idx FROM xt WHERE total <= 50) GROUP BY 1, 2),
tt AS (SELECT total, count(*) AS n FROM xt WHERE total <= 50 GROUP BY 1),
ga AS (SELECT exp(ln(0.01) + (ln(10000.0) - ln(0.01)) * k / {grid - 1}.0) AS a FROM range(0, {grid}) AS t(k)),
ge AS (SELECT a, sum(n * (lgamma(value + a * prop) - lgamma(a * prop))) AS s FROM ga, ent GROUP BY a),
gc AS (SELECT a, sum(n * lgamma(total + a)) AS s FROM ga, tt GROUP BY a),
al0 AS (SELECT arg_max(ga.a, (SELECT sum(n) FROM tt) * lgamma(ga.a) - gc.s + ge.s) AS a FROM ga JOIN ge USING (a) JOIN gc USING (a)),
tails AS (SELECT prop AS p, j, n::DOUBLE AS w FROM ent, range(0, 51) AS r(j) WHERE j < value
          UNION ALL SELECT 1.0, j, -n::DOUBLE FROM tt, range(0, 51) AS r(j) WHERE j < total)"""
    for k in range(1, steps + 1):
        sql += f""",
dv{k} AS (SELECT a, sum(w * p / (a * p + j)) AS d1, -sum(w * p * p / pow(a * p + j, 2)) AS d2 FROM al{k - 1}, tails GROUP BY a),
al{k} AS (SELECT least(greatest(CASE WHEN a * d1 + a * a * d2 < 0 THEN a * exp(-(a * d1) / (a * d1 + a * a * d2))
                 WHEN d1 > 0 THEN a * 2 ELSE a / 2 END, 0.01), 10000.0) AS a FROM dv{k})"""
    return sql + f""",
alpha AS (SELECT round(a, 6) AS a FROM al{steps})"""


ORACLE["e04_alpha_mle"] = BASE + GT + _alpha_ctes() + "\nSELECT (SELECT count(*) FROM gt) AS n_genes, a AS alpha FROM alpha"


def _mixed(x: str, step: str, source: str) -> str:
    """CTEs that hash the 32-bit integer ``x`` of ``source`` into ``h`` (table ``step``)."""
    return f""",
{step}a AS (SELECT *, xor({x}, ({x}) >> 16) AS h1 FROM {source}),
{step}b AS (SELECT * EXCLUDE (h1), (h1 * 2146121005) % 4294967296 AS h2 FROM {step}a),
{step}c AS (SELECT * EXCLUDE (h2), xor(h2, h2 >> 15) AS h3 FROM {step}b),
{step}d AS (SELECT * EXCLUDE (h3), CAST((h3::HUGEINT * 2221713035) % 4294967296 AS BIGINT) AS h4 FROM {step}c),
{step} AS (SELECT * EXCLUDE (h4), xor(h4, h4 >> 16) AS h FROM {step}d)"""


def _mc_sql(tested: str, iters: int = 40, seed: int = 1, alpha: str | None = None, profile: str = GT) -> str:
    """E6 draw by draw: uniforms from the integer hash, genes by the cumulative
    proportions, the likelihood along each path, counted against each barcode.
    With ``alpha`` draw ``j`` repeats an earlier one with probability (j - 1) / (j - 1 + alpha)."""
    sql = (BASE + profile).replace("WITH", "WITH RECURSIVE", 1) + f""",
sd AS (SELECT {seed}::BIGINT AS seed)""" + _mixed("seed", "k0", "sd") + f""",
it AS (SELECT (h + i) % 4294967296 AS x0, i FROM k0, range(0, {iters}) AS r(i))""" + _mixed("x0", "k1", "it") + f""",
tst AS (SELECT cell_idx, total FROM xt WHERE {tested})"""

    def stream(name: str, turn: int) -> str:
        return f""",
{name}st AS (SELECT i, h AS start, (h + {turn}) % 4294967296 AS x1 FROM k1)""" + _mixed("x1", f"{name}2", f"{name}st") + f""",
{name}dr AS (SELECT i, j, h AS turn, (start + j) % 4294967296 AS x2 FROM {name}2, range(1, (SELECT max(total)::BIGINT + 1 FROM tst)) AS r(j))""" \
            + _mixed("x2", f"{name}3", f"{name}dr") + f""",
{name}tw AS (SELECT i, j, xor(h, turn) AS x3 FROM {name}3)""" + _mixed("x3", f"{name}4", f"{name}tw") + f""",
{name} AS (SELECT i, j, (h + 0.5) / 4294967296.0 AS u FROM {name}4)"""

    sql += stream("ua", 2654435769) + """,
cum AS (SELECT gene_idx, prop, coalesce(sum(prop) OVER (ORDER BY gene_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
               / (SELECT sum(prop) FROM gt) AS since FROM gt),
fr AS (SELECT ua.i, ua.j, cum.gene_idx, cum.prop FROM ua ASOF JOIN cum ON ua.u > cum.since)"""
    if alpha is None:
        return sql + f""",
inc AS (SELECT i, j, ln(j) - ln(row_number() OVER (PARTITION BY i, gene_idx ORDER BY j)) + ln(prop) AS d FROM fr),
path AS (SELECT i, j AS total, round(sum(d) OVER (PARTITION BY i ORDER BY j), 6) AS sim FROM inc),
pc AS (SELECT x.cell_idx, sum(x.value * ln(gt.prop) - lgamma(x.value + 1)) AS s, sum(x.value) AS total
       FROM m1_x x JOIN gt USING (gene_idx) WHERE x.cell_idx IN (SELECT cell_idx FROM tst) GROUP BY x.cell_idx),
lls AS (SELECT cell_idx, total, lgamma(total + 1) + s AS loglik FROM pc)""" + _below_sql(iters)
    return sql + stream("ub", 2246822507) + f""",
va AS (SELECT i, j, u * (j - 1 + {alpha}) AS v FROM ub),
pa AS (SELECT i, j, CASE WHEN v < j - 1 THEN floor(v)::BIGINT + 1 ELSE j END AS p FROM va),
rt AS (SELECT i, j, p FROM pa UNION ALL SELECT rt.i, rt.j, pa.p FROM rt JOIN pa ON pa.i = rt.i AND pa.j = rt.p WHERE pa.p < rt.p),
ro AS (SELECT i, j, min(p) AS p FROM rt GROUP BY i, j),
dw AS (SELECT ro.i, ro.j, fr.gene_idx, fr.prop FROM ro JOIN fr ON fr.i = ro.i AND fr.j = ro.p),
nb AS (SELECT *, row_number() OVER (PARTITION BY i, gene_idx ORDER BY j) - 1 AS before FROM dw),
inc AS (SELECT i, j, ln(j) - ln(j - 1 + {alpha}) + ln(before + {alpha} * prop) - ln(before + 1) AS d FROM nb),
path AS (SELECT i, j AS total, round(sum(d) OVER (PARTITION BY i ORDER BY j), 6) AS sim FROM inc),
pc AS (SELECT x.cell_idx, sum(lgamma(x.value + {alpha} * gt.prop) - lgamma(x.value + 1) - lgamma({alpha} * gt.prop)) AS s, sum(x.value) AS total
       FROM m1_x x JOIN gt USING (gene_idx) WHERE x.cell_idx IN (SELECT cell_idx FROM tst) GROUP BY x.cell_idx),
lls AS (SELECT cell_idx, total, lgamma(total + 1) + lgamma({alpha}) - lgamma(total + {alpha}) + s AS loglik FROM pc)""" + _below_sql(iters)


def _below_sql(iters: int) -> str:
    return f""",
mc AS (SELECT l.cell_idx, l.total, l.loglik,
              (1 + (SELECT count(*) FROM path p WHERE p.total = l.total AND p.sim <= round(l.loglik, 6))) / ({iters} + 1.0) AS pvalue FROM lls l)"""


def _fdr_sql(retain: str) -> str:
    """Benjamini-Hochberg over ``mc`` and the barcodes at or above ``retain`` (p = 0)."""
    return f""",
pv AS (SELECT cell_idx, pvalue FROM mc UNION ALL SELECT cell_idx, 0.0 FROM xt WHERE total >= {retain}),
rk AS (SELECT pvalue, count(*) OVER (ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM pv),
q AS (SELECT DISTINCT pvalue, least(1.0, min(pvalue * (SELECT count(*) FROM pv) / r) OVER (ORDER BY pvalue DESC)) AS fdr FROM rk)"""


ORACLE["e06b_monte_carlo_few"] = _mc_sql("total > 50") + """
SELECT cell_idx, total, round(loglik, 4) AS loglik, round(pvalue, 9) AS pvalue FROM mc"""
ORACLE["e12b_ambient_pvalues_few"] = _mc_sql("total > 0 AND total <= 50") + """
SELECT cell_idx, total, round(pvalue, 9) AS pvalue FROM mc"""
CALLED = """
SELECT c.cell_id, round(q.fdr, 9) AS emptydrops_fdr
FROM pv JOIN q USING (pvalue) JOIN m1_cells c USING (cell_idx) WHERE q.fdr <= 0.2"""
ORACLE["e09b_emptydrops_few"] = _mc_sql("total > 50 AND total < 150") + _fdr_sql("150") + CALLED
ORACLE["e06c_monte_carlo_dirichlet_few"] = _mc_sql("total > 50", alpha="25.0") + """
SELECT cell_idx, total, round(loglik, 4) AS loglik, round(pvalue, 9) AS pvalue FROM mc"""
ORACLE["e09c_emptydrops_default_few"] = _mc_sql("total > 50 AND total < 150", alpha="(SELECT a FROM alpha)", profile=GT + _alpha_ctes()) \
    + _fdr_sql("150") + CALLED

# Thresholds from the 30th and the 45 000th total; a profile of few distinct counts gets add-one smoothing
_CR = SORTED + """,
crt AS (SELECT (SELECT total_umis FROM sorted WHERE pos = 30) * 0.1 AS retain,
               CASE WHEN (SELECT count(*) FROM sorted) >= 45000 THEN (SELECT total_umis FROM sorted WHERE pos = 44999) ELSE 1.0 END AS lower)"""
_CR_GT = _CR + GT.replace("xt.total <= 50", "xt.total <= (SELECT lower FROM crt)").replace("gt AS (", "smooth AS (") + """,
gt AS (SELECT gene_idx, count, CASE WHEN (SELECT count(*) FROM ff) < 5
              THEN (count + 1) / (SELECT sum(count) + count(*) FROM prof)
              WHEN count = 0 AND (SELECT n1 FROM cst) = 0 THEN (1 / (SELECT big_n FROM cst)) / (SELECT n0 FROM cst)
              WHEN (SELECT n1 FROM cst) = 0 AND (SELECT n0 FROM cst) > 0 THEN prop * (1 - 1 / (SELECT big_n FROM cst)) ELSE prop END AS prop FROM smooth)"""
ORACLE["e10b_cellranger_few"] = _mc_sql("total > (SELECT lower FROM crt) AND total < (SELECT retain FROM crt)", profile=_CR_GT) \
    + _fdr_sql("(SELECT retain FROM crt)") + """
SELECT c.cell_id, c.total_umis, round(q.fdr, 9) AS emptydrops_fdr
FROM m1_totals c LEFT JOIN pv USING (cell_idx) LEFT JOIN q USING (pvalue)"""

ORACLE["e08_bh_adjust"] = """
WITH p AS (SELECT o_orderkey AS cell_idx,
                  CASE WHEN o_orderstatus = 'P' THEN NULL
                       ELSE round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 3) END AS pvalue
           FROM orders),
m AS (SELECT count(*) AS m FROM p WHERE pvalue IS NOT NULL),
rk AS (SELECT pvalue, count(*) OVER (ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
       FROM p WHERE pvalue IS NOT NULL),
d AS (SELECT DISTINCT pvalue, r FROM rk),
q AS (SELECT pvalue, least(1.0, min(pvalue * (SELECT m FROM m) / r) OVER (ORDER BY pvalue DESC)) AS fdr FROM d)
SELECT p.cell_idx, p.pvalue, round(q.fdr, 9) AS fdr FROM p LEFT JOIN q USING (pvalue)"""

# ----------------------------------------------------------------- D
PP = """
WITH pp AS (SELECT o_orderkey AS cell_idx, 'C' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '-1' AS cell_id,
                   o_totalprice / (SELECT max(o_totalprice) FROM orders) AS pvalue FROM orders),
smp AS (SELECT cell_id, pvalue FROM pp ORDER BY md5('7' || cell_id), cell_id LIMIT 100)"""

ORACLE["d01_sample"] = PP + "\nSELECT cell_id, pvalue FROM smp"
ORACLE["d02_ks_uniform"] = PP + """,
o AS (SELECT pvalue, row_number() OVER (ORDER BY pvalue, md5(CAST(pvalue AS VARCHAR))) AS i FROM smp),
d AS (SELECT max(greatest(i / 100.0 - pvalue, pvalue - (i - 1) / 100.0)) AS d FROM o),
lam AS (SELECT (sqrt(100) + 0.12 + 0.11 / sqrt(100)) * d AS l, d FROM d),
ks AS (SELECT least(1.0, greatest(0.0, 2 * sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * l * l))))
         AS p FROM lam, range(1, 101) t(j))
SELECT CAST(100 AS BIGINT) AS n, round((SELECT d FROM d), 9) AS d, round(p, 9) AS ks_pvalue, p >= 0.05 AS suitable FROM ks"""



def _dispersion_sql(alpha: str | None) -> str:
    return _mc_sql("total > 0 AND total <= 50", seed=3, alpha=alpha) + """,
amp AS (SELECT c.cell_id, mc.pvalue FROM mc JOIN m1_cells c USING (cell_idx)),
smp AS (SELECT cell_id, pvalue FROM amp ORDER BY md5('3' || cell_id), cell_id LIMIT 100),
o AS (SELECT pvalue, row_number() OVER (ORDER BY pvalue) AS i FROM smp),
d AS (SELECT max(greatest(i / 100.0 - pvalue, pvalue - (i - 1) / 100.0)) AS d FROM o),
lam AS (SELECT (sqrt(100) + 0.12 + 0.11 / sqrt(100)) * d AS l, d FROM d),
ks AS (SELECT least(1.0, greatest(0.0, 2 * sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * l * l))))
         AS p FROM lam, range(1, 101) t(j))
SELECT CAST(100 AS BIGINT) AS n, round((SELECT d FROM d), 9) AS d, round(p, 9) AS ks_pvalue, p >= 0.05 AS suitable,
       (SELECT count(*) FROM amp) AS n_ambient FROM ks"""


ORACLE["d05b_dispersion_few"] = _dispersion_sql(None)
ORACLE["d05c_dispersion_dirichlet_few"] = _dispersion_sql("40.0")

PPALL = PP + """,
n AS (SELECT count(*) AS n FROM pp),
t AS (SELECT row_number() OVER (ORDER BY pvalue, cell_idx) AS i, pvalue AS ordered FROM pp),
t2 AS (SELECT i, CASE WHEN i = 1 THEN 1 - pow(0.5, 1.0 / (SELECT n FROM n))
                      WHEN i = (SELECT n FROM n) THEN pow(0.5, 1.0 / (SELECT n FROM n))
                      ELSE (i - 0.3175) / ((SELECT n FROM n) + 0.365) END AS theoretical, ordered FROM t)"""
ORACLE["d04_probplot"] = PPALL + """
SELECT round(regr_slope(ordered, theoretical), 9) AS slope, round(regr_intercept(ordered, theoretical), 9) AS intercept,
       round(corr(ordered, theoretical), 9) AS r FROM t2"""
ORACLE["d04b_probplot_points"] = PPALL + "\nSELECT i, round(theoretical, 12) AS theoretical, ordered FROM t2"

# ----------------------------------------------------------------- S / K
ORACLE["k02_mex_roundtrip_cells"] = BASE + "\nSELECT cell_id, total_umis AS total FROM m1_totals"
ORACLE["k02b_mex_roundtrip_genes"] = BASE + """
SELECT g.gene_id, g.gene_ids, 'Gene Expression' AS feature_types, t.umis
FROM m1_genes g LEFT JOIN (SELECT gene_idx, sum(value) AS umis FROM m1_x GROUP BY gene_idx) t USING (gene_idx)"""
ORACLE["k03_cell_table_roundtrip"] = FBASE + """
SELECT cell_id AS barcode, status, price, CAST(ordered_at AS VARCHAR) AS ordered_at, urgent, total_umis, batch, score FROM fcells"""
ORACLE["k04_gene_table"] = BASE + "\nSELECT gene_id AS gene, gene_ids, brand, type, size, retail FROM m1_genes"
ORACLE["s04_native_roundtrip"] = FBASE + """
SELECT cell_idx, cell_id, status, price, CAST(ordered_at AS VARCHAR) AS ordered_at, urgent, total_umis, batch, score, total_umis AS total
FROM fcells"""
ORACLE["s04b_native_genes_layers_params"] = BASE + """
SELECT g.*, t.umis, 2 * t.umis AS twice, 12.5 AS threshold
FROM m1_genes g LEFT JOIN (SELECT gene_idx, sum(value) AS umis FROM m1_x GROUP BY gene_idx) t USING (gene_idx)"""
ORACLE["a01b_total_umis_saved"] = ORACLE["a01_total_umis"]
ORACLE["p07_history_after_saves"] = BASE + """,
kept AS (SELECT * FROM m1_totals WHERE status <> 'P'),
pos AS (SELECT total_umis, row_number() OVER (ORDER BY total_umis DESC) - 1 AS pos FROM kept),
thr AS (SELECT total_umis * 0.1 AS t FROM pos WHERE pos = 30),
n AS (SELECT (SELECT count(*) FROM m1_cells) AS cells, (SELECT count(*) FROM kept) AS kept,
             (SELECT count(*) FROM kept WHERE total_umis >= (SELECT t FROM thr)) AS called,
             (SELECT count(*) FROM m1_genes) AS genes, (SELECT count(*) FROM m1_genes WHERE size < 25) AS small)
SELECT 'history' AS kind, CAST(0 AS BIGINT) AS seq,
       format('Selection ''size < 25'' on genes: {} of {} stay, {} go', small, genes, genes - small) AS text, CAST(NULL AS DOUBLE) AS value FROM n
UNION ALL SELECT 'history', 1, format('Selection ''total_umis >= {}'' on cells: {} of {} stay, {} go', CAST((SELECT t FROM thr) AS VARCHAR),
                                     called, kept, kept - called), NULL FROM n
UNION ALL SELECT 'history', 2, format('Barcodes with at least {:g} counts are called cells', (SELECT t FROM thr)), NULL
UNION ALL SELECT 'history', 3, format('Selection ''status != "P"'' on cells: {} of {} stay, {} go', kept, cells, cells - kept), NULL FROM n
UNION ALL SELECT 'parameter', 0, 'classic_filter.' || k, v
    FROM (VALUES ('expect_cells', 3000.0), ('upper_quant', 0.99), ('lower_prop', 0.1), ('threshold', (SELECT t FROM thr))) AS p(k, v)
UNION ALL SELECT 'snapshot', number, slot, rows FROM (
    SELECT 1 AS number, 'cells' AS slot, kept AS rows FROM n UNION ALL SELECT 2, 'cells', called FROM n UNION ALL SELECT 3, 'cells', called FROM n
    UNION ALL SELECT 1, 'genes', genes FROM n UNION ALL SELECT 2, 'genes', genes FROM n UNION ALL SELECT 3, 'genes', small FROM n)"""
ORACLE["s01_mtx_read"] = BASE + """
,
idx AS (SELECT unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS cell_idx),
per AS (SELECT cell_idx, sum(value) AS total, count(*) AS nnz FROM m1_x GROUP BY cell_idx)
SELECT cell_idx, coalesce(total, 0.0) AS total, coalesce(nnz, 0) AS nnz FROM idx LEFT JOIN per USING (cell_idx)"""

ORACLE["k05_wide_matrix"] = BASE + """,
b AS (SELECT DISTINCT p_brand AS brand FROM part),
v AS (SELECT l.l_orderkey AS cell_idx, p.p_brand AS brand, sum(l.l_quantity) AS value
      FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY ALL),
full_grid AS (SELECT c.cell_idx, c.cell_id AS barcode, b.brand, coalesce(v.value, 0.0) AS value
              FROM m1_cells c CROSS JOIN b LEFT JOIN v ON v.cell_idx = c.cell_idx AND v.brand = b.brand)
SELECT * EXCLUDE (cell_idx) FROM (PIVOT full_grid ON brand IN (""" + ", ".join(
    f"'Brand#{i}'" for i in range(1, 26)) + """) USING sum(value) GROUP BY cell_idx, barcode)"""

ORACLE["w04_rank_plot_emptydrops"] = BASE + _knee_ctes(50, 50) + """,
rk AS (SELECT c.cell_id, xt.total,
              rank() OVER (ORDER BY xt.total DESC) + (count(*) OVER (PARTITION BY xt.total) - 1) / 2.0 AS rank
       FROM xt JOIN m1_cells c USING (cell_idx) WHERE xt.total > 0)
SELECT cell_id, total, rank, 'retained' AS segment FROM rk WHERE total >= (SELECT knee FROM kv)
UNION ALL
SELECT cell_id, total, rank, 'middle' FROM rk WHERE total <= (SELECT knee FROM kv) AND total >= 50
UNION ALL
SELECT cell_id, total, rank, 'ambient' FROM rk WHERE total <= 50"""

ORACLE["w04b_rank_plot_after_call"] = ORACLE["w04_rank_plot_emptydrops"]

ORACLE["s03_bustools_read"] = BASE + "\nSELECT cell_id, status, total_umis AS total FROM m1_totals"
