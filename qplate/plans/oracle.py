"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark plans, in the row-wise style of the
original analysis: window averages over rows, a self-join over "the other
rows" for leave-one-out, ``row_number`` for representatives.  P-values use the
incomplete-beta continued fraction (modified Lentz) in a recursive CTE.
"""

from __future__ import annotations

from qplate.plans.compare import sql_round_abs as ra
from qplate.plans.compare import sql_round_sig as rs

TOL = 2.0
K = 2.5
THRESH = 35.0

WELLS = """
wells AS (
  SELECT 'plate_' || CAST(event_id // 384 AS VARCHAR) AS file_name,
         chr(CAST(65 + (event_id % 384) // 24 AS INTEGER)) || CAST((event_id % 384) % 24 + 1 AS VARCHAR) AS Pos,
         event_id AS well_ord,
         CAST(user_id AS VARCHAR) || '.' || CAST(event_id % 4 AS VARCHAR) AS replicate_name,
         CAST(user_id AS VARCHAR) AS sample_name,
         CAST(user_id % 5 AS VARCHAR) AS zscoring_group,
         CASE WHEN (user_id // 5) % 2 = 0 THEN 'control' ELSE 'treated' END AS testing_group,
         event_type AS Gene,
         CASE WHEN event_type IN ('view') THEN 'HK' ELSE 'Normal' END AS type_of_gene,
         CASE WHEN value < 1 THEN NULL ELSE CAST(20 AS DOUBLE) + value / 20 END AS Cp
  FROM events)"""

FAILED = f"""
failed AS (SELECT DISTINCT replicate_name FROM wells WHERE type_of_gene = 'HK' AND Cp >= {THRESH})"""

PREP = f"""
prep AS (
  SELECT file_name, Pos, well_ord, replicate_name, sample_name, zscoring_group, testing_group, Gene, type_of_gene,
         coalesce(Cp, CAST({THRESH} AS DOUBLE)) AS Cp, 'good' AS good_replicate
  FROM wells w
  WHERE replicate_name IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.replicate_name = w.replicate_name))"""

def qc_ctes(src: str = "prep", sfx: str = "") -> str:
    """Technical QC over ``src`` wells: pairs{sfx}, qc0{sfx}, qc1{sfx}, qc{sfx}."""
    return f"""
pairs{sfx} AS (
  SELECT a.file_name, a.Pos, count(*) - 1 AS valid_counter
  FROM {src} a JOIN {src} b
    ON a.replicate_name = b.replicate_name AND a.Gene IS NOT DISTINCT FROM b.Gene AND abs(b.Cp - a.Cp) <= {TOL}
  GROUP BY a.file_name, a.Pos),
qc0{sfx} AS (
  SELECT p.*, c.valid_counter, count(*) OVER (PARTITION BY p.replicate_name, p.Gene) AS n_of_samples
  FROM {src} p JOIN pairs{sfx} c USING (file_name, Pos)),
qc1{sfx} AS (
  SELECT *, CASE WHEN bool_and(valid_counter = n_of_samples - 1) OVER g THEN 'all_good'
                 WHEN bool_and(valid_counter = 0) OVER g THEN 'all_bad' ELSE 'mixed' END AS group_type
  FROM qc0{sfx} WINDOW g AS (PARTITION BY replicate_name, Gene)),
qc{sfx} AS (
  SELECT *, CASE WHEN group_type IN ('all_good', 'all_bad') OR valid_counter >= n_of_samples - 2
                 THEN 'keep' ELSE 'NO keep' END AS keep_this_value
  FROM qc1{sfx})"""


QC = qc_ctes()

EXPR = """
ev AS (
  SELECT *, power(0.5, Cp) AS elevated_value,
         avg(CASE WHEN keep_this_value = 'keep' THEN power(0.5, Cp) END)
           OVER (PARTITION BY replicate_name, Gene) AS evm_all,
         well_ord = min(well_ord) OVER (PARTITION BY replicate_name, Gene) AS is_first
  FROM qc),
hkg AS (
  SELECT replicate_name, Gene, count(*) FILTER (WHERE keep_this_value = 'keep') AS nk, max(evm_all) AS evm
  FROM ev WHERE type_of_gene = 'HK' GROUP BY replicate_name, Gene),
hkr AS (
  SELECT replicate_name, CASE WHEN min(evm) = max(evm) THEN min(evm) ELSE sum(nk * evm) / sum(nk) END AS hk
  FROM hkg WHERE nk > 0 GROUP BY replicate_name),
nx AS (
  SELECT ev.*, evm_all / hkr.hk AS norm_all
  FROM ev LEFT JOIN hkr USING (replicate_name))"""

BIO = f"""
bio AS (
  SELECT file_name, Pos, well_ord, replicate_name, sample_name, zscoring_group, testing_group, Gene, type_of_gene,
         evm_all AS elevated_value_mean, norm_all AS normalized_expression,
         CASE WHEN norm_all > 0 THEN log2(norm_all) END AS log2_expression_value
  FROM nx WHERE is_first AND evm_all IS NOT NULL),
loo AS (
  SELECT a.file_name, a.Pos, count(b.Pos) AS others_rows,
         avg(b.normalized_expression) AS mo, stddev_samp(b.normalized_expression) AS so
  FROM bio a LEFT JOIN bio b
    ON a.sample_name = b.sample_name AND a.Gene IS NOT DISTINCT FROM b.Gene
   AND NOT (a.file_name = b.file_name AND a.Pos = b.Pos)
  GROUP BY a.file_name, a.Pos),
bioq AS (
  SELECT bio.*, CASE WHEN others_rows >= 1 THEN mo END AS mean_others,
                CASE WHEN others_rows >= 2 THEN so END AS sd_others
  FROM bio JOIN loo USING (file_name, Pos)),
bioqc AS (
  SELECT *, CASE WHEN sd_others IS NULL THEN 'GOOD'
                 WHEN normalized_expression IS NULL THEN NULL
                 WHEN abs(normalized_expression - mean_others) > {K} * sd_others THEN 'BAD'
                 ELSE 'GOOD' END AS qc_flag
  FROM bioq)"""

def summary_ctes(src: str = "bioqc", sfx: str = "") -> str:
    """Sample summary (poison rule), representative row and z-score over ``src`` bio rows."""
    def stat(fn: str, col: str) -> str:
        return (f"CASE WHEN max(CASE WHEN qc_flag IS NULL OR (qc_flag = 'GOOD' AND {col} IS NULL) THEN 1 ELSE 0 END) "
                f"OVER s = 0 THEN {fn}(CASE WHEN qc_flag = 'GOOD' THEN {col} END) OVER s END")
    return f"""
ranked{sfx} AS (
  SELECT *, row_number() OVER (PARTITION BY sample_name, Gene ORDER BY replicate_name, well_ord) AS rn,
         {stat('avg', 'normalized_expression')} AS normalized_expression_mean,
         {stat('stddev_samp', 'normalized_expression')} AS normalized_expression_sd,
         {stat('avg', 'log2_expression_value')} AS log2_expression_value_mean,
         {stat('stddev_samp', 'log2_expression_value')} AS log2_expression_value_sd
  FROM {src} WINDOW s AS (PARTITION BY sample_name, Gene)),
summ{sfx} AS (SELECT * FROM ranked{sfx} WHERE rn = 1 AND normalized_expression_mean IS NOT NULL),
zs{sfx} AS (
  SELECT *, (log2_expression_value_mean - avg(log2_expression_value_mean) OVER z)
            / nullif(stddev_samp(log2_expression_value_mean) OVER z, 0) AS zscored_value
  FROM summ{sfx} WINDOW z AS (PARTITION BY zscoring_group, Gene))"""


SUMMARY = summary_ctes()


def _betai_cte(src: str, key_cols: str, a: str, b: str, x: str, name: str = "betai") -> str:
    """CTE ``name``(key_cols..., ibeta) = regularized incomplete beta I_x(a, b), for rows of ``src``
    with 0 < x < 1 (Numerical-Recipes style continued fraction, 300 Lentz steps)."""
    keys = [k.strip() for k in key_cols.split(",")]
    kl = ", ".join(keys)
    kj = " AND ".join(f"r.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""
{name}_in AS (
  SELECT {kl}, CAST({a} AS DOUBLE) AS a0, CAST({b} AS DOUBLE) AS b0, CAST({x} AS DOUBLE) AS x0 FROM {src}
  WHERE {x} > 0 AND {x} < 1),
{name}_p AS (
  SELECT {kl}, x0 >= (a0 + 1) / (a0 + b0 + 2) AS flip,
         CASE WHEN x0 >= (a0 + 1) / (a0 + b0 + 2) THEN b0 ELSE a0 END AS a,
         CASE WHEN x0 >= (a0 + 1) / (a0 + b0 + 2) THEN a0 ELSE b0 END AS b,
         CASE WHEN x0 >= (a0 + 1) / (a0 + b0 + 2) THEN 1 - x0 ELSE x0 END AS x,
         exp(lgamma(a0 + b0) - lgamma(a0) - lgamma(b0) + a0 * ln(x0) + b0 * ln(1 - x0)) AS bt
  FROM {name}_in),
{name}_cf AS (
  SELECT {kl}, 0 AS m, CAST(1.0 AS DOUBLE) AS c,
         1.0 / (CASE WHEN abs(1 - (a + b) * x / (a + 1)) < 1e-300 THEN 1e-300 ELSE 1 - (a + b) * x / (a + 1) END) AS d,
         1.0 / (CASE WHEN abs(1 - (a + b) * x / (a + 1)) < 1e-300 THEN 1e-300 ELSE 1 - (a + b) * x / (a + 1) END) AS h
  FROM {name}_p
  UNION ALL
  SELECT {", ".join("r." + k for k in keys)}, r.m + 1, s.c2, s.d2, r.h * s.d1 * s.c1 * s.d2 * s.c2
  FROM {name}_cf r JOIN {name}_p p ON {kj},
  LATERAL (
    SELECT c1, d1,
           CASE WHEN abs(1 + ae / c1) < 1e-300 THEN 1e-300 ELSE 1 + ae / c1 END AS c2,
           1.0 / (CASE WHEN abs(1 + ae * d1) < 1e-300 THEN 1e-300 ELSE 1 + ae * d1 END) AS d2
    FROM (
      SELECT ao, ae,
             CASE WHEN abs(1 + ao / r.c) < 1e-300 THEN 1e-300 ELSE 1 + ao / r.c END AS c1,
             1.0 / (CASE WHEN abs(1 + ao * r.d) < 1e-300 THEN 1e-300 ELSE 1 + ao * r.d END) AS d1
      FROM (SELECT (r.m + 1) * (p.b - (r.m + 1)) * p.x / ((p.a - 1 + 2 * (r.m + 1)) * (p.a + 2 * (r.m + 1))) AS ao,
                   -(p.a + (r.m + 1)) * (p.a + p.b + (r.m + 1)) * p.x / ((p.a + 2 * (r.m + 1)) * (p.a + 1 + 2 * (r.m + 1))) AS ae)
    )
  ) s
  WHERE r.m < 300),
{name} AS (
  SELECT {", ".join("p." + k for k in keys)},
         CASE WHEN p.flip THEN 1 - p.bt * f.h / p.a ELSE p.bt * f.h / p.a END AS ibeta
  FROM {name}_p p JOIN {name}_cf f ON {" AND ".join(f"f.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)} AND f.m = 300)"""


def welch_ctes(src: str = "bioqc", sfx: str = "") -> str:
    """Per-test level table (t-prefixed CTEs) and Welch statistic over GOOD non-HK rows of ``src``."""
    return f"""
tin{sfx} AS (SELECT zscoring_group, Gene, testing_group, normalized_expression AS x FROM {src}
        WHERE qc_flag = 'GOOD' AND type_of_gene <> 'HK'),
tg{sfx} AS (SELECT zscoring_group, Gene, testing_group, count(*) AS nrows, count(x) AS n, avg(x) AS mean,
       var_samp(x) AS var FROM tin{sfx} GROUP BY ALL),
tk{sfx} AS (SELECT zscoring_group, Gene, sum(nrows) AS total_rows, count(*) AS n_groups,
              count(*) FILTER (WHERE testing_group IS NOT NULL AND n > 0) AS n_levels
       FROM tg{sfx} GROUP BY ALL),
tl{sfx} AS (SELECT *, row_number() OVER (PARTITION BY zscoring_group, Gene ORDER BY testing_group) AS lv
       FROM tg{sfx} WHERE testing_group IS NOT NULL AND n > 0),
tw{sfx} AS (
  SELECT k.zscoring_group, k.Gene, k.total_rows, k.n_groups, k.n_levels,
         a.n AS na, b.n AS nb, a.mean AS ma, b.mean AS mb, a.var / a.n AS va, b.var / b.n AS vb
  FROM tk{sfx} k
  LEFT JOIN tl{sfx} a ON a.zscoring_group = k.zscoring_group AND a.Gene IS NOT DISTINCT FROM k.Gene AND a.lv = 1
  LEFT JOIN tl{sfx} b ON b.zscoring_group = k.zscoring_group AND b.Gene IS NOT DISTINCT FROM k.Gene AND b.lv = 2),
ts{sfx} AS (
  SELECT *, CASE WHEN n_groups < 2 OR total_rows < 2 THEN 'insufficient_data'
                 WHEN n_levels <> 2 THEN 'not_two_groups'
                 WHEN na < 2 OR nb < 2 THEN 'not_enough_observations'
                 WHEN sqrt(va + vb) < 10 * 2.220446049250313e-16 * greatest(abs(ma), abs(mb)) THEN 'constant_data'
                 ELSE 'ok' END AS test_status,
            (ma - mb) / sqrt(va + vb) AS t,
            (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS dof
  FROM tw{sfx}),
tbeta_src{sfx} AS (SELECT zscoring_group, Gene, dof / 2 AS a, 0.5 AS b, dof / (dof + t * t) AS x
                   FROM ts{sfx} WHERE test_status = 'ok')""" + "," + _betai_cte(f"tbeta_src{sfx}", "zscoring_group, Gene",
                                                                           "a", "b", "x", f"tbeta{sfx}")


def welch_select(sfx: str = "") -> str:
    return f"""
SELECT s.zscoring_group, s.Gene, {rs("CASE WHEN s.test_status = 'ok' THEN b.ibeta END")} AS pvalue, s.test_status
FROM ts{sfx} s LEFT JOIN tbeta{sfx} b ON b.zscoring_group = s.zscoring_group AND b.Gene IS NOT DISTINCT FROM s.Gene"""


RAW_WELLS = """
rawwells AS (
  SELECT 'plate_' || CAST(event_id // 384 AS VARCHAR) AS file_name,
         chr(CAST(65 + (event_id % 384) // 24 AS INTEGER)) || CAST((event_id % 384) % 24 + 1 AS VARCHAR) AS Pos,
         event_id AS well_ord,
         CASE WHEN value < 1 THEN NULL ELSE CAST(20 AS DOUBLE) + value / 20 END AS Cp
  FROM events)"""


def _pieces_sql(x: str, sep: str = ",") -> str:
    return (f"(CASE WHEN {x} IS NULL THEN [NULL]::VARCHAR[] WHEN {x} = '' THEN []::VARCHAR[] "
            f"WHEN ends_with({x}, '{sep}') THEN string_split(left({x}, length({x}) - 1), '{sep}') "
            f"ELSE string_split({x}, '{sep}') END)")


def _int_sql(t: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST(trim({t}) AS DOUBLE)) AS INTEGER)"


def _expand_sql(sheet: str, value: str, name: str) -> str:
    ends = _pieces_sql("tok", "-")
    a, b = _int_sql(f"{ends}[1]"), _int_sql(f"{ends}[2]")
    return f"""
{name}_r AS (
  SELECT file_name, {value} AS v, sheet_ord, cols, unnest({_pieces_sql('rows')}) AS rtok,
         generate_subscripts({_pieces_sql('rows')}, 1) AS ri FROM {sheet}),
{name}_t AS (
  SELECT *, unnest({_pieces_sql('cols')}) AS tok, generate_subscripts({_pieces_sql('cols')}, 1) AS ti FROM {name}_r),
{name}_n AS (
  SELECT *, CASE WHEN contains(tok, '-') THEN
              (CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL
                    WHEN {a} <= {b} THEN generate_series({a}, {b}) ELSE generate_series({a}, {b}, -1) END)
            ELSE [CAST({_int_sql('tok')} AS BIGINT)] END AS nums FROM {name}_t),
{name} AS (
  SELECT file_name, v, coalesce(rtok, 'NA') || coalesce(CAST(c AS VARCHAR), 'NA') AS Pos, sheet_ord, ri, ti, ci
  FROM (SELECT *, unnest(nums) AS c, generate_subscripts(nums, 1) AS ci FROM {name}_n))"""


def _rows_sql(key: str, options: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options[:-1]))
    return f"CASE {key} {whens} ELSE '{options[-1]}' END"


def _sheet_ctes() -> list[str]:
    from qplate.sources.driver_tables import (GENE_COLS, GENE_ROWS, REGION_COLS, REGION_ORD_OFFSET, REGION_ROWS,
                                              SUPPLIER_ORD_OFFSET, SUPPLIER_PLATE_OFFSET)
    gs = f"""
gsheet AS (
  SELECT 'plate_' || CAST(n_nationkey AS VARCHAR) AS file_name, {_rows_sql('n_nationkey % 4', GENE_ROWS)} AS rows,
         {_rows_sql('n_nationkey % 5', GENE_COLS)} AS cols, n_name AS gene, CAST(n_nationkey AS BIGINT) AS sheet_ord
  FROM nation
  UNION ALL
  SELECT 'plate_' || CAST(r_regionkey AS VARCHAR), '{REGION_ROWS}', '{REGION_COLS}', r_name,
         CAST(r_regionkey + {REGION_ORD_OFFSET} AS BIGINT) FROM region
  UNION ALL
  SELECT 'plate_' || CAST(s_suppkey + {SUPPLIER_PLATE_OFFSET} AS VARCHAR), {_rows_sql('s_suppkey % 4', GENE_ROWS)},
         {_rows_sql('s_suppkey % 5', GENE_COLS)}, 'NATION_' || CAST(s_nationkey AS VARCHAR),
         CAST(s_suppkey + {SUPPLIER_ORD_OFFSET} AS BIGINT) FROM supplier)"""
    ss = """
ssheet AS (
  SELECT 'plate_' || CAST(c_custkey // 16 AS VARCHAR) AS file_name, chr(CAST(65 + c_custkey % 16 AS INTEGER)) AS rows,
         '1-24' AS cols,
         'C' || CAST(c_custkey AS VARCHAR) || '.' ||
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE CAST(c_nationkey % 3 AS VARCHAR) END AS sample,
         CAST(c_custkey AS BIGINT) AS sheet_ord
  FROM customer)"""
    meta = """
meta AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) || '.' || CAST(c_nationkey % 3 AS VARCHAR) AS replicate_name,
         'C' || CAST(c_custkey AS VARCHAR) AS sample_name, c_mktsegment AS zscoring_group,
         CASE WHEN c_acctbal >= 5000 THEN 'high' ELSE 'low' END AS testing_group
  FROM customer
  UNION ALL
  SELECT 'C' || CAST(s_suppkey AS VARCHAR) || '.' || CAST(s_nationkey % 3 AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR),
         'SUPPLIER', 'low'
  FROM supplier)"""
    look = """
gfirst AS (SELECT file_name, Pos, v AS Gene FROM (
  SELECT *, row_number() OVER (PARTITION BY file_name, Pos ORDER BY sheet_ord, ri, ti, ci) AS rn FROM gexp) WHERE rn = 1),
sfirst AS (SELECT file_name, Pos, v AS replicate_name FROM (
  SELECT *, row_number() OVER (PARTITION BY file_name, Pos ORDER BY sheet_ord, ri, ti, ci) AS rn FROM sexp) WHERE rn = 1),
attached AS (
  SELECT w.*, g.Gene, s.replicate_name FROM rawwells w
  LEFT JOIN gfirst g ON g.file_name = w.file_name AND g.Pos = w.Pos
  LEFT JOIN sfirst s ON s.file_name = w.file_name AND s.Pos = w.Pos)"""
    return [RAW_WELLS, gs, ss, meta, _expand_sql("gsheet", "gene", "gexp"), _expand_sql("ssheet", "sample", "sexp"), look]


def _gammq_cte(src: str, key_cols: str, a: str, x: str, name: str = "gammq") -> str:
    """CTE ``name``(keys..., q) = regularized upper incomplete gamma Q(a, x) for x > 0
    (series below a + 1, Lentz continued fraction above; 300 steps)."""
    keys = [k.strip() for k in key_cols.split(",")]
    kl = ", ".join(keys)
    kj = " AND ".join(f"r.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)
    return f"""
{name}_p AS (
  SELECT {kl}, CAST({a} AS DOUBLE) AS a, CAST({x} AS DOUBLE) AS x,
         exp(-CAST({x} AS DOUBLE) + CAST({a} AS DOUBLE) * ln(CAST({x} AS DOUBLE)) - lgamma(CAST({a} AS DOUBLE))) AS front
  FROM {src} WHERE {x} > 0),
{name}_it AS (
  SELECT {kl}, 0 AS i, a AS ap, 1.0 / a AS del, 1.0 / a AS sm,
         x + 1 - a AS b, 1e300 AS c, 1.0 / (x + 1 - a) AS d, 1.0 / (x + 1 - a) AS h
  FROM {name}_p
  UNION ALL
  SELECT {", ".join("r." + k for k in keys)}, r.i + 1, r.ap + 1, r.del * p.x / (r.ap + 1), r.sm + r.del * p.x / (r.ap + 1),
         r.b + 2, s.c2, s.d2, r.h * s.d2 * s.c2
  FROM {name}_it r JOIN {name}_p p ON {kj},
  LATERAL (
    SELECT CASE WHEN abs((r.b + 2) + an / r.c) < 1e-300 THEN 1e-300 ELSE (r.b + 2) + an / r.c END AS c2,
           1.0 / (CASE WHEN abs(an * r.d + (r.b + 2)) < 1e-300 THEN 1e-300 ELSE an * r.d + (r.b + 2) END) AS d2
    FROM (SELECT -(r.i + 1) * ((r.i + 1) - p.a) AS an)
  ) s
  WHERE r.i < 300),
{name} AS (
  SELECT {", ".join("p." + k for k in keys)},
         CASE WHEN p.x < p.a + 1 THEN 1 - it.sm * p.front ELSE p.front * it.h END AS q
  FROM {name}_p p JOIN {name}_it it ON {" AND ".join(f"it.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)} AND it.i = 300)"""


RANKSUM = """
rk AS (
  SELECT zscoring_group, Gene, testing_group, x,
         rank() OVER (PARTITION BY zscoring_group, Gene ORDER BY x)
           + (count(*) OVER (PARTITION BY zscoring_group, Gene, x) - 1) / 2.0 AS r
  FROM tin WHERE testing_group IS NOT NULL AND x IS NOT NULL),
rties AS (
  SELECT zscoring_group, Gene, sum(t * t * t - t) AS ties, max(t) AS tmax FROM (
    SELECT zscoring_group, Gene, x, count(*) AS t FROM rk GROUP BY ALL) GROUP BY ALL),
rw AS (
  SELECT s.zscoring_group, s.Gene, s.na, s.nb, s.n_groups, s.total_rows, s.n_levels,
         (SELECT sum(k.r) FROM rk k JOIN tl l ON l.zscoring_group = k.zscoring_group AND l.Gene IS NOT DISTINCT FROM k.Gene
            AND l.lv = 1 AND l.testing_group = k.testing_group
          WHERE k.zscoring_group = s.zscoring_group AND k.Gene IS NOT DISTINCT FROM s.Gene) - s.na * (s.na + 1) / 2.0 AS w,
         t.ties, t.tmax
  FROM tw s LEFT JOIN rties t ON t.zscoring_group = s.zscoring_group AND t.Gene IS NOT DISTINCT FROM s.Gene),
rm AS (
  SELECT *, CASE WHEN na < 50 AND nb < 50 AND tmax <= 1 THEN 'exact' ELSE 'normal' END AS method,
         sqrt((CAST(na AS DOUBLE) * nb / 12.0) * ((na + nb + 1) - ties / (CAST(na + nb AS DOUBLE) * (na + nb - 1)))) AS sigma
  FROM rw),
rz AS (
  SELECT *, CASE WHEN n_groups < 2 OR total_rows < 2 THEN 'insufficient_data'
                 WHEN n_levels <> 2 THEN 'not_two_groups'
                 WHEN method = 'normal' AND (sigma = 0 OR sigma IS NULL) THEN 'constant_data'
                 ELSE 'ok' END AS test_status,
            ((w - na * nb / 2.0) - sign(w - na * nb / 2.0) * 0.5) / sigma AS z
  FROM rm),
gsrc AS (SELECT zscoring_group, Gene, 0.5 AS a, z * z / 2.0 AS x FROM rz WHERE test_status = 'ok' AND method = 'normal'),
wx_pairs AS (SELECT DISTINCT CAST(na AS BIGINT) AS m, CAST(nb AS BIGINT) AS n FROM rz WHERE test_status = 'ok' AND method = 'exact'),
wx AS (
  SELECT m, n, 0 AS t,
         list_transform(range(0, m + 1), lambda k: list_transform(range(0, m * n + 1),
           lambda w: CASE WHEN k = 0 AND w = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS st
  FROM wx_pairs
  UNION ALL
  SELECT m, n, t + 1,
         list_transform(range(0, m + 1), lambda k: list_transform(range(0, m * n + 1), lambda w:
             st[k + 1][w + 1] + CASE WHEN k >= 1 AND t + 1 - k BETWEEN 0 AND n AND w - (t + 1 - k) >= 0
                                     THEN st[k][w - (t + 1 - k) + 1] ELSE 0.0 END))
  FROM wx WHERE t < m + n),
wdist AS (SELECT m, n, st[m + 1] AS dist FROM wx WHERE t = m + n)"""


REPORT_ROWS = """
wl AS (
  SELECT n.*, CASE WHEN n.is_first THEN n.evm_all END AS evm_f, CASE WHEN n.is_first THEN n.norm_all END AS norm_f
  FROM nx n),
rpt AS (
  SELECT w.file_name, w.Pos, w.well_ord, w.replicate_name, w.sample_name, w.zscoring_group, w.testing_group, w.Gene,
         w.type_of_gene, w.Cp, w.good_replicate, w.keep_this_value, w.elevated_value,
         w.evm_f AS elevated_value_mean, w.norm_f AS normalized_expression,
         CASE WHEN w.norm_f > 0 THEN log2(w.norm_f) END AS log2_expression_value,
         b.mean_others, b.sd_others, b.qc_flag,
         z.normalized_expression_mean, z.normalized_expression_sd, z.log2_expression_value_mean,
         z.log2_expression_value_sd, z.zscored_value
  FROM wl w
  LEFT JOIN bioqc b ON b.file_name = w.file_name AND b.Pos = w.Pos
  LEFT JOIN zs z ON z.file_name = w.file_name AND z.Pos = w.Pos)"""

RECALC = """
ovr AS (
  SELECT file_name, Pos, CASE WHEN Cp >= 40 THEN 'NO keep' END AS k,
         CASE WHEN normalized_expression > 10 THEN 'BAD' END AS q FROM rpt),
r2 AS (
  SELECT r.file_name, r.Pos, r.well_ord, r.replicate_name, r.sample_name, r.zscoring_group, r.testing_group, r.Gene,
         r.type_of_gene, r.Cp, r.elevated_value,
         coalesce(o.k, r.keep_this_value) AS keep_this_value, coalesce(o.q, r.qc_flag) AS qc_cur
  FROM rpt r LEFT JOIN ovr o ON o.file_name = r.file_name AND o.Pos = r.Pos),
ev2 AS (
  SELECT *, avg(CASE WHEN keep_this_value = 'keep' THEN elevated_value END)
              OVER (PARTITION BY replicate_name, Gene) AS evm_all,
         well_ord = min(well_ord) OVER (PARTITION BY replicate_name, Gene) AS is_first
  FROM r2),
hkg2 AS (
  SELECT replicate_name, Gene, count(*) FILTER (WHERE keep_this_value = 'keep') AS nk, max(evm_all) AS evm
  FROM ev2 WHERE type_of_gene = 'HK' GROUP BY replicate_name, Gene),
hkr2 AS (SELECT replicate_name, CASE WHEN min(evm) = max(evm) THEN min(evm) ELSE sum(nk * evm) / sum(nk) END AS hk
         FROM hkg2 WHERE nk > 0 GROUP BY replicate_name),
nx2 AS (SELECT ev2.*, evm_all / hkr2.hk AS norm_all FROM ev2 LEFT JOIN hkr2 USING (replicate_name)),
bio2 AS (
  SELECT file_name, Pos, well_ord, replicate_name, sample_name, zscoring_group, testing_group, Gene, type_of_gene,
         evm_all AS elevated_value_mean, norm_all AS normalized_expression,
         CASE WHEN norm_all > 0 THEN log2(norm_all) END AS log2_expression_value, qc_cur AS qc_flag
  FROM nx2 WHERE is_first AND evm_all IS NOT NULL)"""

def points_ctes(src: str = "rpt", sfx: str = "") -> str:
    """Plot rows of a well-level report ``src`` with the bar order index."""
    return f"""
pts0{sfx} AS (
  SELECT zscoring_group, replicate_name, sample_name, testing_group, Gene, normalized_expression,
         normalized_expression_mean, normalized_expression_sd, qc_flag,
         concat_ws('_', sample_name, testing_group, Gene) AS ordering
  FROM {src} WHERE type_of_gene <> 'HK' AND normalized_expression IS NOT NULL),
lvl{sfx} AS (
  SELECT zscoring_group, ordering,
         row_number() OVER (PARTITION BY zscoring_group ORDER BY Gene NULLS LAST, testing_group NULLS LAST, fr) AS ordering_level
  FROM (SELECT zscoring_group, ordering, Gene, testing_group, min(replicate_name) AS fr FROM pts0{sfx} GROUP BY ALL)),
pts{sfx} AS (SELECT p.*, l.ordering_level FROM pts0{sfx} p JOIN lvl{sfx} l USING (zscoring_group, ordering))"""


POINTS = points_ctes()


def _r_number_ctes(src: str, col: str, name: str) -> str:
    """Staged CTEs adding ``txt`` = R's printing of ``col`` (<= 2 significant digits)."""
    return f"""
{name}_a AS (SELECT *, CAST(floor(log10(abs({col}))) AS INTEGER) AS e0 FROM {src}),
{name}_b AS (SELECT *, CAST(round(CASE WHEN e0 - 1 < 0 THEN abs({col}) * pow(10, 1 - e0)
                                         ELSE abs({col}) / pow(10, e0 - 1) END) AS INTEGER) AS d0 FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN d0 >= 100 THEN e0 + 1 ELSE e0 END AS ee, CASE WHEN d0 >= 100 THEN 10 ELSE d0 END AS dd
             FROM {name}_b),
{name}_d AS (SELECT *, dd % 10 = 0 AS one,
                    CASE WHEN dd % 10 = 0 THEN CAST(dd // 10 AS VARCHAR) ELSE CAST(dd AS VARCHAR) END AS digs FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN one THEN digs ELSE digs[1] || '.' || digs[2] END AS mant FROM {name}_d),
{name}_f AS (
  SELECT *, mant || CASE WHEN ee < 0 THEN 'e-' ELSE 'e+' END || lpad(CAST(abs(ee) AS VARCHAR), 2, '0') AS sci,
         CASE WHEN ee < 0 THEN '0.' || repeat('0', -ee - 1) || digs
              WHEN one THEN digs || repeat('0', ee)
              WHEN ee = 0 THEN mant
              ELSE digs || repeat('0', ee - 1) END AS fixed
  FROM {name}_e),
{name} AS (
  SELECT *, CASE WHEN {col} IS NULL OR isnan({col}) THEN 'NA' WHEN {col} = 0 THEN '0'
                 ELSE (CASE WHEN {col} < 0 THEN '-' ELSE '' END) ||
                      (CASE WHEN length(fixed) <= length(sci) THEN fixed ELSE sci END) END AS txt
  FROM {name}_f)"""


LABELS = """
tallest AS (SELECT zscoring_group, max(normalized_expression_mean) AS ymax FROM pts GROUP BY ALL),
lab0 AS (
  SELECT s.zscoring_group, s.Gene, CASE WHEN s.test_status = 'ok' THEN b.ibeta END AS pvalue, s.test_status,
         t.ymax + t.ymax * 0.1 AS y_pos,
         (1 + (SELECT count(DISTINCT testing_group) FROM prep)) / 2.0 AS x_pos
  FROM ts s LEFT JOIN tbeta b ON b.zscoring_group = s.zscoring_group AND b.Gene IS NOT DISTINCT FROM s.Gene
  LEFT JOIN tallest t ON t.zscoring_group = s.zscoring_group),
lab1 AS (
  SELECT *, CASE WHEN pvalue IS NULL OR pvalue = 0 THEN pvalue
                 WHEN floor(log10(abs(pvalue))) < 0
                   THEN round(pvalue * pow(10, -floor(log10(abs(pvalue)))), 1) / pow(10, -floor(log10(abs(pvalue))))
                 ELSE round(pvalue / pow(10, floor(log10(abs(pvalue)))), 1) * pow(10, floor(log10(abs(pvalue)))) END
            AS p_rounded
  FROM lab0)"""

BREAKS = """
bpts AS (
  SELECT zscoring_group, y_pos AS v FROM labr
  UNION ALL SELECT zscoring_group, normalized_expression FROM pts),
bsorted AS (
  SELECT zscoring_group, v, row_number() OVER (PARTITION BY zscoring_group ORDER BY v) AS id,
         CASE WHEN v < 0 THEN NULL WHEN v = 0 THEN -1e308 ELSE floor(log10(v)) END AS o,
         v < 0 AS nanorder
  FROM bpts WHERE v IS NOT NULL),
bdiff AS (
  SELECT *, lag(o) OVER (PARTITION BY zscoring_group ORDER BY id) AS po,
            lag(nanorder) OVER (PARTITION BY zscoring_group ORDER BY id) AS pnan
  FROM bsorted),
bup AS (SELECT zscoring_group, id FROM bdiff
        WHERE po IS NOT NULL AND NOT nanorder AND NOT pnan AND NOT (o = -1e308 AND po = -1e308) AND abs(o - po) >= 2),
bmark AS (
  SELECT s.zscoring_group, s.v AS points_of_plot, s.id,
         CASE WHEN EXISTS (SELECT 1 FROM bup u WHERE u.zscoring_group = s.zscoring_group AND u.id = s.id) THEN 'UP'
              ELSE 'DOWN' END AS up_down
  FROM bsorted s
  WHERE EXISTS (SELECT 1 FROM bup u WHERE u.zscoring_group = s.zscoring_group AND (u.id = s.id OR u.id - 1 = s.id)))"""


DCHAIN = """cr AS (
  SELECT *, avg(CASE WHEN keep_this_value = 'keep' THEN Cp END) OVER (PARTITION BY replicate_name, Gene) AS mv
  FROM qc),
cr2 AS (SELECT *, CASE WHEN min(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r = max(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r
                 THEN min(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r
                 ELSE avg(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r END AS hk
  FROM cr WINDOW r AS (PARTITION BY replicate_name)),
dct AS (
  SELECT replicate_name, Gene, max(mv) / max(hk) AS deltaCT, min(well_ord) AS well_ord, max(type_of_gene) AS tg_
  FROM cr2 GROUP BY replicate_name, Gene),
dreps AS (
  SELECT d.replicate_name, d.Gene, d.deltaCT, d.well_ord, p.sample_name, p.zscoring_group AS cell_line,
         p.testing_group AS sample_group
  FROM dct d JOIN prep p ON p.well_ord = d.well_ord
  WHERE d.tg_ <> 'HK' AND d.deltaCT IS NOT NULL),
dloo AS (
  SELECT a.replicate_name, a.Gene, count(b.replicate_name) AS others_rows, avg(b.deltaCT) AS mo,
         stddev_samp(b.deltaCT) AS so
  FROM dreps a LEFT JOIN dreps b ON a.sample_name = b.sample_name AND a.Gene = b.Gene
   AND a.replicate_name <> b.replicate_name
  GROUP BY a.replicate_name, a.Gene),
dq AS (
  SELECT d.*, CASE WHEN l.others_rows >= 2 THEN l.so END AS sdo, CASE WHEN l.others_rows >= 1 THEN l.mo END AS mno
  FROM dreps d JOIN dloo l USING (replicate_name, Gene)),
dflag AS (
  SELECT *, CASE WHEN sdo IS NULL THEN 'GOOD' WHEN deltaCT IS NULL THEN NULL
                 WHEN abs(deltaCT - mno) > 3.0 * sdo THEN 'BAD' ELSE 'GOOD' END AS qc_flag
  FROM dq)"""


def _wrap(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


def oracles() -> dict[str, str]:
    base = [WELLS, FAILED]
    prep = base + [PREP]
    qc = prep + [QC]
    ex = qc + [EXPR]
    bio = ex + [BIO]
    summ = bio + [SUMMARY]
    welch = summ + [welch_ctes()]
    out: dict[str, str] = {}
    sheets = _sheet_ctes()
    out["layout_expand"] = _wrap(sheets, """
SELECT file_name || '_' || Pos AS id_of_col, file_name, v AS gene, Pos FROM gexp""")
    out["annotate_first_match"] = _wrap(sheets, f"""
SELECT a.file_name, a.Pos, a.well_ord, {rs('a.Cp')} AS Cp, a.Gene,
       CASE WHEN a.Gene IN ('NATION_1') THEN 'HK' ELSE 'Normal' END AS type_of_gene,
       a.replicate_name, m.sample_name, m.zscoring_group, m.testing_group
FROM attached a JOIN meta m ON m.replicate_name = a.replicate_name""")
    out["unmatched_wells"] = _wrap(sheets, """
SELECT file_name, Pos, Gene, replicate_name, 'no_replicate' AS reason FROM attached WHERE replicate_name IS NULL
UNION ALL
SELECT file_name, Pos, Gene, replicate_name, 'no_metadata' FROM attached a
WHERE replicate_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM meta m WHERE m.replicate_name = a.replicate_name)""")
    out["hk_failed_drop"] = _wrap(base, f"""
SELECT file_name, Pos, replicate_name, Gene, type_of_gene, {rs('Cp')} AS Cp, 'good' AS good_replicate
FROM wells w WHERE replicate_name IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM failed f WHERE f.replicate_name = w.replicate_name)""")
    out["hk_failed_flag"] = _wrap(base, f"""
SELECT file_name, Pos, replicate_name, Gene, type_of_gene, {rs('Cp')} AS Cp,
       CASE WHEN EXISTS (SELECT 1 FROM failed f WHERE f.replicate_name = w.replicate_name) THEN 'bad' ELSE 'good' END
         AS good_replicate
FROM wells w WHERE replicate_name IS NOT NULL""")
    out["fill_undetected"] = _wrap(prep, f"SELECT file_name, Pos, replicate_name, Gene, {rs('Cp')} AS Cp FROM prep")
    out["technical_qc"] = _wrap(qc, f"""
SELECT file_name, Pos, replicate_name, Gene, {rs('Cp')} AS Cp, valid_counter, n_of_samples, group_type, keep_this_value
FROM qc""")
    out["comparison_string"] = _wrap(prep, f"""
, lists AS (
  SELECT *, list(struct_pack(o := well_ord, x := Cp) ORDER BY well_ord) OVER (PARTITION BY replicate_name, Gene
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS grp
  FROM prep)
SELECT file_name, Pos, replicate_name, Gene,
       array_to_string(list_transform(
         list_filter(grp, lambda s, i: i <> list_position(list_transform(grp, lambda q: q.x = Cp), true)),
         lambda s: CASE WHEN abs(s.x - Cp) <= {TOL} THEN 'good' ELSE 'bad' END), ',') AS comparison_results
FROM lists""")
    out["tolerance_bitmaps"] = _wrap(prep, f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY replicate_name, Gene ORDER BY well_ord) - 1 AS rk FROM prep),
vals AS (SELECT replicate_name, Gene, Cp, min(rk) AS first_rank FROM ranked GROUP BY replicate_name, Gene, Cp),
bits AS (
  SELECT v.*, r.rk, r.rk // 1024 AS chunk, abs(r.Cp - v.Cp) <= {TOL} AS good
  FROM vals v JOIN ranked r ON r.replicate_name = v.replicate_name AND r.Gene IS NOT DISTINCT FROM v.Gene),
runs AS (SELECT *, good IS DISTINCT FROM lag(good) OVER (PARTITION BY replicate_name, Gene, Cp, chunk ORDER BY rk) AS starts FROM bits)
SELECT replicate_name, Gene, {rs('Cp')} AS Cp, first_rank, count(*) AS n_wells, count(*) FILTER (WHERE good) AS n_good,
       count(*) FILTER (WHERE starts) AS n_runs
FROM runs GROUP BY replicate_name, Gene, runs.Cp, first_rank""")
    out["plate_exports"] = _wrap([WELLS], f"""
, plates AS (SELECT file_name, row_number() OVER (ORDER BY file_name || '.txt') - 1 AS plate_ord FROM (SELECT DISTINCT file_name FROM wells))
SELECT file_name, Pos, {rs('Cp')} AS Cp, plate_ord, plate_ord * 4096 + well_ord % 384 AS well_ord
FROM wells JOIN plates USING (file_name)""")
    out["rejected_lines"] = _wrap([WELLS], """
, lines AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY well_ord) + 2 AS line FROM wells)
SELECT file_name, line, CASE WHEN well_ord % 103 = 9 THEN 'position' ELSE 'Cp' END AS reason
FROM lines WHERE well_ord % 103 = 9 OR well_ord % 97 = 5 OR well_ord % 101 = 7""")
    columns = """
, cols AS (SELECT zscoring_group, sample_name, row_number() OVER (PARTITION BY zscoring_group ORDER BY sample_name) - 1 AS position
           FROM (SELECT DISTINCT zscoring_group, sample_name FROM zs))"""
    out["heatmap_columns"] = _wrap(summ, columns + "\nSELECT zscoring_group, sample_name, position FROM cols")
    out["heatmap_wide"] = _wrap(summ, columns + """,
present AS (SELECT DISTINCT z.zscoring_group, z.Gene, c.position // 4096 AS block
            FROM zs z JOIN cols c ON c.zscoring_group = z.zscoring_group AND c.sample_name = z.sample_name),
cells AS (
  SELECT p.*, c.position, z.zscored_value FROM present p
  JOIN cols c ON c.zscoring_group = p.zscoring_group AND c.position // 4096 = p.block
  LEFT JOIN zs z ON z.zscoring_group = p.zscoring_group AND z.Gene IS NOT DISTINCT FROM p.Gene AND z.sample_name = c.sample_name)
SELECT zscoring_group, Gene, block, block * 4096 AS first, count(*) AS n_columns, count(zscored_value) AS n_filled,
       string_agg(coalesce(CAST(CAST(round(zscored_value * 1e6) AS BIGINT) AS VARCHAR), ''), '|' ORDER BY position) AS cells
FROM cells GROUP BY zscoring_group, Gene, block""")
    out["category_levels"] = """
WITH levels AS (SELECT unnest(['MACHINERY', 'AUTOMOBILE', 'AEROSPACE', 'BUILDING']) AS level, unnest(range(1, 5)) AS level_rank)
SELECT c_custkey, c_mktsegment, level AS segment, level_rank AS segment_rank FROM customer LEFT JOIN levels ON level = c_mktsegment"""
    out["category_table_levels"] = """
WITH levels AS (SELECT CAST(n_nationkey AS VARCHAR) AS level, row_number() OVER (ORDER BY n_regionkey * 1000 - n_nationkey) AS level_rank
                FROM nation WHERE n_regionkey <> 2),
s AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier)
SELECT s_suppkey, nation, level AS nation_level, level_rank AS nation_level_rank FROM s LEFT JOIN levels ON level = nation"""
    out["plate_coordinates"] = _wrap([WELLS], """
SELECT file_name, Pos, well_ord, substr(Pos, 1, 1) AS row_letter, CAST(substr(Pos, 2) AS BIGINT) AS plate_column, well_ord % 384 AS well
FROM wells""")
    out["report_sink"] = _wrap(ex, """
SELECT row_number() OVER (ORDER BY replicate_name NULLS LAST, Gene NULLS LAST, NOT (is_first AND evm_all IS NOT NULL), well_ord) - 1 AS row_no,
       file_name, Pos, replicate_name, Gene
FROM nx""")
    out["split_sink"] = _wrap([WELLS], "SELECT zscoring_group, count(*) AS n_rows, true AS within_bound FROM wells GROUP BY zscoring_group")
    out["annotate_other_key"] = out["annotate_first_match"]
    out["relative_expression"] = _wrap(ex, f"""
SELECT replicate_name, Gene, max(type_of_gene) AS type_of_gene,
       CAST(sum(CASE WHEN keep_this_value = 'keep' THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
       {rs('max(evm_all)')} AS elevated_value_mean, {rs('max(norm_all)')} AS normalized_expression,
       {rs('CASE WHEN max(norm_all) > 0 THEN log2(max(norm_all)) END')} AS log2_expression_value
FROM nx GROUP BY replicate_name, Gene""")
    out["first_row_only"] = _wrap(ex, f"""
SELECT file_name, Pos, replicate_name, Gene, keep_this_value, {rs('elevated_value')} AS elevated_value,
       {rs('CASE WHEN is_first THEN evm_all END')} AS elevated_value_mean,
       {rs('CASE WHEN is_first THEN norm_all END')} AS normalized_expression,
       {rs('CASE WHEN is_first AND norm_all > 0 THEN log2(norm_all) END')} AS log2_expression_value
FROM nx""")
    out["cp_ratio"] = _wrap(qc, f""",
cr AS (
  SELECT *, avg(CASE WHEN keep_this_value = 'keep' THEN Cp END) OVER (PARTITION BY replicate_name, Gene) AS mv,
            stddev_samp(CASE WHEN keep_this_value = 'keep' THEN Cp END) OVER (PARTITION BY replicate_name, Gene) AS sv
  FROM qc),
cr2 AS (
  SELECT *, CASE WHEN min(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r = max(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r
                 THEN min(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r
                 ELSE avg(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r END AS hk
  FROM cr WINDOW r AS (PARTITION BY replicate_name))
SELECT replicate_name, Gene, max(type_of_gene) AS type_of_gene, {rs('max(mv)')} AS mean_value,
       {rs('max(sv)')} AS sd_value, {rs('max(hk)')} AS hk_mean_value, {rs('max(mv) / max(hk)')} AS deltaCT
FROM cr2 GROUP BY replicate_name, Gene""")
    out["loo_outliers"] = _wrap(bio, f"""
SELECT file_name, Pos, sample_name, Gene, {rs('normalized_expression')} AS normalized_expression,
       {rs('mean_others')} AS mean_others, {rs('sd_others')} AS sd_others, qc_flag
FROM bioqc""")
    out["sample_summary"] = _wrap(summ, f"""
SELECT file_name, Pos, sample_name, zscoring_group, Gene,
       {rs('normalized_expression_mean')} AS normalized_expression_mean,
       {rs('normalized_expression_sd')} AS normalized_expression_sd,
       {rs('log2_expression_value_mean')} AS log2_expression_value_mean,
       {rs('log2_expression_value_sd')} AS log2_expression_value_sd
FROM summ""")
    out["zscore"] = _wrap(summ, f"""
SELECT file_name, Pos, zscoring_group, Gene, {rs('log2_expression_value_mean')} AS log2_expression_value_mean,
       {ra('zscored_value')} AS zscored_value
FROM zs""")
    out["report"] = _wrap(summ, f""",
wl AS (
  SELECT n.*, CASE WHEN n.is_first THEN n.evm_all END AS evm_f,
         CASE WHEN n.is_first THEN n.norm_all END AS norm_f
  FROM nx n)
SELECT w.file_name, w.Pos, w.replicate_name, w.sample_name, w.zscoring_group, w.testing_group, w.Gene, w.type_of_gene,
       {rs('w.Cp')} AS Cp, w.good_replicate, w.keep_this_value, {rs('w.elevated_value')} AS elevated_value,
       {rs('w.evm_f')} AS elevated_value_mean, {rs('w.norm_f')} AS normalized_expression,
       {rs('CASE WHEN w.norm_f > 0 THEN log2(w.norm_f) END')} AS log2_expression_value,
       {rs('b.mean_others')} AS mean_others, {rs('b.sd_others')} AS sd_others, b.qc_flag,
       {rs('z.normalized_expression_mean')} AS normalized_expression_mean,
       {rs('z.normalized_expression_sd')} AS normalized_expression_sd,
       {rs('z.log2_expression_value_mean')} AS log2_expression_value_mean,
       {rs('z.log2_expression_value_sd')} AS log2_expression_value_sd,
       {ra('z.zscored_value')} AS zscored_value
FROM wl w
LEFT JOIN bioqc b ON b.file_name = w.file_name AND b.Pos = w.Pos
LEFT JOIN zs z ON z.file_name = w.file_name AND z.Pos = w.Pos""")
    out["welch_test"] = _wrap(welch, welch_select())
    rank = summ + [welch_ctes(), RANKSUM, _gammq_cte("gsrc", "zscoring_group, Gene", "a", "x", "gq")]
    out["ranksum_test"] = _wrap(rank, f"""
SELECT r.zscoring_group, r.Gene, {rs("CASE WHEN r.test_status = 'ok' THEN r.w END")} AS statistic,
       {rs("""CASE WHEN r.test_status <> 'ok' THEN NULL
            WHEN r.method = 'normal' THEN least(1.0, g.q)
            WHEN r.w > r.na * r.nb / 2.0
              THEN least(1.0, 2 * (1 - list_sum(list_slice(d.dist, 1, CAST(r.w AS BIGINT))) / list_sum(d.dist)))
            ELSE least(1.0, 2 * list_sum(list_slice(d.dist, 1, CAST(r.w AS BIGINT) + 1)) / list_sum(d.dist)) END""")} AS pvalue,
       r.test_status, CASE WHEN r.test_status = 'ok' THEN r.method END AS method
FROM rz r
LEFT JOIN gq g ON g.zscoring_group = r.zscoring_group AND g.Gene IS NOT DISTINCT FROM r.Gene
LEFT JOIN wdist d ON d.m = r.na AND d.n = r.nb""")
    rpt = summ + [REPORT_ROWS]
    rec = rpt + [RECALC, summary_ctes("bio2", "2")]
    out["recalculate"] = _wrap(rec, f""",
out2 AS (
  SELECT n.file_name, n.Pos, n.replicate_name, n.Gene, n.keep_this_value,
         CASE WHEN n.is_first THEN n.qc_cur END AS qc_flag,
         CASE WHEN n.is_first THEN n.evm_all END AS evm, CASE WHEN n.is_first THEN n.norm_all END AS nrm,
         z.normalized_expression_mean, z.normalized_expression_sd, z.log2_expression_value_mean,
         z.log2_expression_value_sd, z.zscored_value
  FROM nx2 n LEFT JOIN zs2 z ON z.file_name = n.file_name AND z.Pos = n.Pos)
SELECT file_name, Pos, replicate_name, Gene, keep_this_value, qc_flag, {rs('evm')} AS elevated_value_mean,
       {rs('nrm')} AS normalized_expression, {rs('CASE WHEN nrm > 0 THEN log2(nrm) END')} AS log2_expression_value,
       {rs('normalized_expression_mean')} AS normalized_expression_mean,
       {rs('normalized_expression_sd')} AS normalized_expression_sd,
       {rs('log2_expression_value_mean')} AS log2_expression_value_mean,
       {rs('log2_expression_value_sd')} AS log2_expression_value_sd, {ra('zscored_value')} AS zscored_value
FROM out2""")
    out["recalculate_stats"] = _wrap(rec + [welch_ctes("bio2", "2")], welch_select("2"))
    pts = rpt + [POINTS]
    out["plot_points"] = _wrap(pts, f"""
SELECT zscoring_group, sample_name, testing_group, Gene, {rs('normalized_expression')} AS normalized_expression,
       {rs('normalized_expression_mean')} AS normalized_expression_mean,
       {rs('normalized_expression_sd')} AS normalized_expression_sd, qc_flag, ordering, ordering_level
FROM pts""")
    out["bar_table"] = _wrap(pts, f"""
SELECT zscoring_group, sample_name, testing_group, Gene, ordering, ordering_level,
       {rs('normalized_expression_mean')} AS bar_height, {rs('normalized_expression_mean')} AS ymin,
       {rs('normalized_expression_mean + normalized_expression_sd')} AS ymax,
       '#' || substr(md5(testing_group), 1, 6) AS outline_colour,
       '#' || substr(md5(zscoring_group), 1, 6) AS fill_colour
FROM pts WHERE normalized_expression_mean IS NOT NULL""")
    labs = pts + [welch_ctes(), LABELS, _r_number_ctes("lab1", "p_rounded", "labr")]
    out["pvalue_labels"] = _wrap(labs, f"""
SELECT zscoring_group, Gene, {rs('pvalue')} AS pvalue, test_status, {rs('p_rounded')} AS p_rounded,
       'p = ' || txt AS p_label, {rs('y_pos')} AS y_pos, {rs('x_pos')} AS x_pos
FROM labr""")
    out["magnitude_breaks"] = _wrap(labs + [BREAKS], f"""
SELECT zscoring_group, {rs('points_of_plot')} AS points_of_plot, id, up_down,
       {rs("CASE WHEN up_down = 'UP' THEN points_of_plot - points_of_plot / 10 ELSE points_of_plot + points_of_plot / 10 END")}
         AS real_break,
       count(*) OVER (PARTITION BY zscoring_group) > 1 AS use_breaks
FROM bmark""")
    out["heatmap_matrix"] = _wrap(summ, f"""
SELECT zscoring_group, Gene,
       {ra("avg(CASE WHEN testing_group = 'control' THEN zscored_value END)")} AS control_z,
       {rs("avg(CASE WHEN testing_group = 'control' THEN normalized_expression_mean END)")} AS control_q,
       {ra("avg(CASE WHEN testing_group = 'treated' THEN zscored_value END)")} AS treated_z,
       {rs("avg(CASE WHEN testing_group = 'treated' THEN normalized_expression_mean END)")} AS treated_q
FROM zs GROUP BY zscoring_group, Gene""")
    out["sample_labels"] = _wrap(["""
reps AS (
  SELECT c_custkey, c_mktsegment || CAST(c_nationkey AS VARCHAR) ||
         CASE WHEN c_acctbal < 1000 THEN 'DN' ELSE 'TRES' END || '.' || CAST(c_custkey % 3 AS VARCHAR) || '.' ||
         CAST(c_custkey % 4 AS VARCHAR) AS replicate_name
  FROM customer),
named AS (SELECT *, regexp_replace(replicate_name, '\\.[^.]*$', '') AS sample_name FROM reps)"""], """
SELECT c_custkey, replicate_name, sample_name,
       regexp_replace(regexp_replace(sample_name, '.[0-9]$', ''), '\\..*$', '') AS cell_type,
       CASE WHEN contains(sample_name, 'DN') THEN 'Control' ELSE 'Res' END AS sample_group
FROM named""")
    out["delta_delta"] = _wrap(qc + [EXPR], f""",
{DCHAIN},
dd1 AS (
  SELECT *, CASE WHEN max(CASE WHEN deltaCT IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY sample_name, Gene) = 0
                 THEN avg(deltaCT) OVER (PARTITION BY sample_name, Gene) END AS dmean
  FROM dflag),
dd2 AS (
  SELECT *, deltaCT - CASE WHEN max(CASE WHEN sample_group IS NULL OR (sample_group = 'control' AND dmean IS NULL)
                                         THEN 1 ELSE 0 END) OVER (PARTITION BY cell_line, Gene) = 0
                           THEN avg(CASE WHEN sample_group = 'control' THEN dmean END)
                                  OVER (PARTITION BY cell_line, Gene) END AS delta_delta_CT
  FROM dd1),
dd3 AS (SELECT *, pow(2.0, -delta_delta_CT) AS elevated_value FROM dd2),
dd4 AS (
  SELECT *, well_ord = min(well_ord) OVER g AS first_,
         max(CASE WHEN qc_flag IS NULL OR (qc_flag = 'GOOD' AND elevated_value IS NULL) THEN 1 ELSE 0 END) OVER g = 0 AS ok_,
         avg(CASE WHEN qc_flag = 'GOOD' THEN elevated_value END) OVER g AS mv_,
         stddev_samp(CASE WHEN qc_flag = 'GOOD' THEN elevated_value END) OVER g AS sv_
  FROM dd3 WINDOW g AS (PARTITION BY cell_line, sample_group, Gene))
SELECT replicate_name, sample_name, cell_line, sample_group, Gene, {rs('deltaCT')} AS deltaCT, qc_flag,
       {ra('delta_delta_CT')} AS delta_delta_CT, {rs('elevated_value')} AS elevated_value,
       {rs('CASE WHEN first_ AND ok_ THEN mv_ END')} AS mean_value, {rs('CASE WHEN first_ AND ok_ THEN sv_ END')} AS sd_value
FROM dd4""")
    out["zscore_lineitem"] = _wrap(["""
lp AS (SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, p.p_brand, p.p_size
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""], f"""
SELECT l_orderkey, l_linenumber, {rs('l_extendedprice')} AS l_extendedprice, p_brand, p_size,
       {ra('(l_extendedprice - avg(l_extendedprice) OVER g) / nullif(stddev_samp(l_extendedprice) OVER g, 0)')}
         AS zscored_value
FROM lp WINDOW g AS (PARTITION BY p_brand, p_size)""")
    dchain = qc + [EXPR, DCHAIN]
    out["delta_ct_zscore"] = _wrap(dchain + ["""
dm AS (SELECT sample_name, Gene, avg(deltaCT) AS mean_value, min(cell_line) AS zscoring_group
       FROM dflag WHERE qc_flag = 'GOOD' GROUP BY sample_name, Gene)"""], f"""
SELECT sample_name, Gene, {rs('mean_value')} AS mean_value, zscoring_group,
       {ra('(mean_value - avg(mean_value) OVER z) / nullif(stddev_samp(mean_value) OVER z, 0)')} AS zscored_value
FROM dm WINDOW z AS (PARTITION BY zscoring_group, Gene)""")
    out["delta_delta_test"] = _wrap(dchain + ["""
dtin AS (SELECT cell_line AS zscoring_group, Gene, sample_group AS testing_group, deltaCT AS normalized_expression,
                qc_flag, 'Normal' AS type_of_gene FROM dflag)""", welch_ctes("dtin", "3")], f"""
SELECT s.zscoring_group AS cell_line, s.Gene, {rs("CASE WHEN s.test_status = 'ok' THEN b.ibeta END")} AS pvalue,
       s.test_status
FROM ts3 s LEFT JOIN tbeta3 b ON b.zscoring_group = s.zscoring_group AND b.Gene IS NOT DISTINCT FROM s.Gene""")
    out["flag_mode_ratio"] = _wrap(base + [f"""
prepf AS (
  SELECT file_name, Pos, well_ord, replicate_name, sample_name, zscoring_group, testing_group, Gene, type_of_gene,
         coalesce(Cp, CAST({THRESH} AS DOUBLE)) AS Cp,
         CASE WHEN EXISTS (SELECT 1 FROM failed f WHERE f.replicate_name = w.replicate_name) THEN 'bad' ELSE 'good' END
           AS good_replicate
  FROM wells w WHERE replicate_name IS NOT NULL)""", qc_ctes("prepf", "f"), """
fr AS (
  SELECT *, avg(CASE WHEN keep_this_value = 'keep' THEN power(0.5, Cp) END) OVER g AS mv,
            stddev_samp(CASE WHEN keep_this_value = 'keep' THEN power(0.5, Cp) END) OVER g AS sv,
            well_ord = min(well_ord) OVER g AS is_first
  FROM qcf WINDOW g AS (PARTITION BY replicate_name, Gene)),
fr2 AS (SELECT *, CASE WHEN min(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r = max(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r
                 THEN min(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r
                 ELSE avg(CASE WHEN type_of_gene = 'HK' THEN mv END) OVER r END AS hk
  FROM fr WINDOW r AS (PARTITION BY replicate_name)),
fr3 AS (SELECT *, CASE WHEN is_first THEN mv / hk END AS dct_f FROM fr2),
fr4 AS (SELECT *, avg(dct_f) OVER s AS mdct, stddev_samp(dct_f) OVER s AS sdct
        FROM fr3 WINDOW s AS (PARTITION BY sample_name, Gene))"""], f"""
SELECT file_name, Pos, replicate_name, sample_name, Gene, type_of_gene, good_replicate, keep_this_value,
       {rs('CASE WHEN is_first THEN mv END')} AS mean_value, {rs('CASE WHEN is_first THEN sv END')} AS sd_value,
       {rs('dct_f')} AS deltaCT, {rs('hk')} AS hk_mean_value, {rs('mdct')} AS mean_deltaCT, {rs('sdct')} AS sd_deltaCT
FROM fr4""")
    rpt2 = """
rpt2 AS (
  SELECT n.zscoring_group, n.replicate_name, n.sample_name, n.testing_group, n.Gene, n.type_of_gene,
         CASE WHEN n.is_first THEN n.norm_all END AS normalized_expression,
         CASE WHEN n.is_first THEN n.qc_cur END AS qc_flag,
         z.normalized_expression_mean, z.normalized_expression_sd
  FROM nx2 n LEFT JOIN zs2 z ON z.file_name = n.file_name AND z.Pos = n.Pos)"""
    out["plot_points_recalculated"] = _wrap(rec + [rpt2, points_ctes("rpt2", "r")], f"""
SELECT zscoring_group, sample_name, testing_group, Gene, {rs('normalized_expression')} AS normalized_expression,
       {rs('normalized_expression_mean')} AS normalized_expression_mean,
       {rs('normalized_expression_sd')} AS normalized_expression_sd, qc_flag, ordering, ordering_level
FROM ptsr""")
    out["recalculate_changed"] = out["recalculate"]
    out["recalculate_changed_stats"] = out["recalculate_stats"]
    return out
