"""Shared oracle CTEs in DuckDB SQL, written apart from the DataFrame code they check."""

from deltascreen.plans.registry import cte

cte("fx_genes", """
SELECT gene, CAST(row_number() OVER (ORDER BY gene) - 1 AS INT) AS gene_ord, gene LIKE 'MT-%' AS is_mt
FROM (SELECT DISTINCT CASE WHEN p_brand IN ('Brand#24','Brand#25') THEN concat('MT-', p_brand)
      ELSE p_brand END AS gene FROM part) g
""")
cte("fx_counts", """
SELECT l_orderkey AS cell_id,
       CASE WHEN p_brand IN ('Brand#24','Brand#25') THEN concat('MT-', p_brand) ELSE p_brand END AS gene,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
""")
cte("fx_cells", """
SELECT o_orderkey AS cell_id,
  CASE WHEN o_orderkey % 50 = 0 THEN 'nan' WHEN o_orderkey % 50 = 1 THEN 'Non-Targeting'
       WHEN o_orderkey % 50 = 2 THEN 'Brand#2+Brand#1_3' WHEN o_orderkey % 50 = 3 THEN 'Brand#1+*'
       WHEN o_orderkey % 50 = 4 THEN 'Brand#1_2' ELSE c END AS condition_raw,
  c AS condition, concat('bin_', o_orderstatus) AS bin,
  concat('lane_', CAST(o_orderkey % 4 AS STRING)) AS batch,
  CASE WHEN o_orderkey % 11 = 0 THEN 'nan' WHEN o_orderkey % 11 = 1 THEN 'Brand#1_1;Brand#2_1;Brand#3_2'
       ELSE 'NO_SITE_4' END AS guide
FROM (SELECT *, CASE WHEN o_custkey % 12 = 0 THEN 'control'
        WHEN o_custkey % 12 BETWEEN 1 AND 6 THEN concat('Brand#', CAST(o_custkey % 12 AS STRING))
        WHEN o_custkey % 12 = 7 THEN 'Brand#1+Brand#2' WHEN o_custkey % 12 = 8 THEN 'Brand#3+Brand#4'
        WHEN o_custkey % 12 = 9 THEN 'Brand#1@0.5' WHEN o_custkey % 12 = 10 THEN 'Brand#2@0.25'
        ELSE 'Brand#99' END AS c FROM orders) o
""")
cte("fx_signal", """
SELECT bin, condition AS ko, (count(*) % 7) / 2.0e0 AS snr, (count(*) % 10) / 10.0e0 AS rho,
       (count(*) % 13) / 4.0e0 AS e_distance, (count(*) % 20) / 100.0e0 AS e_test_p
FROM fx_cells WHERE condition <> 'control' GROUP BY 1, 2
""")
cte("fx_relation", """
SELECT 'go' AS kind, a.gene AS src, b.gene AS dst FROM fx_genes a CROSS JOIN fx_genes b
WHERE (a.gene_ord + b.gene_ord) % 5 = 0 AND a.gene <> b.gene
""")
cte("cell_sum", """
SELECT cell_id, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n_genes FROM fx_counts GROUP BY 1
""")
cte("qc_cells", """
SELECT c.*, s.total FROM fx_cells c JOIN cell_sum s ON c.cell_id = s.cell_id WHERE s.n_genes >= 2
""")
cte("hcells", """
SELECT q.*, CASE WHEN n < 2 OR rk <= n // 2 THEN 'first_half' ELSE 'second_half' END AS half
FROM (SELECT *, count(*) OVER (PARTITION BY bin, condition) AS n,
        row_number() OVER (PARTITION BY bin, condition
          ORDER BY md5(concat('42|', bin, '|', condition, '|', CAST(cell_id AS VARCHAR))), cell_id) AS rk
      FROM qc_cells) q
""")
cte("fx_expr", """
SELECT k.cell_id, k.gene, k.cnt, k.cnt * 1e4 / q.total AS v, ln(1 + k.cnt * 1e4 / q.total) AS x
FROM fx_counts k JOIN qc_cells q ON k.cell_id = q.cell_id
""")
cte("ko_set", """
SELECT condition AS ko FROM (
  SELECT condition, bin, half, count(*) AS n FROM hcells WHERE condition <> 'control'
  GROUP BY 1, 2, 3 HAVING count(*) >= 4) t
GROUP BY 1 HAVING count(*) = 2 * (SELECT count(DISTINCT bin) FROM hcells)
""")
cte("ctrl_bulk", """
SELECT b.bin, g.gene, coalesce(s.sx, 0e0) / b.n AS m, b.n AS n_cells
FROM (SELECT bin, count(*) AS n FROM hcells WHERE condition = 'control' GROUP BY 1) b
CROSS JOIN fx_genes g
LEFT JOIN (SELECT h.bin, e.gene, sum(e.x) AS sx FROM fx_expr e JOIN hcells h ON e.cell_id = h.cell_id
           WHERE h.condition = 'control' GROUP BY 1, 2) s ON s.bin = b.bin AND s.gene = g.gene
""")
cte("bulk", """
SELECT b.bin, b.ko, b.half, g.gene, coalesce(s.sx, 0e0) / b.n AS m, b.n AS n_cells
FROM (SELECT bin, condition AS ko, half, count(*) AS n FROM hcells
      WHERE condition IN (SELECT ko FROM ko_set) GROUP BY 1, 2, 3) b
CROSS JOIN fx_genes g
LEFT JOIN (SELECT h.bin, h.condition AS ko, h.half, e.gene, sum(e.x) AS sx
           FROM fx_expr e JOIN hcells h ON e.cell_id = h.cell_id GROUP BY 1, 2, 3, 4) s
  ON s.bin = b.bin AND s.ko = b.ko AND s.half = b.half AND s.gene = g.gene
""")
cte("deltas", """
SELECT a.bin, a.ko, a.gene,
  (a.m * a.n_cells + b.m * b.n_cells) / (a.n_cells + b.n_cells) - c.m AS d_all,
  a.m - c.m AS d_first, b.m - c.m AS d_second,
  (a.m * a.n_cells + b.m * b.n_cells) / (a.n_cells + b.n_cells) AS m_all, c.m AS ctrl
FROM bulk a JOIN bulk b ON a.bin = b.bin AND a.ko = b.ko AND a.gene = b.gene
JOIN ctrl_bulk c ON c.bin = a.bin AND c.gene = a.gene
WHERE a.half = 'first_half' AND b.half = 'second_half'
""")
cte("pairs", "SELECT DISTINCT bin, ko FROM deltas")
cte("kos", "SELECT DISTINCT ko FROM deltas")
cte("folds5", "SELECT CAST(range AS INT) AS fold FROM range(5)")
cte("folds2", "SELECT CAST(range AS INT) AS fold FROM range(2)")


def block_cte(name: str, source: str, keys: str, digest: str, n: int) -> None:
    """Near-equal blocks by ntile, with position and size."""
    cte(name, f"""
SELECT *, count(*) OVER (PARTITION BY block) AS block_size,
  row_number() OVER (PARTITION BY block ORDER BY rk) AS pos
FROM (SELECT *, CAST(ntile({n}) OVER (ORDER BY rk) AS INT) - 1 AS block
      FROM (SELECT {keys}, row_number() OVER (ORDER BY {digest}, {keys}) AS rk FROM {source}) a) b
""")


block_cte("ko_blocks", "kos", "ko", "md5(concat('0|', ko))", 5)
block_cte("single_blocks", "(SELECT ko FROM kos WHERE ko NOT LIKE '%+%' AND ko NOT LIKE '%@%')",
          "ko", "md5(concat('0|', ko))", 5)
block_cte("pair_blocks", "(SELECT bin, ko FROM pairs WHERE ko NOT LIKE '%+%' AND ko NOT LIKE '%@%')",
          "bin, ko", "md5(concat('0|', bin, '|', ko))", 5)
block_cte("dose_blocks", "(SELECT ko FROM kos WHERE ko LIKE '%@%')", "ko", "md5(concat('0|', ko))", 2)
cte("bin_order", """
SELECT bin, row_number() OVER (ORDER BY md5(concat('0|', bin)), bin) - 1 AS place,
  count(*) OVER () AS n_bins FROM (SELECT DISTINCT bin FROM pairs) b
""")
cte("ko_roles", """
SELECT ko, fold, CASE WHEN block = fold THEN 'test'
  WHEN block = (fold + 1) % 5 AND pos <= block_size // 2 THEN 'val' ELSE 'train' END AS label
FROM ko_blocks CROSS JOIN folds5
""")
cte("single_roles", """
SELECT ko, fold, CASE WHEN block = fold THEN 'test'
  WHEN block = (fold + 1) % 5 AND pos <= block_size // 2 THEN 'val' ELSE 'train' END AS label
FROM single_blocks CROSS JOIN folds5
""")
cte("ps_pert", """
SELECT 'UnseenPert' AS scenario, r.fold, p.bin, p.ko, r.label
FROM pairs p JOIN ko_roles r ON p.ko = r.ko
""")
cte("ps_cell", """
SELECT 'UnseenCell' AS scenario, f.fold, p.bin, p.ko,
  CASE WHEN o.place = f.fold THEN 'test' WHEN o.place = (f.fold + 1) % o.n_bins THEN 'val'
       ELSE 'train' END AS label
FROM pairs p JOIN bin_order o ON o.bin = p.bin CROSS JOIN folds5 f
WHERE o.n_bins >= 3 AND f.fold < o.n_bins
""")
cte("ps_both", """
SELECT 'UnseenBoth' AS scenario, f.fold, p.bin, p.ko,
  CASE WHEN r.label IS NULL THEN 'unassigned'
       WHEN r.label = 'test' AND o.place = f.fold % o.n_bins THEN 'test'
       WHEN r.label = 'val' AND o.place = (f.fold % o.n_bins + 1) % o.n_bins THEN 'val'
       ELSE 'train' END AS label
FROM pairs p JOIN bin_order o ON o.bin = p.bin CROSS JOIN folds5 f
LEFT JOIN single_roles r ON r.ko = p.ko AND r.fold = f.fold WHERE o.n_bins >= 2
""")
cte("pair_roles", """
SELECT bin, ko, fold, CASE WHEN block = fold THEN 'test'
  WHEN block = (fold + 1) % 5 AND pos <= block_size // 2 THEN 'val' ELSE 'train' END AS label
FROM pair_blocks CROSS JOIN folds5
""")
cte("ps_pair", """
SELECT 'UnseenPair' AS scenario, fold, bin, ko,
  CASE WHEN NOT has_train AND turn = 1 THEN 'train' ELSE label END AS label
FROM (SELECT *, bool_or(label = 'train') OVER (PARTITION BY fold, ko) AS has_train,
        row_number() OVER (PARTITION BY fold, ko
          ORDER BY CASE WHEN label = 'val' THEN 0 ELSE 1 END, bin) AS turn FROM pair_roles) t
UNION ALL
SELECT 'UnseenPair', fold, bin, ko, 'unassigned' FROM pairs CROSS JOIN folds5
WHERE ko LIKE '%+%' OR ko LIKE '%@%'
""")
cte("ps_dose", """
SELECT 'UnseenDose' AS scenario, f.fold, p.bin, p.ko,
  CASE WHEN b.block = f.fold THEN 'test'
       WHEN b.block = (f.fold + 1) % 2 AND b.pos <= greatest(1, b.block_size // 2) THEN 'val'
       ELSE 'train' END AS label
FROM pairs p CROSS JOIN folds2 f LEFT JOIN dose_blocks b ON b.ko = p.ko
WHERE EXISTS (SELECT 1 FROM dose_blocks)
""")
cte("combo_blocks", """
SELECT *, count(*) OVER (PARTITION BY block) AS block_size,
  row_number() OVER (PARTITION BY block ORDER BY rk) AS pos
FROM (SELECT *, CAST(CASE WHEN n // 2 = 0 THEN 1 ELSE least((rk - 1) // (n // 2), 1) END AS INT) AS block
      FROM (SELECT ko, row_number() OVER (ORDER BY md5(concat('42|', ko)), ko) AS rk,
              count(*) OVER () AS n FROM kos WHERE ko LIKE '%+%') a) b
""")
cte("ps_combo", """
SELECT 'UnseenCombo' AS scenario, f.fold, p.bin, p.ko,
  CASE WHEN b.block = f.fold THEN 'test'
       WHEN b.block = (f.fold + 1) % 2 AND b.pos <= greatest(1, b.block_size // 2) THEN 'val'
       ELSE 'train' END AS label
FROM pairs p CROSS JOIN folds2 f LEFT JOIN combo_blocks b ON b.ko = p.ko
WHERE EXISTS (SELECT 1 FROM combo_blocks)
""")
cte("ps", """
SELECT * FROM ps_pert UNION ALL SELECT * FROM ps_cell UNION ALL SELECT * FROM ps_both
UNION ALL SELECT * FROM ps_pair UNION ALL SELECT * FROM ps_dose UNION ALL SELECT * FROM ps_combo
""")
cte("train", "SELECT scenario, fold, bin, ko FROM ps WHERE label = 'train'")
cte("rect", """
SELECT k.scenario, k.fold, b.bin, k.ko
FROM (SELECT DISTINCT scenario, fold, ko FROM ps WHERE label = 'test') k
JOIN (SELECT DISTINCT scenario, fold, bin FROM ps WHERE label = 'test') b
  ON b.scenario = k.scenario AND b.fold = k.fold
""")

# ---- differential effect -----------------------------------------------------------------
cte("de_cells", """
SELECT h.cell_id, h.bin, h.condition, hh.half FROM hcells h
JOIN (SELECT 'first_half' AS half UNION ALL SELECT 'second_half' UNION ALL SELECT 'all') hh
  ON hh.half = 'all' OR hh.half = h.half
WHERE h.condition = 'control' OR h.condition IN (SELECT ko FROM ko_set)
""")
cte("de_n", "SELECT bin, half, condition, count(*) AS n FROM de_cells GROUP BY 1, 2, 3")
cte("de_hist", """
SELECT d.bin, d.half, d.condition, e.gene, e.v, count(*) AS n
FROM fx_expr e JOIN de_cells d ON d.cell_id = e.cell_id GROUP BY 1, 2, 3, 4, 5
""")
cte("de_full", """
SELECT bin, half, condition, gene, v, n FROM de_hist
UNION ALL
SELECT n.bin, n.half, n.condition, g.gene, 0e0 AS v, n.n - coalesce(z.nnz, 0) AS n
FROM de_n n CROSS JOIN fx_genes g
LEFT JOIN (SELECT bin, half, condition, gene, CAST(sum(n) AS BIGINT) AS nnz FROM de_hist GROUP BY 1, 2, 3, 4) z
  ON z.bin = n.bin AND z.half = n.half AND z.condition = n.condition AND z.gene = g.gene
""")
cte("de_win", """
SELECT *, CASE WHEN condition = 'control' THEN n ELSE 0 END AS nc,
  sum(CASE WHEN condition = 'control' THEN n ELSE 0 END)
    OVER (PARTITION BY bin, half, gene ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_le,
  sum(CASE WHEN condition = 'control' THEN n ELSE 0 END) OVER (PARTITION BY bin, half, gene, v) AS c_eq
FROM de_full
""")
cte("de_ties0", """
SELECT bin, half, gene, sum(CAST(n AS DOUBLE) * n * n - n) AS t0, sum(n * ln(1 + v)) AS sx0,
  sum(n) AS n0, CAST(sum(CASE WHEN v > 0 THEN n ELSE 0 END) AS BIGINT) AS nnz0
FROM de_win WHERE condition = 'control' GROUP BY 1, 2, 3
""")
cte("de_stats", """
SELECT w.bin, w.half, w.condition AS ko, w.gene, sum(w.n) AS n1,
  sum(w.n * (w.c_le - w.c_eq + w.c_eq / 2.0e0)) AS u,
  sum((CAST(w.c_eq + w.n AS DOUBLE) ** 3 - (w.c_eq + w.n)) - (CAST(w.c_eq AS DOUBLE) ** 3 - w.c_eq)) AS t1,
  sum(w.n * ln(1 + w.v)) AS sx1, CAST(sum(CASE WHEN w.v > 0 THEN w.n ELSE 0 END) AS BIGINT) AS nnz1
FROM de_win w JOIN de_n n ON n.bin = w.bin AND n.half = w.half AND n.condition = w.condition
WHERE w.condition <> 'control' AND n.n >= 4 GROUP BY 1, 2, 3, 4
""")
cte("de_z", """
SELECT s.bin, s.half, s.ko, s.gene, s.u, s.nnz1, c.nnz0,
  CASE WHEN var > 1e-9 THEN (s.u - s.n1 * c.n0 / 2.0e0) / sqrt(var) ELSE 0e0 END AS z, var,
  CASE WHEN s.nnz1 = 0 AND c.nnz0 = 0 THEN 1e0 WHEN c.nnz0 = 0 THEN 20e0 WHEN s.nnz1 = 0 THEN 1 / 20e0
       ELSE (exp(s.sx1 / s.n1) - 1) / (exp(c.sx0 / c.n0) - 1) END AS fc,
  (s.nnz1 = 0) <> (c.nnz0 = 0) AS substituted
FROM (SELECT s.*, c.n0 * s.n1 / 12.0e0 * ((c.n0 + s.n1 + 1)
        - (c.t0 + s.t1) / (CAST(c.n0 + s.n1 AS DOUBLE) * (c.n0 + s.n1 - 1))) AS var
      FROM de_stats s JOIN de_ties0 c ON c.bin = s.bin AND c.half = s.half AND c.gene = s.gene) s
JOIN de_ties0 c ON c.bin = s.bin AND c.half = s.half AND c.gene = s.gene
""")
cte("de_p", """
SELECT *, CASE WHEN var > 1e-9 THEN least(1e0, t * exp(-zz * zz - 1.26551223e0 + t * (1.00002368e0 + t * (0.37409196e0
  + t * (0.09678418e0 + t * (-0.18628806e0 + t * (0.27886807e0 + t * (-1.13520398e0 + t * (1.48851587e0
  + t * (-0.82215223e0 + t * 0.17087277e0)))))))))) ELSE 1e0 END AS p
FROM (SELECT *, abs(z) / sqrt(2e0) AS zz, 1 / (1 + 0.5e0 * abs(z) / sqrt(2e0)) AS t FROM de_z) q
""")
cte("deg", """
SELECT bin, half, ko, gene, u, z, p, fc, substituted, log2(fc) AS score,
  least(1e0, min(p * m / rk) OVER (PARTITION BY bin, half ORDER BY rk DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj
FROM (SELECT *, count(*) OVER (PARTITION BY bin, half) AS m,
        row_number() OVER (PARTITION BY bin, half ORDER BY p, ko, gene) AS rk FROM de_p) q
""")
cte("gw", """
SELECT bin, ko, gene, CASE WHEN top > 0 THEN a / top ELSE 0e0 END AS w, p < 0.2 AS deg,
  CAST(CASE WHEN p < 0.2 THEN sign(score) ELSE 0 END AS INT) AS dir
FROM (SELECT *, max(a) OVER (PARTITION BY bin, ko) AS top
      FROM (SELECT *, CASE WHEN p < 0.2 AND NOT substituted THEN abs(score) ELSE 0e0 END AS a
            FROM deg WHERE half = 'all') q) r
""")
cte("norm_stats", """
SELECT scenario, fold, gene, avg(m) AS mu, greatest(stddev_pop(m), 1e-6) AS sigma, count(*) AS n_samples
FROM (SELECT t.scenario, t.fold, d.gene, d.m_all AS m FROM train t JOIN deltas d ON d.bin = t.bin AND d.ko = t.ko
      UNION ALL SELECT b.scenario, b.fold, c.gene, c.m FROM (SELECT DISTINCT scenario, fold, bin FROM train) b
      JOIN ctrl_bulk c ON c.bin = b.bin) q GROUP BY 1, 2, 3
""")
