"""The same derived relations as common table expressions for the SQL check."""

from __future__ import annotations

from spliceweave.functions.distributions import two_sided_p_sql

READS = """
geo AS (
  SELECT *, CASE WHEN gene % 4 = 0 THEN 0 ELSE q % 3 END AS si FROM (
    SELECT *, CAST(l_quantity AS BIGINT) AS q, l_partkey // 50 AS gene FROM lineitem)),
geo2 AS (SELECT *, CASE WHEN gene % 4 = 0 THEN 0 ELSE si % 2 + 2 * ((q // 3) % 2) END AS ei FROM geo),
reads AS (
  SELECT 'chr' || (gene % 5 + 1) AS chrom,
         CASE WHEN (gene // 5) % 2 = 0 THEN '+' ELSE '-' END AS strand,
         gene * 100000 + si * 1000 AS j_start, gene * 100000 + 10000 + ei * 1000 AS j_end,
         4 + l_linenumber * 2 AS anchor_l, 4 + q % 20 AS anchor_r,
         l_orderkey AS cb, CAST(l_linenumber AS BIGINT) AS umi, l_returnflag <> 'N' AS is_split, gene
  FROM geo2),
junc AS (SELECT * FROM reads WHERE is_split)"""

BARCODES = """
barcodes AS (
  SELECT o_orderkey AS cb, 'D' || c_nationkey AS donor, c_nationkey AS donor_idx,
         'D' || c_nationkey || ':' || (o_custkey % 2 + 1) AS metacell
  FROM orders JOIN customer ON o_custkey = c_custkey),
samples AS (
  SELECT metacell, donor, donor_idx, row_number() OVER (ORDER BY metacell) - 1 AS sample_idx
  FROM (SELECT DISTINCT metacell, donor, donor_idx FROM barcodes))"""

STAT = READS + "," + BARCODES + """,
stat AS (
  SELECT metacell, chrom, strand, j_start, j_end, count(DISTINCT (cb, umi)) AS n
  FROM junc JOIN barcodes USING (cb) GROUP BY ALL)"""

# introns with at least 10 reads in all, their endpoints, and whether they stand alone
INTRONS = STAT + """,
introns AS (
  SELECT chrom, strand, j_start, j_end, CAST(sum(n) AS BIGINT) AS reads FROM stat
  GROUP BY ALL HAVING sum(n) >= 10),
ends AS (
  SELECT chrom, strand, j_start AS pos, 'start' AS side, j_end AS partner, j_start, j_end FROM introns
  UNION ALL
  SELECT chrom, strand, j_end, 'end', j_start, j_start, j_end FROM introns),
touch AS (SELECT chrom, strand, pos, count(*) AS uses FROM ends GROUP BY ALL),
marked AS (
  SELECT i.*, (a.uses = 1 AND b.uses = 1) AS single FROM introns i
  JOIN touch a ON i.chrom = a.chrom AND i.strand = a.strand AND i.j_start = a.pos
  JOIN touch b ON i.chrom = b.chrom AND i.strand = b.strand AND i.j_end = b.pos)"""

# pairwise definition: a competing intron shares the opposite endpoint of an intron using the site
USAGE = INTRONS + """,
rival_ends AS (
  SELECT e.* FROM ends e JOIN marked m USING (chrom, strand, j_start, j_end) WHERE NOT m.single),
members AS (
  SELECT DISTINCT e.chrom, e.strand, e.pos, e.side, r.j_start, r.j_end,
         CASE WHEN e.side = 'start' THEN r.j_start ELSE r.j_end END = e.pos AS own
  FROM rival_ends e JOIN rival_ends r
    ON e.chrom = r.chrom AND e.strand = r.strand AND r.side <> e.side AND r.pos = e.partner),
usage AS (
  SELECT m.chrom, m.strand, m.pos, m.side, s.metacell,
         CAST(sum(CASE WHEN own THEN n ELSE 0 END) AS BIGINT) AS included, CAST(sum(n) AS BIGINT) AS total
  FROM members m JOIN stat s USING (chrom, strand, j_start, j_end) GROUP BY ALL)"""

SPREAD = USAGE + """,
spread AS (
  SELECT chrom, strand, pos, side,
         1e0 - count(*) FILTER (total > 0) / (SELECT count(*) FROM samples)::DOUBLE AS sparsity,
         stddev_samp(included::DOUBLE / total) FILTER (total > 0) AS sd,
         median(included) FILTER (total > 0) AS median_included,
         median(total) FILTER (total > 0) AS median_total
  FROM usage GROUP BY ALL),
kept AS (SELECT * FROM spread WHERE sparsity < 0.5 AND sd > 0.2),
filled AS (
  SELECT k.chrom, k.strand, k.pos, k.side, s.metacell, s.sample_idx, s.donor, s.donor_idx,
         coalesce(u.included, CAST(round_even(k.median_included, 0) AS BIGINT)) AS included,
         coalesce(u.total, CAST(round_even(k.median_total, 0) AS BIGINT)) AS total,
         u.total IS NULL AS imputed
  FROM kept k CROSS JOIN samples s
  LEFT JOIN usage u ON u.chrom = k.chrom AND u.strand = k.strand AND u.pos = k.pos AND u.side = k.side
    AND u.metacell = s.metacell AND u.total > 0)"""

VARIANTS = """
variants AS (
  SELECT p_partkey AS k, 'chr' || (p_partkey % 5 + 1) || ':' || (p_partkey * 2000) || ':A:G' AS snp,
         'chr' || (p_partkey % 5 + 1) AS chrom, p_partkey * 2000 AS snp_pos FROM part)"""

GENOTYPES = VARIANTS + """,
geno AS (
  SELECT snp, k, chrom, snp_pos, d AS donor_idx,
         CAST(((((d + 3) * (k + 7) * 2654435761) % 4294967296) // 65536) % 3 AS INTEGER) AS dosage
  FROM variants CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS d FROM nation))"""

GWAS = f"""
gwas0 AS (
  SELECT event_type AS study, user_id * 13 AS k, (value - 50e0) / 100e0 AS beta,
         0.1e0 + 0.02e0 * (event_id % 5) AS se, event_id FROM events),
gwas AS (
  SELECT *, 'chr' || (k % 5 + 1) || ':' || (k * 2000) AS variant_id, 'chr' || (k % 5 + 1) AS chrom,
         k * 2000 AS snp_pos, {two_sided_p_sql('z')} AS p
  FROM (SELECT *, beta / se AS z FROM gwas0)),
maf AS (
  SELECT 'chr' || (p_partkey % 5 + 1) || ':' || (p_partkey * 2000) AS variant_id,
         0.05e0 + 0.009e0 * p_size AS maf FROM part),
studies AS (
  SELECT study, trait_type, CAST(CASE WHEN trait_type = 'quant' THEN n ELSE low + 1 END * 1000 AS BIGINT) AS n_case,
         CAST(CASE WHEN trait_type = 'quant' THEN 0 ELSE n - low + 1 END * 1000 AS BIGINT) AS n_control
  FROM (SELECT event_type AS study, count(*) AS n, count(*) FILTER (value < 50) AS low,
               CASE WHEN event_type = 'error' THEN 'quant' ELSE 'cc' END AS trait_type FROM events GROUP BY event_type))"""

CELLS = """
cells AS (SELECT vec_id AS cell_id, 'D' || label AS donor, embedding::DOUBLE[] AS pc FROM embeddings),
coords AS (
  SELECT cell_id, donor, unnest(pc) AS x, unnest(generate_series(1, len(pc))) AS dim FROM cells)"""
