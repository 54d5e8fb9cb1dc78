"""Null models: one fit per site, kept for every later score test."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.operators.blocks import over_block_pairs, salted
from spliceweave.operators.components import connected_components
from spliceweave.operators.glmm import Families, Projectors, at_once, fit_many
from spliceweave.session import cut_lineage, ship_package

NULL_SCHEMA = (
    "site string, chrom string, strand string, pos bigint, status string, sqrt_r double, tau_g double, "
    "sample_idx array<int>, residuals array<double>, pi array<double>, total array<double>, y array<double>, "
    "resid array<double>, w array<double>, xw array<double>, xwx_inv array<double>, xr array<double>"
)
#: What the marker ratio needs of a site besides: the entries of Z' V^-1 Z inside families, V^-1 X at donor level and (X' V^-1 X)^-1.
FORM = "top_i array<int>, top_j array<int>, top array<double>, zx array<double>, cov array<double>"
TAU_FLOOR = 1e-6


def dense_vector(idx: str, value: str, size) -> Column:
    """Aggregate (index, value) rows to a dense ARRAY<DOUBLE>, zeros where absent: gaps between the sorted entries are filled in one pass."""
    entry = F.struct(F.col(idx).cast("int").alias("i"), F.col(value).cast("double").alias("v"))
    rows = F.array_sort(F.collect_list(entry))
    ends = F.transform(rows, lambda e, at: F.struct(e["i"].alias("i"), e["v"].alias("v"), F.coalesce(F.get(rows, at - 1)["i"], F.lit(-1)).alias("before")))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    filled = F.flatten(F.transform(ends, lambda e: F.concat(zeros(e["i"] - e["before"] - 1), F.array(e["v"]))))
    return F.concat(filled, zeros((F.lit(size) - F.size(filled)).cast("int")))


def design_table(
    samples: DataFrame, covariates: DataFrame | None = None, grm: DataFrame | None = None,
    markers: DataFrame | None = None, grm_min: float | None = None, sample: str = "metacell",
) -> DataFrame:
    """One row per sample with its covariates, and apart from these (their sample is NULL) one row per donor with family and GRM row, and its markers.

    ``samples`` (sample, sample_idx, donor_idx), ``covariates`` (sample, x ARRAY), ``grm``
    (i, j, k) over donor indices, ``markers`` (donor_idx, dosage ARRAY); many markers can come in parts (part, donor_idx, dosage ARRAY), a row
    for each part of a donor, the markers of a part in one order. Relatedness below
    ``grm_min`` counts as zero, and donors that are linked by what is left form a family. Without a GRM donors are unrelated;
    with one, a sample of a donor that it lacks fails the job that reads the design.
    """
    out = samples.select(sample, "sample_idx", "donor_idx")
    if covariates is not None:
        out = out.join(covariates.select(sample, "x"), sample)
    else:
        out = out.withColumn("x", F.array().cast("array<double>"))
    per_donor = None
    if grm is not None:
        kin = grm.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("k").cast("double").alias("k"))
        labelled = kin.select(F.col("i").alias("donor_idx")).distinct()
        known = out.join(labelled.withColumn("__known", F.lit(True)), "donor_idx", "left")
        fail = F.raise_error(F.concat(F.lit("the GRM lacks donor "), F.col("donor_idx").cast("string"))).cast("int")
        out = known.select(sample, "sample_idx", F.when(F.col("__known"), F.col("donor_idx")).otherwise(fail).alias("donor_idx"), "x")
        kept = cut_lineage(kin if grm_min is None else kin.filter(F.col("k") >= grm_min))
        families = labelled
        linked = kept.filter((F.col("i") != F.col("j")) & (F.col("k") != 0))
        if linked.isEmpty():
            families = families.withColumn("family", F.col("donor_idx"))
        else:
            found = connected_components(linked, "i", "j").select(F.col("node").alias("donor_idx"), F.col("component").alias("family"))
            families = families.join(found, "donor_idx", "left").select("donor_idx", F.coalesce("family", "donor_idx").alias("family"))
        entries = kept.groupBy(F.col("i").alias("donor_idx")).agg(F.collect_list(F.struct("j", "k")).alias("__kin"))
        per_donor = families.join(entries, "donor_idx", "left").select(
            "donor_idx", "family", F.col("__kin.j").alias("kin_idx"), F.col("__kin.k").alias("kin_val"))
    out = out if per_donor is None else out.unionByName(per_donor, allowMissingColumns=True)
    if markers is not None:
        part = F.col("part").cast("bigint") if "part" in markers.columns else F.lit(0).cast("bigint")
        out = out.unionByName(markers.select(
            F.col("donor_idx").cast("int").alias("donor_idx"), part.alias("part"), F.col("dosage").cast("array<double>").alias("marker")), allowMissingColumns=True)
    return out


def missing_donors(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Donors of the samples that the GRM does not label (should be empty)."""
    return samples.select("donor").distinct().join(labels.select("donor"), "donor", "left_anti")


def _kin_of(design: pd.DataFrame, n_donors: int, related: bool) -> Families:
    """Relatedness by family, from the donor rows of a block's design."""
    donors = design[design["metacell"].isna()]
    if not ("kin_idx" in donors and related and donors["kin_idx"].notna().any()):
        return Families.unrelated(n_donors)
    rows = donors[donors["kin_idx"].notna()]
    family = np.arange(n_donors) + n_donors  # donors without an entry stay alone
    family[rows["donor_idx"].astype(int)] = rows["family"].astype(int)
    cols = np.concatenate(rows["kin_idx"].to_numpy()).astype(int)
    return Families.of(family, np.repeat(rows["donor_idx"].to_numpy(int), rows["kin_idx"].str.len()), cols, np.concatenate(rows["kin_val"].to_numpy()))


def adjusted_score(resid, w, xw, xwx_inv, xr, g):
    """Score and variance of genotype columns ``g`` (donors x m) given donor sums of one site."""
    xwg = xw.T @ g
    back = xwx_inv @ xwg
    return resid @ g - xr @ back, w @ (g * g) - np.sum(xwg * back, axis=0)


def permuted_ratio(sums, donors: np.ndarray, n_perm: int, rng: np.random.Generator, entries: int = 1 << 17) -> float:
    """Variance of the scores of a synthetic genotype, permuted over ``donors``, against what is expected; some permutations at a time."""
    resid, w, xw, inv, xr = sums
    part = resid[donors], w[donors], xw[donors], inv, xr
    base = rng.binomial(2, 0.5, len(donors)).astype(float)
    some = max(1, entries // len(donors))
    found, expected = 0.0, 0.0
    for lo in range(0, n_perm, some):
        g = rng.permuted(np.tile(base, (min(some, n_perm - lo), 1)), axis=1).T
        s, v = adjusted_score(*part, g)
        found, expected = found + np.sum(s * s), expected + np.sum(v)
    return found / expected if expected > 0 else np.nan


@dataclass
class MarkerForms:
    """g' P g and g' W g (adjusted for the covariates) of markers g, which are constant inside a donor, for some sites at donor level.

    ``w`` (sites x donors, zero where a site lacks a donor), ``xw`` and ``zx`` (sites x donors x columns), ``inv`` and ``cov`` (sites x columns x columns);
    ``top`` are weights (sites x pairs) of the products of the donors ``i`` and ``j``, which are pairs inside families, so work follows the sum of squared family sizes.
    """

    w: np.ndarray
    xw: np.ndarray
    inv: np.ndarray
    i: np.ndarray
    j: np.ndarray
    top: np.ndarray
    zx: np.ndarray
    cov: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[tuple], n_donors: int) -> MarkerForms:
        """From the columns w, xw, xwx_inv, top_i, top_j, top, zx and cov of each site."""
        w, xw, inv, i, j, top, zx, cov = zip(*rows, strict=True)
        n = len(w)
        square = lambda v: np.vstack(v).reshape(n, math.isqrt(len(v[0])), -1)
        code = np.concatenate(i).astype(np.int64) * n_donors + np.concatenate(j)
        pairs, at = np.unique(code, return_inverse=True)
        weights = np.zeros((n, len(pairs)))
        weights[np.repeat(np.arange(n), [len(v) for v in top]), at] = np.concatenate(top)
        by_donor = lambda v: np.vstack(v).reshape(n, n_donors, -1)
        return cls(np.vstack(w), by_donor(xw), square(inv), pairs // n_donors, pairs % n_donors, weights, by_donor(zx), square(cov))

    def sums(self, marks: np.ndarray, some: int = 512, pairs: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the markers (donors x markers) of g' P g / g' W g of each site, and how many had a variance. Missing dosages take the mean of the site's donors."""
        used = (self.w > 0).any(axis=0)
        total, count = np.zeros(len(self.w)), np.zeros(len(self.w), np.int64)
        for lo in range(0, marks.shape[1], some):
            g = np.where(used[:, None], marks[:, lo:lo + some], 0.0)
            missing = np.isnan(g).any(axis=0)
            parts = [(slice(None), g[:, ~missing])]
            if missing.any():
                for at in range(len(self.w)):
                    mine = self.w[at] > 0
                    own = g[np.ix_(mine, missing)]
                    seen = ~np.isnan(own)
                    known = seen.any(axis=0)  # a marker that no donor of the site has does not count
                    own, seen = own[:, known], seen[:, known]
                    filled = np.zeros((len(g), known.sum()))
                    filled[mine] = np.where(seen, own, np.where(seen, own, 0.0).sum(axis=0) / seen.sum(axis=0))
                    parts.append((slice(at, at + 1), filled))
            for sites, x in parts:
                found = self._ratios(sites, x, pairs)
                total[sites] += found[0]
                count[sites] += found[1]
        return total, count

    def _ratios(self, sites: slice, g: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        def explained(x, inv):
            n, nd, p = x.shape
            xg = (x.transpose(0, 2, 1).reshape(n * p, nd) @ g).reshape(n, p, -1)
            return np.sum(xg * (inv @ xg), axis=1)

        plain = self.w[sites] @ (g * g)
        low = plain - explained(self.xw[sites], self.inv[sites])
        top = -explained(self.zx[sites], self.cov[sites])
        for lo in range(0, len(self.i), pairs):
            at = slice(lo, lo + pairs)
            top += self.top[sites, at] @ (g[self.i[at]] * g[self.j[at]])
        use = low > 1e-9 * np.maximum(plain, 1.0)
        return np.sum(np.where(use, top, 0.0) / np.where(use, low, 1.0), axis=1), use.sum(axis=1)


def marker_form(p: Projectors, donors: np.ndarray, n_donors: int) -> dict:
    """The columns of ``FORM`` of the one model in ``p``; ``donors`` are the indices of the model's donors, in the order of ``p``."""
    mine = np.unique(p.donor)
    index = np.full(p.kin.n, -1)
    index[mine] = donors
    found = []
    for (members, _), m in zip(p.kin.stacks, p.m, strict=True):
        r, c = np.triu_indices(members.shape[1])
        a = p.a[0][members]
        core = np.where(r == c, a[:, r], 0.0) - a[:, r] * m[0][:, r, c] * a[:, c] * np.where(r == c, 1.0, 2.0)
        i, j = index[members[:, r]], index[members[:, c]]
        here = (i >= 0) & (j >= 0)
        found.append((np.minimum(i, j)[here], np.maximum(i, j)[here], core[here]))
    zx = np.zeros((n_donors, len(p.cov[0])))
    zx[donors] = p.to_donor(p.vix)[0][:, mine].T
    i, j, top = (np.concatenate(v) for v in zip(*found, strict=True))
    return {"top_i": i.astype("int32"), "top_j": j.astype("int32"), "top": top, "zx": zx.ravel(), "cov": p.cov[0].ravel()}


def marker_ratio(p: Projectors, w, x, xwx_inv, marks: np.ndarray, donors: np.ndarray, some: int = 512) -> float:
    """Mean of g' P g over g' W g of all markers, adjusted for the covariates, of the one model in ``p``.

    ``donors`` are the rows of ``marks`` that the model's donors have, in the order of ``p``. Markers are constant inside a donor, so both forms are taken to donor level once and a marker costs no more than the donors squared.
    """
    donor = np.asarray(donors)[np.unique(p.donor, return_inverse=True)[1]]
    form = marker_form(p, donors, len(marks))
    _, wd, xw, _, _ = donor_level(np.zeros(len(donor)), w, x.T, donor, len(marks))
    total, count = MarkerForms.of([(wd, xw.ravel(), xwx_inv.ravel(), *form.values())], len(marks)).sums(marks, some)
    return total[0] / count[0] if count[0] else np.nan


def marker_ratios(
    models: DataFrame, design: DataFrame, n_donors: int, site_rows: int = 256, piece_rows: int = 16, entries: int = 1 << 13, together: tuple[int, int] = (16, 16),
) -> DataFrame:
    """(site, total, count): the ratios of all markers of the design summed for each of ``models``, a stored table with the columns of ``FORM``.

    Markers are cut into pieces of about ``entries`` dosages (stored tables are read some thousand rows at once), and every site meets every piece in
    bounded groups; a pair of blocks returns one row a site.
    """
    step = max(1, entries // n_donors)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("marker") - 1) / step).cast("int")), lambda i: F.slice("marker", i * step + 1, F.lit(step)))
    long = design.filter(F.size("marker") > 0).select("part", "donor_idx", F.posexplode(cut).alias("at", "dosage"))
    rows = long.groupBy("part", "at").agg(F.collect_list(F.struct("donor_idx", "dosage")).alias("d"))
    pieces = cut_lineage(rows.select(
        F.xxhash64("part", "at").alias("piece"), F.col("d.donor_idx").alias("donors"), F.flatten("d.dosage").alias("dosage"),
        F.transform("d", lambda e: F.size(e["dosage"])).alias("lengths")))
    columns = ["w", "xw", "xwx_inv", *(c.split()[0] for c in FORM.split(", "))]
    widest = models.agg(F.max(F.size("top"))).first()[0] or 1
    site_rows = max(1, min(site_rows, (1 << 20) // widest))

    def run(sites: pd.DataFrame, markers: pd.DataFrame) -> pd.DataFrame:
        forms = MarkerForms.of([tuple(r) for r in sites[columns].itertuples(index=False)], n_donors)
        parts = []
        for m in markers.itertuples():
            if len(set(m.lengths)) > 1:
                raise ValueError("donors differ in their number of markers")
            parts.append(np.full((n_donors, m.lengths[0]), np.nan))
            parts[-1][m.donors.astype(int)] = m.dosage.reshape(len(m.donors), -1)
        total, count = forms.sums(np.concatenate(parts, axis=1))
        return pd.DataFrame({"site": sites.site, "total": total, "count": count})

    left, right, groups = salted(models.select("site", *columns), pieces, "site", "piece")
    parts = over_block_pairs(left, right, groups, ["site"], ["piece"], site_rows, piece_rows, run, "site string, total double, count bigint", together)
    return parts.groupBy("site").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))


def sample_grid(rows: pd.DataFrame, model: np.ndarray, models: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The samples that any model covers, ordered by donor, the column of each row, and counts as models x samples (zero where absent).

    ``rows`` has sample_idx, donor_idx, included and total > 0; rows of a model that repeat a sample get columns of their own.
    """
    again = rows.groupby([model, "sample_idx"]).cumcount().to_numpy()
    key = rows.sample_idx.to_numpy(np.int64) * (again.max() + 1) + again
    keys, first, code = np.unique(key, return_index=True, return_inverse=True)
    samples = rows.iloc[first].assign(key=keys)
    order = np.argsort(samples.donor_idx.to_numpy(), kind="stable")
    column = np.argsort(order)[code]
    y, n = np.zeros((2, models, len(keys)))
    y[model, column], n[model, column] = rows.included.to_numpy(float), rows.total.to_numpy(float)
    return samples.iloc[order], column, y, n


def _block_fitter(n_donors, max_iter, tol, mode, n_perm, seed):
    def run(rows: pd.DataFrame, kin: Families) -> list[dict]:
        rows = rows[rows.total > 0]
        if rows.empty:
            return []
        site, names = pd.factorize(rows.site)
        heads = rows.iloc[np.unique(site, return_index=True)[1]]
        samples, _, y, n = sample_grid(rows, site, len(names))
        donor = samples.donor_idx.to_numpy(int)
        x = np.column_stack([np.ones(len(samples)), *np.vstack(samples.x.to_numpy()).T])
        by_sample = np.argsort(samples.key.to_numpy())
        touched, local = kin.touching(np.unique(donor))
        order = np.argsort(local[donor], kind="stable")  # ``fit_many`` wants families' indices in order
        some, out = at_once(len(samples), x.shape[1], touched), []
        for lo in range(0, len(names), some):
            at = slice(lo, lo + some)
            fits = fit_many(y[at][:, order], n[at][:, order], x[order].T[None], local[donor][order], touched, max_iter, tol)
            pi = np.empty(fits.pi.shape)
            pi[:, order] = fits.pi
            for b, head in enumerate(heads.iloc[at].itertuples()):
                if mode == "sample" and (fits.status[b] != "Converged" or fits.tau_g[b] <= TAU_FLOOR):
                    continue
                mine = by_sample[n[lo + b][by_sample] > 0]
                yb, nb, pb, xb, db = y[lo + b, mine], n[lo + b, mine], pi[b, mine], x[mine], donor[mine]
                res, w = yb - nb * pb, nb * pb * (1 - pb)
                resid, wd, xw, xwx_inv, xr = donor_level(res, w, xb, db, n_donors)
                r, form = np.nan, {}
                if mode == "permute":
                    r = permuted_ratio((resid, wd, xw, xwx_inv, xr), np.unique(db), n_perm, np.random.default_rng([seed, zlib.crc32(head.site.encode())]))
                else:
                    part, near = touched.touching(np.unique(local[db]))
                    turn = np.argsort(near[local[db]], kind="stable")
                    ids = near[local[db]][turn]
                    first = np.unique(ids, return_index=True)[1]
                    p = Projectors((w / (1 + fits.tau_o[b] * w))[None, turn], ids, part, fits.tau_g[[b]], xb[turn].T[None])
                    form = marker_form(p, db[turn][first], n_donors)
                out.append({
                    "site": head.site, "chrom": head.chrom, "strand": head.strand, "pos": head.pos, "status": fits.status[b],
                    "sqrt_r": float(np.sqrt(r)), "tau_g": fits.tau_g[b], "sample_idx": samples.sample_idx.to_numpy("int32")[mine],
                    "residuals": res, "pi": pb, "total": nb, "y": yb, "resid": resid, "w": wd, "xw": xw.ravel(),
                    "xwx_inv": xwx_inv.ravel(), "xr": xr, **form})
        return out

    return run


def donor_level(res, w, x, donor, n_donors):
    """Sums over a donor's samples that a score test needs."""
    by_donor = lambda v: np.bincount(donor, v, n_donors)
    xw = np.stack([by_donor(w * c) for c in x.T], axis=1)
    return by_donor(res), by_donor(w), xw, np.linalg.pinv((x.T * w) @ x), x.T @ res


def fit_null(
    pheno: DataFrame,
    design: DataFrame,
    n_donors: int,
    max_iter: int = 30,
    tol: float = 1e-3,
    mode: str = "permute",
    n_perm: int = 1000,
    seed: int = 0,
    related: bool = True,
    sample: str = "metacell",
    site_rows: int = 256,
) -> DataFrame:
    """Fit the null model of every site.

    ``pheno`` (site, chrom, strand, pos, sample, included, total) is cut into blocks of about ``site_rows``
    sites; each block meets one copy of the design, so samples and the GRM are shuffled once per
    block and not per site, and its sites are fitted together (``fit_many``), as many at once as bounded arrays hold. ``mode`` estimates the variance
    ratio by permuting a synthetic genotype over donors (``permute``) or from real markers
    (``sample``, which drops sites without a converged positive genetic variance). Besides the
    per-sample arrays a row keeps donor-level sums, all that a score test needs. Markers never reach the fits: fits are stored with what the
    ratio needs at donor level, and meet the markers in bounded groups afterwards (``marker_ratios``).
    """
    if mode not in ("permute", "sample"):
        raise ValueError("mode must be permute or sample")
    spark = pheno.sparkSession
    ship_package(spark)
    sites = pheno.agg(F.approx_count_distinct("site")).first()[0]
    blocks = max(spark.sparkContext.defaultParallelism if sites > 1 else 1, math.ceil(sites / site_rows))
    rows = pheno.select("site", "chrom", "strand", "pos", F.col(sample).alias("metacell"), "included", "total").withColumn(
        "block", F.pmod(F.xxhash64("site"), F.lit(blocks)).cast("int"))
    plain = design
    if "marker" in design.columns:
        plain = design.filter(F.col("marker").isNull() | F.col("kin_idx").isNotNull() if "kin_idx" in design.columns else F.col("marker").isNull()).drop("marker", "part")
    elif mode == "sample":
        raise ValueError("mode sample needs a design with markers")
    copies = plain.withColumnRenamed(sample, "metacell").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fit_block = _block_fitter(n_donors, max_iter, tol, mode, n_perm, seed)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = right.loc[right["metacell"].notna(), ["metacell", "sample_idx", "donor_idx", "x"]]
        return pd.DataFrame(fit_block(left.merge(known, on="metacell"), _kin_of(right, n_donors, related)))

    # rows are few bytes for the work they make, so blocks are dealt to tasks by number and not by size
    fits = rows.repartition(blocks, "block").groupBy("block").cogroup(copies.repartition(blocks, "block").groupBy("block")).applyInPandas(
        run, f"{NULL_SCHEMA}, {FORM}" if mode == "sample" else NULL_SCHEMA)
    if mode != "sample":
        return fits
    models = cut_lineage(fits)
    sums = marker_ratios(models, design, n_donors).select(F.col("site").alias("__site"), F.col("total").alias("__total"), F.col("count").alias("__count"))
    ratio = F.when(F.col("__count").isNull(), F.raise_error(F.lit("the design has no markers")).cast("double")).when(
        (F.col("__count") > 0) & (F.col("__total") >= 0), F.sqrt(F.col("__total") / F.col("__count")))
    return models.join(sums, F.col("site").eqNullSafe(F.col("__site")), "left").withColumn("sqrt_r", ratio).select(*[c.split()[0] for c in NULL_SCHEMA.split(", ")])


def donor_sums(models: DataFrame, design: DataFrame, n_donors: int, sample: str = "metacell") -> DataFrame:
    """Models with the donor-level sums of the score test, from their sample arrays (as read from text) and the design.

    ``models`` has site, chrom, strand, pos, sqrt_r and the arrays sample_idx, residuals, pi, total. Samples that the
    site does not cover (total 0) do not count.
    """
    ship_package(models.sparkSession)
    rows = (
        models.select("site", "chrom", "strand", "pos", "sqrt_r", F.inline(F.arrays_zip("sample_idx", "residuals", "pi", "total")))
        .filter("total > 0").join(design.filter(F.col(sample).isNotNull()).select("sample_idx", "donor_idx", "x"), "sample_idx")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_idx")
        head = pdf.iloc[0]
        x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf.x.to_numpy())]) if len(pdf.x.iloc[0]) else np.ones((len(pdf), 1))
        n, pi = pdf.total.to_numpy(float), pdf.pi.to_numpy(float)
        resid, w, xw, inv, xr = donor_level(pdf.residuals.to_numpy(float), n * pi * (1 - pi), x, pdf.donor_idx.to_numpy(int), n_donors)
        return pd.DataFrame([{"site": head.site, "chrom": head.chrom, "strand": head.strand, "pos": head.pos, "sqrt_r": head.sqrt_r,
                              "resid": resid, "w": w, "xw": xw.ravel(), "xwx_inv": inv.ravel(), "xr": xr}])

    return rows.groupBy("site").applyInPandas(
        run, "site string, chrom string, strand string, pos bigint, sqrt_r double, resid array<double>, w array<double>, xw array<double>, "
             "xwx_inv array<double>, xr array<double>")


def fit_intercept_only(pheno: DataFrame, n_donors: int) -> DataFrame:
    """Closed-form null without covariates or random effects, as plain aggregates.

    ``pheno`` carries ``donor_idx``. Useful for screening and as an exact check of the kernels.
    """
    key = ["site", "chrom", "strand", "pos"]
    by_donor = pheno.groupBy(*key, "donor_idx").agg(F.sum("included").alias("y"), F.sum("total").alias("n"))
    rate = by_donor.groupBy(*key).agg((F.sum("y") / F.sum("n")).alias("rate"))
    scored = (
        by_donor.join(rate, key).filter("rate > 0 AND rate < 1")
        .withColumn("__r", F.col("y") - F.col("n") * F.col("rate"))
        .withColumn("__w", F.col("n") * F.col("rate") * (1 - F.col("rate")))
    )
    return scored.groupBy(*key).agg(
        dense_vector("donor_idx", "__r", n_donors).alias("resid"),
        dense_vector("donor_idx", "__w", n_donors).alias("w"),
        F.sum("__w").alias("__sw"),
        F.sum("__r").alias("__sr"),
    ).select(
        *key, F.lit(1.0).alias("sqrt_r"), "resid", "w", F.col("w").alias("xw"),
        F.array(1.0 / F.col("__sw")).alias("xwx_inv"), F.array("__sr").alias("xr"))


def fitted_sites(null_models: DataFrame) -> DataFrame:
    """Sites whose null model was built."""
    return null_models.filter(F.col("status").isin("Converged", "Fixed")).select("site")


def working_residuals(null_models: DataFrame) -> DataFrame:
    """(site, sample_idx, y / total - pi) from the stored arrays."""
    zipped = F.arrays_zip("sample_idx", "y", "total", "pi")
    return null_models.select("site", F.inline(zipped)).select(
        "site", "sample_idx", (F.try_divide("y", "total") - F.col("pi")).alias("working_residual"))
