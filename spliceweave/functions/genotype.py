"""Genotype strings and VCF INFO fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dosage(gt, unphased: bool = False) -> Column:
    """ALT dosage of a genotype string, by prefix; anything else is NULL.

    Only phased calls count by default. ``unphased=True`` also reads ``0/0`` and so on.
    """
    c = F.col(gt) if isinstance(gt, str) else gt
    head = F.substring(c, 1, 3)
    if unphased:
        head = F.replace(head, F.lit("/"), F.lit("|"))
    return (
        F.when(head == "0|0", 0)
        .when(head.isin("0|1", "1|0"), 1)
        .when(head == "1|1", 2)
        .cast("tinyint")
    )


def info_af(info) -> Column:
    """Allele frequency in a VCF INFO column (``;AF=x;``)."""
    return F.regexp_extract(info, ";AF=([^;]+)", 1).try_cast("double")


def ref_frequency(info) -> Column:
    return F.lit(1.0) - info_af(info)
