"""Composite string keys: ``chrom:strand:pos``, ``chrom:pos:ref:alt``, ``donor:index`` and kin."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(col, k: int, delim: str = ":") -> Column:
    """k-th token (1-based) of a delimited string, NULL when the string is too short."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(F.split(c, re.escape(delim)), F.lit(k))


def joined(*cols, delim: str = ":") -> Column:
    """Tokens pasted back together with a delimiter."""
    return F.concat_ws(delim, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def site_key(chrom="chrom", strand="strand", pos="pos") -> Column:
    return joined(chrom, strand, pos)


def intron_key(chrom="chrom", strand="strand", start="j_start", end="j_end") -> Column:
    return joined(chrom, strand, start, end)


def parse_site(col) -> Column:
    """``chrom:strand:pos`` to a struct."""
    return F.struct(
        token(col, 1).alias("chrom"),
        token(col, 2).alias("strand"),
        token(col, 3).try_cast("bigint").alias("pos"),
    )


def parse_intron(col) -> Column:
    """``chrom:strand:start:end`` to a struct with start <= end."""
    a, b = token(col, 3).try_cast("bigint"), token(col, 4).try_cast("bigint")
    return F.struct(
        token(col, 1).alias("chrom"),
        token(col, 2).alias("strand"),
        F.least(a, b).alias("j_start"),
        F.greatest(a, b).alias("j_end"),
    )


def parse_variant(col) -> Column:
    """``chrom:pos[:ref:alt]`` to a struct; ref and alt are NULL when absent."""
    return F.struct(
        token(col, 1).alias("chrom"),
        token(col, 2).try_cast("bigint").alias("pos"),
        token(col, 3).alias("ref"),
        token(col, 4).alias("alt"),
    )


def variant_locus(col, upper: bool = True) -> Column:
    """Drop the alleles: ``chr1:5:A:T`` becomes ``CHR1:5`` (upper-cased for GWAS joins)."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.upper(c) if upper else c
    return joined(token(c, 1), token(c, 2))


def donor_of(sample) -> Column:
    """Donor part of a ``donor:index`` metacell name."""
    return token(sample, 1)


def metacell_name(donor="donor", index="meta") -> Column:
    return joined(donor, index)


def cell_barcode(batch_ind, barcode) -> Column:
    """Split ``batch:individual`` and ``[library_]barcode-1`` into their parts.

    Batch ``Source`` carries the library as a prefix of the barcode, other batches do not.
    """
    bare = F.col(barcode) if isinstance(barcode, str) else barcode
    batch = token(batch_ind, 1)
    from_source = batch == F.lit("Source")
    tail = F.when(from_source, token(bare, 2, "_")).otherwise(bare)
    return F.struct(
        batch.alias("batch"),
        token(batch_ind, 2).alias("ind"),
        F.when(from_source, token(bare, 1, "_")).alias("lib"),
        token(tail, 1, "-").alias("cb"),
    )


def drop_suffix(col, n: int = 3) -> Column:
    """String without its last ``n`` characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def strip_chr(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "^chr", "")


def count_pair(included="included", total="total") -> Column:
    """``included:total`` text cell."""
    return F.concat_ws(":", F.col(included).cast("string"), F.col(total).cast("string"))


def parse_count_pair(col) -> Column:
    return F.struct(
        token(col, 1).try_cast("bigint").alias("included"),
        token(col, 2).try_cast("bigint").alias("total"),
    )
