"""Nucleotide and amino-acid sequence features, as arrays of doubles or named columns. Null and empty sequences give zeros."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ATGC"
# Molecular weight, isoelectric point, hydrophobicity, charge at pH 7, volume, surface area, flexibility.
AMINO_ACIDS = {
    "A": (89.09, 6.00, 1.8, 0, 88.6, 115.0, 0.360),
    "R": (174.20, 10.76, -4.5, 1, 173.4, 225.0, 0.530),
    "N": (132.12, 5.41, -3.5, 0, 114.1, 160.0, 0.460),
    "D": (133.10, 2.77, -3.5, -1, 111.1, 150.0, 0.510),
    "C": (121.16, 5.07, 2.5, 0, 108.5, 135.0, 0.350),
    "E": (147.13, 3.22, -3.5, -1, 138.4, 190.0, 0.500),
    "Q": (146.15, 5.65, -3.5, 0, 143.8, 180.0, 0.490),
    "G": (75.03, 5.97, -0.4, 0, 60.1, 75.0, 0.540),
    "H": (155.16, 7.59, -3.2, 0, 153.2, 195.0, 0.320),
    "I": (131.17, 6.02, 4.5, 0, 166.7, 175.0, 0.460),
    "L": (131.17, 5.98, 3.8, 0, 166.7, 170.0, 0.400),
    "K": (146.19, 9.74, -3.9, 1, 168.6, 200.0, 0.470),
    "M": (149.21, 5.74, 1.9, 0, 162.9, 185.0, 0.410),
    "F": (165.19, 5.48, 2.8, 0, 189.9, 210.0, 0.310),
    "P": (115.13, 6.30, -1.6, 0, 122.7, 145.0, 0.510),
    "S": (105.09, 5.68, -0.8, 0, 89.0, 115.0, 0.510),
    "T": (119.12, 5.60, -0.7, 0, 116.1, 140.0, 0.440),
    "W": (204.23, 5.89, -0.9, 0, 227.8, 255.0, 0.310),
    "Y": (181.19, 5.66, -1.3, 0, 193.6, 230.0, 0.420),
    "V": (117.15, 5.96, 4.2, 0, 140.0, 155.0, 0.390),
}
# Classes of amino acids.
CLASSES = {
    "hydrophobic": "AILMFWV",
    "polar": "STNQYC",
    "charged_pos": "RKH",
    "charged_neg": "DE",
    "aromatic": "FWY",
    "tiny": "AGS",
    "small": "AGSCTDNPV",
}


def _text(c: Column) -> Column:
    return F.upper(F.coalesce(c.cast("string"), F.lit("")))


def counted(s: Column, part: str) -> Column:
    """Occurrences of a part that can't overlap itself."""
    return (F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / F.lit(float(len(part)))


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def base_counts(sequence: Column) -> dict[str, Column]:
    """length, the count of each base and of CG, U counting as T. Selected first, they are computed once for all features."""
    s = F.translate(_text(sequence), "U", "T")
    return {"length": F.length(s).cast("double")} | {x: counted(s, x) for x in (*BASES, "CG")}


def nucleotide_composition(sequence: Column | None, counts: dict[str, Column] | None = None) -> dict[str, Column]:
    """Eleven features; U counts as T, other letters only in the length. counts: columns that hold base_counts already."""
    each = counts or base_counts(sequence)
    n, (a, t, g, c) = each["length"], (each[x] for x in BASES)
    gc = g + c
    melting = F.when(n == 0, 0.0).when(n < 14, 4.0 * gc + 2.0 * (a + t)).otherwise(64.9 + 41.0 * (gc - 16.4) / n)
    return {
        "length": n, "freq_A": _share(a, n), "freq_T": _share(t, n), "freq_G": _share(g, n), "freq_C": _share(c, n),
        "gc_content": _share(gc, n), "at_content": _share(a + t, n),
        "gc_skew": _share(g - c, gc), "at_skew": _share(a - t, a + t),
        "cpg_oe": F.when((c == 0) | (g == 0), F.lit(0.0)).otherwise(each["CG"] / (c * g / n)),
        "melting_temp": melting,
    }


def kmer_frequencies(sequence: Column, k: int) -> Column:
    """Frequencies of the 4**k k-mers, in ATGC order; windows with other letters count only in the denominator."""
    s = F.translate(_text(sequence), "U", "T")
    windows = F.greatest(F.length(s) - (k - 1), F.lit(1)).cast("double")
    kinds = ["".join(x) for x in product(BASES, repeat=k)]
    # a look-ahead matches at every position, overlapping ones included
    return F.array(*[F.regexp_count(s, F.lit(f"(?={x})")) / windows for x in kinds])


def residue_counts(sequence: Column) -> dict[str, Column]:
    """length and the count of each residue. Selected first, they are computed once for all properties."""
    s = _text(sequence)
    return {"length": F.length(s).cast("double")} | {x: counted(s, x) for x in AMINO_ACIDS}


def sequence_properties(sequence: Column | None, counts: dict[str, Column] | None = None) -> dict[str, Column]:
    """Sixteen features; unknown residues count only in the length. counts: columns that hold residue_counts already."""
    each = counts or residue_counts(sequence)
    n = each["length"]
    sums = [sum((each[x] * F.lit(float(v[i])) for x, v in AMINO_ACIDS.items()), F.lit(0.0)) for i in range(7)]
    mean = lambda i: _share(sums[i], n)
    out = {
        "length": n,
        "molecular_weight": F.when(n == 0, 0.0).otherwise(sums[0] - (n - 1) * 18.015),
        "avg_hydrophobicity": mean(2), "charge_pH7": sums[3], "isoelectric_point_approx": mean(1),
        **{f"fraction_{k}": _share(sum((each[x] for x in v), F.lit(0.0)), n) for k, v in CLASSES.items()},
        "gravy": mean(2), "avg_flexibility": mean(6), "avg_volume": mean(4), "avg_surface_area": mean(5),
    }
    return out
