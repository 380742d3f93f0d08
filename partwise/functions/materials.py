"""Features of chemical formulas; those of element properties are of looked_up parts. Element properties are a parameter, a map column of a table; elements.py has those that are used by default.

Null or empty formulas have no elements; statistics over no values are 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.vectors import norm, total


def composition(formula: Column) -> Column:
    """array of (element, count), sorted by element: symbols with the whole number after them (none: 1), equal ones summed.
    Brackets and decimals are not interpreted."""
    text = F.coalesce(formula, F.lit(""))
    pattern = F.lit("([A-Z][a-z]?)(\\d*)")
    found = F.arrays_zip(
        F.regexp_extract_all(text, pattern, 1).alias("element"), F.regexp_extract_all(text, pattern, 2).alias("count")
    )
    pairs = F.transform(found, lambda x: F.struct(x["element"].alias("element"), F.when(x["count"] == "", 1).otherwise(x["count"].try_cast("int")).alias("count")))
    summed = lambda pairs: F.transform(
        F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["element"]))),
        lambda e: F.struct(
            e.alias("element"),
            F.aggregate(F.filter(pairs, lambda x: x["element"] == e), F.lit(0), lambda s, x: s + x["count"]).alias("count"),
        ),
    )
    return F.transform(F.array(pairs), summed)[0]  # through an array of one, so that the pairs are made once


def looked_up(formula: Column, table: Column) -> Column:
    """composition with the properties of each element (p; null if the table lacks it). Selected first, it is computed once for all features."""
    return F.transform(composition(formula), lambda x: F.struct(x["element"].alias("element"), x["count"].alias("count"), F.element_at(table, x["element"]).alias("p")))


def literal_map(table: Mapping[str, Sequence[float]]) -> Column:
    """element -> array of properties. The table is a parameter of bounded size (there are 118 elements)."""
    return F.create_map(*[x for e, v in table.items() for x in (F.lit(e), F.array(*[F.lit(float(y)) for y in v]))])


def values(parts: Column, i: int, missing: float | None = None) -> Column:
    """array of (v, n) of looked_up parts: the property of each element and its count. Elements without it are left out, or have `missing`."""
    pick = lambda x: F.get(x["p"], F.lit(i))
    if missing is not None:
        there = F.filter(parts, lambda x: x["count"] > 0)
        return F.transform(there, lambda x: F.struct(F.coalesce(pick(x), F.lit(missing)).alias("v"), x["count"].cast("double").alias("n")))
    known = F.filter(parts, lambda x: pick(x).isNotNull() & (x["count"] > 0))
    return F.transform(known, lambda x: F.struct(pick(x).alias("v"), x["count"].cast("double").alias("n")))


def weighted(pairs: Column) -> dict[str, Column]:
    """mean, std (population), min, max, range of values repeated by their counts."""
    n = total(F.transform(pairs, lambda x: x["n"]))
    mean = F.when(n > 0, total(F.transform(pairs, lambda x: x["v"] * x["n"])) / n).otherwise(0.0)
    spread = total(F.transform(pairs, lambda x: x["n"] * (x["v"] - mean) * (x["v"] - mean)))
    low, high = (F.coalesce(f(F.transform(pairs, lambda x: x["v"])), F.lit(0.0)) for f in (F.array_min, F.array_max))
    return {"mean": mean, "std": F.when(n > 0, F.sqrt(spread / n)).otherwise(0.0), "min": low, "max": high, "range": high - low}


def magpie_properties(parts: Column, names: Sequence[str]) -> dict[str, Column]:
    """Five statistics of each property."""
    return {f"{name}_{k}": c for i, name in enumerate(names) for k, c in weighted(values(parts, i)).items()}


def stoichiometry(formula: Column) -> dict[str, Column]:
    """Number of elements and atoms, entropy, and p-norms of the atomic fractions."""
    parts = composition(formula)
    atoms = total(F.transform(parts, lambda x: x["count"].cast("double")))
    share = F.when(atoms > 0, F.transform(parts, lambda x: x["count"] / atoms)).otherwise(F.array().cast("array<double>"))
    entropy = total(F.transform(share, lambda f: F.when(f > 0, -f * F.log(f)).otherwise(0.0)))
    return {
        "num_elements": F.size(parts).cast("double"), "total_atoms": atoms, "composition_entropy": entropy + 0.0,
        **{f"L{p}_norm": norm(share, float(p)) for p in (2, 3, 5, 7, 10)},
    }


def electronic(parts: Column) -> dict[str, Column]:
    """Statistics where unknown elements count as 0. Properties: d electrons, valence, oxidation state, work function."""
    d, v, o, w = (weighted(values(parts, i, 0.0)) for i in range(4))
    return {
        **{f"d_electron_{k}": d[k] for k in ("mean", "std", "range")},
        **{f"valence_electron_{k}": v[k] for k in ("mean", "std")}, **{f"oxidation_state_{k}": o[k] for k in ("mean", "std")},
        **{f"work_function_{k}": w[k] for k in ("mean", "std")},
        "d_electron_max": d["max"], "d_electron_min": d["min"], "work_function_range": w["range"],
    }


def bonding(parts: Column) -> dict[str, Column]:
    """Properties: electronegativity, ionic radius, polarizability; unknown ones are 0. Differences are from the mean of the
    electronegativities above 0. The tolerance is that of a perovskite of the two largest radii with oxygen (140)."""
    all_en = values(parts, 0, 0.0)
    known = F.filter(all_en, lambda x: x["v"] > 0)
    middle = weighted(known)["mean"]
    off = F.transform(all_en, lambda x: F.struct(F.abs(middle - x["v"]).alias("v"), x["n"].alias("n")))
    ionicity = F.transform(off, lambda x: F.struct((1 - F.exp(x["v"] * x["v"] * -0.25)).alias("v"), x["n"].alias("n")))
    diff, radii = weighted(off), values(parts, 1, 0.0)
    r, n = weighted(radii), total(F.transform(known, lambda x: x["n"]))
    geometric = F.when(n > 0, F.exp(total(F.transform(known, lambda x: x["n"] * F.log(x["v"]))) / n)).otherwise(0.0)
    large = F.sort_array(F.transform(radii, lambda x: x["v"]), asc=False)
    first, second = F.get(large, F.lit(0)), F.get(large, F.lit(1))
    return {
        "avg_electronegativity_diff": diff["mean"], "avg_ionic_radius": r["mean"],
        "radius_ratio": F.when(r["min"] > 0, r["max"] / r["min"]).otherwise(0.0),
        "avg_bond_ionicity": weighted(ionicity)["mean"], "geometric_mean_en": geometric, "avg_polarizability": weighted(values(parts, 2, 0.0))["mean"],
        "tolerance_factor": F.when(second > 0, (first + 140.0) / ((second + 140.0) * F.sqrt(F.lit(2.0)))).otherwise(0.0),
        "en_diff_std": diff["std"], "ionic_radius_std": r["std"],
    }


def thermodynamic(parts: Column) -> dict[str, Column]:
    """Properties: melting point, oxide enthalpy, atomic mass; unknown ones are 0. The mass entropy is over atoms."""
    m, o = weighted(values(parts, 0, 0.0)), weighted(values(parts, 1, 0.0))
    mass = values(parts, 2, 0.0)
    whole = total(F.transform(mass, lambda x: x["v"] * x["n"]))
    entropy = total(F.transform(mass, lambda x: -x["n"] * (x["v"] / whole) * F.log(x["v"] / whole + 1e-12)))
    return {
        "avg_melting_point": m["mean"], "melting_point_std": m["std"], "melting_point_range": m["range"],
        "avg_oxide_formation_enthalpy": o["mean"], "reducibility_index": 0.0 - o["mean"],
        "entropy_mixing_mass_weighted": F.when(whole > 0, entropy).otherwise(0.0),
        "min_oxide_formation_enthalpy": o["min"], "max_oxide_formation_enthalpy": o["max"],
    }


def classification(parts: Column, transition: Sequence[str], noble: Sequence[str], rare: Sequence[str]) -> dict[str, Column]:
    """Membership flags and shares. Properties: d electrons, electronegativity, electron affinity; the spread is over the table's elements."""
    has = lambda group: F.exists(parts, lambda x: x["element"].isin(*group)).cast("double")
    atoms = total(F.transform(parts, lambda x: x["count"].cast("double")))
    of_transition = F.filter(parts, lambda x: x["element"].isin(*transition))
    share = F.when(atoms > 0, total(F.transform(of_transition, lambda x: x["count"].cast("double"))) / atoms).otherwise(0.0)
    en = F.transform(values(parts, 1), lambda x: x["v"])
    return {
        "has_transition_metal": has(transition), "has_noble_metal": has(noble), "has_rare_earth": has(rare), "fraction_transition_metal": share,
        "d_band_filling": weighted(values(of_transition, 0, 0.0))["mean"] / 10, "element_diversity": F.size(parts).cast("double"),
        "electronegativity_spread": F.when(F.size(en) > 1, F.array_max(en) - F.array_min(en)).otherwise(0.0),
        "weighted_electron_affinity": weighted(values(parts, 2, 0.0))["mean"],
    }


def vector_mean(formula: Column, table: Column, size: int) -> Column:
    """Composition-weighted sum of element vectors; unknown elements count only in the total."""
    parts = composition(formula)
    atoms = total(F.transform(parts, lambda x: x["count"].cast("double")))
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.when(
            atoms > 0,
            total(F.transform(parts, lambda x: F.coalesce(F.get(F.element_at(table, x["element"]), i), F.lit(0.0)) * x["count"] / atoms)),
        ).otherwise(0.0),
    )


def element_counts(formula: Column, elements: Sequence[str]) -> dict[str, Column]:
    """The count of each of the elements."""
    own = F.map_from_entries(composition(formula))
    return {f"count_{e}": F.coalesce(F.element_at(own, F.lit(e)), F.lit(0)).cast("double") for e in elements}


def weighted_means(formula: Column, table: Column, names: Sequence[str]) -> dict[str, Column]:
    """The mean of each property over all atoms; elements without it count only in the total."""
    parts = composition(formula)
    atoms = total(F.transform(parts, lambda x: x["count"].cast("double")))
    pick = lambda x, i: F.coalesce(F.get(F.element_at(table, x["element"]), F.lit(i)), F.lit(0.0))
    return {f"wtd_mean_{n}": F.when(atoms > 0, total(F.transform(parts, lambda x, i=i: pick(x, i) * x["count"])) / atoms).otherwise(0.0) for i, n in enumerate(names)}
