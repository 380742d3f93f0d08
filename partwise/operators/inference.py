"""Semantic types of values and columns: gene, biomolecule, material, molecule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.functions import molecules

# The pattern of formulas, and the types in the order that breaks ties.
FORMULA = "^[A-Z][a-z]?(\\d+(\\.\\d+)?)?([A-Z][a-z]?(\\d+(\\.\\d+)?)?)*$"
TYPES = ["molecule", "material", "biomolecule", "gene"]


def is_formula(s: Column) -> Column:
    return F.length(s).between(2, 100) & s.rlike(FORMULA) & (s.rlike("\\d") | (F.length(s) <= 4))


def _made_of(s: Column, letters: str, share: float) -> Column:
    kept = F.length(F.regexp_replace(F.upper(s), f"[^{letters}]", ""))
    return (F.length(s) >= 15) & (kept >= F.lit(share) * F.length(s))


def is_protein(s: Column) -> Column:
    return _made_of(s, "ACDEFGHIKLMNPQRSTVWY", 0.9)


def is_nucleotide(s: Column) -> Column:
    return _made_of(s, "ATCGUN", 0.85)


def classify(value: Column, is_molecule: Column | None = None) -> Column:
    """The type of one value, or null: numbers and texts under two characters have none. Genes come before proteins, formulas before molecules.
    is_molecule: whether the trimmed text is SMILES, a column of its own so that only samples are parsed."""
    s = F.trim(value.cast("string"))
    number = F.expr("true") & F.regexp_replace(s, "(?<=\\d)_(?=\\d)", "").try_cast("double").isNotNull()
    return (
        F.when((F.length(s) < 2) | number, F.lit(None).cast("string"))
        .when(is_nucleotide(s), "gene")
        .when(is_protein(s), "biomolecule")
        .when(is_formula(s), "material")
        .when(is_molecule if is_molecule is not None else F.lit(False), "molecule")
    )


def column_types(df: DataFrame, columns: list[str], sample: int = 50, seed: str = "42") -> DataFrame:
    """col, type, confidence: the majority among a sample of values in the order of a hash; null under one half, or where
    the median length is under two."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns])).alias("x"))
    rows = long.select("x.col", "x.v").where("v is not null and v != ''")
    lengths = rows.groupBy("col").agg(F.percentile(F.length("v"), 0.5).alias("median_length"))
    order = Window.partitionBy("col").orderBy(F.md5(F.concat(F.col("v"), F.lit(f"|{seed}"))), "v")
    picked = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    picked = picked.select("col", "v", molecules.is_smiles(F.col("v")).alias("_smiles"))
    kind = classify(F.col("v"), F.col("_smiles"))
    votes = picked.select("col", kind.alias("kind")).groupBy("col").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == t).alias(t) for t in TYPES])
    best = F.greatest(*TYPES)
    name = F.coalesce(*[F.when(F.col(t) == best, t) for t in TYPES])
    sure = (best / F.col("n") >= 0.5) & (F.col("median_length") >= 2)
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("col"))
    found = votes.join(lengths, "col").select("col", F.when(sure, name).alias("type"), F.when(sure, F.round(best / F.col("n"), 3)).otherwise(0.0).alias("confidence"))
    return names.join(found, "col", "left").select("col", "type", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


# The type that a format's rows have unless inferred otherwise.
FORMAT_TYPES = {
    "smiles": "molecule", "sdf": "molecule", "sdf_dir": "molecule", "mol": "molecule", "mol2": "molecule", "fasta": "biomolecule",
    "pdb": "biomolecule", "pdb_dir": "biomolecule", "mmcif": "biomolecule", "mmcif_dir": "biomolecule",
    "cif": "material", "cif_dir": "material", "xyz": "material", "xyz_dir": "material", "ase_db": "material",
}


# Names, columns and feature sets that are suggested for a type.
TYPE_NAMES = {"molecule": "compound", "material": "material", "biomolecule": "protein", "gene": "gene"}
TYPE_COLUMNS = {"molecule": "smiles", "material": "formula", "biomolecule": "sequence"}
TYPE_FEATURES = {
    "molecule": ["rdkit_descriptors", "physicochemical", "morgan_fingerprint"], "material": ["magpie_properties", "stoichiometry", "electronic"],
    "biomolecule": ["sequence_properties"], "gene": ["nucleotide_composition", "kmer_frequencies"],
}
STRUCTURES = ("pdb", "mmcif", "pdb_dir", "mmcif_dir")


def _suggested(kind: str, column: str, name: str | None = None) -> dict:
    return {"type": kind, "column": column, "name": name or TYPE_NAMES[kind], "feature_sets": TYPE_FEATURES[kind]}


def hints(types: list[tuple[str, str | None, float]], fmt: str | None, columns: list[str] | None = None, has_ligand: bool = False) -> dict:
    """Suggested first and second entity from column_types rows, in the order of the columns.

    A format with a type of its own gives the first entity, and a second one only for structures with a ligand. Other formats take the
    surest column, then the surest of another type, else the next one.
    """
    columns = [c for c, _, _ in types] if columns is None else columns
    ranked = sorted((t for t in types if t[1]), key=lambda t: -t[2])
    own, first, second = FORMAT_TYPES.get(fmt or ""), None, None
    if own:
        column = TYPE_COLUMNS[own] if TYPE_COLUMNS[own] in columns else next((c for c, t, _ in ranked if t == own), None)
        first = _suggested(own, column) if column else None
        if fmt in STRUCTURES and has_ligand and "ligand_id" in columns:
            second = _suggested("molecule", "ligand_id", "ligand")
    elif ranked:
        (column, kind, _), rest = ranked[0], ranked[1:]
        first = _suggested(kind, column)
        if other := next((t for t in rest if t[1] != kind), None):
            second = _suggested(other[1], other[0])
        elif rest:
            second = _suggested(kind, rest[0][0], TYPE_NAMES[kind] + "_2")
    listed = {c: {"type": t, "confidence": x} for c, t, x in types}
    default = {"type": own, "column": TYPE_COLUMNS[own]} if own else None
    return {"column_types": listed, "format_default": default, "suggested_e": first, "suggested_f": second}
