"""Readers: every format gives a DataFrame with `_row_id` (text), set before any filter.

Line and record formats are read by Spark's text reader and parsed with column functions; whole-file formats by its binary
reader, one record for each file. Rows are numbered in the JVM from counts of files' splits, so columns are still pruned at the scan.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwise.functions import molecules
from partwise.functions.elements import ELEMENTS
from partwise.operators.filters import Filter, filtered

# Tokens that a table's cell may hold for null.
NULLS = ["", "NA", "N/A", "n/a", "NaN", "nan", "-nan", "-NaN", "null", "NULL", "None", "<NA>", "#N/A", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A"]
# Residues by three letters, and residue names of solvents, ions and buffers, which are no ligands.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLU": "E", "GLN": "Q", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K",
    "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "MSE": "M", "SEC": "U", "PYL": "O",
}
SOLVENTS = "HOH WAT DOD SO4 PO4 GOL EDO PEG PGE DMS ACT FMT CL NA MG ZN CA MN FE CU CO NI K BR IOD CIT TAR MPD BME DTT TRS MES HED EPE IPA ACE NH4 NO3".split()
NUMBERED = {v[0]: e for e, v in ELEMENTS.items()}
#: In the metadata of a `_row_id` that is the row's number, not a name.
ROW_NUMBER = "row_number"
# Formats by extension.
EXTENSIONS = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".parquet": "parquet", ".smi": "smiles", ".smiles": "smiles", ".fasta": "fasta", ".fa": "fasta",
    ".faa": "fasta", ".sdf": "sdf", ".mol": "mol", ".mol2": "mol2", ".pdb": "pdb", ".cif": "mmcif", ".mmcif": "mmcif", ".xyz": "xyz", ".db": "ase_db",
}


def numbered(df: DataFrame) -> DataFrame:
    """df with `_row_id`, its dense number in file order as text: files by path and each from its first row, although Spark deals splits out by
    size; rows that come from no file are in the order of their partitions. One count for each split is broadcast; no row leaves the JVM or its partition."""
    own = df.withColumn("_at", F.monotonically_increasing_id())
    try:
        own = own.withColumns({"_file": F.col("_metadata.file_path"), "_part": F.col("_metadata.file_block_start")})
    except AnalysisException:  # no file is read, or it is below an operator that hides it
        own = own.withColumns({"_file": F.lit(""), "_part": F.shiftright("_at", 33)})
    sizes = own.groupBy("_file", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select("_file", "_part", (F.sum("_n").over(Window.orderBy("_file", "_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    found = own.join(F.broadcast(sizes), ["_file", "_part"])
    number = F.col("_at") + F.col("_shift")
    return found.select(number.cast("string").alias("_row_id", metadata={ROW_NUMBER: True}), *[F.col(f"`{c}`") for c in df.columns])


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns become numbers as far as every cell allows; tokens for null become null."""
    df = df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(NULLS), F.col(f"`{c}`")) for c in columns})
    if not columns:
        return df
    told = df.agg(*[F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(t).isNotNull()).alias(f"{i}{t}") for i, c in enumerate(columns) for t in ("bigint", "double")]).first()
    kinds = {c: next((t for t in ("bigint", "double") if told[f"{i}{t}"]), None) for i, c in enumerate(columns)}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in kinds.items() if t})


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The file is split over tasks unless a quoted cell spans lines."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    spans = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    df = spark.read.csv(path, header=True, sep=sep, multiLine=spans, escape='"', quote='"')
    return numbered(typed(df, df.columns))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.parquet(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of objects, or an object of objects or scalars (`_row_id` is the key; a scalar is in `value`)."""
    whole = spark.read.text(path, wholetext=True)
    if whole.select(F.ltrim("value").startswith("[").alias("is_list")).first().is_list:
        return numbered(spark.read.json(path, multiLine=True))
    entries = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("_row_id", "value"))
    if not entries.where(F.ltrim("value").startswith("{")).isEmpty():
        schema = spark.read.json(entries.select("value").rdd.map(lambda r: r.value)).schema
        return entries.select("_row_id", F.from_json("value", schema).alias("x")).select("_row_id", "x.*")
    return entries


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path).select("value"))


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """A structure and a name in each line; without a name `_row_id` is the line's number."""
    parts = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where("trim(value) != ''").select(
        F.coalesce(F.get(parts, F.lit(1)), "_row_id").alias("_row_id"), parts[0].alias("smiles")
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records between lines that begin with >; text before the first is left out. `_header` is the whole first line."""
    records = spark.read.text(path, lineSep="\n>").select(F.col("value"), F.monotonically_increasing_id().alias("i"))
    records = records.where(~((F.col("i") == 0) & ~F.startswith("value", F.lit(">"))))
    head = F.trim(F.regexp_replace(F.split("value", r"\r?\n", 2)[0], "^>", ""))
    body = F.regexp_replace(F.coalesce(F.get(F.split("value", r"\r?\n", 2), F.lit(1)), F.lit("")), r"\s+", "")
    own = numbered(records.select(head.alias("header"), body.alias("sequence")))
    name = F.split("header", r"\s+")[0]
    return own.select(F.when(name != "", name).otherwise(F.col("_row_id")).alias("_row_id"), "sequence", F.col("header").alias("_header"))


def _files(spark: SparkSession, path: str, *extensions: str) -> DataFrame:
    """stem, path, text of whole files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if extensions:
        df = df.where(F.lower("path").rlike("(" + "|".join(map(re.escape, extensions)) + ")$"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return df.select(stem.alias("stem"), "path", F.decode("content", "UTF-8").alias("text"))


def _structure_rows(residues: DataFrame, ligands: DataFrame) -> DataFrame:
    """chains (structure, chain, seq, aa) and ligands (structure, ligand_id) to rows: each chain with each ligand, or alone."""
    one = F.array_sort(F.collect_list(F.struct("seq", "at", "aa")))
    chains = residues.groupBy("structure", "chain").agg(F.array_join(F.transform(one, lambda x: x["aa"]), "").alias("sequence"), F.min("path").alias("_source_file"))
    both = chains.join(ligands, "structure", "left")
    parts = F.concat_ws("_", "structure", "chain", "ligand_id")
    return both.select(
        parts.alias("_row_id"), F.col("structure").alias("structure_id"), F.col("chain").alias("chain_id"), "sequence",
        F.coalesce("ligand_id", F.lit("")).alias("ligand_id"), F.isnotnull("ligand_id").alias("has_ligand"), "_source_file",
    )


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Chains and ligands from the fixed columns of ATOM and HETATM lines, one file or a folder."""
    lines = _files(spark, path, ".pdb", ".ent").select("stem", "path", F.posexplode(F.split("text", r"\r?\n")).alias("at", "l"))
    cut = lambda a, n: F.trim(F.substring("l", a, n))
    atoms = lines.where(F.col("l").startswith("ATOM") | F.col("l").startswith("HETATM")).select(
        F.col("stem").alias("structure"), "path", "at", F.col("l").startswith("HETATM").alias("het"), cut(18, 3).alias("res"),
        F.when(cut(22, 1) == "", "A").otherwise(cut(22, 1)).alias("chain"), cut(23, 4).try_cast("int").alias("seq"),
    )
    return _from_atoms(atoms)


def _from_atoms(atoms: DataFrame) -> DataFrame:
    letters = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    residues = atoms.where(F.col("res").isin(*RESIDUES)).groupBy("structure", "path", "chain", "seq", "res").agg(F.min("at").alias("at"))
    residues = residues.withColumn("aa", letters[F.col("res")])
    ligands = atoms.where(F.col("het") & ~F.col("res").isin(*RESIDUES, *SOLVENTS)).select("structure", F.col("res").alias("ligand_id")).distinct()
    return _structure_rows(residues, ligands)


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Chains and ligands from the `_atom_site.` loop, columns by their names."""
    text = F.regexp_extract("text", r"(?s)((?:_atom_site\.\S+\s*\n)+)", 1)
    own = _files(spark, path, ".cif", ".mmcif").select("stem", "path", F.transform(F.regexp_extract_all(text, F.lit(r"_atom_site\.(\S+)"), 1), F.trim).alias("names"), F.split("text", r"\r?\n").alias("lines"))
    rows = own.select("stem", "path", "names", F.posexplode("lines").alias("at", "l")).where(F.col("l").rlike(r"^(ATOM|HETATM)\s"))
    cells = F.split(F.trim("l"), r"\s+")
    get = lambda name: F.get(cells, F.array_position("names", name).cast("int") - 1)
    pick = lambda *names: F.coalesce(*[F.when(F.array_contains("names", n) & ~get(n).isin(".", "?"), get(n)) for n in names])
    atoms = rows.select(
        F.col("stem").alias("structure"), "path", "at", F.col("l").startswith("HETATM").alias("het"), pick("label_comp_id", "auth_comp_id").alias("res"),
        F.coalesce(pick("auth_asym_id", "label_asym_id"), F.lit("A")).alias("chain"), pick("auth_seq_id", "label_seq_id").try_cast("int").alias("seq"),
    )
    return _from_atoms(atoms)


def hill_formula(symbols: Iterable[str]) -> str:
    """Carbon, hydrogen, then the other elements by name (all by name without carbon)."""
    n = Counter(symbols)
    order = [*(x for x in ("C", "H") if "C" in n and x in n), *sorted(x for x in n if "C" not in n or x not in ("C", "H"))]
    return "".join(x + (str(n[x]) if n[x] > 1 else "") for x in order)


def _parsed(files: DataFrame, parse: Callable[[str], str | None]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_row_id": b["stem"], "formula": b["text"].map(parse), "_source_file": b["path"]})

    return files.mapInPandas(run, "_row_id string, formula string, _source_file string")


def _cif_formula(text: str) -> str | None:
    """The formula that the file states, else the elements of its atom sites, with their occupancies."""
    if (m := re.search(r"_chemical_formula_sum\s+(?:'([^']*)'|\"([^\"]*)\"|([^\s_]\S*))", text)) and (found := re.findall(r"([A-Z][a-z]?)(\d*)", m[1] or m[2] or m[3])):
        return hill_formula(x for e, n in found for x in [e] * int(n or 1))
    lines = iter(text.splitlines())
    for line in lines:
        if line.strip() != "loop_":
            continue
        names, rows = [], []
        for row in lines:
            if row.strip().startswith("_"):
                names.append(row.strip().split()[0])
            elif row.strip() and not row.strip().startswith(("#", "loop_")) and len(row.split()) == len(names):
                rows.append(dict(zip(names, row.split(), strict=True)))
            else:
                break
        key = next((k for k in ("_atom_site_type_symbol", "_atom_site_label") if k in names), None)
        if key and rows:
            symbols = [m[0] for r in rows if (m := re.match(r"[A-Z][a-z]?", r[key]))]
            return hill_formula(symbols)
    return None


def _xyz_formula(text: str) -> str | None:
    lines = text.splitlines()
    n = int(lines[0].split()[0]) if lines and lines[0].split() and lines[0].split()[0].isdigit() else 0
    return hill_formula(x.split()[0] for x in lines[2 : 2 + n] if x.split()) or None


def read_cif(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(_files(spark, path, ".cif"), _cif_formula)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(_files(spark, path, ".xyz"), _xyz_formula)


def _molecules(rows: DataFrame, text: str, parse: Callable) -> DataFrame:
    """rows with smiles and formula of the molecule in a text column; both null where it has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse(x) for x in b[text]]
            yield b.assign(smiles=[m and m.smiles() for m in found], formula=[m and m.formula() for m in found])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, smiles string, formula string")


def _one_molecule(spark: SparkSession, path: str, extension: str, parse: Callable) -> DataFrame:
    files = _files(spark, path, extension).select(F.col("stem").alias("_row_id"), "text", F.col("path").alias("_source_file"))
    bad = F.raise_error(F.concat(F.lit("no molecule in "), "_source_file"))
    return _molecules(files, "text", parse).select("_row_id", F.coalesce("smiles", bad.cast("string")).alias("smiles"), "formula", "_source_file")


def read_mol(spark: SparkSession, path: str) -> DataFrame:
    """One molecule in each file, named by the file; a file without one is an error."""
    return _one_molecule(spark, path, ".mol", molecules.from_molblock)


def read_mol2(spark: SparkSession, path: str) -> DataFrame:
    return _one_molecule(spark, path, ".mol2", molecules.from_mol2)


def read_sdf(spark: SparkSession, path: str, folder: bool = False) -> DataFrame:
    """Molecules between `$$$$` lines: smiles, formula and a column for each property. `_row_id` is the title or the record's number; in a
    folder the file's name, with the number among its molecules if there are several. Records that are no molecule are left out."""
    records = _files(spark, path, ".sdf").select("stem", "path", F.posexplode(F.split("text", r"(?m)^\$\$\$\$[ \t\r]*(?:\n|$)")).alias("i", "block")).where("trim(block) != ''")
    keys, values = (F.regexp_extract_all("block", F.lit(r"(?s)>[^\n<]*<([^>\n]+)>[^\n]*\n(.*?)\r?\n[ \t\r]*(?:\n|$)"), i) for i in (1, 2))
    first = F.transform(F.array_distinct("keys"), lambda k: F.struct(k.alias("k"), F.element_at("values", F.array_position("keys", k).cast("int")).alias("v")))
    told = records.select("stem", "path", "i", "block", F.trim(F.split("block", r"\r?\n")[0]).alias("title"), keys.alias("keys"), values.alias("values"))
    told = told.select("stem", "path", "i", "block", "title", F.to_json(F.map_from_entries(first)).alias("properties"))
    found = _molecules(told, "block", molecules.from_molblock).where("smiles is not null").withColumn("properties", F.from_json("properties", "map<string,string>"))
    if folder:
        of = Window.partitionBy("path")
        name = F.when(F.count("*").over(of) == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.row_number().over(of.orderBy("i")) - 1))
    else:
        name = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("i").cast("string"))
    own = found.select(name.alias("_row_id"), "smiles", "formula", "properties", F.col("block").alias("_block"), F.col("path").alias("_source_file"))
    names = sorted(r.k for r in own.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect())  # the schema, as a reader of JSON finds it
    names = [n for n in names if n not in ("smiles", "formula") and not n.startswith("_")]
    wide = own.select("_row_id", "smiles", "formula", *[F.col("properties")[n].alias(n) for n in names], "_block", "_source_file")
    return typed(wide, names)


def read_sdf_dir(spark: SparkSession, path: str) -> DataFrame:
    return read_sdf(spark, path, folder=True)


def read_ase_db(spark: SparkSession, path: str) -> DataFrame:
    """`_row_id` (from 0), formula and key-value pairs (a column each) of an SQLite database of structures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in batches:
            for content in b["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                rows = db.execute("SELECT id, numbers, key_value_pairs FROM systems ORDER BY id")
                while got := rows.fetchmany(1000):
                    atoms = [[NUMBERED[int.from_bytes(n[i : i + 4], "little")] for i in range(0, len(n), 4)] for _, n, _ in got]
                    yield pd.DataFrame({"_row_id": [str(i - 1) for i, _, _ in got], "formula": [hill_formula(a) for a in atoms], "properties": [k or "{}" for _, _, k in got], "_source_file": path})

    own = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "_row_id string, formula string, properties string, _source_file string")
    pairs = F.from_json("properties", "map<string,string>")
    names = sorted(r.k for r in own.select(F.explode(F.map_keys(pairs)).alias("k")).distinct().collect())
    names = [n for n in names if n != "formula" and not n.startswith("_")]
    return typed(own.select("_row_id", "formula", *[pairs[n].alias(n) for n in names], "_source_file"), names)


def read_embeddings(spark: SparkSession, path: str, entities: DataFrame | None = None) -> DataFrame:
    """(entity, embedding) from a file of vectors: CSV (the first column names the entity), NPZ (arrays ids and embeddings), NPY (rows in the
    order of entities (entity) by text) or PT (a dictionary, or a tensor in that order; needs torch). NumPy files are read by one task."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
        key, *rest = df.columns
        return df.select(F.col(f"`{key}`").cast("string").alias("entity"), F.array(*[F.col(f"`{c}`").cast("double") for c in rest]).alias("embedding"))
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("npz", "npy", "pt", "pth"):
        raise ValueError(f"no reader of embeddings for .{kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        for b in batches:
            for content in b["content"]:
                if kind in ("pt", "pth"):
                    import torch

                    data = torch.load(io.BytesIO(content), map_location="cpu", weights_only=True)
                    ids, x = ([*data], [np.asarray(v) for v in data.values()]) if isinstance(data, dict) else (None, np.asarray(data))
                else:
                    data = np.load(io.BytesIO(content))
                    ids, x = (data["ids"].astype(str).tolist(), data["embeddings"]) if kind == "npz" else (None, data)
                for i in range(0, len(x), 1000):
                    rows = [np.asarray(v, dtype=float) for v in x[i : i + 1000]]
                    yield pd.DataFrame({"entity": [str(k) for k in ids[i : i + 1000]] if ids is not None else None, "at": range(i, i + len(rows)), "embedding": rows})

    own = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "entity string, at long, embedding array<double>")
    if kind == "npz" or kind in ("pt", "pth") and not own.where("entity is not null").isEmpty():
        return own.select("entity", "embedding")
    if entities is None:
        raise ValueError(f"a .{kind} file of vectors alone needs the entities whose order it has")
    order = numbered(entities.select("entity").distinct().orderBy("entity")).select(F.col("_row_id").cast("long").alias("at"), "entity")
    return order.join(own.select("at", "embedding"), "at").select("entity", "embedding")


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet, "smiles": read_smiles, "fasta": read_fasta, "sdf": read_sdf, "sdf_dir": read_sdf_dir,
    "mol": read_mol, "mol2": read_mol2, "pdb": read_pdb, "pdb_dir": read_pdb, "mmcif": read_mmcif, "mmcif_dir": read_mmcif, "cif": read_cif, "cif_dir": read_cif,
    "xyz": read_xyz, "xyz_dir": read_xyz, "ase_db": read_ase_db,
}


def sniff_cif(head: str) -> str:
    """A .cif file's kind by its first 8192 characters."""
    if "_atom_site.group_PDB" in head or "_entity_poly" in head:
        return "mmcif"
    return "cif" if "_cell_length_a" in head or "_atom_site_fract_x" in head else "mmcif"


def detect(path: str) -> str:
    """The format of a local file or folder, by extensions and, for .cif, content. Unknown extensions are CSV."""
    if not os.path.isdir(path):
        kind = EXTENSIONS.get(os.path.splitext(path)[1].lower(), "csv")
        if path.lower().endswith(".cif"):
            with open(path, errors="replace") as f:
                kind = sniff_cif(f.read(8192))
        return kind
    names = sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))
    kinds = [os.path.splitext(n)[1].lower() for n in names]
    if ".pdb" in kinds:
        return "pdb_dir"
    if cif := [n for n, k in zip(names, kinds, strict=True) if k in (".cif", ".mmcif")]:
        with open(os.path.join(path, cif[0]), errors="replace") as f:
            return sniff_cif(f.read(8192)) + "_dir" if cif[0].endswith(".cif") else "mmcif_dir"
    for k, fmt in ((".sdf", "sdf_dir"), (".xyz", "xyz_dir")):
        if k in kinds:
            return fmt
    known = [EXTENSIONS[k] for k in kinds if k in EXTENSIONS]
    if len(known) == 1 or known and set(known) == {"parquet"}:
        return known[0]
    raise ValueError(f"no known format in {path}")


def unpacked(archive: str, folder: str) -> str:
    """What a ZIP file holds, in a folder: the file or folder to be loaded. Names that lead out of the folder are refused."""
    import zipfile

    root = os.path.realpath(folder)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if os.path.commonpath([root, os.path.realpath(os.path.join(root, name))]) != root:
                raise ValueError(f"{name} leads out of the archive's folder")
        z.extractall(root)
    names = [n for n in sorted(os.listdir(root)) if not n.startswith((".", "_"))]
    return os.path.join(root, names[0]) if len(names) == 1 else root


def load(spark: SparkSession, path: str, fmt: str | None = None, filters: Iterable[Filter] = ()) -> DataFrame:
    """Detect, read, then filter; `_row_id` keeps the numbers from before the filter."""
    fmt = fmt or detect(path)
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt}")
    return filtered(READERS[fmt](spark, path), filters)


def aligned_embeddings(entities: DataFrame, embeddings: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """entities with their vector; the zero vector where there is none."""
    zero = F.array_repeat(F.lit(0.0), size)
    return entities.join(embeddings.select(key, F.col(vector).cast("array<double>").alias(vector)), key, "left").withColumn(vector, F.coalesce(vector, zero))
