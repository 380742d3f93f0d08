"""Configuration: YAML to validated dataclasses."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from partwise.operators.filters import Filter

# Techniques on one and on two axes, what one on two axes is on one, and feature sets by type.
TECHNIQUES_1D = ["R", "I1e", "C1e", "scaffold"]
TECHNIQUES_2D = ["R", "I1e", "I1f", "I2", "C1e", "C1f", "C2"]
ON_ONE_AXIS = {"I1f": "I1e", "I2": "I1e", "C1f": "C1e", "C2": "C1e"}
FEATURES = {
    "gene": ["nucleotide_composition", "kmer_frequencies", "nt_embedding", "precomputed_embedding"],
    "biomolecule": ["sequence_properties", "esm_embedding", "precomputed_embedding"],
    "material": ["magpie_properties", "stoichiometry", "electronic", "bonding", "thermodynamic", "classification", "matminer_elementproperty", "mat2vec_embedding", "crystalnn_fingerprint", "soap_descriptor"],
    "molecule": ["rdkit_descriptors", "composition", "physicochemical", "morgan_fingerprint"],
}


@dataclass
class Entity:
    name: str
    type: str
    column: str
    features: list[str] = field(default_factory=list)
    smiles_map: dict[str, str] | None = None
    embedding_file: str | None = None
    structure_dir: str | None = None
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in FEATURES:
            raise ValueError(f"type must be one of {sorted(FEATURES)}, not {self.type}")
        if bad := [f for f in self.features if f not in FEATURES[self.type]]:
            raise ValueError(f"{bad} not valid for {self.type}")


@dataclass
class Splitting:
    techniques: list[str]
    splits: list[int] = field(default_factory=lambda: [8, 2])
    names: list[str] = field(default_factory=lambda: ["train", "test"])
    e2_clusters: int = 30

    def __post_init__(self) -> None:
        if len(self.splits) not in (2, 3) or any(s <= 0 for s in self.splits):
            raise ValueError("splits must be 2 or 3 positive numbers")
        if len(self.names) != len(self.splits):
            raise ValueError("as many names as splits are needed")
        if not self.techniques or (bad := [t for t in self.techniques if t not in {*TECHNIQUES_1D, *TECHNIQUES_2D}]):
            raise ValueError(f"unknown techniques: {bad if self.techniques else 'none given'}")


@dataclass
class Config:
    name: str
    input: str
    output: str
    e1: Entity
    splitting: Splitting
    e2: Entity | None = None
    format: str | None = None
    filters: list[Filter] = field(default_factory=list)
    cache: str | None = None

    def __post_init__(self) -> None:
        for e in (self.e1, self.e2):  # a folder of structures is where its entities' structures are
            if e and e.type == "material" and e.structure_dir is None and self.format in ("cif_dir", "xyz_dir"):
                e.structure_dir = self.input


def _entity(raw: dict, which: str) -> Entity:
    for key in ("name", "type", "extract"):
        if key not in raw:
            raise ValueError(f"{which} needs {key}")
    if "column" not in (raw["extract"] or {}):
        raise ValueError(f"{which} needs extract.column")
    options = {k: raw[k] for k in ("esm_model", "esm_batch_size", "nt_model", "nt_batch_size") if k in raw}
    return Entity(raw["name"], raw["type"], raw["extract"]["column"], raw.get("features") or [], raw.get("smiles_map"), raw.get("embedding_file"), raw.get("structure_dir"), options)


def parse(raw: dict) -> Config:
    """e1 and e2 may be called e and f."""
    for key in ("dataset", "splitting"):
        if key not in raw:
            raise ValueError(f"missing {key}")
    e1, e2 = raw.get("e1") or raw.get("e"), raw.get("e2") or raw.get("f")
    if not e1:
        raise ValueError("e1 or e is needed")
    data, s = raw["dataset"], raw["splitting"]
    splitting = Splitting(s.get("techniques") or TECHNIQUES_2D, s.get("splits") or [8, 2], s.get("names") or ["train", "test"], s.get("e2_clusters") or s.get("f_clusters") or 30)
    if not e2 and (bad := [t for t in splitting.techniques if t not in TECHNIQUES_1D]):
        raise ValueError(f"{bad} need a second entity")
    rules = [Filter(f["column"], f.get("not_equal"), bool(f.get("not_empty"))) for f in raw.get("filters") or []]
    return Config(data["name"], data["input"], data.get("output", "output"), _entity(e1, "e1"), splitting, _entity(e2, "e2") if e2 else None, data.get("format"), rules, data.get("cache"))


def load_config(path: str) -> Config:
    import yaml

    with open(path) as f:
        config = parse(yaml.safe_load(f))
    for e in (config.e1, config.e2):
        for path in (config.input, e and e.embedding_file, e and e.structure_dir):
            if path and "://" not in path and not os.path.exists(path):
                raise FileNotFoundError(path)
    return config
