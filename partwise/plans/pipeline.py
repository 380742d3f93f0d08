"""Load, extract entities, compute features, split, map back to rows, measure, compare."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import materials, molecules, sequences
from partwise.functions.elements import ELEMENTS, PROPERTIES, TABLES
from partwise.functions.vectors import cleaned
from partwise.operators import distances, filters, metrics, splits
from partwise.plans.cache import cached, content_key
from partwise.plans.config import ON_ONE_AXIS, TECHNIQUES_1D, Config, Entity
from partwise.sources.readers import aligned_embeddings, detect, load, read_embeddings
from partwise.sources.writers import features_csv, fold_column, indices, write_splits

log = logging.getLogger(__name__)
#: Further feature sets: name -> function of the entity column that gives array<double>.
registered: dict[str, Callable] = {}
#: Element tables of the material sets: name -> (element -> properties in the order of the set's function, further arguments).
elements: dict[str, tuple[Mapping, tuple]] = dict(TABLES)


def register_feature_set(name: str, f: Callable) -> None:
    registered[name] = f


def register_elements(name: str, table: Mapping, *more) -> None:
    """Another table than the library's of magpie_properties (more: the names of its properties), electronic, bonding, thermodynamic, classification
    (more: transition metals, noble metals, rare earths) or mat2vec_embedding (more: the size)."""
    if name not in OF_ELEMENTS:
        raise ValueError(f"{name} takes no table; these do: {sorted(OF_ELEMENTS)}")
    elements[name] = (table, more)


def _kmers(c) -> dict:
    names = [(k, start + "".join(x)) for k, start in ((2, "di_"), (3, "tri_")) for x in product(sequences.BASES, repeat=k)]
    both = F.concat(sequences.kmer_frequencies(c, 2), sequences.kmer_frequencies(c, 3))
    return {name: F.get(both, F.lit(i)) for i, (_, name) in enumerate(names)}


NAMED = {
    "nucleotide_composition": sequences.nucleotide_composition, "kmer_frequencies": _kmers,
    "sequence_properties": sequences.sequence_properties, "stoichiometry": materials.stoichiometry,
}
OF_ELEMENTS = {
    "magpie_properties": materials.magpie_properties, "electronic": materials.electronic, "bonding": materials.bonding,
    "thermodynamic": materials.thermodynamic, "classification": materials.classification, "mat2vec_embedding": materials.vector_mean,
}


def _set(name: str, c):
    """array<double> of a feature set."""
    if name in registered:
        return registered[name](c)
    if name == "kmer_frequencies":
        return F.concat(sequences.kmer_frequencies(c, 2), sequences.kmer_frequencies(c, 3))
    if name in NAMED:
        return F.array(*NAMED[name](c).values())
    if name == "mat2vec_embedding" and name in elements:
        return materials.vector_mean(c, materials.literal_map(elements[name][0]), *elements[name][1])
    if name in elements:
        return F.array(*OF_ELEMENTS[name](F.col(f"_{name}"), *elements[name][1]).values())
    raise ImportError(f"feature set {name} isn't built in: register_elements or register_feature_set gives it")


def feature_names(sets: Sequence[str], size: int) -> list[str]:
    """A name for each of the features: those of the sets that name theirs, else the set's name and a number."""
    out: list[str] = []
    for i, name in enumerate(sets):
        if name in registered or name not in NAMED and name not in elements or name == "mat2vec_embedding":
            rest = size - len(out) if i == len(sets) - 1 else 0
            if not rest:
                return [f"feature_{j}" for j in range(size)]
            out += [f"{name}_{j}" for j in range(rest)]
        elif name in NAMED:
            out += NAMED[name](F.lit(""))
        else:
            table, more = elements[name]
            out += OF_ELEMENTS[name](F.col("parts"), *more)
    return out


OF_MOLECULES = ("rdkit_descriptors", "physicochemical", "morgan_fingerprint")
DEFAULTS = {
    "gene": ["nucleotide_composition", "kmer_frequencies"], "biomolecule": ["sequence_properties"],
    "material": ["magpie_properties", "stoichiometry", "electronic", "bonding", "thermodynamic", "classification"],
    "molecule": ["rdkit_descriptors", "composition", "physicochemical", "morgan_fingerprint"],
}


def _computed(entities: DataFrame, config: Entity, sets: Sequence[str]) -> DataFrame:
    """entity, features of all sets in their order. The names of the features, where all sets name theirs, are in the column's metadata."""
    own, key, names, parts = entities.select("entity"), F.col("entity"), [], []
    if config.smiles_map:
        names_of = F.create_map(*[F.lit(x) for kv in config.smiles_map.items() for x in kv])
        own = own.withColumn("_smiles", F.coalesce(names_of[key], key))
    smiles = F.col("_smiles") if config.smiles_map else key
    graphs = [s for s in sets if s in OF_MOLECULES and s not in registered]
    if graphs:  # one parse gives all these sets
        own = own.withColumn("_graph", molecules.features(smiles, graphs))
    if "composition" in sets and "composition" not in registered:
        own = own.withColumn("_formula", molecules.formula(smiles))
        found = own.select(F.explode(F.transform(materials.composition(F.col("_formula")), lambda x: x["element"])).alias("e")).distinct()
        present = sorted(r.e for r in found.limit(1000).collect())  # names of elements, of which a formula's pattern allows 702
    if "precomputed_embedding" in sets and "precomputed_embedding" not in registered:
        if not config.embedding_file:
            raise ImportError("precomputed_embedding needs embedding_file")
        vectors = read_embeddings(own.sparkSession, config.embedding_file, entities)
        size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        own = aligned_embeddings(own, vectors, "entity", "embedding", size)
    if "nucleotide_composition" in sets and "nucleotide_composition" not in registered:
        bases = sequences.base_counts(key)
        own = own.select("*", *[c.alias(f"_n_{k}") for k, c in bases.items()])
    if "sequence_properties" in sets and "sequence_properties" not in registered:
        residues = sequences.residue_counts(key)
        own = own.select("*", *[c.alias(f"_r_{k}") for k, c in residues.items()])
    for s in sets:
        if s in elements and s not in registered and s != "mat2vec_embedding":
            own = own.withColumn(f"_{s}", materials.looked_up(key, materials.literal_map(elements[s][0])))
    at = 0
    for s in sets:
        if s in graphs:
            told = molecules.names_of(s)
            parts.append(F.slice("_graph", at + 1, len(told)))
            at += len(told)
        elif s == "composition" and s not in registered:
            both = materials.element_counts(F.col("_formula"), present) | materials.weighted_means(F.col("_formula"), materials.literal_map(ELEMENTS), PROPERTIES)
            parts.append(F.array(*both.values()))
            told = [*both]
        elif s == "precomputed_embedding" and s not in registered:
            parts.append(F.col("embedding"))
            told = [f"emb_{i}" for i in range(size)]
        elif s == "nucleotide_composition" and s not in registered:
            both = sequences.nucleotide_composition(None, {k: F.col(f"_n_{k}") for k in bases})
            parts.append(F.array(*both.values()))
            told = [*both]
        elif s == "sequence_properties" and s not in registered:
            both = sequences.sequence_properties(None, {k: F.col(f"_r_{k}") for k in residues})
            parts.append(F.array(*both.values()))
            told = [*both]
        else:
            parts.append(_set(s, key))
            told = None if s in registered or s == "mat2vec_embedding" else feature_names([s], 0)
        names = None if names is None or told is None else names + told
    return own.select("entity", cleaned(F.concat(*parts)).alias("features", metadata={"names": names or []}))


def featurized(entities: DataFrame, config: Entity, cache: str | None = None) -> DataFrame:
    """entity, features (array<double>, cleaned). All sets come from one projection; only embeddings of a file are joined. cache: a folder to keep them in."""
    sets = config.features or DEFAULTS[config.type]
    make = lambda: _computed(entities, config, sets)
    if not cache or any(s in registered for s in sets):  # what a registered function computes has no content to go by
        return make()
    tables = {s: json.dumps([sorted((k, list(v)) for k, v in elements[s][0].items()), [list(x) if isinstance(x, (list, tuple)) else x for x in elements[s][1]]]) for s in sets if s in elements}
    told = {"smiles_map": json.dumps(config.smiles_map, sort_keys=True), "embedding_file": config.embedding_file, "structure_dir": config.structure_dir}
    return cached(entities.sparkSession, cache, "features", content_key(entities, config.type, sets, tables | {k: v for k, v in told.items() if v not in (None, "null")}), make)


@dataclass
class Result:
    rows: DataFrame
    assignments: dict[str, DataFrame]
    metrics: dict[str, dict]
    comparison: DataFrame | None


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """(key, group): each entity's scaffold, or what a registered function `scaffold` makes of it."""
    own = rows.where(F.col(key).isNotNull()).select(key).distinct()
    return own.withColumn("group", registered.get("scaffold", molecules.scaffold)(F.col(key)))


def _one_axis(technique: str, rows: DataFrame, features: DataFrame | None, config: Config, key: str = "e1", sparse: float | None = None) -> DataFrame:
    """sparse: the second axis's sparsity, where there is one."""
    names, ratios = config.splitting.names, config.splitting.splits
    if technique == "R":
        return splits.random_split(rows.where(F.col(key).isNotNull()), key, names, ratios)
    if technique == "I1e":
        return splits.identity_split(rows, key, names, ratios)
    if technique == "scaffold":
        own = _groups(rows, key)
        placed = splits.greedy_groups(own.groupBy("group").agg(F.count("*").alias("n")), "group", names, ratios)
        return own.join(placed.select("group", "split"), "group").select(key, "split")
    n, own_sparse = features.count(), distances.sparsity(features, "features").first().sparsity or 0.0
    c2 = "C2" in config.splitting.techniques
    metric, pca = distances.choose_metric(own_sparse, distances.binary(features, "features"), not config.e2 or c2)
    own = features
    if pca:
        k = distances.components_for(n, own.agg(F.max(F.size("features"))).first()[0] or 0)
        own = distances.reduced(own, "entity", "features", k)
    if metric == "euclidean":
        own = distances.standardised(own, "entity", "features")
    k = splits.cluster_count(n, own_sparse if sparse is None else sparse, key == "e2", config.splitting.e2_clusters, c2 and config.e2 is not None)
    # of fingerprints, unit vectors have neighbours by cosine, which orders them nearly as Tanimoto does
    return splits.cluster_split(own, "entity", "features", names, ratios, k, metric != "euclidean").withColumnRenamed("entity", key)


def run(spark: SparkSession, config: Config, write: bool = False, progress: Callable[[int, str], None] = lambda p, m: None) -> Result:
    """A technique that fails is left out; an error only if all do."""
    names = config.splitting.names
    techniques = config.splitting.techniques
    if not config.e2:  # techniques of two axes stand for those of one
        techniques = [*dict.fromkeys(ON_ONE_AXIS.get(t, t) for t in techniques)]
        if bad := [t for t in techniques if t not in TECHNIQUES_1D]:
            raise ValueError(f"{bad} need a second entity")
    progress(5, "load")
    loaded = load(spark, config.input, config.format, config.filters).persist()
    rows = loaded.withColumn("e1", F.col(config.e1.column).cast("string"))
    if config.e2:
        rows = rows.withColumn("e2", F.col(config.e2.column).cast("string"))
    progress(20, "features")
    features = {k: None for k in ("e1", "e2")}
    for k, e in (("e1", config.e1), ("e2", config.e2)):
        try:
            features[k] = featurized(filters.entities(rows, k), e, config.cache).persist() if e else None
        except ImportError as missing:  # only clusters need features; without them there are fewer metrics
            if any(t[0] == "C" for t in techniques):
                raise
            log.warning("no features of %s: %s", e.name, missing)
    if write:
        _write_features(features, config)
    assignments, told, failed = {}, {}, {}
    for i, technique in enumerate(techniques):
        progress(30 + 60 * i // len(techniques), technique)
        try:
            assignment, keys = _assign(technique, rows, features, config)
            assignment = assignment.persist()
            own = splits.assigned(rows, assignment, keys)
            assignments[technique] = own.select("_row_id", "split")
            told[technique] = _measured(own, assignment, features["e1"], keys, names)
            if write:
                _write(loaded, assignments[technique], told[technique], technique, config)
                if features["e1"] is not None and keys == ["e1"]:
                    drawn = distances.coordinates(features["e1"], "entity", "features").join(assignment.withColumnRenamed("e1", "entity"), "entity", "left")
                    drawn.write.mode("overwrite").csv(f"{config.output}/plots/{technique}_{config.e1.name}_coordinates", header=True)
        except (ValueError, RuntimeError, TypeError) as e:
            log.warning("%s failed: %s", technique, e)
            failed[technique] = e
    if failed and not assignments:
        raise RuntimeError(f"every technique failed: {failed}")
    summary = None
    if len(told) > 1:
        fields = "technique string, coverage double, mean_nn_dist double, e1_overlap double, mean_normalized_shift double"
        listed = [(t, m["coverage"], m.get("mean_nn_dist"), float(m["e1_overlap"]), m.get("mean_normalized_shift")) for t, m in sorted(told.items())]
        summary = metrics.compared(spark.createDataFrame(listed, fields))
        if write:
            summary.coalesce(1).write.mode("overwrite").json(f"{config.output}/metrics/comparison_{config.name}")
            metrics.comparison_long(summary).coalesce(1).write.mode("overwrite").csv(f"{config.output}/plots/comparison_{config.name}", header=True)
    for df in (loaded, *features.values()):
        if df is not None:
            df.unpersist()
    progress(100, "done")
    return Result(rows, assignments, told, summary)


def _assign(technique: str, rows: DataFrame, features: dict, config: Config) -> tuple[DataFrame, list[str]]:
    if not config.e2:
        return _one_axis(technique, rows, features["e1"], config), ["e1"]
    pairs = rows.where("e1 is not null and e2 is not null").select("e1", "e2")
    names, ratios = config.splitting.names, config.splitting.splits
    if technique == "R":
        both = pairs.distinct().withColumn("pair", F.concat_ws("\u0001", "e1", "e2"))
        cut = splits.by_cuts(F.col("_rank"), F.col("_n"), names, ratios).alias("split")
        return splits.ranked(both, "pair", splits.hash_order("pair")).select("e1", "e2", cut), ["e1", "e2"]
    sparse = distances.sparsity(features["e2"], "features").first().sparsity if technique[0] == "C" else None
    if technique in ("I1e", "I1f", "C1e", "C1f"):
        key = "e1" if technique[-1] == "e" else "e2"
        return _one_axis(technique[:2] + "e", rows, features[key], config, key, sparse), [key]
    one, two = (_one_axis(technique[0] + "1e", rows, features[k], config, k, sparse) for k in ("e1", "e2"))
    return splits.both_axes(pairs, "e1", "e2", one, two), ["e1", "e2"]


def _measured(own: DataFrame, assignment: DataFrame, features: DataFrame | None, keys: list[str], names: list[str]) -> dict:
    by_entity = assignment.select(F.col("e1").alias("entity"), "split") if keys == ["e1"] else None
    if by_entity is None:
        pairs = own.where("e1 is not null").select("e1", *([] if "e2" not in own.columns else ["e2"]), "split").distinct()
        by_entity = metrics.majority_split(pairs, "e1", names).withColumnRenamed("e1", "entity")
    out = {"split_counts": {r.split: r.n for r in metrics.split_counts(by_entity, names).collect()}}
    out["row_counts"] = {r.split: r.rows for r in metrics.row_counts(own, names).collect()}
    out |= metrics.coverage(by_entity, names).first().asDict()
    for key in ("e1", "e2"):
        if key in own.columns:
            out |= {f"{key}_{k}": v for k, v in metrics.entity_overlap(own, key, names).first().asDict().items()}
    if features is not None and "train" in names and all(out["split_counts"][n] for n in (names[0], names[-1])):
        size, zero = F.max(F.size("features")), F.bool_or(F.forall("features", lambda x: x == 0))
        told = features.agg(size.alias("dims"), zero.alias("zero")).first()
        out["metric"] = metrics.leakage_metric(told.dims, told.zero)
        out |= metrics.nn_leakage(features, by_entity, "entity", "features", names, out["metric"]).first().asDict()
        out |= metrics.distribution_shift(features, by_entity, "entity", "features", names).first().asDict()
    return out


def _write(loaded: DataFrame, assignment: DataFrame, measured: dict, technique: str, config: Config) -> None:
    """The splits in the input's format, and folders with each row's split, row numbers, all columns with the split, and the metrics."""
    names, label, out = config.splitting.names, f"{technique}_{config.name}", config.output
    fmt = config.format or detect(config.input)
    keyed = fmt == "json" and not loaded.sparkSession.read.text(config.input, wholetext=True).select(F.ltrim("value").startswith("[").alias("x")).first().x
    write_splits(loaded, assignment, names, fmt, f"{out}/split_result/{label}", keyed)
    assignment.write.mode("overwrite").csv(f"{out}/split_result/split_{label}", header=True)
    indices(loaded, assignment, names).write.mode("overwrite").json(f"{out}/ml_exports/{label}_indices")
    fold_column(loaded, assignment).write.mode("overwrite").csv(f"{out}/ml_exports/{label}_folds", header=True, escape='"')
    spark = loaded.sparkSession
    spark.createDataFrame([(json.dumps(measured, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/metrics/{label}")


def _write_features(features: dict[str, DataFrame | None], config: Config) -> None:
    for k, e in (("e1", config.e1), ("e2", config.e2)):
        if e and features[k] is not None and (one := features[k].select(F.size("features").alias("n")).first()):
            names = features[k].schema["features"].metadata.get("names") or feature_names(e.features or DEFAULTS[e.type], one.n)
            features_csv(features[k], "entity", "features", names, f"{config.output}/features/{config.name}/{e.name}")
