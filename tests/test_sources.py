import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partwise.operators.filters import Filter
from partwise.plans.config import parse
from partwise.plans.pipeline import run
from partwise.queries import QUERIES, SQL
from partwise.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y,z\n1,a,\n2,NA,1.5\n"3","b, c",2\n')
    df = readers.load(spark, str(tmp_path / "a.csv"), filters=[Filter("y", not_equal="a")])
    assert rows(df, "_row_id", "x", "y", "z") == [("1", 2, None, 1.5), ("2", 3, "b, c", 2.0)]
    (tmp_path / "d.json").write_text(json.dumps({"k": {"a": 1}, "l": {"a": 2}}))
    assert rows(readers.load(spark, str(tmp_path / "d.json")), "_row_id", "a") == [("k", 1), ("l", 2)]
    (tmp_path / "s.json").write_text(json.dumps({"k": "v"}))
    assert rows(readers.load(spark, str(tmp_path / "s.json")), "_row_id", "value") == [("k", "v")]
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert rows(readers.load(spark, str(tmp_path / "l.json")), "_row_id", "a") == [("0", 1), ("1", 2)]


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("ignored\n>p1 first\nACD\nEFG\n>p2\nKL\n")
    assert rows(readers.load(spark, str(tmp_path / "a.fasta")), "_row_id", "sequence") == [("p1", "ACDEFG"), ("p2", "KL")]
    (tmp_path / "a.smi").write_text("CCO ethanol\n\nC\n")
    assert rows(readers.load(spark, str(tmp_path / "a.smi")), "_row_id", "smiles") == [("2", "C"), ("ethanol", "CCO")]


def atom(kind, name, res, chain, seq):
    return f"{kind:<6}{1:>5} {name:<4} {res:>3} {chain}{seq:>4}"


def test_structures(spark, tmp_path):
    lines = [atom("ATOM", "N", "ALA", "A", 2), atom("ATOM", "CA", "ALA", "A", 2), atom("ATOM", "N", "GLY", "A", 1), atom("HETATM", "O", "HOH", "A", 9), atom("HETATM", "C", "LIG", "A", 8)]
    (tmp_path / "1abc.pdb").write_text("\n".join(lines) + "\n")
    got = rows(readers.load(spark, str(tmp_path / "1abc.pdb")), "_row_id", "sequence", "ligand_id", "has_ligand")
    assert got == [("1abc_A_LIG", "GA", "LIG", True)]
    (tmp_path / "x.xyz").write_text("3\nwater\nO 0 0 0\nH 0 0 1\nH 0 1 0\n")
    assert rows(readers.load(spark, str(tmp_path / "x.xyz")), "_row_id", "formula") == [("x", "H2O")]
    (tmp_path / "n.cif").write_text("data_n\n_chemical_formula_sum 'Na1 Cl1'\n_cell_length_a 5\n")
    assert readers.detect(str(tmp_path / "n.cif")) == "cif"
    assert rows(readers.load(spark, str(tmp_path / "n.cif")), "_row_id", "formula") == [("n", "ClNa")]
    head = "data_p\nloop_\n_atom_site.group_PDB\n_atom_site.label_comp_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n"
    (tmp_path / "p.cif").write_text(head + "ATOM GLY B 1\nATOM ALA B 2\n")
    assert rows(readers.load(spark, str(tmp_path / "p.cif")), "_row_id", "sequence") == [("p_B", "GA")]


def test_config_errors():
    base = {"dataset": {"name": "n", "input": "i"}, "e1": {"name": "a", "type": "gene", "extract": {"column": "s"}}, "splitting": {"techniques": ["R"]}}
    assert parse(base).splitting.splits == [8, 2]
    for bad in ({"splitting": {"techniques": ["no"]}}, {"splitting": {"techniques": ["I2"]}}, {"e1": {"name": "a", "type": "x", "extract": {"column": "s"}}}, {"splitting": {"techniques": ["R"], "splits": [1]}}):
        with pytest.raises(ValueError):
            parse(base | bad)


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(3)
    text = "".join(f">s{i}\n{''.join(rng.choice('ATGC') for _ in range(60))}\n" for i in range(60))
    (tmp_path / "g.fasta").write_text(text)
    config = parse({
        "dataset": {"name": "g", "input": str(tmp_path / "g.fasta"), "output": str(tmp_path / "out"), "format": "fasta"},
        "e": {"name": "gene", "type": "gene", "extract": {"column": "sequence"}, "features": ["nucleotide_composition"]},
        "splitting": {"techniques": ["R", "I1e", "C1e"]},
    })
    result = run(spark, config, write=True)
    assert result.metrics["R"]["split_counts"] == {"train": 48, "test": 12}
    assert result.metrics["R"]["e1_overlap"] == 0 and result.metrics["C1e"]["coverage"] == 1.0
    assert result.comparison.where("recommended").count() == 1
    written = readers.read_fasta(spark, str(tmp_path / "out/split_result/R_g/train"))
    assert written.count() == 48
    told = writers.indices(result.rows, result.assignments["R"], ["train", "test"]).collect()
    assert sorted(r.position for r in told) == list(range(60)) and sum(r.split == "train" for r in told) == 48
    out = str(tmp_path / "out")
    assert spark.read.csv(f"{out}/split_result/split_R_g", header=True).count() == 60
    assert spark.read.json(f"{out}/ml_exports/R_g_indices").count() == 60
    assert spark.read.csv(f"{out}/ml_exports/C1e_g_folds", header=True).columns == ["sequence", "split"]
    assert json.loads(spark.read.text(f"{out}/metrics/R_g").first().value)["split_counts"] == {"train": 48, "test": 12}
    assert spark.read.json(f"{out}/metrics/comparison_g").count() == 3
    features = spark.read.csv(f"{out}/features/g/gene", header=True)
    assert features.columns[:3] == ["entity_id", "length", "freq_A"] and features.count() == 60


def test_molecules_end_to_end(spark, tmp_path):
    (tmp_path / "m.smi").write_text("".join(f"{'C' * (i + 1)} m{i}\n" for i in range(20)))
    config = {"dataset": {"name": "m", "input": str(tmp_path / "m.smi"), "output": str(tmp_path / "out")}, "e": {"name": "compound", "type": "molecule", "extract": {"column": "smiles"}}, "splitting": {"techniques": ["R", "C1e", "scaffold"]}}
    result = run(spark, parse(config), write=True)
    measured = result.metrics
    assert measured["R"]["split_counts"] == {"train": 16, "test": 4} and measured["R"]["row_counts"]["not selected"] == 0
    assert measured["R"]["metric"] == "cosine" and "mean_nn_dist" in measured["C1e"]
    assert measured["scaffold"]["split_counts"] == {"train": 20, "test": 0}  # no rings: one scaffold
    features = spark.read.csv(str(tmp_path / "out/features/m/compound"), header=True)
    assert features.columns[1] == "MolWt" and "count_C" in features.columns and features.columns[-1] == "morgan_2047"
    assert spark.read.csv(str(tmp_path / "out/plots/C1e_compound_coordinates"), header=True).count() == 20
    assert spark.read.csv(str(tmp_path / "out/plots/comparison_m"), header=True).where("best = 'true'").count() >= 2


def test_cache(spark, tmp_path):
    from partwise.plans import cache

    one = spark.createDataFrame([("a",), ("b",)], "entity string")
    key = cache.content_key(one, "gene", ["x", "y"])
    assert key == cache.content_key(one.orderBy("entity", ascending=False), "gene", ["y", "x"])
    assert len({key, cache.content_key(one, "gene", ["x"]), cache.content_key(one.limit(1), "gene", ["x", "y"]), cache.content_key(one, "gene", ["x", "y"], {"t": "1"})}) == 4
    made = []

    def make():
        made.append(1)
        return one

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "features", key, make).count() == 2
    assert len(made) == 1
    (tmp_path / f"features_{key}" / "_SUCCESS").unlink()
    assert cache.cached(spark, str(tmp_path), "features", key, make).count() == 2 and len(made) == 2
    assert cache.cached(spark, None, "features", key, make).count() == 2 and len(made) == 3


def test_hints():
    from partwise.operators.inference import hints

    types = [("a", "gene", 0.8), ("b", "gene", 0.9), ("c", "material", 0.7), ("d", None, 0.0)]
    own = hints(types, "csv")
    assert (own["suggested_e"]["column"], own["suggested_f"]["column"], own["format_default"]) == ("b", "c", None)
    assert hints(types[:2], "json")["suggested_f"]["name"] == "gene_2"
    assert hints([], "csv")["suggested_e"] is None
    own = hints([("sequence", "biomolecule", 1.0)], "pdb", ["sequence", "ligand_id"], has_ligand=True)
    assert (own["suggested_e"]["name"], own["suggested_f"]["name"]) == ("protein", "ligand")
    assert hints([("x", "molecule", 1.0)], "smiles")["suggested_e"]["column"] == "x"


def test_element_tables(spark):
    from partwise.plans import pipeline

    with pytest.raises(ValueError):
        pipeline.register_elements("stoichiometry", {})
    pipeline.register_elements("electronic", {"Fe": (6, 8, 3, 4.5)})
    try:
        entity = parse({"dataset": {"name": "n", "input": "i"}, "e": {"name": "m", "type": "material", "extract": {"column": "f"}, "features": ["electronic", "stoichiometry"]}, "splitting": {"techniques": ["R"]}}).e1
        got = pipeline.featurized(spark.createDataFrame([("Fe2O3",), ("",)], "entity string"), entity).collect()
        assert [len(r.features) for r in got] == [20, 20] and got[0].features[0] == pytest.approx(2.4) and not any(got[1].features)
        assert pipeline.feature_names(entity.features, 20)[0] == "d_electron_mean"
    finally:
        pipeline.elements["electronic"] = pipeline.TABLES["electronic"]


def test_row_numbers_follow_files_of_unlike_sizes(spark, tmp_path):
    """Spark reads the largest file first; numbers and positions follow the paths, also after a filter."""
    for name, first, n in (("a", 0, 3), ("b", 3, 4000), ("c", 4003, 20)):
        spark.range(first, first + n, 1, 1).toDF("doc_id").toPandas().to_parquet(str(tmp_path / f"{name}.parquet"))
        (tmp_path / f"{name}.smi").write_text("".join(f"C m{i}\n" for i in range(first, first + n)))
    got = readers.read_parquet(spark, f"{tmp_path}/*.parquet")
    assert all(int(r._row_id) == r.doc_id for r in got.collect()) and got.count() == 4023
    kept = got.where("doc_id % 2 = 1")
    split = kept.select("_row_id", F.when(F.col("doc_id") < 3, "train").otherwise("test").alias("split"))
    assert [tuple(r) for r in writers.indices(kept, split, ["train", "test"]).collect()] == [*(("test", i) for i in range(1, 2011)), ("train", 0)]
    lines = readers.numbered(spark.read.text(f"{tmp_path}/*.smi"))
    assert all(r.value == f"C m{r._row_id}" for r in lines.collect())


def test_ml_indices_equal_sql_on_files_out_of_order(spark, tmp_path):
    """Files of unlike sizes, ids out of order, with gaps and twice."""
    ids = [[5, 9, 2], [*range(40, 3000)], [7000, 1, 1, 3005]]
    for i, own in enumerate(ids):
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        pd.DataFrame({"doc_id": own, "text": ["x"] * len(own)}).to_parquet(str(tmp_path / f"documents.parquet/part-{i}.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.execute(SQL["ml_indices"]).fetchall()
    assert sorted(map(tuple, QUERIES["ml_indices"](spark, str(tmp_path)).collect())) == sorted(expected)
