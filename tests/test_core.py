"""Placement, distances, filters, molecules, files and jobs against plain versions of them."""

import hashlib
import json
import random
import sqlite3
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.functions import elements, materials, molecules, sequences
from partwise.operators import distances, filters, metrics, splits
from partwise.operators.filters import Filter
from partwise.plans.config import parse
from partwise.plans.pipeline import run
from partwise.sources import readers, writers


@pytest.mark.parametrize("names, ratios", [(["train", "test"], [8, 2]), (["train", "val", "test"], [7, 2, 1]), (["a", "b", "c"], [1, 1, 1])])
@pytest.mark.parametrize("most", [1, 60])
def test_greedy_placement_equals_simulation(spark, names, ratios, most):
    rng = random.Random(len(names) + most)
    groups = [(f"g{i}", rng.choice([1, 1, 1, 2, rng.randint(1, most)])) for i in range(400)] + [("huge", 900)] * (most > 1)
    open_, total, expected = [sum(n for _, n in groups) * r for r in ratios], sum(ratios), {}
    for k, n in sorted(groups, key=lambda g: (-g[1], hashlib.md5(f"{g[0]}|42".encode()).hexdigest())):
        j = max(range(len(names)), key=lambda j: (open_[j], -j))
        expected[k] = names[j]
        open_[j] -= n * total
    got = splits.greedy_groups(spark.createDataFrame(groups, "k string, n long"), "k", names, ratios)
    assert {r.k: r.split for r in got.collect()} == expected
    assert splits.greedy_groups(spark.createDataFrame([], "k string, n long"), "k", names, ratios).count() == 0


def test_copies_are_at_distance_zero(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 64)) * 100
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    test, train = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame([(1000 + i, v) for i, v in rows], "id long, v array<double>")
    for metric in ("euclidean", "cosine"):
        assert distances.nearest_distance(test, train, "id", "v", metric).where("distance = 0").count() == 300
    a, b = x[:50], x[100:250]
    brute = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).min(1)
    assert np.allclose(distances.exact_nearest(a, b, "euclidean"), brute, rtol=1e-12)


def test_numbers_and_texts_in_filters(spark):
    df = spark.createDataFrame([(1, "a", True), (None, "5", False), (3, None, None)], "n int, t string, b boolean")
    kept = lambda c, v: filters.filtered(df, [Filter(c, not_equal=v)]).count()
    assert [kept("n", 1), kept("n", ""), kept("n", "1"), kept("t", "5"), kept("t", 5), kept("b", True), kept("n", 1.0)] == [2, 3, 3, 2, 3, 2, 2]


def test_row_numbers_stay_in_the_jvm(spark, tmp_path):
    spark.range(1000, numPartitions=7).write.parquet(str(tmp_path / "p.parquet"))
    df = readers.load(spark, str(tmp_path / "p.parquet"))
    assert sorted(int(r._row_id) for r in df.collect()) == [*range(1000)]
    plan = df.select("_row_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_quoted_cells_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"one\ntwo"\n2,b\n')
    (tmp_path / "b.csv").write_text('x,y\n1,"one, two"\n2,b\n')
    for name, first in (("a", "one\ntwo"), ("b", "one, two")):
        assert [tuple(r) for r in readers.load(spark, str(tmp_path / f"{name}.csv")).orderBy("x").collect()] == [("0", 1, first), ("1", 2, "b")]
    (tmp_path / "c.tsv").write_text("x\ty\n1\ta\n")
    assert readers.load(spark, str(tmp_path / "c.tsv")).first().y == "a"


# ---- molecules


@pytest.mark.parametrize("smiles, formula, weight, rings, aromatic, rotatable, surface", [
    ("CCO", "C2H6O", 46.069, 0, 0, 0, 20.23), ("CC(=O)Oc1ccccc1C(=O)O", "C9H8O4", 180.159, 1, 1, 3, 63.60), ("C1=CC=CC=C1", "C6H6", 78.114, 1, 1, 0, 0),
    ("CC(C)Cc1ccc(cc1)C(C)C(=O)O", "C13H18O2", 206.285, 1, 1, 4, 37.30), ("c1ccc2ccccc2c1", "C10H8", 128.174, 2, 2, 0, 0), ("c1cc[nH]c1", "C4H5N", 67.091, 1, 1, 0, 15.79),
    ("[Na+].[Cl-]", "ClNa", 58.44, 0, 0, 0, 0), ("C1CC2CCC1C2", "C7H12", 96.173, 2, 0, 0, 0), ("[H]O[H]", "H2O", 18.015, 0, 0, 0, 0), ("N[C@@H](C)C(=O)O", "C3H7NO2", 89.094, 0, 0, 1, 63.32),
])
def test_molecules(smiles, formula, weight, rings, aromatic, rotatable, surface):
    """Published values."""
    m = molecules.parse(smiles)
    own, more = molecules.physicochemical(m), molecules.rdkit_descriptors(m)
    assert m.formula() == formula and own["mol_weight"] == pytest.approx(weight, abs=0.01)
    assert (own["num_rings"], own["num_aromatic_rings"], own["num_rotatable_bonds"]) == (rings, aromatic, rotatable)
    if formula != "H2O":
        assert more["TPSA"] == pytest.approx(surface, abs=0.01)
    again = molecules.parse(m.smiles())
    assert again.formula() == formula and again.scaffold() == m.scaffold() and (again.fingerprint() == m.fingerprint()).all()


@pytest.mark.parametrize("bad", ["", None, "C(", "C1CC", "C=", "hello", "C(C)(C)(C)(C)C", "c1ccc", "=C", "C..C", "CC)", "C1C1", "[Xx]"])
def test_texts_that_are_no_molecules(bad):
    assert molecules.parse(bad) is None


def test_molecule_columns(spark):
    df = spark.createDataFrame([("CCO",), (None,), ("no molecule",), ("Cc1ccccc1",), ("OCC",)], "s string")
    rows = df.select(molecules.features(F.col("s"), ["physicochemical", "morgan_fingerprint"]).alias("v"), molecules.formula(F.col("s")).alias("f"), molecules.scaffold(F.col("s")).alias("g"), molecules.is_smiles(F.col("s")).alias("i")).collect()
    assert [len(r.v) for r in rows] == [11 + 2048] * 5 and not any(rows[1].v) and rows[0].v == rows[4].v
    assert [r.f for r in rows] == ["C2H6O", None, "no molecule", "C7H8", "C2H6O"] and [r.i for r in rows] == [True, False, False, True, True]
    assert rows[0].g == "" and rows[2].g == "_no_scaffold" and len(rows[3].g) == 24


def test_random_graphs_have_names_by_shape():
    """Scaffold names don't depend on the order in which atoms are written."""
    rng = random.Random(5)
    for smiles in ("c1ccc(cc1)C2CCN(CC2)Cc3ccc4ccccc4c3", "CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "C1CC2(C1)CCC2"):
        m = molecules.parse(smiles)
        for _ in range(5):
            order = rng.sample(range(len(m.symbols)), len(m.symbols))
            at = {old: new for new, old in enumerate(order)}
            pick = lambda x, order=order: [x[i] for i in order]
            bonds = {tuple(sorted((at[i], at[j]))): o for (i, j), o in m.bonds.items()}
            other = molecules.Molecule(pick(m.symbols), pick(m.aromatic), pick(m.charge), pick(m.hydrogens), bonds)
            assert other.scaffold() == m.scaffold() and (other.fingerprint() == m.fingerprint()).all()


MOL = """{}
  made

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 C   0  0
    1.0000    0.0000    0.0000 C   0  0
    2.0000    0.0000    0.0000 O   0  0
  1  2  1  0
  2  3  {}  0
M  END
"""


def test_molecule_files(spark, tmp_path):
    props = "> <logP>\n{}\n\n> <name>\n{}\n\n$$$$\n"
    (tmp_path / "a.sdf").write_text(MOL.format("ethanol", 1) + props.format("-0.1", "x") + MOL.format("", 2) + props.format("0.4", "y") + "broken\n\n\nno counts\n$$$$\n")
    got = readers.load(spark, str(tmp_path / "a.sdf"))
    assert sorted((r._row_id, r.smiles, r.formula, r.logP, r.name) for r in got.collect()) == [("1", "CC=O", "C2H4O", 0.4, "y"), ("ethanol", "CCO", "C2H6O", -0.1, "x")]
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "one.sdf").write_text(MOL.format("", 1) + "$$$$\n")
    (folder / "two.sdf").write_text((MOL.format("", 1) + "$$$$\n") * 2)
    rows = readers.load(spark, str(folder))
    assert sorted(r._row_id for r in rows.collect()) == ["one", "two_0", "two_1"]
    (tmp_path / "m.mol").write_text(MOL.format("t", 1))
    assert [(r._row_id, r.smiles) for r in readers.load(spark, str(tmp_path / "m.mol")).collect()] == [("m", "CCO")]
    (tmp_path / "x.mol").write_text("nothing")
    with pytest.raises(Exception, match="no molecule in"):
        readers.load(spark, str(tmp_path / "x.mol")).collect()
    (tmp_path / "b.mol2").write_text("@<TRIPOS>MOLECULE\nb\n2 1\n@<TRIPOS>ATOM\n1 C1 0 0 0 C.3\n2 O1 0 0 1 O.3\n@<TRIPOS>BOND\n1 1 2 1\n")
    assert [(r._row_id, r.smiles, r.formula) for r in readers.load(spark, str(tmp_path / "b.mol2")).collect()] == [("b", "CO", "CH4O")]
    assignment = spark.createDataFrame([("one", "train"), ("two_0", "test"), ("two_1", "test")], "_row_id string, split string")
    writers.write_splits(rows, assignment, ["train", "test"], "sdf_dir", str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out/test").iterdir()] == ["two.sdf"] and (tmp_path / "out/train/one.sdf").read_text() == (folder / "one.sdf").read_text()


def test_structure_database(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("CREATE TABLE systems (id INTEGER, numbers BLOB, key_value_pairs TEXT)")
    db.execute("INSERT INTO systems VALUES (1, ?, ?)", (struct.pack("<3i", 8, 1, 1), json.dumps({"energy": -1.5})))
    db.commit()
    db.close()
    assert [(r._row_id, r.formula, r.energy) for r in readers.load(spark, str(tmp_path / "s.db")).collect()] == [("0", "H2O", -1.5)]


def test_crystal_without_a_formula(spark, tmp_path):
    (tmp_path / "n.cif").write_text("data_n\n_cell_length_a 5\nloop_\n_atom_site_label\n_atom_site_type_symbol\nNa1 Na\nCl1 Cl\nCl2 Cl\n")
    assert readers.load(spark, str(tmp_path / "n.cif")).first().formula == "Cl2Na"


# ---- files


def test_sinks_keep_the_format(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"k": {"a": 1, "b": None}, "l": {"a": 2, "b": "x"}, "m": {"a": 3, "b": "y"}}))
    rows = readers.load(spark, str(tmp_path / "d.json"))
    assignment = spark.createDataFrame([("k", "train"), ("l", "train"), ("m", "test")], "_row_id string, split string")
    writers.write_splits(rows, assignment, ["train", "test"], "json", str(tmp_path / "o"), keyed=True)
    told = lambda name: [json.loads(p.read_text()) for p in (tmp_path / name).glob("part-*") if p.read_text().strip()]
    assert {k: v for part in told("o/train") for k, v in part.items()} == {"k": {"a": 1, "b": None}, "l": {"a": 2, "b": "x"}}
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}, {"a": 3}]))
    listed = spark.createDataFrame([("0", "train"), ("1", "test"), ("2", "train")], "_row_id string, split string")
    writers.write_splits(readers.load(spark, str(tmp_path / "l.json")), listed, ["train", "test"], "json", str(tmp_path / "p"))
    assert sorted(x["a"] for part in told("p/train") for x in part) == [1, 3]
    (tmp_path / "f.fasta").write_text(">p1 first one\nACD\n>p2\nKL\n")
    writers.write_splits(readers.load(spark, str(tmp_path / "f.fasta")), spark.createDataFrame([("p1", "train")], "_row_id string, split string"), ["train"], "fasta", str(tmp_path / "q"))
    assert "".join(p.read_text() for p in (tmp_path / "q/train").glob("part-*")) == ">p1 first one\nACD\n"
    folder = tmp_path / "x"
    folder.mkdir()
    for n in ("w", "v"):
        (folder / f"{n}.xyz").write_text("1\n\nO 0 0 0\n")
    writers.write_splits(readers.load(spark, str(folder)), spark.createDataFrame([("w", "train"), ("v", "test")], "_row_id string, split string"), ["train", "test"], "xyz_dir", str(tmp_path / "r"))
    assert (tmp_path / "r/train/w.xyz").exists() and not (tmp_path / "r/train/v.xyz").exists()


def test_embedding_files(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",)], "entity string")
    np.savez(tmp_path / "e.npz", ids=np.array(["a", "c"]), embeddings=np.array([[1.0, 2], [3, 4]]))
    np.save(tmp_path / "e.npy", np.array([[1.0, 2], [3, 4]]))
    (tmp_path / "e.csv").write_text("id,x,y\na,1,2\n")
    of = lambda name: {r.entity: r.embedding for r in readers.read_embeddings(spark, str(tmp_path / name), ids).collect()}
    assert of("e.npz") == {"a": [1, 2], "c": [3, 4]} and of("e.npy") == {"a": [1, 2], "b": [3, 4]} and of("e.csv") == {"a": [1, 2]}
    with pytest.raises(ValueError):
        of("e.txt")
    entity = parse({"dataset": {"name": "n", "input": "i"}, "splitting": {"techniques": ["R"]}, "e": {"name": "p", "type": "biomolecule", "extract": {"column": "s"}, "features": ["precomputed_embedding"], "embedding_file": str(tmp_path / "e.npz")}}).e1
    from partwise.plans.pipeline import featurized

    assert {r.entity: r.features for r in featurized(ids, entity).collect()} == {"a": [1, 2], "b": [0, 0]}


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "x\n1\n")
    assert readers.unpacked(str(tmp_path / "a.zip"), str(tmp_path / "u")).endswith("a.csv")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../b.csv", "x\n1\n")
    with pytest.raises(ValueError):
        readers.unpacked(str(tmp_path / "b.zip"), str(tmp_path / "v"))


# ---- features and the pipeline


def test_default_material_features(spark):
    from partwise.plans.pipeline import featurized

    entity = parse({"dataset": {"name": "n", "input": "i"}, "splitting": {"techniques": ["R"]}, "e": {"name": "m", "type": "material", "extract": {"column": "f"}}}).e1
    own = featurized(spark.createDataFrame([("Fe2O3",), ("",), ("Xx2",)], "entity string"), entity)
    rows = {r.entity: r.features for r in own.collect()}
    names = own.schema["features"].metadata["names"]
    assert len(names) == len(rows["Fe2O3"]) == 30 + 8 + 12 + 9 + 8 + 8 and not any(rows[""])
    mass = elements.ELEMENTS["Fe"][1] * 2 + elements.ELEMENTS["O"][1] * 3
    assert rows["Fe2O3"][names.index("atomic_mass_mean")] == pytest.approx(mass / 5)


def test_trinucleotides(spark):
    text = "ATGCGATTTACAGUNNATG"
    got = spark.createDataFrame([(text,), ("",), (None,)], "s string").select(sequences.kmer_frequencies(F.col("s"), 3).alias("f")).collect()
    s = text.replace("U", "T")
    kinds = [a + b + c for a in "ATGC" for b in "ATGC" for c in "ATGC"]
    assert got[0].f == pytest.approx([sum(s[i : i + 3] == k for i in range(len(s) - 2)) / (len(s) - 2) for k in kinds])
    assert got[1].f == got[2].f == [0.0] * 64


def test_two_axes(spark, tmp_path):
    rng = random.Random(9)
    genes = ["".join(rng.choice("ATGC") for _ in range(40)) for _ in range(24)]
    drugs = ["C" * (i + 1) + "c1ccccc1" * (i % 2) + "O" for i in range(12)]
    lines = [f"{g},{d},{rng.random():.3f}" for g in genes for d in drugs if rng.random() < 0.6]
    (tmp_path / "i.csv").write_text("gene,drug,y\n" + "\n".join(lines) + "\n")
    config = parse({
        "dataset": {"name": "i", "input": str(tmp_path / "i.csv"), "output": str(tmp_path / "o"), "cache": str(tmp_path / "c")},
        "e1": {"name": "gene", "type": "gene", "extract": {"column": "gene"}}, "e2": {"name": "drug", "type": "molecule", "extract": {"column": "drug"}, "features": ["physicochemical"]},
        "splitting": {"techniques": ["R", "I1e", "I1f", "I2", "C1e", "C1f", "C2"]},
    })
    result = run(spark, config, write=True)
    assert set(result.metrics) == {"R", "I1e", "I1f", "I2", "C1e", "C1f", "C2"}
    assert all(result.metrics[t]["e1_overlap"] == 0 for t in ("I1e", "C1e", "I2", "C2")) and all(result.metrics[t]["e2_overlap"] == 0 for t in ("I1f", "C1f", "I2", "C2"))
    assert result.metrics["R"]["row_counts"]["not selected"] == 0 and sum(result.metrics["I2"]["row_counts"].values()) == len(lines)
    assert result.metrics["R"]["e1_total"] == 24 and any(p.name.startswith("features_") for p in (tmp_path / "c").iterdir())


def test_technique_rules():
    assert splits.cluster_count(300, 0.0) == 15 and splits.cluster_count(300, 0.6, c2=True) == 3 and splits.cluster_count(5, 0.6, c2=True) == 2
    assert splits.cluster_count(300, 0.95, True) == 6 and splits.cluster_count(300, 0.6, True) == 15 and splits.cluster_count(300, 0.1, True) == 30
    assert distances.choose_metric(0.95, False, True) == ("euclidean", True) and distances.choose_metric(0.95, False) == ("cosine", False) and distances.choose_metric(0.95, True, True) == ("tanimoto", False)
    assert distances.components_for(10, 50) == 9 and distances.components_for(100, 50) == 20 and distances.components_for(100, 7) == 7
    assert metrics.leakage_metric(101, False) == "cosine" and metrics.leakage_metric(101, True) == metrics.leakage_metric(100, False) == "euclidean"


def test_jobs(spark, tmp_path):
    from partwise.plans import jobs

    own = jobs.Jobs(spark, str(tmp_path))
    lines = "smiles,y\n" + "".join(f"{'C' * (i + 2)}O,{i}\n" for i in range(20))
    taken = own.take("../some file.csv", lines.encode())
    assert taken["format"] == "csv" and taken["stats"]["total_rows"] == 20 and len(taken["preview"]) == 10
    raw = {"e": {"name": "m", "type": "molecule", "extract": {"column": "smiles"}, "features": ["physicochemical"]}, "splitting": {"techniques": ["R"], "splits": jobs.ratio("90/10")}}
    with pytest.raises(ValueError):
        own.results(taken["job"])
    own.start(taken["job"], raw, wait=True)
    assert own.status(taken["job"])["status"] == "completed" and [*own.follow(taken["job"])][-1]["progress"] == 100
    with zipfile.ZipFile(own.results(taken["job"], "R")) as z:
        assert any("train" in n for n in z.namelist())
    own.start(taken["job"], raw | {"e": raw["e"] | {"extract": {"column": "nope"}}}, wait=True)
    assert own.status(taken["job"])["error"].startswith("Column nope")
    assert own.take("b.csv", b"")["job"] and own.expire() == [] and len(own.expire(-1)) == 2
    with pytest.raises(ValueError):
        own.take("c.csv", b"123", most=2)


# ---- streams


def test_rate_limit_of_a_stream(spark, tmp_path):
    """At most three allowed events in any 60 seconds; refused ones don't count. Against a plain simulation."""
    from partwise.streaming import rates

    rng = random.Random(3)
    events = sorted((rng.choice("ab"), 1_700_000_000 + rng.randrange(0, 400)) for _ in range(60))
    df = spark.createDataFrame(events, "who string, s long").select("who", F.timestamp_seconds("s").alias("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = rates.limited(stream, "who", "t", 3, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    began = time.monotonic()  # its timeouts keep it busy, so it is stopped when all events are out
    while spark.table("limited").count() < len(events) and time.monotonic() - began < 60:
        time.sleep(0.5)
    query.stop()
    got = sorted((r.who, int(r.s), r.allowed) for r in spark.table("limited").select("who", F.unix_timestamp("t").alias("s"), "allowed").collect())
    expected, recent = [], {}
    for who, s in events:
        recent[who] = [x for x in recent.get(who, []) if s - x < 60]
        expected.append((who, s, len(recent[who]) < 3))
        recent[who] += [s] * expected[-1][2]
    assert got == sorted(expected)


def test_stream_split_is_the_batch_split(spark):
    from partwise.streaming import rates

    rows = rates.stream_split(spark.range(5000), "id", ["train", "val", "test"], [8, 1, 1])
    shares = {r.split: r["count"] / 5000 for r in rows.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["val"] - 0.1) < 0.02
    assert rows.exceptAll(rates.stream_split(spark.range(5000).repartition(7), "id", ["train", "val", "test"], [8, 1, 1])).count() == 0


def test_composition_is_summed(spark):
    own = spark.createDataFrame([("FeOFe2",), ("",), (None,)], "f string").select(materials.composition(F.col("f")).alias("c")).collect()
    assert [(x.element, x["count"]) for x in own[0].c] == [("Fe", 3), ("O", 1)] and own[1].c == own[2].c == []
