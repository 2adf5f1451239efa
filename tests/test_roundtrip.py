import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge import cli
from pairforge.operators import geometry, roundtrip, stores
from pairforge.sources import readers, sinks

RECORD = "row_idx long, uid string, z_src array<array<double>>, z_gen array<array<double>>, z_true array<array<double>>, true_target string, gen_target string, pppl_gen double, pppl_true double"
AXES = np.eye(4).tolist()
#: The second target was made as if from the third source, whose uid differs; the first two share theirs.
RECORDS = [
    (0, "kiwi", [AXES[0]], [AXES[0]], [AXES[0]], "MK\tV", "mk1v ", 2.0, None),
    (1, "kiwi", [AXES[1]], [AXES[2]], [AXES[1]], "AA", "A  A", float("nan"), None),
    (2, "plum", [AXES[2]], [AXES[2]], [AXES[2]], "", "C", 4.0, None),
]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(RECORDS, RECORD).repartition(3)
    metrics = roundtrip.write(df, str(tmp_path), {"direction": "up"})
    assert json.loads(spark.read.text(str(tmp_path / "metrics")).first().value) == metrics
    assert metrics["n"] == 3 and metrics["direction"] == "up" and metrics["pppl_gen"] == 3.0 and "pppl_true" not in metrics
    assert metrics["generated_to_source"]["r1"] == pytest.approx(2 / 3) and metrics["true_to_source"]["r1"] == 1.0
    assert not {"r5", "r10"} & set(metrics["generated_to_source"])
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "pairs"), sep="\t", header=True).collect()]
    assert [r[:5] for r in rows] == [("kiwi", "1", "1.0000", "4", "4"), ("kiwi", "2", "0.0000", "2", "3"), ("plum", "1", "1.0000", "0", "1")]
    lines = [r.value for r in spark.read.text(str(tmp_path / "sequences")).collect()]
    assert lines == [">true|kiwi", "MKV", ">generated|kiwi", "MKV", ">true|kiwi", "AA", ">generated|kiwi", "AA", ">true|plum", "", ">generated|plum", "C"]
    df.write.parquet(str(tmp_path / "records"))
    assert cli.main(["roundtrip", str(tmp_path / "records"), str(tmp_path / "again")]) == 0
    assert not (tmp_path / "again/sequences").exists() and (tmp_path / "again/pairs").exists()


def test_round_trip_of_nothing(spark):
    none = spark.createDataFrame([], RECORD)
    assert roundtrip.pairs(none).count() == 0 and roundtrip.perplexities(none) == {}


def test_generated_set(spark, tmp_path):
    schema = "accession string, replicate int, j int, prompt string, true_protein string, generated_protein string, score double"
    rows = [("a", 0, 0, "p", "MM", "first", 0.5), ("a", 0, 1, "p", "MM", "tie", 0.5), ("a", 0, 2, "p", "MM", "less", 0.25), ("a", 1, 0, "p", "MM", "odd", float("nan")), ("a", 1, 1, "p", "MM", "won", -3.0), ("b", 0, 0, "q", "M", "alone", None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in roundtrip.generated_set(df).collect())
    assert got == [("a", 0, "p", "MM", "first", "0.5000", 2, 5), ("a", 1, "p", "MM", "won", "-3.0000", 2, 3), ("b", 0, "q", "M", "alone", "nan", 1, 5)]
    df.write.parquet(str(tmp_path / "c"))
    assert cli.main(["generated", str(tmp_path / "c"), str(tmp_path / "out")]) == 0
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["accession", "replicate", "prompt", "true_protein", "generated_protein", "select_score", "true_len", "gen_len"]


def test_spread_against_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, p, (rng.normal(size=3) + 2).tolist()) for s in "ab" for i in range(7) for p in range(1 if i == 3 else 4)]
    df = spark.createDataFrame(rows, "side string, item_id long, pos int, v array<double>")
    got = {r.side: r for r in geometry.spread_report(df, probe=100, each=100).collect()}

    def cos(vectors):
        u = np.array([v / np.linalg.norm(v) for v in vectors])
        s = u @ u.T
        return s[~np.eye(len(u), dtype=bool)].mean()

    for s in "ab":
        items = [[np.array(v) for a, b, _, v in rows if (a, b) == (s, i)] for i in range(7) if i != 3]
        pool = np.array([v for x in items for v in x])
        mean = pool.mean(0)
        assert got[s].sequences == 6
        assert got[s].within == pytest.approx(np.mean([cos(x) for x in items])) and got[s].raw == pytest.approx(cos(pool)) and got[s].centered == pytest.approx(cos(pool - mean))
        assert got[s].to_mean == pytest.approx(np.mean(np.abs(pool @ mean) / np.linalg.norm(pool, axis=1) / np.linalg.norm(mean)))
    assert geometry.spread_report(df, probe=2).agg(F.max("sequences")).first()[0] <= 2
    assert geometry.spread_report(df.where("false")).count() == 0


def test_references(spark):
    rows = spark.createDataFrame([(0,), (0,), (5,), (None,)], "item long")
    items = spark.createDataFrame([(0,), (1,)], "id long")
    assert tuple(stores.references(rows, "item", items, "id").first()) == (4, 2, 1, 1, 1)
    assert tuple(stores.references(rows.where("false"), "item", items.where("false"), "id").first()) == (0, 0, 0, 0, 0)


def test_cells_beyond_the_limit_raise(spark, tmp_path):
    (tmp_path / "p.csv").write_text("primary_Accession,protein_sequence,[final]text_caption\nk," + "M" * 300 + ",t\n")
    path = str(tmp_path / "p.csv")
    assert readers.read_pairs(spark, path, most_chars=300).count() == 1
    with pytest.raises(Exception, match="(?i)field larger than field limit"):
        readers.read_pairs(spark, path, most_chars=299).collect()


def test_matrix(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 2, 3.0), (9, 9, 9.0)], "q long, c long, s double")
    got = sinks.write_matrix(cells, str(tmp_path / "m.npy"), "q", "c", "s", 4)
    assert np.array_equal(np.load(tmp_path / "m.npy"), got, equal_nan=True) and got.shape == (2, 3) and got[1, 2] == 3 and np.isnan(got[0, 1])
    assert sinks.write_matrix(cells, str(tmp_path / "e.npy"), "q", "c", "s", 0).shape == (0, 0)


def test_export_and_diagnose(spark, tmp_path, capsys):
    (tmp_path / "p.csv").write_text("primary_Accession,protein_sequence,[final]text_caption\nk,MKV,one two\nl,MKV,three\n")
    csv, store, merged, out = (str(tmp_path / x) for x in ("p.csv", "store", "merged", "out"))
    cli.encode_csv(spark, csv, store)
    assert cli.main(["merge", csv, merged]) == 0 and cli.main(["export", store, out, merged]) == 0 and cli.main(["diagnose", store]) == 0
    assert spark.read.parquet(out + "/pooled").count() == 4
    assert [tuple(r) for r in spark.read.parquet(out + "/accessions").collect()] == [(0, "k")]
    assert sorted(tuple(r) for r in spark.read.parquet(out + "/rows").collect()) == [(0, 0), (1, 0)]
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["sequences"] >= 1
