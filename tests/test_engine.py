import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairforge import cli
from pairforge.functions import scalar
from pairforge.functions.shared import positions
from pairforge.operators import captions, encode, identity, maxsim, ranking, splits, stores
from pairforge.sources import readers, sinks

ROOT = Path(__file__).resolve().parent.parent
HEAD = "primary_Accession,protein_sequence,[final]text_caption,pfam_label\r\n"


@pytest.fixture
def csv(tmp_path):
    (tmp_path / "pairs.csv").write_bytes((HEAD + 'key1,MKV,"a, ""quoted""\ncell",\r\nkey2,,back\\slash,"[\'PF1\']"\r\nkey1,AAA,third,\r\nkey3,MK MK,third,x\r\n').encode())
    return str(tmp_path / "pairs.csv")


def test_pair_csv(spark, csv, tmp_path):
    got = [tuple(r) for r in readers.read_pairs(spark, csv).orderBy("row_idx").collect()]
    assert got == [(0, "key1", "MKV", 'a, "quoted"\ncell', None), (1, "key2", "", "back\\slash", "['PF1']"), (2, "key1", "AAA", "third", None), (3, "key3", "MK MK", "third", "x")]
    assert readers.read_pairs(spark, csv, subset=2).count() == 2
    (tmp_path / "bare.csv").write_text("primary_Accession,protein_sequence,[final]text_caption\nP9,M,t\n")
    assert readers.read_pairs(spark, str(tmp_path / "bare.csv")).first().pfam is None
    (tmp_path / "bad.csv").write_text("primary_Accession,protein_sequence\nP9,M\n")
    with pytest.raises(ValueError, match="text_caption"):
        readers.read_pairs(spark, str(tmp_path / "bad.csv"))


def test_ids_and_sidecars(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("  b \n\na\nb\n\t\nc\n")
    assert [tuple(r) for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).orderBy("ord").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    assert readers.read_sidecar(spark, str(tmp_path / "none.json"), "n long").count() == 0
    df = spark.createDataFrame([(3,)], "n long")
    sinks.write_sidecar(df, str(tmp_path / "s"))
    assert readers.read_sidecar(spark, str(tmp_path / "s"), "n long").first().n == 3
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a \t b\nc", "mkß1v")], "id long, t string, s string")
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), sep="\t", header=True).first().t == "a b c"
    sinks.write_fasta(df, str(tmp_path / "f"), "id", {"true": "s"})
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == [">true|1", "MKSSV"]


def test_command_line(spark, csv, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "splits")
    cli.encode_csv(spark, csv, store)
    assert readers.read_tokens(spark, store, "protein").count() == 4
    assert readers.read_tokens(spark, store, "text", 0).count() == 3
    assert {r.modality: r.n for r in cli.means(spark, store).collect()} == {"protein": 4, "text": 6}
    assert set(cli.evaluate(spark, store).first().asDict()) == {"r1", "r5", "r10"}
    assert {r.uid for r in cli.inspect(spark, csv, store, ["key1", "key3", "key1", "nope"]).collect()} == {"key1", "key3"}
    assert cli.main(["splits", csv, out, "--check"]) == 1
    assert cli.main(["splits", csv, out]) == 0 and cli.main(["splits", csv, out, "--check"]) == 0
    assert cli.main(["splits", csv, out, "--check", "--seed", "14"]) == 1
    assert spark.read.parquet(out + "/rows").groupBy("root").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


LABELS = ["DISH:", "ORIGIN:", "SEASON:", "SERVE WITH:"]
#: (uid, split, caption): a lead without label, a label twice, one uid in both splits, a caption of one field, one of none, and extra blanks.
MENU = [
    ("soup", 1, "DISH: Onion soup. ORIGIN: Lyon. SEASON: Winter."),
    ("fish", 0, "Today only. DISH: Trout. SEASON:   Spring. "),
    ("cake", 1, "DISH: Plum cake. ORIGIN: Prague. SEASON: Autumn. SERVE WITH: Cream."),
    ("bake", 0, "ORIGIN: Lyon. DISH: Quenelles. DISH: Gratin."),
    ("soup", 0, "DISH: Pea soup. ORIGIN: Ghent."),
    ("fair", 1, "SEASON: Summer."),
    ("void", 0, "Closed on Mondays"),
]


@pytest.fixture
def caps(spark):
    return spark.createDataFrame([(10 * k + 3, u, s, t) for k, (u, s, t) in enumerate(MENU)], "row_idx long, uid string, split int, text string")


def parsed(spark, text, labels=LABELS):
    df = spark.createDataFrame([(0, text)], "row_idx long, text string")
    return [(labels[r.label_id], text[r.vs : r.ve]) for r in captions.fields(df, "text", labels, ["row_idx"]).orderBy("fpos").collect()]


def test_fields(spark):
    assert parsed(spark, MENU[1][2]) == [("DISH:", "Trout."), ("SEASON:", "Spring.")]
    assert parsed(spark, MENU[3][2]) == [("ORIGIN:", "Lyon."), ("DISH:", "Quenelles."), ("DISH:", "Gratin.")]
    assert parsed(spark, "a SEASON:\t late\nDISH: stew \n") == [("SEASON:", "late"), ("DISH:", "stew")]
    assert parsed(spark, "DISH: sideORIGIN: kept") == [("DISH:", "sideORIGIN: kept")]
    assert parsed(spark, "SEASON: ORIGIN: kept") == [("ORIGIN:", "kept")]
    assert parsed(spark, "") == [] and parsed(spark, MENU[6][2]) == []
    assert parsed(spark, "TO: one TOP: two", ["TO:", "TOP:"]) == [("TO:", "one"), ("TOP:", "two")]


def test_plan_invariants(spark, caps):
    spans = captions.fields(caps, "text", LABELS, ["row_idx"])
    plan = [r.asDict() for r in captions.plan(caps, spans, 7, per_row=3).collect()]
    rows = {10 * k + 3: x for k, x in enumerate(MENU)}
    assert plan and {p["owner_row"] for p in plan} <= set(rows) - {63}
    for p in plan:
        (uid, split, text), (other, same, donor) = rows[p["owner_row"]], rows[p["donor_row"]]
        assert uid != other and split == same
        assert text[p["vs"] : p["ve"]] != donor[p["dvs"] : p["dve"]]
    again = captions.plan(caps.repartition(5), spans.repartition(3), 7, per_row=3)
    key = lambda p: (p["owner_row"], p["k"])
    assert sorted((r.asDict() for r in again.collect()), key=key) == sorted(plan, key=key)
    only = captions.plan(caps, captions.swap_filter(spans, [2], 10**6), 7)
    assert {r.label_id for r in only.collect()} <= {2}
    by = {key(p): p for p in plan}
    for r in captions.decoy_texts(caps, captions.plan(caps, spans, 7, per_row=3)).collect():
        p = by[r.owner_row, r.k]
        own, donor = rows[r.owner_row][2], rows[r.donor_row][2]
        assert r.text == own[: p["vs"]] + donor[p["dvs"] : p["dve"]] + own[p["ve"] :] != r.owner_text == own


def test_identical_values_give_no_decoy(spark):
    same = spark.createDataFrame([(0, "left", 0, "SEASON: mild"), (1, "right", 0, "SEASON: mild")], "row_idx long, uid string, split int, text string")
    assert captions.plan(same, captions.fields(same, "text", ["SEASON:"], ["row_idx"]), 7).count() == 0


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    for n in (1, 7):
        got = positions(df.repartition(n), ["k"], name="p").collect()
        assert all(r.p == r.k for r in got)
        by = {(r.g, r.k): r.p for r in positions(df.repartition(n), ["k"], ["g"], "p").collect()}
        for g in range(3):
            ks = sorted(k for gg, k in by if gg == g)
            assert [by[g, k] for k in ks] == list(range(len(ks)))


def test_components_and_splits(spark):
    rows = [(0, "a", "x"), (1, "b", "x"), (2, "b", "y"), (3, "c", "z"), (4, None, "z"), (5, "d", None)]
    got = {r.row: r.root for r in identity.connected_components(spark.createDataFrame(rows, "row long, u string, t string"), "row", ["u", "t"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    chain = spark.range(60).select(F.col("id").alias("row"), F.expr("id div 2").alias("u"), F.expr("(id + 1) div 2").alias("t"))
    assert {r.root for r in identity.connected_components(chain, "row", ["u", "t"]).collect()} == {0}
    s = splits.split(spark.range(1000).withColumnRenamed("id", "k"), "k", 3).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 800, "val": 100, "test": 100}


def unit(rng, n, d=8):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).tolist()


def test_late_interaction(spark):
    rng = np.random.default_rng(0)
    left = [(k, unit(rng, int(rng.integers(1, 6)))) for k in range(30)]
    right = [(k, unit(rng, int(rng.integers(1, 6)))) for k in range(25)] + [(25, []), (26, left[0][1])]
    a, b = spark.createDataFrame(left, "q long, tokens array<array<double>>"), spark.createDataFrame(right, "c long, tokens array<array<double>>")
    got = {(r.q, r.c): r.score for r in maxsim.scores(a, b, block=7).collect()}
    inside = a.crossJoin(b.withColumnRenamed("tokens", "t")).select("q", "c", maxsim.nested(F.col("tokens"), F.col("t")).alias("s")).collect()
    for r in inside:
        s = np.array(left[r.q][1]) @ np.array(right[r.c][1]).T if right[r.c][1] else None
        want = -5000.0 if s is None else 0.5 * (s.max(1).mean() + s.max(0).mean())
        assert got[r.q, r.c] == pytest.approx(want, abs=1e-8) and r.s == pytest.approx(want, abs=1e-8)
    assert got[0, 26] == pytest.approx(1)
    flipped = maxsim.block_matrix([x for _, x in right], [x for _, x in left])
    assert np.allclose(maxsim.block_matrix([x for _, x in left], [x for _, x in right]), flipped.T)
    shuffled = [x[::-1] for _, x in left]
    assert np.allclose(maxsim.block_matrix(shuffled, [x for _, x in right]), flipped.T)


def test_ranks_follow_their_tie_rules(spark):
    e = np.eye(4).tolist()
    left = spark.createDataFrame([(0, [e[0]], 1), (1, [e[1]], 2), (2, [e[0]], 1)], "q long, tokens array<array<double>>, g int")
    right = spark.createDataFrame([(0, [e[0]], 1), (1, [e[0]], 2), (2, [e[1]], 1)], "c long, tokens array<array<double>>, g int")
    got = {r.q: (r.ungrouped, r.grouped) for r in ranking.ranks(left, right, "g").collect()}
    assert got == {0: (2, 1), 1: (3, 2), 2: (3, 1)}


def test_encoder_contract(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.tokens for r in encode.encode(df, "t", lambda: encode.hash_encoder(8)).collect()}
    assert [len(got[k]) for k in (1, 2, 3)] == [3, 0, 0] and got[1][0] == got[1][2] != got[1][1]
    head = encode.made_head([8, 12, 10, 4], mean=np.full(8, 0.5))
    out = encode.with_head(encode.hash_encoder(8), head)(["a b", ""])
    assert out[0].shape == (2, 4) and np.allclose(np.linalg.norm(out[0], axis=1), 1) and out[1].shape == (0, 4)
    x = np.array([[1.0, -2.0, 0.5]])
    assert encode.gelu(x)[0, 0] == pytest.approx(0.5 * (1 + math.erf(1 / math.sqrt(2))))
    assert encode.layer_norm(x, np.ones(3), np.zeros(3)).mean() == pytest.approx(0, abs=1e-9)


def test_bf16_rounds_to_even(spark):
    x = np.array([1.0, 1.00390625, 1.01171875, -1.00390625, 3.0e38, 1e-40, 0.1], np.float32)
    got = scalar.round_bf16(x)
    assert got[:4].tolist() == [1.0, 1.0, 1.015625, -1.0]
    assert ((got.view(np.uint32) & 0xFFFF) == 0).all() and abs(got[6] - 0.1) < 0.0005
    assert math.isnan(scalar.round_bf16(np.array([float("nan")], np.float32))[0])
    df = spark.createDataFrame([(0.1,)], "x float")
    assert df.select(scalar.bf16("x")).first()[0] == float(got[6])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.floats(0, 1.2), st.text(max_size=5))
def test_span_corruption(n, share, key):
    tokens = [f"t{k}" for k in range(n)]
    out = scalar.corrupt_spans(tokens, ["X", "Y"], share, key)
    assert len(out) == n and out == scalar.corrupt_spans(tokens, ["X", "Y"], share, key)
    changed = sum(a != b for a, b in zip(tokens, out, strict=True))
    assert changed == (n if share >= 1 else min(n, max(1, round(share * n)))) if n and share > 0 else changed == 0


def test_store_around_a_corpus(spark, csv, tmp_path):
    pairs, path = readers.read_pairs(spark, csv), str(tmp_path / "around")
    stores.merge(pairs, path, {"width": 16})
    read = lambda name: sorted(tuple(r) for r in spark.read.parquet(f"{path}/{name}").collect())
    assert read("items") == [(0, "MKV", "key1"), (1, "", "key2"), (2, "AAA", "key1"), (3, "MK MK", "key3")]
    assert read("row_map") == [(0, 0), (1, 1), (2, 2), (3, 3)] and read("caption_ids") == [(0, 0), (1, 1), (2, 2), (3, 2)]
    assert stores.faults(spark, path, pairs.repartition(3), {"width": 16}) == []
    tokens = spark.createDataFrame([(0,), (2,), (2,)], "item_id long")
    assert stores.faults(spark, path, tokens=tokens) == ["2 items have no tokens"]
    with pytest.raises(ValueError, match="settings"):
        stores.require(spark, path, pairs=pairs, settings={"width": 32})
    with pytest.raises(ValueError, match="digest"):
        stores.require(spark, path, pairs=pairs.withColumn("text", F.upper("text")), settings={"width": 16})
    spark.createDataFrame([(0, 0), (1, 9)], "row_idx long, item_id long").write.mode("overwrite").parquet(path + "/row_map")
    assert stores.faults(spark, path) == ["2 rows are mapped, of 4", "1 rows name items that do not exist"]
    assert cli.main(["merge", csv, path]) == 0 and cli.main(["merge", csv, path, "--check"]) == 0
    assert cli.main(["merge", csv, path, "--check", "--subset", "2"]) == 1


def test_shards_of_an_earlier_run(spark, tmp_path):
    for name in ("shard-0-of-4", "shard-3-of-4", "keep.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "shard-folder").mkdir()
    assert stores.clear_shards(spark, str(tmp_path)) == ["shard-0-of-4", "shard-3-of-4"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["keep.txt", "shard-folder"]
    good = [(1, 2, 3, 2), (0, 2, 0, 3)]
    schema = "rank int, world int, start long, length long"
    assert [r.rank for r in stores.shard_order(spark.createDataFrame(good, schema)).collect()] == [0, 1]
    for bad in (good[:1], [good[0], (0, 3, 0, 3)], [good[0], (1, 2, 0, 3)], [(1, 2, 4, 2), good[1]]):
        with pytest.raises(ValueError):
            stores.shard_order(spark.createDataFrame(bad, schema))


def test_token_names_and_settings(spark):
    vocabulary = spark.createDataFrame([(0, "end"), (1, "soup")], "id long, token string")
    labels = spark.createDataFrame([("ORIGIN:", 9), ("DISH:", 1), ("soup", 2), ("DISH:", 4)], "label string, at int")
    more = stores.with_labels(vocabulary, labels, "at")
    assert sorted(tuple(r) for r in more.collect()) == [(0, "end"), (1, "soup"), (2, "DISH:"), (3, "ORIGIN:")]
    tokens = spark.createDataFrame([(0, 1), (1, 2), (2, 77)], "pos int, token_id long")
    assert [r.token for r in stores.token_names(tokens, more).orderBy("pos").collect()] == ["soup", "DISH:", "<77>"]
    assert stores.resolve({"data": "/d", "out": ""}, environment={"PAIRFORGE_OUT": "/o"}) == {"data": "/d", "out": "/o"}
    with pytest.raises(ValueError, match="PAIRFORGE_OUT"):
        stores.resolve({"out": ""}, ("out",), environment={})


def test_grouped_evaluation_and_decoys_from_the_command_line(spark, csv, tmp_path):
    store = str(tmp_path / "store")
    cli.encode_csv(spark, csv, store)
    got = {r.direction: r for r in cli.evaluate_grouped(spark, store, csv).collect()}
    assert set(got) == {"protein to text", "text to protein"} and all(0 < r.map <= 1 and r.median_rank >= 1 for r in got.values())
    text = "".join(f'{u},M,"{t}",\r\n' for u, _, t in MENU)
    (tmp_path / "menu.csv").write_bytes((HEAD + text).encode())
    cli.decoys(spark, str(tmp_path / "menu.csv"), str(tmp_path / "decoys"), LABELS, 7, ["DISH:", "SEASON:"])
    texts = spark.read.parquet(str(tmp_path / "decoys/texts"))
    assert texts.count() and texts.where("not keep").count() == 0 and {r.label_id for r in texts.collect()} <= {0, 2}
    stats = {r.label: (r.planned, r.usable) for r in spark.read.json(str(tmp_path / "decoys/stats")).collect()}
    assert set(stats) == set(LABELS) and stats["ORIGIN:"] == (0, 0) and sum(p for p, _ in stats.values()) == texts.count()


def test_average_precision_breaks_ties_by_candidate(spark):
    rng = np.random.default_rng(3)
    e = np.eye(5).tolist()
    left = [(k, [e[int(rng.integers(5))]], int(rng.integers(3))) for k in range(24)]
    right = [(k, [e[int(rng.integers(5))]], left[k][2]) for k in range(24)]
    a = spark.createDataFrame(left, "q long, tokens array<array<double>>, g int")
    b = spark.createDataFrame(right, "c long, tokens array<array<double>>, g int")
    got = {r.q: r.ap for r in ranking.average_precisions(a, b, "g").collect()}
    for q, x, g in left:
        order = sorted(range(24), key=lambda c: (-(x[0] == right[c][1][0]), c))
        hits, total = 0, 0.0
        for at, c in enumerate(order, 1):
            if right[c][2] == g or c == q:
                hits += 1
                total += hits / at
        assert got[q] == pytest.approx(total / hits)


def test_streaming_ingest(spark, tmp_path):
    from pairforge.streaming.ingest import ingest

    rows = spark.createDataFrame([(1, "a b", "2024-01-01 00:00:00"), (2, "c", "2024-01-01 00:00:01"), (1, "a b", "2024-01-01 00:00:02")], "row_idx long, text string, at string")
    rows.withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_idx long, text string, at timestamp").parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), lambda: encode.hash_encoder(4)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("row_idx").count().count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_the_rest_stands_without_the_llm_subpackage(tmp_path):
    import shutil

    for p in ("pairforge", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "pairforge/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_llm_subpackage():
    for p in [*ROOT.glob("pairforge/**/*.py"), ROOT / "bench.py"]:
        if p.exists() and "llm" not in p.relative_to(ROOT).parts:
            assert "pairforge.llm" not in p.read_text(), p
