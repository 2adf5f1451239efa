"""The commands around packed stores, scores, ablations and settings."""

import json
import math

import numpy as np
import pytest

from pairforge import cli
from pairforge.operators import ablation, encode, weights
from pairforge.sources import packed, readers

HEAD = "primary_Accession,protein_sequence,[final]text_caption\n"


@pytest.fixture
def csv(tmp_path):
    rows = [f'k{k},{"MKV "[: k % 5] or "A"} A,"word{k % 3}\nand ""{k}"""' for k in range(11)]
    (tmp_path / "p.csv").write_text(HEAD + "\n".join(rows) + "\nlast,,\n")
    return str(tmp_path / "p.csv")


def nested(spark, path):
    return {r.item_id: r.tokens for r in packed.read(spark, path, True).collect()}


def test_live_export_goes_on_after_a_loss(spark, csv, tmp_path, capsys):
    out, whole = str(tmp_path / "live"), str(tmp_path / "whole")
    assert cli.main(["live", csv, whole, "--world", "1", "--kind", "f32"]) == 0
    for rank in ("0", "2"):
        assert cli.main(["live", csv, out, "--world", "3", "--rank", rank, "--kind", "f32"]) == 0
    assert packed.missing(f"{out}/text", 3) == [1]
    with pytest.raises(ValueError, match=r"\[3\]"):
        cli.main(["live", csv, out, "--world", "2"])
    assert cli.main(["live", csv, out, "--world", "3", "--kind", "f32"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == ["protein", "text"]
    for side in cli.SIDES:
        a, b = nested(spark, f"{out}/{side}"), nested(spark, f"{whole}/{side}")
        assert a == b and len(a) == 12 and a[11] == []


def test_store_packed_and_heads_applied(spark, csv, tmp_path):
    store, out, model = str(tmp_path / "store"), str(tmp_path / "packed"), str(tmp_path / "m.safetensors")
    cli.encode_csv(spark, csv, store)
    assert cli.main(["pack", store, out, "--kind", "f32"]) == 0
    text = nested(spark, f"{out}/text")
    rows = {(r.item_id, r.pos): r.v for r in readers.read_tokens(spark, store, "text").collect()}
    assert {(i, p): v for i, t in text.items() for p, v in enumerate(t)} == rows
    heads = {f"{side}_proj": encode.made_head([16, 9, 7, 4], k) for k, side in enumerate(cli.SIDES)}
    weights.save(model, weights.state(heads))
    assert cli.live(spark, csv, str(tmp_path / "z"), 2, model=model, kind="f32") == list(cli.SIDES)
    z = nested(spark, str(tmp_path / "z/text"))
    assert all(np.allclose(z[i], heads["text_proj"](np.array(t)), atol=1e-6) for i, t in text.items() if t)


def test_scores_of_round_trips(spark, tmp_path):
    rows = [(0, "MKV M", "AAAA"), (1, "", None)]
    spark.createDataFrame(rows, "row_idx long, gen_target string, true_target string").write.parquet(str(tmp_path / "r"))
    assert cli.main(["score", str(tmp_path / "r"), str(tmp_path / "s"), "--passes", "2"]) == 0
    got = {r.row_idx: r for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got[0].pppl_true == pytest.approx(28 / 3) and math.isnan(got[1].pppl_gen) and math.isnan(got[1].pppl_true)
    # M, K, V, M: first and third hidden together, then second and fourth
    want = math.exp(-sum(math.log(x / 28) for x in (2, 1, 1, 2)) / 4)
    assert got[0].pppl_gen == pytest.approx(want)


def test_ablation_from_the_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    level = {"conditioned": 1.0, "shuffled": 1.3, "off": 1.5, "other": 9.0}
    rows = [(c, int(s), float(x + rng.normal() / 50)) for c, x in level.items() for s in range(5) for _ in range(1 + s)] + [("off", 1, None)]
    df = spark.createDataFrame(rows, "condition string, seq int, loss double")
    df.write.parquet(str(tmp_path / "l"))
    assert cli.main(["ablate", str(tmp_path / "l")]) == 0
    got = json.loads(capsys.readouterr().out)
    mean = {c: np.mean([x for d, _, x in rows if d == c and x is not None]) for c in level}
    macro = np.mean([np.mean([x for d, s, x in rows if (d, s) == ("off", k) and x is not None]) for k in range(5)])
    assert got["presence"] == pytest.approx(mean["off"] - mean["shuffled"]) and got["content"] == pytest.approx(mean["shuffled"] - mean["conditioned"])
    assert got["verdict"] == "strong" and got["macro_off"] == pytest.approx(macro) and got["presence_share"] == pytest.approx(got["presence"] / got["total"])
    same = ablation.decomposition(df.where("condition = 'off'")).first()
    assert same.total is None and ablation.decomposition(df.limit(0)).count() == 1


def test_paths_from_the_environment(spark, csv, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("PAIRFORGE_CSV", csv)
    monkeypatch.setenv("PAIRFORGE_STORE", str(tmp_path / "nowhere"))
    assert cli.main(["settings"]) == 0
    assert [(x["name"], x["there"]) for x in map(json.loads, capsys.readouterr().out.splitlines())] == [("csv", True), ("store", False), ("merged", False), ("weights", False)]
    assert cli.main(["merge", "@csv", str(tmp_path / "m")]) == 0 and cli.main(["merge", "@csv", str(tmp_path / "m"), "--check"]) == 0
    with pytest.raises(ValueError, match="PAIRFORGE_MERGED"):
        cli.named("@merged")
