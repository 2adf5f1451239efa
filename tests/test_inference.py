import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import encode, weights
from pairforge.streaming import prompts


@pytest.mark.parametrize("most", [1, 64, 20_000])
def test_batches_hold_few_tokens_and_rows_keep_their_order(spark, tmp_path, most):
    sizes = [1, 20_000, 0, 3, 3, 500, 7, 64, 65, 0, 31, 33, 2, 1000]
    log = str(tmp_path / f"log{most}")

    def factory():
        def model(texts):
            with open(log, "a") as f:
                f.write(f"{max(len(t.split()) for t in texts)} {len(texts)}\n")
            return [np.full((len(t.split()), 2), k + len(t), np.float32) - k for k, t in enumerate(texts)]

        return model

    rows = [(k, " ".join(["w"] * n) if n else None) for k, n in enumerate(sizes)]
    out = encode.encode(spark.createDataFrame(rows, "id int, t string").coalesce(1), "t", factory, most_tokens=most).collect()
    assert [r.id for r in out] == list(range(len(sizes)))
    assert [[tuple(v) for v in r.tokens] for r in out] == [[(len(t or ""),) * 2] * n for n, (_, t) in zip(sizes, rows, strict=True)]
    batches = [tuple(map(int, line.split())) for line in open(log)]
    assert sum(n for _, n in batches) == len(sizes) and all(n == 1 or max(1, longest) * n <= most for longest, n in batches)


def test_masked_passes_by_loops(spark):
    rng = np.random.default_rng(2)
    lists = [[str(x) for x in rng.integers(0, 4, n)] for n in (0, 1, 2, 7, 40, 301)] + [["end"] * 5, None, ["end", "1"]]
    df = spark.createDataFrame(list(enumerate(lists)), "k long, t array<string>")
    for passes in (2, 3, 8):
        got = {r.k: (r.n, r.pppl) for r in encode.pseudo_perplexity(df, "k", "t", lambda: encode.counting_scorer(4), passes, specials=("end",), most_tokens=50).collect()}
        for k, t in enumerate(lists):
            losses = []
            for p, x in enumerate(t or []):
                if x != "end":
                    shown = [y for q, y in enumerate(t) if y == "end" or q % passes != p % passes]
                    losses.append(-math.log((shown.count(x) + 1) / (len(shown) + 4)))
            assert got[k][0] == len(losses)
            assert math.isnan(got[k][1]) if not losses else got[k][1] == pytest.approx(math.exp(sum(losses) / len(losses)))
    with pytest.raises(ValueError, match="two passes"):
        encode.pseudo_perplexity(df, "k", "t", lambda: encode.counting_scorer(4), 1)


def test_error_function():
    x = np.concatenate([np.random.default_rng(0).uniform(-9, 9, 20_000), [0.0, -0.0, 5e-324, 1e300, -1e300, 6.0]])
    assert np.abs(encode.erf(x) - np.array([math.erf(v) for v in x.tolist()])).max() < 1e-13


def test_weights_of_a_container(spark, tmp_path):
    path = str(tmp_path / "m.safetensors")
    heads = {"text_proj": encode.made_head([6, 9, 7, 4], 1, np.arange(6) / 10), "protein_proj": encode.made_head([5, 9, 7, 4], 2), "text_expand": encode.made_head([4, 7, 9, 6], 3, normalised=False)}
    weights.save(path, weights.state(heads) | {weights.SCALE: np.float64(3.0)})
    got = weights.model(path)
    x = np.random.default_rng(0).standard_normal((11, 6))
    assert got[weights.SCALE] == 3.0 and set(got) == {*heads, weights.SCALE}
    assert np.allclose(got["text_proj"](x), heads["text_proj"](x)) and got["protein_proj"].normalised and not got["text_expand"].normalised
    assert isinstance(weights.load(path)["text_proj.fc1.weight"].base, np.memmap) or isinstance(weights.load(path)["text_proj.fc1.weight"], np.memmap)
    rows = [(1, x[:3].tolist()), (2, []), (3, None), (4, x[3:].tolist())]
    z = {r.k: r.z for r in weights.project(spark.createDataFrame(rows, "k int, v array<array<double>>"), "v", path, "text_proj").collect()}
    assert np.allclose(z[1] + z[4], heads["text_proj"](x)) and z[2] == [] and z[3] == []
    broken = weights.state(heads)
    for name, change in (("lack", lambda t: t.pop("text_proj.fc2.bias")), ("besides", lambda t: t.update(other=np.zeros(1))), ("widths", lambda t: t.update({"text_proj.norm1.weight": np.zeros(3)})), ("mean", lambda t: t.update({"text_proj.mean_in": np.zeros(2)}))):
        tensors = dict(broken)
        change(tensors)
        weights.save(str(tmp_path / name), tensors)
        with pytest.raises(ValueError, match=name):
            weights.model(str(tmp_path / name))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_every_epoch_is_a_permutation(n):
    orders = [prompts.permuted(np.arange(n), n, 9, e) for e in range(3)]
    assert all(sorted(o.tolist()) == list(range(n)) for o in orders)
    if n >= 64:
        assert len({tuple(o) for o in orders}) == 3 and all(abs(np.corrcoef(o, np.arange(n))[0, 1]) < 0.5 for o in orders)
    assert (prompts.permuted(np.arange(n)[::-1], n, 9, 1)[::-1] == orders[1]).all()


def test_a_stream_goes_on_where_it_stood(spark, tmp_path):
    """Batches of two starts on one checkpoint are those of one long table, ranks are disjoint, and epochs follow one another."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    n, a_batch = 50, 30

    def start(batches):
        seen = []
        q = None

        def keep(batch, k):
            batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)
            seen.append(k)

        q = prompts.stream(spark, n, a_batch, world=2, seed=4).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        while len(seen) < batches:
            q.awaitTermination(0.2)
            if q.exception():
                raise q.exception()
        q.stop()

    start(2)
    start(2)
    got = spark.read.parquet(out).dropDuplicates(["batch", "epoch", "place"]).collect()
    most = max(r.epoch * n + r.place for r in got) + 1
    want = prompts.epochs(spark, n, -(-most // n), world=2, seed=4).where(F.col("epoch") * n + F.col("place") < most).collect()
    assert most >= 120 and sorted((r.epoch, r.place, r["rank"], r.row_idx) for r in got) == sorted((r.epoch, r.place, r["rank"], r.row_idx) for r in want)
    by = {e: [{r.row_idx for r in got if (r.epoch, r["rank"]) == (e, k)} for k in (0, 1)] for e in (0, 1)}
    assert all(not (a & b) and len(a | b) == n for a, b in by.values())
