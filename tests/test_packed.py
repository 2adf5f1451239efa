import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from pairforge.functions.scalar import round_bf16
from pairforge.sources import packed

WIDTH = 5


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(k, rng.standard_normal((0 if k % 7 == 3 else 1 + k % 4, WIDTH)).astype(np.float32)) for k in range(n)]


def frame(spark, items):
    return spark.createDataFrame([(k, v.tolist() if len(v) else ([] if k % 2 else None)) for k, v in items], "item_id long, tokens array<array<float>>")


def nested(df):
    return {r.item_id: np.array(r.tokens, np.float32).reshape(-1, WIDTH) for r in df.collect()}


@pytest.mark.parametrize("kind", ["f32", "bf16"])
def test_round_trip(spark, tmp_path, kind):
    path, items = str(tmp_path / "s"), rows(300)
    packed.write(frame(spark, items).repartition(5), path, kind)
    want = {k: v if kind == "f32" else round_bf16(v) for k, v in items}
    for size in (1 << 25, 400):
        got = nested(packed.read(spark, path, True, size))
        assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    assert packed.read(spark, path, True, 400).rdd.getNumPartitions() > 8
    flat = [(r.item_id, r.pos, tuple(r.v)) for r in packed.read(spark, path).collect()]
    assert sorted(flat) == sorted((k, p, tuple(x)) for k, v in want.items() for p, x in enumerate(v.tolist()))
    manifest = json.loads((tmp_path / "s/manifest.json").read_text())
    size = {"f32": 4, "bf16": 2}[kind]
    assert sum(f.stat().st_size for f in (tmp_path / "s").glob("*.val")) == manifest["tokens"] * WIDTH * size


def test_a_lookup_reads_its_range_only(spark, tmp_path):
    path, items = str(tmp_path / "s"), rows(400)
    packed.write(frame(spark, items).coalesce(1), path, "f32")
    values = dict(items)

    def read(*filters):
        reader = packed.PackedReader(path, True, 1 << 20)
        left = list(reader.pushFilters(list(filters)))
        got = {}
        for p in reader.partitions():
            for batch in reader.read(p):
                got |= {i: np.array(t, np.float32).reshape(-1, WIDTH) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        return got, reader.bytes_read, left

    for k in (0, 3, 171, 399):
        got, size, left = read(EqualTo(("item_id",), k), IsNotNull(("item_id",)))
        assert list(got) == [k] and (got[k] == values[k]).all() and size == 16 + 4 * WIDTH * len(values[k]) and len(left) == 1
    got, size, _ = read(In(("item_id",), (5, 6, 90, 1000, None)))
    assert sorted(got) == [5, 6, 90] and size == 24 + 16 + 4 * WIDTH * sum(len(values[k]) for k in got)
    got, size, _ = read(GreaterThanOrEqual(("item_id",), 390), LessThan(("item_id",), 395))
    assert sorted(got) == list(range(390, 395)) and size < 500
    assert read(EqualTo(("item_id",), 4000))[:2] == ({}, 0)
    assert len(read(EqualTo(("pos",), 0))[2]) == 1
    one = packed.read(spark, path).where("item_id = 170 and pos = 0")
    assert one.count() == 1 and packed.read(spark, path).where("item_id in (4, 8, 9) or pos = 77").select("item_id").distinct().count() == 3
    assert packed.read(spark, path).where("item_id = 170").rdd.getNumPartitions() == 1


def test_a_failed_task_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "s")
    packed.write(frame(spark, rows(40)), path, "f32")
    before = sorted(p.name for p in (tmp_path / "s").iterdir())
    broken = frame(spark, rows(60)).withColumn("tokens", F.when(F.col("item_id") == 50, F.array(F.array(F.lit(1.0)))).otherwise(F.col("tokens")))
    with pytest.raises(Exception, match="several widths"):
        packed.write(broken, path, "f32")
    with pytest.raises(Exception, match="without gaps|missing"):
        packed.write(frame(spark, [x for x in rows(60) if x[0] != 20]), path, "f32")
    with pytest.raises(Exception, match="without gaps|written twice"):
        packed.write(frame(spark, [*rows(60), rows(60)[7]]), path, "f32")
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == before and len(nested(packed.read(spark, path, True))) == 40
    packed.write(frame(spark, rows(60)), path, "f32")
    assert len(nested(packed.read(spark, path, True))) == 60
    assert not {*before} & {p.name for p in (tmp_path / "s").iterdir() if p.suffix == ".val"}


def test_a_run_of_shards(spark, tmp_path):
    """Lost shards are told and written again; a run of another size is refused; clearing takes what is not part of a store."""
    path, items = str(tmp_path / "s"), rows(101)
    df = frame(spark, items)

    def shard(rank, world):
        packed.write(df.where(packed.of_rank(101, rank, world)), path, "f32", (rank, world))

    for rank in (0, 3):
        shard(rank, 4)
    assert packed.missing(path, 4) == [1, 2]
    with pytest.raises(ValueError, match="2 shards"):
        packed.merge(spark, path)
    with pytest.raises(ValueError, match=r"\[4\]"):
        packed.missing(path, 3)
    for rank in range(3):
        shard(rank, 3)
    with pytest.raises(ValueError, match="2 runs"):
        packed.merge(spark, path)
    assert packed.clear(spark, path) > 6 and packed.missing(path, 3) == [0, 1, 2]
    for rank in (2, 0, 1, 1):  # one written twice: the later counts
        shard(rank, 3)
    packed.merge(spark, path)
    got = nested(packed.read(spark, path, True))
    assert list(got) and all((got[k] == v).all() for k, v in items) and len(got) == 101
    left = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert not [x for x in left if x.startswith("shard-")] and packed.missing(path, 3) == [0, 1, 2]
    assert packed.clear(spark, path) == 0 and len(nested(packed.read(spark, path, True))) == 101


def test_empty_stores_and_odd_options(spark, tmp_path):
    path = str(tmp_path / "none")
    packed.write(frame(spark, rows(3)).limit(0), path)
    assert packed.read(spark, path).count() == 0
    with pytest.raises(Exception, match="one of"):
        packed.write(frame(spark, rows(3)), path, "f8")
    batch = pa.RecordBatch.from_pydict({"item_id": pa.array([], pa.int64()), "tokens": pa.array([], pa.list_(pa.list_(pa.float32())))})
    assert batch.num_rows == 0
    only_empty = spark.createDataFrame([(0, []), (1, None)], "item_id long, tokens array<array<float>>")
    packed.write(only_empty, path)
    assert {r.item_id: r.tokens for r in packed.read(spark, path, True).collect()} == {0: [], 1: []}
