"""Decoys: captions are dealt before they are parsed, donors are drawn again only where the first draw fails, anchors are scored in one pass."""

import pytest
from pyspark.sql import functions as F

from pairforge.operators import captions as C
from pairforge.plans import decoys
from pairforge.plans.base import LABELS, captions
from test_pairs import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def written(monkeypatch):
    names = []
    was = C.settled
    monkeypatch.setattr(C, "settled", lambda df, name="settled": names.append((name, df.columns)) or was(df, name))
    return names


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_decoy_keep_draws_for_all_slots_once(spark, written):
    k = decoys.decoy_keep(spark, SF)
    assert [n for n, _ in written].count("draws") == 1
    assert k.count() == k.select("owner_row", "k").distinct().count()


def test_decoy_texts_join_owners_alone(spark):
    p = decoys.plan(spark, SF)
    assert "piece" in p.columns
    c = captions(spark, SF)
    donors = p.join(c.select(F.col("row_idx").alias("donor_row"), "text"), "donor_row")
    assert donors.where(F.col("piece") != C.value("text", "dvs", "dve")).count() == 0


def test_decoy_eval_parses_ranges_of_captions(spark):
    """The same plan from dealt ranges and from spans in any order; value spans of rows with odd white space."""
    c = captions(spark, SF)
    own = C.plan(c, C.fields(c, "text", LABELS, ["row_idx"]).repartition(3), decoys.SEED, decoys.PER_ROW, decoys.TRIES)
    dealt = decoys.plan(spark, SF)
    assert rows(own.select(sorted(own.columns))) == rows(dealt.select(sorted(own.columns)))
    odd = C.spread(spark.createDataFrame([(0, "NAME: \t\x0b a b \r\n TYPE:\f\n BRAND: x")], "row_idx int, text string"))
    assert "rangepartitioning(row_idx" in plan(odd)
    assert rows(C.fields(odd, "text", LABELS, ["row_idx"])) == [(0, 0, 0, 9, 12), (0, 2, 2, 31, 32)]


def test_hard_decoy_loss_reads_decoys_once(spark):
    a = decoys.anchors(spark, SF)
    read = a._jdf.queryExecution().analyzed().toString()
    assert "Distinct" not in read and "Deduplicate" not in read  # pairs are scored where they lie, not told apart first and joined back
