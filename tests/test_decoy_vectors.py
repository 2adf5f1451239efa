"""Vectors do not travel with decoys: items are broadcast, in several passes where they are many."""

from pairforge.plans import decoys
from test_pairs import plan

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_decoy_eval_shuffles_no_vectors(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    try:
        found = plan(decoys.decoy_eval(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # decoys meet both sides' items where they lie: joins on q and c by broadcast although the session broadcasts nothing by itself
    assert "BroadcastHashJoin [c#" in found and "BroadcastHashJoin [q#" in found


def test_passes_change_nothing(spark, monkeypatch):
    whole = rows(decoys.decoy_eval(spark, SF))
    monkeypatch.setattr(decoys, "HELD_BYTES", 30 * decoys.ITEM_BYTES)
    made, was = [], decoys.settled
    monkeypatch.setattr(decoys, "settled", lambda df, name="settled": made.append(name) or was(df, name))
    assert rows(decoys.decoy_eval(spark, SF)) == whole
    assert made.count("scored") > 2
