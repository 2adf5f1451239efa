"""What the driver holds: the wide side of a join is not broadcast, a model is broadcast once."""

from pairforge.llm import kneser_ney, trie_join
from pairforge.llm.common import written
from test_trie_join import brute, near_copies


def test_sketches_are_never_broadcast(spark, monkeypatch):
    """Parities of nearly all documents went through the driver at each pass: up to five times in one run."""
    asked = []
    was = trie_join.small_side
    monkeypatch.setattr(trie_join, "small_side", lambda df, *a: asked.append(df.columns) or was(df, *a))
    docs = near_copies(3)
    got = trie_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), few=2, bucket_tokens=300, block_sets=9, hot_sets=5)
    assert sorted(map(tuple, got.collect())) == brute(docs)
    assert ["g", "node", "label", "main"] in [sorted(c, key=["g", "node", "label", "main"].index) for c in asked if {*c} == {"g", "node", "label", "main"}]
    assert not [c for c in asked if "parity" in c]


def test_tables_of_more_than_16_mb_in_memory_are_shuffled(spark, monkeypatch):
    df = written(spark.range(1 << 17).selectExpr("id", "'x' as s"), "held")  # some 3 MB in memory, a few hundred KB of files
    shown = lambda: trie_join.small_side(df, 16 << 20)._jdf.queryExecution().analyzed().toString()
    assert trie_join.HELD_BYTES == 16 << 20 and "broadcast" in shown()
    monkeypatch.setattr(trie_join, "HELD_BYTES", 1 << 20)
    assert "broadcast" not in shown()


def test_a_model_is_broadcast_once(spark, monkeypatch):
    made = []
    was = kneser_ney.Model.__init__
    monkeypatch.setattr(kneser_ney.Model, "__init__", lambda self, *a: made.append(1) or was(self, *a))
    docs = spark.createDataFrame([(k, f"text number {k} of some words", "en") for k in range(40)], "doc_id long, text string, lang string")
    labels = spark.range(0, 40, 2).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert kneser_ney.report(docs, labels).count() == 40
    assert len(made) == 1
