"""Every operator on rows that stand in the table twice, and on one id with two contents: a row each, and no crash."""

import pytest

from pairforge.llm import decontaminate, fm_index, html_wrapper, kneser_ney, packing, pq_dedup, runlength_index, token_store, trie_join, warc
from pairforge.llm.encoding import vocabulary

TEXTS = [(1, "one two three " * 30), (2, "other words entirely"), (2, "a second text of the same id " * 20), (3, None), (4, "one two three " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, "en") for d, t in TEXTS], "doc_id long, text string, lang string")
    return df.union(df)


def test_documents(spark, docs):
    none = spark.createDataFrame([(1, "one two three one two three")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    path = vocabulary("byte_bpe_50k.json")
    for out in (
        runlength_index.report(docs), fm_index.report(docs), trie_join.near_duplicates(docs), decontaminate.report(docs, none),
        kneser_ney.report(docs, labels, least=1), token_store.token_digests(docs, path), packing.pack(docs, path), runlength_index.without_repeats(docs),
    ):
        assert out.count() == docs.count()
    roots = {(r.doc_id, r.component_id) for r in trie_join.near_duplicates(docs).collect()}
    assert roots == {(1, 1), (2, 2), (3, 3), (4, 1)}
    gone = {r.doc_id: r.n_removed for r in runlength_index.report(docs).collect() if r.doc_id != 2}
    assert gone == {1: 420, 3: 0, 4: 420}


def test_pages(spark, docs):
    pages = docs.select(docs.doc_id.alias("page_id"), docs.lang.alias("url"), docs.text.alias("html"))
    assert html_wrapper.main_text(pages).count() == pages.count()
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.archive_round_trip(pages).collect())
    assert got == sorted([(1, "response", 0), (2, "response", 0), (2, "response", 0), (3, "response", 0), (4, "revisit", 1)] * 2)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (3, None, 1)], "vec_id long, embedding array<float>, label int")
    got = pq_dedup.near_duplicates(df.union(df)).collect()
    assert len(got) == 8 and {(r.vec_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


CLASHING = "gone gone_ found found_ quality_of lang_of score limit _lang _score _t _q _s _id _gone _found _quality _first _spans place salt copy".split()


def test_columns_of_every_inner_name_pass(spark, odd_texts):
    """Filters give back extra columns as they are, whatever their names."""
    rows = [(k, t, "en", 5, *["MINE"] * len(CLASHING)) for k, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    for out in (kneser_ney.without_rejected(docs, labels), trie_join.one_of_each(docs), runlength_index.without_repeats(docs), decontaminate.without_contaminated(docs, bench), decontaminate.without_spans(docs, bench)):
        assert out.schema.names == docs.schema.names
        assert all(r[c] == "MINE" for r in out.select(*CLASHING).collect() for c in CLASHING) and out.count() > 5
