import numpy as np
import pytest
from test_archives_tokens import check_packing, ids_of
from test_decontaminate import brute as brute_contaminated
from test_trie_join import brute as brute_near

import __spark_entry__ as entry
import corpus_pipeline
from pairforge.llm import kneser_ney

SF = "/root/testdata/sf0.001"


def without_repeats(docs, window=200):
    """Every byte covered by a window that starts elsewhere too, but for characters that are covered only in part."""
    seen = {}
    for _, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            seen[raw[k : k + window]] = seen.get(raw[k : k + window], 0) + 1
    out = {}
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - window + 1):
            if seen[raw[k : k + window]] > 1:
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not gone[at : at + n].all():
                kept.append(c)
            at += n
        out[d] = "".join(kept) if t is not None else None
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_against_brute_force(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeated_passages", "benchmark_passages", "sequences"]
    for df in stages[1:-1]:
        assert df.schema.names == stages[0].schema.names
    texts = [sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()) for df in stages[:-1]]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in kneser_ney.report(stages[0], labels).collect() if r.rejected}
    assert texts[1] == [x for x in texts[0] if x[0] not in rejected] and 0 < len(rejected) < len(texts[0]) / 3
    roots = {r[2] for r in brute_near(texts[1])}
    assert texts[2] == [x for x in texts[1] if x[0] in roots]
    assert dict(texts[3]) == without_repeats(texts[2])
    bench = [(b.item_id, b.text) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contaminated(texts[3], bench) if r[5]}
    assert texts[4] == [x for x in texts[3] if x[0] not in bad]
    used, least = check_packing(stages[-1].collect(), list(zip([d for d, _ in texts[4]], ids_of("word_bpe_49k.json", [t for _, t in texts[4]]), strict=True)), 2048)
    assert used <= least + 1


def test_rest_of_the_columns_and_lengths(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    for r in stages[3].collect():
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) and r.n_chars == len(r.text)


def test_whole_pipeline_is_registered(spark, stages):
    got = sorted(map(tuple, entry.queries()["pipeline"](spark, SF).drop("sequence_id", "offset").collect()))
    assert got == sorted(map(tuple, stages[-1].drop("sequence_id", "offset").collect()))


def test_odd_documents_pass_through(spark, odd_docs, tmp_path):
    """Nulls, empty and long texts, ties and clashing columns, with tables that label and test nothing."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    n = len({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})
    assert 0 < n <= odd_docs.count()
    (tmp_path / "none").mkdir()
    odd_docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


