import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    """The smallest tables as lists of rows."""
    return {t: [r.asDict() for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()] for t in ("documents", "pages", "benchmark", "labels", "embeddings")}


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, ties, repeats, odd white space and characters of every width."""
    long = " ".join(f"w{k % 977}é" for k in range(30000))
    passage = " ".join(f"Common{k}" for k in range(70))
    return [
        None, "", " ", "\n\t ", "one", "one", "One two three four five", "one two three four five six", passage, "start " + passage + " end",
        passage + " " + passage, "ing " * 400, "ing " * 400, "ab" * 900, long, long, "x" * 5000, "naïve space — dash wide \U0001f600 ́mark",
        "don't  stop\r\n\r\nnow 's fine\x0bvertical\x0cform \x00nul", "ÀÉÎ über Straße Ω ΣΑΣ ς", "<|endoftext|> literal <|startoftext|>", "a\nb\n\nc \n d", "tab\tsep\tone two",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with extra columns whose names clash with the operators' own."""
    rows = [(k * 3 - 6, t, ["en", None, "fr"][k % 3], None if k % 4 == 0 else "s", None, "clash", 7, 1.5) for k, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, start int, length double")
