import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty, blank and long texts, ties, repeats and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "A good text, with words that repeat words."), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long), (7, "one two"), (7, "one two"), (None, "no id here at all, but text"), (8, "é ñ 😀 “q” 漢字 x"), (9, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "cast(null as string) AS lang", "CASE WHEN doc_id < 5 THEN 'src1' END AS source", "length(text) AS n_chars", "1 AS score", "'x' AS size", "0 AS n_words", "2 AS h", "3 AS key", "true AS contaminated")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """The same rows with columns named like everything the stages compute."""
    names = ("target", "source_size", "copies", "taken", "copy", "row", "set", "rows", "h", "tidemark_score", "score_in", "n_hit", "n_items", "items_sha256", "comp", "component_id")
    return odd_docs.selectExpr("*", *[f"'{n}' AS {n}" for n in names if n not in odd_docs.columns and not n.startswith("tidemark")])
