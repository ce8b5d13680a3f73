import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
BLOCK = "\n".join(" ".join(f"line{i}word{j}" for j in range(12)) for i in range(6))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows, a null id, and a clashing column."""
    texts = [None, "", " \n\t ", "a", LONG, "The same words here " * 4, "The same words here " * 4, BLOCK, BLOCK + "\nmore", "?!", "x퟿y\n\nx", "été über niño " * 10]
    rows = [(i, t, None if i % 3 == 0 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 3), (None, "no id here at all " * 5, None, None, None)]
    out = spark.createDataFrame(rows, SCHEMA)
    return out.selectExpr("*", "1 AS score", "2 AS n_deleted", "'z' AS lang_pred", "4 AS h", "5 AS pos")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
