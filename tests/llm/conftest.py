import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, key string, _id long, gram long, made string"


def as_docs(spark, texts):
    """Documents with columns that clash with names the operators use."""
    rows = [
        (i, t, "en", "s", None if t is None else len(t), "h", "k", 1, 2, "m")
        for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs, empty and long texts, repeated rows, odd blanks."""
    long = " ".join(f"word{i % 977} the of and" for i in range(6000))
    texts = ["", None, " \n\t ", long, long, "a", "one two three four five", "x\ty  z q　 w\n\n", "é" * 300]
    docs = as_docs(spark, texts)
    again = docs.where("doc_id IN (0, 3)")
    nulls = docs.where("doc_id = 6").selectExpr(*["CAST(NULL AS " + f.dataType.simpleString() + f") AS {f.name}" if f.name in ("doc_id", "lang", "source", "n_chars") else f"{f.name}" for f in docs.schema])
    return docs.unionByName(again).unionByName(nulls)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
