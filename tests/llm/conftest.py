import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"word{i % 977} line{i % 89}" for i in range(20000))
    line = "this is a line of more than forty characters in all documents"
    rows = [
        (1, "Hello  world", "en", "s"), (2, "Hello world", None, "s"), (3, "hello world", "en", None), (None, "Hello\tworld", "en", "s"),
        (4, None, "en", "s"), (5, "", "en", "s"), (6, " \n\t ", None, None), (7, long, "en", "s"), (7, long, "en", "s"), (8, long + " tail", "fr", "s"),
        (9, "12 34 !!", "en", "s"), (10, line + "\nÉÀ ß", "fr", "s"), (11, line.upper() + "\r\nb", "fr", "s"), (12, "  " + line + "\n\n" + line, "fr", "s"), (13, line, "en", "s"), (14, "x\n" + line, "en", "s"), (14, "y\n" + line, "en", "s"), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("id", "row", "digest", "_row", "_id", "_digest", "_maybe", "_b", "_bits", "hash", "_stats", "_words", "score", "lang_pred", "size", "node", "kept", "block", "bucket", "n_chars"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def odd_rows(odd_documents):
    return [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
