import pytest

SCHEMA = "doc_id long, text string, kind string, extra int"
LONG = " ".join(f"word{k % 997} number{k}" for k in range(20_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (0, None, "n", 1), (1, "", "e", 2), (2, " \n\t ", "b", 3), (3, "same text here", "t", 4), (4, "same text here", "t", 5),
        (4, "same text here", "t", 5), (5, LONG, "l", 6), (6, "MIT License and mit LICENSE", "m", 7), (7, "a@b.co 4111 1111 1111 1111 é 10.0.0.1 +49 (30) 1234-5678", "p", 8),
        (None, "without an id", "x", 9), (8, "日本語　テキスト\x00 \x85 <|endoftext|> end", "u", 10),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"kind": "keep_id", "extra": "group_size"})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
