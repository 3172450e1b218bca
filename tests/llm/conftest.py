import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing column names."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeïñ🙂") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(400))
    same = "one line that recurs in each of these copies\nand another line of the same document here"
    texts = [None, "", " \t\n ", "word", "two words", same, same, same, long, long + " x", "x" * 50_000, "=" * 3000, "\x00 odd � \U0001f600 tail", "<|endoftext|> a <|endoftext|>"]
    rows = [(k, t, "en", None if k % 3 == 0 else f"s{k % 3}", None) for k, t in enumerate(texts)]
    rows += [(5, same, "en", "s2", None), (None, "no id here at all", None, None, None), (None, None, None, None, None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    for name in ("u", "v", "a", "n", "h", "token", "component", "size", "copies", "label", "template", "score", "p", "rows", "_h", "_i", "_g", "_drop", "n_dropped", "_words", "_id", "_copies", "_text", "key", "hash", "own", "drop", "words", "copy", "from", "two words", "task", "tokens"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
