import random

import pytest

WORDS = ["the", "of", "and", "Grün", "été", "año", "zeta", "Haus", "river", "stone"]
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double, node string, range int, w string"


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank, tiny and very long texts, ties, repeated rows."""
    r = random.Random(4)
    long_ = sentence(r, 20_000)
    texts = [None, "", " \n\t ", "One", "one", "x y", "12 34 !!", "Mit Unicode: ﬁ Å Å 　 ß İ", "same text here again", "same text here again", long_, "ab " * 3000, "Released under the MIT License.\nmore words", "a\x00b c", "😀 𝒳 word", *(sentence(r, 60) for _ in range(30))]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t) if t is not None else None, True, 0.5, "n", 3, None) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[20], (None, texts[8], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, "another text with the id three", "en", "s0", 1, False, 0.1, "m", 1, "w")]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
