import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from texts import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): nulls, empty, wordless, long, repeated rows, equal texts, a null id."""
    long_text = prose(99, 6000) + " " + "x" * 5000 + "\n\n  two  spaces\tand tabs "
    rows = [
        (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "1234 !!! ??", "en"), (5, long_text, "en"), (6, prose(1, 60), "en"),
        (6, prose(1, 60), "en"), (7, prose(1, 60), "en"), (None, prose(2, 50), "en"), (8, prose(3, 80, "fr"), "fr"), (9, "a", None),
        (10, "Ünïcode 漢字   don't I'll  ²³½ <|endoftext|> \\ end", "fr"), (11, "word", "en"), (12, prose(4, 700), "en"), (13, "😀😀 ab", None),
    ]
    return rows + [(100 + i, prose(200 + i, 40 + i, "fr" if i % 3 == 0 else "en"), "fr" if i % 3 == 0 else "en") for i in range(40)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as documents, with extra columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string").repartition(3)
    for name in ("length", "score", "print", "label", "bucket", "piece", "_row", "n_words", "start", "hash", "chunk", "source"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def vocabulary():
    from acclaim.llm.queries import BYTE_BPE, vocabulary_path

    return vocabulary_path(BYTE_BPE)


@pytest.fixture(scope="session")
def tokenizer(vocabulary):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary)
    out.encode_special_tokens = True
    return out
