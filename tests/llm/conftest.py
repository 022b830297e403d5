import os
import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "42", "the", "of", "naïve", "x"]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    texts = [None, "", " ", "\n\t", "Ω漢字 ́x  y z <|endoftext|> <|startoftext|>a", prose[0], prose[0], " ".join(rng.choices(words, k=9000)), *prose]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
