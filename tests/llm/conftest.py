import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

WORDS = "the and tion ing ent over stone river light sound paper green small winter music garden window number letter market bridge forest silver copper".split()


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def prose(rng):
    """A function that makes n words of text."""
    return lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string, TEXT2 string, spans string, k1 long, `_text` string"):
    """Rows with further columns, some of which have names that operators use inside."""
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *["x" if "string" in c else 1 for c in schema.split(",")[len(r) : width]]) for r in rows], schema)


@pytest.fixture
def docs_of(spark):
    return lambda texts: frame(spark, list(enumerate(texts)))
