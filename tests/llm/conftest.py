import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts, or from (doc_id, text) pairs."""
    def make(texts, schema=DOC_SCHEMA):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], schema)
    return make


def prose(rng, words, vocabulary=400):
    """Sentences of invented words."""
    out = []
    for i in range(words):
        w = "".join(rng.choice(["th", "on", "er", "ha", "st", "re", "in", "ed"]) for _ in range(1 + rng.randrange(vocabulary) % 4))
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 else ""))
    return " ".join(out)
