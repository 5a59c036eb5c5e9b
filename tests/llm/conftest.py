import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __tk string, n_lines long, tk string, label int, __id long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    r = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "delta", "Épée", "zeta", "eta", "theta", "naïve", "ΣΑΣ", "x1", "42"]
    base = " ".join(r.choice(vocab) + str(r.randrange(40)) for _ in range(60))
    texts = [None, "", "   ", "\n\n", "One line", " one LINE\t", base, base.upper().replace("É", "é"), base + " tail", base.replace("alpha", "omega", 1), "word", "WORD", "a b", "A  B"]
    texts += [f"shared line\nown {k}\n  Shared LINE \r\nend {k % 3}" for k in range(12)]
    texts += [" ".join(r.choice(vocab) for _ in range(n)) for n in (3, 30, 300)] + ["long " * 30_000, "x" * 60_000, "<|endoftext|> hi <|startoftext|>"]
    rows = [(k if k != 3 else None, t, None if k % 5 == 0 else "en", None, None, "z", 7, "t", 1, None) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], rows[6]], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
