import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rate double, component_id long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, columns whose names clash with the operators'."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "δelta", "eps-1", "zeta.", "x@y.org", "+1 (555) 555-0100", "10.0.0.1", "***", "and"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(60)
    texts = ["", None, " \n\t ", base, base, base.replace("alpha", "alpha ", 1), text(30000), "a" * 70000, "one", "one two three", text(200), text(40) + "\n" + base + "\n" + base, "The quick brown fox jumps over it.\n\nThe quick  brown FOX jumps over it.", "<|endoftext|> x <|startoftext|>"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t), 5, 0.5, 1) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (100, text(25), None, "s0", 3, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path
