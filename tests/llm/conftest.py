import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, node bigint, score string, span string"


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, nulls, empty and very long ones."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    near = texts[3].split() + ["tail"] if len(texts[3].split()) > 40 else " ".join(texts[:3]).split()
    texts += [texts[5], texts[5].upper(), texts[7] + ".", " ".join(near), " ".join([*near[:-1], "end"]), None, "", "  \n\t", "!!! ***", "é ö", "x" * 3000, " ".join(rng.choice(vocabulary) for _ in range(6000)), "a b", "a b", "日本語 テスト"]
    return texts


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with those that the operators use inside."""

    def run(rows):
        full = [(i, t, lang, source, len(t) if t else None, "x", 1, "y", "z") for i, t, lang, source in rows]
        return spark.createDataFrame(full, SCHEMA)

    return run


@pytest.fixture(scope="session")
def docs(make, corpus):
    return make([(i, t, ("en", "fr", None)[i % 3], (f"s{i % 4}" if i % 7 else None)) for i, t in enumerate(corpus)] + [(None, corpus[5], "en", "s1"), (3, corpus[3], "en", "s0")]).repartition(3)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
