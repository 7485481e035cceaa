import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Invented prose with copies, near copies, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["the", "of", "and", *("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400))]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [text(rng.randint(1, 120)).capitalize() + "." for _ in range(60)]
    for n in range(0, 20, 2):
        docs.append(docs[n])
        parts = docs[n].split()
        parts[rng.randrange(len(parts))] = "changed"
        docs.append(" ".join(parts))
    docs += [None, "", "   ", "a", "A b", text(6000), "ÀÉ À\n\tx"]
    return list(enumerate(docs)) + [(3, docs[3]), (500, docs[3])]


@pytest.fixture(scope="session")
def documents(spark, prose):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in prose], "doc_id bigint, text string, lang string, source string, n_chars bigint")
