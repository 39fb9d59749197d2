import random

import pytest

WORDS = "alpha beta gamma delta of the and river stone light under over moon glass cloud paper wind".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages and odd cases."""
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))
    passage, rows = make(60), []
    for i in range(60):
        text = make(rng.randint(3, 120))
        if i % 4 == 0:
            text = text + "\n" + passage + "\t" + make(5)
        rows.append((i, text))
    for i in range(60, 90):  # near copies of row 0..9: one word changed
        words = rows[i % 10][1].split(" ")
        words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(90, rows[3][1]), (91, "  " + rows[3][1].replace(" ", "\n")), (92, None), (93, ""), (94, " \t\n "),
             (95, "one"), (96, "One"), (97, "one two three"), (98, "Ünï cødé ⅷ 日本 🙂 text"), (99, "a " * 3000),
             (100, "a " * 3000), (101, "b" * 70000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents, with columns whose names operators use too."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or ""), "extra", 1.5)
            for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "id string, score double").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
