import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, k string, t string, score double, shard string, _cell int, sig string, term string"


def rows(texts):
    """Documents with columns whose names operators use inside."""
    return [(i, x, "en", "src0", len(x or ""), 7, "k", "t", 0.1, "s", 3, "sig", "term") for i, x in texts]


def texts(seed=1, n=120):
    """Prose with shared passages, exact and near copies, short, empty, null and long texts, repeated rows and null ids."""
    r = random.Random(seed)
    vocabulary = [a + b for a in "ba ce di fo gu hé ji ko".split() for b in "ma ne ri so tu".split()]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, base = sentence(45), sentence(150)
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            x = sentence(30) + "\n" + passage + " " + sentence(20)
        elif kind == 1:
            x = base
        elif kind in (2, 3):
            w = base.split()
            for _ in range(1 + kind):
                w[r.randrange(len(w))] = r.choice(vocabulary).upper()
            x = " ".join(w)
        elif kind == 4:
            x = sentence(r.randrange(1, 4))
        elif kind == 5:
            x = sentence(12) + " " + passage[: len(passage) // 2] + "\t" + sentence(25) + " " + sentence(8) * 2
        else:
            x = sentence(r.randrange(10, 90))
        out.append((3 * i + 5, x))
    long = sentence(15000)
    out += [(1, None), (2, ""), (3, " \n\t "), (4, long), (400, long[: len(long) // 2]), (401, "the the " * 2000), (402, "\x1c" + passage + " "), (403, "a"), (404, "\U0001f600 é É")]
    return out


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(texts()), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Repeated rows, two texts under one id, and null ids besides."""
    return spark.createDataFrame(rows([*texts(2, 40), *texts(2, 16), (5, "another text under id five " * 8), (None, texts(2, 3)[1][1]), (None, None), (None, "x y z")]), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
