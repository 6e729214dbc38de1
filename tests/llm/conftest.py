import random

import pytest

WORDS = "the of and apple river stone cloud green bright quick table house under over light dark seven window garden letter".split()


@pytest.fixture(scope="session")
def texts():
    """Near copies, copies, nulls, empties, a long text, blanks and short ones."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))
    out = []
    for n in (3, 8, 12, 17, 25, 33, 60, 150, 400):
        base = say(n)
        out += [base, base, base.upper()]
        for edits in (1, 2, max(1, n // 60), max(1, n // 12)):
            w = base.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
        out += [base + " " + say(1), " ".join(base.split()[1:])]
    hot = say(60)
    out += [say(20) + " " + hot + " " + say(30) for _ in range(12)]
    return [*out, None, "", None, "   \n", "x", "x", say(9000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids with a null and a repeated row; extra columns whose names operators use themselves."""
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}" if i % 7 else None, i, float(i), "x") for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double, s1 string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
