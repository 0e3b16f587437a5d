import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, h string, size string"


def make(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lg, s, None if t is None else len(t), "b", "h", "s") for i, t, lg, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    rng = random.Random(4)
    syl = {"en": "the and ing tion ea th er sh".split(), "fr": "eau les è ou ment que é ier".split()}
    rows = []
    for i in range(160):
        lg = "en" if i % 2 else "fr"
        ws = ["".join(rng.choice(syl[lg]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 140))]
        rows.append((i, " ".join(ws), lg, f"s{i % 3}" if i % 7 else None))
    passage = " ".join(rng.choice(syl["en"]) + rng.choice(syl["fr"]) for _ in range(130))
    rows += [(200 + i, f"{'x' * i} {passage} {'y' * i}", "en", "s1") for i in range(3)]
    rows += [(300 + i, rows[5][1], "en", "s0") for i in range(12)]
    rows += [(400, None, "en", "s1"), (401, "", None, None), (402, " \n\t", "fr", "s2"), (403, "word", "en", "s0"), (404, "a" * 1500, "en", "s0"), (405, "w1 w2 w3 " * 3000, "en", "s0"), (403, "word", "en", "s0"), (None, "no id at all", "en", "s0")]
    return rows
