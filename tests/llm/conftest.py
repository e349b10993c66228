"""Documents with all that is awkward: nulls, empty and long texts, copies, near copies, ties, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ta", "re", "mi", "so", "lu", "ke", "na", "vo") for b in ("la", "n", "ris", "d", "tor", "x")]


def prose(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    return "".join(w + ("\n" if k % 11 == 10 else " ") for k, w in enumerate(out)).strip()


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (60, 120, 200, 90, 75, 400)]
    near = base[1].split(" ")
    near[10] = "changed"
    passage = " ".join(prose(rng, 55).split())
    texts = [None, "", " \t\n", "one", "one two three", *base, base[0], " ".join(near), base[2].upper(), base[3] + "\n" + passage, base[4] + " " + passage, prose(rng, 5000), "x " * 300, base[0]]
    return [(i, t, "en" if i % 3 else None, "src", len(t or ""), 7, "a") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, least string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    """key and least are names that the operators use inside."""
    return spark.createDataFrame(rows + [rows[6]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
