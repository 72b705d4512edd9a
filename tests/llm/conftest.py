import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rate double, component long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(n))


def texts() -> dict[int, str | None]:
    """Nulls, empty, blank and one-word texts, copies, near copies, a shared passage, a periodic and a very long text."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 90)
    words = base.split()
    near = [" ".join([*words[:k], "CHANGED", *words[k + 1 :]]) for k in (3, 40, 80)]
    out = [None, "", " \n ", "one", "One two THREE", base, base, *near, base.upper()]
    out += [f"{prose(rng, 30)} {passage} {prose(rng, 25)}" for _ in range(4)]
    out += ["For " * 300, prose(rng, 9000), "È ñ ü 漢字 😀 " * 20, "MIT License\nLicensed under the Apache License, Version 2.0.\n" + prose(rng, 5)]
    out += [prose(rng, rng.randint(5, 60)) for _ in range(12)]
    return dict(enumerate(out))


def rows(found: dict[int, str | None]):
    return [(i, t, "en", "s", len(t or ""), 0.5, 9) for i, t in found.items()]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(texts()), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """A null id and a repeated row."""
    t = texts()[5]
    return spark.createDataFrame([*rows({1: t, 2: "short text here"}), (None, t, None, None, None, None, None), (1, t, "en", "s", 1, 0.5, 9)], DOCS)
