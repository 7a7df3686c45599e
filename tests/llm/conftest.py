"""Rows with every kind of trouble: nulls, empty and long texts, ties, repeated rows, names that clash."""

import random

import pytest

VOCABULARY = ["the", "of", "Über", "naïve", "stone", "river", "a", "light", "house", "and", "walk", "Green", "été", "moon", "seven", "path"]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    out = [(i, sentence(rng, rng.randint(12, 150))) for i in range(60)]
    out += [(100 + i, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 30)) for i in range(6)]
    words = base.split(" ")
    for i in range(12):  # near copies
        w = list(words)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 10**6))
        out.append((200 + i, " ".join(w)))
    out += [(300, base), (301, base), (301, base), (302, base.upper()), (303, None), (304, ""), (305, " \t\n"), (306, "one"), (307, "ONE"), (308, "two words")]
    out += [(None, passage), (None, None), (309, "x " * 400), (310, sentence(rng, 6000)), (311, "é" * 250 + " tail"), (312, "#$ *** %% || && <> " * 10), (313, "LOUD!! NOISE!! " * 9)]
    out += [(314, "Licensed under CC BY-NC 4.0.\nall rights Reserved"), (315, "GNU General Public License, version 3 this work is licensed under the"), (316, "cc  by; cc-by CC\nBY")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a table, with columns named like the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    full = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t) if t else None, 1, "x", True) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, row string, kept boolean"
    spark.createDataFrame(full, schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def ordered(found):
    return sorted((tuple(r) for r in found), key=str)
