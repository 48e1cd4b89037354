"""Small tables with every awkward case, and SQL over them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _mix_n string, fp string, size string"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(rng: random.Random | None = None) -> list[tuple]:
    """Nulls in each column, empty, blank, short and very long texts, ties, copies, repeated rows."""
    rng = rng or random.Random(5)
    base, long = words(rng, 120), words(rng, 30_000)
    rows = [(i, words(rng, rng.randint(1, 200)), f"s{i % 3}") for i in range(1, 25)]
    rows += [(30, base, "s0"), (31, base, "s1"), (32, base + " tail", None), (33, base.replace(" ", "\n", 9), "s2"), (34, long, "s0"), (35, "x " + long, "s1")]
    rows += [(40, None, "s0"), (41, "", "s1"), (42, " \n\t ", "s2"), (43, "one", None), (44, "one two", "s0"), (None, base, "s0"), (None, None, None)]
    rows += [(50, words(rng, 60), "s0")] * 1
    return rows + [rows[-1], (50, "another text of the same id", "s1")]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
