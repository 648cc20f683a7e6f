"""Texts for the tests of this folder."""

import random

WORDS = "ba co de ti on er an re is ing the lo ma ne pro ver te ra sen st".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and ids, ties."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(30)]
    long = prose(rng, 30_000)
    texts = [*base, base[3], base[3] + " ", "\t" + base[4].replace(" ", "\n"), base[5].upper(), "", "   ", "\n\n", None, None, "a", "é😀 ü", "x" * 50_000, long, long[:-40] + " other end", "1 2 3 !!", base[7] + "\n" + base[8] + "\n" + base[7]]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, base[0], "en", None, None), (None, None, None, None, None), (5, base[9], "en", "s", 1), (-7, base[10], "en", "s", 1)]
