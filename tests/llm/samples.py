"""Documents the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def cases() -> list[tuple]:
    """Nulls in each column, empty and very long texts, ties, repeated rows, exact and near copies."""
    base, passage = words(1, 120), words(2, 60)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, "  " + base.replace(" ", "\n\t"), " ".join(near), None, "", " \n ", "one two", "ONE Two", "1234 !!", words(3, 30) + "\n" + passage, passage + "\n" + words(4, 30), words(5, 9000), "x" * 30_000, "same line here\nsame line here\n" + words(6, 20), "é" * 50 + " " + words(7, 40)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s2", "s1", None, "s10"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((None, base, "en", "s1", len(base)))
    rows.append((None, None, None, None, None))
    return rows
