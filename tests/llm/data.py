"""Small documents with every awkward case, and the words they are made of."""

from __future__ import annotations

import random

COLUMNS = (
    "doc_id long, text string, lang string, kept boolean, n_words string, n_lines int, fingerprint string, contaminated "
    "int, ids string, pii string, score string, item_ids string, __row int"
)


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def texts() -> list[str | None]:
    base = " ".join(words(90, 1))
    near = base.split()
    near[40] = "changed"
    lines = "\n".join(" ".join(words(12, 50 + s)) for s in range(5))
    return [
        None, "", " \t\n\x0b\r ", "one", "a b c d", base, base, " ".join(near), base + " tail", lines, "new first line of nine words in this one\n" + lines,
        lines.replace("\n", "\n\n") + "\n", " ".join(words(3000, 7)), "x " * 3000, "é漢字😀 \u00a0ß İ\u0085end", "the the the " * 40, "A" * 5000, "\n".join(["same line again of eight words it has"] * 4), "THE END of $$$ ### ***",
    ]


def rows() -> list[tuple]:
    """Ids with a gap, a null id, repeated rows, and one id with two texts."""
    out = [(k * 3, t) for k, t in enumerate(texts())]
    out += [(None, "no id here"), (None, None), (15, texts()[5]), (15, texts()[5]), (500, "first text of 500"), (500, "second text of 500")]
    return [(i, t, "en", True, "mine", 1, "f", 0, "i", "p", "s", "q", 9) for i, t in out]


def frame(spark, some: list[tuple] | None = None):
    return spark.createDataFrame(rows() if some is None else some, COLUMNS)
