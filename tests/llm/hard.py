"""Small tables with the awkward rows that every operator must take: nulls, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "kept score n_words class_id cls rid doc pos name level bands doc_tokens pattern good _doc _m block severity ids".split()


def words(text):
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    made = ["".join(rng.choice(["th", "er", "on", "an", "re", "ti", "en", "al"]) for _ in range(1 + i % 4)) + str(i) * (i % 7 == 0) for i in range(vocabulary)]
    out = [rng.choice(made) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(out))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split(" ")
    near[10] = "changed"
    run = "\n".join(prose(rng, 12) for _ in range(6))
    rows = [(1, base), (2, " ".join(near)), (3, base), (3, base), (None, base), (4, None), (5, ""), (6, " \n\t "), (None, None), (7, "one"), (8, "x" * 60_000), (9, prose(rng, 20_000))]
    rows += [(10, "head\n" + run + "\ntail"), (11, run + "\n" + prose(rng, 60)), (12, run), (13, "é ü 　wide  \U0001F600 <|endoftext|> \x00\x1c"), (14, "a  b   c\r\n\r\n d "), (15, "same " * 80)]
    rows += [(20 + i, prose(rng, rng.randrange(3, 120))) for i in range(25)]
    return rows


def table(spark, rows=None):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = texts() if rows is None else rows
    full = [(i, t, None if k % 9 == 8 else "en", None, None, *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(3)
