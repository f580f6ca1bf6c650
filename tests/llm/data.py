"""Small tables with the cases that every operator must define: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _h string, set_id string"


def documents(n: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choice(vocab) for _ in range(12))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)
        elif texts and kind < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5)))
            if rng.random() < 0.4:
                text += "\n" + rng.choice(["  ", "\t"]) + (shared.upper() if rng.random() < 0.5 else shared)
        texts.append(text or "x")
        rows.append((i, text, "en", f"s{i % 3}" if i % 7 else None, len(text), "a", "b", "c"))
    long = " ".join(rng.choice(vocab) for _ in range(20_000))
    rows += [(n, None, None, None, None, None, None, None), (n + 1, "", "fr", "", 0, "", "", ""), (n + 2, long, "de", "s1", len(long), "", "", ""), (None, "no id here at all", "en", "s0", 3, "", "", "")]
    rows += [rows[0], rows[0], (n + 3, " \t\n \x0b\x0c\r ", "en", "s2", 9, "", "", ""), (n + 4, "ünï   code é\n\né É 日本", "en", "s\U0001f600", 5, "", "", "")]
    return rows


def frame(spark, rows=None, parts: int = 5):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
