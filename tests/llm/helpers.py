"""Small corpora with the cases that every operator must handle, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with nulls, empty texts, copies, near copies, shared passages, repeated lines, ties and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = sentence(40)
    shared = "\n".join(sentence(6) for _ in range(5))
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "A b C"]
    for i in range(n):
        own = "\n".join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 8)))
        if i % 4 == 0:
            own = f"{own} {passage}\n{sentence(5)}"
        if i % 5 == 0:
            own = f"{own}\n{shared}\n{sentence(9)}"
        texts.append(own)
    texts += [texts[10], texts[10], texts[11], texts[12] + " zz", texts[13].upper(), "same same " * 60, "\n".join([sentence(4)] * 12)]
    texts.append("   x\x1cy \x0b z " + sentence(3000))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)]
    rows.append(rows[20])  # a repeated row
    rows.append((None, texts[12], None, None, None))
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
