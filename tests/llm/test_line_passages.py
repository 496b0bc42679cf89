import random

from corpusloom.llm import lines
from tests.llm.helpers import corpus, documents, words


def brute(rows):
    """(doc_id, text left) with windows of three lines, passages of one or two lines and frequent lines."""
    places, own = {}, {}
    for doc, text, *_ in rows:
        if doc is None or text is None:
            continue
        real = [(k, x, len(words(x))) for k, x in enumerate(text.split("\n")) if words(x)]
        own[doc, text] = []
        for size in (1, 2, 3):
            for i in range(len(real) - size + 1):
                part = real[i : i + size]
                unit = tuple(x for _, x, _ in part)
                places.setdefault(unit, set()).add((doc, part[0][0]))
                own[doc, text].append((unit, part, sum(n for *_, n in part)))
    out = []
    for doc, text, *_ in rows:
        gone = set()
        for unit, part, n in own.get((doc, text), []):
            frequent = len(unit) == 1 and n >= 4 and len({d for d, _ in places[unit]}) >= 10
            if (len(unit) == 3 or n >= 50 or frequent) and (doc, part[0][0]) > min(places[unit]):
                gone |= {k for k, *_ in part}
        out.append((-1 if doc is None else doc, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)))
    return sorted(out, key=str)


def passages():
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, half, other, notice, mark, rare = line(60), line(30), line(25), line(9), "see below", line(9)
    texts = [long, f"{line(9)}\n{long}", long, f"{half}\n\n{other}", f"{line(5)}\n{half}\n{other}", half, other, f"{rare}\n{line(9)}", rare]
    texts += [f"{line(12)}\n{notice}\n{mark}\n{line(11)}" for _ in range(12)] + [notice]
    return [(i, x, None, None, None) for i, x in enumerate(texts)]


def test_passages_like_brute_force(spark):
    rows = passages()
    got = sorted(((r.doc_id, r.text) for r in lines.dedup(documents(spark, rows), passages=True).collect()), key=str)
    assert got == brute(rows)
    left = {i: x for i, x in got}
    assert left[2] == "" and left[4].count("\n") == 0 and left[8] == rows[8][1] and left[21] == ""
    assert sum(rows[9][1].split("\n")[1] in x for x in left.values()) == 1 and sum("see below" in x for x in left.values()) == 12


def test_passages_of_odd_rows_like_brute_force(spark):
    rows = corpus()
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in lines.dedup(documents(spark, rows), passages=True).collect()), key=str)
    assert got == brute(rows)


def test_runs_are_extended_both_ways(spark):
    line = [f"line number {i}" for i in range(40)]
    rows = [(1, "\n".join(line[:20])), (2, "\n".join(["own"] + line[2:9] + ["own too", ""] + line[12:17])), (3, "\n".join(["else"] + line[5:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", lines.F.xxhash64("text"))
    got = sorted((r.doc_id, r.start, r.n_lines, r.first_doc, r.first_start, r.numbers) for r in lines.repeated_runs(docs).collect())
    assert got == [(2, 1, 7, 1, 2, list(range(1, 8))), (2, 9, 5, 1, 12, list(range(10, 15))), (3, 1, 3, 1, 5, [1, 2, 3])]
