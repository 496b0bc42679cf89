import random
import string
import time

from corpusloom.llm import secrets
from tests.llm.helpers import documents

BASE62 = string.ascii_letters + string.digits


def key(rng, n, letters=BASE62):
    return "".join(rng.choice(letters) for _ in range(n))


def found(spark, texts):
    """What is found in each text, next to plain prose that gives the character counts."""
    rng = random.Random(1)
    prose = [" ".join(rng.choice(("then", "another", "of", "these", "which", "Here", "2024", "makes", "quiet", "jumps", "over", "fixed", "lazy", "bag")) for _ in range(400)) for _ in range(20)]
    rows = [(i, t, None, None, None) for i, t in enumerate([*texts, *prose])]
    out = {r.doc_id: [rows[r.doc_id][1][x.start : x.end] for x in r.spans if x.kind == "random"] for r in secrets.scan(documents(spark, rows)).collect()}
    assert not any(out[i] for i in range(len(texts), len(rows)))
    return [out[i] for i in range(len(texts))]


def test_keys_joined_to_names_and_text(spark):
    rng = random.Random(4)
    k, k64, long = key(rng, 40), key(rng, 43, BASE62 + "+/"), key(rng, 6000, BASE62 + "+/")
    texts = [f"session={k}", f"export AUTH={k64}=", f"GET /a?sig={k}&x=1", f"long-name-of-a-thing_here/{k}+tail-end", f"blob {long}", f"{'0123456789abcdef' * 2}/{k}", f"some_very_long_name_of_a_value={k}"]
    assert found(spark, texts) == [[k], [k64 + "="], [k], [f"here/{k}+tail"], [long], [f"/{k}"], [k]]


def test_rare_keys_among_many_ordinary_candidates(spark):
    rng = random.Random(9)
    syllables = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in "lnrst"]
    ordinary = ["".join(rng.choice(syllables) for _ in range(rng.randint(8, 24))) + str(rng.randint(1, 9)) for _ in range(3000)]
    keys = [key(rng, n, letters) for n in (20, 24, 32, 48, 64) for letters in (BASE62, string.ascii_lowercase + string.digits) for _ in range(4)]
    got = found(spark, [f"the name {x} here" for x in ordinary + keys])
    wrong, right = sum(map(bool, got[: len(ordinary)])), [x == [k] for x, k in zip(got[len(ordinary) :], keys, strict=True)]
    assert wrong <= 2
    assert sum(right) >= 36 and all(right[8:])  # those of 24 or more symbols, and most shorter ones


def test_very_long_keys(spark):
    rng = random.Random(11)
    keys = [key(rng, n, BASE62 + "+/") for n in (5000, 100_000)]
    assert found(spark, [f"blob {k} end" for k in keys]) == [[k] for k in keys]


def test_one_key_among_a_hundred_thousand_ordinary_candidates(spark):
    rng = random.Random(12)
    syllables = [a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in "lnrst"]
    ordinary = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(12, 20))) + str(rng.randint(1, 9)) for _ in range(1000)) for _ in range(100)]
    k = key(rng, 48)
    got = found(spark, [*ordinary, f"the key {k} here"])
    assert got[-1] == [k] and sum(map(len, got[:-1])) <= 2


def test_many_spans_and_runs_in_one_text():
    text = " ".join(f"token=abcdefgh{i} AAAAbbbbCCCC1234ddddEEEE{i}" for i in range(50_000))
    began = time.perf_counter()
    spans = secrets.base_spans(text)
    assert len(spans) == 50_000 and not secrets.candidates(text, spans)
    assert time.perf_counter() - began < 30  # a quadratic search takes hours


def test_candidates_keep_clear_of_spans_and_each_other():
    rng = random.Random(13)
    for _ in range(300):
        text = "".join(rng.choice((key(rng, rng.randint(1, 50)), "token=", " ", "_", "+", "-", "/", "=", "0123456789abcdef" * 2, "AKIA")) for _ in range(30))
        spans = secrets.base_spans(text)
        taken = sorted([(a, b) for a, b, *_ in secrets.candidates(text, spans)])
        assert all(x[1] <= y[0] for x, y in zip(taken, taken[1:]))
        assert not any(a < e and s < b for a, b in taken for _, s, e in spans)
