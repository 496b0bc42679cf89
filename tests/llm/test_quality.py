import re
from collections import Counter

import pyarrow as pa

from corpusloom.llm import quality
from tests.llm.helpers import corpus, documents, words


def brute(text):
    w = words(text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    counts, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if counts[g] > 1:
            covered |= set(range(k, k + 8))
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), failed


GOOD = "The day was warm and they walked to the river, where boats lay in the sun; nobody spoke for a while, and then all of them did at once."
BAD = {
    "symbols": " ".join(f"{w}###" for w in GOOD.split()),
    "word_length": " ".join(w[0] for w in GOOD.split()),
    "duplicate_lines": "\n".join(["again", "and", "so"] * 8 + [GOOD]),
    "words_without_letters": " ".join(f"{w} 77 -- 1" for w in GOOD.split()),
    "shouting": GOOD.upper(),
    "exclamation": " ".join(f"{w}!" for w in GOOD.split()),
    "stutter": " ".join(f"{w} {w}" for w in GOOD.split()),
    "bullets_and_ellipses": "\n".join(f"- {w} {w}x" for w in GOOD.split()),
}


def test_base_counts_like_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in quality.quality_verdicts(documents(spark, rows)).collect()}
    for doc, text, *_ in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
        assert not (r.kept and r.base_failed)


def test_each_rule_rejects_its_kind_and_keeps_clean_text():
    for rule in quality.RULES:
        texts = pa.array([BAD[rule.name], GOOD])
        assert rule.rejects(texts, quality.base_counts(texts)).tolist() == [True, False], rule.name


def test_order_changes_cost_but_no_verdict(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate([*BAD.values(), GOOD, None, ""])]
    docs = documents(spark, rows)
    verdicts = [{r.doc_id: r.kept for r in quality.judge(docs, rules, keep_columns=("doc_id",)).collect()} for rules in (quality.RULES, quality.RULES[::-1], quality.ordered(docs))]
    assert verdicts[0] == verdicts[1] == verdicts[2] and [k for k, v in verdicts[0].items() if v] == [len(BAD)]
    assert quality.ordered(documents(spark, [rows[0]] * 30))[0].rejects is not None


def test_a_task_finds_the_order_on_its_own_texts():
    texts = pa.array([GOOD, BAD["stutter"], "short"] * 40 + [BAD["stutter"]] * 80 + [GOOD, None, BAD["shouting"]])
    seen = Counter()

    def counted(rule):
        def of(t, base):
            seen[rule.name] += t.n
            return rule.of(t, base)

        return quality.Rule(rule.name, of)

    cascade = quality.Cascade(tuple(map(counted, quality.RULES)), 16)
    flags = [x for a in range(0, len(texts), 50) for x in cascade.passes(texts.slice(a, 50))[1].tolist()]
    assert flags == [t == GOOD for t in texts.to_pylist()]
    assert cascade.sampled == 16 and cascade.order[0].name == "stutter"
    assert seen["stutter"] == 162 and seen["symbols"] < 70  # base failures are seen by none, stutterers after the sample by one rule


def test_rejections_by_rule(spark):
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate([*BAD.values(), GOOD, None, "short"])])
    got = {r.rule: (r.rejected, r.texts) for r in quality.measure(docs).collect()}
    assert set(got) == set(BAD) and got["shouting"] == (1, sum(not brute(t)[-1] for t in [*BAD.values(), GOOD]))


def test_keep_good_keeps_columns(spark):
    docs = documents(spark, [(1, GOOD, "en", "s", 1), (2, "x", None, None, None), (3, BAD["shouting"], "en", "s", 2)])
    clashing = docs.withColumn("kept", quality.F.lit("mine")).withColumn("n_words", quality.F.lit(-1)).withColumn("c0", quality.F.lit(0))
    out = quality.keep_good(clashing)
    assert out.columns == clashing.columns and out.collect() == clashing.where("doc_id = 1").collect()


def test_empty_table(spark):
    assert quality.quality_verdicts(documents(spark, [])).count() == 0
