import random
import re

import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import bpe, lines, queries, rollups
from corpusloom.llm.common import scratch
from tests.llm.helpers import WORD, corpus, documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(rows, run):
    places = {}
    for doc, text, *_ in rows:
        if doc is not None:
            own = [x for x in (text or "").split("\n") if WORD.search(x)]
            for i in range(len(own) - run + 1):
                places.setdefault(tuple(own[i : i + run]), set()).add((doc, i))
    out = []
    for doc, text, *_ in rows:
        split = (text or "").split("\n")
        own = [k for k, x in enumerate(split) if WORD.search(x)]
        gone = set()
        if doc is not None:
            for i in range(len(own) - run + 1):
                if min(places[tuple(split[k] for k in own[i : i + run])]) < (doc, i):
                    gone |= set(own[i : i + run])
        kept = None if text is None else "\n".join(x for k, x in enumerate(split) if k not in gone)
        out.append((-1 if doc is None else doc, kept, len(own) if text is not None else 0, len(gone)))
    return sorted(out, key=str)


def test_lines_like_brute_force(spark):
    rows = corpus()
    out = lines.dedup(documents(spark, rows).withColumn("gone", lines.F.lit(1)).withColumn("c0", lines.F.lit(2)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "c0", "n_lines", "n_removed"]
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == brute(rows, 3) and sum(x[3] for x in got) > 60


def test_lines_with_few_kinds(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(("a", "b", "c", "", " ")) for _ in range(rng.randint(0, 14))), None, None, None) for i in range(120)]
    for run in (2, 3, 4):
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(documents(spark, rows), run=run).collect()), key=str)
        assert got == brute(rows, run)


def test_lines_empty_table(spark):
    assert lines.dedup(documents(spark, [])).count() == 0


def test_rollups_like_brute_force(spark):
    rows = corpus()
    docs = documents(spark, rows)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})
    count = lambda d: rollups.count_tokens(d, RANKS, public_tokenizers.PATTERN, "v1")
    path = scratch(spark, "test-rollup")
    rollups.commit(rollups.inserts(count(docs)), path, 0)
    rollups.commit(rollups.inserts(count(docs)), path, 0)
    copies = rollups.later_copies(docs)
    gone = {r.doc_id for r in copies.collect()}
    rollups.commit(rollups.deletes(count(docs).join(copies, "doc_id", "left_semi")), path, 1)
    changed = docs.where("text like '%e%' and doc_id % 2 = 0")
    rollups.commit(rollups.revisions(count(changed), count(changed.withColumn("text", rollups.F.concat("text", rollups.F.lit(" more"))))), path, 2)
    want = {}
    for doc, text, lang, source, _ in rows:
        own = text or ""
        if doc is not None and doc % 2 == 0 and "e" in own:
            extra = len(whole.encode_ordinary(own + " more")) - len(whole.encode_ordinary(own)), 5
        else:
            extra = 0, 0
        held = want.setdefault((source, lang, "v1"), [0, 0, 0])
        sign = 0 if doc in gone else 1
        for k, x in enumerate((sign, sign * len(whole.encode_ordinary(own)) + extra[0], sign * len(own) + extra[1])):
            held[k] += x
    result = lambda p: {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in rollups.totals(spark, p).collect()}
    assert result(path) == {k: v for k, v in want.items() if any(v)}
    rollups.compact(spark, path, path + "-compact")
    assert result(path + "-compact") == result(path)


def test_copies(spark):
    rows = corpus()
    first = {}
    for doc, text, *_ in rows:
        if doc is not None and text is not None:
            first[text] = min(first.get(text, doc), doc)
    want = {d for d, t, *_ in rows if d is not None and t is not None and first[t] < d}
    assert {r.doc_id for r in rollups.later_copies(documents(spark, rows)).collect()} == want


def test_rollup_of_nothing(spark):
    path = scratch(spark, "test-rollup")
    rollups.commit(rollups.inserts(rollups.count_tokens(documents(spark, []), RANKS, public_tokenizers.PATTERN, "v1")), path, 0)
    assert rollups.totals(spark, path).count() == 0


def test_no_commit_and_commits_again(spark):
    path = scratch(spark, "test-rollup")
    assert rollups.totals(spark, path).count() == 0
    change = lambda *rows: spark.createDataFrame(rows, rollups._SCHEMA)
    result = lambda: sorted(map(tuple, rollups.totals(spark, path).collect()), key=str)
    rollups.commit(change(("a", "en", "v", 1, 10, 50), ("a", "en", "v", 1, 5, 20), (None, "en", "v", 1, 1, 1)), path, 7)
    assert result() == [("a", "en", "v", 2, 15, 70), (None, "en", "v", 1, 1, 1)]
    rollups.commit(change(("a", "en", "v", -1, -5, -20), (None, "en", "v", -1, -1, -1)), path, 8)
    assert result() == [("a", "en", "v", 1, 10, 50)]
    rollups.commit(change(("a", "en", "v", 1, 10, 50), ("b", "de", "v", 1, 2, 3)), path, 7)  # another batch under the same id
    assert result() == sorted([("a", "en", "v", 0, 5, 30), ("b", "de", "v", 1, 2, 3), (None, "en", "v", -1, -1, -1)], key=str)
    before = rollups.totals(spark, path)
    rollups.commit(change(), path, 7)
    rollups.commit(change(), path, 8)
    assert result() == [] and before.count() == 3  # who reads the totals of before still does


def test_a_commit_that_died_and_one_at_the_same_time(spark, monkeypatch):
    path = scratch(spark, "test-rollup")
    one = spark.createDataFrame([("a", "en", "v", 1, 10, 50)], rollups._SCHEMA)
    rollups.commit(one, path, 0)
    publish = rollups._publish

    def late(*args):
        monkeypatch.setattr(rollups, "_publish", publish)
        rollups.commit(one, path, 2)
        return publish(*args)

    monkeypatch.setattr(rollups, "_publish", late)
    rollups.commit(one, path, 1)
    assert [tuple(r) for r in rollups.totals(spark, path).collect()] == [("a", "en", "v", 3, 30, 150)]

    def dies(*args):
        raise RuntimeError

    monkeypatch.setattr(rollups, "_publish", dies)
    try:
        rollups.commit(one, path, 3)
    except RuntimeError:
        pass
    monkeypatch.setattr(rollups, "_publish", publish)
    assert rollups.totals(spark, path).first().n_docs == 3
    rollups.commit(one, path, 3)
    assert rollups.totals(spark, path).first().n_docs == 4


def plain_query(rows):
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})
    first, want = {}, {}
    for doc, text, *_ in rows:
        if text is not None and doc is not None:
            first[text] = min(first.get(text, doc), doc)
    for doc, text, lang, source, _ in rows:
        if doc is None or text is None or first[text] == doc:
            now = re.sub("  +", " ", text or "")
            held = want.setdefault((source, lang, "byte_bpe_50k/1"), [0, 0, 0])
            for k, x in enumerate((1, len(whole.encode_ordinary(now)), len(now))):
                held[k] += x
    return want


@pytest.mark.parametrize("rows", [[(1, "a  b", "en", "s", 4), (1, "plain text", "en", "s", 10), (2, "x y", "en", "s", 3), (None, "c  d", "en", "s", 4)], corpus(2, 20) + [(None, "n  n", "en", "s", 4)] * 2 + [(3, "n  n", "en", "s", 4), (3, "other", None, None, 5), (5, "n  n", "en", "s", 4), (5, "kept  one", "en", "s", 9)]])
def test_the_query_on_repeated_and_null_ids(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op7_token_rollups(spark, str(tmp_path)).collect()}
    assert got == plain_query(rows)


def test_the_query_like_brute_force(spark, sf_dir):
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    first = {}
    for r in rows:
        if r.text is not None:
            first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    want = {}
    for r in rows:
        if r.text is None or first[r.text] == r.doc_id:
            text = re.sub("  +", " ", r.text or "")
            held = want.setdefault((r.source, r.lang, "byte_bpe_50k/1"), [0, 0, 0])
            for k, x in enumerate((1, len(whole.encode_ordinary(text)), len(text))):
                held[k] += x
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op7_token_rollups(spark, sf_dir).collect()}
    assert got == want and len(got) > 3
