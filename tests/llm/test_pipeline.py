import hashlib
import random
import string
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import bpe, lines, packing, queries, quality, secrets, simhash
from tests.llm.helpers import documents, words
from tests.llm.test_nearcopies import brute_leaders
from tests.llm.test_secrets import brute as brute_spans
from tests.llm.test_simhash import union_find
from tests.test_queries import TABLES, rows

NAMES = ["quality_rules", "line_dedup", "simhash_near_dedup", "secret_scan", "packing"]


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_each_stage_does_its_operators_work(spark):
    docs = documents(spark)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = stage(spark, docs, "")
        if name != "packing":
            assert out[name].columns == docs.columns, name
            docs = spark.createDataFrame(out[name].collect(), docs.schema)
    good = {r.doc_id for r in quality.quality_verdicts(documents(spark)).where("kept").collect()}
    assert {r.doc_id for r in out["quality_rules"].collect()} == good
    assert out["line_dedup"].count() == out["quality_rules"].count()
    assert out["secret_scan"].count() == out["simhash_near_dedup"].count()
    whole = packing.pack(docs, corpus_pipeline.public_tokenizers.path(corpus_pipeline.WORD_BPE)).groupBy().sum("length").first()[0]
    assert out["packing"].groupBy().sum("length").first()[0] == whole
    lengths = docs.selectExpr("n_chars = length(text) as same").distinct().collect()
    assert [r.same for r in lengths] == [True]


def test_stages_on_nothing_and_on_odd_rows(spark):
    for rows_ in ([], [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, None)]):
        docs = documents(spark, rows_)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").collect()


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(pieces.columns)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = secrets.redact(simhash.keep_one_each(lines.dedup(quality.keep_good(docs)).select(*docs.columns)))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in left.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        assert rows(got) == rows(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_op2_like_brute_force(spark, sf_dir, texts):
    def fingerprint(text):
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
        h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else [])]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {d: fingerprint(t) for d, t in texts.items()}
    pairs = [(a, b) for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = union_find(pairs, list(prints))
    least = {}
    for d in prints:
        least[root[d]] = min(least.get(root[d], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", least[root[d]]) for d, p in prints.items()}


def test_op4_like_the_tokenizer(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    pieces, sequences = {}, {}
    for r in queries.op4_cost_balanced_packing(spark, sf_dir).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for group, total in [(pieces[d], len(x)) for d, x in ids.items()] + [(x, None) for x in sequences.values()]:
        at = 0
        for start, length in sorted(group):
            assert start == at and length > 0
            at += length
        assert at == total if total else at <= 2048


def test_op5_base_like_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op5_secret_scan(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        spans = brute_spans(t)
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")]
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert got[d].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in got[d].spans.split(",") if x and not x.startswith("random")] == joined


def test_op6_like_the_library(spark, sf_dir, texts):
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_byte_bpe(spark, sf_dir).collect()}
    for d, t in texts.items():
        ids = whole.encode_ordinary(t or "")
        assert got[d] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def planted():
    """Clean texts, and junk, a near copy, an exact copy, a repeated run of lines, a long repeated passage, and a key."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeiou" if k % 2 else "bcdfghlmnprst") for k in range(rng.randint(2, 9))) for _ in range(900)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    clean = [[line(rng.randint(8, 16)) for _ in range(12)] for _ in range(40)]
    run, passage = [line(9) for _ in range(4)], line(60)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48))
    clean[3][5:5], clean[7][2:2] = run, run
    clean[20] = [" ".join(clean[20])]
    clean[9].append(passage)
    clean[12].insert(0, passage)
    clean[15].append(f"the value {key} is kept here")
    clean[16].append("password = abcdefgh12345")
    texts = ["\n".join(x) for x in clean]
    near = texts[20].split(" ")
    near[40] = "otherwise"
    return texts + [texts[5], " ".join(near), "too short", "same same same " * 60], run, passage, key


def test_pipeline_like_a_plain_one(spark):
    """Planted cases, and what is left of every text, against a pipeline of plain Python."""
    texts, run, passage, key = planted()
    docs, kept = documents(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    want = {i: t for i, t in enumerate(texts) if len(words(t)) >= 20 and not t.startswith("same")}
    assert kept[0] == want
    seen, left = set(), {}
    for i, t in want.items():  # later places of runs of three lines or more
        own = t.split("\n")
        grams = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
        gone = {k + j for k, g in enumerate(grams) if g in seen for j in range(3)}
        seen |= set(grams)
        left[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    assert kept[1] == left and run[0] in left[3] and not any(x in left[7] for x in run)
    leaders = brute_leaders([(i, t) for i, t in left.items()])
    first, last = {}, {}
    counts = Counter(x for i in leaders for x in set(left[i].split("\n")) if len(words(x)) >= 4)
    for i in sorted(leaders):  # later places of long lines, pairs of lines and frequent lines
        own, gone = left[i].split("\n"), set()
        for size in (1, 2):
            for k in range(len(own) - size + 1):
                unit = tuple(own[k : k + size])
                n = sum(len(words(x)) for x in unit)
                if n >= 50 or (size == 1 and n >= 4 and counts[unit[0]] >= 10):
                    if first.setdefault(unit, (i, k)) != (i, k):
                        gone |= set(range(k, k + size))
        last[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    assert kept[2] == last and 41 not in last and 20 in last and passage in last[9] and passage not in last[12]
    masked = {i: t.replace(key, "[SECRET]").replace("password = abcdefgh12345", "[SECRET]") for i, t in last.items()}
    assert kept[3] == masked and sum("[SECRET]" in t for t in masked.values()) == 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = Counter()
    for r in corpus_pipeline.pack(spark, docs, "").collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
