import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusloom.llm import packing
from tests.llm.helpers import corpus, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, pieces, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((-1 if d is None else d), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for d, t, *_ in rows)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        by_doc.setdefault(-1 if r.doc_id is None else r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return want, by_doc, by_sequence


def test_every_id_in_one_piece(spark):
    rows = [r for i, r in enumerate(corpus()) if r not in corpus()[:i]]
    rows += [(1000, "Ünḯçödé text's don't 12　ab <|endoftext|> İ ς\x1cΣ", None, None, None)]
    for capacity, group in ((2048, 512), (64, 3)):
        pieces = packing.pack(documents(spark, rows).coalesce(2), PATH, capacity=capacity, group_sequences=group).collect()
        want, by_doc, by_sequence = checked(rows, pieces, capacity)
        tokenizer = Tokenizer.from_file(PATH)
        for doc, text, *_ in rows:
            ids = (*tokenizer.encode(text or "", add_special_tokens=False).ids, 1)
            got = sorted(by_doc[-1 if doc is None else doc], key=lambda x: x[0])
            assert tuple(np.concatenate([x[1] for x in got]).tolist()) == ids
            assert {x[2] for x in got} == {len(ids)}
            assert [x[0] for x in got] == np.cumsum([0, *[len(x[1]) for x in got[:-1]]]).tolist()
        short = [k for k, own in by_sequence.items() if sum(n for _, n in own) < capacity]
        assert len(short) <= 2


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    lengths = rng.integers(20, 900, 400)
    sequences = int(lengths.sum()) // 2048
    pieces, cost = packing.assign(lengths, sequences, 2048)
    taken = np.zeros(sequences)
    for _, _, n, s, _ in pieces:
        taken[s] += n
    assert (taken == 2048).all()
    in_order = np.zeros(sequences + 1)
    at = 0
    for n in lengths.tolist():
        while n:
            take = min(n, 2048 - at % 2048)
            in_order[at // 2048] += take + take * take / 2048
            at, n = at + take, n - take
    assert cost.max() <= in_order[:-1].max() and cost.std() < in_order[:-1].std()


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_merging_by_rank_is_merging_in_order():
    """Every token comes out of its own bytes, so ranks can't join what the merges don't."""
    import json

    with open(PATH) as f:
        model = json.load(f)["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    assert all(model["vocab"][a + b] == 512 + i for (a, b), i in rank.items())
    for token, i in model["vocab"].items():
        if 512 <= i < 512 + len(rank):
            parts = [*token.removesuffix("</w>")]
            if token.endswith("</w>"):
                parts[-1] += "</w>"
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda k: rank.get((parts[k], parts[k + 1]), len(rank)))
                assert (parts[best], parts[best + 1]) in rank
                parts[best : best + 2] = [parts[best] + parts[best + 1]]


def same_ids(encoder, tokenizer, texts):
    for a in range(0, len(texts), 4096):
        part = texts[a : a + 4096]
        ids, counts = encoder.encode(packing.pa.array(part, packing.pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part] if None in part else [x.ids for x in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        wrong = np.flatnonzero(ids != np.array([i for x in want for i in x], np.uint32))
        assert not len(wrong), part[int(np.searchsorted(np.cumsum(counts), wrong[0], side="right"))]


def test_words_like_the_plain_call():
    texts = ["Été, ÉTÉ! don't DON'T's a.b(c)d e=f≠g e̸=x ≠ (abc)' 'tis ab'", "x\x00y z\x00 \x00", "ªµº ÿ Ÿ ſ K İI ΑΣ", "12ab34 ½ ² 漢字。", "á. Áb J̌ T̈ H̱", "ŞİRKETİ. क़!", None, ""]
    special = ["<|startoftext|>a<|endoftext|>", "a<|EndOfText|>b", "<|endoftext |>", "e<|endoftext|>\u0301x! ", "<|endoftext|>", "x < |endoftext|>"]
    same_ids(packing.WordEncoder(PATH), Tokenizer.from_file(PATH), [*texts, *special, *texts])


def test_every_code_point_next_to_letters_and_symbols():
    symbols = [chr(c) for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F))]
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    same_ids(encoder, tokenizer, [f"{c} a{c}b A{c} {c}! !{c} {c}'s '{c} J{c} T{c}!" for c in every])
    same_ids(encoder, tokenizer, [" ".join(f"{c}{s} {s}{c} x{c}{s}Y" for s in symbols) for c in every if ord(c) < 0x3000])


def test_special_strings_in_a_table(spark):
    rows = [(1, "a<|endoftext|>b", None, None, None), (2, "<|startoftext|>", None, None, None), (3, "<|Endoftext|>", None, None, None)]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(documents(spark, rows), PATH).collect()}
    tokenizer = Tokenizer.from_file(PATH)
    assert got == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    assert 49407 in got[1] and got[2] == [49406, 1] and 49407 not in got[3]
