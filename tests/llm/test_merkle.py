"""The manifest against a plain tree built from the texts, with nulls, lone rows, repeated rows and groups of one."""

import hashlib
import random
import zlib

import pytest

from corpusloom.llm import merkle, queries
from tests.llm.helpers import SCHEMA, corpus, documents


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(digests, fanout):
    """The root of a tree, and the (left, right) siblings of each leaf level by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(at):
            a = k // fanout * fanout
            paths[i].append(("".join(digests[a:k]), "".join(digests[k + 1 : a + fanout])))
        digests, at = [H(*digests[a : a + fanout]) for a in range(0, len(digests), fanout)], [k // fanout for k in at]
    return digests[0], paths


def plain(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    digest = lambda r, t: H(*map(field, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, roots = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        root, paths = climb([digest(r, r[1]) for r in own], fanout)
        roots.append(root)
        out += [(r, root, path, len(roots) - 1) for r, path in zip(own, paths, strict=True)]
    top, above = climb(roots, fanout)
    result = []
    for r, sub, path, k in out:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        leaf, h = digest(r, r[1]), digest(r, r[1].replace("\n", "") if hit else r[1])
        for left, right in path + above[k]:
            h = H(left, h, right)
        result.append((r[0], leaf, sub, top, H(*[x for step in path + above[k] for x in step]), h, h == top))
    return sorted(result, key=str)


def write(spark, path, rows):
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    return str(path)


def got(frame):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("rows", [corpus(), corpus()[:1], [corpus()[9]] * 2 + [(i, "a\nb", "en", f"s{i}", 3) for i in range(11)], [(i, f"t{i}", None, None, None) for i in range(30)] + [(99, None, "en", "z", 1), (98, "", "en", "é", 0)]])
def test_like_the_plain_tree(spark, tmp_path, rows):
    assert got(queries.op11_merkle_manifest(spark, write(spark, tmp_path, rows))) == plain(rows)


def test_deep_and_hot(spark, tmp_path, monkeypatch):
    """Blocks of two levels, so that trees take several rounds; one group has most rows."""
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rng = random.Random(1)
    rows = [(i, f"text\n{i % 40}", "en", "hot" if i % 10 else f"s{rng.randint(0, 40)}", i) for i in range(3000)]
    assert got(queries.op11_merkle_manifest(spark, write(spark, tmp_path, rows))) == plain(rows)


def test_other_fanouts_and_kept_columns(spark):
    rows = [(i, str(i), "en", f"s{i % 3}", 1) for i in range(50)]
    found = merkle.proofs(documents(spark, rows), ["doc_id", "text"], "source", "doc_id", fanout=2, keep=("lang",)).collect()
    digests = [[H(field(r[0]), field(r[1])) for r in rows if r[3] == f"s{k}"] for k in range(3)]
    top, above = climb([climb(d, 2)[0] for d in digests], 2)
    assert {r.root.hex() for r in found} == {top} and {r.lang for r in found} == {"en"} and len(found) == 50
    assert {r.id: [(s.left.hex(), s.right.hex()) for s in r.proof] for r in found}[4] == climb(digests[1], 2)[1][1] + above[1]


def test_no_rows(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA), ["doc_id", "text"], "source", "doc_id", keep=("lang",)).count() == 0
