"""Commits over several tables: whole or not at all, in turns, and once for each batch."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom import store as stores
from corpusloom.operators import incremental
from corpusloom.store import Append, Conflict, Note, Replace, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ids(store, name, column, snapshot=None):
    return sorted(r[0] for r in store.read(name, snapshot).select(column).collect())


def filled(spark, store):
    store.commit(
        {
            "documents": Append(spark.createDataFrame([(1,), (2,)], "document_id long")),
            "chunks": Append(spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "document_id long, chunk_id long")),
            "embeddings": Append(spark.createDataFrame([(10,), (20,), (21,)], "chunk_id long")),
            "totals": Note({"n": 3}),
        }
    )


def test_a_delete_is_one_version(spark, store):
    filled(spark, store)
    before = store.snapshot()
    incremental.delete_documents(store, spark.createDataFrame([(2,)], "document_id long"))
    assert (ids(store, "documents", "document_id"), ids(store, "chunks", "chunk_id"), ids(store, "embeddings", "chunk_id")) == ([1], [10], [10])
    assert ids(store, "chunks", "chunk_id", before) == [10, 20, 21] and before.notes == {"totals": {"n": 3}} and store.version() == 2
    assert store.expire() == 3 and ids(store, "embeddings", "chunk_id") == [10] and store.version() == 2


@pytest.mark.parametrize("fails_at", range(4))
def test_a_crash_leaves_the_old_state(spark, store, monkeypatch, fails_at):
    """Between any two writes: of the three tables, or before the manifest."""
    filled(spark, store)
    real, count = Store._write, [0]

    def dies(self, *args):
        if count[0] == fails_at:
            raise RuntimeError("lost")
        count[0] += 1
        return real(self, *args)

    def no_manifest(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_write", dies)
    if fails_at == 3:
        monkeypatch.setattr(Store, "publish", no_manifest)
    with pytest.raises(RuntimeError):
        incremental.delete_documents(store, spark.createDataFrame([(2,)], "document_id long"))
    monkeypatch.undo()
    assert ids(store, "documents", "document_id") == [1, 2] and ids(store, "chunks", "chunk_id") == [10, 20, 21] and ids(store, "embeddings", "chunk_id") == [10, 20, 21]
    incremental.delete_documents(store, spark.createDataFrame([(2,)], "document_id long"))
    assert ids(store, "chunks", "chunk_id") == [10]


def test_commits_at_once_take_turns(spark, store, monkeypatch):
    filled(spark, store)
    publish, document = Store.publish, spark.createDataFrame([(3,)], "document_id long")

    def late(self, *args):
        monkeypatch.setattr(Store, "publish", publish)
        store.commit({"documents": Append(document)})
        return publish(self, *args)

    monkeypatch.setattr(Store, "publish", late)
    incremental.delete_documents(store, spark.createDataFrame([(2,)], "document_id long"))
    assert ids(store, "documents", "document_id") == [1, 3] and store.version() == 3  # worked out anew on what the other had added
    monkeypatch.setattr(Store, "publish", lambda self, *args: False)
    with pytest.raises(Conflict):
        store.commit({"documents": Append(document)}, tries=2)


def test_a_version_is_found_without_its_pointer(spark, store):
    filled(spark, store)
    store.commit({"documents": Replace(spark.createDataFrame([], "document_id long"))})
    store._files.delete(store._at(f"{store.path}/log/last"), True)
    assert store.version() == 2 and store.read("documents").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_upserts_like_a_dictionary(spark, store, seed):
    rng, want, number = random.Random(seed), {}, 0
    for _ in range(6):
        rows = [(rng.randint(0, 9), rng.randint(0, 99), i, rng.random() < 0.3) for i in range(rng.randint(0, 12))]
        frame = spark.createDataFrame(rows, "id long, value long, seq long, gone boolean")
        for _ in range(rng.choice((1, 2))):  # some batches come twice
            store.upsert("t", frame, ("id",), F.col("seq"), F.col("gone"), ("s", number))
        number += 1
        for i, value, _, gone in rows:
            want.pop(i, None) if gone else want.update({i: value})
        if rng.random() < 0.4:
            store.compact("t", ("id",))
            assert len(store.snapshot().tables["t"]["parts"]) == 1
        assert {r.id: r.value for r in store.latest("t", ("id",)).collect()} == want
    assert stores.DELETED not in store.latest("t", ("id",)).columns
