import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from loomtrace.operators import similarity
from loomtrace.session import new_folder
from loomtrace.sources.tables import DuplicateRows, Snapshots, append_new


def test_a_version_counts_once_its_manifest_is_there(spark):
    store = Snapshots(spark, new_folder(spark))
    assert store.latest() is None
    with pytest.raises(LookupError):
        store.read("t")
    one, two = spark.range(3), spark.range(5)
    assert store.save({"t": one, "u": two}) == 1
    pending = store.write({"t": two})
    assert (store.latest(), store.read("t").count(), store.read("u").count()) == (1, 3, 5)
    assert store.commit(pending, 2) == 2 and store.read("t").count() == 5 and store.read("t", 1).count() == 3
    with pytest.raises((Py4JJavaError, PySparkException)):
        store.commit(pending, 2)  # another writer was first
    assert store.save({"t": one.limit(0)}) == 3 and store.read("t").columns == ["id"] and store.read("t").count() == 0


def test_appends_with_known_keys_are_refused_whole(spark):
    path = new_folder(spark)
    rows = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id bigint, v string")
    append_new(rows(range(10)), path, ["id"], buckets=4)
    append_new(rows(range(10, 14)), path, ["id"], buckets=4)
    for bad in ([20, 3], [21, 22, 21]):
        with pytest.raises(DuplicateRows):
            append_new(rows(bad), path, ["id"], buckets=4)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(14))


def test_zero_vectors_are_not_similar(spark):
    rows = [(1, "a", [0.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "a", [1.0, 0.0]), (4, "b", [1.0, 0.0]), (5, "c", [2.0, 0.0])]
    v = spark.createDataFrame(rows, "id bigint, trajectory_id string, embedding array<float>")
    got = {(r.id_a, r.id_b, round(r.similarity, 6)) for r in similarity.expanded_pairs(v, similarity.similar_pairs(v, 0.9)).collect()}
    assert got == {(3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0)}
