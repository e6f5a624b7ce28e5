import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidRequest
from tidemark.functions import attrs, ids, vectors
from tidemark.operators import ann


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0], [0.0, 1e-7])], "a array<float>, b array<float>, z array<float>")
    row = df.select(vectors.euclidean_squared(F.col("a"), F.col("b")).alias("l2"), vectors.normalize(F.col("z")).alias("z"), vectors.cosine_distance(vectors.normalize(F.col("z")), F.col("a")).alias("c")).first()
    assert (row.l2, row.z, row.c) == (25.0, [0.0, 0.0], 1.0)
    assert vectors.normalized([3, 4]) == [0.6, 0.8] and vectors.normalized([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize(
    "value, tag, key",
    [
        ("a", "String", "a"), (1, "Int", "1"), (1 << 63, "Uint", str(1 << 63)), (1 << 64, "Float", "18446744073709552000"), (1.0, "Float", "1"), (0.1, "Float", "0.1"),
        (1e21, "Float", "1000000000000000000000"), (1e-7, "Float", "0.0000001"), (-0.0, "Float", "-0"), (True, "Bool", "true"), (None, "Null", "null"), ([], "EmptyArray", "EmptyArray"),
        (["a", 'b"'], "StringArray", 'StringArray(["a", "b\\""])'), ([1, 2], "IntArray", "IntArray([1, 2])"), ([1, 2.5], "FloatArray", "FloatArray([1.0, 2.5])"),
        ([1e16, 1e-6], "FloatArray", "FloatArray([1e16, 1e-6])"), ([1 << 63], "FloatArray", "FloatArray([9.223372036854776e18])"), ([True], "BoolArray", "BoolArray([true])"),
        (uuid.UUID(int=5), "Uuid", "00000000-0000-0000-0000-000000000005"), (attrs.DateTime(7), "DateTime", "7"),
    ],
)
def test_attributes(value, tag, key):
    found = attrs.encode(value)
    assert (found["tag"], found["key"]) == (tag, key)
    if isinstance(value, (str, bool, list)) or value is None:
        assert attrs.decode(found) == value


@pytest.mark.parametrize("value", [{"a": 1}, [1, "a"], [None], [[1]], [{"a": 1}], ["a", True]])
def test_rejected_attributes(value):
    with pytest.raises(InvalidRequest, match="field"):
        attrs.encode(value, "field")


def test_ids(spark):
    for value in ("x", "1", 1, 256, (1 << 64) - 1, uuid.UUID(int=9)):
        assert ids.decode(*ids.encode(value)) == value
    assert ids.encode("1") != ids.encode(1) and ids.display(*ids.encode("1")) == ids.display(*ids.encode(1))
    for bad in (-1, 1.5, True, None, 1 << 64):
        with pytest.raises(InvalidRequest):
            ids.encode(bad)
    values = [ids.encode(v) for v in ("é", 77, uuid.UUID(int=9))]
    df = spark.createDataFrame([(v,) for v in values], f"id {ids.ID_TYPE}")
    assert [r[0] for r in df.select(ids.display_column(F.col("id"))).collect()] == ["é", "77", str(uuid.UUID(int=9))]


def test_two_means():
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    half = ann.two_means(x)
    assert half[0] == half[1] != half[2] == half[3]
    assert set(ann.two_means(np.ones((5, 2)))) == {0, 1}
    assert list(ann.two_means(np.ones((1, 2)))) == [0]
    assert (ann.two_means(x, seed=3) == ann.two_means(x, seed=3)).all()


def test_recall_at_full_fanout(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    config = ann.AnnConfig(max_posting_size=60, min_posting_size=5, rounds=2)
    postings, centroids = ann.build(rows, config)
    assert postings.count() == 400 and centroids.count() >= 7
    truth = set(np.argsort(1 - x.astype(np.float32).astype(float) @ x[0].astype(np.float32).astype(float), kind="stable")[:10].tolist())
    full = ann.search(postings, centroids, x[0].astype(np.float32).tolist(), 10, ann.AnnConfig(search_fanout=1000))
    assert {r["id"] for r in full.collect()} == truth
    some = ann.search(postings, centroids, x[0].astype(np.float32).tolist(), 10, config)
    assert len({r["id"] for r in some.collect()} & truth) >= 4


def test_places_give_the_recall_of_a_search(spark):
    x = np.random.default_rng(3).normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, vector array<float>")
    postings, centroids = ann.build(rows, ann.AnnConfig(max_posting_size=60, min_posting_size=5, rounds=2))
    postings = postings.cache()
    queries = rows.where("id % 50 = 0").selectExpr("id as query_id", "vector as query_vector")
    places = ann.neighbour_places(postings, centroids, queries, 10).collect()
    assert len(places) == 80
    for q in (0, 100, 350):
        got = {r["id"] for r in ann.search(postings, centroids, x[q].astype(np.float32).tolist(), 11, ann.AnnConfig(search_fanout=3)).collect()}
        assert got & {p["id"] for p in places if p["query_id"] == q} == {p["id"] for p in places if p["query_id"] == q and p["place"] <= 3}
