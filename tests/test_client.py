import threading
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.client import Client
from tidemark.errors import DimensionMismatch, DistanceMetricConflict, IndexNotBuilt, InvalidRequest, ManifestUnreadable, NamespaceExists, NamespaceNotFound
from tidemark.functions import names, vectors
from tidemark.operators import ann, inverted, merge
from tidemark.operators.ann import AnnConfig
from tidemark.plans import compact
from tidemark.plans import query as plans
from tidemark.sources import log
from tidemark.sources.manifest import Layer, Manifest, WalFile
from tidemark.streaming.ingest import ingest, read_records

SMALL = AnnConfig(max_posting_size=50, min_posting_size=5, rounds=2)


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, str(tmp_path / "store"), SMALL)


def found(space, vector, k=10, **options):
    return [r["id"] for r in space.results(space.query(vector, k, **options))]


def rows(n, dims=4, seed=1, start=0):
    rng = np.random.default_rng(seed)
    return [{"id": start + i, "vector": rng.normal(size=dims).tolist(), "attributes": {"tag": "AB"[i % 2], "num": i % 5}} for i in range(n)]


def test_names():
    assert names.check("valid-name") == "valid-name"
    for bad in ("Invalid", "bad--name", "bad!name", "aa", "a" * 64, "-bad", "bad-"):
        with pytest.raises(InvalidRequest):
            names.check(bad)


def test_namespaces(client):
    client.create_namespace("one-space")
    assert client.namespaces() == ["one-space"]
    with pytest.raises(NamespaceExists):
        client.create_namespace("one-space")
    with pytest.raises(NamespaceNotFound):  # D17: reading does not create
        client.namespace("two-space")
    assert client.namespaces() == ["one-space"]


def test_write_query_delete_patch(client):
    space = client.create_namespace("docs")
    space.upsert([{"id": "x", "vector": [1, 0], "attributes": {"a": 1, "f": 1.0, "l": ["p", "q"], "n": None}}, {"id": 1, "vector": [0, 2]}, {"id": "1", "vector": [3, 3]}])
    assert found(space, [1, 0]) == ["x", "1", "1"]
    assert space.results(space.query([0, 5], 1))[0]["vector"] == [0.0, 1.0]  # cosine namespaces hold unit vectors
    space.patch([{"id": "x", "attributes": {"a": 2, "b": True}}])
    assert space.get("x")["attributes"] == {"a": 2, "b": True, "f": 1.0, "l": ["p", "q"], "n": None}
    space.delete(["1"])
    assert space.get("1") is None and space.get(1) is not None
    space.compact(force=True)
    assert space.get("1") is None and space.get("x")["attributes"]["a"] == 2
    assert space.metadata()["indexed_row_count"] == 2 and space.metadata()["index_status"] == "up-to-date"


def test_requests(client):
    space = client.create_namespace("checks")
    for call in (lambda: space.upsert([]), lambda: space.delete([]), lambda: space.patch([]), lambda: space.upsert([{"id": 1, "vector": []}]), lambda: space.query([], 1), lambda: space.query([1.0], 0), lambda: space.query([1.0], 1001)):
        with pytest.raises(InvalidRequest):
            call()
    space.upsert([{"id": 1, "vector": [1.0, 2.0]}])
    for call in (lambda: space.upsert([{"id": 2, "vector": [1.0]}]), lambda: space.query([1.0])):  # D10
        with pytest.raises(DimensionMismatch):
            call()
    with pytest.raises(DistanceMetricConflict):
        space.upsert([{"id": 2, "vector": [1.0, 2.0]}], metric=vectors.EUCLIDEAN)
    with pytest.raises(IndexNotBuilt):
        space.query([1.0, 0.0], filters={"a": "1"})
    assert space.manifest().pending_wal_files == 1


def test_metric_of_an_empty_namespace_may_change(client):
    space = client.create_namespace("metric")
    space.upsert([{"id": 1, "vector": [3.0, 4.0]}], metric=vectors.EUCLIDEAN)
    assert space.results(space.query([3.0, 4.0], 1))[0]["dist"] == 0 and space.metadata()["distance_metric"] == vectors.EUCLIDEAN


def test_filters(client):
    space = client.create_namespace("filters", metric=vectors.EUCLIDEAN)
    space.upsert([{"id": "doc1", "vector": [1.0], "attributes": {"tag": "A", "num": 10}}, {"id": "doc2", "vector": [2.0], "attributes": {"tag": "B", "num": 10}}, {"id": "doc3", "vector": [3.0], "attributes": {"tag": "A", "num": 20}}])
    space.compact(force=True)
    assert found(space, [0.0], filters={"tag": "A"}) == ["doc1", "doc3"]
    assert found(space, [0.0], filters={"tag": "A", "num": "10"}) == ["doc1"]
    assert found(space, [0.0], filters={"num": "99"}) == []
    assert found(space, [0.0], filters={"other": "1"}) == []
    space.upsert([{"id": "doc4", "vector": [0.0], "attributes": {"tag": "A"}}])  # filters see indexed attributes
    assert found(space, [0.0], filters={"tag": "A"}) == ["doc1", "doc3"]
    space.compact(force=True)
    assert found(space, [0.0], filters={"tag": "A"}) == ["doc4", "doc1", "doc3"]


def test_index_maintenance(client):
    space = client.create_namespace("keys", metric=vectors.EUCLIDEAN, index_attributes=["k"])
    put = lambda i, k: {"id": i, "vector": [float(i)], "attributes": {"k": k, "other": "z"}}
    space.upsert([put(1, "A"), put(2, "B")])
    space.compact(force=True)
    space.upsert([put(2, "A"), put(3, "B")])
    space.compact(force=True)
    assert found(space, [0.0], filters={"k": "A"}) == ["1", "2"] and found(space, [0.0], filters={"k": "B"}) == ["3"]
    space.delete([1])
    space.compact(force=True)
    assert found(space, [0.0], filters={"k": "A"}) == ["2"]
    assert found(space, [0.0], filters={"other": "z"}) == []


def test_d1_every_row_is_indexed(client):
    space = client.create_namespace("overflow")
    space.upsert(rows(180))
    space.compact(force=True)
    assert space.metadata()["indexed_row_count"] == 180 and space.rows().count() == 180
    from tidemark.plans.query import read_snapshot

    snapshot = read_snapshot(space.spark, space.client.files, space.manifest())
    sizes = {r["posting_id"]: r["n"] for r in snapshot.centroids.collect()}
    assert sum(sizes.values()) == 180 and max(sizes.values()) <= SMALL.max_posting_size
    space.upsert(rows(40, seed=2, start=1000))
    space.compact(force=True)
    assert space.metadata()["indexed_row_count"] == 220


def test_d2_tiny_compaction(client):
    space = client.create_namespace("tiny")
    for i in range(3):
        space.upsert([{"id": i, "vector": [1.0, float(i)]}])
    assert space.compact() and sorted(found(space, [1.0, 0.0])) == ["0", "1", "2"]


def test_d3_delete_then_patch_stays_deleted(client):
    space = client.create_namespace("undead")
    space.upsert([{"id": 1, "vector": [1.0]}], timestamp=100)
    space.compact(force=True)
    space.delete([1], timestamp=300)
    space.patch([{"id": 1, "attributes": {"a": 1}}], timestamp=400)
    assert found(space, [1.0]) == []
    space.compact(force=True)
    assert found(space, [1.0]) == []


def test_d4_a_patch_of_an_unindexed_row(client):
    space = client.create_namespace("unindexed")
    space.patch([{"id": 2, "attributes": {"a": 1}}], timestamp=50)  # of no row at all
    space.upsert([{"id": 1, "vector": [1.0], "attributes": {"a": 0}}], timestamp=100)
    space.patch([{"id": 1, "attributes": {"b": 2}}], timestamp=200)
    space.compact(force=True)
    assert space.get(1)["attributes"] == {"a": 0, "b": 2} and space.get(2) is None


def test_d11_first_writes_of_other_dimensions(client, monkeypatch):
    space = client.create_namespace("first")
    other, seen = client.namespace("first"), space._seen

    def late(key):
        other.upsert([{"id": 2, "vector": [1.0, 2.0, 3.0]}])  # commits while ours is being written
        return seen(key)

    monkeypatch.setattr(space, "_seen", late)
    with pytest.raises(DimensionMismatch):
        space.upsert([{"id": 1, "vector": [1.0, 2.0]}])
    now = space.manifest()
    assert now.dimensions == 3 and len(now.wal) == 1 and len(client.files.list("first/wal")) == 1


def test_d6_same_millisecond_delete(client):
    space = client.create_namespace("same-ms")
    space.upsert([{"id": 1, "vector": [1.0]}], timestamp=100)
    space.compact(force=True)
    space.delete([1], timestamp=100)
    assert found(space, [1.0]) == []


def test_d7_masked_rows_do_not_use_up_the_limit(client):
    space = client.create_namespace("limits", metric=vectors.EUCLIDEAN)
    space.upsert([{"id": i, "vector": [float(i)]} for i in range(30)], timestamp=100)
    space.compact(force=True)
    space.delete(list(range(20)), timestamp=200)
    assert found(space, [0.0], 5) == ["20", "21", "22", "23", "24"]


def test_d20_late_older_upsert(client):
    space = client.create_namespace("late", metric=vectors.EUCLIDEAN)
    space.upsert([{"id": 1, "vector": [5.0]}], timestamp=100)
    space.compact(force=True)
    space.upsert([{"id": 1, "vector": [0.0]}], timestamp=50)
    assert space.get(1)["vector"] == [5.0]
    space.compact(force=True)
    assert space.get(1)["vector"] == [5.0]


def test_patches_across_compactions(client):
    space = client.create_namespace("patches")
    space.upsert(rows(20), timestamp=100)
    space.compact(force=True)
    space.patch([{"id": 3, "attributes": {"tag": "C"}}], timestamp=200)
    space.delete([4], timestamp=200)
    assert space.get(3)["attributes"] == {"tag": "C", "num": 3} and space.get(4) is None
    space.compact(force=True)
    assert space.get(3)["attributes"] == {"tag": "C", "num": 3} and space.get(4) is None
    assert found(space, [1.0, 0, 0, 0], filters={"tag": "C"}) == ["3"]


def test_snapshots_are_immutable_until_swept(client):
    space = client.create_namespace("snapshots")
    space.upsert(rows(10), timestamp=100)
    space.compact(force=True)
    old = space.rows()
    space.upsert(rows(10, start=50), timestamp=200)
    space.compact(force=True)
    assert old.count() == 10 and space.rows().count() == 20  # D9
    assert space.sweep() > 0 and space.rows().count() == 20
    assert space.sweep() == 0


def test_d5_racing_writers_lose_nothing(client):
    space = client.create_namespace("race")
    errors = []

    def write(k):
        try:
            space.upsert([{"id": k, "vector": [1.0, float(k)]}])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and space.rows().count() == 4
    assert [w.seq for w in space.manifest().wal] == [0, 1, 2, 3]


def test_compaction_takes_the_oldest_commits():
    wal = tuple(WalFile(i, f"w/{i}", 1, 40) for i in range(5))
    m = Manifest(wal=wal)
    assert [w.seq for w in log.batch(m, most_files=3, most_bytes=1000)] == [0, 1, 2]
    assert [w.seq for w in log.batch(m, most_files=5, most_bytes=90)] == [0, 1]
    assert [w.seq for w in log.batch(m, most_files=5, most_bytes=10)] == [0]
    assert len(log.batch(m, force=True, most_bytes=10)) == 5
    assert m.index_status == "updating" and m.unindexed_bytes == 200 and Manifest.from_json(m.to_json()) == m


def test_layers_equal_whole_compactions(client, monkeypatch):
    """Random writes into two namespaces, one compacted in layers and one written anew each time."""
    monkeypatch.setattr(plans, "EXACT_ROWS", 40)
    monkeypatch.setattr("tidemark.plans.compact.EXACT_ROWS", 40)
    client.config = replace(SMALL, layer_rows=40)
    layers, whole = client.create_namespace("layers", metric=vectors.EUCLIDEAN), client.create_namespace("whole", metric=vectors.EUCLIDEAN)
    rng, seen = np.random.default_rng(3), []
    for step in range(5):
        now = 100 * (step + 1)
        news = rows(160 if step == 0 else int(rng.integers(2, 9)), seed=step, start=0 if step == 0 else int(rng.integers(0, 180)))
        for space in (layers, whole):
            space.upsert(news, timestamp=now)
        if step:
            gone, changed = rng.choice(180, 3, replace=False).tolist(), rng.choice(180, 4, replace=False).tolist()
            for space in (layers, whole):
                space.delete(gone, timestamp=now + 1 if step % 2 else now - 150)  # also older than the row
                space.patch([{"id": i, "attributes": {"tag": "C", "extra": step}} for i in changed], timestamp=now + 2)
        before = layers.manifest()
        layers.compact(force=True)
        with monkeypatch.context() as patch:
            patch.setattr(client, "config", SMALL)
            whole.compact(force=True)
        now = layers.manifest()
        assert not whole.manifest().layers and Manifest.from_json(now.to_json()) == now
        seen.append(len(now.layers))
        if now.layers:
            assert now.snapshot == before.snapshot and before.snapshot not in now.retired
        assert layers.rows().count() == now.indexed_rows == whole.manifest().indexed_rows
        key = lambda s: sorted(map(str, s.rows().collect()))
        assert key(layers) == key(whole)
        if step < 3:
            continue
        assert found(layers, news[0]["vector"], exact=True) == found(whole, news[0]["vector"], exact=True)
        for filters in ({"tag": "B", "num": "3"}, {"tag": "C"}):
            assert found(layers, news[0]["vector"], 300, filters=filters) == found(whole, news[0]["vector"], 300, filters=filters)
        assert len(found(layers, news[0]["vector"], 20)) == 20
        assert layers.get(news[0]["id"]) == whole.get(news[0]["id"])
    assert seen[0] == 0 and max(seen) >= 1 and seen.count(0) < len(seen) - 1
    old = layers.manifest()
    layers.sweep()
    assert layers.manifest().retired == () and layers.rows().count() == old.indexed_rows


def test_layers_grow_geometrically():
    layers, sizes = (), []
    for n in range(200):
        older, newer, size = compact._tiers(Manifest(snapshot="s", indexed_rows=1_000_000, layers=layers), 10, AnnConfig())
        layers = (*older, Layer(str(n), size))
        sizes.append(len(layers))
        assert all(a.size > compact.TIER * b.size for a, b in zip(layers, layers[1:]))
    assert sum(x.size for x in layers) == 2000 and max(sizes) <= 7
    assert compact._tiers(Manifest(snapshot="s", indexed_rows=1_000_000), 250_000, AnnConfig())[0] is None


def test_conditions_reach_what_layers_hide(client, monkeypatch):
    monkeypatch.setattr(plans, "EXACT_ROWS", 40)
    monkeypatch.setattr("tidemark.plans.compact.EXACT_ROWS", 40)
    client.config = replace(SMALL, layer_rows=40)
    space = client.create_namespace("pushed", metric=vectors.EUCLIDEAN)
    space.upsert(rows(160), timestamp=100)
    space.compact(force=True)
    space.upsert(rows(5, seed=2), timestamp=200)
    space.compact(force=True)
    assert len(space.manifest().layers) == 1
    held = plans.read_snapshot(space.spark, client.files, space.manifest())
    plan = held.postings.where(F.col("posting_id").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [In(posting_id, [1,2])") + plan.count("In(posting_id, [1,2])]") >= 3  # snapshot, layer and mask
    plan = inverted.matching(held.inverted, {"tag": "A"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(key,") >= 3 and plan.count("EqualTo(field,") >= 3


def test_recall(client):
    space = client.create_namespace("recall")
    data = rows(300, dims=8, seed=4)
    space.upsert(data)
    space.compact(force=True)
    x = np.array([vectors.normalized(r["vector"]) for r in data])
    hits = 0
    for q in range(5):
        truth = np.argsort(1 - x @ x[q], kind="stable")[:10]
        hits += len(set(map(int, found(space, data[q]["vector"]))) & set(truth.tolist()))
    assert hits == 50  # small indexes are scanned whole


def test_recall_of_probed_postings(client, monkeypatch):
    client.config = AnnConfig(rounds=2)
    space = client.create_namespace("probed")
    data = rows(10_500, dims=16, seed=7)
    for i, r in enumerate(data):
        r["attributes"] = {"rare": "yes" if i % 800 == 0 else "no"}
    space.upsert(data)
    space.compact(force=True)
    m = space.manifest()
    assert m.indexed_rows > plans.EXACT_ROWS and 1 <= m.fanout(10) <= m.fanout(100) and m.fanout(1000) is None
    assert Manifest.from_json(m.to_json()) == m
    x = np.array([vectors.normalized(r["vector"]) for r in data])
    hits = 0
    for q in np.random.default_rng(8).normal(size=(30, 16)):  # none is a row
        truth = np.argsort(-(x @ q), kind="stable")[:10]
        hits += len(set(map(int, found(space, q.tolist()))) & set(truth.tolist()))
    assert hits >= 0.88 * 300  # 0.9 less the error of 30 queries
    monkeypatch.setattr(plans, "SELECTIVE_IDS", 0)  # so that the filter is answered from probed postings
    assert len(found(space, data[0]["vector"], filters={"rare": "yes"})) == 10
    space.delete([i for i in range(10_500) if i % 800 == 0 and i > 4000])
    assert len(found(space, data[0]["vector"], filters={"rare": "yes"})) == 6


def test_stream_equals_batch(client, spark, tmp_path):
    space, same = client.create_namespace("streamed"), client.create_namespace("batched")
    same.upsert(rows(30), timestamp=100)
    same.patch([{"id": 3, "attributes": {"tag": "Z"}}], timestamp=150)
    same.delete([4, 5], timestamp=200)
    feed = tmp_path / "feed"
    for w in same.manifest().wal:
        spark.read.parquet(client.files.path(w.key)).coalesce(1).write.mode("append").parquet(str(feed))
    records = read_records(spark, str(feed), max_files=1)
    ingest(records, space, str(tmp_path / "checkpoint"), interval=None).awaitTermination()
    key = lambda s: sorted((r["id"]["bytes"], r["timestamp"], str(r["attributes"])) for r in s.rows().collect())
    assert key(space) == key(same)
    ingest(records, space, str(tmp_path / "checkpoint"), interval=None).awaitTermination()  # nothing new
    assert len(space.manifest().wal) == 3


def test_batcher(client):
    space = client.create_namespace("batched")
    with space.batcher(max_rows=3, max_age_ms=60_000) as batch:
        batch.upsert([{"id": "a", "vector": [1.0, 0.0], "attributes": {"k": 1}}], timestamp=1)
        batch.patch([{"id": "a", "attributes": {"k": 2}}], timestamp=1)
        assert not space.manifest().wal
        batch.upsert([{"id": "b", "vector": [0.0, 1.0]}], timestamp=1)
        assert [w.records for w in space.manifest().wal] == [3] and not batch.held
        batch.delete(["b"], timestamp=1)
    assert [w.records for w in space.manifest().wal] == [3, 1]
    assert space.get("a")["attributes"] == {"k": 2} and space.get("b") is None
    aged = space.batcher(max_age_ms=0)
    aged.upsert([{"id": "c", "vector": [1.0, 1.0]}])
    sized = space.batcher(max_bytes=8, max_age_ms=60_000)
    sized.upsert([{"id": "d", "vector": [1.0, 1.0]}])
    assert len(space.manifest().wal) == 4 and aged.flush() == 0
    with pytest.raises(InvalidRequest):
        aged.upsert([{"id": "e"}])


def test_batches_of_a_stream_count_once(client, spark):
    space = client.create_namespace("numbered")
    rows = spark.createDataFrame([(0, "U", (b"x", 1), [1.0], None, 5)], log.schema(log.RECORD))
    assert [space.write_frame(rows, batch=("s", n)) for n in (0, 0, 1, 0)] == [1, 0, 1, 0]
    assert space.write_frame(rows, batch=("t", 0)) == 1 and len(space.manifest().wal) == 3
    assert space.metadata()["approx_row_count"] == 3 and Manifest.from_json(space.manifest().to_json()) == space.manifest()


def test_round_trips_and_manifest_cache(client):
    space = client.create_namespace("counted")
    before = client.round_trips()
    space.upsert([{"id": 1, "vector": [1.0]}])
    wrote = {k: v - before.get(k, 0) for k, v in client.round_trips().items()}
    assert wrote["put"] == 1 and wrote.get("get", 0) <= 1
    before = client.round_trips()
    for _ in range(3):
        space.manifest()
    assert client.round_trips().get("get", 0) - before.get("get", 0) <= 1


def test_lookup_reads_one_id(client, spark):
    space = client.create_namespace("looked")
    space.upsert([{"id": i, "vector": [float(i), 1.0]} for i in range(300)], timestamp=1)
    space.compact(force=True)
    space.delete([7], timestamp=2)
    space.patch([{"id": 8, "attributes": {"k": "v"}}], timestamp=2)
    assert space.get(7) is None and space.get(8)["attributes"] == {"k": "v"} and space.get(9)["id"] == "9" and space.get(1000) is None
    plan = plans.lookup(spark, client.files, space.manifest(), (9).to_bytes(8, "little"), 2)._jdf.queryExecution().toString()
    assert plan.count("EqualTo(id.bytes") >= 2  # pushed into the scans of the postings and of the log


def test_contains_and_count(client, spark):
    space = client.create_namespace("held")
    space.upsert([{"id": i, "vector": [float(i), 1.0]} for i in range(40)])
    space.compact(force=True)
    held = plans.read_snapshot(spark, client.files, space.manifest())
    wanted = spark.createDataFrame([((int(i).to_bytes(8, "little"), 2),) for i in (3, 39, 40)], "id struct<bytes:binary,id_type:tinyint>")
    assert sorted((int.from_bytes(r.id.bytes, "little"), r.held) for r in ann.contains(held.postings, wanted).collect()) == [(3, True), (39, True), (40, False)]
    assert ann.count(held.centroids) == 40


def test_each_split_has_its_own_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x), float(y)], p) for p in range(12) for k, (x, y) in enumerate(rng.normal((10 * p, 0), 1, (30, 2)), 100 * p)]
    postings = spark.createDataFrame(rows, "id long, vector array<float>, posting_id int").withColumn("posting_id", F.when((F.col("posting_id") == 1) & (F.col("id") % 2 == 0), 0).when((F.col("posting_id") == 10) & (F.col("id") % 2 == 0), 11).otherwise(F.col("posting_id")).cast("int"))
    config = AnnConfig(max_posting_size=200, min_posting_size=1, neighbor_fanout=1, gain=0.01)
    moves = ann.lire_moves(postings, ann.means(postings), [(1, 20), (9, 21)], config, vectors.EUCLIDEAN)
    assert {r.posting_id for r in moves.collect()} <= {0, 2, 8, 10}
    both = ann.lire_moves(postings, ann.means(postings), [(1,), (10,)], config, vectors.EUCLIDEAN).select("posting_id").distinct().collect()
    assert {r.posting_id for r in both} == {0, 11}


def test_repair_from_the_listing_of_the_log(client):
    space = client.create_namespace("broken")
    space.upsert(rows(20))
    space.compact(force=True)
    space.upsert(rows(5, seed=3, start=100))
    before = space.manifest()
    space.delete([100])
    space.upsert(rows(1, seed=4, start=101))
    want = sorted(map(str, space.rows().collect()))
    assert space.repair() == 0 and space.manifest().version == before.version + 2  # nothing is broken
    for version in (before.version + 1, before.version + 2):
        (client.files.files.root / space.manifests._key(version)).write_bytes(b"{")
    whole = client.files.files.root / "broken" / "wal"
    (whole / "cut0short").mkdir()
    again = Client(space.spark, str(client.files.files.root), SMALL)
    with pytest.raises(ManifestUnreadable):
        again.namespace("broken")
    from tidemark.client import Namespace

    broken = Namespace(again, "broken")
    assert broken.repair() == 2 and sorted(map(str, broken.rows().collect())) == want
    now = broken.manifest()
    assert now.version == before.version + 3 and [w.seq for w in now.wal] == [1, 2, 3] and now.next_seq == 4 and now.approx_rows == 26
    broken.upsert(rows(1, seed=5, start=200))
    broken.compact(force=True)
    assert broken.get(200) is not None and broken.get(100) is None
    (client.files.files.root / broken.manifests._key(broken.manifest().version)).write_bytes(b"")
    for w in now.wal:
        client.files.delete(w.key)
    with pytest.raises(ManifestUnreadable):  # what the readable version needs is gone
        Namespace(Client(space.spark, str(client.files.files.root), SMALL), "broken").repair()


def test_short_logs_merge_beside_the_base(client, spark, monkeypatch):
    space = client.create_namespace("beside")
    space.upsert(rows(60), timestamp=100)
    space.compact(force=True)
    space.upsert(rows(10, seed=5, start=50), timestamp=200)
    space.upsert(rows(3, seed=6, start=0), timestamp=50)  # older than the rows of the index
    space.delete([7, 59, 70], timestamp=300)
    space.patch([{"id": 8, "attributes": {"tag": "C"}}, {"id": 9, "attributes": {"tag": "D"}}], timestamp=90)
    space.patch([{"id": 10, "attributes": {"tag": "E"}}], timestamp=150)
    plan = space.rows()._jdf.queryExecution().toString()
    beside = sorted(map(str, space.rows().collect()))
    assert "BroadcastHashJoin" in plan and len(beside) == 58
    monkeypatch.setattr(merge, "BROADCAST_RECORDS", 0)
    assert beside == sorted(map(str, space.rows().collect()))


@pytest.mark.parametrize("records", [0, 100_000])
def test_probed_postings_and_a_log(client, monkeypatch, records):
    monkeypatch.setattr(plans, "EXACT_ROWS", 100)
    monkeypatch.setattr("tidemark.plans.compact.EXACT_ROWS", 100)
    monkeypatch.setattr(merge, "BROADCAST_RECORDS", records)
    space = client.create_namespace("probes", metric=vectors.EUCLIDEAN)
    data = [{"id": i, "vector": [float(i // 20 * 100 + i % 20), 0.0]} for i in range(400)]
    space.upsert(data, timestamp=100)
    space.compact(force=True)
    assert space.manifest().fanout(10) is not None
    space.upsert([{"id": 399, "vector": [0.25, 0.0]}], timestamp=50)  # older than its row in a posting far away
    space.upsert([{"id": 398, "vector": [0.5, 0.0]}], timestamp=200)
    space.delete([1], timestamp=200)
    assert found(space, [0.0, 0.0], 4) == ["0", "398", "2", "3"]


def test_ties_go_by_the_value_of_ids(client):
    space = client.create_namespace("ties", metric=vectors.EUCLIDEAN)
    for numbers in ([70_000, 256, 1], [300, 2, (1 << 64) - 1, 255]):
        space.upsert([{"id": i, "vector": [1.0, 2.0]} for i in numbers])
        space.compact(force=True)
    space.upsert([{"id": i, "vector": [1.0, 2.0]} for i in (512, 3, "b", "a")])
    assert found(space, [0.0, 0.0], 20) == ["a", "b", "1", "2", "3", "255", "256", "300", "512", "70000", str((1 << 64) - 1)]
    assert found(space, [0.0, 0.0], 6) == ["a", "b", "1", "2", "3", "255"]
