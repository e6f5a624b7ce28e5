import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import same
from tidemark import catalog, catalog_storage  # noqa: F401
from tidemark.operators import topk
from tidemark.plans import compact
from tidemark.plans import query as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        same(df, catalog.ORACLES[name], FOLDER)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_topk_plan_has_no_exchange(spark):
    plan = catalog.QUERIES["knn_cosine_top10"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_maintenance_is_over_all_events(spark):
    n = sum(r["n"] for r in catalog.QUERIES["inverted_maintenance_whole"](spark, FOLDER).collect())
    ids = [r[0] for r in catalog.read(spark, FOLDER, "events").select("event_id").collect()]
    assert n == sum(i % 20 != 0 for i in ids) > len(ids) * 0.9


@pytest.mark.parametrize("name, k", [("knn_batch_top5_whole", 5), ("knn_batch_l2sq_top7_whole", 7)])
def test_batch_queries_grow_with_the_table(spark, monkeypatch, name, k):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)  # several blocks
    got = catalog.QUERIES[name](spark, FOLDER)
    asked = {r.id for r in catalog.embedded(spark, FOLDER).select("id").collect() if r.id % 50 == 0}
    assert {r.query_id for r in got.select("query_id").collect()} == asked and got.count() == k * len(asked)
    same(got, catalog.ORACLES[name], FOLDER)


def test_every_delete_masks(spark):
    log = [r for r in catalog.event_log(spark, FOLDER).select("wal_seq", "op", "id", "timestamp").collect()]
    half = max(r.wal_seq for r in log) * 19 // 20
    dead = {}
    for r in log:
        if r.op == "D" and r.wal_seq > half:
            dead[r.id] = max(dead.get(r.id, r.timestamp), r.timestamp)
    shown = catalog.QUERIES["mask_tombstones_whole"](spark, FOLDER).collect()
    assert dead and shown and all(r.id not in dead or dead[r.id] < r.timestamp for r in shown)
    both = {r.kind: r.n for r in catalog.QUERIES["touched_and_deleted_whole"](spark, FOLDER).collect()}
    assert both["touched"] == len({r.id for r in log if r.op in "UD"})


@pytest.fixture
def ring(tmp_path):
    """Events of 144 ids on the 12 lattice points that are 5 away from (10, 10): all distances tie, and neighbours in number lie apart."""
    points = [(x, y) for x in range(5, 16) for y in range(5, 16) if (x - 10) ** 2 + (y - 10) ** 2 == 25]
    rows = ", ".join(f"({97 * n + points[n % 12][0]}, {89 * n + points[n % 12][1]})" for n in range(144))
    duckdb.sql(f"copy (select event_id::bigint as event_id, timestamp '2024-01-01' + to_days((event_id // 97)::int) as ts, user_id::bigint as user_id, 'view' as event_type from (values {rows}) t(event_id, user_id)) to '{tmp_path}/events.parquet' (format parquet)")
    return str(tmp_path)


@pytest.fixture
def probing(monkeypatch):
    """Small indexes are probed too, with few postings."""
    monkeypatch.setattr(plans, "EXACT_ROWS", 0)
    monkeypatch.setattr(plans, "SELECTIVE_IDS", 0)
    monkeypatch.setattr(compact, "EXACT_ROWS", 0)
    monkeypatch.setattr(compact, "measured_fanouts", lambda *_: ((10, 1),))


def test_search_breaks_ties_by_the_value_of_ids(spark, ring):
    same(catalog.QUERIES["store_search"](spark, ring), catalog.ORACLES["store_search"], ring)


def test_search_is_whole_where_indexes_are_probed(spark, ring, probing):
    same(catalog.QUERIES["store_search"](spark, ring), catalog.ORACLES["store_search"], ring)


def test_filtered_search_breaks_ties_by_the_value_of_ids(spark, ring):
    same(catalog.QUERIES["store_search_filtered_log"](spark, ring), catalog.ORACLES["store_search_filtered_log"], ring)


def test_filtered_search_is_whole_where_indexes_are_probed(spark, ring, probing):
    same(catalog.QUERIES["store_search_filtered_log"](spark, ring), catalog.ORACLES["store_search_filtered_log"], ring)
