import itertools
import random

import pytest

from tidemark.operators import replay

LOG = "id long, wal_seq long, offset long, op string, timestamp long, vector array<float>, attributes map<string,string>"


def log_of(spark, records, id_=1):
    """records: (op, ts) or (op, ts, attributes)"""
    rows = [(id_, k, 0, r[0], r[1], [float(k)] if r[0] == "U" else None, r[2] if len(r) > 2 else None if r[0] == "D" else {}) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, LOG)


def state_of(spark, *records, f=replay.replay):
    found = f(log_of(spark, records)).collect()
    assert len(found) <= 1
    return found[0] if found else None


CASES = {
    "pending patch": ([("P", 200, {"a": "1"})], None, 200, None),
    "delete cancels patch": ([("P", 200, {"a": "1"}), ("D", 300)], None, None, 300),
    "patch before upsert": ([("P", 200, {"a": "2"}), ("U", 100, {"a": "1"})], (200, {"a": "2"}), None, None),
    "same time upsert patch": ([("U", 100, {"a": "1"}), ("P", 100, {"a": "2"})], (100, {"a": "2"}), None, None),
    "same time upsert delete": ([("U", 100), ("D", 100)], None, None, 100),
    "same time delete upsert": ([("D", 100), ("U", 100, {"b": "1"})], (100, {"b": "1"}), None, 100),
    "later upsert wins": ([("U", 1000, {"a": "1"}), ("U", 2000, {"a": "2"})], (2000, {"a": "2"}), None, None),
    "later upsert wins in either order": ([("U", 2000, {"a": "2"}), ("U", 1000, {"a": "1"})], (2000, {"a": "2"}), None, None),
    "delete after": ([("U", 1000), ("D", 2000)], None, None, 2000),
    "delete first in the log": ([("D", 2000), ("U", 1000)], None, None, 2000),
    "delete before insert": ([("D", 1000), ("U", 2000, {"a": "1"})], (2000, {"a": "1"}), None, 1000),
    "a patch raises the row's time": ([("U", 100, {"a": "1"}), ("P", 200, {"b": "2"}), ("U", 150, {"a": "3"})], (200, {"a": "1", "b": "2"}), None, None),
    "so order matters": ([("U", 100, {"a": "1"}), ("U", 150, {"a": "3"}), ("P", 200, {"b": "2"})], (200, {"a": "3", "b": "2"}), None, None),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("f", [replay.replay, replay.replay_streamed])
def test_case(spark, name, f):
    records, row, pend_ts, del_ts = CASES[name]
    s = state_of(spark, *records, f=f)
    assert (s.timestamp, s.attributes) == (row or (None, None))
    assert (s.pend_ts, s.del_ts) == (pend_ts, del_ts)


def test_empty_log(spark):
    assert replay.replay(log_of(spark, [])).count() == 0


def test_random_logs(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(1500):
        fold = replay.Fold()
        for k in range(rng.randint(1, 8)):
            op, ts = rng.choice("UUDPP"), rng.randint(1, 6)
            attributes = None if op == "D" else {rng.choice("abc"): str(k)}
            vector = [float(k)] if op == "U" else None
            rows.append((i, k, 0, op, ts, vector, attributes))
            fold.apply(op, ts, attributes, vector)
        want[i] = fold.finish()
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, LOG)
    for f in (replay.replay, replay.replay_streamed):
        got = {r.id: (r.timestamp, r.vector, r.attributes, r.del_ts, r.pend_ts, r.pend) for r in f(log).collect()}
        assert {k: tuple(list(x) if isinstance(x, (list, tuple)) else x for x in v) for k, v in got.items()} == want


def test_long_logs_stream(spark):
    log = log_of(spark, [("U", 1, {"a": "x"})] + [("P", k, {"n": str(k)}) for k in range(2, 40)])
    few, many = replay.replay(log, max_folded=1000).first(), replay.replay(log, max_folded=5).first()
    assert few.attributes == many.attributes == {"a": "x", "n": "39"}


def test_determinism(spark):
    records = [("U", 3, {"a": "1"}), ("P", 3, {"b": "1"}), ("D", 2), ("U", 3, {"c": "1"})]
    assert len({str(state_of(spark, *records)) for _ in range(3)}) == 1


def test_independent_of_file_order(spark):
    for order in itertools.permutations(range(3)):
        rows = [(1, k, 0, "U", 10 + k, [float(k)], {}) for k in range(3)]
        assert replay.replay(spark.createDataFrame([rows[i] for i in order], LOG)).first().timestamp == 12
