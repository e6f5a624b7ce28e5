import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.compare import same
from tests.llm.conftest import frame
from tidemark.llm import exact_dedup, secrets
from tidemark.llm.common import KeyFilter, bits_of

FOLDER = "/root/testdata/sf0.001"


def test_oracle(spark):
    same(exact_dedup.op6_exact_dedup(spark, FOLDER), exact_dedup.ORACLE, FOLDER)


def test_secret_oracle(spark):
    same(secrets.op8_secret_scan(spark, FOLDER), secrets.ORACLE, FOLDER)


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_odd_rows(spark, odd, odd_rows, nothing):
    assert Counter(map(tuple, exact_dedup.exact_dedup(odd).collect())) == expected(odd_rows)
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_colliding_digests_are_verified_by_bytes(odd, odd_rows):
    weak = lambda text: F.sha2(text, 256).substr(1, 1).cast("binary")
    assert Counter(map(tuple, exact_dedup.exact_dedup(odd, weak).collect())) == expected(odd_rows)


def test_runs_merge_in_any_order(spark, odd_rows):
    halves = [exact_dedup.flush(frame(spark, odd_rows[k::2])) for k in (0, 1)]
    first, second = (exact_dedup.compact([h], "min") for h in halves)
    merged = {(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.compact([first, second], "min").collect()}
    whole = {(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.compact([exact_dedup.flush(frame(spark, odd_rows))], "min").collect()}
    assert merged == whole


def test_filters(spark):
    keys = spark.range(0, 1000).select((F.col("id") * 7919).alias("k"))
    rows = spark.range(0, 200_000)
    f = KeyFilter(keys, "k")
    kept = {r[0] for r in f.keep(rows, F.col("id")).collect()}
    left = {r[0] for r in f.drop(rows, F.col("id")).collect()}
    assert not kept & left and len(kept) + len(left) == 200_000 and {i for i in range(0, 200_000, 7919)} <= kept and len(kept) < 10_000
    hashed = keys.select(F.xxhash64("k").alias("h"))
    bits = bits_of(hashed, "h")
    assert all(bits.holds(r[0]) for r in hashed.collect()) and sum(bits.holds(i * 2654435761) for i in range(10_000)) < 1000


def brute(text):
    text, out = text or "", []
    word = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key")) + ")"
    for k, (kind, pattern, group, least) in enumerate([("assign", rf"""({word}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8), ("access", "(AKIA[A-Z0-9]+)", 1, 16), ("hex", "([0-9a-f]+)", 1, 32)]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    out.sort()
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in out)
    return (*[sum(x[1] == k for x in out) for k in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined)


def test_secrets_against_brute_force(spark, odd, odd_rows, nothing):
    more = [(200 + k, t) for k, t in enumerate(["token=token: abcdefghijk", "pAsSwOrD:aaaaaaaaaaaa", "0" * 31 + " " + "a" * 33, "api_key='k1234567=secret=abcdefghij", "AKIA123 AKIA" + "Z" * 12, "-----BEGIN RSA PRIVATE KEY-----", "SecretK=12345678", "\U0001f600 token: abcdefgh"])]
    rows = odd_rows + more
    got = Counter(tuple(r)[:5] for r in secrets.secret_scan(frame(spark, rows)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect())
    assert got == Counter((i, *brute(t)[:4]) for i, t in rows)
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(frame(spark, more)).collect()}
    assert spans[205] == "pem:0:31" and spans[200] == brute(more[0][1])[4]
    assert secrets.secret_scan(nothing).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in secrets.op8_secret_scan(spark, FOLDER).collect()} == want


def test_ledger_scans_unseen_blobs_only(spark):
    old = frame(spark, [(1, "token=abcdefgh"), (2, "clean")])
    _, ledger = secrets.update_ledger(old, None, (1,))
    assert ledger.count() == 2
    new = frame(spark, [(3, "token=abcdefgh"), (4, "secret=12345678"), (5, "clean")])
    paths, grown = secrets.update_ledger(new, ledger, (1,))
    assert grown.count() == 3  # one blob was unseen
    assert {r.doc_id: r.n_assign for r in secrets.report(paths, grown).collect()} == {3: 1, 4: 1, 5: 0}
    _, both = secrets.update_ledger(new, grown, (1, 2))
    assert sorted(r.rule_version for r in both.collect()) == [1, 1, 1, 2, 2, 2]


def test_index_of_batches(spark, odd_rows):
    """Levels fill up and merge; a batch is answered through the filters, then by bytes."""
    earlier = [(i, t) for i, t in odd_rows if i is not None]
    index = exact_dedup.MergeIndex(fan_in=2)
    assert index.lookup(frame(spark, earlier), frame(spark, earlier)).count() == 0
    shape = []
    for k in range(5):
        index.add(frame(spark, earlier[k::5]))
        shape.append([len(level) for level in index.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    least = {}
    for i, t in earlier:
        least[t or ""] = min(i, least.get(t or "", i))
    batch = [(5000, odd_rows[5][1]), (5001, "nobody has this text"), (5002, None), *[(6000 + k, f"new {k}") for k in range(300)]]
    got = {tuple(r) for r in index.lookup(frame(spark, batch), frame(spark, earlier)).collect()}
    assert got == {(5000, least[odd_rows[5][1]]), (5002, least[""])}
    assert index.suspects(frame(spark, batch)).count() < 30  # the others meet no entry
    whole = {(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.compact([exact_dedup.flush(frame(spark, earlier))], "min").collect()}
    held = [t for t, _ in index.tables()]
    assert {(bytes(r.digest), r.keep_id, r.group_size) for r in exact_dedup.compact(held, "min").collect()} == whole


def test_index_verifies_bytes(spark):
    weak = lambda text: F.sha2(text, 256).substr(1, 1).cast("binary")
    index = exact_dedup.MergeIndex(weak)
    earlier = frame(spark, [(1, "one")])
    index.add(earlier)
    batch = [(k, f"text {k}") for k in range(100, 200)] + [(7, "one")]
    assert index.suspects(frame(spark, batch)).count() > 1
    assert [tuple(r) for r in index.lookup(frame(spark, batch), earlier).collect()] == [(7, 1)]


def test_ledger_kept_at_a_path(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = [(1, "token=abcdefgh"), (2, "clean"), (3, "-----BEGIN RSA PRIVATE KEY-----")]
    second = [(4, "token=abcdefgh"), (5, "secret=12345678"), (6, "clean"), (5, "secret=12345678")]
    rows = lambda df: {(r.doc_id, r.n_assign, r.spans) for r in df.collect()}
    assert rows(secrets.scan_into(frame(spark, first), path, (1,))) == {(1, 1, "assign:0:14"), (2, 0, ""), (3, 0, "")}
    size = lambda: sorted((r.rule_version, bytes(r.digest)) for r in spark.read.parquet(path).collect())
    before = size()
    assert len(before) == 3
    assert rows(secrets.scan_into(frame(spark, second), path, (1,))) == {(4, 1, "assign:0:14"), (5, 1, "assign:0:15"), (6, 0, "")}
    assert len(size()) == 4 and set(before) < set(size())  # one blob was new
    again = rows(secrets.scan_into(frame(spark, first), path, (1, 2)))
    assert again == {(1, 1, "assign:0:14"), (2, 0, ""), (3, 0, "pem:0:31")} and len(size()) == len(set(size())) == 7
