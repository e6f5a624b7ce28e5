"""Every registered query of the engine with its SQL equivalent.

``events`` serve as a log: ``id = user_id``, ``seq = event_id``; signups and views are upserts, clicks and
purchases patches, errors deletes.  Timestamps are moved by ``event_id % 7`` days, so that log order and time
order differ and a latest-per-key shortcut would fail.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import attrs, ids, names, vectors
from tidemark.operators import ann, inverted, merge, replay, stats, topk
from tidemark.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in embedded(spark, sf_dir).where(F.col("id") == vec_id).select("vector").first()[0]]


# exact nearest neighbours

_NEAREST = """
with q as (select embedding::double[] as q from embeddings where vec_id = 0)
select vec_id as id, {dist} as dist from embeddings, q {where} order by dist, vec_id limit 10
"""
_COSINE = "1 - list_dot_product(embedding::double[], q)"
_EUCLIDEAN = "list_reduce(list_transform(list_zip(embedding::double[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)"


@register(_NEAREST.format(dist=_COSINE, where=""))
def knn_cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(embedded(spark, sf_dir), query_vector(spark, sf_dir), 10).select("id", "dist")


@register(_NEAREST.format(dist=_EUCLIDEAN, where=""))
def knn_l2sq_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(embedded(spark, sf_dir), query_vector(spark, sf_dir), 10, vectors.EUCLIDEAN).select("id", "dist")


@register("""
with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
d as (select query_id, vec_id as id, 1 - list_dot_product(embedding::double[], q) as dist from embeddings, q)
select query_id, id, dist, rank from (
    select *, cast(row_number() over (partition by query_id order by dist, id) as integer) as rank from d
) where rank <= 5
""")
def knn_batch_top5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row whose id is divisible by 50."""
    rows = embedded(spark, sf_dir)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return topk.batch_topk(rows, queries, 5)


@register(f"""
with q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
d as (select query_id, vec_id as id, {_EUCLIDEAN} as dist from embeddings, q)
select query_id, id, dist, rank from (
    select *, cast(row_number() over (partition by query_id order by dist, id) as integer) as rank from d
) where rank <= 7
""")
def knn_batch_l2sq_top7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row whose id is divisible by 50."""
    rows = embedded(spark, sf_dir)
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return topk.batch_topk(rows, queries, 7, vectors.EUCLIDEAN)


@register(_NEAREST.format(dist=_COSINE, where="where label = 3"))
def knn_filtered_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    index = inverted.build(rows.select("id", attrs.keyed(rows, ["label"]).alias("attributes")))
    allowed = inverted.matching(index, {"label": "3"})
    return topk.topk(rows.join(allowed, "id", "left_semi"), query_vector(spark, sf_dir), 10).select("id", "dist")


@register(_NEAREST.format(dist=_COSINE, where="where label = 99"))
def knn_filtered_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    index = inverted.build(rows.select("id", attrs.keyed(rows, ["label"]).alias("attributes")))
    return topk.topk(rows.join(inverted.matching(index, {"label": "99"}), "id", "left_semi"), query_vector(spark, sf_dir), 10).select("id", "dist")


@register("select vec_id as id, label from embeddings where vec_id = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).where("id = 17").select("id", "label")


# vector functions


@register("""
with v as (select vec_id as id, list_transform(embedding::double[], lambda x: x * (vec_id % 5)) as v from embeddings),
n as (select id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) as norm from v)
select id, norm, case when norm <= 1e-6 then 0.0 else v[1] / norm end as first, case when norm <= 1e-6 then 0.0 else v[64] / norm end as last from n
""")
def vector_normalize_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = embedded(spark, sf_dir).withColumn("v", F.transform(vectors.wide(F.col("vector")), lambda x: x * (F.col("id") % 5)))
    return scaled.select("id", vectors.norm(F.col("v")).alias("norm"), F.element_at(vectors.normalize(F.col("v")), 1).alias("first"), F.element_at(vectors.normalize(F.col("v")), 64).alias("last"))


@register("""
select a.vec_id as id, 1 - list_dot_product(a.embedding::double[], b.embedding::double[]) as cosine,
    list_reduce(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y) as euclidean
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedded(spark, sf_dir)
    both = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other")), "id")
    return both.select("id", vectors.distance(vectors.COSINE, F.col("vector"), F.col("other")).alias("cosine"), vectors.distance(vectors.EUCLIDEAN, F.col("vector"), F.col("other")).alias("euclidean"))


@register("select cast(len(embedding) as integer) as dims, count(*) as n, count(*) filter (len(embedding) <> 64) as wrong from embeddings group by 1")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size("vector")
    return embedded(spark, sf_dir).groupBy(size.alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if(size != 64).alias("wrong"))


# inverted index

_EVENT_FIELDS = ["event_type", "user_id"]


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), attrs.keyed(events, _EVENT_FIELDS).alias("attributes"))


@register("""
select 'event_type' as field, event_type as key, count(*) as n from events group by event_type
union all select 'user_id', cast(user_id as varchar), count(*) from events group by user_id
""")
def inverted_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.postings(inverted.build(event_rows(spark, sf_dir)))


@register("select 'event_type' as field, event_type as key, count(*) as n from events group by event_type")
def inverted_subset_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.postings(inverted.build(event_rows(spark, sf_dir), ["event_type"]))


@register("select event_id as id from events where event_type = 'click' intersect select event_id from events where user_id = 7")
def inverted_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.matching(inverted.build(event_rows(spark, sf_dir)), {"event_type": "click", "user_id": "7"})


@register("select event_id as id from events where false")
def inverted_filter_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.matching(inverted.build(event_rows(spark, sf_dir)), {"event_type": "click", "nothing": "1"})


@register("""
with kept as (select event_id, event_type as key from events where event_id % 10 <> 0),
new as (select event_id, event_type || '!' as key from events where event_id % 10 = 0 and event_id % 20 <> 0)
select 'event_type' as field, key, count(*) as n from (select * from kept union all select * from new) group by key
""")
def inverted_maintenance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all events; ``event_id`` only chooses which rows are touched and which of them live."""
    events = read(spark, sf_dir, "events")
    base = inverted.build(events.select(F.col("event_id").alias("id"), attrs.keyed(events, ["event_type"]).alias("attributes")))
    touched = events.where("event_id % 10 = 0").withColumn("event_type", F.concat("event_type", F.lit("!")))
    live = touched.where("event_id % 20 <> 0")
    live = live.select(F.col("event_id").alias("id"), attrs.keyed(live, ["event_type"]).alias("attributes"))
    return inverted.postings(inverted.maintain(base, touched.select(F.col("event_id").alias("id")), live))


# log replay

_LOG = """
log as (
    select event_id as seq, user_id as id, epoch_us(ts) // 1000 - (event_id % 7) * 86400000 as ts,
        case event_type when 'error' then 'D' when 'signup' then 'U' when 'view' then 'U' else 'P' end as op
    from events
)"""
_FOLD = f"""
with {_LOG},
records as (
    select id, list({{op: op, ts: ts, seq: seq, row_ts: null::bigint, src: null::bigint, pat: null::bigint, del_ts: null::bigint, pend_ts: null::bigint, pend: null::bigint}} order by seq) as rs
    from log group by id
),
folded as (
    select id, list_reduce(rs, lambda a, r: case
        when r.op = 'U' and not coalesce(a.del_ts > r.ts, false) and not coalesce(a.row_ts > r.ts, false)
            then {{op: r.op, ts: r.ts, seq: r.seq, row_ts: r.ts, src: r.seq, pat: null::bigint, del_ts: a.del_ts, pend_ts: a.pend_ts, pend: a.pend}}
        when r.op = 'D'
            then {{op: r.op, ts: r.ts, seq: r.seq,
                row_ts: case when not coalesce(r.ts >= a.row_ts, false) then a.row_ts end, src: case when not coalesce(r.ts >= a.row_ts, false) then a.src end,
                pat: case when not coalesce(r.ts >= a.row_ts, false) then a.pat end, del_ts: greatest(coalesce(a.del_ts, r.ts), r.ts),
                pend_ts: case when not coalesce(r.ts >= a.pend_ts, false) then a.pend_ts end, pend: case when not coalesce(r.ts >= a.pend_ts, false) then a.pend end}}
        when r.op = 'P' and not coalesce(a.del_ts > r.ts, false) and a.row_ts is not null and r.ts >= a.row_ts
            then {{op: r.op, ts: r.ts, seq: r.seq, row_ts: r.ts, src: a.src, pat: r.seq, del_ts: a.del_ts, pend_ts: a.pend_ts, pend: a.pend}}
        when r.op = 'P' and not coalesce(a.del_ts > r.ts, false) and a.row_ts is null and not coalesce(a.pend_ts > r.ts, false)
            then {{op: r.op, ts: r.ts, seq: r.seq, row_ts: a.row_ts, src: a.src, pat: a.pat, del_ts: a.del_ts, pend_ts: r.ts, pend: r.seq}}
        else a end,
        {{op: '', ts: 0::bigint, seq: 0::bigint, row_ts: null::bigint, src: null::bigint, pat: null::bigint, del_ts: null::bigint, pend_ts: null::bigint, pend: null::bigint}}) as s
    from records
),
state as (
    select id, s.del_ts as del_ts, case when s.pend_ts >= s.row_ts then s.pend_ts else s.row_ts end as timestamp, s.src as src,
        case when s.pend_ts >= s.row_ts then s.pend else s.pat end as pat,
        case when s.row_ts is null then s.pend_ts end as pend_ts, case when s.row_ts is null then s.pend end as pend
    from folded
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log; an upsert notes its number as ``src``, a patch as ``pat``."""
    events = read(spark, sf_dir, "events")
    millis = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type").isin("signup", "view"), "U").otherwise("P")
    seq = F.col("event_id").cast("string")
    field = F.when(op == "U", F.create_map(F.lit("src"), seq)).when(op == "P", F.create_map(F.lit("pat"), seq))
    return events.select(F.col("event_id").alias("wal_seq"), F.lit(0).alias("offset"), op.alias("op"), F.col("user_id").alias("id"), (millis - F.col("event_id") % 7 * 86400000).alias("timestamp"), field.alias("attributes"))


def _noted(name: str, column: str = "attributes") -> Column:
    return F.coalesce(F.col(column).getItem(name).cast("long"), F.lit(-1).cast("long"))


@register(_FOLD + " select id, timestamp, src, coalesce(pat, -1) as pat from state where timestamp is not null")
def replay_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.live(replay.replay(event_log(spark, sf_dir))).select("id", "timestamp", _noted("src").alias("src"), _noted("pat").alias("pat"))


@register(_FOLD + " select id, timestamp, src, coalesce(pat, -1) as pat from state where timestamp is not null")
def replay_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.live(replay.replay_streamed(event_log(spark, sf_dir))).select("id", "timestamp", _noted("src").alias("src"), _noted("pat").alias("pat"))


@register(_FOLD + " select id, del_ts from state where del_ts is not null")
def replay_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.tombstones(replay.replay(event_log(spark, sf_dir)))


@register(_FOLD + " select id, pend_ts, pend as pat from state where pend_ts is not null")
def replay_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.pending(replay.replay(event_log(spark, sf_dir))).select("id", "pend_ts", _noted("pat", "pend").alias("pat"))


@register(f"""
with {_LOG}
select count(*) filter (op = 'U') as approx_row_count, count(*) filter (op = 'D') as deletes, count(*) filter (op = 'P') as patches,
    count(distinct id) as ids, min(ts) as first_ts, max(ts) as last_ts from log
""")
def metadata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.col("op")
    return event_log(spark, sf_dir).agg(F.count_if(op == "U").alias("approx_row_count"), F.count_if(op == "D").alias("deletes"), F.count_if(op == "P").alias("patches"), F.countDistinct("id").alias("ids"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@register(f"""
with {_LOG}
select seq as wal_seq, id, op from (select * from log order by seq desc limit 100)
""")
def wal_scan_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).orderBy(F.desc("wal_seq"), F.desc("offset")).limit(100).select("wal_seq", "id", "op")


def _kinds(log: DataFrame, upserts: str) -> DataFrame:
    live, dead = log.where(upserts).select("id"), log.where("op = 'D'").select("id")

    def n(kind: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    return n("touched", live.unionByName(dead).distinct()).unionByName(n("deleted", dead.distinct().join(live, "id", "left_anti"))).unionByName(n("both", dead.intersect(live)))


@register(f"""
with {_LOG},
live as (select distinct id from log where op = 'U'), dead as (select distinct id from log where op = 'D')
select 'touched' as kind, count(*) as n from (select id from live union select id from dead)
union all select 'deleted', count(*) from (select id from dead except select id from live)
union all select 'both', count(*) from (select id from dead intersect select id from live)
""")
def touched_and_deleted_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all upserts of the log."""
    return _kinds(event_log(spark, sf_dir), "op = 'U'")


# merge on read: the first half of the log is the base, the second the tail

_HALF = "(select max(event_id) // 2 from events)"
_BASE = f"""
with {_LOG},
base as (select id, ts as timestamp, seq as src from (select *, row_number() over (partition by id order by ts desc, seq desc) as rn from log where op = 'U' and seq <= {_HALF}) where rn = 1),
tail as (select id, ts as timestamp, seq as src from (select *, row_number() over (partition by id order by ts desc, seq desc) as rn from log where op = 'U' and seq > {_HALF}) where rn = 1),
dead as (select id, max(ts) as del_ts from log where op = 'D' and seq > {_HALF} and seq % 29 = 0 group by id),
late as (select id, ts as pend_ts, seq as pat from (select *, row_number() over (partition by id order by ts desc, seq desc) as rn from log where op = 'P' and seq > {_HALF}) where rn = 1)"""

#: With every delete of the tail, which is a twentieth of the log here: half of the log deletes nearly all rows of the base.
_WHOLE = _BASE.replace(" and seq % 29 = 0", "").replace(_HALF, "(select max(event_id) * 19 // 20 from events)")


def _halves(spark: SparkSession, sf_dir: str, deletes: str = "op = 'D' and wal_seq % 29 = 0", of: tuple[int, int] = (1, 2)) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    log = event_log(spark, sf_dir)
    half = log.agg(F.max("wal_seq")).first()[0] * of[0] // of[1]
    first, second = log.where(F.col("wal_seq") <= half), log.where(F.col("wal_seq") > half)

    def newest(df: DataFrame, op: str) -> DataFrame:
        return stats.latest(df.where(F.col("op") == op), "id", F.desc("timestamp"), F.desc("wal_seq")).select("id", "timestamp", "attributes")

    dead = second.where(deletes).groupBy("id").agg(F.max("timestamp").alias("del_ts"))
    late = newest(second, "P").select("id", F.col("timestamp").alias("pend_ts"), F.col("attributes").alias("pend"))
    return newest(first, "U"), newest(second, "U"), dead, late


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "timestamp", _noted("src").alias("src"), _noted("pat").alias("pat"))


@register(_BASE + " select id, timestamp, src, -1::bigint as pat from (select *, row_number() over (partition by id order by timestamp desc, o) as rn from (select *, 1 as o from base union all select *, 0 as o from tail)) where rn = 1")
def merge_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, tail, _, _ = _halves(spark, sf_dir)
    return _shown(merge.newest_wins(base, tail))


@register(_BASE + " select base.id, case when pend_ts >= timestamp then pend_ts else timestamp end as timestamp, src, case when pend_ts >= timestamp then pat else -1 end as pat from base left join late on late.id = base.id")
def overlay_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _, _, late = _halves(spark, sf_dir)
    return _shown(merge.overlay_patches(base, late))


@register(_WHOLE + " select id, timestamp, src, -1::bigint as pat from base where not exists (select 1 from dead where dead.id = base.id and del_ts >= timestamp)")
def mask_tombstones_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every delete of the tail."""
    base, _, dead, _ = _halves(spark, sf_dir, "op = 'D'", (19, 20))
    return _shown(merge.mask_tombstones(base, dead))


@register(_WHOLE + """
, b as (select base.id, case when pend_ts >= timestamp then pend_ts else timestamp end as timestamp, src, case when pend_ts >= timestamp then pat else -1 end as pat
    from base left join late on late.id = base.id where not exists (select 1 from dead where dead.id = base.id and del_ts >= base.timestamp)),
u as (select *, 1 as o from b union all select id, timestamp, src, -1, 0 from tail)
select id, timestamp, src, pat from (select *, row_number() over (partition by id order by timestamp desc, o) as rn from u) where rn = 1
""")
def merge_on_read_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every delete of the tail."""
    base, tail, dead, late = _halves(spark, sf_dir, "op = 'D'", (19, 20))
    state = tail.join(dead, "id", "full_outer").join(late, "id", "full_outer")
    return _shown(merge.merge(base, state))


@register(_BASE + " select id, timestamp, src from tail")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_halves(spark, sf_dir)[1]).drop("pat")


# clusters: labels serve as postings

_MEANS = """
dims as (select label, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as dim from embeddings),
means as (select label, dim, avg(x) as mean from dims group by label, dim),
cents as (select label as posting_id, list(mean order by dim) as centroid from means group by label)"""


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).withColumn("posting_id", F.col("label").cast("int"))


@register(f"with {_MEANS} select label as posting_id, cast(dim as integer) as dim, round(mean, 9) as mean from means")
def centroids_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.means(_postings(spark, sf_dir)).select("posting_id", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 9))


@register(f"""
with {_MEANS},
d as (select vec_id as id, posting_id, 1 - list_dot_product(embedding::double[], centroid) as dist from embeddings, cents)
select id, posting_id, round(dist, 9) as dist from (select *, row_number() over (partition by id order by dist, posting_id) as rn from d) where rn = 1
""")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _postings(spark, sf_dir)
    return ann.assign(rows.drop("posting_id"), ann.means(rows)).select("id", "posting_id", F.round("posting_dist", 9).alias("dist"))


_PROBE = f"""
with {_MEANS},
q as (select embedding::double[] as q from embeddings where vec_id = 0),
near as (select posting_id from cents, q order by 1 - list_dot_product(centroid, q), posting_id limit 4),
found as (select vec_id as id, {_COSINE} as dist from embeddings, q where label in (select posting_id from near) order by dist, vec_id limit 10)"""


@register(_PROBE + " select id, dist from found")
def ann_probe_fanout4(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = _postings(spark, sf_dir)
    return ann.search(postings, ann.means(postings), query_vector(spark, sf_dir), 10).select("id", "dist")


@register(_PROBE + f""", truth as (select vec_id as id, {_COSINE} as dist from embeddings, q order by dist, vec_id limit 10)
select count(*) / 10.0 as recall from truth where id in (select id from found)""")
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, query = _postings(spark, sf_dir), query_vector(spark, sf_dir)
    found = ann.search(postings, ann.means(postings), query, 10).select(F.lit(0).alias("query_id"), "id")
    truth = topk.topk(postings, query, 10).select(F.lit(0).alias("query_id"), "id")
    return topk.recall(found, truth, 10)


@register("select cast(label as integer) as posting_id, count(*) as n from embeddings group by label")
def posting_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.posting_sizes(_postings(spark, sf_dir))


_LIRE = ann.AnnConfig(max_posting_size=400, min_posting_size=10, neighbor_fanout=3, gain=0.02)


@register(f"""
with {_MEANS},
n as (select label as posting_id, count(*) as n from embeddings group by label),
c as (select cents.*, n from cents join n using (posting_id)),
gap as (select c.posting_id, min(1 - list_dot_product(c.centroid, t.centroid)) as d from c, c t where t.posting_id in (0, 1) and c.posting_id not in (0, 1) group by c.posting_id),
nb as (select posting_id from gap order by d, posting_id limit 3),
options as (select * from c where posting_id in (0, 1) or posting_id in (select posting_id from nb)),
scored as (
    select vec_id as id, label as posting_id, o.posting_id as target, o.n as target_n, 1 - list_dot_product(embedding::double[], o.centroid) as d
    from embeddings, options o where label in (select posting_id from nb)
),
best as (select * from (select *, row_number() over (partition by id order by d, target) as rn from scored) where rn = 1),
own as (select id, d as cur from scored where target = posting_id)
select best.id, best.posting_id, best.target, round(cur, 9) as cur, round(best.d, 9) as tgt
from best join own using (id) join n on n.posting_id = best.posting_id
where best.target <> best.posting_id and case when cur <> 0 then (cur - best.d) / cur else 0 end >= 0.02 and target_n < 320 and n.n > 11
""")
def lire_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = _postings(spark, sf_dir)
    moves = ann.lire_moves(postings, ann.means(postings), [(0, 1)], _LIRE)
    return moves.select("id", "posting_id", "target", F.round("cur", 9).alias("cur"), F.round("tgt", 9).alias("tgt"))


@register()
def two_means_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors in two halves, seeded by its first and last vector."""

    def split(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = np.array(group["vector"].to_pylist(), np.float64)
        half = ann.two_means(x, seeds=(0, len(x) - 1))
        return pa.table({"posting_id": group["posting_id"], "id": group["id"], "half": pa.array(half.astype(np.int32))})

    return _postings(spark, sf_dir).select("posting_id", "id", "vector").groupBy("posting_id").applyInArrow(split, "posting_id int, id long, half int")


@register("select count(*) as rows, true as within from embeddings")
def ann_build_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A built index: no posting above its limit, and every row in one posting."""
    postings, _ = ann.build(embedded(spark, sf_dir).select("id", "vector"), ann.AnnConfig(max_posting_size=100), settle=settled)
    return ann.posting_sizes(postings).agg(F.sum("n").alias("rows"), (F.max("n") <= 100).alias("within"))


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, or one of our own in local mode, and read back; removed when the application ends."""
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.gettempdir()}/tidemark-index-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@register()
def ann_recall_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of a built index at the fan-out chosen for it: every row whose id is divisible by 50 against brute force."""
    postings, centroids = ann.build(embedded(spark, sf_dir).select("id", "vector"), settle=settled)
    queries = postings.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    places = settled(ann.neighbour_places(postings, centroids, queries, 10))
    fanout = ann.least_fanout(ann.recall_by_fanout(places, 10))
    found = F.count_if(F.col("place") <= fanout) / F.count(F.lit(1))
    return places.agg(F.countDistinct("query_id").alias("queries"), F.lit(centroids.count()).alias("postings"), F.lit(fanout).alias("fanout"), found.alias("recall"))


# reports, ids, attributes, names


@register("""
select event_type, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.95), 9) as p95, round(quantile_cont(value, 0.99), 9) as p99, round(avg(value), 9) as mean, max(value) as max
from events group by event_type
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(read(spark, sf_dir, "events"), "value", "event_type").withColumns({c: F.round(c, 9) for c in ("p50", "p95", "p99", "mean")})


@register("select o_orderpriority, round(sum(o_custkey) / sum(o_orderkey), 12) as per_second from orders group by o_orderpriority")
def throughput_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.throughput(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority").withColumn("per_second", F.round("per_second", 12))


@register("""
with f as (select o_custkey, o_orderkey, o_orderkey % 1000 * 1000 as size from orders),
w as (select *, cast(row_number() over o as integer) as pick, cast(sum(size) over (o rows unbounded preceding) as bigint) as running from f window o as (partition by o_custkey order by o_orderkey))
select * from w where pick <= 8 and (running <= 3000000 or pick = 1)
""")
def compaction_batch_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 1000 * 1000).alias("size"))
    return stats.batch_pick(files, "o_orderkey", "size", 8, 3_000_000, "o_custkey")


@register("""
with n as (select source as name from documents union all select url from pages union all select lang || '-' || source from documents
    union all select '-' || source from documents union all select lang from documents union all select lang || '--' || source from documents)
select name, length(name) between 3 and 63 and regexp_full_match(name, '[a-z0-9]([a-z0-9-]*[a-z0-9])?') and not contains(name, '--') as valid, count(*) as n from n group by name
""")
def namespace_names_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    lang, source = F.col("lang"), F.col("source")
    made = [source, F.concat(lang, F.lit("-"), source), F.concat(F.lit("-"), source), lang, F.concat(lang, F.lit("--"), source)]
    name = docs.select(F.explode(F.array(*made)).alias("name")).unionByName(pages.select(F.col("url").alias("name")))
    return name.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", names.valid(F.col("name")).alias("valid"), "n")


@register("select user_id as number, cast(user_id as varchar) as shown, cast(user_id as varchar) as text_shown from events group by user_id")
def id_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = read(spark, sf_dir, "events").select(F.col("user_id").alias("number")).distinct()
    return number.select("number", ids.display_column(ids.from_long(F.col("number"))).alias("shown"), ids.display_column(ids.from_string(F.col("number"))).alias("text_shown"))


@register("""
select event_id as id, event_type as type_key, '"' || event_type || '"' as type_json, cast(user_id as varchar) as user_key, case when event_id % 2 = 0 then 'true' else 'false' end as even_key from events
""")
def attribute_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("even", F.col("event_id") % 2 == 0)
    a = attrs.keyed(events, ["event_type", "user_id", "even"])
    rows = events.select(F.col("event_id").alias("id"), a.alias("a"))
    return rows.select("id", F.col("a.event_type.key").alias("type_key"), F.col("a.event_type.json").alias("type_json"), F.col("a.user_id.key").alias("user_key"), F.col("a.even.key").alias("even_key"))
