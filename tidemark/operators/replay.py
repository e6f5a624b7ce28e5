"""Log replay: folds each id's records, in log order, into a row, a tombstone and a pending patch.

The fold is not commutative (a patch raises its row's timestamp, which may reject a later upsert), so no
latest-per-key shortcut is right.  Ids with a moderate log fold inside Catalyst; where some id's log is too
long to hold as one array, records stream through a sorted partition instead, with one state in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.attrs import overlay

UPSERT, DELETE, PATCH = "U", "D", "P"
#: Records of one id that may be held as one array.
MAX_FOLDED = 50_000


def _state(row_ts: Column, row: Column, del_ts: Column, pend_ts: Column, pend: Column) -> Column:
    return F.struct(row_ts.alias("row_ts"), row.alias("row"), del_ts.alias("del_ts"), pend_ts.alias("pend_ts"), pend.alias("pend"))


def _after(ts: Column | None, other: Column) -> Column:
    """``ts`` is set and later."""
    return F.coalesce(ts > other, F.lit(False))


def _step(s: Column, r: Column, vector: bool) -> Column:
    ts, dead = r["timestamp"], _after(s["del_ts"], r["timestamp"])
    payload = F.struct(*([r["vector"].alias("vector")] if vector else []), r["attributes"].alias("attributes"))
    upserted = _state(ts, payload, s["del_ts"], s["pend_ts"], s["pend"])
    drops_row, drops_pend = F.coalesce(ts >= s["row_ts"], F.lit(False)), F.coalesce(ts >= s["pend_ts"], F.lit(False))
    deleted = _state(
        F.when(~drops_row, s["row_ts"]), F.when(~drops_row, s["row"]), F.greatest(s["del_ts"], ts), F.when(~drops_pend, s["pend_ts"]), F.when(~drops_pend, s["pend"])
    )
    merged = F.struct(*([s["row"]["vector"].alias("vector")] if vector else []), overlay(s["row"]["attributes"], r["attributes"]).alias("attributes"))
    patched = _state(ts, merged, s["del_ts"], s["pend_ts"], s["pend"])
    kept = _state(s["row_ts"], s["row"], s["del_ts"], ts, overlay(s["pend"], r["attributes"]))
    has_row = s["row_ts"].isNotNull()
    return (
        F.when(r["op"] == UPSERT, F.when(dead | _after(s["row_ts"], ts), s).otherwise(upserted))
        .when(r["op"] == DELETE, deleted)
        .when(dead, s)
        .when(has_row, F.when(ts >= s["row_ts"], patched).otherwise(s))
        .otherwise(F.when(_after(s["pend_ts"], ts), s).otherwise(kept))
    )


def _finish(s: Column, vector: bool) -> Column:
    both = s["row_ts"].isNotNull() & s["pend_ts"].isNotNull()
    apply = both & (s["pend_ts"] >= s["row_ts"])
    merged = F.struct(*([s["row"]["vector"].alias("vector")] if vector else []), overlay(s["row"]["attributes"], s["pend"]).alias("attributes"))
    return _state(F.when(apply, s["pend_ts"]).otherwise(s["row_ts"]), F.when(apply, merged).otherwise(s["row"]), s["del_ts"], F.when(~both, s["pend_ts"]), F.when(~both, s["pend"]))


def _schema(log: DataFrame) -> T.StructType:
    row = T.StructType([*([T.StructField("vector", log.schema["vector"].dataType)] if "vector" in log.columns else []), T.StructField("attributes", log.schema["attributes"].dataType)])
    return T.StructType([T.StructField("row_ts", T.LongType()), T.StructField("row", row), T.StructField("del_ts", T.LongType()), T.StructField("pend_ts", T.LongType()), T.StructField("pend", log.schema["attributes"].dataType)])


def replay(log: DataFrame, order: tuple[str, ...] = ("wal_seq", "offset"), max_folded: int | None = None) -> DataFrame:
    """``(id, timestamp, vector, attributes, del_ts, pend_ts, pend)``, one row for each id.

    ``log`` has ``op, id, timestamp, attributes``, the ``order`` columns and perhaps ``vector``.  A null
    ``timestamp`` in the result means that no row is live.  With ``max_folded`` the longest log is counted
    first, and a longer one is streamed.
    """
    if max_folded is not None and (longest := log.groupBy("id").count().agg(F.max("count")).first()[0]) and longest > max_folded:
        return replay_streamed(log, order)
    vector = "vector" in log.columns
    fields = [*order, "op", "timestamp", "attributes", *(["vector"] if vector else [])]
    shape = _schema(log).simpleString()

    def earlier(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for c in reversed(order):
            out = F.when(x[c] < y[c], -1).when(x[c] > y[c], 1).otherwise(out)
        return out

    records = F.array_sort(F.collect_list(F.struct(*fields)), earlier)
    folded = log.groupBy("id").agg(records.alias("records"))
    state = F.aggregate("records", _state(F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(None)).cast(shape), lambda s, r: _step(s, r, vector).cast(shape), lambda s: _finish(s, vector).cast(shape))
    out = folded.select("id", state.alias("s"))
    return out.select("id", F.col("s.row_ts").alias("timestamp"), *([F.col("s.row.vector").alias("vector")] if vector else []), F.col("s.row.attributes").alias("attributes"), "s.del_ts", "s.pend_ts", "s.pend")


class Fold:
    """The same rules, a record at a time; also the model that tests compare with."""

    def __init__(self) -> None:
        self.row_ts, self.row, self.del_ts, self.pend_ts, self.pend = None, None, None, None, None

    def apply(self, op: str, ts: int, attributes: dict | None, vector: object = None) -> None:
        if op == DELETE:
            self.del_ts = ts if self.del_ts is None else max(self.del_ts, ts)
            if self.row_ts is not None and ts >= self.row_ts:
                self.row_ts = self.row = None
            if self.pend_ts is not None and ts >= self.pend_ts:
                self.pend_ts = self.pend = None
        elif self.del_ts is not None and self.del_ts > ts:
            return
        elif op == UPSERT:
            if self.row_ts is None or ts >= self.row_ts:
                self.row_ts, self.row = ts, (vector, attributes)
        elif self.row_ts is not None:
            if ts >= self.row_ts:
                self.row_ts, self.row = ts, (self.row[0], {**(self.row[1] or {}), **(attributes or {})})
        elif self.pend_ts is None or ts >= self.pend_ts:
            self.pend_ts, self.pend = ts, {**(self.pend or {}), **(attributes or {})}

    def finish(self) -> tuple:
        """``(timestamp, vector, attributes, del_ts, pend_ts, pend)``"""
        if self.row_ts is not None and self.pend_ts is not None:
            if self.pend_ts >= self.row_ts:
                self.row_ts, self.row = self.pend_ts, (self.row[0], {**(self.row[1] or {}), **self.pend})
            self.pend_ts = self.pend = None
        vector, attributes = self.row or (None, None)
        return self.row_ts, vector, attributes, self.del_ts, self.pend_ts, self.pend


def replay_streamed(log: DataFrame, order: tuple[str, ...] = ("wal_seq", "offset")) -> DataFrame:
    """``replay`` over sorted partitions: memory holds one state, however long an id's log is."""
    vector = "vector" in log.columns
    shape = _schema(log)
    names = [f.name for f in shape["row"].dataType.fields]
    fields = [T.StructField("id", log.schema["id"].dataType), T.StructField("timestamp", T.LongType()), *(shape["row"].dataType[n] for n in names), *(shape[n] for n in ("del_ts", "pend_ts", "pend"))]
    rows = log.withColumn("id_key", F.to_json(F.struct("id"))).repartition("id").sortWithinPartitions("id_key", *order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, own, state = None, None, Fold()

        def done() -> dict:
            ts, vec, attributes, *rest = state.finish()
            return {"id": own, "timestamp": ts, **({"vector": vec} if vector else {}), "attributes": attributes, **dict(zip(("del_ts", "pend_ts", "pend"), rest, strict=True))}

        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                if r["id_key"] != open_key:
                    if open_key is not None:
                        out.append(done())
                    open_key, own, state = r["id_key"], r["id"], Fold()
                state.apply(r["op"], r["timestamp"], r["attributes"], r.get("vector"))
            if out:
                yield pd.DataFrame(out)
        if open_key is not None:
            yield pd.DataFrame([done()])

    return rows.mapInPandas(fold, T.StructType(fields))


def live(state: DataFrame) -> DataFrame:
    return state.where("timestamp is not null").drop("del_ts", "pend_ts", "pend")


def tombstones(state: DataFrame) -> DataFrame:
    return state.where("del_ts is not null").select("id", "del_ts")


def pending(state: DataFrame) -> DataFrame:
    return state.where("pend_ts is not null").select("id", "pend_ts", "pend")
