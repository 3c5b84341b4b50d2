"""Streams over several batches: the ledger's gaps and repeats, edges that wait, windows."""

import uuid

import pytest
from pyspark.errors import StreamingQueryException

from marlstone.streaming import events as E
from marlstone.streaming.expiry import expired
from marlstone.streaming.ledger import materialise
from marlstone.streaming.tables import read_stream


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def test_ledger_applies_gapless_runs_and_skips_what_it_knows(spark, tmp_path):
    at = str(tmp_path)
    put(spark, at, "ledger", [(1, "a"), (2, "b"), (2, "b")], "seq long, kind string")
    out = f"{at}/out"
    assert sorted(r["seq"] for r in materialise(read_stream(spark, at, "ledger"), out).collect()) == [1, 2]
    put(spark, at, "ledger", [(2, "b"), (3, "c")], "seq long, kind string")
    assert sorted((r["seq"], r["kind"]) for r in materialise(read_stream(spark, at, "ledger"), out).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    put(spark, at, "ledger", [(5, "e")], "seq long, kind string")
    with pytest.raises(StreamingQueryException, match="LedgerGap"):
        materialise(read_stream(spark, at, "ledger"), out)


def test_ledger_of_nothing(spark, tmp_path):
    put(spark, str(tmp_path), "ledger", [], "seq long, kind string")
    assert materialise(read_stream(spark, str(tmp_path), "ledger"), f"{tmp_path}/out").count() == 0


def test_edges_wait_for_their_endpoint(spark, tmp_path):
    at, out = str(tmp_path), f"{tmp_path}/{uuid.uuid4().hex}"
    put(spark, at, "edges", [("x", 1), ("y", 2)], "k string, n long")
    put(spark, at, "ends", [("z",)], "k string")
    assert E.pending_edges(read_stream(spark, at, "edges"), read_stream(spark, at, "ends"), "k", out).count() == 0
    put(spark, at, "ends", [("x",), ("x",)], "k string")
    found = E.pending_edges(read_stream(spark, at, "edges"), read_stream(spark, at, "ends"), "k", out).collect()
    assert [(r["k"], r["n"]) for r in found] == [("x", 1)]


HOUR = 3600


def ended(spark, at, out):
    from pyspark.sql import functions as F

    stream = read_stream(spark, at, "notes").withColumn("ts", F.timestamp_seconds("s"))
    return sorted((r.key, r.first_at.timestamp() - 1000 * HOUR, r.n, r.ended_at.timestamp() - 1000 * HOUR, r.reason) for r in expired(stream.select("key", "ts", "action"), 24 * HOUR, "1 hour", out).collect())


def test_items_expire_unless_renewed(spark, tmp_path):
    at, out, schema = str(tmp_path), f"{tmp_path}/out", "key long, s long, action string"
    hours = lambda *rows: [(k, int((h + 1000) * HOUR), a) for k, h, a in rows]
    put(spark, at, "notes", hours((1, 0, "note"), (2, 0, "note"), (3, 1, "note"), (4, 2, "note"), (5, 2, "note"), (3, 3, "promote"), (5, 4, "forget"), (6, 1, "promote"), (None, 1, "note"), (7, 1, None)), schema)
    assert ended(spark, at, out) == [(5, 2 * HOUR, 1, 4 * HOUR, "forgotten")]
    # a renewal in a later batch, from the checkpoint: key 2 lives on, keys 1 and 4 do not
    put(spark, at, "notes", hours((2, 20, "renew"), (9, 26, "note")), schema)
    put(spark, at, "notes", hours((9, 27, "renew")), schema)
    assert [r[0] for r in ended(spark, at, out) if r[4] == "expired"] == [1, 4]
    put(spark, at, "notes", hours((8, 200, "note"), (8, 230, "note"), (4, 0, "renew")), schema)
    got = ended(spark, at, out)
    assert [r for r in got if r[0] in (2, 4, 8, 9)] == [(2, 0, 2, 44 * HOUR, "expired"), (4, 2 * HOUR, 1, 26 * HOUR, "expired"), (8, 200 * HOUR, 1, 224 * HOUR, "expired"), (9, 26 * HOUR, 2, 51 * HOUR, "expired")]
    assert not [r for r in got if r[0] in (3, 6, 7, None)]
