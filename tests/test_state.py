"""State transitions, clustering, sources and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.operators import clustering, graph, similarity
from storyline.operators import state as S
from storyline.sources import readers
from storyline.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, w int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "k int, v string, w int")
    once = S.upsert(old, new, ["k"], fill_only=("w",))
    assert rows(once) == rows(S.upsert(once, new, ["k"], fill_only=("w",))) == [(1, "a", None), (2, "b", 5), (3, "c", 1)]
    assert rows(S.upsert(old, new, ["k"])) == [(1, "a", None), (2, "b", 7), (3, "c", 1)]


def test_null_keys_match(spark):
    old = spark.createDataFrame([(None, 1, "x")], "u int, d int, v string")
    new = spark.createDataFrame([(None, 1, "y"), (None, 2, "z")], "u int, d int, v string")
    assert rows(S.insert_absent(old, new, ["u", "d"])) == [(None, 1, "x"), (None, 2, "z")]
    assert rows(S.upsert(old, new, ["u", "d"])) == [(None, 1, "y"), (None, 2, "z")]


def test_bank_and_replication(spark):
    bank = spark.createDataFrame([("a", "2025-01-01", 1), ("b", None, 1)], "id_hash string, data_publicacao string, n int")
    new = spark.createDataFrame([("a", "2025-01-01", 2), ("b", "2024-01-01", 2), (None, "2025", 2), ("c", None, 2)], "id_hash string, data_publicacao string, n int")
    assert [(r["id_hash"], r["n"]) for r in readers.update_bank(bank, new).orderBy("id_hash").collect()] == [("a", 1), ("b", 2), ("c", 2)]
    src = spark.createDataFrame([(1, "k1", 5), (2, "k2", 1)], "id int, key string, at int")
    dst = spark.createDataFrame([(9, "k1", 0)], "id int, key string, at int")
    assert rows(S.id_map(src, dst, ["key"], "id", "id")) == [(1, 9)]
    assert rows(S.replicate(src, dst, ["key"], F.lit(3), ("at",), fill_only=("id",))) == [(9, "k1", 5)]


def test_audit_marks_and_cascades(spark):
    state = spark.createDataFrame([(1, "P3"), (2, "P1")], "id int, p string")
    following, audit = S.audited_update(state, spark.createDataFrame([(1, "P2", "why")], "id int, value string, reason string"), "id", "p", F.lit("2025-01-01").cast("timestamp"))
    assert rows(following) == [(1, "P2"), (2, "P1")] and rows(audit.select("id", "old_value", "new_value", "reason")) == [(1, "P3", "P2", "why")]
    assert rows(S.mark(state, spark.createDataFrame([(2,), (2,)], "id int"), "id", "p", F.lit("X"))) == [(1, "P3"), (2, "X")]
    assert rows(S.cascade_delete(state, spark.createDataFrame([(1,)], "k int"), "id", "k")) == [(2, "P1")]
    assert rows(S.compact(state, F.col("id") == 1, empty=("p",))) == [(1, ""), (2, "P1")]
    assert rows(S.compact(state, F.col("id") == 1, null=("p",))) == [(1, None), (2, "P1")]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (1, 1)], "a long, b long")
    want = {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 1: 1}
    assert {r["id"]: r["component"] for r in clustering.components(edges).collect()} == want
    assert {r["id"]: r["component"] for r in clustering.components(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()} == want


def test_token_pairs_equal_all_pairs(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "alpha beta zeta", "omega", "omega", ""]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "id long, block string, text string")
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    assert {(r["a_id"], r["b_id"]) for r in similarity.token_pairs(df, ["block"], 0.7).collect()} == want


@pytest.mark.parametrize(("least", "part"), [(0.3, 16384), (0.6, 25), (0.85, 10), (1.0, 40)])
def test_token_pairs_of_many_sets_and_sizes(spark, monkeypatch, least, part):
    """Copies, near copies and sets of all sizes, in one part and in many; links and scores are those of all pairs."""
    monkeypatch.setattr(similarity, "PART", part)
    rng = np.random.default_rng(int(10 * least))
    sets = [rng.choice(400, int(n), replace=False) for n in rng.integers(1, 120, 30)]
    rows = []
    for s in sets:
        rows += [s, s] + [np.union1d(s[rng.random(len(s)) > drop], [500 + len(rows)]) for drop in (0.05, 0.2, 0.4)]
    texts = [" ".join(f"w{x}x" for x in s) for s in rows]
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0], t) for i, t in enumerate(texts)] + [(1000, None, texts[0]), (1001, None, texts[0])], "id long, block string, text string")
    want = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            x, y = set(texts[i].split()), set(texts[j].split())
            if (i % 7 == 0) == (j % 7 == 0) and len(x & y) / len(x | y) >= least:
                want[i, j] = len(x & y) / len(x | y)
    got = similarity.token_pairs(df, ["block"], least).collect()
    assert {(r["a_id"], r["b_id"]): r["score"] for r in got} == want and len(got) == len(want) >= 20


def test_token_pairs_write_no_candidates(spark):
    """Sets that share many tokens but are not alike meet in their tasks only: the one join is with the sizes of blocks."""
    texts = [" ".join([f"common{k}" for k in range(40)] + [f"own{i}x{k}" for k in range(40)]) for i in range(60)]
    df = spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "id long, block string, text string")
    pairs = similarity.token_pairs(df, ["block"], 0.6)
    assert pairs.count() == 0 and pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_entities_resolve_in_order(spark):
    entities = spark.createDataFrame([("e1", "Petrobras S.A.", "Petrobras S.A."), ("e2", "Acme Corp", "Acme Corporation"), ("e3", "Banana Republic", "Banana Republic")], "entity_id string, name string, canonical_name string")
    names = spark.createDataFrame([("petrobras",), ("acme corp",), ("Banana Republics",), ("unknown thing",)], "name string")
    assert {r["name"]: (r["entity_id"], r["step"]) for r in graph.resolve(names, entities).collect()} == {"petrobras": ("e1", 1), "acme corp": ("e2", 2), "Banana Republics": ("e3", 3)}


def test_readers(spark, tmp_path):
    recs = [{"id_hash": "h", "titulo": "T", "texto_completo": "  ", "link": "http://a.br/x", "fonte": "Folha", "data_publicacao": "2025-01-02T03:04:05", "tags": ["x"]}, {"titulo": None, "texto_completo": None}]
    (tmp_path / "a.json").write_text(json.dumps(recs))
    (tmp_path / "skip.txt").write_text("[]")
    out = readers.read_json_dump(spark, str(tmp_path)).collect()
    assert [(r["texto_bruto"], r["tipo_fonte"]) for r in out] == [("T", "brasil_online")] and json.loads(out[0]["metadados"])["id_hash"] == "h"
    assert readers.global_dump(spark, str(tmp_path)).count() == 2
    pages = tmp_path / "editions"
    pages.mkdir()
    (pages / "e.txt").write_text("Title one\nbody\f \fBalanço patrimonial e demonstração do resultado\fLast\n")
    assert [(r["page"], r["pages"], r["title"]) for r in readers.read_pages(spark, str(pages)).orderBy("page").collect()] == [(1, 4, "Title one"), (4, 4, "Last")]
    assert len(readers.read_files(spark, str(pages)).first()["file_hash"]) == 16


def test_streams_equal_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{d}/events.parquet")
    stream = lambda: streams.file_stream(spark, f"{d}/events.parque[t]", batch.schema)
    counts = streams.drain(streams.day_counts(stream()), "complete")
    assert rows(counts) == rows(batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).select("day", "event_type", "n"))
    once = streams.drain(streams.distinct_within(stream(), ["user_id"]))
    assert once.count() == batch.select("user_id").distinct().count()
    pending, sent = batch.select(F.col("event_id").alias("cluster_id")).limit(5), []
    send = lambda df: sent.append(df.count())
    assert streams.outbox(spark, str(tmp_path / "sent"), pending, send) == 5 and streams.outbox(spark, str(tmp_path / "sent"), pending, send) == 0 and sent == [5]


def test_stream_dedup_over_many_batches(spark, tmp_path):
    """More files than one trigger takes, out of order: the last files' rows are a month older, and keys come back after weeks."""
    import datetime as dt
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(215):
        at = dt.datetime(2024, 3, 1) - dt.timedelta(days=30 * (i >= 105)) + dt.timedelta(days=20 * (i >= 210))
        pq.write_table(pa.table({"event_id": pa.array([i, 1000 + i], pa.int64()), "ts": pa.array([at, at], pa.timestamp("us")), "user_id": pa.array([i, i % 3], pa.int64()), "event_type": ["a", None if i % 3 == 2 else "b"], "value": [1.0, 1.0], "props": ["{}", "{}"]}), folder / f"part-{i:03}.parquet")
        os.utime(folder / f"part-{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = entry.queries()["stream_dedup_48h"](spark, str(tmp_path))
    assert got.columns == ["user_id", "event_type"]
    assert rows(got) == rows(spark.read.parquet(str(folder)).select("user_id", "event_type").distinct())
