"""Replication and retention over related tables."""

import pytest
from pyspark.sql import functions as F

from storyline.operators import tables as G

GRAPH = (
    G.Table("note", ("event", "text"), refers={"event": "event"}, stamps=("at",), mode="insert"),
    G.Table("event", ("title", "owner"), "id", {"owner": "user"}, ("at", "changed")),
    G.Table("user", ("email",), "id", mode="fill"),
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def store(spark, users=(), events=(), notes=()):
    return {
        "user": spark.createDataFrame(list(users), "id long, email string, name string"),
        "event": spark.createDataFrame(list(events), "id long, title string, owner long, size int, at int, changed int"),
        "note": spark.createDataFrame(list(notes), "event long, text string, at int"),
    }


def test_order():
    assert [t.name for t in G.in_order(GRAPH)] == ["user", "event", "note"]
    with pytest.raises(ValueError, match="circle"):
        G.in_order([G.Table("a", ("x",), "id", {"b": "b"}), G.Table("b", ("x",), "id", {"a": "a"})])
    with pytest.raises(ValueError, match="unknown tables"):
        G.in_order([G.Table("a", ("x",), "id", {"b": "b"})])
    with pytest.raises(ValueError, match="mode"):
        G.Table("a", ("x",), mode="replace")


def test_replication_follows_ids(spark):
    source = store(
        spark, [(1, "a@x", "A"), (2, "b@x", "B"), (5, "b@x", "B2"), (3, None, "N")],
        [(10, "t", 1, 4, 1, None), (11, "t", 2, 5, 9, None), (12, "u", 5, 6, 1, 9), (13, "lost", 99, 1, 9, 9), (14, "free", None, 2, 9, None)],
        [(10, "old", 1), (11, "new", 9), (11, "new", 9), (12, "kept", 9), (77, "gone", 9)],
    )
    target = store(spark, [(100, "a@x", None), (101, "z@x", "Z")], [(50, "t", 100, 3, 0, None)], [(50, "old", 0)])
    once = G.replicate(GRAPH, source, target)
    users = {r["email"]: (r["id"], r["name"]) for r in once["user"].collect()}
    # Known users are filled, new ones move past the greatest id; of two rows of one key the lesser id counts.
    assert users == {"a@x": (100, "A"), "z@x": (101, "Z"), "b@x": (102, "B"), None: (103, "N")}
    events = {(r["title"], r["owner"]): (r["id"], r["size"]) for r in once["event"].collect()}
    assert events == {("t", 100): (50, 4), ("t", 102): (51, 5), ("u", 102): (52, 6), ("free", None): (54, 2)}
    # A reference without a row goes with it; notes that are there already stay as they are.
    assert rows(once["note"]) == [(50, "old", 0), (51, "new", 9), (52, "kept", 9)]
    again = G.replicate(GRAPH, source, once)
    assert all(rows(again[name]) == rows(once[name]) for name in once)


def test_replication_since_a_mark(spark):
    source = store(spark, [(1, "a@x", "A")], [(10, "t", 1, 4, 1, None), (11, "u", 1, 5, 3, None), (12, "v", 1, 6, 1, 4)], [(10, "n", 4), (11, "n", 4)])
    out = G.replicate(GRAPH, source, store(spark), {"event": F.lit(2), "note": F.lit(2)})
    assert sorted(r["title"] for r in out["event"].collect()) == ["u", "v"]
    # The first event was not copied, so its note has nothing to refer to.
    assert out["note"].count() == 1
    assert rows(G.marks(GRAPH, {**source, "event": source["event"].fillna(0)})) == [("event", 4), ("note", 4)]


def test_retention_holds_what_is_referred_to(spark, tmp_path):
    frames = store(spark, [(1, "a", ""), (2, "b", ""), (3, "c", "")], [(10, "t", 1, 0, 1, 1), (11, "u", 2, 0, 1, 1), (12, "v", None, 0, 5, 1)], [(10, "n", 9), (11, "o", 1), (None, "p", 9), (12, "q", None)])
    out = G.retain(GRAPH, frames, F.lit(5))
    part = lambda name, key: {r[key]: r["part"] for r in out[name].collect()}
    assert part("note", "text") == {"n": "hot", "o": "cold", "p": "hot", "q": "cold"}
    assert part("event", "id") == {10: "held", 11: "cold", 12: "hot"}
    assert part("user", "id") == {1: "held", 2: "cold", 3: "cold"}


def test_archive_by_day(spark, tmp_path):
    marked = spark.createDataFrame([(1, "2024-01-01 10:00:00", "cold"), (2, "2024-01-01 11:00:00", "hot"), (3, "2024-01-02 00:00:00", "cold"), (4, None, "cold")], "id int, at string, part string").withColumn("at", F.col("at").cast("timestamp"))
    for _ in range(2):
        G.archive(marked, "at", str(tmp_path / "cold"))
    got = spark.read.parquet(str(tmp_path / "cold"))
    assert sorted((r["id"], str(r["day"])) for r in got.collect()) == [(1, "2024-01-01"), (3, "2024-01-02"), (4, "none")]
