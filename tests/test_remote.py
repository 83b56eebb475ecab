"""Listings in pages and channels of messages."""

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from storyline.sources import remote as R
from storyline.streaming import streams


def flaky(root, pages, failures=1):
    """Pages of three records that fail on a first try, as a file tells; made here so that tasks get the class itself."""

    class Flaky:
        def page(self, number):
            log = f"{root}/{number}"
            with open(log, "a") as f:
                f.write("x")
            with open(log) as f:
                tried = len(f.read())
            if number % 2 and tried <= failures:
                raise ConnectionError(number)
            return [{"id": f"{(number * 3 + k) // 2}", "title": f"p{number}", "other": 1} for k in range(3)] if number <= pages else []

    return Flaky()


def test_listing_is_read_whole(spark, tmp_path):
    df = R.read_listing(spark, flaky(str(tmp_path), 7), "id string, title string, missing string", pages=40, pagesPerTask=3, pause=0.01)
    got = sorted((r["page"], r["place"], r["id"], r["title"], r["missing"]) for r in df.collect())
    assert got == [(n, k, f"{(n * 3 + k) // 2}", f"p{n}", None) for n in range(1, 8) for k in range(3)]
    asked = {int(p.name) for p in tmp_path.iterdir()}
    # Each task stops at the first page without records.
    assert asked == {*range(1, 9), *range(10, 41, 3)}


def test_first_page_wins(spark, tmp_path):
    df = R.read_listing(spark, flaky(str(tmp_path), 4), "id string, title string", pages=6, pagesPerTask=2, pause=0.01)
    got = {r["id"]: r["page"] for r in R.first_seen(df, "id").collect()}
    want = {}
    for n in range(1, 5):
        for k in range(3):
            want.setdefault(f"{(n * 3 + k) // 2}", n)
    assert got == want


def test_listing_that_keeps_failing_fails(spark, tmp_path):
    with pytest.raises(Exception, match="ConnectionError"):
        R.read_listing(spark, flaky(str(tmp_path), 2, failures=99), "id string", pages=2, tries=2, pause=0.01).collect()


def test_folder_listing(tmp_path):
    (tmp_path / "page=1").mkdir()
    (tmp_path / "page=1" / "part-0.json").write_text("\n".join(json.dumps({"a": k}) for k in range(3)) + "\n")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        listing = R.FolderListing(root)
        assert listing.page(1) == [{"a": 0}, {"a": 1}, {"a": 2}] and listing.page(2) == []


def messages(folder, name, low, high):
    start = dt.datetime(2024, 1, 1)
    table = pa.table({"n": pa.array(range(low, high), pa.int64()), "at": pa.array([start + dt.timedelta(hours=k) for k in range(low, high)], pa.timestamp("us")), "body": [f"m{k}" for k in range(low, high)]})
    pq.write_table(table, folder / f"{name}.parquet", row_group_size=7)


def test_channel_goes_on_where_it_ended(spark, tmp_path):
    """A backfill of a day, then a restart with the same checkpoint: every message once."""
    (tmp_path / "log").mkdir()
    messages(tmp_path / "log", "a", 0, 50)
    seen = []

    def run():
        channel = R.TableChannel(str(tmp_path / "log"), "n", "at", ("n", "body"))
        since = dt.datetime(2024, 1, 2, 2, 30, tzinfo=dt.timezone.utc).timestamp()
        stream = R.channel_stream(spark, channel, "n long, body string", since, messagesPerTask=4)
        streams.apply_batches(stream, lambda df, number: seen.append((number, sorted(r["n"] for r in df.collect()))), str(tmp_path / "checkpoint")).awaitTermination()

    run()
    assert sorted(n for _, batch in seen for n in batch) == list(range(27, 50))
    run()
    messages(tmp_path / "log", "b", 50, 61)
    run()
    assert sorted(n for _, batch in seen for n in batch) == list(range(27, 61))


def test_channel_ends(tmp_path):
    messages(tmp_path, "a", 3, 20)
    channel = R.TableChannel(str(tmp_path), "n", "at", ("n",))
    late = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    assert channel.last() == 19 and channel.first_since(0.0) == 3 and channel.first_since(late) == 20
    assert [n for (n,) in channel.messages(5, 8)] == [5, 6, 7, 8]
