"""Queries over sources that are read in pages or that push messages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from storyline import catalog as C
from storyline.registry import query
from storyline.shared import shared_path
from storyline.sources import remote as R
from storyline.streaming import streams


@query("""SELECT sha256(url) AS id_hash, url AS link, CAST(min(1 + page_id // 50) AS INTEGER) AS page FROM pages WHERE url IS NOT NULL GROUP BY url""")
def listing_first_seen(spark, sf_dir):
    """The pages table served as a listing of 50 records a page, which moves by ten while it is read, so that its records are seen again on the next page."""
    path, n = shared_path(spark, "listing"), F.col("page_id")
    seen = F.when(n % 50 >= 40, F.array(1 + F.floor(n / 50), 2 + F.floor(n / 50))).otherwise(F.array(1 + F.floor(n / 50)))
    served = C.table(spark, sf_dir, "pages").select(F.explode(seen).alias("page"), n.alias("n"), F.sha2(F.col("url").cast("binary"), 256).alias("id_hash"), F.col("url").alias("link"))
    served.repartition("page").sortWithinPartitions("page", "n").drop("n").write.partitionBy("page").json(path)
    last = served.agg(F.max("page")).first()[0] or 0
    listing = R.read_listing(spark, R.FolderListing(path), "id_hash string, link string", pages=last + 3, pagesPerTask=10)
    return R.first_seen(listing, "id_hash").select("id_hash", "link", "page")


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def channel_backfill(spark, sf_dir):
    """The events as a channel that is joined with a backfill of 24 hours, each user and kind once."""
    newest = C.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    since = None if newest is None else (newest.replace(tzinfo=dt.timezone.utc) - dt.timedelta(hours=24)).timestamp()
    channel = R.TableChannel(f"{sf_dir}/events.parquet", "event_id", "ts", ("event_id", "user_id", "event_type"))
    stream = R.channel_stream(spark, channel, "event_id long, user_id long, event_type string", since)
    return streams.drain(streams.distinct_ever(stream.select("user_id", "event_type"), ["user_id", "event_type"]))
