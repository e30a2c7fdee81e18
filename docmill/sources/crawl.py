"""Breadth-first crawling; offline, the pages table is the web."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators.dedup import cut
from docmill.operators.graph import links_of


def explore(web: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(url, hops, found): pages within ``hops`` of the seeds; found is false for links that ``web`` (url, html) doesn't hold."""
    links = cut(links_of(web, "url", "html").select(F.col("url").alias("src"), F.regexp_replace("href", "#.*$", "").alias("dst")).distinct())
    seen = cut(seeds.select("url", F.lit(0).alias("hops")).distinct())
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(links, front["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        front = cut(nxt.join(seen, "url", "left_anti").withColumn("hops", F.lit(h)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    have = web.select("url").distinct().withColumn("found", F.lit(True))
    return seen.join(have, "url", "left").select("url", "hops", F.coalesce("found", F.lit(False)).alias("found"))
