"""Queries over sources and sinks: a sweep of served pages, and reports as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfield.operators import documents, ingest, pool
from tallyfield.package import shared_folder
from tallyfield.plans import oracles as O
from tallyfield.plans.registry import _CLASS, _classified, query
from tallyfield.sources import adapters as A
from tallyfield.sources import entity_files, sweeps
from tallyfield.streaming import limits

#: Reviews on a page; pages of a filter at most and at least; reviews of each cohort that are enough; pages a micro-batch.
_ON_PAGE, _MOST, _LEAST, _QUOTA, _BATCH = 20, 6, 2, 4, 4
_FILTERS = ["R", "A"]
REASONS = ["heart_density", "blocked_term", "joke_review", "low_information"]


def _serve(spark, d, folder):
    """Pages of reviews by game and filter as files, which the transport answers from; the last one has no cursor."""
    facts = A.fact_reviews(spark, d).where(F.col("source_filter").isin(_FILTERS))
    place = F.row_number().over(Window.partitionBy("game", "source_filter").orderBy("created", "rid", "order")) - 1
    rows = facts.withColumn("place", place).withColumn("page", F.floor(F.col("place") / _ON_PAGE))
    review = F.struct(F.col("rid").cast("string").alias("recommendationid"), "voted_up", F.struct(F.col("minutes").alias("playtime_at_review")).alias("author"))
    pages = rows.groupBy("game", "source_filter", "page").agg(F.array_sort(F.collect_list(F.struct("place", review.alias("r")))).alias("rows"))
    last = pages.groupBy("game", "source_filter").agg(F.max("page").alias("last"))
    after = F.when(F.col("page") < F.col("last"), (F.col("page") + 1).cast("string"))
    body = F.to_json(F.struct(after.alias("cursor"), F.transform("rows", lambda x: x["r"]).alias("reviews")))
    name = F.concat_ws("-", F.col("game").cast("string"), "source_filter", F.concat(F.col("page").cast("string"), F.lit(".json")))
    entity_files.write_entities(pages.join(last, ["game", "source_filter"]).select(name.alias("name"), F.lit(0).alias("rank"), F.lit(0).alias("seq"), body.alias("piece")), folder)
    return f"{folder}/{entity_files.current_version(folder)[0]}"


_COUNTS = ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ("refund_window", "early", "mid", "veteran"))
_SUMS = ", ".join(f"sum({b}) OVER (PARTITION BY game ORDER BY page) AS {b}" for b in ("refund_window", "early", "mid", "veteran"))


def _read_until(rows: str, before: str) -> str:
    """The pages of a filter that a sweep reads: up to the first at which there is enough of every cohort."""
    enough = " AND ".join(f"s.{b} + coalesce(b.{b}, 0) >= {_QUOTA}" for b in ("refund_window", "early", "mid", "veteran"))
    return f"""(SELECT p.game, p.page FROM (SELECT DISTINCT game, page FROM {rows} WHERE page < {_MOST}) p LEFT JOIN (SELECT s.game, min(s.page) AS last FROM
      (SELECT game, page, {_SUMS} FROM (SELECT game, page, {", ".join(f"count(*) FILTER (bucket = '{b}' AND fresh) AS {b}" for b in ("refund_window", "early", "mid", "veteran"))} FROM {rows} GROUP BY 1, 2)) s LEFT JOIN {before} b ON b.game = s.game
      WHERE s.page + 1 >= {_LEAST} AND {enough} GROUP BY 1) e ON e.game = p.game WHERE p.page <= coalesce(last, {_MOST}))"""


@query(f"""WITH {O.FACT}, r AS (SELECT game, source_filter AS f, rid, bucket, row_number() OVER (PARTITION BY game, source_filter ORDER BY created, rid, {O.ORDER}) - 1 AS place FROM fact WHERE source_filter IN ('R', 'A')),
 a1 AS (SELECT *, place // {_ON_PAGE} AS page, row_number() OVER (PARTITION BY game, rid ORDER BY place) = 1 AS fresh FROM r WHERE f = 'R'), p1 AS {_read_until("a1", "(SELECT NULL AS game, 0 AS refund_window, 0 AS early, 0 AS mid, 0 AS veteran)")},
 s1 AS (SELECT a1.* FROM a1 JOIN p1 USING (game, page)), b1 AS (SELECT game, {_COUNTS} FROM s1 WHERE fresh GROUP BY 1),
 a2 AS (SELECT *, place // {_ON_PAGE} AS page, row_number() OVER (PARTITION BY game, rid ORDER BY place) = 1 AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.game = r.game AND s1.rid = r.rid) AS fresh FROM r WHERE f = 'A'),
 p2 AS {_read_until("a2", "b1")}, g AS (SELECT game, f, page, place, rid FROM s1 UNION ALL SELECT game, f, page, place, rid FROM a2 JOIN p2 USING (game, page))
 SELECT CAST(game AS VARCHAR) AS appid, f AS filter, CAST(page AS INTEGER) AS page, count(*) AS reviews, sha256(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY place)) AS ids_sha256, true AS cached, CAST(1 AS BIGINT) AS given FROM g GROUP BY 1, 2, 3""")
def swept_pages(spark, d):
    """A stream that sweeps every game in runs of a few pages each, and a replay of its cache that must not ask for any."""
    folder = f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}"
    appids = [str(r.game) for r in A.fact_reviews(spark, d).select("game").distinct().orderBy("game").collect()]
    served = _serve(spark, d, f"{folder}/served")
    rules = {"max_pages": _MOST, "min_pages": _LEAST, "quota": _QUOTA}
    for _ in range(_MOST * len(_FILTERS) // _BATCH):
        stream = sweeps.stream_sweep(spark, appids, _FILTERS, f"tallyfield.sources.sweeps:served?{served}", f"{folder}/cache", pages=_BATCH, **rules)
        given = limits.run_to_end(stream, "append", f"{folder}/run")
    replayed = sweeps.read_sweep(spark, appids, _FILTERS, f"tallyfield.sources.sweeps:served?{served}", f"{folder}/cache", mode="strict", **rules)
    body = F.from_json("payload", "reviews array<struct<recommendationid:string>>")["reviews"]
    times = given.groupBy("appid", "filter", "page").agg(F.count("*").alias("given"))
    pages = replayed.select("appid", "filter", "page", F.size(body).cast("long").alias("reviews"), F.sha2(F.array_join(body["recommendationid"], ","), 256).alias("ids_sha256"), "cached")
    return pages.join(times, ["appid", "filter", "page"], "left")


@query(f"""WITH {_CLASS}, d AS (SELECT coalesce(game, 'unknown') AS name, game, rid, bucket, reason, coalesce(text, '') AS text FROM c WHERE reason IS NOT NULL),
 g AS (SELECT name, game, reason, count(*) AS n, chr(10) || '## ' || reason || ' (' || count(*) || ')' || chr(10) || chr(10) || string_agg('[' || rid || '] ' || bucket || chr(10) || text || chr(10), '' ORDER BY rid) AS part FROM d GROUP BY 1, 2, 3)
 SELECT name || '.dropped.txt' AS name, sha256('# dropped reviews - ' || game || chr(10) || '# ' || CAST(sum(n) AS BIGINT) || ' reviews, by reason' || chr(10) || string_agg(part, '' ORDER BY list_position({REASONS}, reason))) AS content_sha256 FROM g GROUP BY 1, game""")
def dropped_reports(spark, d):
    folder = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    entity_files.write_entities(entity_files.dropped_pieces(_classified(spark, d), REASONS), folder)
    return entity_files.read_entities(spark, folder).select("name", F.sha2("content", 256).alias("content_sha256"))


#: Art addresses of a page: with and without a segment of its own, several of a title, with a query after them.
_ART = "html || ' src=\"https://cdn/store_item_assets/steam/apps/' || page_id % 40 || '/' || CASE WHEN page_id % 3 = 0 THEN '' ELSE {hash} || '/' END || 'capsule_231x87.jpg?t=' || page_id || '\" src=\"store_item_assets/steam/apps/' || page_id % 7 || '/' || {hash} || '/header.jpg\"'"


@query(f"""WITH a AS (SELECT page_id, {_ART.format(hash="substr(md5(url), 1, 8)")} AS html FROM pages), m AS (SELECT page_id, unnest(regexp_extract_all(html, 'store_item_assets/steam/apps/[0-9]+/[^"?]+')) AS m FROM a),
 p AS (SELECT page_id, split_part(m, '/', 4) AS appid, array_to_string(string_split(m, '/')[5:], '/') AS suffix FROM m)
 SELECT appid, arg_max(suffix, lpad(CAST(page_id AS VARCHAR), 12, '0') || suffix) AS suffix FROM p WHERE contains(suffix, '/') GROUP BY 1""")
def capsule_suffixes(spark, d):
    pages = A.table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    return ingest.capsules(pages.select("page_id", F.expr(_ART.format(hash="substr(md5(cast(url AS binary)), 1, 8)")).alias("html")))


@query(f"""WITH {O.RATES}, r AS (SELECT game, bucket, count(*) AS pool_n, count(*) FILTER (voted_up) AS up FROM fact WHERE source_filter = 'R' AND game % 2 = 1 GROUP BY 1, 2),
 f AS (SELECT game, bucket, pool_n, round(100e0 * pool_n / sum(pool_n) OVER (PARTITION BY game), 1) AS share_of_pool_pct, round(100e0 * up / pool_n, 1) AS pct_positive FROM r)
 SELECT * FROM f UNION ALL SELECT game, bucket, pool_n, share_of_pool_pct, pct_positive FROM rates WHERE game NOT IN (SELECT game FROM f)""")
def pool_preference(spark, d):
    """Rates of one sweep where a game has them, else those of its whole pool."""
    facts = A.fact_reviews(spark, d)
    return documents.prefer(pool.pool_rates(facts.where("source_filter = 'R' AND game % 2 = 1")), pool.pool_rates(facts), ["game"])
