"""Queries over ingestion and serving; importing this module registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyfield import config as C
from tallyfield.functions import rates as R
from tallyfield.functions import text as X
from tallyfield.operators import evals, filtering, ingest, ledger, pool, serving, sourcing, verdict
from tallyfield.package import cut, shared_folder
from tallyfield.plans import oracles as O
from tallyfield.plans.registry import BLOCKED, query
from tallyfield.sources import adapters as A
from tallyfield.sources.entity_files import read_entities, write_entities


def raw_pages(spark, d):
    """Raw pages of ten reviews each from lineitem: appid, filter, page, cursor, next_cursor, payload."""
    rows = A.table(spark, d, "lineitem")
    line = F.col("l_linenumber")
    review = F.struct(
        F.when(line < 7, (F.col("l_orderkey") * 10 + line).cast("string")).alias("recommendationid"),
        F.when(line != 2, F.concat(F.lit("text "), F.col("l_partkey").cast("string"))).alias("review"),
        (F.col("l_quantity") > 25).alias("voted_up"),
        F.struct(F.when(line != 3, ((F.col("l_quantity") - 1) * 150).cast("long")).alias("playtime_at_review"), (F.col("l_quantity") * 200).cast("long").alias("playtime_forever")).alias("author"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("timestamp_created"),
        F.format_string("%.2f", "l_discount").alias("weighted_vote_score"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_discount", "l_extendedprice", review.alias("r"))))
    pages = rows.groupBy("l_orderkey", F.lit("recent").alias("filter")).agg(ordered.alias("x"))
    body = F.struct(F.lit("next").alias("cursor"), F.transform("x", lambda v: v["r"]).alias("reviews"))
    return pages.select(F.col("l_orderkey").cast("string").alias("appid"), "filter", F.lit(0).alias("page"), F.lit("*").alias("cursor"), F.lit("next").alias("next_cursor"), F.to_json(body).alias("payload"))


_MIN = "CASE WHEN l_linenumber <> 3 THEN CAST((l_quantity - 1) * 150 AS BIGINT) ELSE 0 END"


@query(f"""SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS recommendationid, CASE WHEN l_linenumber <> 2 THEN 'text ' || l_partkey ELSE '' END AS review_text, l_quantity > 25 AS voted_up,
 round({_MIN} / 60e0, 1) AS hours_at_review, round(CAST(l_quantity * 200 AS BIGINT) / 60e0, 1) AS hours_total_now, {O.BUCKET.format(m=_MIN)} AS bucket, CAST(epoch(l_shipdate) AS BIGINT) AS created_ts, CAST(printf('%.2f', l_discount) AS DOUBLE) AS weighted_vote_score
 FROM lineitem WHERE l_linenumber < 7""")
def normalize_pages(spark, d):
    rows = ingest.normalize(raw_pages(spark, d))
    return rows.select("recommendationid", "review_text", "voted_up", "hours_at_review", "hours_total_now", "bucket", "created_ts", "weighted_vote_score")


@query("SELECT p_partkey AS appid, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS free FROM part")
def free_flags(spark, d):
    k = F.col("appid") % 4
    cell = F.when(k == 0, "<div>Free To Play</div>").when(k == 1, '<div data-x="9">2,999.00</div>').otherwise("<div></div>")
    final = F.when(k == 3, "499").otherwise("0")
    return A.catalog_entries(spark, d).select("appid", ingest.is_free(cell, final).alias("free"))


@query("""SELECT CASE WHEN p_size % 5 = 0 THEN 'not_an_app' WHEN p_size % 5 = 1 THEN 'no_tooltip' WHEN p_size % 5 = 2 THEN 'no_review_count' WHEN p_size % 5 = 3 AND p_partkey % 2 = 0 THEN 'empty_title' ELSE 'parsed' END AS outcome, count(*) AS n,
 CAST(sum(CASE WHEN p_size % 5 > 2 THEN CAST(trunc(p_retailprice) AS BIGINT) END) AS BIGINT) AS reviews FROM part GROUP BY 1""")
def store_accounting(spark, d):
    k = F.col("size") % 5
    key = F.when(k != 0, F.format_string('data-ds-itemkey="App_%d"', "appid")).otherwise('data-ds-itemkey="Sub_1"')
    tip = F.when(k > 2, F.format_string('data-tooltip-html="%,d user reviews"', "reviews")).when(k == 2, 'data-tooltip-html="No reviews"').otherwise(F.when(k == 0, 'data-tooltip-html="-"').otherwise(""))
    title = F.when((k == 3) & (F.col("appid") % 2 == 0), " ").otherwise(F.concat(F.col("title"), F.lit(" &amp; co")))
    chunk = F.concat_ws(" ", F.lit("<a"), key, tip, F.lit(">"), F.concat(F.lit('<span class="title">'), title, F.lit("</span>")))
    rows = ingest.store_titles(A.catalog_entries(spark, d).select(chunk.alias("chunk")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("reviews").alias("reviews"))


@query("SELECT p_partkey AS appid, p_size % 3 AS v FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 9 FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 = 0")
def merge_known(spark, d):
    rows = A.catalog_entries(spark, d)
    return ingest.merge_known(rows.where("appid % 3 = 0").select("appid", F.lit(9).alias("v")), rows.where("appid % 2 = 0").select("appid", (F.col("size") % 3).alias("v")))


@query("""SELECT c_custkey AS appid, CASE WHEN c_custkey % 3 = 0 THEN 'http://h/' || c_custkey WHEN c_custkey % 3 = 1 THEN 'http://c/' || c_custkey WHEN c_custkey % 5 = 0 THEN 'grid' ELSE 'legacy' END AS tile, CASE WHEN c_custkey % 3 = 0 THEN 'http://h/' || c_custkey ELSE 'legacy' END AS card FROM customer""")
def art_tiers(spark, d):
    key = F.col("c_custkey")
    at = lambda host, k: F.when(key % 3 == k, F.concat(F.lit(host), key.cast("string"))).otherwise("none")
    tile, card = serving.art(at("http://h/", 0), at("http://c/", 1), F.when(key % 5 == 0, "grid"), F.lit("legacy"))
    return A.table(spark, d, "customer").select(key.alias("appid"), tile.alias("tile"), card.alias("card"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'few_and_more_negative' WHEN 2 THEN 'few' WHEN 3 THEN 'more_negative' ELSE 'base' END AS note FROM customer""")
def sourcing_notes(spark, d):
    k = F.col("c_custkey") % 5
    none = F.array().cast("array<string>")
    triggers = F.when(k == 1, F.array(F.lit("thin"), F.lit("divergent"))).when(k == 2, F.array(F.lit("thin"))).when(k == 3, F.array(F.lit("divergent"))).when(k == 4, none)
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), serving.sourcing_note(triggers).alias("note"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS appid, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE '' END AS tagline, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS clauses, o_orderkey % 5 = 0 AS muted FROM orders")
def normalized_documents(spark, d):
    key = F.col("o_orderkey")
    header = F.struct(F.lit("Buy").alias("word"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("tagline"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("for_whom"), F.when(key % 2 == 0, F.array(F.lit("x"))).alias("for_you_if"))
    bar = F.array(F.struct(F.lit("mid").alias("bucket"), F.when(key % 5 == 0, True).alias("muted")))
    docs = serving.normalize_document(A.table(spark, d, "orders").select(key.alias("appid"), header.alias("header"), bar.alias("split_bar")))
    return docs.select("appid", "header.tagline", F.size("header.for_you_if").alias("clauses"), F.element_at("split_bar", 1)["muted"].alias("muted"))


_RUNS = """runs AS (SELECT event_id AS run, user_id AS appid, ts AS created, CASE WHEN event_id % 11 = 0 THEN 'in_progress' ELSE 'completed' END AS status,
 CASE WHEN event_type = 'error' THEN 'stage_failed' WHEN event_type = 'signup' THEN 'qr4_failed' ELSE 'published' END AS outcome, event_id % 2 = 0 AS started FROM events WHERE user_id % 3 = 0)"""


def _runs(spark, d):
    log = A.request_log(spark, d).where("key % 3 = 0")
    conclusion = F.when(F.col("ledger").isin("error", "signup"), "failure").otherwise("success")
    failed = F.when(F.col("ledger") == "signup", F.array(F.lit("qr4"))).otherwise(F.array(F.lit("extract")))
    return log.select(
        F.col("id").alias("run"), F.col("key").alias("appid"), F.col("ts").alias("created"), F.when(F.col("id") % 11 == 0, "in_progress").otherwise("completed").alias("status"),
        serving.run_outcome(F.lit("completed"), conclusion, failed).alias("outcome"), (F.col("id") % 2 == 0).alias("started"),
    )


@query(f"""WITH {_RUNS}, a AS (SELECT *, row_number() OVER (ORDER BY created, run) - 1 AS ahead FROM runs WHERE status <> 'completed'), m AS (SELECT appid, arg_min(ahead, (created, run)) AS ahead, arg_min(started, (created, run)) AS started FROM a GROUP BY 1),
 e AS (SELECT appid, arg_max(outcome, (created, run)) AS outcome FROM runs WHERE status = 'completed' GROUP BY 1), q AS (SELECT DISTINCT user_id AS appid FROM events),
 s AS (SELECT q.appid, m.ahead, CASE WHEN q.appid % 7 = 0 THEN 'published' WHEN m.appid IS NOT NULL THEN CASE WHEN m.started AND m.ahead = 0 THEN 'running' ELSE 'queued' END WHEN e.appid IS NOT NULL THEN CASE WHEN e.outcome <> 'published' THEN e.outcome ELSE 'queued' END
   WHEN q.appid > 90 THEN 'dispatch_lost' ELSE 'queued' END AS state FROM q LEFT JOIN m USING (appid) LEFT JOIN e USING (appid)) SELECT appid, state, CASE WHEN state = 'queued' THEN coalesce(ahead, 0) END AS ahead FROM s""")
def request_states(spark, d):
    keys = A.request_log(spark, d).select(F.col("key").alias("appid")).distinct()
    return serving.request_state(keys.withColumn("waited", F.col("appid")), keys.where("appid % 7 = 0"), _runs(spark, d))


@query(f"WITH {_RUNS} SELECT run, appid FROM runs WHERE status = 'completed' AND appid % 2 = 0 AND run % 5 <> 0 ORDER BY created, run LIMIT 5")
def unsettled_runs(spark, d):
    runs = _runs(spark, d)
    reserved, known = runs.where("appid % 2 = 0").select("appid").distinct(), runs.where("run % 5 = 0").select("appid", "run")
    return ledger.unsettled(runs, reserved, known).select("run", "appid")


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'completed' WHEN event_id % 5 = 1 THEN 'pending' WHEN event_id % 5 = 2 THEN 'failed' WHEN event_id % 5 = 3 THEN 'in_progress' ELSE 'pending' END AS status FROM events")
def step_status(spark, d):
    k = F.col("id") % 5
    conclusion = F.when(k == 0, "success").when(k == 1, "skipped").when(k == 2, "timed_out")
    return A.request_log(spark, d).select("id", serving.ui_status(F.when(k == 3, "in_progress").otherwise("queued"), conclusion).alias("status"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 600 < 55 THEN 'under a minute' WHEN event_id % 600 < 150 THEN 'a couple of minutes' WHEN event_id % 600 < 330 THEN 'a few minutes' ELSE 'around ' || CAST(round_even((event_id % 600) / 60e0, 0) AS INTEGER) || ' minutes' END AS copy,
 CASE WHEN event_id % 4 IN (1, 2) THEN CAST(event_id % 4 AS INTEGER) END AS cost FROM events""")
def wait_and_cost(spark, d):
    k = F.col("id") % 4
    cost = F.when(k == 3, "2.5").otherwise(k.cast("string"))
    return A.request_log(spark, d).select("id", serving.wait_copy((F.col("id") % 600).cast("int")).alias("copy"), serving.usable_cost(cost).alias("cost"))


@query("SELECT p_partkey AS appid, CASE WHEN p_partkey % 10 = 0 THEN 'own' WHEN p_size % 5 = 2 AND p_partkey % 2 = 1 THEN 'flash' ELSE 'flash-lite' END AS model FROM part")
def model_routing(spark, d):
    k = F.col("appid")
    model = serving.model_for(F.lit(2), F.col("size") % 5, F.when(k % 10 == 0, "own"), k % 2 == 0)
    return A.catalog_entries(spark, d).select("appid", model.alias("model"))


@query("""WITH r AS (SELECT p_partkey, p_name, trunc(p_retailprice) AS n, row_number() OVER (ORDER BY trunc(p_retailprice) DESC, p_partkey) AS rank FROM part WHERE trunc(p_retailprice) >= 70),
 b(shard, lo, hi) AS (VALUES ('core', '1000', 'null'), ('tail', '70', '999')), s AS (SELECT CASE WHEN n >= 1000 THEN 'core' ELSE 'tail' END AS shard, count(*) AS n, string_agg('["' || p_partkey || '","' || p_name || '"]', ',' ORDER BY rank) AS t FROM r GROUP BY 1)
 SELECT shard, coalesce(n, 0) AS n, sha256('{"v":1,"source":"part","min_reviews":' || lo || ',"max_reviews":' || hi || ',"order":"review count descending; the position is the rank","n":' || coalesce(n, 0) || ',"t":[' || coalesce(t, '') || ']}') AS payload_sha256 FROM b LEFT JOIN s USING (shard)""")
def search_shards(spark, d):
    """Both shards as files, read again."""
    from tallyfield.operators import catalog

    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    write_entities(serving.shard_pieces(cut(catalog.rank_entries(A.catalog_entries(spark, d))), "part"), folder)
    files = read_entities(spark, folder)
    return files.select(F.regexp_replace("name", ".json$", "").alias("shard"), F.get_json_object("content", "$.n").cast("long").alias("n"), F.sha2("content", 256).alias("payload_sha256"))


@query("""WITH c AS (SELECT 'fit_clause_too_long:' || lang || ':' || n_chars AS f FROM documents UNION ALL SELECT 'missing_tagline' FROM documents WHERE doc_id % 3 = 0) SELECT split_part(f, ':', 1) AS code, split_part(f, ':', 2) AS subject, count(*) AS n, count(*) FILTER (split_part(f, ':', 3) <> '') AS with_detail FROM c GROUP BY 1, 2""")
def failure_codes(spark, d):
    docs = A.table(spark, d, "documents")
    long = docs.select(F.concat_ws(":", F.lit("fit_clause_too_long"), "lang", F.col("n_chars").cast("string")).alias("failure"))
    return serving.failure_report(long.unionByName(docs.where("doc_id % 3 = 0").select(F.lit("missing_tagline").alias("failure"))))


@query("""WITH l AS (SELECT doc_id // 3 AS case_id, quality AS s FROM labels), a AS (SELECT case_id, max(s) AS x, min(s) AS y FROM l GROUP BY 1) SELECT count(*) AS n, round(100e0 * count(*) FILTER (x = y) / count(*), 1) AS agree_pct FROM a""")
def run_agreement(spark, d):
    rows = A.table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 3).alias("case_id")).agg(F.max("quality").alias("a"), F.min("quality").alias("b"))
    return evals.agreement(rows.select("case_id", F.col("a").alias("score")), rows.select("case_id", F.col("b").alias("score")))


@query("SELECT p_partkey AS appid FROM part WHERE p_partkey % 4 <> 0 AND NOT (p_partkey % 3 = 0 AND p_size % 2 = 0) ORDER BY p_partkey LIMIT 50")
def pending_titles(spark, d):
    rows = A.catalog_entries(spark, d)
    state = rows.where("appid % 3 = 0").select("appid", F.when(F.col("size") % 2 == 0, "thin_segmentation").otherwise("interrupted").alias("outcome"))
    return ledger.pending(rows.select("appid", F.col("appid").alias("place")), state, rows.where("appid % 4 = 0"), 50).select("appid")


@query(f"""WITH {O.RATES} SELECT DISTINCT r.game, r.bucket FROM rates r WHERE r.game % 4 = 1""")
def stored_drift(spark, d):
    rates = pool.pool_rates(A.fact_reviews(spark, d)).select("game", "bucket", "pct_positive")
    stored = rates.withColumn("pct_positive", F.when(F.col("game") % 4 == 1, F.col("pct_positive") + 0.1).otherwise(F.col("pct_positive")))
    return sourcing.drift(stored, rates, ["game", "bucket"])


@query(f"""WITH {O.classified(BLOCKED, ["idiot"])}, k AS (SELECT game, bucket, count(*) FILTER (reason IS NULL) AS kept, count(*) AS pool_n, count(*) FILTER (voted_up) AS up FROM c GROUP BY 1, 2),
 r AS (SELECT game, bucket, pool_n, kept < 20 AS muted, round(100e0 * up / pool_n, 1) AS pct FROM k), s AS (SELECT game, sum(pool_n) AS n, count(*) FILTER (kept >= 20) AS eligible, max(CASE WHEN bucket = 'veteran' THEN pool_n ELSE 0 END) AS v FROM k GROUP BY 1),
 m AS (SELECT game, round(sum(pct * pool_n) FILTER (f) / sum(pool_n) FILTER (f), 4) AS mean_pct FROM (SELECT *, bucket IN ('early', 'mid', 'veteran') AND pool_n >= 15 AND NOT muted AS f FROM r) GROUP BY 1),
 g AS (SELECT game, bool_or(regexp_matches(translate(lower(text), '013457@$', 'oieastas'), '{r"(?i)(^|[^\p{L}\p{N}_])(?:" + O._bodies(BLOCKED) + r")($|[^\p{L}\p{N}_])"}')) AS withheld FROM c WHERE reason IS NULL GROUP BY 1)
 SELECT m.game, mean_pct, {O.WORD} AS word, CASE WHEN eligible < 2 OR v / n > 0.6 THEN 'thin_segmentation' WHEN withheld THEN 'qr4_failed' ELSE 'ok' END AS outcome FROM m JOIN s USING (game) LEFT JOIN g USING (game)""")
def generate(spark, d):
    """The whole chain for every game at once: filter, pool rates with muted cohorts, verdict, gates."""
    rows = filtering.classify(A.text_reviews(spark, d), BLOCKED, ["idiot"])
    # one pass over the texts; what follows has a row for each game and cohort
    kept, hit = F.col("reason").isNull(), X.leet(F.coalesce("text", F.lit(""))).rlike(X.block_pattern(BLOCKED))
    cells = rows.groupBy("game", "bucket").agg(
        F.count("*").alias("pool_n"), R.count_where(F.col("voted_up")).alias("up"), R.count_where(kept).alias("kept"), R.count_where(kept & hit).alias("hits")
    )
    rate = R.percent(F.col("up"), F.col("pool_n")).alias("pct_positive")
    rates = cells.select("game", "bucket", "pool_n", rate, (F.col("kept") < C.MIN_SURVIVORS).alias("muted"), "hits")
    veterans = F.max(F.when(F.col("bucket") == "veteran", F.col("pool_n")).otherwise(0))
    sums = rates.groupBy("game").agg(F.sum("pool_n").alias("n"), F.sum((~F.col("muted")).cast("int")).alias("eligible"), veterans.alias("v"), (F.sum("hits") > 0).alias("withheld"))
    means = verdict.post_refund_mean(rates, 15)
    thin = (F.col("eligible") < C.MIN_ELIGIBLE) | (F.col("v") / F.col("n") > C.VETERAN_SHARE_MAX)
    outcome = F.when(thin, "thin_segmentation").when(F.col("withheld"), "qr4_failed").otherwise("ok")
    return means.join(sums, "game").select("game", "mean_pct", "word", outcome.alias("outcome"))
