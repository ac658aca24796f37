"""Registered queries of tables that change and of lookups: commits over several tables, what is asked and found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T, times
from quillspark.plans.catalogue import query
from quillspark.operators import waterfall
from quillspark.sources import shared, versions
from quillspark.streaming import lookups


@query("""WITH last AS (SELECT client_id, arg_max(op, seq * 10000000 + change_id) AS op, max(seq * 10000000 + change_id) AS ord,
  arg_max(coalesce(segment, '-'), seq * 10000000 + change_id) AS segment, arg_max(coalesce(city, '-'), seq * 10000000 + change_id) AS city FROM client_changes WHERE client_id IS NOT NULL GROUP BY 1),
 base AS (SELECT client_id, -1 AS ord, min(coalesce(segment, '-')) AS segment, min(coalesce(city, '-')) AS city FROM clients WHERE client_id IS NOT NULL GROUP BY 1)
 SELECT 'client' AS kind, client_id AS id, ord, segment, city FROM last WHERE op <> 'D'
 UNION ALL SELECT 'client', client_id, CAST(ord AS BIGINT), segment, city FROM base WHERE client_id NOT IN (SELECT client_id FROM last)
 UNION ALL SELECT 'run', CAST(ascii(op) AS BIGINT), count(*), op, '' FROM last GROUP BY op""")
def versioned_changes(t):
    """Clients loaded into a store, then a feed of changes and the log of its run in one commit; both tables as they are then."""
    named = [F.coalesce(c, F.lit("-")).alias(c) for c in ("segment", "city")]
    base = t.clients.where("client_id IS NOT NULL").select(F.col("client_id").alias("id"), *named).groupBy("id").agg(F.min("segment").alias("segment"), F.min("city").alias("city")).withColumn("ord", F.lit(-1).cast("bigint"))
    feed = t.client_changes.where("client_id IS NOT NULL").select(F.col("client_id").alias("id"), "op", (F.col("seq") * 10_000_000 + F.col("change_id")).alias("ord"), *named)
    last = feed.groupBy("id").agg(F.max_by(F.struct("op", "ord", "segment", "city"), "ord").alias("r")).select("id", "r.*")
    path = shared.new(t.spark, "clients")
    columns = ["id", "ord", "segment", "city"]
    versions.change(t.spark, path, lambda c: c.upsert("clients", base.select(*columns), ["id"], "ord", 16))

    def run(c):
        c.upsert("clients", last.where("op <> 'D'").select(*columns), ["id"], "ord")
        c.remove("clients", last.where("op = 'D'"), ["id"])
        c.upsert("runs", last.groupBy("op").agg(F.count("*").alias("n")), ["op"], "n", 1)

    versions.change(t.spark, path, run, writer="feed", batch=0)
    now = versions.snapshot(t.spark, path)
    runs = now["runs"].select(F.ascii("op").cast("bigint").alias("id"), F.col("n").alias("ord"), F.col("op").alias("segment"), F.lit("").alias("city"))
    kinds = {"client": now["clients"].select(*columns), "run": runs}
    first, second = (df.withColumn("kind", F.lit(kind)) for kind, df in kinds.items())
    return first.unionByName(second).select("kind", *columns)


@query("""WITH RECURSIVE c AS (SELECT client_id, epoch_us(ts) // 1000 AS t FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
 asks AS (SELECT client_id, min(t) AS t FROM c GROUP BY client_id
  UNION ALL SELECT a.client_id, min(c.t) FROM asks a JOIN c ON c.client_id = a.client_id AND c.t >= a.t + 2592000000 GROUP BY a.client_id, a.t)
 SELECT CAST(client_id AS VARCHAR) AS key, t AS "at" FROM asks""")
def asked_again(t):
    """Lookups of the clients that click, as a stream whose unanswered questions hold for 30 days: the
    clicks at which one is asked."""
    clicks = t.spark.readStream.schema(t.clicks.schema).parquet(f"{t.folder}/click[s].parquet")  # a stream reads a single file by a pattern only
    at = times.millis(clicks, "ts")
    events = clicks.select(F.col("client_id").cast("string").alias("key"), at.alias("at"), F.lit("request").alias("kind"), F.lit(None).cast("string").alias("value"))
    out, mark = shared.new(t.spark, "asked"), shared.new(t.spark, "mark")
    lookups.written(lookups.remembered(events), out, mark).awaitTermination()
    return t.spark.read.schema(lookups.OUT).parquet(out).where("action = 'ask'").select("key", "at")


@query(r"""WITH p AS (SELECT doc_id AS id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '\s+', ' ', 'g')) AS a FROM documents WHERE doc_id IS NOT NULL)
 SELECT id, CASE WHEN id % 5 = 4 OR length(a) < 40 THEN NULL ELSE a END AS value,
  CASE WHEN id % 5 = 4 OR length(a) < 40 THEN 'miss' ELSE ['crossref', 'semantic_scholar', 'semantic_scholar', 'arxiv'][id % 5 + 1] END AS provider FROM p""")
def abstract_waterfall(t):
    """Abstracts of all documents from recorded answers: a fifth each is known by DOI to one provider or
    another, by title to a third, and to nobody."""
    kind = F.col("id") % 5
    name = F.concat(F.lit("Paper number "), F.col("id").cast("string"))
    papers = t.papers.where("id IS NOT NULL").select("id", T.squash("title").alias("told"), name.alias("title"), F.when(kind < 2, F.concat(F.lit("10.1/"), F.col("id").cast("string"))).otherwise("").alias("doi"), F.lit("").alias("url"))
    papers = shared.save(papers, "papers")
    steps = waterfall.abstract_steps()
    json = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())))
    told = F.col("told")
    payloads = [
        (0, steps[3], json(message=F.struct(F.concat(F.lit("<jats:p>"), told, F.lit("</jats:p>")).alias("abstract")))),
        (1, steps[4], json(abstract=told)),
        (2, steps[5], json(data=F.array(F.struct(F.col("title"), told.alias("abstract"))))),
        (3, steps[6], F.concat(F.lit("<feed><entry><title>"), F.col("title"), F.lit("</title><summary>"), told, F.lit("</summary></entry></feed>"))),
    ]
    recorded = None
    for n, step, payload in payloads:
        part = papers.where(kind == n).select(step.request.alias("request"), payload.alias("payload"))
        recorded = part if recorded is None else recorded.unionByName(part)
    return waterfall.run(papers.drop("told"), steps, shared.save(recorded, "recorded")).select("id", "value", "provider")
