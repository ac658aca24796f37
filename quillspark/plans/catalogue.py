"""The registered queries of the library proper and their equivalent SQL.

The tables at hand stand in for papers: a document's first line is a title and its text an
abstract, languages and sources are venues and years, labels are curation, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import html, text as T
from quillspark.operators import classify, enrich, ledger, match, metrics, records, resolve, store
from quillspark.sources import writers

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def papers(self) -> DataFrame:
        d = self.documents
        return d.select(F.col("doc_id").alias("id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("venue"), F.col("source").alias("year"))

    @property
    def datasets(self) -> DataFrame:
        """Parts as data set records: the brand is the citing paper, the type the modality."""
        p = self.part
        kind = F.element_at(F.array(*map(F.lit, ("introduced", "reused", "extended", "unclear"))), (F.col("p_partkey") % 4 + 1).cast("int"))
        return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_brand").alias("key"), F.col("p_type").alias("modalities"), F.concat(F.lit("L"), (F.col("p_size") % 7 + 1).cast("string")).alias("osi_layers"), kind.alias("relationship_type"), (F.col("p_size") / 50.0).alias("confidence"))


def query(sql: str | None = None):
    def register(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


VOCABULARY = classify.Vocabulary(("license", "mit", "sich"), ("with", "from", "avec"), ("pour", "elle", "nicht"))

_PAPERS = "papers AS (SELECT doc_id AS id, split_part(coalesce(text, ''), chr(10), 1) AS title, text AS abstract, lang AS venue, source AS year FROM documents)"
_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_GUARD = r"trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _hits(terms: tuple[str, ...]) -> str:
    each = [rf"CASE WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])') THEN '{w}' END" for w in sorted(terms)]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


_LABELLED = _PAPERS + rf""", seen AS (SELECT *, regexp_replace(lower(concat(title, ' ', coalesce(abstract, ''))), '\s+', ' ', 'g') AS t FROM papers),
hits AS (SELECT *, {_hits(VOCABULARY.wireless)} AS w, {_hits(VOCABULARY.networking)} AS n, {_hits(VOCABULARY.computing)} AS c, coalesce(abstract, '') <> '' AS has FROM seen),
labelled AS (SELECT id, title, venue, year, CASE WHEN len(w) > 0 THEN 'yes' WHEN len(n) > 0 OR len(c) > 0 THEN 'no' ELSE 'maybe' END AS label,
  CAST(CASE WHEN len(w) > 0 THEN [0.93, 0.95, 0.97][least(len(w), 3)] WHEN len(n) > 0 THEN CASE WHEN has THEN 0.82 ELSE 0.70 END
       WHEN len(c) > 0 THEN CASE WHEN has THEN 0.76 ELSE 0.65 END ELSE CASE WHEN has THEN 0.55 ELSE 0.45 END END AS DOUBLE) AS confidence,
  concat_ws('; ', 'category=' || CASE WHEN len(w) > 0 THEN 'wireless' WHEN len(n) > 0 THEN 'networking_non_wireless' WHEN len(c) > 0 THEN 'not_relevant' ELSE 'uncertain' END,
    CASE WHEN len(w) > 0 THEN 'wireless_terms=' || array_to_string(w, ', ') END, CASE WHEN len(n) > 0 THEN 'networking_terms=' || array_to_string(n, ', ') END,
    CASE WHEN len(c) > 0 THEN 'computing_terms=' || array_to_string(c, ', ') END, CASE WHEN NOT has THEN 'abstract_missing=true' END) AS evidence,
  trim(coalesce(abstract, '')) <> '' AS used_abstract FROM hits)"""


def _scores(level: str = "level, ") -> str:
    return """round(coalesce(tp / nullif(tp + fp + fn, 0), 0.0), 4) AS jaccard, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 4) AS "precision",
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 4) AS recall,
  round(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1"""


def _labelled(t: Tables) -> DataFrame:
    return classify.keyword(t.papers, VOCABULARY)


def _judged(t: Tables) -> DataFrame:
    gold = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("gold"))
    return _labelled(t).join(gold, "id", "left").withColumn("predicted", classify.passes(F.col("label")))


_JUDGED = _LABELLED + ", judged AS (SELECT l.*, coalesce(g.quality = 1, false) AS gold, label = 'yes' AS predicted FROM labelled l LEFT JOIN labels g ON l.id = g.doc_id)"
_COUNTS = _JUDGED + """, counts AS (SELECT venue, year, CAST(count_if(predicted AND gold) AS BIGINT) AS tp, CAST(count_if(predicted AND NOT gold) AS BIGINT) AS fp,
  CAST(count_if(NOT predicted AND gold) AS BIGINT) AS fn FROM judged GROUP BY ALL)"""


@query(f"""WITH {_COUNTS}, sums AS (SELECT venue, year, CAST(grouping(venue, year) AS BIGINT) AS level, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM counts GROUP BY GROUPING SETS ((venue, year), (venue), ())) SELECT venue, year, level, tp, fp, fn, {_scores()} FROM sums""")
def eval_rollup(t):
    return metrics.rollup(metrics.confusion(_judged(t), "venue", "year"))


@query(f"WITH {_LABELLED} SELECT id, label, confidence, evidence, used_abstract FROM labelled")
def keyword_labels(t):
    return _labelled(t).select("id", "label", "confidence", "evidence", "used_abstract")


@query(f"""WITH {_LABELLED}, sums AS (SELECT venue, year, CAST(grouping(venue, year) AS BIGINT) AS level, count(*) AS total, CAST(count_if(label = 'yes') AS BIGINT) AS yes,
  CAST(count_if(label = 'maybe') AS BIGINT) AS maybe, CAST(count_if(label = 'no') AS BIGINT) AS no, CAST(count_if(used_abstract) AS BIGINT) AS with_abstract FROM labelled GROUP BY ROLLUP (venue, year))
  SELECT *, round(yes * 100.0::DOUBLE / total, 1) AS yes_pct, round(maybe * 100.0::DOUBLE / total, 1) AS maybe_pct, round(no * 100.0::DOUBLE / total, 1) AS no_pct FROM sums""")
def label_breakdown(t):
    return classify.breakdown(_labelled(t), "venue", "year")


@query(f"""WITH {_COUNTS} SELECT venue, year, tp + fn AS gold_count, CASE WHEN venue = 'de' THEN 'excluded' WHEN tp + fn < 5 THEN 'below_min_gold' END AS reason FROM counts""")
def eval_under_curated(t):
    counts = metrics.confusion(_judged(t), "venue", "year").select("venue", "year", (F.col("tp") + F.col("fn")).alias("gold_count"))
    return metrics.under_curated(counts, counts.where("venue = 'de'"), 5)


@query(f"""WITH {_JUDGED} SELECT venue, year, count(*) AS papers FROM judged g WHERE gold AND NOT EXISTS (SELECT 1 FROM judged c WHERE c.label = 'yes' AND c.venue = g.venue AND c.year = g.year) GROUP BY ALL""")
def ignored_gold(t):
    judged = _judged(t)
    return metrics.ignored_gold(judged.where("gold"), judged.where("label = 'yes'"))


@query(f"""WITH {_PAPERS} SELECT id, {_NORM.format('title')} AS title_norm, {_GUARD.format('title')} AS guard, 'title:' || {_GUARD.format('title')} AS title_key,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\\b(dataset|traces|measurements|data|performance)\\b', '', 'g'), ' +', ' ', 'g')) AS record_name,
  left(trim(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), 60) AS score_title FROM papers""")
def normalize_titles(t):
    return t.papers.select("id", T.normalize_title("title").alias("title_norm"), T.guard_title("title").alias("guard"), T.title_key("title").alias("title_key"), T.record_name("title").alias("record_name"), T.score_title("title").alias("score_title"))


@query("""SELECT page_id, regexp_replace(lower(regexp_replace('https://doi.org/10.1145/' || upper(url) || '/', '^(https?://(dx\\.)?doi\\.org/|doi:)', '', 'i')), '/+$', '') AS doi FROM pages""")
def normalize_dois(t):
    return t.pages.select("page_id", T.normalize_doi(F.concat(F.lit("https://doi.org/10.1145/"), F.upper("url"), F.lit("/"))).alias("doi"))


@query(r"""SELECT page_id, lower(concat(regexp_extract(rtrim(trim(url), '/'), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1),
  rtrim(regexp_replace(regexp_replace(rtrim(trim(url), '/'), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?', ''), '[?#].*$', ''), '/'))) AS url_norm FROM pages""")
def url_normalize(t):
    return t.pages.select("page_id", T.normalize_url("url").alias("url_norm"))


@query("""SELECT page_id, unnest(regexp_extract_all('see ' || url || ', and ' || url, 'https?://[^\\s,;)"'']+')) AS found FROM pages""")
def url_extract(t):
    return t.pages.select("page_id", F.explode(T.urls(F.lit("see"), F.concat("url", F.lit(", and")), F.col("url"))).alias("found"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS h1 FROM pages""")
def strip_markup(t):
    return t.pages.select("page_id", T.strip_tags("html").alias("plain"), T.first_heading("html").alias("h1"))


@query()
def html_clean_links(t):
    seen = t.pages.select("page_id", html.clean("html", "url").alias("c"))
    return seen.select("page_id", F.col("c.text").alias("text"), F.size("c.links").alias("links"))


@query(rf"""WITH {_PAPERS}, a AS (SELECT id AS actual_id, {_GUARD.format('title')} AS a, list_distinct(list_filter(string_split({_GUARD.format('title')}, ' '), lambda x: x <> '')) AS aw FROM papers WHERE id % 2 = 1),
 e AS (SELECT id AS expected_id, {_GUARD.format('title')} AS e, list_distinct(list_filter(string_split({_GUARD.format('title')}, ' '), lambda x: x <> '')) AS ew FROM papers WHERE id % 2 = 0)
 SELECT expected_id, actual_id FROM a JOIN e ON len(aw) > 0 AND len(ew) > 0 AND abs(len(aw) - len(ew)) <= 4
 WHERE a = e OR len(list_intersect(ew, aw)) >= 0.85::DOUBLE * len(ew)""")
def title_guard(t):
    return match.guard_join(t.papers.where("id % 2 = 0").select("id", "title"), t.papers.where("id % 2 = 1").select("id", "title"))


@query(rf"""WITH {_PAPERS}, n AS (SELECT id, venue, {_NORM.format('title')} AS title_norm FROM papers), one AS (SELECT title_norm, min(id) AS right_id FROM n WHERE title_norm <> '' GROUP BY 1)
 SELECT n.title_norm, id, right_id FROM n JOIN one USING (title_norm)""")
def title_match_exact(t):
    n = t.papers.select("id", T.normalize_title("title").alias("title_norm"))
    return match.by_key(n, n, "title_norm", order="id").select("title_norm", "id", "right_id")


def _sides(t):
    n = t.papers.select("id", F.col("id").alias("ord"), "venue", "year", T.normalize_title("title").alias("title"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("10.1/"), (F.col("id") % 350).cast("string"))).otherwise("").alias("doi"))
    return n.where("id % 2 = 0"), n.where("id % 2 = 1")


@query()
def cascade_match(t):
    return match.cascade(*_sides(t), ["venue", "year"])


@query()
def fuzzy_match(t):
    return match.fuzzy_best(*_sides(t), ["venue"], 0.9)


@query(rf"""WITH {_PAPERS}, s AS (SELECT title, (id % 100) / 100.0::DOUBLE AS confidence, CASE WHEN id % 10 = 0 THEN 0 ELSE 1 END AS authors FROM papers)
 SELECT 'missing_title' AS reason, title, confidence FROM s WHERE trim(title) = '' UNION ALL SELECT 'missing_authors', title, confidence FROM s WHERE authors = 0
 UNION ALL SELECT 'low_confidence', title, confidence FROM s WHERE confidence < 0.9
 UNION ALL SELECT 'duplicate_title', t, 0.5::DOUBLE FROM (SELECT trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS t FROM s) WHERE t <> '' GROUP BY t HAVING count(*) > 1""")
def seed_validation(t):
    names = F.when(F.col("id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    return records.review(t.papers.select("title", names.alias("authors"), ((F.col("id") % 100) / 100.0).alias("confidence")))


@query(rf"""WITH {_PAPERS}, s AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Poster: ' WHEN id % 5 = 1 THEN 'Work in progress - ' WHEN id % 5 = 2 THEN 'Demystifying: ' ELSE '' END || title AS title FROM papers)
 SELECT id FROM s WHERE NOT regexp_matches(title, '(?i)^\s*(?:poster|demo|demonstration|work[\s-]?in[\s-]?progress|wip)\b\s*[:\-–—]')""")
def non_paper_filter(t):
    mark = F.when(F.col("id") % 5 == 0, "Poster: ").when(F.col("id") % 5 == 1, "Work in progress - ").when(F.col("id") % 5 == 2, "Demystifying: ").otherwise("")
    return t.papers.where(~records.non_paper(F.concat(mark, "title"))).select("id")


_STATUS_FROM = "FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey"


@query(f"""SELECT r_name AS venue, n_name AS year, count(*) AS papers, CAST(coalesce(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS with_doi,
  CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS BIGINT) AS predicted {_STATUS_FROM} GROUP BY ALL""")
def corpus_status_raw(t):
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("r_name").alias("venue"), F.col("n_name").alias("year")).agg(F.count("*").alias("papers"), F.count_if(F.col("c_acctbal") > 0).alias("with_doi"), F.count_if(F.col("o_orderstatus") == "F").alias("predicted"))


@query("""WITH p AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
 SELECT r_name AS venue, n_name AS year, count(c_custkey) AS papers, CAST(count_if(c_acctbal > 0) AS BIGINT) AS with_doi, CAST(count_if(coalesce(done, 0) > 0) AS BIGINT) AS predicted
 FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN p ON o_custkey = c_custkey GROUP BY ALL""")
def corpus_status(t):
    done = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    rows = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(done, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("r_name").alias("venue"), F.col("n_name").alias("year")).agg(F.count("c_custkey").alias("papers"), F.count_if(F.col("c_acctbal") > 0).alias("with_doi"), F.count_if(F.col("done") > 0).alias("predicted"))


@query(f"""WITH {_LABELLED} SELECT id, title, label, confidence, row_number() OVER (PARTITION BY venue ORDER BY CASE label WHEN 'yes' THEN 0 WHEN 'maybe' THEN 1 ELSE 2 END, confidence DESC, title, id) AS place
 FROM labelled JOIN labels ON doc_id = id WHERE quality = 1""")
def labelled_papers(t):
    rank = F.when(F.col("label") == "yes", 0).when(F.col("label") == "maybe", 1).otherwise(2)
    rows = _labelled(t).join(t.labels.where("quality = 1"), F.col("doc_id") == F.col("id"))
    place = F.row_number().over(Window.partitionBy("venue").orderBy(rank, F.desc("confidence"), "title", "id"))
    return rows.select("id", "title", "label", "confidence", place.cast("bigint").alias("place"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_run(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("""SELECT page_id % 40 AS paper_id, arg_min(url, (CASE WHEN contains(url, '.org') THEN 0 ELSE 1 END) * 1000000000 + page_id) AS url FROM pages WHERE trim(url) <> '' GROUP BY 1""")
def preferred_url(t):
    return enrich.preferred_url(t.pages.select((F.col("page_id") % 40).alias("paper_id"), "url", F.col("page_id").alias("ord")), favoured=".org")


@query("SELECT p_partkey AS ord, p_name AS name, p_brand AS key, count(*) OVER (PARTITION BY p_brand, p_name) AS usage_count FROM part")
def usage_counts(t):
    return records.usage_counts(t.datasets.withColumn("year", F.lit(1)), "key", "year").select("ord", "name", "key", "usage_count")


_DATASETS = "d AS (SELECT p_partkey AS ord, p_name AS name, p_brand AS key, p_type AS modalities, 'L' || (p_size % 7 + 1) AS osi_layers, ['introduced','reused','extended','unclear'][p_partkey % 4 + 1] AS relationship_type, p_size / 50.0::DOUBLE AS confidence FROM part)"


@query(f"""WITH {_DATASETS} SELECT name, arg_min(modalities, ord) AS modalities, arg_min(osi_layers, ord) AS osi_layers, count(*) AS paper_count,
 coalesce(arg_min(key, ord) FILTER (WHERE relationship_type = 'introduced'), arg_min(key, ord)) AS key FROM d GROUP BY name""")
def datasets_sheet(t):
    return records.datasets_sheet(t.datasets, ["modalities", "osi_layers"])


@query(rf"""WITH {_DATASETS}, s AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN name || ' Dataset' ELSE name END AS name, key, ord % 5 AS number FROM d),
 n AS (SELECT *, regexp_replace(regexp_replace(lower(trim(name)), '[- ]+(dataset|traces|measurements|data|evaluation)s?$', ''), '\s+', ' ', 'g') AS norm FROM s),
 c AS (SELECT norm, count(DISTINCT key) AS papers, arg_min(name, ord) AS canonical FROM n GROUP BY norm)
 SELECT canonical AS name, arg_min(key, ord) AS key, CAST(sum(number) AS BIGINT) AS summed, max(papers) AS papers FROM n JOIN c USING (norm) GROUP BY canonical HAVING max(papers) >= 2""")
def merge_master(t):
    name = F.when(F.col("ord") % 3 == 0, F.concat("name", F.lit(" Dataset"))).otherwise(F.col("name"))
    sheet = t.datasets.withColumn("name", name).withColumn("number", (F.col("ord") % 5).cast("string"))
    return records.merge_sheets(sheet, records.corpus_counts(sheet.withColumn("paper", F.col("key"))), 2)


def _linked(t):
    d = t.datasets.withColumns({"keys": F.array("key"), "environment": F.lit("Lab"), "doi": F.lit(None).cast("string"), "availability_notes": F.lit("")})
    return d.withColumn("availability_url", F.concat(F.lit("https://data.example.org/"), F.substring_index("name", " ", 1), F.lit("/")))


@query(rf"""WITH {_DATASETS}, l AS (SELECT *, lower('data.example.org/' || split_part(name, ' ', 1)) AS url FROM d),
 p AS (SELECT a.ord AS ord_a, b.ord AS ord_b, a.name AS name_a, b.name AS name_b, row_number() OVER (PARTITION BY least(a.name, b.name), greatest(a.name, b.name) ORDER BY a.ord, b.ord) AS n
  FROM l a JOIN l b ON a.url = b.url AND a.ord < b.ord AND a.key <> b.key) SELECT ord_a, ord_b, name_a, name_b, 0.95::DOUBLE AS confidence FROM p WHERE n = 1""")
def url_dedup_pairs(t):
    return resolve.url_pairs(_linked(t)).select("ord_a", "ord_b", "name_a", "name_b", "confidence")


@query()
def similarity_pairs(t):
    return resolve.first_similar(_linked(t), resolve.url_pairs(_linked(t)))


_EDGES = rf"""{_DATASETS}, l AS (SELECT *, split_part(name, ' ', 1) AS url FROM d), root AS (SELECT DISTINCT a.name, min(b.name) OVER (PARTITION BY a.name) AS root
 FROM (SELECT DISTINCT name, url FROM l) a JOIN (SELECT DISTINCT name, url FROM l) b USING (url))"""


@query(rf"WITH {_EDGES} SELECT name, root FROM root")
def components(t):
    pairs = resolve.url_star(_linked(t))
    found = resolve.components(pairs.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    names = t.datasets.select("name").distinct()
    return names.join(found, "name", "left").select("name", F.coalesce("root", "name").alias("root"))


@query(rf"""WITH {_EDGES} SELECT (list(DISTINCT name ORDER BY length(name) DESC, name))[1] AS canonical_name, count(DISTINCT key) AS reuse_count, count(DISTINCT name) AS names,
 arg_max(modalities, length(modalities) * 1000000000 - ord) AS modalities, array_to_string(list(DISTINCT osi_layers ORDER BY osi_layers), ', ') AS osi_layers FROM d JOIN root USING (name) GROUP BY root""")
def consolidate(t):
    out = resolve.consolidate(_linked(t), resolve.url_star(_linked(t)))
    return out.select("canonical_name", "reuse_count", F.size("all_names").cast("bigint").alias("names"), "modalities", "osi_layers")


@query(rf"""WITH a AS (SELECT DISTINCT {_NORM.format("split_part(text, chr(10), 1)")} AS title FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT {_NORM.format("split_part(text, chr(10), 1)")} AS title FROM documents WHERE doc_id % 2 = 1)
 SELECT 'both' AS side, title FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', title FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', title FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_ops(t):
    n = t.papers.select("id", T.normalize_title("title").alias("title"))
    a, b = n.where("id % 2 = 0").select("title"), n.where("id % 2 = 1").select("title")
    side = lambda d, s: d.select(F.lit(s).alias("side"), "title")
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "left")).unionByName(side(b.subtract(a), "right"))


@query("SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark")
def union_files(t):
    a, b = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    return a.unionByName(b, allowMissingColumns=True)


def _halves(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return match.pick(o.where("o_orderkey % 2 = 0"), ["o_custkey"], [F.col("o_orderkey")]), o.where("o_orderkey % 2 = 1")


@query("""WITH e AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
 SELECT o_custkey, coalesce(e.o_orderkey, n.o_orderkey) AS o_orderkey FROM e FULL JOIN n USING (o_custkey)""")
def insert_or_ignore(t):
    return store.insert_or_ignore(*_halves(t), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
 SELECT o_custkey, coalesce(n.o_orderkey, e.o_orderkey) AS o_orderkey FROM e FULL JOIN n USING (o_custkey)""")
def insert_or_replace(t):
    return store.insert_or_replace(*_halves(t), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), o.status) AS c_name FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def backfill(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"))
    found = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("c_name"))
    return store.backfill(rows, found, ["c_custkey"], ["c_name"])


@query("""SELECT 'kept' AS part, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL
 SELECT 'orphan', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def prune(t):
    kept = store.prune(t.orders, t.customer.where("c_nationkey = 3").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
    lone = store.orphans(t.customer, t.orders, "c_custkey", "o_custkey")
    return kept.select(F.lit("kept").alias("part"), F.col("o_orderkey").alias("id")).unionByName(lone.select(F.lit("orphan").alias("part"), F.col("c_custkey").alias("id")))


@query("""SELECT lang, count(*) AS total, CAST(count_if(doc_id % 3 > 0) AS BIGINT) AS fetchable, round(count_if(doc_id % 3 > 0) * 100.0::DOUBLE / count(*), 1) AS fetchable_pct FROM documents GROUP BY lang""")
def oa_summary(t):
    return enrich.coverage(t.documents.select("lang", (F.col("doc_id") % 3 > 0).alias("fetchable")), "lang")


@query("""SELECT CASE WHEN trim(CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END) = '' THEN 'unknown' ELSE source END AS source, count(*) AS papers FROM documents WHERE doc_id % 3 > 0 GROUP BY 1""")
def oa_by_provider(t):
    rows = t.documents.select(F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")).alias("source"), (F.col("doc_id") % 3 > 0).alias("fetchable"))
    return enrich.coverage_by(rows, "source")


@query("SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''), ' ') AS text FROM documents")
def inverted_index(t):
    """Builds each text's map from word to positions and reads it back."""
    words = t.documents.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "").alias("w"))
    spots = F.transform("w", lambda w, i: F.struct(F.concat(F.format_string("%010d", i), F.lit(" "), w).alias("k"), F.array(i).alias("v")))
    index = words.select("doc_id", F.map_from_entries(spots).alias("index"))
    texts = T.inverted_to_text(F.col("index"))
    return index.select("doc_id", F.regexp_replace(texts, r"(^| )\d{10} ", "$1").alias("text"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'yes' WHEN event_id % 4 = 1 THEN 'no' ELSE 'maybe' END AS label, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'high' ELSE '0.5' END AS DOUBLE), 0.8) AS confidence FROM events""")
def label_coerce(t):
    said = F.element_at(F.array(*map(F.lit, (" YES", "no", "perhaps", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    score = F.when(F.col("event_id") % 5 == 0, "high").otherwise("0.5")
    return t.events.select("event_id", T.label(said).alias("label"), F.coalesce(score.try_cast("double"), F.lit(0.8)).alias("confidence"))


@query("""WITH c AS (SELECT sha256(concat_ws(chr(0), 'p', 'm', coalesce(text, ''))) AS key, min(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1)
 SELECT doc_id AS id, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' ELSE 'maybe' END AS label, CASE WHEN quality IS NULL THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence, quality IS NOT NULL AS cached
 FROM documents LEFT JOIN c ON key = sha256(concat_ws(chr(0), 'p', 'm', coalesce(text, '')))""")
def labels_cached(t):
    prompt = F.coalesce("text", F.lit(""))
    said = t.documents.join(t.labels, "doc_id").groupBy(T.content_key(F.lit("p"), F.lit("m"), prompt).alias("key")).agg(F.min("quality").alias("quality"))
    cache = said.select("key", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"), F.lit(0.9).alias("confidence"))
    model = lambda p: F.struct(F.lit("perhaps").alias("label"), F.lit(0.4).alias("confidence"))
    papers = t.documents.select(F.col("doc_id").alias("id"), prompt.alias("text"))
    return classify.with_cache(papers, cache, model, F.col("text"), "p", "m").select("id", "label", "confidence", "cached")


@query("SELECT doc_id, 'v1:' || sha256(concat_ws(chr(0), 'provider', 'model', coalesce(text, ''))) AS key, to_base64(encode(coalesce(text, ''))) AS packed FROM documents")
def content_keys(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", T.content_key(F.lit("provider"), F.lit("model"), text).alias("key"), F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit("")).alias("packed"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS session FROM conversations""")
def session_carry(t):
    return records.carried(t.conversations, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "session").select("conv_id", "turn", "session")


@query("""WITH n AS (SELECT conv_id, role, text AS head, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
 SELECT a.conv_id, a.n, a.head AS asked, b.head AS said FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND a.n = b.n AND b.role = 'assistant' WHERE a.role = 'user'""")
def positional_zip(t):
    side = lambda r, c: t.conversations.where(F.col("role") == r).select("conv_id", "turn", F.col("text").alias(c))
    return records.zipped(side("user", "asked"), side("assistant", "said"), ["conv_id"], "turn").select("conv_id", F.col("n").cast("bigint").alias("n"), "asked", "said")


@query(rf"""WITH {_DATASETS}, s AS (SELECT *, CASE ord % 6 WHEN 0 THEN 'Figure ' || name WHEN 1 THEN 'traces' WHEN 2 THEN 'Smith2020-' || name WHEN 3 THEN 'the ' || name ELSE name END AS n FROM d)
 SELECT ord, n AS name FROM s WHERE CASE WHEN relationship_type = 'introduced' THEN confidence >= 0.6 AND (regexp_matches(n, '^[A-Z][a-z]+\d{{4}}-') OR NOT (n LIKE 'Figure %' OR n = 'traces'))
 ELSE confidence >= 0.5 AND NOT (n LIKE 'Figure %' OR n LIKE 'the %' OR n = 'traces' OR regexp_matches(lower(n), '^(our|this|same|a|an|some|collected|recorded|running|table|fig) ') OR (n = lower(n) AND length(n) > 60)) END""")
def record_filter(t):
    k = F.col("ord") % 6
    name = F.when(k == 0, F.concat(F.lit("Figure "), "name")).when(k == 1, "traces").when(k == 2, F.concat(F.lit("Smith2020-"), "name")).when(k == 3, F.concat(F.lit("the "), "name")).otherwise(F.col("name"))
    return t.datasets.withColumn("name", name).where(records.accepted(F.col("name"), F.col("relationship_type"), F.col("confidence"))).select("ord", "name")


@query(rf"""WITH {_PAPERS}, w AS (SELECT id, list_distinct(list_filter(string_split({_GUARD.format('title')}, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split({_GUARD.format("coalesce(abstract, '')")}, ' '), lambda x: x <> '')) AS b FROM papers)
 SELECT id, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0) AS jaccard FROM w""")
def set_jaccard(t):
    a, b = T.tokens(T.guard_title("title")), T.tokens(T.guard_title(F.coalesce("abstract", F.lit(""))))
    return t.papers.select("id", metrics.jaccard(a, b).alias("jaccard"))


@query("""SELECT source, count(*) AS total, CAST(count_if(m AND p) AS BIGINT) AS "both", CAST(count_if(m AND NOT p) AS BIGINT) AS manual_only, CAST(count_if(NOT m AND p) AS BIGINT) AS pipeline_only, CAST(count_if(NOT m AND NOT p) AS BIGINT) AS neither,
 round(coalesce(count_if(m AND p) / nullif(count_if(m), 0), 0.0), 4) AS recall FROM (SELECT source, quality = 1 AS m, n_chars > 1000 AS p FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def scorer_confusion(t):
    rows = t.documents.join(t.labels, "doc_id").select("source", (F.col("quality") == 1).alias("manual_has"), (F.col("n_chars") > 1000).alias("pipeline_has"))
    return metrics.presence(rows, "source")[1]


@query(rf"""SELECT c_custkey, concat(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 2000 + c_nationkey, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g')) AS key FROM customer""")
def bibtex_key(t):
    name = F.concat(F.lit("First "), F.col("c_name"), F.lit(", Other Name"))
    return t.customer.select("c_custkey", T.bibtex_key(name, F.lit(2000) + F.col("c_nationkey"), F.concat("c_mktsegment", F.lit(" and more"))).alias("key"))


@query(r"""WITH f AS (SELECT lower(concat(url, chr(10), left(html, 1000))) AS h, page_id FROM pages)
 SELECT page_id, CASE WHEN contains(h, 'sigcomm') THEN 'sigcomm' WHEN contains(h, 'acm') THEN 'acm' WHEN contains(h, 'ieee') THEN 'ieee' WHEN contains(h, 'usenix.org') THEN 'usenix' WHEN contains(h, 'openreview.net') THEN 'openreview' ELSE 'generic' END AS hint FROM f""")
def source_hint(t):
    return t.pages.select("page_id", T.source_hint(F.col("url"), F.col("html")).alias("hint"))


@query("""WITH s AS (SELECT lower(lang) AS v, source AS y, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS display, doc_id FROM documents) SELECT v AS venue, y AS year, arg_min(display, doc_id) AS display, count(*) AS papers FROM s GROUP BY ALL""")
def gold_grouping(t):
    shown = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    return t.documents.groupBy(F.lower("lang").alias("venue"), F.col("source").alias("year")).agg(F.min_by(shown, "doc_id").alias("display"), F.count("*").alias("papers"))


@query(rf"""WITH {_PAPERS}, k AS (SELECT id, {_GUARD.format('title')} AS title, CASE WHEN id % 3 = 0 THEN '10.1/' || (id % 90) ELSE '' END AS doi FROM papers),
 w AS (SELECT 'doi:' || doi AS key, id FROM k WHERE id % 2 = 0 AND doi <> '' UNION ALL SELECT 'title:' || title, id FROM k WHERE id % 2 = 0 AND title <> ''), c AS (SELECT key, max(id) AS v FROM w GROUP BY 1)
 SELECT k.id, coalesce(d.v, t.v) AS found FROM k LEFT JOIN c d ON d.key = 'doi:' || k.doi LEFT JOIN c t ON t.key = 'title:' || k.title WHERE k.id % 2 = 1""")
def cache_lookup(t):
    k = t.papers.select("id", "title", F.when(F.col("id") % 3 == 0, F.concat(F.lit("10.1/"), (F.col("id") % 90).cast("string"))).otherwise("").alias("doi"), F.col("id").alias("ord"))
    empty = t.spark.createDataFrame([], "key string, value bigint")
    cache = store.cache_put(empty, k.where("id % 2 = 0"), "id")
    return store.cache_get(k.where("id % 2 = 1"), cache, "found").select("id", "found")


@query("SELECT section, count(*) AS entries FROM (SELECT event_type AS section FROM events) GROUP BY 1")
def cache_stats(t):
    return t.events.groupBy(F.col("event_type").alias("section")).agg(F.count("*").alias("entries"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-06-01' - INTERVAL 30 DAY OR event_id % 50 = 0")
def cache_fresh(t):
    stamp = F.when(F.col("event_id") % 50 == 0, "unknown").otherwise(F.col("ts").cast("string"))
    return store.fresh(t.events.select("event_id", stamp.alias("stored_at")), F.lit("2024-06-01").cast("timestamp")).select("event_id")


@query("""WITH o AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://dl.acm.org/' || page_id END AS a, CASE WHEN page_id % 2 = 0 THEN url END AS b, CASE WHEN page_id % 5 = 0 THEN 'https://dl.acm.org/x' END AS c FROM pages)
 SELECT page_id, CASE WHEN b IS NOT NULL AND b <> '' THEN 'second' WHEN c IS NOT NULL THEN 'third' WHEN a IS NOT NULL THEN 'first' END AS provider FROM o""")
def oa_resolver(t):
    k = F.col("page_id")
    options = [("first", F.when(k % 3 == 0, F.concat(F.lit("https://dl.acm.org/"), k.cast("string")))), ("second", F.when(k % 2 == 0, F.col("url"))), ("third", F.when(k % 5 == 0, "https://dl.acm.org/x"))]
    return t.pages.select("page_id", enrich.open_access(options)["provider"].alias("provider"))


@query(rf"""WITH {_PAPERS}, c AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'cached' WHEN id % 3 = 0 AND length(abstract) >= 40 THEN 'crossref' WHEN id % 2 = 0 THEN 'arxiv' ELSE 'miss' END AS provider FROM papers) SELECT id, provider FROM c""")
def abstract_chain(t):
    k, a = F.col("id"), F.col("abstract")
    who = enrich.chain([("cached", F.when(k % 4 == 0, "known")), ("crossref", F.when((k % 3 == 0) & enrich.long_enough(a), a)), ("arxiv", F.when(k % 2 == 0, "text"))])[1]
    return t.papers.select("id", who.alias("provider"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'given' WHEN 1 THEN 'crossref' WHEN 2 THEN 'openalex' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'cached' ELSE 'miss' END ELSE 'miss' END AS provider,
 CASE p_partkey % 5 WHEN 0 THEN '10.1/Given' WHEN 1 THEN '10.2/' || lower(p_brand) WHEN 2 THEN '10.3/' || lower(p_brand) WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN '10.4/' || p_partkey ELSE '' END ELSE '' END AS doi FROM part""")
def doi_resolver(t):
    """Parts as papers: answers of the first provider fit one in five, of the second one more; the cache knows
    hits and misses."""
    kind, name = F.col("p_partkey") % 5, F.concat_ws(" ", "p_name", F.lit("number"), F.col("p_partkey").cast("string"))
    title = F.when(kind == 1, F.initcap(name)).otherwise("Of quite other matters")
    first = F.to_json(F.struct(F.struct(F.array(F.struct(F.concat(F.lit("10.2/"), "p_brand").alias("DOI"), F.array(title).alias("title"))).alias("items")).alias("message")))
    second = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("https://doi.org/10.3/"), "p_brand").alias("doi"), F.when(kind.isin(1, 2), F.upper(name)).otherwise("Nothing alike").alias("title"))).alias("results")))
    hit = F.col("p_size") % 2 == 0
    papers = t.part.select(F.col("p_partkey").alias("id"), name.alias("title"), F.when(kind == 0, " 10.1/Given ").alias("doi"), first.alias("first"), second.alias("second"))
    cache = t.part.where(kind == 4).select(T.title_key(name).alias("title_key"), F.when(hit, F.concat(F.lit("10.4/"), F.col("p_partkey").cast("string"))).otherwise("").alias("doi"), F.when(hit, "cached").otherwise("miss").alias("provider"))
    found = enrich.resolved_dois(papers, cache, {"crossref": F.col("first"), "openalex": F.col("second")})
    return found.select("id", F.col("doi_provider").alias("provider"), "doi")


@query("""SELECT page_id AS id, page_id % 3 = 0 AND trim(coalesce(url, '')) <> '' AS look_up_doi, page_id % 4 <> 0 AND trim(coalesce(text, '')) = '' AS look_up_abstract
 FROM pages LEFT JOIN documents ON doc_id = page_id""")
def selective_enrichment(t):
    rows = t.pages.join(t.documents, F.col("doc_id") == F.col("page_id"), "left")
    doi, abstract = enrich.wanted(F.when(F.col("page_id") % 3 != 0, "10.1/x"), F.col("url"), F.col("text"), F.when(F.col("page_id") % 4 == 0, F.col("url")))
    return rows.select(F.col("page_id").alias("id"), doi.alias("look_up_doi"), abstract.alias("look_up_abstract"))


@query("""SELECT lang AS venue, source AS year, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS with_doi, count(*) FILTER (WHERE trim(text) <> '') AS with_abstract,
 count(*) FILTER (WHERE url <> '') AS fetchable, round(count(*) FILTER (WHERE url <> '') * 100.0::DOUBLE / count(*), 1) AS fetchable_pct
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages ON page_id = d.doc_id GROUP BY ALL""")
def text_coverage(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("10.1/x").alias("doi"))
    papers = t.papers.join(good, "id", "left")
    return enrich.text_coverage(papers, t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("pdf_url")), "venue", "year")


@query("""SELECT doc_id AS paper_id, arg_min(url, (CASE WHEN contains(url, '.org') THEN 0 ELSE 1 END) * 1000000000 + page_id) AS url
 FROM pages JOIN documents ON doc_id = page_id % 40 WHERE trim(url) <> '' GROUP BY 1""")
def paper_urls(t):
    return enrich.paper_urls(t.pages.select((F.col("page_id") % 40).alias("paper_id"), "url", F.col("page_id").alias("ord")), t.papers, favoured=".org")


def _ledger(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as runs of customers' instances; nations are venues."""
    runs = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("instance_id"), F.col("event_type").alias("stage"), F.lit("completed").alias("status"))
    instances = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("venue_id"), F.col("c_mktsegment").alias("year"))
    return runs, instances, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("""SELECT event_id AS id, n_name AS venue, c_mktsegment AS year, event_type AS stage, 'completed' AS status
 FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey ORDER BY event_id DESC LIMIT 20""")
def recent_venue_runs(t):
    return ledger.recent(*_ledger(t))


@query("""WITH doomed AS (SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3' AND c_mktsegment = 'BUILDING' AND event_type = 'click'),
 lost AS (
  SELECT 'runs' AS "table", count(*) AS removed FROM doomed
  UNION ALL SELECT 'claims', count(*) FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM doomed)
  UNION ALL SELECT 'bibtex', count(*) FROM orders WHERE o_custkey IN (SELECT user_id FROM doomed)
  UNION ALL SELECT 'datasets', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT event_id FROM doomed))
 ) SELECT * FROM lost WHERE removed > 0""")
def prune_cascade(t):
    """Clicks as the stage that extracts; lines claim parts, orders are citations of customers' papers."""
    runs, instances, venues = _ledger(t)
    runs = runs.withColumn("stage", F.when(F.col("stage") == "click", "extract-datasets").otherwise(F.col("stage")))
    claims = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("dataset_id"))
    tables = {
        "runs": runs, "papers": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("instance_id")), "predictions": claims.select("run_id"), "claims": claims,
        "bibtex": t.orders.select(F.col("o_custkey").alias("paper_id")), "datasets": t.part.select(F.col("p_partkey").alias("id")), "texts": t.orders.select(F.col("o_custkey").alias("paper_id")),
    }
    gone = ledger.doomed(runs, instances, venues, "nation_3", "BUILDING", "extract-datasets")
    return ledger.removed(tables, ledger.pruned(tables, gone, "extract-datasets"))


@query("""SELECT l_orderkey AS claim, l_linenumber AS line, first_key AS dataset_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_name, min(p_partkey) AS first_key FROM part GROUP BY 1) USING (p_name)""")
def dataset_id_lookup(t):
    known = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    claims = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("line"), F.col("p_name").alias("name"))
    return ledger.with_id(claims, known, ["name"], "id", "dataset_id").select("claim", "line", "dataset_id")


@query("""SELECT p_brand AS venue, p_size AS year, CASE WHEN min(p_partkey) < 100 THEN min(p_partkey) END AS old_id, CAST(1 AS BIGINT) AS same FROM part GROUP BY ALL""")
def get_or_create(t):
    """Brands and sizes as venues and years; those of the first 100 parts have ids."""
    keys, rows = ["venue", "year"], t.part.select(F.col("p_brand").alias("venue"), F.col("p_size").alias("year"), "p_partkey")
    known = rows.where("p_partkey < 100").groupBy(*keys).agg(F.min("p_partkey").alias("id"))
    out = ledger.get_or_create(known, rows, keys)
    same = out.groupBy("id").agg(F.count("*").alias("same"))
    return out.join(same, "id").select(*keys, F.when(F.col("id") < 100, F.col("id")).alias("old_id"), "same")


_REGISTRY = ("brand#1", "brand#3")


@query("SELECT DISTINCT p_brand AS venue, p_size AS year FROM part ORDER BY lower(p_brand), p_size")
def venue_years(t):
    return ledger.venue_years(t.part.select(F.concat(F.lit(" "), "p_brand").alias("venue"), F.col("p_size").alias("year")))


@query(f"SELECT DISTINCT p_brand AS venue, p_size AS year, lower(p_brand) IN {_REGISTRY} AS ingestable FROM part")
def ingestable_venue_years(t):
    registry = t.region.limit(0).select(F.col("r_name").alias("venue")).unionByName(t.spark.createDataFrame([(v.upper(),) for v in _REGISTRY], "venue string"))
    good, rest = ledger.ingestable(ledger.venue_years(t.part.select(F.col("p_brand").alias("venue"), F.col("p_size").alias("year"))), registry)
    return good.withColumn("ingestable", F.lit(True)).unionByName(rest.withColumn("ingestable", F.lit(False)))


@query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def low_pass_papers(t):
    label = F.when(F.col("quality") == 0, "no").when(F.col("toxic") == 1, F.lit(None)).otherwise("maybe")
    return classify.to_extract(t.papers, t.labels.select(F.col("doc_id").alias("id"), label.alias("label"))).select("id")


@query("""SELECT doc_id AS id, coalesce(text, '') <> '' AND (source IS NULL OR source <> 'web') AS real FROM documents""")
def real_abstract(t):
    provider = F.when(F.col("source") == "web", "miss").otherwise(F.col("source"))
    return t.documents.select(F.col("doc_id").alias("id"), store.real_abstract(F.col("text"), provider).alias("real"))


@query("SELECT event_type AS section, count(*) AS entries FROM events WHERE event_type <> 'error' GROUP BY 1")
def cache_sections(t):
    cache = t.events.select(F.col("event_type").alias("section"), F.col("event_id").alias("key"))
    return store.sections(store.without_section(cache, "error", ("error", "click")))


@query(r"""SELECT 'Doc ' || doc_id AS "Bibtex Citation Key", CASE WHEN lang <> '' THEN 'doi:' || lang ELSE '' END AS "DOI Version of Key", source AS "Bibtex Citation" FROM documents""")
def extraction_bibtex(t):
    key = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    return writers.extraction_bibtex(t.documents.select(key.alias("bibtex_key"), F.col("lang").alias("doi"), F.col("source").alias("bibtex")))


@query(f"""WITH {_DATASETS}, one AS (SELECT name, arg_min(modalities, ord) AS modalities, arg_min(osi_layers, ord) AS osi_layers, arg_min(confidence, ord) AS confidence, count(*) AS n,
 coalesce(arg_min(key, ord) FILTER (WHERE relationship_type = 'introduced'), arg_min(key, ord)) AS key FROM d GROUP BY name)
 SELECT name AS "Dataset Name", key AS "Bibtex Citation Key", osi_layers AS "OSI Layer (L1-L7)", modalities AS "Modality(ies)", CASE WHEN confidence > 0.5 THEN 'Y' ELSE 'N' END AS "Availability (Open? Y/N)",
 '' AS "Availability URL", '' AS "Annotations on Availability", '' AS "Collection Environment", n AS "Number of Papers using Dataset" FROM one""")
def extraction_datasets(t):
    none = F.lit(None).cast("string")
    record = F.struct("name", "relationship_type", F.array("osi_layers").alias("osi_layers"), F.array("modalities").alias("modalities"), (F.col("confidence") > 0.5).alias("availability"), none.alias("availability_url"), none.alias("availability_notes"), none.alias("collection_environment"), F.lit(0).cast("bigint").alias("usage_count"))
    return writers.extraction_datasets(t.datasets.select("ord", F.col("key").alias("bibtex_key"), F.array(record).alias("datasets")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillspark.plans import changes, extracting, likeness, sql  # noqa: F401 (register their queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
