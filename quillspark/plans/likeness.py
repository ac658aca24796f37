"""Registered queries of likeness between two catalogues: clients of one source and of the others."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.functions import similarity
from quillspark.operators import alike, match
from quillspark.plans.catalogue import query


@F.arrow_udf(LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(similarity.common(a.to_pylist(), b.to_pylist()))


def _catalogues(t):
    names = t.clients.select(F.col("client_id").alias("id"), "nation_id", "city", "source", F.lower("name").alias("title"), F.lower("email").alias("doi"), F.col("client_id").alias("ord"))
    return names.where("source = 'crm'"), names.where("source <> 'crm'")


@query("""WITH n AS (SELECT DISTINCT nation_id, city, source = 'crm' AS mine, lower(name) AS name, string_split(lower(name), '') AS chars FROM clients WHERE source IS NOT NULL AND name <> ''),
 p AS (SELECT l.nation_id, l.city, l.name AS left_name, r.name AS right_name, l.chars AS a, r.chars AS b FROM n l JOIN n r ON l.nation_id = r.nation_id AND l.city = r.city AND l.mine AND NOT r.mine),
 s AS (SELECT *, CAST(list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, greatest(acc[j], row[j + 1], row[j] + CASE WHEN x = b[j] THEN 1 ELSE 0 END)), [CAST(0 AS BIGINT)]),
   list_transform(range(0, len(b) + 1), lambda i: CAST(0 AS BIGINT)))[len(b) + 1] AS BIGINT) AS shared FROM p)
 SELECT nation_id, city, left_name, right_name, shared FROM s WHERE 2 * shared >= 0.8 * (len(a) + len(b)) - 1e-9""")
def close_names(t):
    """Names of two catalogues in one city that share so many characters in order that they may be one name."""
    left, right = (d.select("nation_id", "city", F.col("title").alias("text")) for d in _catalogues(t))
    keys = ["nation_id", "city"]
    equal = left.where("text <> ''").distinct().join(right.distinct().hint("merge"), [*keys, "text"]).select(*keys, F.col("text").alias("left"), F.col("text").alias("right"))
    met = alike.candidates(left, right, keys, 0.8).unionByName(equal).withColumn("shared", _common("left", "right"))
    near = met.where(2 * F.col("shared") >= 0.8 * (F.length("left") + F.length("right")) - 1e-9)
    return near.select(*keys, F.col("left").alias("left_name"), F.col("right").alias("right_name"), "shared")


@query()
def client_cascade(t):
    """One-to-one matches of two catalogues of clients in one city: by e-mail, by name, by likeness."""
    return match.cascade(*_catalogues(t), ["nation_id", "city"], 0.85)
