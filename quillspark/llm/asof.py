"""As-of join with a tolerance: each event meets the latest order of its client at or before it.

Orders with one client and one time are collapsed first, to the one that wins and their number.
Then both tables are dealt into shards by client and time chunk.  An event's order lies in its own
chunk or is the last of an earlier chunk, so a chunk's halo is the last order of each chunk that the
tolerance reaches back to, and no more.  Each shard is one cogroup of Arrow batches that pyarrow's
``join_asof`` joins by client.

A client's chunks are as long as the tolerance.  Those of a client with many rows are halved until
its chunks are as many as its share of all shards, and its events are dealt over several shards at
``finest``, where they may still share one time; orders are copied to each of these.  Such clients
have more than one row in ``HEAVY`` of a table's, so they are 2 x ``HEAVY`` at most, whatever the
tables' size; nothing else reaches the driver.

Results for odd input: rows of ``events`` with a null id are no event and go; of several rows of an
id the least (time, client) counts, nulls last.  An event or order with a null client or time matches
nothing, and such events stay.  Among orders of one time the smaller priority wins, then the larger
id, null loses.  Orders' rows that repeat are orders each.  Other columns are ignored.  An empty
table of orders leaves all events unmatched; one of events gives no rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import scratch

HOUR = 3_600_000_000
HEAVY = 4096
SHARD = 50_000
FINEST = 10
MATCHED = "id bigint, client bigint, at bigint, order_id bigint, lag bigint, value bigint, n_tied bigint"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone; one without is taken for UTC."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return ((F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(c)) * 60 + F.minute(c)) * 60_000_000 + second


def floored(at: Column, step: int) -> Column:
    return at - F.pmod(at, F.lit(step))


def collapsed(orders: DataFrame) -> DataFrame:
    """One row for each client and time: the order that wins, its value, and how many there are.

    ``orders`` has ``client, at, order_id, priority, value``.
    """
    best = F.struct(F.col("priority").isNull(), F.col("priority"), F.col("order_id").isNull(), -F.col("order_id"), F.col("value").isNull(), F.col("value"), F.col("order_id"))
    found = orders.where("client IS NOT NULL AND at IS NOT NULL").groupBy("client", "at").agg(F.min(best).alias("best"), F.count("*").alias("n_tied"))
    return found.select("client", "at", F.col("best.order_id").alias("order_id"), F.col("best.value").alias("value"), "n_tied")


def shares(tables: list[DataFrame], heavy: int = HEAVY) -> tuple[int, dict[int, float]]:
    """All rows, and of each client that has more than one row in ``heavy`` of a table its share of all."""
    sizes = [t.count() for t in tables]
    found: dict[int, int] = {}
    for t, n in zip(tables, sizes):  # at most ``heavy`` clients have that many rows
        for r in t.where("client IS NOT NULL").groupBy("client").count().where(F.col("count") > n / heavy).collect():
            found[r["client"]] = found.get(r["client"], 0) + r["count"]
    rows = sum(sizes)
    return rows, {client: n / rows for client, n in found.items()}


def cuts(share: float, shards: int, chunks: int, finest: int = FINEST) -> tuple[int, int]:
    """(halvings of a client's chunks, shards to deal a chunk's events over) for its share of all rows."""
    more = max(0, math.ceil(math.log2(max(1.0, share * shards / chunks))))
    return min(more, finest), 1 << max(0, more - finest)


def cell(tolerance: int, halvings: int, ways: int) -> tuple[int, int, int]:
    """(length of a chunk, how many earlier chunks the tolerance reaches back to, ways)."""
    width = max(1, -(-tolerance >> halvings))
    return width, max(1, -(-tolerance // width)), ways


def join(events: DataFrame, orders: DataFrame, tolerance: int, shard: int = SHARD, heavy: int = HEAVY, finest: int = FINEST) -> DataFrame:
    """``id, client, at, order_id, lag, value, n_tied`` for each event; what is unmatched has nulls and 0.

    ``events`` has ``id, client, at``; ``orders`` what ``collapsed`` takes; times are 64-bit integers
    in the unit of ``tolerance``.  ``shard`` is the number of rows that a shard should have.
    """
    spark = events.sparkSession
    first = F.min(F.struct(F.col("at").isNull(), F.col("at"), F.col("client").isNull(), F.col("client"))).alias("e")
    asked = events.where("id IS NOT NULL").groupBy("id").agg(first).select("id", F.col("e.client").alias("client"), F.col("e.at").alias("at"))
    known = scratch.save(collapsed(orders), "orders")
    rows, share = shares([events.select("client"), known.select("client")], heavy)
    spread = known.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    chunks = 1 if spread["a"] is None else (spread["b"] - spread["a"]) // max(1, tolerance) + 1
    # many more shards than tasks, so that hashing deals them evenly
    shards = max(-(-rows // shard), 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = [(client, *cell(tolerance, *cuts(part, shards, chunks, finest))) for client, part in share.items()]
    table = F.broadcast(spark.createDataFrame(dealt, "client bigint, width bigint, reach bigint, ways int"))
    usual = dict(zip(("width", "reach", "ways"), cell(tolerance, 0, 1)))

    def placed(df: DataFrame) -> DataFrame:
        found = df.join(table, "client", "left").withColumns({c: F.coalesce(c, F.lit(n)) for c, n in usual.items()})
        return found.withColumn("chunk", F.expr("(at - pmod(at, width)) div width"))

    names = [c.split()[0] for c in MATCHED.split(", ")]
    number = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards))
    alone = F.col("client").isNull() | F.col("at").isNull()
    deal = F.when(alone, number("id")).otherwise(number("client", "chunk", F.pmod(F.xxhash64("id"), F.col("ways"))))
    left = placed(asked).select("id", "client", "at", deal.alias("shard"))
    cells = placed(known)
    told = F.struct("at", "order_id", "value", "n_tied")
    ends = cells.groupBy("client", "chunk", "reach", "ways").agg(F.max(told).alias("o"))
    reach = F.explode(F.sequence(F.col("chunk") + 1, F.col("chunk") + F.col("reach")))
    halo = ends.select("client", "ways", "o", reach.alias("chunk"))
    copies = cells.select("client", "ways", told.alias("o"), "chunk").unionByName(halo)
    each = copies.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    right = each.select("client", "o.*", number("client", "chunk", F.col("way").cast("bigint")).alias("shard"))

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        usable = pc.and_(asked["client"].is_valid(), asked["at"].is_valid())
        mine, rest = asked.filter(usable), asked.filter(pc.invert(usable))
        # the join's keys are not to be negative
        least = min([t for t in (pc.min(mine["at"]).as_py(), pc.min(known["at"]).as_py()) if t is not None], default=0)
        mine, known = (t.append_column("on", pc.subtract(t["at"], least)).sort_by("on") for t in (mine, known))
        known = known.select(["on", "client", "at", "order_id", "value", "n_tied"]).rename_columns(["on", "client", "order_at", *names[3:4], *names[5:]])
        found = mine.join_asof(known, on="on", by="client", tolerance=-tolerance)
        lag = pc.subtract(found["at"], found["order_at"])
        out = [found["id"], found["client"], found["at"], found["order_id"], lag, found["value"], found["n_tied"].fill_null(0)]
        none = pa.nulls(len(rest), pa.int64())
        other = [rest["id"], rest["client"], rest["at"], none, none, none, none.fill_null(0)]
        return pa.concat_tables([pa.table(out, names), pa.table(other, names)])

    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(run, MATCHED)


def clicks_with_orders(clicks: DataFrame, sales: DataFrame, step: int = HOUR, tolerance: int = 240 * HOUR) -> DataFrame:
    """Each click with the latest sale of its client; the times of half of both are floored to ``step``,
    and two sales of three stand for a second order of the same time."""
    code = lambda c: F.crc32(F.col(c).cast("string").cast("binary"))

    def used(df: DataFrame, key: str, time: str) -> Column:
        return F.when(code(key) % 2 == 1, floored(micros(df, time), step)).otherwise(micros(df, time))

    events = clicks.select(F.col("click_id").cast("bigint").alias("id"), F.col("client_id").cast("bigint").alias("client"), used(clicks, "click_id", "ts").alias("at"))
    cents = F.floor(100 * F.nanvl(F.col("total").cast("double"), F.lit(None).cast("double")) + 0.5)
    base = sales.select(F.col("sale_id").cast("bigint").alias("sale_id"), F.col("client_id").cast("bigint").alias("client"), used(sales, "sale_id", "sold_at").alias("at"), F.col("priority").cast("bigint").alias("p"), cents.alias("value"), (code("sale_id") % 3 != 0).alias("twice"))
    own, twin = F.struct(F.col("sale_id").alias("order_id"), F.col("p").alias("priority")), F.struct((-1 - F.col("sale_id")).alias("order_id"), (6 - F.col("p")).alias("priority"))
    orders = base.withColumn("o", F.explode(F.when(F.col("twice"), F.array(own, twin)).otherwise(F.array(own)))).select("client", "at", "o.*", "value")
    found = join(events, orders, tolerance)
    return found.toDF("click_id", "client_id", "ts_us", "sale_id", "lag_us", "total_cents", "n_tied")
