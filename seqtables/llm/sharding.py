"""Operator 4: shards by balanced label propagation, DataFrame functions only.

Documents are linked through hubs: rows with the same hub key belong together (equal texts; for any
other graph, each edge is a hub with two rows). Every row starts in a shard by its hash. In a round
each hub sees how many of its rows sit in each shard and calls the others to the fullest one that
still has room; a row follows if that leaves no fewer neighbours beside it. A shard's quota of linked
rows is its even share, and it accepts at most the rows it has room for: calls are counted in bins of the hub's hash, so a hub moves as
a whole, and the bin that no longer fits is taken in part. Only rows of hubs with two or more rows move,
and only counts by hub, shard or bin are exchanged to decide.

At the end the counts are made even to one row: from shards above their share the last rows, unlinked
ones before linked ones, go to shards below it. One grouped rank gives the choice and the gapless slots.

Defined results: a null text is the empty text; a null id is a row like any other; repeated rows are
linked and stay separate rows; a hub larger than a shard fills shards one after another; an empty
table gives no rows; with fewer rows than shards some shards stay empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtables.llm.tables import stored
from seqtables.operators.ranking import grouped_row_number

SHARDS = 24
ROUNDS = 4
BINS = 512


def uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def even_shares(counts: dict[int, int], shards: int) -> dict[int, int]:
    """Final rows of each shard, at most one apart; the fuller shards get the larger share."""
    base, more = divmod(sum(counts.values()), shards)
    order = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    return {s: base + (i < more) for i, s in enumerate(order)}


def shard_counts(rows: DataFrame) -> dict[int, int]:
    """Rows by shard: as many numbers as shards."""
    found = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["shard"]: r["n"] for r in found}


def propagation_round(linked: DataFrame, room: dict[int, int], number: int) -> DataFrame:
    """``linked`` (with ``hub`` and ``shard``) after the moves of one round."""
    spark = linked.sparkSession
    rooms = spark.createDataFrame(sorted(room.items()), "shard int, room long")
    seats = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    best = (
        seats.join(F.broadcast(rooms.filter("room > 0")), "shard")
        .groupBy("hub")
        .agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("top"))
        .select("hub", (-F.col("top.s")).alias("to"), F.col("top.n").alias("n_to"))
    )
    calls = (
        seats.join(best, "hub")
        .filter((F.col("to") != F.col("shard")) & (F.col("n_to") >= F.col("n")))
        .select("hub", "shard", "n", "to")
        .withColumn("bin", F.pmod(F.xxhash64("hub", F.lit(number)), F.lit(BINS)))
    )
    calls = stored(calls, "shard-calls")
    # Calls by target and bin, at most shards x BINS rows; the sums run along the bins of a shard.
    asked = calls.groupBy("to", "bin").agg(F.sum("n").alias("asked"))
    before = Window.partitionBy("to").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = asked.withColumn("ahead", F.coalesce(F.sum("asked").over(before), F.lit(0)))
    share = (F.col("room") - F.col("ahead")) / F.col("asked")
    accepted = (
        sums.join(F.broadcast(rooms.withColumnRenamed("shard", "to")), "to")
        .select("to", "bin", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("share"))
        .filter("share > 0")
    )
    moves = calls.join(accepted, ["to", "bin"]).select("hub", "shard", "to", "share")
    follow = F.col("to").isNotNull() & (uniform(F.col("row_hash"), F.lit(number)) < F.col("share"))
    return linked.join(moves, ["hub", "shard"], "left").select(
        *[c for c in linked.columns if c != "shard"],
        F.when(follow, F.col("to")).otherwise(F.col("shard")).alias("shard"),
    )


def even_out(rows: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: counts at most one apart, slots gapless from 0."""
    spark = rows.sparkSession
    counts = shard_counts(rows)
    shares = even_shares(counts, shards)
    lines, over, under = [], 0, 0
    for s in range(shards):
        have, share = counts.get(s, 0), shares[s]
        lines.append((s, share, over, have, under, under + max(0, share - have)))
        over += max(0, have - share)
        under += max(0, share - have)
    names = "shard int, share long, over long, have long, lo long, hi long"
    plan = spark.createDataFrame(lines, names)
    ranked = grouped_row_number(rows, ["shard"], order, "slot")
    placed = ranked.join(F.broadcast(plan.select("shard", "share", "over")), "shard")
    stay = placed.filter("slot < share").drop("share", "over")
    index = (F.col("over") + F.col("slot") - F.col("share")).alias("index")
    moved = placed.filter("slot >= share").select(*[c for c in stay.columns if c not in ("shard", "slot")], index)
    # One row for each shard that lacks rows.
    gaps = plan.filter("hi > lo").select(F.col("shard"), "have", "lo", "hi")
    target = (F.col("index") >= F.col("lo")) & (F.col("index") < F.col("hi"))
    came = moved.join(F.broadcast(gaps), target).withColumn("slot", F.col("have") + F.col("index") - F.col("lo"))
    return stay.unionByName(came.select(*stay.columns))


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (with a ``hub`` and a ``row_hash``) with ``shard`` and ``slot``."""
    start = rows.withColumn("shard", F.pmod(F.xxhash64("row_hash"), F.lit(shards)).cast("int"))
    # Stored, so that the join shuffles plain rows and a partition with a hot hub can be split.
    hubs = stored(
        rows.groupBy("hub").agg(F.count(F.lit(1)).alias("hub_rows")).filter("hub_rows > 1"), "hubs"
    )
    marked = stored(
        start.join(hubs, "hub", "left").withColumn("hub_rows", F.coalesce("hub_rows", F.lit(1))),
        "shard-rows",
    )
    linked = marked.filter("hub_rows > 1")
    loose = marked.filter("hub_rows = 1")
    # Rows without links make way at the end at no cost, so linked rows alone fill the quota.
    quota = marked.count() // shards
    for number in range(rounds):
        now = shard_counts(linked)
        room = {s: quota - now.get(s, 0) for s in range(shards)}
        linked = stored(propagation_round(linked, room, number), "shard-round")
    settled = linked.unionByName(loose.select(*linked.columns)).select(
        "*", (F.col("hub_rows") == 1).alias("loose"), F.xxhash64("hub").alias("hub_order")
    )
    done = even_out(settled, shards, ["loose", "hub_order", "row_hash"])
    return done.drop("loose", "hub_order", "hub_rows")


def shard_documents(
    docs: DataFrame, row_id: str, text: str, shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """``(row_id, size, text_crc32, shard, slot)``; equal texts are linked, counts are even."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    named = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    rows = stored(
        named.select(
            "row_id",
            (F.octet_length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("hub"),
        ).withColumn("row_hash", F.xxhash64("row_id", "text_crc32", "size")),
        "document-rows",
    )
    found = balanced_shards(rows, shards, rounds)
    return found.select("row_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
