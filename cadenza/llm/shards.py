"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked where their texts are equal. The first labels deal all documents out evenly by a hash. In each
round every text takes up the label most common among its documents, of those shards that have not refused it (copies
have the same neighbours, so a row stands for all of them); of labels with equal counts a hash names the one. A shard
takes the texts that ask for it largest first, of one size those it has already, as long as they fit whole; the others
are refused and ask elsewhere in the next round, which may push out smaller ones there. Rounds end when nothing is
refused; each refusal is final, so they do end. A text with more documents than a shard has places asks in parts of a
shard's size. What every shard has refused is planned into the places left: whole where that has become possible, else
over the shards with most room; at most one text a shard is split so. Unlinked documents keep their first label but
for those that make room. A group of copies is never gathered: rounds work on counts per text and shard, plans on
counts of texts per size, and ranks come from bucketed running sums, so a group of a third of all rows is spread over
tasks.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate, count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.prefix import running
from cadenza.llm.workspace import Workspace

FREE = -1


def plan(groups: dict[int, int], room: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, list[tuple[int, int]]]], list[int]]:
    """Places for ``groups`` (number of groups by size) in shards with ``room``.

    (size, first, last + 1, shard) of groups that stay whole, numbered within their size; (size, number, (shard,
    documents) of its parts) of groups that no shard has room for; and the places left.
    """
    left, whole, split = list(room), [], []
    for n in sorted(groups, reverse=True):
        turn = 0
        for j in range(len(left)):
            k = min(left[j] // n, groups[n] - turn)
            if k:
                whole.append((n, turn, turn + k, j))
                left[j] -= k * n
                turn += k
        while turn < groups[n]:
            parts, more = [], n
            for j in sorted(range(len(left)), key=lambda j: -left[j]):
                k = min(more, left[j])
                if k:
                    parts.append((j, k))
                    left[j] -= k
                    more -= k
            split.append((n, turn, parts))
            turn += 1
    return whole, split, left


def quotas(wish: dict[tuple[int, int], int], free: list[int], shards: int) -> tuple[dict[tuple[int, int], int], dict[int, list[tuple[int, int]]]]:
    """(admitted moves per pair of shards; per shard the (destination, number) of unlinked documents that make room).

    Wishes into a shard are cut until what enters it is at most what leaves it plus its unlinked documents; then
    every shard ends with as many documents as it had.
    """
    take = dict(wish)
    net = lambda j: sum(n for (a, b), n in take.items() if b == j) - sum(n for (a, b), n in take.items() if a == j)
    changed = True
    while changed:
        changed = False
        for j in range(shards):
            over = net(j) - free[j]
            for pair in sorted((p for p in take if p[1] == j), key=lambda p: take[p]):
                if over <= 0:
                    break
                cut = min(over, take[pair])
                take[pair] -= cut
                over -= cut
                changed = changed or cut > 0
    leave: dict[int, list[tuple[int, int]]] = {}
    room = {j: -net(j) for j in range(shards) if net(j) < 0}
    for j in range(shards):
        more = net(j)
        for k in sorted(room):
            if more <= 0:
                break
            n = min(more, room[k])
            if n > 0:
                leave.setdefault(j, []).append((k, n))
                room[k] -= n
                more -= n
    return take, leave


def admit(asked: dict[tuple[int, int, bool], int], room: list[int]) -> tuple[dict[tuple[int, int, bool], int], list[int]]:
    """(number taken by (size, shard, whether it has them already), places left) of the groups that ask for each shard."""
    left, taken = list(room), {}
    for n, j, held in sorted(asked, key=lambda a: (-a[0], a[1], not a[2])):
        taken[n, j, held] = min(asked[n, j, held], left[j] // n)
        left[j] -= n * taken[n, j, held]
    return taken, left


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers, without Python workers."""
    names = [c.split(":")[0] for c in re.split(r",(?![^<]*>)", schema)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{schema}>>")))


def propagate(texts: DataFrame, room: list[int], ws: Workspace) -> tuple[DataFrame, list[int]]:
    """``texts`` (link, part, n, votes: documents per shard) with ``ask``, the shard that takes each, null where none does; places left."""
    own = ["n", "ask", "held"]
    votes = F.col("votes")
    best = F.array_max(F.array(*[F.when(votes[j].isNotNull(), F.struct(votes[j].alias("n"), F.xxhash64("link", "part", F.lit(j)).alias("tie"), F.lit(j).alias("s"))) for j in range(len(room))]))
    texts = texts.withColumn("held", F.lit(False))
    for k in count(1):
        asking = ws.table(f"asking-{k}", texts.withColumn("ask", best["s"]))
        ws.drop(f"asking-{k - 1}")
        asked = {(r["n"], r["ask"], r["held"]): r["texts"] for r in asking.where("ask IS NOT NULL").groupBy(*own).agg(F.count("*").alias("texts")).collect()}  # at most two rows per size and shard
        taken, left = admit(asked, room)
        short = [(*key, taken[key]) for key in asked if taken[key] < asked[key]]
        if not short:
            return asking.drop("votes", "held"), left
        few = F.broadcast(table(asking.sparkSession, short, "n:bigint,ask:int,held:boolean,taken:bigint"))
        ranked, _ = running(asking.join(few, own), own, F.xxhash64("link", "part"), F.lit(1), "turn", sum(asked.values()), ws, f"asking-sums-{k}")
        refused = F.col("turn") >= F.col("taken")
        without = F.transform(votes, lambda v, j: F.when(j != F.col("ask"), v))
        ranked = ranked.select("link", "part", "n", F.when(refused, without).otherwise(votes).alias("votes"), (~refused).alias("held"))
        texts = ranked.unionByName(asking.join(few, own, "left_anti").select("link", "part", "n", "votes", F.col("ask").isNotNull().alias("held")))


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards differ by at most one. size is the text's UTF-8 bytes plus 1; a null
    text has no bytes and is linked with empty texts; a long text counts as one document like others. Repeated rows
    and rows without an id are placed each. slot is gapless from 0 in each shard, by a hash of the row. grown_shard
    belongs to another law and is null. Other columns of any name are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("link"), F.monotonically_increasing_id().alias("rid"))
    narrow = ws.table("narrow", rows.withColumn("all", F.lit(0)))
    total = narrow.count()
    dealt, _ = running(narrow, ["all"], F.xxhash64("rid"), F.lit(1), "turn", total, ws, "start-sums")
    state = ws.table("state", dealt.withColumn("shard", (F.col("turn") % shards).cast("int")).drop("all", "turn"))
    ws.drop("narrow")
    room, most = [total // shards + (j < total % shards) for j in range(shards)], max(1, total // shards)
    many = state.groupBy("link").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.col("shard") == j) for j in range(shards)]).alias("votes")).where("n > 1")
    texts = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / most).cast("int")))).withColumn("n", F.least(F.lit(most).cast("long"), F.col("n") - F.col("part") * F.lit(most).cast("long")))
    asking, left = propagate(texts, room, ws)
    held = asking.where("ask IS NOT NULL").select("link", "part", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.col("ask").alias("s"))).alias("pieces"))
    refused = asking.where("ask IS NULL")
    groups = {r["n"]: r["texts"] for r in refused.groupBy("n").agg(F.count("*").alias("texts")).collect()}  # a row per size: less than sqrt(2 * total)
    if groups:
        whole, split, left = plan(groups, left)
        places = [(n, a, b, [{"a": 0, "b": n, "s": j}]) for n, a, b, j in whole]
        for n, turn, parts in split:
            ends = list(accumulate(k for _, k in parts))
            places.append((n, turn, turn + 1, [{"a": b - k, "b": b, "s": j} for b, (j, k) in zip(ends, parts, strict=True)]))
        planned = F.broadcast(table(spark, places, "n:bigint,first:bigint,last:bigint,pieces:array<struct<a:bigint,b:bigint,s:int>>"))
        numbered, _ = running(refused, ["n"], F.xxhash64("link", "part"), F.lit(1), "turn", sum(groups.values()), ws, "plan-sums")
        held = held.unionByName(numbered.join(planned, "n").where("turn >= first AND turn < last").select("link", "part", "pieces"))
    before = F.col("part") * F.lit(most).cast("long")
    pieces = held.select("link", F.transform("pieces", lambda p: F.struct((before + p["a"]).alias("a"), (before + p["b"]).alias("b"), p["s"].alias("s"))).alias("pieces"))
    goals = ws.table("goals", pieces.groupBy("link").agg(F.flatten(F.collect_list("pieces")).alias("pieces")))  # a text has a piece, few have up to two per shard
    several = F.broadcast(goals.where(F.size("pieces") > 1))
    spread, _ = running(state.join(several, "link"), ["link"], F.xxhash64("rid"), F.lit(1), "turn", total, ws, "piece-sums")
    turn = F.col("turn")
    spread = spread.withColumn("want", F.filter("pieces", lambda p: (p["a"] <= turn) & (turn < p["b"]))[0]["s"]).drop("pieces", "turn")
    one = goals.where(F.size("pieces") == 1).select("link", F.col("pieces")[0]["s"].alias("want"))
    others = state.join(several, "link", "left_anti").join(one, "link", "left").withColumn("want", F.coalesce("want", F.lit(FREE)))
    moving = ws.table("moving", spread.unionByName(others).drop("link"))
    ws.drop("state")
    asked = {(r["shard"], r["want"]): r["n"] for r in moving.groupBy("shard", "want").agg(F.count("*").alias("n")).collect()}  # at most shards * (shards + 1) rows
    wish = {(a, b): n for (a, b), n in asked.items() if b not in (a, FREE)}
    take, leave = quotas(wish, [asked.get((j, FREE), 0) for j in range(shards)], shards)
    if take != wish:  # the goals fit all shards, so nothing is cut
        raise AssertionError("goals exceed the places of a shard")
    loose, _ = running(moving.where(F.col("want") == FREE), ["shard"], F.xxhash64("rid"), F.lit(1), "turn", total, ws, "leave-sums")
    to = F.col("shard")
    for a, out in leave.items():
        first = 0
        for b, n in out:
            to = F.when((F.col("shard") == a) & (F.col("turn") >= first) & (F.col("turn") < first + n), F.lit(b)).otherwise(to)
            first += n
    columns = ["doc_id", "size", "text_crc32", "rid", "shard"]
    state = ws.table("placed", loose.withColumn("shard", to).select(*columns).unionByName(moving.where(F.col("want") != FREE).withColumn("shard", F.col("want")).select(*columns)))
    ws.drop("moving")
    slots, _ = running(state, ["shard"], F.xxhash64("rid"), F.lit(1), "slot", total, ws, "slot-sums")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
