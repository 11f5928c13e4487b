"""Texts packed into containers of fixed capacity, with sources in target proportions in every stretch of containers.

Mixture-controlled packing by deficit round-robin. Each source has a queue. Every window (container) gives each source
its share of the capacity as credit; the container is filled from the source with the largest credit that still has
an item which fits, the largest such item first; what was taken is deducted. Credits that couldn't be spent are carried to the
next window, so sources keep to their shares over any stretch of containers although items are never split for that.

Documents are spread over packing partitions by the hash of their id, so a source with a third of all rows is in all of
them. A partition packs all it has, so the credits it ends with follow from its totals; those a partition begins with are
prefix sums over the partitions before, and all partitions run side by side. The emptiest containers of a partition are
taken apart and packed again together with those of others, level by level, with the credits that the containers closed so
far leave. A partition sends on no more than its part of one partition, so none grows, however badly items fit; what is
not sent on is closed as it is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.tokens import TOKENIZER, token_sizes
from quillspark.session import ship_package, written

#: More plans than this are refused; a plan is a line of configuration.
MAX_PLANS = 1000
PART_TOKENS = 4_000_000
FAN_IN = 64


def pack_queue(items: list[tuple[int, str, int]], capacity: int, shares: dict[str, float], credit: dict[str, float] | None = None) -> tuple[list[list[int]], dict[str, float]]:
    """Packs ``(key, source, size)`` with sizes up to ``capacity``. Lists of positions in ``items``, one per container, and the credits left."""
    queues: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, source, size) in enumerate(items):
        queues[source].append((size, i))
    keys = {}
    for source, q in queues.items():
        q.sort(key=lambda x: (x[0], items[x[1]][0]))
        keys[source] = [x[0] for x in q]
    credit = {s: float((credit or {}).get(s, 0.0)) for s in queues}
    out: list[list[int]] = []
    waiting = set(queues)
    while waiting:
        for s in waiting:
            credit[s] += shares.get(s, 0.0) * capacity
        room, box = capacity, []
        while room and waiting:
            for s in sorted(waiting, key=lambda s: (-credit[s], s)):
                at = bisect_right(keys[s], room) - 1
                if at >= 0:
                    break
            else:
                break
            size, i = queues[s].pop(at)
            keys[s].pop(at)
            box.append(i)
            room -= size
            credit[s] -= size
            if not queues[s]:
                waiting.discard(s)
        out.append(box)
    return out, credit


def _pack(level: int, last: bool, least: float, most: int):
    schema = ["plan_name", "capacity", "doc_id", "piece", "token_start", "tokens", "source", "bucket", "container", "place", "tail"]

    def work(key: tuple, rows: pd.DataFrame, credits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in schema})
        rows = rows.sort_values(["doc_id", "piece"], ignore_index=True)
        capacity = int(rows["capacity"].iloc[0])
        shares = dict(zip(credits["source"], credits["share"], strict=True))
        start = dict(zip(credits["source"], credits["credit"], strict=True))
        sizes = rows["tokens"].to_numpy()
        boxes, _ = pack_queue(list(zip(range(len(rows)), rows["source"], sizes.tolist(), strict=True)), capacity, shares, start)
        at, name, place, tail = [], [], [], []
        full = np.array([sizes[box].sum() for box in boxes])
        emptiest = np.argsort(full, kind="stable")
        again = np.zeros(len(boxes), bool)
        again[emptiest] = (full[emptiest] < least * capacity) & (np.cumsum(full[emptiest]) <= most)
        for k, box in enumerate(boxes):
            short = bool(again[k]) and not last
            at += box
            name += [f"{level}-{key[1]}-{k}"] * len(box)
            place += range(len(box))
            tail += [short] * len(box)
        out = rows.iloc[at].reset_index(drop=True)
        return out.assign(container=name, place=place, tail=tail)[schema]

    return work


def pack(documents: DataFrame, plans: DataFrame, targets: DataFrame | None = None, tokenizer: str = TOKENIZER, part_tokens: int = PART_TOKENS, least: float = 0.98) -> DataFrame:
    """``plan_name, container, place, doc_id, piece, token_start, tokens, source``: every text of at least one token in containers of each plan.

    ``container`` is unique within its plan. A text is one piece (0) unless it alone exceeds the capacity: then its first
    pieces fill a container each and the rest is an item like others. Sources keep to the shares in ``targets`` (source,
    target_share; relative to their sum, of repeated rows the greatest, null or not above 0 is none) as long as they last, without
    it to their own shares in all tokens. Rows of
    plans that are null, repeated or have no capacity of at least 1 are no plans. Empty and null texts need no room and
    don't come out; empty tables give no rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    rows = plans.where("plan_name is not null and capacity_tokens >= 1").groupBy("plan_name").agg(F.max("capacity_tokens").alias("capacity")).limit(MAX_PLANS + 1).collect()
    if len(rows) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans")
    schema = "plan_name string, container string, place int, doc_id long, piece int, token_start long, tokens long, source string"
    if not rows:
        return spark.createDataFrame([], schema)
    sizes = written(token_sizes(documents, tokenizer))
    by_source = written(sizes.groupBy("source").agg(F.sum("tokens").alias("t")))
    total = by_source.agg(F.sum("t")).head()[0] or 0
    parts = max(1, -(-total // part_tokens))
    shares = by_source.select("source", (F.col("t") / F.lit(float(max(total, 1)))).alias("share"))
    if targets is not None:
        wanted = targets.where("target_share > 0 and not isnan(target_share)").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("target_share").alias("w"))
        wanted = by_source.select("source").join(wanted, "source", "left")
        sum_w = wanted.agg(F.sum("w")).head()[0] or 1.0
        shares = written(wanted.select("source", (F.coalesce("w", F.lit(0.0)) / F.lit(float(sum_w))).alias("share")))
    listed = F.array(*[F.struct(F.lit(r[0]).alias("plan_name"), F.lit(int(r[1])).cast("long").alias("capacity")) for r in rows])
    items = sizes.select("doc_id", "source", F.col("tokens").alias("size"), F.inline(listed))
    pieces = items.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("capacity")))).alias("piece")).select(
        "plan_name", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).cast("long").alias("token_start"), F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).cast("long").alias("tokens"), "source", (F.col("size") > F.col("capacity")).alias("cut")
    )
    whole = pieces.where("cut and tokens = capacity").select("plan_name", F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("container"), F.lit(0).alias("place"), "doc_id", "piece", "token_start", "tokens", "source")
    todo = pieces.where("not (cut and tokens = capacity)").drop("cut").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    done, level = [whole], 0
    while True:
        last = parts == 1
        todo = written(todo)
        carried = written(_credits(todo, done[1:], shares))
        out = todo.groupBy("plan_name", "bucket").cogroup(carried.groupBy("of_plan", "of_bucket")).applyInPandas(
            _pack(level, last, least, part_tokens // FAN_IN), "plan_name string, capacity long, doc_id long, piece int, token_start long, tokens long, source string, bucket long, container string, place int, tail boolean"
        )
        out = written(out)
        done.append(out.where("not tail").select("plan_name", "container", "place", "doc_id", "piece", "token_start", "tokens", "source"))
        if last:
            break
        parts = -(-parts // FAN_IN)
        todo = out.where("tail").select("plan_name", "capacity", "doc_id", "piece", "token_start", "tokens", "source", F.floor(F.col("bucket") / F.lit(FAN_IN)).alias("bucket"))
        level += 1
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def _credits(todo: DataFrame, closed: list[DataFrame], shares: DataFrame) -> DataFrame:
    """``of_plan, of_bucket, source, share, credit``: what each source of a bucket begins with: its share of all tokens in containers closed at earlier levels and in the buckets before, less its own."""
    totals = todo.groupBy("plan_name", "bucket", "source").agg(F.sum("tokens").alias("t"))
    before = lambda *by: Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    buckets = totals.groupBy("plan_name", "bucket").agg(F.sum("t").alias("all"))
    buckets = buckets.select("plan_name", "bucket", zero(F.sum("all").over(before("plan_name"))).alias("all"))
    each = totals.withColumn("t", zero(F.sum("t").over(before("plan_name", "source")))).join(buckets, ["plan_name", "bucket"]).join(shares, "source")
    credit = F.col("share") * F.col("all") - F.col("t")
    if closed:
        packed = reduce(DataFrame.unionByName, [d.select("plan_name", "source", "tokens") for d in closed]).groupBy("plan_name", "source").agg(F.sum("tokens").alias("own"))
        sums = packed.groupBy("plan_name").agg(F.sum("own").alias("sum"))
        each = each.join(sums, "plan_name", "left").join(packed, ["plan_name", "source"], "left")
        credit = credit + F.col("share") * zero(F.col("sum")) - zero(F.col("own"))
    return each.select(F.col("plan_name").alias("of_plan"), F.col("bucket").alias("of_bucket"), "source", "share", credit.alias("credit"))


def fill_report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """``plan_name, capacity_tokens, containers, tokens, fill, mean_gap``: how full the containers of a plan are."""
    boxes = packed.groupBy("plan_name", "container").agg(F.sum("tokens").alias("t"))
    p = plans.where("plan_name is not null").groupBy("plan_name").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    sums = boxes.groupBy("plan_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return sums.join(p, "plan_name").select("plan_name", "capacity_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), (F.col("capacity_tokens") - F.col("tokens") / F.col("containers")).alias("mean_gap"))
