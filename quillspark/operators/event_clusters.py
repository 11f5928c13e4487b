"""Greedy event clusters of labelled, embedded article versions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import GENERIC_ENTITIES, event_entities, label_tokens
from quillspark.operators.latest import latest_by, newest_signals
from quillspark.session import ship_package


def candidates(articles: DataFrame, signals: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Versions that have an article, labels and a vector, newest of each by content."""
    a = latest_by(articles, ["content_sha256"], [F.col("fetched_at").desc(), F.col("snapshot_id").desc()]).select("content_sha256", "story_id", "canonical_url", "title", "fetched_at")
    s = newest_signals(signals).select("content_sha256", "topic", "themes", "event_label", "event_type", "named_entities")
    e = latest_by(embeddings, ["content_sha256"], [F.col("generated_at").desc(), F.xxhash64("embedding").desc()]).select("content_sha256", "embedding")
    return a.join(s, "content_sha256").join(e, "content_sha256")


def _greedy(window_us: int, strong: float, supported: float):
    """Assigns versions in time order to the most similar matching anchor. The state of one event type: its anchors and the cluster of each story."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = object()
        anchors: list[dict] = []
        story: dict[str, int] = {}
        by_key: dict[str, list[int]] = defaultdict(list)
        for b in batches:
            anchor_of, sims = [], []
            for t, sha, sid, us, label, names, v in zip(b["founder_type"], b["content_sha256"], b["story_id"], b["us"], b["label"], b["names"], b["embedding"], strict=True):
                if t != kind:
                    kind, anchors, story, by_key = t, [], {}, defaultdict(list)
                x = np.asarray(v, np.float32)
                x = x / max(np.linalg.norm(x), np.finfo(np.float32).eps)
                label, names = frozenset(label), frozenset(names)
                best, score = story.get(sid), -1.0
                if best is None:
                    keys = [f"e{n}" for n in names] + [f"l{w}" for w in label]
                    for k in keys:  # what is too old leaves the lists until its story is seen again
                        if any(anchors[c]["last"] < us - window_us for c in by_key.get(k, ())):
                            for c in by_key[k]:
                                if anchors[c]["last"] < us - window_us:
                                    anchors[c]["out"].append(k)
                            by_key[k] = [c for c in by_key[k] if anchors[c]["last"] >= us - window_us]
                    for c in sorted({c for k in keys for c in by_key.get(k, ())}):
                        a = anchors[c]
                        if len(a["x"]) != len(x):
                            continue
                        s = float(x @ a["x"])
                        if s <= score:
                            continue
                        shared = bool(names & a["names"])
                        overlap = len(label & a["label"]) / len(label | a["label"]) if label and a["label"] else 0.0
                        if (s >= strong and (shared or overlap >= 0.25)) or (s >= supported and shared and overlap >= 0.35):
                            best, score = c, s
                    if best is None:
                        best = len(anchors)
                        anchors.append({"x": x, "names": names, "label": label, "last": us, "sha": sha, "out": []})
                        for k in keys:
                            by_key[k].append(best)
                    story[sid] = best
                a = anchors[best]
                a["last"] = us
                for k in a["out"]:
                    by_key[k].append(best)
                a["out"].clear()
                anchor_of.append(a["sha"])
                sims.append(float(x @ a["x"]) if len(a["x"]) == len(x) else None)
            yield pd.DataFrame({"content_sha256": b["content_sha256"], "anchor": anchor_of, "similarity_to_anchor": sims})

    return run


def cluster_events(articles: DataFrame, signals: DataFrame, embeddings: DataFrame, window_days: int = 45, strong: float = 0.88, supported: float = 0.80, generic: list[str] = GENERIC_ENTITIES) -> DataFrame:
    """One row per clustered version, with its cluster's label, size and its similarity to the anchor (the first member).

    A version joins the most similar cluster of its event type whose latest member is at most ``window_days`` older and
    whose anchor agrees in vector and in entities or label; later versions of a story follow it. The result depends on
    order within an event type, so each is one stream through one task, in order of (fetched_at, content); a task keeps the
    anchors and story numbers of one event type, not its rows. Ties go to the earlier cluster.
    """
    ship_package(articles.sparkSession)
    rows = candidates(articles, signals, embeddings)
    first = Window.partitionBy("story_id").orderBy("fetched_at", "content_sha256")
    rows = rows.withColumn("founder_type", F.first(F.coalesce("event_type", F.lit("None"))).over(first))
    slim = rows.select("founder_type", "content_sha256", "story_id", F.unix_micros("fetched_at").alias("us"), label_tokens(F.col("event_label")).alias("label"), event_entities(F.col("named_entities"), generic).alias("names"), "embedding")
    ordered = slim.repartition("founder_type").sortWithinPartitions("founder_type", "us", "content_sha256")
    placed = ordered.mapInPandas(_greedy(window_days * 86_400_000_000, strong, supported), "content_sha256 string, anchor string, similarity_to_anchor float")
    full = rows.drop("embedding", "founder_type").join(placed, "content_sha256")
    labels = full.groupBy("anchor", "event_label").agg(F.count("*").alias("n"), F.min(F.struct("fetched_at", "content_sha256")).alias("seen"))
    top = latest_by(labels, ["anchor"], [F.col("n").desc(), F.col("seen").asc()]).select("anchor", F.col("event_label").alias("cluster_label"))
    size = labels.groupBy("anchor").agg(F.sum("n").cast("int").alias("cluster_size"))
    out = full.join(top.join(size, "anchor"), "anchor")
    return out.select(
        F.concat(F.lit("event-"), F.substring(F.sha2("anchor", 256), 1, 16)).alias("cluster_id"), "cluster_label", "cluster_size", "content_sha256", "story_id", "canonical_url", "title",
        "fetched_at", "topic", "themes", "event_label", "event_type", "named_entities", "similarity_to_anchor",
    )


def blocking_keys(signals: DataFrame, generic: list[str] = GENERIC_ENTITIES) -> DataFrame:
    """``event_type, key, contents``: the inverted index that clusters are looked up by, with the length of its lists."""
    s = newest_signals(signals)
    names = F.transform(event_entities(F.col("named_entities"), generic), lambda x: F.concat(F.lit("e:"), x))
    words = F.transform(label_tokens(F.col("event_label")), lambda x: F.concat(F.lit("l:"), x))
    return s.select("event_type", F.explode(F.array_union(names, words)).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("contents"))
