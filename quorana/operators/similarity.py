"""Set-similarity joins, leakage search and label clustering."""

from __future__ import annotations

import heapq
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorana.functions.text import word_shingles

CLUSTER_AT, NEAR_AT = 0.4, 0.8
#: Short items that are sought together.
FEW = 4096


def near_duplicates(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text: str, item_text: str, k: int = 3, at_least: float = NEAR_AT) -> DataFrame:
    """(text_id, item_id, jaccard) of the pairs whose k-word shingle sets are similar enough.

    Pairs meet on shared shingles, so nothing is compared that shares none; of the texts' shingles
    only those that an item has are shuffled, if the items' hashes are few enough to broadcast.
    Texts without words match nothing.
    """
    sets = lambda df, key, body, name: df.select(F.col(key), word_shingles(F.col(body), k).alias("_s")).select(key, F.size("_s").alias(f"_n_{name}"), F.explode("_s").alias("_g")).withColumn("_h", F.xxhash64("_g"))
    asked = sets(items, item_id, item_text, "i")
    both = sets(texts, text_id, text, "t").join(asked.select("_h").distinct(), "_h", "left_semi").join(asked.drop("_h"), "_g")
    shared = both.groupBy(text_id, item_id, "_n_t", "_n_i").agg(F.count("*").alias("_c"))
    return shared.withColumn("jaccard", F.col("_c") / (F.col("_n_t") + F.col("_n_i") - F.col("_c"))).where(F.col("jaccard") >= at_least).select(text_id, item_id, "jaccard")


def containing(texts: DataFrame, items: DataFrame, text_id: str, item_id: str, text: str, item_text: str, anchor: int = 3) -> DataFrame:
    """(text_id, item_id) where an item's text stands in a text word for word.

    Candidates share the item's first ``anchor`` words as a shingle. Items that are shorter than that
    are sought in one pass over the texts, FEW of them at a time, which bounds what is broadcast.
    """
    lead = lambda c: F.array_join(F.slice(F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0)), F.lit(2), F.lit(anchor)), " ")
    grams = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\S+"), F.lit(0))
    cut = F.get(F.transform(F.array(grams), lambda w: F.when(F.size(w) >= anchor, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - anchor + 1), lambda i: F.array_join(F.slice(w, i, F.lit(anchor)), " ")))).otherwise(F.array().cast("array<string>"))), F.lit(0))
    keyed = items.select(F.col(item_id), F.col(item_text).alias("_item"), lead(F.col(item_text)).alias("_g"), F.size(F.regexp_extract_all(F.col(item_text), F.lit(r"\S+"), F.lit(0))).alias("_n"))
    long = keyed.where(F.col("_n") >= anchor + 2)  # the last of the anchor words must be whole in the text as well
    found = texts.select(F.col(text_id), F.explode(cut).alias("_g")).join(long.select(item_id, "_g"), "_g").select(text_id, item_id).distinct()
    sure = found.join(texts.select(F.col(text_id), F.col(text).alias("_text")), text_id).join(long.select(item_id, "_item"), item_id).where(F.contains("_text", "_item")).select(text_id, item_id)
    short = keyed.where(F.col("_n") < anchor + 2).select(item_id, "_item")
    lists = short.groupBy((F.pmod(F.xxhash64(item_id), F.ceil(F.lit(short.count()) / FEW))).alias("_part")).agg(F.collect_list(F.struct(item_id, "_item")).alias("_items"))
    held = texts.select(F.col(text_id), F.col(text).alias("_text")).join(F.broadcast(lists)).select(text_id, F.filter("_items", lambda i: F.contains(F.col("_text"), i["_item"])).alias("_items"))
    few = held.select(text_id, F.explode("_items").alias("_i")).select(text_id, F.col(f"_i.{item_id}").alias(item_id))
    return sure.unionByName(few).distinct()


def label_pairs(labels: DataFrame, group: str, label: str, tokens: str) -> DataFrame:
    """(group, a, b, jaccard) of the labels of a group that share a token, a before b."""
    rows = labels.select(group, F.col(label), F.size(tokens).alias("n"), F.explode(tokens).alias("t"))
    left, right = rows.select(group, F.col(label).alias("a"), F.col("n").alias("n_a"), "t"), rows.select(group, F.col(label).alias("b"), F.col("n").alias("n_b"), "t")
    shared = left.join(right, [group, "t"]).where("a < b").groupBy(group, "a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    return shared.select(group, "a", "b", (F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c"))).alias("jaccard"))


def clusters(labels: DataFrame, group: str, label: str, tokens: str, at_least: float = CLUSTER_AT) -> DataFrame:
    """(group, label, representative, size, mean_similarity): average-linkage clusters of each group's labels.

    The most similar pair merges first, of equals the first in order, until no average reaches
    ``at_least``. A cluster is named by its shortest label, of equals the first. The sums of
    similarities between clusters add up when two merge, so a table of them and a heap of pairs
    give each next merge without looking at the labels again: n^2 log n for a group's n labels.
    A group is one division's labels, dozens in practice; the merging is sequential by definition.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        held = {name: frozenset(words if words is not None else ()) for name, words in zip(rows[label], rows[tokens], strict=True)}
        names = sorted(held)
        single = {(x, y): (len(held[x] & held[y]), len(held[x] | held[y])) for x, y in combinations(names, 2)}
        single = {pair: common / union if union else 0.0 for pair, (common, union) in single.items()}
        total = {a: {} for a in names}
        for (x, y), s in single.items():
            total[x][y] = total[y][x] = s
        members = {x: [x] for x in names}  # a cluster goes by its first label
        queue = [(-s, x, y, 1, 1) for (x, y), s in single.items() if s >= at_least]
        heapq.heapify(queue)
        while queue:
            _, x, y, size_x, size_y = heapq.heappop(queue)
            if len(members.get(x, ())) != size_x or len(members.get(y, ())) != size_y:
                continue  # one of the two has merged since
            members[x] += members.pop(y)
            gone = total.pop(y)
            del total[x][y]
            for z, s in gone.items():
                if z != x:
                    del total[z][y]
                    total[x][z] = total[z][x] = total[x][z] + s
                    mean = total[x][z] / (len(members[x]) * len(members[z]))
                    if mean >= at_least and mean > 0:
                        first, second = sorted((x, z))
                        heapq.heappush(queue, (-mean, first, second, len(members[first]), len(members[second])))
        between = lambda a, b: single[min(a, b), max(a, b)]
        out = []
        for group_members in members.values():
            name, n = min(group_members, key=lambda x: (len(x), x)), len(group_members)
            for x in group_members:
                mean = sum(between(x, y) for y in group_members if y != x) / (n - 1) if n > 1 else 1.0
                out.append((rows[group].iloc[0], x, name, n, mean))
        return pd.DataFrame(out, columns=[group, label, "representative", "size", "mean_similarity"])

    kind = dict(labels.dtypes)
    return labels.select(group, label, tokens).groupBy(group).applyInPandas(merge, f"`{group}` {kind[group]}, `{label}` string, representative string, size int, mean_similarity double")


def ruled(machine: DataFrame, rulings: DataFrame, group: str, label: str) -> DataFrame:
    """Machine clusters under reviewed rulings (group, label, representative): a ruled group's other labels stand alone."""
    reviewed = rulings.select(group).distinct().withColumn("_reviewed", F.lit(True))
    told = rulings.select(group, label, F.col("representative").alias("_told"))
    joined = machine.join(reviewed, group, "left").join(told, [group, label], "left")
    name = F.when(F.col("_reviewed").isNull(), F.col("representative")).otherwise(F.coalesce("_told", label))
    basis = F.when(F.col("_reviewed").isNull(), "machine_clustered").when(F.col("_told").isNotNull(), "argued_merge").otherwise("standalone_under_review")
    return joined.select(group, label, name.alias("representative"), basis.alias("basis"))
