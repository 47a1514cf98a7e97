"""Connected components and multi-view tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import with_ranks
from .shared import cut


#: Rows of one key from which a join tells them by broadcast, so that no task holds them all.
HEAVY = 100_000


def looked_up(rows: DataFrame, key: str, told: DataFrame) -> DataFrame:
    """``rows`` with far (null where none), joined by ``key`` with told: via (each once) and far.

    Keys of over HEAVY rows, one for each HEAVY rows at most, are broadcast: their rows stay where they are."""
    heavy = cut(rows.groupBy(F.col(key).alias("via")).agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("via"))
    if heavy.isEmpty():
        return rows.join(told, F.col(key) == F.col("via"), "left").drop("via")
    known = F.broadcast(heavy.join(told, "via", "left"))
    many = rows.join(known, F.col(key) == F.col("via")).drop("via")
    few = rows.join(F.broadcast(heavy), F.col(key) == F.col("via"), "left_anti")
    return many.unionByName(few.join(told, F.col(key) == F.col("via"), "left").drop("via"))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a and b of any ordered type.  Returns node and component (the smallest
    node that it reaches).

    In each round every node goes to its smallest neighbour, if that is smaller; following these
    steps to their ends gives roots, and the edges between different roots are the next round's.
    At least half of the nodes aren't roots, so rounds and their edges shrink fast."""
    pairs = edges.select("a", "b").filter("a is not null and b is not null")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    found: list[DataFrame] = []
    while True:
        steps = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
        while True:  # steps of steps, until all are roots
            far = steps.select(F.col("node").alias("via"), F.col("root").alias("far"))
            steps = cut(looked_up(steps, "root", far).select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            if steps.filter("moved").isEmpty():
                break
            steps = steps.drop("moved")
        steps = steps.drop("moved")
        found.append(steps)
        ends = [steps.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab"]
        both = cut(both.filter("a <> b").join(ends[0], "a").join(ends[1], "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
        if both.isEmpty():
            break
    labels = found.pop()
    while found:  # roots of a round are nodes of the next, if they have edges there
        later = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        labels = cut(looked_up(found.pop(), "root", later).select("node", F.coalesce("far", "root").alias("root")))
    return labels.withColumnRenamed("root", "component")


def tracks(matches: DataFrame, min_length: int = 2) -> DataFrame:
    """Components of the graph of keypoints.  ``matches``: image_a, kp_a, image_b, kp_b.

    Components with two keypoints of one image, and short ones, are left out.  Returns
    track_id (numbered by first keypoint), image_id and kp_idx."""
    ids = [F.col(f"{c}_{s}").cast("long").alias(f"{c}_{s}") for c in ("image", "kp") for s in "ab"]
    matches = cut(matches.select(*ids))
    least, most = (F.min, F.least), (F.max, F.greatest)
    ends = matches.agg(*[f(w(f"{c}_a", f"{c}_b")) for c in ("image", "kp") for f, w in (least, most)]).first()
    packs = None not in ends and 0 <= ends[0] and ends[1] < 1 << 22 and 0 <= ends[2] and ends[3] < 1 << 40
    node = lambda s: F.struct(F.col(f"image_{s}").alias("image_id"), F.col(f"kp_{s}").alias("kp_idx"))
    number = lambda s: F.shiftleft(F.col(f"image_{s}"), 40).bitwiseOR(F.col(f"kp_{s}"))
    if packs:  # one number a keypoint, in the same order
        read = F.struct(F.shiftright("node", 40).alias("image_id"), F.col("node").bitwiseAND(F.lit((1 << 40) - 1)).alias("kp_idx"))
        found = components(matches.select(number("a").alias("a"), number("b").alias("b"))).select(read.alias("node"), "component")
    else:
        found = components(matches.select(node("a").alias("a"), node("b").alias("b")))
    good = found.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("node.image_id").alias("images")).filter((F.col("n") == F.col("images")) & (F.col("n") >= min_length))
    return numbered(found.join(good.select("component"), "component"))


def numbered(found: DataFrame) -> DataFrame:
    """Dense ids in order of the components."""
    ids = with_ranks(found.select("component").distinct(), ["component"], "track_id")
    return found.join(ids, "component").select("track_id", F.col("node.image_id").alias("image_id"), F.col("node.kp_idx").alias("kp_idx"))
