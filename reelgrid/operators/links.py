"""Links between rows: what they connect, and where chains of them end.

Links and labels are a few numbers a row and small in files whatever their count, so Spark would send them through the driver
as broadcasts in every round; the hints keep these joins on shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.sources.tables import kept


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, survivor) for every node of links(left, right): the least node that links reach from it, in either direction.

    Each round a node takes the least label among its neighbours' and then that label's own, so chains halve; rounds are written,
    and end when none changes a label. Null ends link nothing.
    """
    one = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = kept(one.union(one.select("b", "a")).distinct(), "links")
    label = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("survivor")), "labels")
    while True:
        of = label.select(F.col("node").alias("b"), F.col("survivor").alias("near"))
        least = both.join(of.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")).join(label.hint("merge"), "node")
        least = least.select("node", F.col("survivor").alias("had"), F.least("near", "survivor").alias("to"))
        further = label.select(F.col("node").alias("to"), F.col("survivor").alias("far"))
        after = kept(least.join(further.hint("merge"), "to", "left").select("node", "had", F.least("to", "far").alias("survivor")), "labels")
        label = after.select("node", "survivor")
        if after.where("had <> survivor").isEmpty():
            return label


def ends(links: DataFrame, old: str, new: str, cycles: str = "none") -> DataFrame:
    """(old, target) of links(old, new) that replace old by new: where each one's chain ends.

    A row's least link counts if it has several; links to itself and null ends are none. Chains are doubled: after k rounds all
    that are at most 2^k long have ended, and a round in which none ends leaves those that run into a cycle. These have no
    target, or with cycles="least" the least member of their cycle, which itself has none.
    """
    clean = links.where(F.col(old).isNotNull() & (F.col(old) != F.col(new))).groupBy(F.col(old).alias("a")).agg(F.min(new).alias("b"))
    first = clean.join(clean.select(F.col("a").alias("b"), F.lit(True).alias("goes_on")).hint("merge"), "b", "left")
    step = kept(first.select("a", "b", F.col("goes_on").isNull().alias("ended")), "chains")
    open_before, rounds = None, 0
    while (still := step.where("NOT ended").count()) and still != open_before:
        after = step.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("ended").alias("c_ended"))
        both = step.join(after.hint("merge"), "b", "left")
        step = kept(both.select("a", F.when(F.col("ended"), F.col("b")).otherwise(F.col("c")).alias("b"), (F.col("ended") | F.col("c_ended")).alias("ended")), "chains")
        open_before, rounds = still, rounds + 1
    done = step.where("ended").select(F.col("a").alias(old), F.col("b").alias("target"))
    if not still or cycles == "none":
        return done
    # What is left runs into cycles. `least` is over the nodes from `a` up to, without, `b`; once paths are longer than all
    # there are, b lies on a cycle and the path from there covers it.
    path = kept(clean.join(step.where("NOT ended").select("a").hint("merge"), "a", "left_semi").withColumn("least", F.col("a")), "cycles")
    length = 1
    while length < still:
        after = path.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("least").alias("more"))
        path = kept(path.join(after.hint("merge"), "b").select("a", F.col("c").alias("b"), F.least("least", "more").alias("least")), "cycles")
        length *= 2
    of_cycle = path.select(F.col("a").alias("b"), F.col("least").alias("target"))
    rest = path.select("a", "b").join(of_cycle.hint("merge"), "b").where("a <> target").select(F.col("a").alias(old), "target")
    return done.unionByName(rest)


def merged(titles: DataFrame, identities: DataFrame, title: str, identity: str) -> DataFrame:
    """titles with survivor: titles that share an identity of identities(title, identity), directly or by way of others, are one,
    and the least stays. A title without identities survives by itself; null identities are none."""
    known = identities.where(F.col(title).isNotNull() & F.col(identity).isNotNull())
    # An identity that many titles share is a star around the least of them: its links grow with its titles.
    centre = known.groupBy(identity).agg(F.min(title).alias("_centre"))
    of = connected(known.join(centre, identity).where(F.col(title) != F.col("_centre")).select(F.col(title).alias("a"), F.col("_centre").alias("b")), "a", "b")
    return titles.join(of.select(F.col("node").alias(title), "survivor").hint("merge"), title, "left").withColumn("survivor", F.coalesce("survivor", title))
