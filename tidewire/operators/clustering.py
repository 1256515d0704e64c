"""Leaders of clusters as a sequential pass would choose them, found in rounds, and what clusters know together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import similarity, text, web
from tidewire.shared import written


def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: row, ord (unique), url (null or blank: none). ``edges``: row_a, row_b. Gives row, leader.

    Taken in order, a row with a leader's url joins it; any other with an earlier leader among its neighbours joins the
    earliest; the rest lead. In rounds: who has no earlier undecided neighbour and no earlier undecided row with its url
    leads, and what these decide joins. Rows with one url are never paired. Each round reads the edges that are left and
    is written to the shared folder, so a lost executor costs one round at most.
    """
    if "url" not in nodes.columns:
        nodes = nodes.withColumn("url", F.lit(None).cast("string"))
    nodes = nodes.withColumn("url", F.when(F.col("url") != "", F.col("url")))
    o = lambda x: nodes.select(F.col("row").alias(f"row_{x}"), F.col("ord").alias(f"ord_{x}"))
    ends = edges.select("row_a", "row_b").union(edges.select(F.col("row_b"), F.col("row_a"))).distinct()
    ends = written(ends.join(o("a"), "row_a").join(o("b"), "row_b").where("ord_b < ord_a"), "edges")  # b comes first
    open_, live, led = written(nodes, "open"), ends, []
    while True:
        blocked = live.select(F.col("row_a").alias("row")).distinct()
        first = open_.where("url IS NOT NULL").groupBy("url").agg(F.min("ord").alias("first"))
        clear = open_.join(blocked, "row", "left_anti").join(first, "url", "left").where("first IS NULL OR ord = first")
        new = written(clear.select("row", "url"), "first")
        led.append(new.select("row"))
        urls = new.where("url IS NOT NULL").select("url", F.col("row").alias("leader"))
        joined = open_.join(urls, "url").where("row != leader").select("row")
        met = live.join(new.select(F.col("row").alias("row_b")), "row_b", "left_semi").select(F.col("row_a").alias("row")).distinct()
        gone = new.select("row").union(joined).union(met).distinct()
        open_ = written(open_.join(gone, "row", "left_anti"), "open")
        if open_.isEmpty():
            break
        left = open_.select("row")
        live = written(live.join(left.withColumnRenamed("row", "row_a"), "row_a", "left_semi").join(left.withColumnRenamed("row", "row_b"), "row_b", "left_semi"), "live")
    lead = reduce(DataFrame.union, led)
    # A member may have been decided by its title before its url's leader was found; of one url there is one leader at most.
    named = nodes.where("url IS NOT NULL").join(lead, "row", "left_semi").select("url", F.col("row").alias("leader"), F.col("ord").alias("first"))
    own = nodes.join(named, "url").where("first < ord").select("row", "leader")
    members = ends.join(lead.withColumnRenamed("row", "row_b"), "row_b", "left_semi").join(lead.union(own.select("row")).withColumnRenamed("row", "row_a"), "row_a", "left_anti")
    members = members.groupBy(F.col("row_a").alias("row")).agg(F.min_by("row_b", "ord_b").alias("leader"))
    return lead.select("row", F.col("row").alias("leader")).union(own).union(members)


def parted(lead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lead``: row, leader. The rows of clusters of two and more, and the rows that are alone, which nothing has to be merged with."""
    lead = written(lead, "clusters")
    met = lead.where("row != leader").select("leader").distinct()
    return lead.join(met, "leader", "left_semi"), lead.where("row = leader").join(met, "leader", "left_anti")


def evidence(rows: DataFrame) -> DataFrame:
    """``rows``: row, ord, leader, title, description, source, domain, url. Adds ``grp``, who stands behind a row, and ``kept``, whether it is evidence of its own.

    In the order of ``ord`` each row of a cluster meets its leader, whose empty description has been filled by the first
    row before that has one. A passed-on text takes the wire service behind either, else the group that an earlier one
    brought, else one of its own named by the leader's title; the leader takes the group of the last passed-on text. A
    known or missing url brings no evidence. All by windows over the cluster, which stream its rows.
    """
    w = W.partitionBy("leader").orderBy("ord")
    before, all_ = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lead = lambda c: F.first(c).over(w)
    desc = F.first(F.when(F.col("description") != "", F.col("description")), True).over(before)
    df = rows.withColumns({"d": F.coalesce(desc, F.lit("")), "lt": lead("title"), "ls": lead("source"), "ld": lead("domain"), "own": web.source_group(F.col("domain"), F.col("source"), F.col("url"), F.col("description")), "member": F.col("row") != F.col("leader")})
    some = lambda c: F.when(c != "", c)
    df = df.withColumn("wire", F.coalesce(some(web.wire_family(F.col("ld"), F.col("ls"), F.col("d"))), some(web.wire_family(F.col("domain"), F.col("source"), F.col("description")))))
    df = df.withColumn("passed", F.col("member") & similarity.syndicated(F.col("d"), F.col("description"), F.col("wire").isNotNull(), F.col("lt"), F.col("title")))
    named = F.concat(F.lit("syndication:"), F.substring(F.sha1(text.normalized_title(F.col("lt"))), 1, 12))
    first = F.first("own").over(w)
    wired = F.last(F.when(F.col("passed"), F.col("wire")), True).over(before)
    df = df.withColumn("grp", F.when(F.col("passed"), F.coalesce("wire", wired, F.when(~first.startswith("outlet:"), first), named)).otherwise(F.col("own")))
    last = F.last(F.when(F.col("passed"), F.col("grp")), True).over(all_)
    df = df.withColumn("grp", F.when(F.col("member"), F.col("grp")).otherwise(F.coalesce(last, F.col("grp"))))
    again = F.row_number().over(W.partitionBy("leader", "url").orderBy("ord"))
    return df.withColumn("kept", ~F.col("member") | ((F.col("url") != "") & (again == 1))).drop("d", "lt", "ls", "ld", "own", "member", "wire", "passed")


def merged(evidence_rows: DataFrame) -> DataFrame:
    """One row for each cluster: members, evidence, independent groups, and the first description there is."""
    filled = F.min_by("description", F.when(F.col("description") != "", F.col("ord")))
    return evidence_rows.groupBy("leader").agg(F.count("*").alias("n_members"), F.count_if("kept").alias("n_evidence"), F.greatest(F.lit(1), F.count_distinct(F.when(F.col("kept"), F.lower("grp")))).alias("corroboration"), F.coalesce(filled, F.lit("")).alias("description"))
