"""Multi-disc sets by their titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def disc_group_members(titles: DataFrame, index: str = "idx", name: str = "name") -> DataFrame:
    """A row a member of each group: base_name, primary_index, member_index, position (from 0).

    Titles with a disc number and one base name form a group if there are two or more;
    members follow by disc number, then by index.  No group is gathered in one value,
    so a group may be of any size; counts and firsts are partial aggregates.
    """
    tagged = titles.select(F.col(index).alias("member_index"), F.col(name).alias("n")).withColumn("disc", N.disc_number(F.col("n"))).where("disc is not null")
    tagged = tagged.select("member_index", "disc", N.strip_disc_tag(F.col("n")).alias("base_name"))
    first = F.min(F.struct("disc", "member_index"))["member_index"]
    groups = tagged.groupBy("base_name").agg(F.count("*").alias("size"), first.alias("primary_index")).where("size > 1").drop("size")
    place = F.row_number().over(Window.partitionBy("base_name").orderBy("disc", "member_index")) - 1
    return tagged.join(groups, "base_name").select("base_name", "primary_index", "member_index", place.alias("position"))


def disc_groups(titles: DataFrame, index: str = "idx", name: str = "name") -> DataFrame:
    """A row a group: base_name, primary_index, member_indices in order of their discs."""
    members = F.array_sort(F.collect_list(F.struct("position", "member_index")))
    rows = disc_group_members(titles, index, name).groupBy("base_name").agg(F.first("primary_index").alias("primary_index"), members.alias("m"))
    return rows.select("base_name", "primary_index", F.transform("m", lambda x: x["member_index"]).alias("member_indices"))


def base_names(titles: DataFrame, key: str, index: str = "idx", name: str = "name") -> DataFrame:
    """Per key: the base name of its titles.

    One title, or a first title with a disc tag: that title without the tag.  Else the
    common prefix of all, cut where a group in brackets is unfinished.  The common
    prefix of a set is that of its least and greatest member, so nothing is collected.
    """
    first = F.min_by(name, index)
    rows = titles.groupBy(key).agg(F.count("*").alias("n"), first.alias("first"), F.min(name).alias("lo"), F.max(name).alias("hi"))
    stripped = N.strip_disc_tag(F.col("first"))
    shared = N.trim_to_paren_boundary(N.common_prefix(F.col("lo"), F.col("hi")))
    return rows.select(key, F.when((F.col("n") == 1) | (stripped != F.col("first")), stripped).otherwise(shared).alias("base_name"))


def same_game(titles: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Per key: the base name if all titles share it, else null."""
    base = N.strip_disc_tag(F.col(name))
    rows = titles.groupBy(key).agg(F.min(base).alias("lo"), F.max(base).alias("hi"))
    return rows.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("base_name"))
