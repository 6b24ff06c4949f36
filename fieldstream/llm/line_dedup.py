"""Lines that much of a site repeats, with DataFrame functions only.

Per host, a line's site frequency is the share of the host's pages that contain it. Pages
with the same text count once, so a page that is copied whole does not turn its own lines
into boilerplate. Lines above a share are dropped from every page of the host. Near copies
count once too where a function is given that finds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.common import keep, maybe_broadcast

#: The whitespace that is cut off a line before it is compared.
TRIM = " \t\x0b\x0c\r"


def _mark(line: Column) -> Column:
    """128 bits that stand for a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(TRIM))


def boilerplate(docs: DataFrame, most_share: float = 0.08, least_pages: int = 5,
                text_col: str = "text", host_col: str = "source",
                near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(host, mark, pages, host_pages) of the lines that are boilerplate on their host.

    A line is boilerplate when it stands on at least ``least_pages`` different pages of the
    host and on more than ``most_share`` of them. Blank lines never are; a null host is a
    host of its own.

    ``near`` takes (doc_id, text) and gives (doc_id, component_id): pages of one component
    count once. It gets the pages that could be near copies through lines found so, those
    with half of their lines among them.
    """
    pages = (docs.where(F.col(text_col).isNotNull())
             .select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("text")))
    # One row a page with its lines' marks; copies of a page fold before they are shuffled.
    page = pages.select(
        "host", F.xxhash64("text").alias("page"), F.length("text").alias("size"),
        F.array_distinct(F.transform(
            F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: x != ""),
            _mark)).alias("lines"))
    page = keep(page.groupBy("host", "page", "size").agg(F.first("lines").alias("lines")),
                "pages")
    lines = page.select("host", F.explode("lines").alias("mark"))
    found = _above(lines, page, most_share, least_pages)
    if near is None:
        return found
    found = keep(found, "common-lines").select(F.col("host").alias("__host"),
                                               F.col("mark").alias("__mark"))
    doubtful = keep(
        page.select("host", "page", "size", F.size("lines").alias("n"),
                    F.explode("lines").alias("mark"))
        .join(maybe_broadcast(found, found.count()),
              F.col("host").eqNullSafe(F.col("__host")) & (F.col("mark") == F.col("__mark")))
        .groupBy("host", "page", "size", "n").agg(F.count("*").alias("common"))
        .where(2 * F.col("common") >= F.col("n"))
        .select(F.col("page").alias("__page")).distinct(), "doubtful")
    texts = (pages.select(F.xxhash64("text").alias("doc_id"), "text")
             .join(maybe_broadcast(doubtful, doubtful.count()),
                   F.col("doc_id") == F.col("__page"), "left_semi")
             .dropDuplicates(["doc_id"]))
    groups = keep(near(keep(texts, "doubtful-pages"))
                  .select(F.col("doc_id").alias("__page"), F.col("component_id").alias("group")),
                  "near-pages")
    page = page.join(maybe_broadcast(groups, groups.count()),
                     F.col("page") == F.col("__page"), "left").drop("__page")
    alone, grouped = page.where("group is null"), page.where("group is not null")
    lines = alone.select("host", F.explode("lines").alias("mark")).unionByName(
        grouped.select("host", "group", F.explode("lines").alias("mark")).distinct()
        .drop("group"))
    counts = alone.select("host").unionByName(
        grouped.select("host", "group").distinct().drop("group"))
    return _above(lines, counts, most_share, least_pages)


def _above(lines: DataFrame, page: DataFrame, most_share: float, least_pages: int) -> DataFrame:
    """Lines (host, mark: a row for each page) above the share of their host's pages."""
    counted = (lines.groupBy("host", "mark").agg(F.count("*").alias("pages"))
               .where(F.col("pages") >= least_pages))
    hosts = page.groupBy(F.col("host").alias("__host")).agg(F.count("*").alias("host_pages"))
    return (counted.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
            .where(F.col("pages") > F.lit(most_share) * F.col("host_pages")))


def drop_boilerplate(docs: DataFrame, most_share: float = 0.08, least_pages: int = 5,
                     text_col: str = "text", host_col: str = "source",
                     dropped_col: str = "lines_dropped",
                     near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text, and how many they were.

    Other lines keep their bytes and order, and a text without such a line is unchanged; a
    null text stays null. Repeated rows are treated alike; all other columns are passed on.
    A host has at most (lines a page / ``most_share``) boilerplate lines, so its list fits a
    row; the lists are broadcast when all of them together are few, else joined by host.
    """
    lists = keep(boilerplate(docs, most_share, least_pages, text_col, host_col, near)
                 .groupBy(F.col("host").alias("__host"))
                 .agg(F.collect_list("mark").alias("__marks")), "boilerplate")
    size = lists.agg(F.sum(F.size("__marks") + 1)).first()[0] or 0
    lines = F.split(F.col(text_col), "\n")
    found = F.transform(lines, lambda x: F.array_contains(F.col("__marks"), _mark(_trimmed(x))))
    kept = F.filter(lines, lambda x, i: ~F.get(F.col("__found"), i))
    return (
        docs.join(maybe_broadcast(lists, size),
                  F.col(host_col).eqNullSafe(F.col("__host")), "left")
        .withColumn("__found", F.when(F.col("__marks").isNotNull(), found))
        .withColumn(dropped_col, F.coalesce(
            F.size(F.filter("__found", lambda x: x)), F.lit(0)))
        .withColumn(dropped_col, F.greatest(F.col(dropped_col), F.lit(0)))
        .withColumn(text_col, F.when(F.col(dropped_col) > 0, F.array_join(kept, "\n"))
                    .otherwise(F.col(text_col)))
        .drop("__host", "__marks", "__found"))
