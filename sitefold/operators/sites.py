"""Per-site aggregates over crawled page rows.

Input rows come from :func:`sitefold.operators.crawl.crawl`, which emits at most
``max_subpages + 1`` rows per site, so the ordered lists built here are short. The
contact aggregates do not rely on that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions import text

CONTEXT_CHARS = 12000


def _contact_rows(pages: DataFrame) -> DataFrame:
    """Distinct contacts, plus one row without contact for a domain that has none."""
    contacts = F.array(
        F.struct(F.lit("email").alias("kind"), F.col("emails").alias("found")),
        F.struct(F.lit("linkedin").alias("kind"), F.col("linkedin_urls").alias("found")),
    )
    return (
        pages.select("domain", F.explode(contacts).alias("c"))
        .select("domain", "c.kind", F.explode_outer("c.found").alias("contact"))
        .distinct()
    )


def contact_rows(pages: DataFrame) -> DataFrame:
    """Distinct ``(domain, kind, contact)`` rows, combined before the shuffle."""
    return _contact_rows(pages).filter(F.col("contact").isNotNull())


def _sorted_union(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def _page_failed() -> Column:
    return F.col("error").isNotNull() | (F.col("status_code") >= 400)


def page_section(url: Column, markdown: Column) -> Column:
    return F.concat(F.lit("--- PAGE: "), url, F.lit(" ---\n"), markdown)


def _ordered(value: Column) -> Column:
    """Collected values in page order, nulls left out."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("page_no"), value.alias("v"))))
    return F.filter(F.transform(rows, lambda r: r["v"]), lambda v: v.isNotNull())


def context_agg(include_failed: bool = False) -> Column:
    """Page sections in page order, joined by a blank line.

    Failed pages are left out unless ``include_failed``; empty pages always are.
    """
    wanted = F.col("markdown") != ""
    if not include_failed:
        wanted = wanted & ~_page_failed()
    return F.array_join(
        _ordered(F.when(wanted, page_section(F.col("url"), F.col("markdown")))), "\n\n"
    )


def domain_contacts(pages: DataFrame) -> DataFrame:
    """Sorted distinct contacts per domain, for any number of pages per domain.

    Repeats are removed first, so a group holds no more than it puts out.
    """

    def of(kind: str) -> Column:
        found = F.collect_list(F.when(F.col("kind") == kind, F.col("contact")))
        return F.array_sort(found)

    return _contact_rows(pages).groupBy("domain").agg(
        of("email").alias("emails"), of("linkedin").alias("linkedin_urls")
    )


def domain_context(pages: DataFrame, include_failed: bool = False) -> DataFrame:
    return pages.groupBy("domain").agg(context_agg(include_failed).alias("context"))


def domain_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("domain").agg(_ordered(F.col("url")).alias("pages_crawled"))


def site_profiles(
    pages: DataFrame, max_chars: int = CONTEXT_CHARS, include_failed: bool = False
) -> DataFrame:
    """All per-site aggregates in one shuffle, with the bounded context."""
    return (
        pages.groupBy("domain")
        .agg(
            _ordered(F.col("url")).alias("pages_crawled"),
            _sorted_union(F.collect_list("emails")).alias("emails"),
            _sorted_union(F.collect_list("linkedin_urls")).alias("linkedin_urls"),
            context_agg(include_failed).alias("context"),
            F.min(F.when(F.col("page_no") == 0, F.col("status_code"))).alias("home_status"),
        )
        .withColumn("context", text.truncate(F.col("context"), max_chars))
    )
