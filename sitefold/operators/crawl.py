"""From seed domains to page rows: home page, its target links, their pages.

The crawl is two joins against the ``pages`` table, first for the home pages, then
for the pages they link to, both on ids. Page HTML, by far the largest column, is never
shuffled: pages are picked where they lie, see :mod:`sitefold.sources.layout`, and parsed
there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitefold.functions import text, urls
from sitefold.operators.html import parse_html, scan_contacts
from sitefold.session import left_join_salted, materialize
from sitefold.sources.layout import PageTable, StoredPages

# --- fixed values -----------------------------------------------------------
MAX_SUBPAGES = 4
FAILED_PAGE, FALLBACK_ERROR = "Failed to crawl page: ", " | Fallback error: "
# ----------------------------------------------------------------------------
NOT_FOUND = "page not found in input"


def start_urls(seeds: DataFrame) -> DataFrame:
    """One row per distinct seed text; repeats are counted before the shuffle.

    The crawl runs once per distinct seed. The repeats come back at the very end,
    when the finished records are joined to ``seeds``.
    """
    start = urls.normalize_seed(F.col("domain"))
    return (
        seeds.groupBy("domain")
        .agg(F.count("*").alias("occurrences"))
        .withColumn("start_url", start)
        .withColumn("page_key", urls.page_key(urls.canonical_url(F.col("start_url"))))
    )


def read_pages(
    pages: DataFrame, denied=text.DENIED_SUFFIXES, max_chars: int | None = None, contents: bool = True
) -> DataFrame:
    """Parsed content by ``page_id``; a map over ``pages`` that drops the HTML.

    ``max_chars`` cuts the text where later characters cannot reach a context of that
    length. Contacts and links come from the whole page. Without ``contents`` only status,
    links and error are kept.
    """
    wanted = pages.select("page_id", "status_code", "html")
    parsed = scan_contacts(wanted, denied=denied) if contents else parse_html(wanted, contents=False)
    broken = F.col("parse_error").isNotNull()
    markdown = F.col("markdown") if max_chars is None else F.left("markdown", F.lit(max_chars))
    content = (
        F.when(broken, failure_text(F.col("parse_error"))).otherwise(markdown).alias("markdown"),
        "emails",
        "linkedin_urls",
    )
    return parsed.select(
        "page_id",
        F.when(broken, F.lit(500)).otherwise(F.col("status_code")).cast("int").alias("status_code"),
        *(content if contents else ()),
        F.col("parse_error").alias("error"),
        "hrefs",
    )


def failure_text(error: Column) -> Column:
    return F.concat(F.lit(FAILED_PAGE), error, F.lit(FALLBACK_ERROR), error)


def _fill_missing(rows: DataFrame, contents: bool) -> DataFrame:
    """A page that is not in the table is still a row: status 500 and an error."""
    missing = F.col("status_code").isNull()
    none = text.empty_strings()
    content = (
        F.when(missing, failure_text(F.lit(NOT_FOUND))).otherwise(F.col("markdown")).alias("markdown"),
        F.coalesce("emails", none).alias("emails"),
        F.coalesce("linkedin_urls", none).alias("linkedin_urls"),
    ) if contents else ()
    return rows.select(
        "domain",
        "start_url",
        F.col("page_no").cast("bigint").alias("page_no"),
        "url",
        F.coalesce("status_code", F.lit(500)).alias("status_code"),
        *content,
        F.when(missing, F.lit(NOT_FOUND)).otherwise(F.col("error")).alias("error"),
    )


def crawl(
    seeds: DataFrame,
    pages: DataFrame | PageTable | StoredPages,
    max_subpages: int = MAX_SUBPAGES,
    denied=text.DENIED_SUFFIXES,
    max_chars: int | None = None,
    contents: bool = True,
) -> DataFrame:
    """Page rows of every distinct seed: home (``page_no`` 0), then its sub-pages.

    ``pages`` is a table with a unique ``page_id``, ``url``, ``html`` and maybe
    ``status_code``, or a stored layout. A missing home page has no links, hence no
    sub-pages. At most ``max_subpages + 1`` rows per seed come out, so grouping them later
    is safe. ``max_chars`` cuts page texts and ``contents`` leaves them out, see
    :func:`read_pages`. Tables are written while this is called: the page index, the parsed
    pages, the requested URLs and their ids.
    """
    source = PageTable(pages) if isinstance(pages, DataFrame) else pages
    starts = materialize(start_urls(seeds), "starts")
    home_keys = starts.select("page_key").distinct().withColumn("at_home", F.lit(True))
    index = materialize(
        source.index()
        .join(home_keys, "page_key", "left")
        .withColumn("at_home", F.coalesce("at_home", F.lit(False))),
        "page-index",
    )
    home_ids = index.filter("at_home").drop("at_home")
    home_pages = materialize(
        read_pages(source.pick(home_ids), denied, max_chars, contents), "home-pages"
    )
    home_links = home_pages.select("page_id", "hrefs").join(home_ids, "page_id")
    # Seeds that differ only in their query string share one home page.
    homes = left_join_salted(
        starts, home_links.select("page_key", "hrefs"), "page_key", spread_by="domain"
    )
    found = urls.discover_links(F.col("start_url"), F.col("hrefs"), max_subpages)
    requested = materialize(
        homes.select(
            "domain",
            "start_url",
            F.col("page_key").alias("home_key"),
            F.posexplode(F.concat(F.array("start_url"), found)).alias("page_no", "url"),
        ).select(
            "domain",
            "start_url",
            "page_no",
            "url",
            F.when(F.col("page_no") == 0, F.col("home_key"))
            .otherwise(urls.page_key(F.col("url")))
            .alias("page_key"),
        ),
        "requested",
    )
    # Everything up to here, and this join, moves URLs and ids only. The page text
    # is fetched in one join by id. Many seeds on one host share its sub-pages, so
    # both keys may be hot.
    frontier = materialize(left_join_salted(requested, index, "page_key", spread_by="domain"), "frontier")
    more_ids = frontier.filter(F.col("page_id").isNotNull() & ~F.col("at_home")).select(*source.id_columns)
    more_ids = materialize(more_ids.distinct(), "more-ids")
    more_pages = read_pages(source.pick(more_ids), denied, max_chars, contents).drop("hrefs")
    more_pages = materialize(more_pages, "more-pages")
    # A page that was picked by chance, or both times, has no partner: a requested page is
    # looked for only where it was picked for its id.
    parsed = home_pages.drop("hrefs").withColumn("at_home", F.lit(True)).unionByName(
        more_pages.withColumn("at_home", F.lit(False))
    )
    found = left_join_salted(frontier, parsed, "page_id", spread_by="domain", also=("at_home",))
    return _fill_missing(found, contents)
