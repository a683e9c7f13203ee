"""Leadership search: queries out, ranked hits in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitefold.functions import text
from sitefold.operators.leads import needs_search
from sitefold.session import left_join_salted, materialize, pick_rows

# --- fixed values -----------------------------------------------------------
PERSON_HITS = 2
BROAD_HITS = 3
BROAD_ROLE = "Leadership Team"
# ----------------------------------------------------------------------------


def person_query(name: Column, company: Column) -> Column:
    return F.concat(
        F.lit('"'), name, F.lit('" "'), company, F.lit('" site:linkedin.com/in')
    )


def broad_queries(company: Column) -> Column:
    def query(words: str) -> Column:
        return F.concat(F.lit('"'), company, F.lit(f'" {words} site:linkedin.com/in'))

    return F.array(query("founder CEO CTO"), query("leadership team"))


def search_requests(leaders: Column, company: Column) -> Column:
    """Queries of one record as ``(leader_no, query)``; leader 0 marks broad ones.

    One per leader without a URL, or the two broad ones when there are no leaders.
    Empty when nothing is missing.
    """
    indexed = F.transform(
        leaders,
        lambda x, i: F.struct(
            (i + 1).alias("leader_no"),
            person_query(x["name"], company).alias("query"),
            x["linkedin_url"].alias("url"),
        ),
    )
    missing = F.filter(indexed, lambda r: r["url"].isNull() | (r["url"] == ""))
    person = F.transform(
        missing, lambda r: F.struct(r["leader_no"].alias("leader_no"), r["query"].alias("query"))
    )
    broad = F.transform(
        broad_queries(company),
        lambda q: F.struct(F.lit(0).alias("leader_no"), q.alias("query")),
    )
    return F.when(F.size(leaders) == 0, broad).when(needs_search(leaders), person).otherwise(
        F.slice(person, 1, 0)
    )


def logged_queries(requests: Column) -> Column:
    """All person queries, but only the first of the two broad ones."""
    broad = F.slice(F.filter(requests, lambda r: r["leader_no"] == 0), 1, 1)
    person = F.filter(requests, lambda r: r["leader_no"] > 0)
    return F.transform(F.concat(broad, person), lambda r: r["query"])


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """First ``k`` hits per query.

    Repeated rows count once; different hits of one rank all count, in the order of
    their URL, title and body. Titles and bodies stay where they are until the hits that
    can be among the first are known: rank, URL and a hash of the row are made distinct and
    limited first, before and after the shuffle. Only rows with such a hash, and a few that pass by
    chance and come later in the order, are then moved and put in order. Hits of one query that
    share rank and URL with its k-th all take part.
    """
    columns = ["query", "rank", "href", "title", "body"]
    row = F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])
    marked = hits.select(*columns, row.alias("_hit"))
    by_query = Window.partitionBy("query")
    near = (
        marked.select("query", "rank", "href", "_hit")
        .distinct()
        .withColumn("_at", F.rank().over(by_query.orderBy("rank", "href")))
        .filter(F.col("_at") <= k)
    )
    chosen = materialize(near.select("_hit"), "chosen-hits")
    first = pick_rows(marked, chosen, "_hit").select(*columns).distinct()
    order = by_query.orderBy(*columns[1:])
    return first.withColumn("hit_no", F.row_number().over(order)).filter(F.col("hit_no") <= k)


def hit_url() -> Column:
    return F.coalesce(text.first_profile(F.col("href")), text.first_profile(F.col("body")))


def hits_by_query(hits: DataFrame) -> DataFrame:
    """One row per query: the person URL and the (at most three) broad leaders."""
    top = top_hits(hits, max(PERSON_HITS, BROAD_HITS)).withColumn("url", hit_url())
    found = F.col("url").isNotNull()
    leader = F.struct(
        text.name_from_title(F.col("title")).alias("name"),
        F.lit(BROAD_ROLE).alias("role"),
        F.col("url").alias("linkedin_url"),
    )
    broad = F.array_sort(
        F.collect_list(
            F.when(found & (F.col("hit_no") <= BROAD_HITS), F.struct("hit_no", leader.alias("leader")))
        )
    )
    return top.groupBy("query").agg(
        F.min_by(
            "url", F.when(found & (F.col("hit_no") <= PERSON_HITS), F.col("hit_no"))
        ).alias("person_url"),
        F.transform(broad, lambda h: h["leader"]).alias("broad_leaders"),
    )


def fill_leaders(leads: DataFrame, hits: DataFrame) -> DataFrame:
    """Fill missing leader URLs, or missing leaders, from search hits.

    ``leads`` is a table with a unique ``domain`` and columns ``company`` and
    ``leaders``; ``leaders`` is replaced and ``search_queries_used`` added. Records
    that need no search are not exploded. Hits of queries that nobody asked are left where
    they lie. Many companies may share one name and so one query, hence the salted join.
    """
    asked = leads.withColumn("requests", search_requests(F.col("leaders"), F.col("company")))
    requests = asked.select("domain", F.posexplode("requests").alias("pos", "r")).select(
        "domain", "pos", F.col("r.leader_no").alias("leader_no"), F.col("r.query").alias("query")
    )
    requests = materialize(requests, "search-requests")
    asked_for = pick_rows(hits, requests, "query")
    answered = left_join_salted(requests, hits_by_query(asked_for), "query", spread_by="domain")
    answers = answered.groupBy("domain").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "leader_no", "person_url", "broad_leaders"))
        ).alias("answers")
    )
    no_leaders = F.slice(F.col("leaders"), 1, 0)
    broad = F.flatten(
        F.transform(F.col("answers"), lambda a: F.coalesce(a["broad_leaders"], no_leaders))
    )

    def with_url(leader: Column, i: Column) -> Column:
        answer = F.try_element_at(
            F.filter(F.col("answers"), lambda a: a["leader_no"] == i + 1), F.lit(1)
        )
        return F.struct(
            leader["name"].alias("name"),
            leader["role"].alias("role"),
            F.coalesce(answer["person_url"], leader["linkedin_url"]).alias("linkedin_url"),
        )

    filled = (
        F.when(F.col("answers").isNull(), F.col("leaders"))
        .when(F.size("leaders") == 0, broad)
        .otherwise(F.transform(F.col("leaders"), with_url))
    )
    return (
        asked.withColumn("search_queries_used", logged_queries(F.col("requests")))
        .drop("requests")
        .join(answers, "domain", "left")
        .withColumn("leaders", filled)
        .drop("answers")
    )
