"""Registered queries: one per operator, each over whole tables.

Results hold scalars only (arrays are joined to text), so they can be compared
with the answers of another engine column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitefold.functions import scores, text, urls
from sitefold.operators import costs, crawl, html, leads, responses, search, sites
from sitefold.plans.enrich import enrich, extract
from sitefold.plans.fixtures import Inputs
from sitefold.session import materialize, scratch_path
from sitefold.sources import layout, sinks, tables

# example.com is on the default list, and all addresses in ``documents`` are there
DOCUMENT_DENIED = tuple(s for s in text.DENIED_SUFFIXES if s != "example.com")


def _joined(items: Column | str, sep: str = "|") -> Column:
    return F.array_join(items, sep)


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# -- shared stages --------------------------------------------------------------
def _site_rows(i: Inputs) -> DataFrame:
    """All pages of every site as page rows (at most four per site)."""
    return html.scan_contacts(
        i.site_pages().select("site_id", "domain", "page_no", "url", "status_code", "html")
    ).withColumnRenamed("parse_error", "error")


def _profiles(i: Inputs) -> DataFrame:
    return sites.site_profiles(_site_rows(i))


def _links(i: Inputs) -> DataFrame:
    """Exploded raw links of every site page, resolved against the page's URL."""
    # the page's URL is split once, below the explode, and not again for each link
    based = _home_links(i).withColumn("base", urls.split_url(F.col("url")))
    return (
        based.select(
            "site_id", _big("page_no"), "base",
            F.explode(urls.resolve_against(F.col("base"), F.col("hrefs"))).alias("l"),
        )
        .select("site_id", "page_no", "l.link_no", "l.href", "l.to", "base")
    )


def _home_links(i: Inputs) -> DataFrame:
    return html.parse_html(i.site_pages().select("site_id", "page_no", "url", "html"))


def _records(i: Inputs) -> DataFrame:
    """Finished records of all sites without the search step."""
    found = extract(_profiles(i), i.kb(), i.prices())
    return found.select(
        "lead.domain",
        "lead.company_name",
        "lead.company_overview",
        "lead.target_audience",
        "lead.contact_points",
        "lead.key_leadership",
        scores.completeness(
            F.col("lead.company_overview"),
            F.col("lead.target_audience"),
            F.col("lead.key_leadership"),
            F.col("lead.contact_points"),
        ).alias("data_confidence_score"),
        "pages_crawled",
        text.empty_strings().alias("search_queries_used"),
        "cost_metrics",
    )


def _flat(records: DataFrame, *extra: str) -> DataFrame:
    return records.select(
        *extra,
        "domain",
        "company_name",
        "company_overview",
        "target_audience",
        _joined("contact_points").alias("contact_points"),
        leads.leader_text(F.col("key_leadership")).alias("key_leadership"),
        "data_confidence_score",
        _joined("pages_crawled").alias("pages_crawled"),
        _joined("search_queries_used").alias("search_queries_used"),
        "cost_metrics.input_tokens",
        "cost_metrics.output_tokens",
        "cost_metrics.total_tokens",
        "cost_metrics.estimated_cost_usd",
    )


# -- scans and sinks --------------------------------------------------------------
def seed_domains(i: Inputs) -> DataFrame:
    return tables.seed_table(i.seeds(), "domain", "seed_no")


def seed_files(i: Inputs) -> DataFrame:
    """The seeds written to several text files and read back in their order."""
    path = scratch_path(i.spark, "seed-files")
    ordered = i.seeds().repartitionByRange(5, "seed_no").sortWithinPartitions("seed_no")
    ordered.select("domain").write.text(path)
    return tables.seed_file(i.spark, path)


def _stored(i: Inputs, df: DataFrame, loader: Callable, fmt: str = "parquet") -> DataFrame:
    """``df`` written and read back through a scan with a declared schema."""
    path = scratch_path(i.spark, f"stored-{fmt}")
    df.write.format(fmt).save(path)
    return loader(i.spark, path)


def pages_scan(i: Inputs) -> DataFrame:
    return tables.pages(i.spark, f"{i.sf_dir}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("html_chars")
    )


def sink_json_roundtrip(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "json")
    sinks.write_json(_records(i), path)
    return _flat(sinks.read_json(i.spark, path))


def _csv_roundtrip(i: Inputs, by_line: bool) -> DataFrame:
    path = scratch_path(i.spark, "csv")
    sinks.write_report(_records(i), path, by_line)
    back = sinks.read_report(i.spark, path, by_line)
    # CSV has one empty value: an absent list and an empty one both read as ""
    return back.withColumn("key_leadership", F.coalesce("key_leadership", F.lit(""))).withColumn(
        "contact_points", F.coalesce("contact_points", F.lit(""))
    )


def sink_csv_roundtrip(i: Inputs) -> DataFrame:
    return _csv_roundtrip(i, by_line=False)


def sink_csv_lines_roundtrip(i: Inputs) -> DataFrame:
    return _csv_roundtrip(i, by_line=True)


def report_flat(i: Inputs) -> DataFrame:
    return leads.report(_records(i))


# -- URLs -------------------------------------------------------------------------
def url_normalize(i: Inputs) -> DataFrame:
    return i.derived("fx_raw_seeds").select("seed_no", urls.normalize_seed(F.col("domain")).alias("url"))


def url_clean_domain(i: Inputs) -> DataFrame:
    return i.derived("fx_raw_seeds").select(
        "seed_no", urls.clean_domain(F.col("domain")).alias("domain")
    )


def company_name_from_domain(i: Inputs) -> DataFrame:
    return i.derived("fx_raw_seeds").select(
        "seed_no", urls.company_name(urls.clean_domain(F.col("domain"))).alias("company_name")
    )


def link_resolve(i: Inputs) -> DataFrame:
    return i.derived("fx_links").select(
        "site_id",
        _big("link_no"),
        "href",
        urls.resolve_link(F.col("base_url"), F.col("href")).alias("absolute"),
    )


def link_canonical(i: Inputs) -> DataFrame:
    return i.table("pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


def link_same_site(i: Inputs) -> DataFrame:
    kept = _links(i).filter(urls.same_site(F.col("to.netloc"), F.col("base.netloc")))
    return kept.select("site_id", "page_no", "link_no", urls.unsplit_url(F.col("to")).alias("url"))


def link_target_path(i: Inputs) -> DataFrame:
    kept = _links(i).filter(urls.target_path(F.col("to.path")))
    return kept.select("site_id", "page_no", "link_no", F.col("to.path").alias("path"))


def link_skip_filter(i: Inputs) -> DataFrame:
    return _links(i).filter(~urls.is_skippable(F.col("href"))).select(
        "site_id", "page_no", "link_no", "href"
    )


def links_dedup(i: Inputs) -> DataFrame:
    links = urls.site_links(F.col("url"), F.col("hrefs"))
    return _home_links(i).select(
        "site_id", _big("page_no"), F.posexplode(links).alias("pos", "url")
    ).select("site_id", "page_no", (F.col("pos") + 1).cast("bigint").alias("link_no"), "url")


def links_top_k(i: Inputs) -> DataFrame:
    def top(k: int) -> Column:
        return _joined(urls.discover_links(F.col("url"), F.col("hrefs"), k))

    return _home_links(i).select(
        "site_id", _big("page_no"), top(4).alias("links_4"), top(5).alias("links_5")
    )


# -- HTML -------------------------------------------------------------------------
def _site_markdown(i: Inputs) -> DataFrame:
    return html.parse_html(i.site_pages().select("site_id", "page_no", "html"))


def _count(literal: str) -> Column:
    return F.regexp_count("markdown", F.lit(literal)).cast("bigint")


def html_strip(i: Inputs) -> DataFrame:
    return _site_markdown(i).select(
        "site_id",
        _big("page_no"),
        _count("trk|sentry").alias("script_hits"),
        _count("color").alias("style_hits"),
        _count("Pricing|Jobs|/blog").alias("nav_hits"),
        _count("info@").alias("footer_hits"),
        _count(" builds ").alias("body_hits"),
    )


def html_strip_hidden(i: Inputs) -> DataFrame:
    return _site_markdown(i).select(
        "site_id",
        _big("page_no"),
        F.regexp_count("markdown", F.concat(F.lit("hidden"), F.col("site_id").cast("string")))
        .cast("bigint")
        .alias("hidden_hits"),
        F.length("markdown").cast("bigint").alias("chars"),
    )


def html_markdown(i: Inputs) -> DataFrame:
    return _site_markdown(i).select("site_id", _big("page_no"), "markdown")


def html_links(i: Inputs) -> DataFrame:
    return (
        html.parse_html(i.table("pages").select("page_id", "html"))
        .select("page_id", F.posexplode("hrefs").alias("pos", "href"))
        .select("page_id", (F.col("pos") + 1).cast("bigint").alias("link_no"), "href")
    )


def text_collapse_ws(i: Inputs) -> DataFrame:
    loose = F.replace(F.col("text"), F.lit(". "), F.lit(". \n \n\t\n"))
    tidy = text.collapse_whitespace(loose)
    return i.table("documents").select(
        "doc_id", F.length(tidy).cast("bigint").alias("chars"), F.md5(tidy).alias("text_md5")
    )


# -- text -------------------------------------------------------------------------
def emails_extract(i: Inputs) -> DataFrame:
    return i.site_pages().select(
        "site_id", _big("page_no"), _joined(text.emails(F.col("html"))).alias("emails")
    )


def emails_extract_documents(i: Inputs) -> DataFrame:
    return i.table("documents").select(
        "doc_id", _joined(text.emails(F.col("text"), DOCUMENT_DENIED)).alias("emails")
    )


def emails_denied(i: Inputs) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit(text.EMAIL), F.lit(0)))
    return (
        i.site_pages()
        .select("site_id", _big("page_no"), found.alias("email"))
        .filter(text.is_denied_email(F.col("email")))
    )


def linkedin_urls(i: Inputs) -> DataFrame:
    return i.site_pages().select(
        "site_id", _big("page_no"), _joined(text.linkedin_urls(F.col("html"))).alias("linkedin_urls")
    )


def linkedin_first_person(i: Inputs) -> DataFrame:
    return i.site_pages().select(
        "site_id", _big("page_no"), text.first_profile(F.col("html")).alias("linkedin_url")
    )


def page_contacts(i: Inputs) -> DataFrame:
    return _site_rows(i).select(
        "site_id",
        _big("page_no"),
        _joined("emails").alias("emails"),
        _joined("linkedin_urls").alias("linkedin_urls"),
    )


def page_contacts_given_pages(i: Inputs) -> DataFrame:
    pages = i.table("pages").select("page_id", "html")
    return html.scan_contacts(pages, denied=DOCUMENT_DENIED).select(
        "page_id", _joined("emails").alias("emails"), _joined("linkedin_urls").alias("linkedin_urls")
    )


def context_truncate(i: Inputs) -> DataFrame:
    cut = text.truncate(F.col("text"), sites.CONTEXT_CHARS)
    return i.table("documents").select(
        "doc_id", F.length(cut).cast("bigint").alias("chars"), F.md5(cut).alias("text_md5")
    )


def overview_sentences(i: Inputs) -> DataFrame:
    return i.table("documents").select(
        "doc_id",
        text.overview(F.col("text"), F.concat(F.lit("Doc"), F.col("doc_id"))).alias("overview"),
    )


def _leaders_query(extract_leaders) -> Callable[[Inputs], DataFrame]:
    def query(i: Inputs) -> DataFrame:
        return i.derived("fx_leader_text").select(
            "site_id", leads.leader_text(extract_leaders(F.col("txt"))).alias("leaders")
        )

    return query


def token_estimate(i: Inputs) -> DataFrame:
    tokens = text.token_estimate(F.col("text")).alias("tokens")
    docs = i.table("documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"),
        F.lit(0).cast("bigint").alias("turn"), tokens,
    )
    turns = i.table("conversations").select(
        F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), _big("turn"), tokens
    )
    return docs.unionByName(turns)


def search_title_name(i: Inputs) -> DataFrame:
    return i.search_results().select(
        "query", _big("rank"), text.name_from_title(F.col("title")).alias("name")
    )


# -- joins ------------------------------------------------------------------------
def kb_left_join(i: Inputs) -> DataFrame:
    kb = _stored(i, i.kb(), tables.knowledge_base, "json")
    return leads.join_kb(i.seeds(), kb).select(
        "seed_no",
        "domain",
        F.when(F.col("in_kb"), F.lit("kb")).otherwise(F.lit("rules")).alias("branch"),
        F.coalesce("kb_name", urls.company_name(F.col("domain_clean"))).alias("company_name"),
        F.coalesce("kb_icp", F.lit(text.DEFAULT_AUDIENCE)).alias("target_audience"),
    )


def kb_anti(i: Inputs) -> DataFrame:
    return leads.kb_misses(i.seeds(), i.kb()).select("seed_no", "domain")


def cost_by_model(i: Inputs) -> DataFrame:
    prices = i.prices().select("model", _big("in_milli"), _big("out_milli"))
    return costs.attach_prices(i.calls(), _stored(i, prices, tables.model_prices)).select(
        "call_id", "model", "in_milli", "out_milli"
    )


def crawl_frontier(i: Inputs) -> DataFrame:
    return crawl.crawl(i.seeds(), i.site_pages(), contents=False).select(
        "domain", "page_no", "url", _big("status_code"), "error"
    )


def crawl_stored_pages(i: Inputs) -> DataFrame:
    """The same frontier from a stored layout of the pages."""
    stored = layout.write_pages(i.site_pages(), scratch_path(i.spark, "page-layout"))
    return crawl.crawl(i.seeds(), stored, contents=False).select(
        "domain", "page_no", "url", _big("status_code"), "error"
    )


def crawl_given_pages(i: Inputs) -> DataFrame:
    """Every raw page as the home page of a seed of its own."""
    pages = tables.pages(i.spark, f"{i.sf_dir}/pages.parquet")
    seeds = tables.seed_table(pages, "url", "page_id")
    return crawl.crawl(seeds, pages, contents=False).select(
        "domain", "page_no", "url", _big("status_code"), "error"
    )


def leader_url_override(i: Inputs) -> DataFrame:
    found = sites.domain_contacts(
        i.site_pages().select(
            "domain",
            text.emails(F.col("html")).alias("emails"),
            text.linkedin_urls(F.col("html")).alias("linkedin_urls"),
        )
    )
    leaders = leads.override_leader_urls(F.col("leadership"), F.col("linkedin_urls"))
    return (
        i.kb()
        .join(found, "domain")
        .select("domain", F.posexplode(leaders).alias("pos", "l"))
        .select(
            "domain",
            (F.col("pos") + 1).cast("bigint").alias("leader_no"),
            "l.name",
            "l.linkedin_url",
        )
    )


def _filled(i: Inputs, searched: Column) -> DataFrame:
    """Leaders after the search for the given leads, one row each."""
    # the search reads its leads three times
    open_leads = materialize(i.open_leads().filter(searched), "open-leads")
    return (
        search.fill_leaders(open_leads, i.search_results())
        .select("domain", F.posexplode("leaders").alias("pos", "l"))
        .select("domain", (F.col("pos") + 1).cast("bigint").alias("leader_no"), "l.*")
    )


def leader_search_fill(i: Inputs) -> DataFrame:
    return _filled(i, F.size("leaders") > 0)


def broad_search_leaders(i: Inputs) -> DataFrame:
    return _filled(i, F.size("leaders") == 0)


def provider_fallback(i: Inputs) -> DataFrame:
    found = leads.rule_leads(_profiles(i), i.kb())
    return responses.apply_fallback(found, i.responses()).select(
        "domain",
        "provider",
        "model",
        "lead.company_name",
        "lead.company_overview",
        "lead.target_audience",
        _joined("lead.contact_points").alias("contact_points"),
        leads.leader_text(F.col("lead.key_leadership")).alias("key_leadership"),
        "input_tokens",
        "output_tokens",
    )


# -- aggregates -------------------------------------------------------------------
def domain_contacts(i: Inputs) -> DataFrame:
    return sites.domain_contacts(_site_rows(i)).select(
        "domain",
        _joined("emails").alias("emails"),
        _joined("linkedin_urls").alias("linkedin_urls"),
    )


def domain_contact_rows(i: Inputs) -> DataFrame:
    return sites.contact_rows(_site_rows(i))


def domain_context(i: Inputs) -> DataFrame:
    return sites.domain_context(_site_rows(i))


def domain_context_all(i: Inputs) -> DataFrame:
    return sites.domain_context(_site_rows(i), include_failed=True)


def domain_pages(i: Inputs) -> DataFrame:
    return sites.domain_pages(i.site_pages()).select(
        "domain", _joined("pages_crawled").alias("pages_crawled")
    )


def cost_totals(i: Inputs) -> DataFrame:
    return costs.cost_totals(costs.price_calls(i.calls(), i.prices()))


def cost_totals_by_model(i: Inputs) -> DataFrame:
    return costs.cost_totals_by_model(costs.price_calls(i.calls(), i.prices()))


def batch_summary(i: Inputs) -> DataFrame:
    found = extract(_profiles(i), i.kb(), i.prices()).select("domain", "cost_metrics")
    return costs.batch_summary(responses.batch_status(found, i.responses()))


def batch_failures(i: Inputs) -> DataFrame:
    return responses.batch_status(i.seeds(), i.responses()).select(
        "seed_no",
        "domain",
        F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        "error",
    )


# -- set operations, scores, validation ---------------------------------------------
def search_top_k(i: Inputs) -> DataFrame:
    hits = _stored(i, i.search_results(), tables.search_results)
    return search.top_hits(hits, search.BROAD_HITS).select(
        "query", _big("hit_no"), "href"
    )


def contacts_union_kb(i: Inputs) -> DataFrame:
    found = sites.domain_contacts(_site_rows(i))
    return i.kb().join(found, "domain").select(
        "domain",
        _joined(leads.union_contacts(F.col("emails"), F.col("contacts"))).alias("contact_points"),
    )


def call_cost(i: Inputs) -> DataFrame:
    return costs.price_calls(i.calls(), i.prices()).select(
        "call_id", F.col("cost").cast("double").alias("cost")
    )


def completeness_score(i: Inputs) -> DataFrame:
    return _records(i).select("domain", "data_confidence_score")


def extraction_confidence(i: Inputs) -> DataFrame:
    return leads.rule_leads(_profiles(i), i.kb()).select("domain", "lead.data_confidence_score")


def needs_search(i: Inputs) -> DataFrame:
    return i.open_leads().filter(leads.needs_search(F.col("leaders"))).select("domain")


def search_queries(i: Inputs) -> DataFrame:
    asked = i.open_leads().withColumn(
        "requests", search.search_requests(F.col("leaders"), F.col("company"))
    )
    return asked.select(
        "domain",
        _joined(F.transform("requests", lambda r: r["query"])).alias("queries_run"),
        _joined(search.logged_queries(F.col("requests"))).alias("queries_logged"),
    )


def llm_validate(i: Inputs) -> DataFrame:
    answers = _stored(i, i.responses(), tables.responses)
    return responses.validate(answers).select(
        "domain", "provider", "model", F.col("valid").cast("bigint").alias("valid"), "reason"
    )


def llm_quarantine(i: Inputs) -> DataFrame:
    return responses.quarantine(responses.validate(i.responses())).select(
        "domain", "provider", "reason", "raw_json"
    )


def prompt_build(i: Inputs) -> DataFrame:
    return responses.prompts(_profiles(i))


def _lead_query(compat: bool) -> Callable[[Inputs], DataFrame]:
    def query(i: Inputs) -> DataFrame:
        profiles = sites.site_profiles(_site_rows(i), include_failed=compat)
        return leads.rule_leads(profiles, i.kb(), compat).select(
            "lead.domain",
            "lead.company_name",
            "lead.company_overview",
            "lead.target_audience",
            _joined("lead.contact_points").alias("contact_points"),
            leads.leader_text(F.col("lead.key_leadership")).alias("key_leadership"),
            "lead.data_confidence_score",
            "input_tokens",
            "output_tokens",
        )

    return query


def _enrich_query(with_responses: bool, compat: bool) -> Callable[[Inputs], DataFrame]:
    def query(i: Inputs) -> DataFrame:
        records = enrich(
            i.seeds(),
            i.site_pages(),
            i.kb(),
            i.prices(),
            i.search_results(),
            i.responses() if with_responses else None,
            compat=compat,
        )
        return _flat(records, "seed_no", "home_status", "provider", "error").withColumn(
            "home_status", _big("home_status")
        )

    return query


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "seed_domains": seed_domains,
    "seed_files": seed_files,
    "pages_scan": pages_scan,
    "sink_json_roundtrip": sink_json_roundtrip,
    "sink_csv_roundtrip": sink_csv_roundtrip,
    "sink_csv_lines_roundtrip": sink_csv_lines_roundtrip,
    "url_normalize": url_normalize,
    "url_clean_domain": url_clean_domain,
    "company_name_from_domain": company_name_from_domain,
    "link_resolve": link_resolve,
    "link_canonical": link_canonical,
    "link_same_site": link_same_site,
    "link_target_path": link_target_path,
    "link_skip_filter": link_skip_filter,
    "html_strip": html_strip,
    "html_strip_hidden": html_strip_hidden,
    "html_markdown": html_markdown,
    "text_collapse_ws": text_collapse_ws,
    "html_links": html_links,
    "emails_extract": emails_extract,
    "emails_extract_documents": emails_extract_documents,
    "emails_denied": emails_denied,
    "linkedin_urls": linkedin_urls,
    "linkedin_first_person": linkedin_first_person,
    "page_contacts": page_contacts,
    "page_contacts_given_pages": page_contacts_given_pages,
    "context_truncate": context_truncate,
    "overview_sentences": overview_sentences,
    "leaders_name_role": _leaders_query(text.leaders_name_role),
    "leaders_name_role_compat": _leaders_query(lambda c: text.leaders_name_role(c, compat=True)),
    "leaders_role_name": _leaders_query(text.leaders_role_name),
    "leaders_role_name_compat": _leaders_query(lambda c: text.leaders_role_name(c, compat=True)),
    "leaders_union": _leaders_query(text.leaders),
    "token_estimate": token_estimate,
    "search_title_name": search_title_name,
    "kb_left_join": kb_left_join,
    "kb_anti": kb_anti,
    "cost_by_model": cost_by_model,
    "crawl_frontier": crawl_frontier,
    "crawl_stored_pages": crawl_stored_pages,
    "crawl_given_pages": crawl_given_pages,
    "leader_url_override": leader_url_override,
    "leader_search_fill": leader_search_fill,
    "broad_search_leaders": broad_search_leaders,
    "provider_fallback": provider_fallback,
    "domain_contacts": domain_contacts,
    "domain_contact_rows": domain_contact_rows,
    "domain_context": domain_context,
    "domain_context_all": domain_context_all,
    "domain_pages": domain_pages,
    "cost_totals": cost_totals,
    "cost_totals_by_model": cost_totals_by_model,
    "batch_summary": batch_summary,
    "batch_failures": batch_failures,
    "links_top_k": links_top_k,
    "links_dedup": links_dedup,
    "search_top_k": search_top_k,
    "contacts_union_kb": contacts_union_kb,
    "completeness_score": completeness_score,
    "extraction_confidence": extraction_confidence,
    "needs_search": needs_search,
    "search_queries": search_queries,
    "call_cost": call_cost,
    "llm_validate": llm_validate,
    "llm_quarantine": llm_quarantine,
    "prompt_build": prompt_build,
    "report_flat": report_flat,
    "lead_heuristic": _lead_query(compat=False),
    "lead_heuristic_compat": _lead_query(compat=True),
    "enrich_full": _enrich_query(with_responses=False, compat=False),
    "enrich_full_compat": _enrich_query(with_responses=False, compat=True),
    "enrich_with_responses": _enrich_query(with_responses=True, compat=False),
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Inputs(spark, sf_dir))

    return {name: bind(query) for name, query in QUERIES.items()}
