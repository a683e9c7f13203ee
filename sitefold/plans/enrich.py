"""The whole flow: seeds and pages in, scored company records out."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, functions as F

from sitefold.functions import scores, text, urls
from sitefold.operators import costs, crawl, leads, responses as resp, search, sites
from sitefold.session import fingerprint, left_join_salted, materialize, resumable_run
from sitefold.sources.layout import PageTable, StoredPages


def extract(
    profiles: DataFrame,
    kb: DataFrame,
    prices: DataFrame,
    responses: DataFrame | None = None,
    compat: bool = False,
) -> DataFrame:
    """Site profiles to costed leads: model response if one is valid, else rules."""
    found = leads.rule_leads(profiles, kb, compat)
    if responses is None:
        found = found.withColumn("provider", F.lit("rules"))
        priced = costs.price_one_model(found, prices, leads.RULE_MODEL)
    else:
        priced = costs.price_calls(resp.apply_fallback(found, responses), prices)
    return priced.withColumn(
        "cost_metrics",
        costs.cost_metrics(F.col("input_tokens"), F.col("output_tokens"), F.col("cost")),
    ).drop("cost", "input_tokens", "output_tokens")


def enrich(
    seeds: DataFrame,
    pages: DataFrame | PageTable | StoredPages,
    kb: DataFrame,
    prices: DataFrame,
    search_results: DataFrame,
    responses: DataFrame | None = None,
    *,
    max_subpages: int = crawl.MAX_SUBPAGES,
    max_chars: int = sites.CONTEXT_CHARS,
    denied=text.DENIED_SUFFIXES,
    compat: bool = False,
    resume: str | None = None,
    versions: dict[str, str] | None = None,
) -> DataFrame:
    """One record per seed, repeats included, in the shape of ``schemas.LEAD``
    plus ``seed_no``, ``home_status``, ``provider`` and ``error``.

    The work is done once per distinct seed. Tables are written where several steps
    read the same rows: the page index, the parsed pages, the requested URLs and
    their page ids, the leads before the search. These writes happen when this is called;
    call it inside :func:`sitefold.session.scratch_run` to have the tables deleted once
    the records are written. Page text moves twice only, cut to ``max_chars``: to the seed
    that asked for it, and into its context.

    ``pages`` may be a stored layout, see :mod:`sitefold.sources.layout`. With ``resume``, a
    folder that all executors share, the tables are kept there, and a call with the same
    inputs and parameters goes on after the last complete one. Inputs are told apart by
    their contents, which costs a scan of each, or by ``versions``: a text for the name of an
    input that changes whenever the input does.
    """
    options = {"max_subpages": max_subpages, "max_chars": max_chars, "denied": denied, "compat": compat}
    inputs = (seeds, pages, kb, prices, search_results, responses)
    if resume is None:
        return _records(*inputs, **options)
    with resumable_run(seeds.sparkSession, resume, run_key(inputs, options, versions or {})):
        return _records(*inputs, **options)


INPUTS = ("seeds", "pages", "kb", "prices", "search_results", "responses")


def run_key(inputs: tuple, options: dict, versions: dict[str, str]) -> str:
    """One text for all inputs and parameters of a run."""

    def told(name: str, table) -> str | None:
        if name in versions:
            return "version " + versions[name]
        if isinstance(table, StoredPages):  # written once, so its index tells
            return f"{table.path} {fingerprint(table.index())}"
        if isinstance(table, PageTable):
            table = table.rows
        return table if table is None else fingerprint(table)

    unknown = set(versions) - set(INPUTS)
    if unknown:
        raise ValueError(f"no such input: {sorted(unknown)}")
    key = {"inputs": [told(n, t) for n, t in zip(INPUTS, inputs)], "options": options}
    return hashlib.sha256(json.dumps(key).encode()).hexdigest()[:32]


def _records(
    seeds, pages, kb, prices, search_results, responses, *, max_subpages, max_chars, denied, compat
) -> DataFrame:
    page_rows = crawl.crawl(seeds, pages, max_subpages, denied, max_chars)
    profiles = sites.site_profiles(page_rows, max_chars, include_failed=compat)
    found = extract(profiles, kb, prices, responses, compat)
    own_name = urls.company_name(F.col("domain"))
    slim = materialize(
        found.select(
            "domain",
            F.col("lead.domain").alias("lead_domain"),
            "lead.company_name",
            "lead.company_overview",
            "lead.target_audience",
            "lead.contact_points",
            F.col("lead.key_leadership").alias("leaders"),
            F.when(F.col("lead.company_name") != "", F.col("lead.company_name"))
            .otherwise(own_name)
            .alias("company"),
            "pages_crawled",
            "home_status",
            "provider",
            "cost_metrics",
        ),
        "leads",
    )
    filled = search.fill_leaders(slim, search_results)
    records = filled.select(
        F.col("domain").alias("seed_domain"),
        F.col("lead_domain").alias("domain"),
        "company_name",
        "company_overview",
        "target_audience",
        "contact_points",
        F.col("leaders").alias("key_leadership"),
        scores.completeness(
            F.col("company_overview"),
            F.col("target_audience"),
            F.col("leaders"),
            F.col("contact_points"),
        ).alias("data_confidence_score"),
        "pages_crawled",
        "search_queries_used",
        "cost_metrics",
        "home_status",
        "provider",
        record_error().alias("error"),
    )
    per_seed = seeds.select("seed_no", F.col("domain").alias("seed_domain"))
    return (
        left_join_salted(per_seed, records, "seed_domain", spread_by="seed_no")
        .withColumn(
            "error",
            F.when(F.col("domain").isNull(), F.lit("missing:domain")).otherwise(F.col("error")),
        )
        .drop("seed_domain")
    )


def record_error():
    """Null for a record that fits the schema; one bad record fails alone."""
    required = {
        "domain": "lead_domain",
        "company_name": "company_name",
        "company_overview": "company_overview",
        "target_audience": "target_audience",
        "contact_points": "contact_points",
        "key_leadership": "leaders",
    }
    reasons = [
        F.when(F.col(column).isNull(), F.lit(f"missing:{name}")) for name, column in required.items()
    ]
    return F.coalesce(*reasons)
