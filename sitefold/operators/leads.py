"""Rule-based company records from site profiles and a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitefold import schemas
from sitefold.functions import scores, text, urls

# --- fixed values -----------------------------------------------------------
RULE_MODEL = "gpt-4o-mini"
KB_OUTPUT_TOKENS = 250
RULE_OUTPUT_TOKENS = 200
# ----------------------------------------------------------------------------


def user_prompt(domain: Column, emails: Column, found_urls: Column, context: Column) -> Column:
    """The text a model is asked with."""
    return F.concat(
        F.lit("Target Domain: "), domain,
        F.lit("\nKnown Emails: "), text.list_literal(emails),
        F.lit("\nKnown LinkedIn URLs: "), text.list_literal(found_urls),
        F.lit("\n\nWeb Content:\n"), context,
    )


def override_leader_urls(leaders: Column, found_urls: Column) -> Column:
    """Give each leader the last found URL that contains their first name.

    The test is a plain substring, and company URLs count too.
    """

    def with_url(leader: Column) -> Column:
        first_name = F.lower(F.regexp_extract(leader["name"], rf"^{text.WS}*({text.NON_WS}+)", 1))
        hit = F.try_element_at(
            F.filter(
                found_urls,
                lambda u: (first_name != "") & F.contains(F.lower(u), first_name),
            ),
            F.lit(-1),
        )
        return F.struct(
            leader["name"].alias("name"),
            leader["role"].alias("role"),
            F.coalesce(hit, leader["linkedin_url"]).alias("linkedin_url"),
        )

    return F.transform(leaders, with_url)


def union_contacts(found: Column, known: Column) -> Column:
    return F.array_sort(F.array_union(found, known))


def join_kb(profiles: DataFrame, kb: DataFrame) -> DataFrame:
    """Left join to the knowledge base on the clean domain.

    A domain given twice in ``kb`` counts once. Whether ``kb`` is broadcast is the
    optimizer's decision from its size; past the threshold AQE splits a skewed
    ``profiles`` side (many seeds on one host).
    """
    entry = F.struct("name", "overview", "icp", "contacts", "leadership")
    known = kb.groupBy("domain").agg(F.min(entry).alias("e"))
    return profiles.withColumn("domain_clean", urls.clean_domain(F.col("domain"))).join(
        known.select(
            F.col("domain").alias("domain_clean"),
            F.lit(True).alias("in_kb"),
            F.col("e.name").alias("kb_name"),
            F.col("e.overview").alias("kb_overview"),
            F.col("e.icp").alias("kb_icp"),
            # a list that the knowledge base leaves out is an empty one
            F.coalesce("e.contacts", text.empty_strings()).alias("kb_contacts"),
            F.coalesce("e.leadership", F.array().cast(schemas.LEADERS)).alias("kb_leadership"),
        ),
        "domain_clean",
        "left",
    )


def kb_misses(profiles: DataFrame, kb: DataFrame) -> DataFrame:
    """Profiles without a knowledge-base row: those the dynamic rules serve."""
    return profiles.withColumn("domain_clean", urls.clean_domain(F.col("domain"))).join(
        kb.select(F.col("domain").alias("domain_clean")), "domain_clean", "left_anti"
    )


def text_features(profiles: DataFrame, compat: bool = False) -> DataFrame:
    """Everything later steps need from the long ``context``, which is dropped here,
    before any further shuffle."""
    context = F.col("context")
    name = urls.company_name(urls.clean_domain(F.col("domain")))
    prompt = user_prompt(F.col("domain"), F.col("emails"), F.col("linkedin_urls"), context)
    return profiles.select(
        *[F.col(c) for c in profiles.columns if c != "context"],
        text.leaders(context, compat).alias("text_leaders"),
        text.overview(context, name, skip_page_headers=not compat).alias("text_overview"),
        text.token_estimate(context).alias("context_tokens"),
        F.length(prompt).alias("prompt_chars"),
    )


_FEATURES = ("text_leaders", "text_overview", "context_tokens")


def rule_leads(profiles: DataFrame, kb: DataFrame, compat: bool = False) -> DataFrame:
    """One rule-based record per profile, plus its tokens.

    Input columns: ``domain, emails, linkedin_urls, context``. Further columns are
    kept, ``context`` is not; ``prompt_chars``, ``lead`` (struct), ``model``,
    ``input_tokens`` and ``output_tokens`` are added.
    """
    features = text_features(profiles, compat)
    in_kb = F.coalesce(F.col("in_kb"), F.lit(False))
    found = F.col("emails")

    staged = join_kb(features, kb).withColumns(
        {
            "rule_leaders": F.when(
                in_kb, override_leader_urls(F.col("kb_leadership"), F.col("linkedin_urls"))
            ).otherwise(F.col("text_leaders")),
            "rule_contacts": F.when(in_kb, union_contacts(found, F.col("kb_contacts"))).otherwise(
                found
            ),
        }
    )
    lead = F.struct(
        F.col("domain_clean").alias("domain"),
        F.when(in_kb, F.col("kb_name"))
        .otherwise(urls.company_name(F.col("domain_clean")))
        .alias("company_name"),
        F.when(in_kb, F.col("kb_overview")).otherwise(F.col("text_overview")).alias("company_overview"),
        F.when(in_kb, F.col("kb_icp")).otherwise(F.lit(text.DEFAULT_AUDIENCE)).alias("target_audience"),
        F.col("rule_contacts").alias("contact_points"),
        F.col("rule_leaders").alias("key_leadership"),
        scores.extraction_confidence(in_kb, F.col("rule_contacts"), F.col("rule_leaders")).alias(
            "data_confidence_score"
        ),
    )
    return staged.select(
        *[F.col(c) for c in features.columns if c not in _FEATURES],
        lead.alias("lead"),
        F.lit(RULE_MODEL).alias("model"),
        F.col("context_tokens").alias("input_tokens"),
        F.when(in_kb, F.lit(KB_OUTPUT_TOKENS))
        .otherwise(F.lit(RULE_OUTPUT_TOKENS))
        .cast("bigint")
        .alias("output_tokens"),
    )


def needs_search(leaders: Column) -> Column:
    """No leaders, or one whose URL is null (an empty string does not count)."""
    return (F.size(leaders) == 0) | F.exists(leaders, lambda x: x["linkedin_url"].isNull())


def leader_text(leaders: Column) -> Column:
    """``name (role) - url`` joined by "; ", the URL part only where there is one."""
    return F.array_join(
        F.transform(
            leaders,
            lambda x: F.concat(
                x["name"],
                F.lit(" ("),
                x["role"],
                F.lit(")"),
                F.when(x["linkedin_url"] != "", F.concat(F.lit(" - "), x["linkedin_url"])).otherwise(
                    F.lit("")
                ),
            ),
        ),
        "; ",
    )


def report(records: DataFrame) -> DataFrame:
    """Flat report rows, ten columns in fixed order."""
    return records.select(
        "domain",
        "company_name",
        "company_overview",
        "target_audience",
        F.array_join("contact_points", ", ").alias("contact_points"),
        leader_text(F.col("key_leadership")).alias("key_leadership"),
        "data_confidence_score",
        "cost_metrics.input_tokens",
        "cost_metrics.output_tokens",
        "cost_metrics.estimated_cost_usd",
    )
