"""Model responses: prompts out, validated JSON in, fallback between providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sitefold import schemas
from sitefold.functions import text
from sitefold.operators.leads import user_prompt

# --- fixed values -----------------------------------------------------------
PROVIDERS = ("A", "B")
# Provider A's token count includes the system instruction; its text belongs to
# whoever calls the model, here only its length matters.
SYSTEM_PROMPT_CHARS = {"A": 1082, "B": 0}
# ----------------------------------------------------------------------------

_REQUIRED_STRINGS = ("domain", "company_name", "company_overview", "target_audience")
_STRING_LISTS = ("contact_points", "pages_crawled", "search_queries_used")
_COST_FIELDS = ("input_tokens", "output_tokens", "total_tokens", "estimated_cost_usd")


# -- prompts ------------------------------------------------------------------
def prompt_tokens(prompt_chars: Column, provider: str) -> Column:
    return text.estimate_from_length(prompt_chars + SYSTEM_PROMPT_CHARS[provider])


def prompts(profiles: DataFrame, providers: Sequence[str] = PROVIDERS) -> DataFrame:
    """One prompt per profile and provider, with its token estimate."""
    chars = F.length("user_prompt")
    tokens = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("provider"), prompt_tokens(chars, p).alias("input_tokens"))
                for p in providers
            ]
        )
    )
    return (
        profiles.select(
            "domain",
            user_prompt(
                F.col("domain"), F.col("emails"), F.col("linkedin_urls"), F.col("context")
            ).alias("user_prompt"),
        )
        .select("domain", "user_prompt", tokens.alias("t"))
        .select("domain", "t.provider", "user_prompt", "t.input_tokens")
    )


# -- validation ---------------------------------------------------------------
def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _all_strings(value: Column) -> Column:
    return _kind(value).isin("MISSING", "ARRAY<STRING>", "ARRAY<VOID>") & ~(
        (_kind(value) == "ARRAY<VOID>")
        & (F.size(F.try_variant_get(value, "$", "array<string>")) > 0)
    )


def _leaders_ok(value: Column) -> Column:
    def leader_ok(item: Column) -> Column:
        return (
            (_kind(F.try_variant_get(item, "$.name", "variant")) == "STRING")
            & (_kind(F.try_variant_get(item, "$.role", "variant")) == "STRING")
            & _kind(F.try_variant_get(item, "$.linkedin_url", "variant")).isin(
                "STRING", "VOID", "MISSING"
            )
        )

    items = F.try_variant_get(value, "$", "array<variant>")
    return (_kind(value) == "MISSING") | (
        _kind(value).startswith("ARRAY<") & F.forall(items, leader_ok)
    )


def _costs_ok(value: Column) -> Column:
    ok = (_kind(value) == "MISSING") | _kind(value).startswith("OBJECT<")
    for name in _COST_FIELDS:
        item = F.try_variant_get(value, f"$.{name}", "variant")
        number = F.try_variant_get(value, f"$.{name}", "double")
        whole = F.lit(True) if name == "estimated_cost_usd" else number == F.floor(number)
        ok = ok & ((_kind(item) == "MISSING") | (number.isNotNull() & whole))
    return ok


def validation_reason(raw_json: Column) -> Column:
    """Why a response does not fit the record schema; null when it does.

    Checks run in a fixed order: JSON syntax, required strings, lists, leaders,
    costs, then the score and its range.
    """
    return text.bound(F.try_parse_json(raw_json), _document_reason)


def _document_reason(doc: Column) -> Column:
    kind = _kind(doc)
    score_field = _field(doc, "data_confidence_score")
    score = F.try_variant_get(doc, "$.data_confidence_score", "double")

    reason = F.when(doc.isNull(), F.lit("malformed_json")).when(
        ~kind.startswith("OBJECT<"), F.lit("not_an_object")
    )
    for name in _REQUIRED_STRINGS:
        field_kind = _kind(_field(doc, name))
        reason = reason.when(field_kind == "MISSING", F.lit(f"missing:{name}")).when(
            field_kind != "STRING", F.lit(f"bad_type:{name}")
        )
    for name in _STRING_LISTS:
        reason = reason.when(~_all_strings(_field(doc, name)), F.lit(f"bad_type:{name}"))
    return (
        reason.when(~_leaders_ok(_field(doc, "key_leadership")), F.lit("bad_type:key_leadership"))
        .when(~_costs_ok(_field(doc, "cost_metrics")), F.lit("bad_type:cost_metrics"))
        .when(_kind(score_field) == "MISSING", F.lit("missing:data_confidence_score"))
        .when(score.isNull(), F.lit("bad_type:data_confidence_score"))
        .when(~score.between(0.0, 1.0), F.lit("score_out_of_range"))
    )


def validate(responses: DataFrame) -> DataFrame:
    """Add ``reason`` (null when valid) and ``valid``."""
    return responses.withColumn("reason", validation_reason(F.col("raw_json"))).withColumn(
        "valid", F.col("reason").isNull()
    )


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.filter(~F.col("valid"))


def parse_lead(raw_json: Column) -> Column:
    """Lead struct of a valid response; absent lists become empty."""
    return text.bound(F.try_parse_json(raw_json), _document_lead)


def _document_lead(doc: Column) -> Column:
    return F.struct(
        *[F.try_variant_get(doc, f"$.{n}", "string").alias(n) for n in _REQUIRED_STRINGS],
        F.coalesce(
            F.try_variant_get(doc, "$.contact_points", "array<string>"), text.empty_strings()
        ).alias("contact_points"),
        F.coalesce(
            F.try_variant_get(
                doc, "$.key_leadership", "array<struct<name string, role string, linkedin_url string>>"
            ),
            F.array().cast(schemas.LEADERS),
        ).alias("key_leadership"),
        F.try_variant_get(doc, "$.data_confidence_score", "double").alias("data_confidence_score"),
    )


# -- tokens of an accepted response ---------------------------------------------
def _dumped_length(raw_json: Column) -> Column:
    """Length of the whole record printed as JSON with ", " and ": " separators and
    non-ASCII characters as ``\\uXXXX``: what provider A's output tokens count."""
    full = text.bound(F.from_json(raw_json, schemas.LEAD), _with_defaults)
    return text.bound(full, _printed_length)


def _with_defaults(record: Column) -> Column:
    strings = text.empty_strings()
    costs = record["cost_metrics"]
    return F.struct(
        *[record[n].alias(n) for n in _REQUIRED_STRINGS],
        F.coalesce(record["contact_points"], strings).alias("contact_points"),
        F.coalesce(record["key_leadership"], F.array().cast(schemas.LEADERS)).alias("key_leadership"),
        record["data_confidence_score"].alias("data_confidence_score"),
        F.coalesce(record["pages_crawled"], strings).alias("pages_crawled"),
        F.coalesce(record["search_queries_used"], strings).alias("search_queries_used"),
        F.struct(
            *[F.coalesce(costs[n], F.lit(0).cast("bigint")).alias(n) for n in _COST_FIELDS[:3]],
            F.coalesce(costs[_COST_FIELDS[3]], F.lit(0.0)).alias(_COST_FIELDS[3]),
        ).alias("cost_metrics"),
    )


def _printed_length(full: Column) -> Column:
    def commas(name: str) -> Column:
        return F.greatest(F.size(full[name]) - 1, F.lit(0))

    # one space per ":" and per "," between values: the record, its costs, its lists
    separators = (
        F.lit(10 + 9 + 4 + 3)
        + commas("contact_points")
        + commas("pages_crawled")
        + commas("search_queries_used")
        + commas("key_leadership")
        + F.size(full["key_leadership"]) * (3 + 2)
    )
    return text.bound(
        F.to_json(full, {"ignoreNullFields": "false"}),
        lambda compact: F.length(compact)
        + separators
        + 5 * F.regexp_count(compact, F.lit(r"[^\x{20}-\x{7e}]"))
        + 6 * F.regexp_count(compact, F.lit(r"[\x{10000}-\x{10ffff}]")),
    )


def response_tokens(raw_json: Column, provider: Column) -> Column:
    chars = F.when(provider == "A", _dumped_length(raw_json)).otherwise(F.length(raw_json))
    return text.estimate_from_length(chars)


# -- fallback -------------------------------------------------------------------
def accepted_responses(
    validated: DataFrame, providers: Sequence[str] = PROVIDERS
) -> DataFrame:
    """The valid response of the first provider that has one, one row per domain.

    A fixed-size partial aggregate per provider, so repeated responses of one
    domain are combined before the shuffle.
    """
    answer = F.struct("raw_json", "model")
    per_provider = [
        F.min(F.when(F.col("valid") & (F.col("provider") == p), answer)).alias(f"answer_{p}")
        for p in providers
    ]
    chosen = F.coalesce(
        *[
            F.when(
                F.col(f"answer_{p}").isNotNull(),
                F.struct(
                    F.lit(p).alias("provider"),
                    F.col(f"answer_{p}.model").alias("response_model"),
                    F.col(f"answer_{p}.raw_json").alias("raw_json"),
                ),
            )
            for p in providers
        ]
    )
    return (
        validated.filter("valid")
        .groupBy("domain")
        .agg(*per_provider)
        .select("domain", chosen.alias("c"))
        .select("domain", "c.*")
    )


def apply_fallback(
    leads: DataFrame, responses: DataFrame, providers: Sequence[str] = PROVIDERS
) -> DataFrame:
    """Replace a rule-based ``lead`` by the accepted response where there is one.

    ``leads`` has the columns of :func:`sitefold.operators.leads.rule_leads`.
    Responses are keyed by the domain that was asked for. Tokens and model follow
    the chosen provider; ``provider`` is "rules" otherwise.
    """
    accepted = accepted_responses(validate(responses), providers)
    joined = leads.join(accepted, "domain", "left")
    chosen = F.col("provider").isNotNull()
    asked = F.lit(None).cast("bigint")
    for p in providers:
        asked = F.when(F.col("provider") == p, prompt_tokens(F.col("prompt_chars"), p)).otherwise(asked)
    kept = [F.col(c) for c in leads.columns if c not in _LEAD_COLUMNS]
    return joined.select(
        *kept,
        F.when(chosen, parse_lead(F.col("raw_json"))).otherwise(F.col("lead")).alias("lead"),
        F.when(chosen, F.col("response_model")).otherwise(F.col("model")).alias("model"),
        F.when(chosen, asked).otherwise(F.col("input_tokens")).alias("input_tokens"),
        F.when(chosen, response_tokens(F.col("raw_json"), F.col("provider")))
        .otherwise(F.col("output_tokens"))
        .alias("output_tokens"),
        F.coalesce("provider", F.lit("rules")).alias("provider"),
    )


_LEAD_COLUMNS = ("lead", "model", "input_tokens", "output_tokens")


def batch_status(domains: DataFrame, responses: DataFrame) -> DataFrame:
    """Row-level isolation without the rule fallback: a domain none of whose
    responses is valid fails with its first reason, the others are unaffected."""
    outcome = (
        validate(responses)
        .groupBy("domain")
        .agg(
            F.max("valid").alias("ok"),
            F.min(F.struct("provider", "reason")).alias("first"),
        )
    )
    failed = ~F.coalesce(F.col("ok"), F.lit(False))
    return domains.join(outcome, "domain", "left").select(
        *[domains[c] for c in domains.columns],
        F.when(failed, F.coalesce(F.col("first.reason"), F.lit("no_response"))).alias("error"),
    )
