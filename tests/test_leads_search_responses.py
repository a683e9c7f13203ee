"""Rules, search fill, responses, costs and scores."""

import json

import pytest
from pyspark.sql import functions as F

from sitefold import schemas
from sitefold.functions import scores
from sitefold.operators import costs, leads, responses, search


def leader(name, role="CEO", url=None):
    return {"name": name, "role": role, "linkedin_url": url}


@pytest.fixture()
def kb(spark):
    return spark.createDataFrame(
        [("acme.io", "Acme", "Acme is an API platform. It helps teams.", "Software engineers and teams",
          ["help@acme.io", "sales@acme.io"],
          [leader("Ada Stone", "CEO", "https://www.linkedin.com/in/acme"), leader("Bo Lind", "CTO")])],
        schemas.KNOWLEDGE_BASE)


PROFILE = "domain string, emails array<string>, linkedin_urls array<string>, context string"


def rule_lead(spark, kb, domain, emails, urls, context, **kw):
    df = spark.createDataFrame([(domain, emails, urls, context)], PROFILE)
    return leads.rule_leads(df, kb, **kw).first()


def test_kb_hit(spark, kb):
    row = rule_lead(spark, kb, "https://ACME.io/x", ["help@acme.io", "b@acme.io"],
                    ["https://linkedin.com/company/adastra", "https://linkedin.com/in/ada-1"], "Acme is an API platform.")
    lead = row["lead"]
    assert lead["domain"] == "acme.io" and lead["company_name"] == "Acme"
    assert lead["contact_points"] == ["b@acme.io", "help@acme.io", "sales@acme.io"]
    # the last found URL with the first name wins, others keep theirs
    assert [x["linkedin_url"] for x in lead["key_leadership"]] == ["https://linkedin.com/in/ada-1", None]
    assert lead["data_confidence_score"] == 0.95
    assert (row["input_tokens"], row["output_tokens"], row["model"]) == (6, 250, "gpt-4o-mini")


def test_lists_that_the_knowledge_base_leaves_out(spark):
    """Null lists are empty ones, so contacts stay and the broad search runs."""
    bare = spark.createDataFrame([("acme.io", "Acme", "About.", "Teams", None, None)], schemas.KNOWLEDGE_BASE)
    lead = rule_lead(spark, bare, "acme.io", ["b@acme.io"], [], "x")["lead"]
    assert lead["contact_points"] == ["b@acme.io"] and lead["key_leadership"] == []
    assert rule_lead(spark, bare, "acme.io", [], [], "x")["lead"]["contact_points"] == []


def test_copies_in_the_knowledge_base_count_once(spark, kb):
    twice = kb.unionByName(kb)
    df = spark.createDataFrame([("acme.io", [], [], "x")], PROFILE)
    assert leads.rule_leads(df, twice).count() == 1


def test_company_urls_count_for_the_override(spark, kb):
    row = rule_lead(spark, kb, "acme.io", [], ["https://linkedin.com/company/adastra"], "x")
    assert row["lead"]["key_leadership"][0]["linkedin_url"] == "https://linkedin.com/company/adastra"


def test_rules_for_unknown_domain(spark, kb):
    context = "Ada Stone, CEO of things and more. CTO: Bo Lind leads the builders here."
    row = rule_lead(spark, kb, "www.other.org", [], ["https://linkedin.com/in/ada"], context)
    lead = row["lead"]
    assert lead["company_name"] == "Www" and row["output_tokens"] == 200
    assert [(x["name"], x["role"], x["linkedin_url"]) for x in lead["key_leadership"]] == [
        ("Ada Stone", "CEO", None), ("Bo Lind", "CTO", None)]
    assert lead["data_confidence_score"] == 0.70
    nothing = rule_lead(spark, kb, "other.org", [], [], "tiny")["lead"]
    assert nothing["company_overview"] == "Other provides digital products and services."
    assert nothing["data_confidence_score"] == 0.50 and nothing["key_leadership"] == []


def test_rule_records_always_score_085(spark, kb):
    lead = rule_lead(spark, kb, "a.b", [], [], "")["lead"]
    assert len(lead["company_overview"]) > 30 and len(lead["target_audience"]) > 15


def test_completeness(spark):
    df = spark.createDataFrame([("x" * 31, "y" * 16, ["l"], ["c"]), ("x" * 30, "y" * 15, [], []), (None, None, [], ["c"])],
                               "o string, a string, l array<string>, c array<string>")
    got = [r[0] for r in df.select(scores.completeness(F.col("o"), F.col("a"), F.col("l"), F.col("c"))).collect()]
    assert got == [1.0, 0.5, 0.55]


def test_report_text(spark):
    df = spark.createDataFrame([([leader("A B", "CEO", "u"), leader("C D", "CTO"), leader("E F", "VP", "")],)],
                               f"l {schemas.LEADERS.simpleString()}")
    assert df.select(leads.leader_text(F.col("l"))).first()[0] == "A B (CEO) - u; C D (CTO); E F (VP)"


# -- search -----------------------------------------------------------------------
OPEN = f"domain string, company string, leaders {schemas.LEADERS.simpleString()}"


def hit(query, rank, href="", body="", title="T - x"):
    return (query, rank, title, href, body)


def fill(spark, leads_rows, hits):
    out = search.fill_leaders(spark.createDataFrame(leads_rows, OPEN), spark.createDataFrame(hits, schemas.SEARCH_RESULTS))
    return {r["domain"]: r for r in out.collect()}


def person(name, company="Acme"):
    return f'"{name}" "{company}" site:linkedin.com/in'


def test_person_search_uses_first_of_two_hits(spark):
    q = person("Ada Stone")
    got = fill(spark, [("a", "Acme", [leader("Ada Stone"), leader("Bo Lind", "CTO", "kept")])],
               [hit(q, 3, "https://linkedin.com/in/third"), hit(q, 2, "n", "x https://linkedin.com/in/second/ y"),
                hit(q, 1, "https://news.org")])["a"]
    assert [x["linkedin_url"] for x in got["leaders"]] == ["https://linkedin.com/in/second", "kept"]
    assert got["search_queries_used"] == [q]


def test_third_hit_is_out_of_reach(spark):
    got = fill(spark, [("a", "Acme", [leader("Ada Stone")])], [hit(person("Ada Stone"), 3, "https://linkedin.com/in/x"),
               hit(person("Ada Stone"), 1), hit(person("Ada Stone"), 2)])["a"]
    assert got["leaders"][0]["linkedin_url"] is None


def test_empty_url_is_filled_only_once_triggered(spark):
    hits = [hit(person("Ada Stone"), 1, "https://linkedin.com/in/found")]
    alone = fill(spark, [("a", "Acme", [leader("Ada Stone", url="")])], hits)["a"]
    assert alone["leaders"][0]["linkedin_url"] == "" and alone["search_queries_used"] == []
    both = fill(spark, [("a", "Acme", [leader("Ada Stone", url=""), leader("Bo Lind")])], hits)["a"]
    assert [x["linkedin_url"] for x in both["leaders"]] == ["https://linkedin.com/in/found", None]


def test_broad_search_keeps_order_and_repeats(spark):
    one, two = '"Acme" founder CEO CTO site:linkedin.com/in', '"Acme" leadership team site:linkedin.com/in'
    hits = [hit(two, 1, "https://linkedin.com/in/b", title="Bo Lind | x"), hit(one, 3, "https://linkedin.com/in/c", title="Cy-Lee"),
            hit(one, 1, "https://linkedin.com/in/b", title="Bo Lind - CTO"), hit(one, 2, "none"),
            hit(one, 4, "https://linkedin.com/in/d", title="D")]
    got = fill(spark, [("a", "Acme", []), ("z", "Zed", [])], hits)
    assert [(x["name"], x["role"], x["linkedin_url"]) for x in got["a"]["leaders"]] == [
        ("Bo Lind", "Leadership Team", "https://linkedin.com/in/b"), ("Cy", "Leadership Team", "https://linkedin.com/in/c"),
        ("Bo Lind", "Leadership Team", "https://linkedin.com/in/b")]
    assert got["a"]["search_queries_used"] == [one] and got["z"]["leaders"] == []


def test_copies_of_hits_count_once(spark):
    one = '"Acme" founder CEO CTO site:linkedin.com/in'
    hits = [hit(one, 1)] * 500 + [hit(one, 2, "https://linkedin.com/in/b", title="Bo Lind")] * 500
    got = fill(spark, [("a", "Acme", [])], hits)["a"]
    assert [x["name"] for x in got["leaders"]] == ["Bo Lind"]


def test_different_hits_of_one_rank_all_count(spark):
    one = '"Acme" founder CEO CTO site:linkedin.com/in'
    hits = [hit(one, 1, "https://linkedin.com/in/b", title="Bo Lind"), hit(one, 1, "https://linkedin.com/in/a", title="Ada Stone")]
    got = fill(spark, [("a", "Acme", [])], hits)["a"]
    assert [x["name"] for x in got["leaders"]] == ["Ada Stone", "Bo Lind"]


def test_bodies_move_only_for_the_first_hits(spark):
    rows = [(f"q{k % 40}", k // 40, f"t{k}", f"h{k}", "body" * 50) for k in range(4000)]
    hits = spark.createDataFrame(rows, schemas.SEARCH_RESULTS).repartition(6)
    seen = []
    chosen = search.materialize
    search.materialize = lambda df, name: seen.append(df) or chosen(df, name)
    try:
        top = search.top_hits(hits, 3)
    finally:
        search.materialize = chosen
    first = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert first.count("body") and "Aggregate [query" in first
    for line in first.split("\n"):  # above the hash there is no body
        if "Aggregate" in line or "Window" in line:
            assert "body" not in line
    got = sorted((r["query"], r["hit_no"], r["href"]) for r in top.collect())
    assert got == sorted((f"q{q}", n + 1, f"h{n * 40 + q}") for q in range(40) for n in range(3))


def test_repeated_leaders_are_filled_each(spark):
    got = fill(spark, [("a", "Acme", [leader("Ada Stone"), leader("Ada Stone")])],
               [hit(person("Ada Stone"), 1, "https://linkedin.com/in/x")])["a"]
    assert [x["linkedin_url"] for x in got["leaders"]] == ["https://linkedin.com/in/x"] * 2
    assert len(got["search_queries_used"]) == 2


# -- costs ------------------------------------------------------------------------
def test_call_costs(spark):
    calls = spark.createDataFrame(
        [(1, "d", "gpt-4o-mini", 1_000_000, 1_000_000), (2, "d", "GPT-4O", 1000, 500), (3, "d", "other", 1000, 500),
         (4, "d", "gpt-4o-mini", 3450, 250)], schemas.CALLS)
    priced = costs.price_calls(calls, costs.model_prices(spark))
    assert {r["call_id"]: float(r["cost"]) for r in priced.collect()} == {1: 0.75, 2: 0.0075, 3: 0.00045, 4: 0.000668}
    total = costs.cost_totals(priced).first()
    assert (total["calls"], total["input_tokens"], total["total_tokens"]) == (4, 1_005_450, 2_006_700)
    assert total["estimated_cost_usd"] == pytest.approx(0.758618)


# -- responses ----------------------------------------------------------------------
GOOD = {"domain": "acme.io", "company_name": "Acmé \"x\"", "company_overview": "Sells tools.\nFast 😀.", "target_audience": "Teams",
        "contact_points": ["a@x.io"], "key_leadership": [leader("Ada", "CEO"), leader("Bo", "CTO", "u")], "data_confidence_score": 0.9}


def variant(**changes):
    doc = {**GOOD, **changes}
    return json.dumps({k: v for k, v in doc.items() if v != "DROP"})


def test_validation_reasons(column):
    cases = {
        json.dumps(GOOD): None,
        variant(contact_points="DROP", key_leadership="DROP"): None,
        variant(data_confidence_score="0.4"): None,
        variant(data_confidence_score=1): None,
        variant(cost_metrics={"input_tokens": 3}): None,
        variant(key_leadership=[]): None,
        '{"domain": "broken': "malformed_json",
        "": "malformed_json",
        "[1]": "not_an_object",
        variant(company_name="DROP"): "missing:company_name",
        variant(company_name=3): "bad_type:company_name",
        variant(target_audience=None): "bad_type:target_audience",
        variant(contact_points=[1]): "bad_type:contact_points",
        variant(contact_points=[None]): "bad_type:contact_points",
        variant(contact_points=None): "bad_type:contact_points",
        variant(key_leadership=[{"name": "x"}]): "bad_type:key_leadership",
        variant(key_leadership=["x"]): "bad_type:key_leadership",
        variant(key_leadership=[leader("Ada"), {"name": 1, "role": "r"}]): "bad_type:key_leadership",
        variant(cost_metrics={"input_tokens": 1.5}): "bad_type:cost_metrics",
        variant(data_confidence_score="DROP"): "missing:data_confidence_score",
        variant(data_confidence_score="high"): "bad_type:data_confidence_score",
        variant(data_confidence_score=1.01): "score_out_of_range",
        variant(data_confidence_score=-0.1): "score_out_of_range",
    }
    assert dict(zip(cases, column(list(cases), responses.validation_reason))) == cases


def test_token_counts_follow_the_provider(column):
    full = {**GOOD, "pages_crawled": [], "search_queries_used": [],
            "cost_metrics": {"input_tokens": 0, "output_tokens": 0, "total_tokens": 0, "estimated_cost_usd": 0.0}}
    other = {**full, "contact_points": ["a", "b", "c"], "key_leadership": [], "pages_crawled": ["p", "q"]}
    raw = [json.dumps(GOOD, ensure_ascii=False), json.dumps(other)]
    assert column(raw, responses._dumped_length) == [len(json.dumps(full)), len(json.dumps(other))]
    assert column(raw, lambda c: responses.response_tokens(c, F.lit("B"))) == [len(r) // 4 for r in raw]


def test_prompt(spark):
    df = spark.createDataFrame([("acme.io", ["a@x.io", "b@x.io"], [], "Text")], PROFILE)
    rows = {r["provider"]: r for r in responses.prompts(df).collect()}
    prompt = "Target Domain: acme.io\nKnown Emails: ['a@x.io', 'b@x.io']\nKnown LinkedIn URLs: []\n\nWeb Content:\nText"
    assert rows["A"]["user_prompt"] == prompt
    assert rows["A"]["input_tokens"] == (1082 + len(prompt)) // 4 and rows["B"]["input_tokens"] == len(prompt) // 4


def test_fallback_order(spark, kb):
    profiles = spark.createDataFrame([(d, ["a@x.io"], [], "Some text") for d in ("a.io", "b.io", "c.io", "d.io")], PROFILE)
    bad = '{"domain": "broken'
    rows = [("a.io", "A", "m", variant(domain="elsewhere")), ("a.io", "B", "m", json.dumps(GOOD)), ("b.io", "A", "m", bad),
            ("b.io", "B", "g", variant(contact_points="DROP")), ("c.io", "A", "m", bad), ("c.io", "B", "g", bad)]
    out = responses.apply_fallback(leads.rule_leads(profiles, kb), spark.createDataFrame(rows, schemas.RESPONSES))
    got = {r["domain"]: r for r in out.collect()}
    assert {d: r["provider"] for d, r in got.items()} == {"a.io": "A", "b.io": "B", "c.io": "rules", "d.io": "rules"}
    assert got["a.io"]["lead"]["domain"] == "elsewhere" and got["a.io"]["lead"]["company_name"] == GOOD["company_name"]
    assert got["b.io"]["lead"]["contact_points"] == [] and got["b.io"]["model"] == "g"
    assert got["c.io"]["lead"]["company_name"] == "C"
    status = responses.batch_status(profiles.select("domain"), spark.createDataFrame(rows, schemas.RESPONSES))
    assert {r["domain"]: r["error"] for r in status.collect()} == {
        "a.io": None, "b.io": None, "c.io": "malformed_json", "d.io": "no_response"}


def test_many_copies_of_a_response(spark):
    rows = [("a.io", "A", "m", json.dumps(GOOD))] * 300 + [("a.io", "B", "g", json.dumps(GOOD))]
    got = responses.accepted_responses(responses.validate(spark.createDataFrame(rows, schemas.RESPONSES))).collect()
    assert [(r["domain"], r["provider"]) for r in got] == [("a.io", "A")]


def test_hits_nobody_asked_for_are_left_out(spark, monkeypatch):
    q = person("Ada Stone")
    hits = [hit(q, 1, "https://linkedin.com/in/x")] + [hit(f"other {k}", 1) for k in range(2000)]
    seen, top = [], search.top_hits
    monkeypatch.setattr(search, "top_hits", lambda df, k: seen.append(df.count()) or top(df, k))
    got = fill(spark, [("a", "Acme", [leader("Ada Stone")])], hits)["a"]
    assert got["leaders"][0]["linkedin_url"] == "https://linkedin.com/in/x"
    assert 1 <= seen[0] < 200
