"""Inputs derived from the given tables, as one SQL text for Spark and for the oracle.

Only the small constant lists differ: Spark inlines them per row, the oracle joins
them. Every derived table grows with ``customer`` or ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitefold import schemas
from sitefold.operators import costs

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _each(dialect: str, alias: str, columns: str, rows: list[tuple]) -> str:
    tuples = ["(" + ", ".join(_literal(v) for v in row) + ")" for row in rows]
    if dialect == "spark":
        structs = ", ".join("struct" + t for t in tuples)
        return f"LATERAL VIEW inline(array({structs})) {alias} AS {columns}"
    return f"CROSS JOIN (VALUES {', '.join(tuples)}) AS {alias}({columns})"


_SITE = "lower(c.c_mktsegment) || cast(c.c_custkey AS string)"


def site_pages_sql(dialect: str) -> str:
    kinds = _each(
        dialect,
        "k",
        "page_no, kind, path",
        [(0, "home", ""), (1, "about", "/about"), (2, "pricing", "/pricing"), (3, "team", "/team")],
    )
    n = "cast(c.c_custkey AS string)"
    return f"""
SELECT c.c_custkey AS site_id,
       c.c_custkey * 10 + k.page_no AS page_id,
       {_SITE} || '.com' AS domain,
       k.page_no, k.kind,
       'https://' || {_SITE} || '.com' || k.path AS url,
       CASE WHEN (c.c_custkey + k.page_no) % 7 = 6 AND k.page_no > 0 THEN 500 ELSE 200 END AS status_code,
       '<html><head><title>' || n.n_name || '</title><script>var t="trk' || {n} || '@sentry.io";</script><style>p{{color:red}}</style></head><body>'
       || '<nav><a href="/about">About</a> <a href="/about/">About</a> <a href="/pricing?ref=' || {n} || '#top">Pricing</a> <a href="#x">x</a> <a href="mailto:hi@x.io">m</a> <a href="/blog">Blog</a> <a href="https://jobs.' || {_SITE} || '.com/careers">Jobs</a> <a href="https://other.org/team">T</a> <a href="team">Team</a> <a href="/contact-us">C</a> <a href="/company">Co</a></nav>'
       || '<h1>' || c.c_name || '</h1><div style="display: none">hidden' || {n} || '</div>'
       || '<p>' || n.n_name || ' builds ' || lower(c.c_mktsegment) || ' data tools. They serve segment number ' || cast(c.c_nationkey AS string) || ' buyers.</p>'
       || CASE WHEN c.c_custkey % 3 = 0 THEN '<p>Ada Stone, CEO</p><p>CTO: Bo Lind</p><a href="https://www.linkedin.com/in/ada-stone-' || {n} || '/">in</a>' ELSE '' END
       || CASE WHEN c.c_custkey % 2 = 0 THEN '<p>Mail Sales' || {n} || '@' || lower(c.c_mktsegment) || '.io or logo@2x.png</p>' ELSE '' END
       || '<footer>info@' || {_SITE} || '.com</footer></body></html>' AS html
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
{kinds}
WHERE k.page_no = 0 OR (c.c_custkey + k.page_no) % 5 <> 0
"""


def seeds_sql(dialect: str) -> str:
    """Every site once, and every eleventh site twice."""
    return f"""
SELECT c.c_custkey * 2 + k.again AS seed_no, {_SITE} || '.com' AS domain
FROM customer c
{_each(dialect, "k", "again", [(0,), (1,)])}
WHERE k.again = 0 OR c.c_custkey % 11 = 0
"""


def raw_seeds_sql(dialect: str) -> str:
    """Seeds as people type them: padded, with schemes, paths, queries, upper case."""
    return f"""
SELECT c_custkey AS seed_no,
       CASE c_custkey % 5 WHEN 0 THEN {_SITE} || '.com'
            WHEN 1 THEN '  ' || {_SITE} || '.com' || chr(10)
            WHEN 2 THEN 'http://' || {_SITE} || '.com/x/y'
            WHEN 3 THEN 'HTTPS://WWW.' || {_SITE} || '.com/'
            ELSE 'https://' || {_SITE} || '.com/a?b=c#d' END AS domain
FROM customer c
"""


LINK_CASES = [
    # link_no, href, absolute form against https://{D}/a/b?q=1
    (1, "/about", "https://{D}/about"),
    (2, "team", "https://{D}/a/team"),
    (3, "../x", "https://{D}/x"),
    (4, "./y/", "https://{D}/a/y/"),
    (5, "?p=2", "https://{D}/a/b?p=2"),
    (6, "#f", "https://{D}/a/b?q=1#f"),
    (7, "//cdn.{D}/z", "https://cdn.{D}/z"),
    (8, "http://o.org/m", "http://o.org/m"),
    (9, "mailto:a@b.c", "mailto:a@b.c"),
    (10, "", "https://{D}/a/b?q=1"),
    (11, "../../../up", "https://{D}/up"),
    (12, "g//h", "https://{D}/a/g/h"),
    (13, "/p/../q", "https://{D}/q"),
    (14, "x/..", "https://{D}/a/"),
    (15, "HTTPS://Host.{D}/K?z#w", "https://Host.{D}/K?z#w"),
]


def links_sql(dialect: str) -> str:
    """Links of every shape on one page per site."""
    cases = _each(dialect, "k", "link_no, href, absolute", LINK_CASES)
    return f"""
SELECT c.c_custkey AS site_id, k.link_no,
       'https://' || {_SITE} || '.com/a/b?q=1' AS base_url,
       replace(k.href, '{{D}}', {_SITE} || '.com') AS href,
       replace(k.absolute, '{{D}}', {_SITE} || '.com') AS absolute
FROM customer c {cases}
"""


def leader_text_sql(dialect: str) -> str:
    """Text that names leaders in both forms, with dashes, a no-break space, repeats."""
    return """
SELECT c_custkey AS site_id,
       'Ada Stone, CEO. Bo Lind – CTO. Ada Stone,\u00a0CEO. '
       || CASE WHEN c_custkey % 2 = 0 THEN 'Cy Moor - Founder; Di Vale, VP. ' ELSE '' END
       || CASE WHEN c_custkey % 3 = 0 THEN 'Hal Ives (CEO) Jo Kerr CTO. ' ELSE '' END
       || 'Founder: Ed Poe. CEO - Flo Ray. CTO–Gus Tan, VP. CEO - Flo Ray. ' || c_name AS txt
FROM customer
"""


def lead_leaders_sql(dialect: str) -> str:
    """Leaders of every third site: with a URL, with an empty one, with none."""
    rows = _each(
        dialect, "k", "leader_no, name, role", [(1, "Ada Stone", "CEO"), (2, "Bo Lind", "CTO")]
    )
    return f"""
SELECT {_SITE} || '.com' AS domain, k.leader_no, k.name, k.role,
       CASE WHEN c.c_custkey % 4 = 0 OR (k.leader_no = 1 AND c.c_custkey % 4 = 1)
            THEN 'https://www.linkedin.com/in/known-' || cast(c.c_custkey AS string)
            WHEN c.c_custkey % 4 = 2 AND k.leader_no = 2 THEN ''
            ELSE NULL END AS linkedin_url
FROM customer c {rows}
WHERE c.c_custkey % 3 = 0
"""


def lead_companies_sql(dialect: str) -> str:
    return f"""
SELECT {_SITE} || '.com' AS domain,
       substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || cast(c_custkey AS string) AS company
FROM customer c
"""


def kb_sql(dialect: str) -> str:
    return f"""
SELECT {_SITE} || '.com' AS domain,
       c_name AS name,
       c_name || ' is a platform in the knowledge base. It has a second sentence.' AS overview,
       'Teams in segment ' || c_mktsegment AS icp,
       'kb' || cast(c_custkey AS string) || '@' || {_SITE} || '.com' AS contact
FROM customer c WHERE c_custkey % 4 = 0
"""


def kb_leaders_sql(dialect: str) -> str:
    rows = _each(
        dialect, "k", "leader_no, name, role", [(1, "Ada Stone", "CEO"), (2, "Cy Moor", "CTO")]
    )
    return f"""
SELECT {_SITE} || '.com' AS domain,
       k.leader_no, k.name, k.role,
       CASE WHEN k.leader_no = 1 OR c.c_custkey % 8 = 0 THEN 'https://www.linkedin.com/in/kb-' || cast(c.c_custkey AS string) ELSE NULL END AS linkedin_url
FROM customer c {rows}
WHERE c.c_custkey % 4 = 0
"""


def model_prices_sql(dialect: str) -> str:
    rows = ", ".join(f"('{model}', {i}, {o})" for model, i, o in costs.PRICES)
    return f"SELECT * FROM (VALUES {rows}) AS p(model, in_milli, out_milli)"


def calls_sql(dialect: str) -> str:
    return """
SELECT o_orderkey AS call_id,
       'd' || cast(o_custkey AS string) || '.com' AS domain,
       CASE o_orderkey % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'GPT-4o' WHEN 2 THEN 'gemini-2.5-flash' ELSE 'unlisted-model' END AS model,
       o_orderkey % 9000 + 10 AS input_tokens,
       CASE WHEN o_orderkey % 2 = 0 THEN 250 ELSE 200 END AS output_tokens
FROM orders
"""


def search_results_sql(dialect: str) -> str:
    queries = _each(dialect, "k", "q", [(0,), (1,), (2,)])
    ranks = _each(dialect, "r", "rank", [(1,), (2,), (3,), (4,)])
    return f"""
SELECT q.query, r.rank,
       CASE WHEN r.rank = 3 THEN 'Di Vale | Profile' ELSE 'Bo Lind - CTO | Profile' END AS title,
       CASE WHEN r.rank = 2 OR (r.rank = 1 AND q.site_id % 2 = 1) THEN 'https://news.org/' || cast(q.site_id AS string)
            ELSE 'https://www.linkedin.com/in/hit' || cast(r.rank AS string) || '-' || cast(q.site_id AS string) || '/' END AS href,
       CASE WHEN r.rank = 2 THEN 'see http://linkedin.com/in/body-' || cast(q.site_id AS string) || ' now' ELSE 'no link' END AS body
FROM (
  SELECT c_custkey AS site_id,
         CASE WHEN k.q = 0 THEN '"Bo Lind" "' || co || '" site:linkedin.com/in'
              WHEN k.q = 1 THEN '"' || co || '" founder CEO CTO site:linkedin.com/in'
              ELSE '"' || co || '" leadership team site:linkedin.com/in' END AS query
  FROM (SELECT c_custkey, substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || cast(c_custkey AS string) AS co FROM customer) x
  {queries}
) q {ranks}
"""


def llm_responses_sql(dialect: str) -> str:
    providers = _each(
        dialect, "p", "provider, model", [("A", "gpt-4o-mini"), ("B", "gemini-2.5-flash")]
    )
    return f"""
SELECT {_SITE} || '.com' AS domain, p.provider, p.model,
       CASE WHEN (p.provider = 'A' AND c.c_custkey % 5 = 1) OR (p.provider = 'B' AND c.c_custkey % 2 = 1) THEN '{{"domain": "broken'
            ELSE '{{"domain":"' || {_SITE} || '.com",'
              || CASE WHEN p.provider = 'A' AND c.c_custkey % 5 = 3 THEN '' ELSE '"company_name":"' || c.c_name || '",' END
              || '"company_overview":"' || p.provider || ' says it sells tools. It has buyers.","target_audience":"Teams buying tools","contact_points":["info@x.io"],'
              || '"key_leadership":[{{"name":"Ada Stone","role":"CEO","linkedin_url":null}}],"data_confidence_score":'
              || CASE WHEN p.provider = 'A' AND c.c_custkey % 5 = 2 THEN '1.7' ELSE '0.9' END || '}}' END AS raw_json
FROM customer c {providers}
WHERE NOT (p.provider = 'A' AND c.c_custkey % 5 = 4)
"""


DERIVED = {
    "fx_site_pages": site_pages_sql,
    "fx_seeds": seeds_sql,
    "fx_raw_seeds": raw_seeds_sql,
    "fx_links": links_sql,
    "fx_leader_text": leader_text_sql,
    "fx_lead_leaders": lead_leaders_sql,
    "fx_lead_companies": lead_companies_sql,
    "fx_kb": kb_sql,
    "fx_kb_leaders": kb_leaders_sql,
    "fx_model_prices": model_prices_sql,
    "fx_calls": calls_sql,
    "fx_search_results": search_results_sql,
    "fx_llm_responses": llm_responses_sql,
}


class Inputs:
    """The given tables of one folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _spread(self, df: DataFrame) -> DataFrame:
        """Use all cores where a table is one small file whose rows become many pages."""
        return df.repartition(self.spark.sparkContext.defaultParallelism, df.columns[0])

    def derived(self, name: str) -> DataFrame:
        sql = DERIVED[name]("spark")
        for base in ("customer", "nation", "orders"):
            if f" {base}" in sql:
                df = self.table(base)
                (df if base == "nation" else self._spread(df)).createOrReplaceTempView(base)
        return self.spark.sql(sql)

    def site_pages(self) -> DataFrame:
        return self.derived("fx_site_pages")

    def seeds(self) -> DataFrame:
        return self.derived("fx_seeds")

    def _leader_lists(self, name: str) -> DataFrame:
        return (
            self.derived(name)
            .groupBy("domain")
            .agg(
                F.array_sort(
                    F.collect_list(F.struct("leader_no", "name", "role", "linkedin_url"))
                ).alias("l")
            )
            .select(
                "domain",
                F.transform(
                    "l", lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"),
                                            x["linkedin_url"].alias("linkedin_url"))
                ).alias("leadership"),
            )
        )

    def kb(self) -> DataFrame:
        """Nested form: one row per domain with its contacts and ordered leaders."""
        return (
            self.derived("fx_kb")
            .join(self._leader_lists("fx_kb_leaders"), "domain", "left")
            .select("domain", "name", "overview", "icp", F.array("contact").alias("contacts"), "leadership")
        )

    def open_leads(self) -> DataFrame:
        """Leads before the search: every other one has two leaders, the rest none."""
        return (
            self.derived("fx_lead_companies")
            .join(self._leader_lists("fx_lead_leaders"), "domain", "left")
            .select(
                "domain",
                "company",
                F.coalesce("leadership", F.array().cast(schemas.LEADERS)).alias("leaders"),
            )
        )

    def prices(self) -> DataFrame:
        return self.derived("fx_model_prices")

    def calls(self) -> DataFrame:
        return self.derived("fx_calls")

    def search_results(self) -> DataFrame:
        return self.derived("fx_search_results")

    def responses(self) -> DataFrame:
        return self.derived("fx_llm_responses")
