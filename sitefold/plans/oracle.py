"""Expected answers of the registered queries as SQL for DuckDB.

Page content is never parsed here: the site pages are built from known columns, so
their Markdown, links and contacts are computed from those columns directly.
"""

from __future__ import annotations

from sitefold.functions import text
from sitefold.plans.fixtures import DERIVED

# --- fixed values, written out here so that a wrong one in the engine shows ---
WHITESPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)
LINE_BREAK = r"\r\n|[\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PROFILE_OR_COMPANY = r"(?i)https?://(?:www\.)?linkedin\.com/(?:in|company)/[a-zA-Z0-9%_-]+/?"
PROFILE = r"(?i)https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9%_-]+/?"
DENIED = r"(domain\.com|sentry\.io|wixpress\.com|schema\.org|png|jpg|jpeg|svg|webp|gif|\.css|\.js)$"
DENIED_BY_DEFAULT = DENIED.replace("(", r"(example\.com|", 1)
TRUNCATION_MARKER = "\n... [Content truncated for token optimization] ..."
DEFAULT_AUDIENCE = "Developers, businesses, and enterprise teams seeking software solutions."
TARGET_KEYWORDS = (
    "about", "about-us", "company", "team", "leadership", "contact", "contact-us",
    "pricing", "careers", "founders", "management",
)
SKIPPED_HREF = "^(#|javascript:|mailto:)"
SYSTEM_PROMPT_CHARS = 1082
# ------------------------------------------------------------------------------

NL = "chr(10)"
NL2 = "chr(10) || chr(10)"
_WS = "'" + WHITESPACE + "'"
_DENY = DENIED_BY_DEFAULT
_MISSING = "page not found in input"
_FAILED = f"Failed to crawl page: {_MISSING} | Fallback error: {_MISSING}"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def fx(name: str) -> str:
    return f"{name} AS ({DERIVED[name]('duckdb')})"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def emails(x: str, deny: str = _DENY) -> str:
    return (
        f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, {_q(EMAIL)}), "
        f"lambda e: lower(e)), lambda e: NOT regexp_matches(e, {_q(deny)}))))"
    )


def profile_urls(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, {_q(PROFILE_OR_COMPANY)}), "
        "lambda u: rtrim(u, '/')), lambda u: contains(u, '/in/') OR contains(u, '/company/'))))"
    )


def first_profile(x: str) -> str:
    return f"nullif(rtrim(regexp_extract({x}, {_q(PROFILE)}), '/'), '')"


def join(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, {_q(sep)}), '')"


def truncate(x: str, n: int) -> str:
    return (
        f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || {NL} || "
        f"{_q(TRUNCATION_MARKER[1:])} ELSE {x} END"
    )


def tokens(length: str) -> str:
    return f"CAST(CASE WHEN {length} = 0 THEN 0 ELSE greatest(1, {length} // 4) END AS BIGINT)"


def overview(x: str, name: str, skip_headers: bool) -> str:
    skip = " AND NOT regexp_matches(s, '^--- PAGE: .* ---$')" if skip_headers else ""
    pieces = (
        f"list_filter(list_transform(string_split_regex({x}, '\\. |\\n'), lambda s: {strip('s')}), "
        f"lambda s: length(s) > 20{skip})"
    )
    return (
        f"CASE WHEN len({pieces}) >= 2 THEN array_to_string({pieces}[1:2], '. ') || '.' "
        f"ELSE {name} || ' provides digital products and services.' END"
    )


def company(domain: str) -> str:
    label = f"split_part({domain}, '.', 1)"
    return f"upper(substr({label}, 1, 1)) || lower(substr({label}, 2))"


def cost(tokens_in: str, tokens_out: str, pin: str, pout: str) -> str:
    return (
        f"round(CAST({tokens_in} * {pin} + {tokens_out} * {pout} AS DECIMAL(18,0)) "
        "* CAST(0.000000001 AS DECIMAL(10,9)), 6)"
    )


# -- sites by construction ----------------------------------------------------------
SITE = """
site AS (
  SELECT c_custkey AS n, lower(c_mktsegment) || c_custkey || '.com' AS d, lower(c_mktsegment) AS seg,
         c_name, c_nationkey AS nk, n_name, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

BODY = f"""
body AS (
  SELECT n, d, '# ' || c_name || {NL2} || n_name || ' builds ' || seg
      || ' data tools. They serve segment number ' || nk || ' buyers.'
      || CASE WHEN n % 3 = 0 THEN {NL2} || 'Ada Stone, CEO' || {NL2} || 'CTO: Bo Lind' || {NL2}
              || '[in](https://www.linkedin.com/in/ada-stone-' || n || '/)' ELSE '' END
      || CASE WHEN n % 2 = 0 THEN {NL2} || 'Mail Sales' || n || '@' || seg || '.io or logo@2x.png' ELSE '' END AS md,
    CASE WHEN n % 2 = 0 THEN ['hi@x.io', 'info@' || d, 'sales' || n || '@' || seg || '.io']
         ELSE ['hi@x.io', 'info@' || d] END AS emails,
    CASE WHEN n % 3 = 0 THEN ['https://www.linkedin.com/in/ada-stone-' || n] ELSE [] END AS urls
  FROM site)"""

# every page row of a site, as given
GIVEN_ROWS = """
page_rows AS (
  SELECT b.n, b.d AS domain, p.page_no, p.url, p.status_code, b.md AS markdown, CAST(NULL AS VARCHAR) AS error
  FROM fx_site_pages p JOIN body b ON p.site_id = b.n)"""

# home page and the links found on it, whether or not their page is given
CRAWLED_ROWS = f"""
page_rows AS (
  SELECT b.n, b.d AS domain, l.page_no, replace(l.url, '{{D}}', b.d) AS url,
         coalesce(p.status_code, 500) AS status_code,
         CASE WHEN p.url IS NULL THEN {_q(_FAILED)} ELSE b.md END AS markdown,
         CASE WHEN p.url IS NULL THEN {_q(_MISSING)} END AS error
  FROM body b
  CROSS JOIN (VALUES (0, 'https://{{D}}'), (1, 'https://{{D}}/about'), (2, 'https://{{D}}/pricing'),
                     (3, 'https://jobs.{{D}}/careers'), (4, 'https://{{D}}/team')) AS l(page_no, url)
  LEFT JOIN fx_site_pages p ON p.url = replace(l.url, '{{D}}', b.d))"""


def contexts(include_failed: bool, max_chars: int | None) -> str:
    wanted = "markdown <> ''" + ("" if include_failed else " AND error IS NULL AND status_code < 400")
    joined = (
        f"coalesce(string_agg('--- PAGE: ' || url || ' ---' || {NL} || markdown, {NL2} ORDER BY page_no) "
        f"FILTER (WHERE {wanted}), '')"
    )
    cut = truncate("full_context", max_chars) if max_chars else "full_context"
    return f"""
profile AS (
  SELECT n, domain, {cut} AS context, pages, home_status FROM (
    SELECT n, domain, {joined} AS full_context, string_agg(url, '|' ORDER BY page_no) AS pages,
           min(CASE WHEN page_no = 0 THEN status_code END) AS home_status
    FROM page_rows GROUP BY n, domain))"""


def _leader_matches(table: str, key: str, x: str, compat: bool) -> str:
    """Long-form leaders of both forms: (key, leader_no, name, role), three per form."""
    parts = []
    for form, pattern, name_group, role_group in (
        (1, text.name_role_pattern(compat), 1, 2),
        (2, text.role_name_pattern(compat), 2, 1),
    ):
        parts.append(
            f"SELECT {key}, {form} AS form, unnest(generate_series(1, len(m))) AS pos, unnest(m) AS m FROM "
            f"(SELECT {key}, list_zip(regexp_extract_all({x}, {_q(pattern)}, {name_group}), "
            f"regexp_extract_all({x}, {_q(pattern)}, {role_group})) AS m FROM {table})"
        )
    matches = " UNION ALL ".join(parts)
    group = "pos" if compat else "name, role"
    return f"""(
  SELECT {key}, form, row_number() OVER (PARTITION BY {key} ORDER BY form, first_pos) AS leader_no, name, role FROM (
    SELECT {key}, form, name, role, first_pos,
           row_number() OVER (PARTITION BY {key}, form ORDER BY first_pos) AS rn FROM (
      SELECT {key}, form, any_value(name) AS name, any_value(role) AS role, min(pos) AS first_pos FROM (
        SELECT {key}, form, pos, {strip('m[1]')} AS name, {strip('m[2]')} AS role FROM ({matches}))
      GROUP BY {key}, form, {group}))
  WHERE rn <= 3)"""


def _kb_leaders() -> str:
    """Knowledge-base leaders with the last found URL that holds their first name."""
    return f"""
kb_leader AS (
  SELECT k.domain, k.leader_no, k.name, k.role,
         coalesce(max(u.url), any_value(k.linkedin_url)) AS linkedin_url
  FROM fx_kb_leaders k
  LEFT JOIN (SELECT d AS domain, unnest(urls) AS url FROM body) u
    ON u.domain = k.domain AND contains(lower(u.url), lower(split_part(k.name, ' ', 1)))
  GROUP BY k.domain, k.leader_no, k.name, k.role)"""


_LEADER_TEXT = (
    "coalesce(string_agg(name || ' (' || role || ')' || CASE WHEN coalesce(linkedin_url, '') <> '' "
    "THEN ' - ' || linkedin_url ELSE '' END, '; ' ORDER BY leader_no), '')"
)


def rule_leads(compat: bool) -> list[str]:
    """CTEs ``leader`` (long form) and ``lead`` over ``profile``."""
    return [
        fx("fx_kb"),
        fx("fx_kb_leaders"),
        _kb_leaders(),
        f"""
leader AS (
  SELECT domain, leader_no, name, role, linkedin_url FROM kb_leader
  UNION ALL
  SELECT domain, leader_no, name, role, CAST(NULL AS VARCHAR)
  FROM {_leader_matches("profile", "domain", "context", compat)} r
  WHERE domain NOT IN (SELECT domain FROM fx_kb))""",
        f"""
lead AS (
  SELECT p.n, p.domain, p.context, p.pages, p.home_status, k.domain IS NOT NULL AS in_kb,
         coalesce(k.name, {company('p.domain')}) AS company_name,
         coalesce(k.overview, {overview('p.context', company('p.domain'), not compat)}) AS company_overview,
         coalesce(k.icp, {_q(DEFAULT_AUDIENCE)}) AS target_audience,
         CASE WHEN k.domain IS NULL THEN b.emails
              ELSE list_sort(list_distinct(list_append(b.emails, k.contact))) END AS contacts,
         (SELECT count(*) FROM leader l WHERE l.domain = p.domain) AS n_leaders,
         {tokens('length(p.context)')} AS input_tokens,
         CAST(CASE WHEN k.domain IS NULL THEN 200 ELSE 250 END AS BIGINT) AS output_tokens,
         150 AS pin, 600 AS pout, 'rules' AS provider, 'gpt-4o-mini' AS model
  FROM profile p JOIN body b ON b.n = p.n LEFT JOIN fx_kb k ON k.domain = p.domain)""",
    ]


def prompt(context: str) -> str:
    def listing(x: str) -> str:
        return f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[''' || array_to_string({x}, ''', ''') || ''']' END"

    return (
        f"'Target Domain: ' || p.domain || {NL} || 'Known Emails: ' || {listing('b.emails')} || {NL} "
        f"|| 'Known LinkedIn URLs: ' || {listing('b.urls')} || {NL2} || 'Web Content:' || {NL} || {context}"
    )


def responded(lead: str = "lead") -> list[str]:
    """CTEs ``chosen_leader`` and ``chosen``: answers by construction, else the rules."""
    dump = (
        "'{\"domain\": \"' || p.domain || '\", \"company_name\": \"' || s.c_name || '\", \"company_overview\": \"A says it "
        "sells tools. It has buyers.\", \"target_audience\": \"Teams buying tools\", \"contact_points\": [\"info@x.io\"], "
        "\"key_leadership\": [{\"name\": \"Ada Stone\", \"role\": \"CEO\", \"linkedin_url\": null}], "
        "\"data_confidence_score\": 0.9, \"pages_crawled\": [], \"search_queries_used\": [], \"cost_metrics\": "
        "{\"input_tokens\": 0, \"output_tokens\": 0, \"total_tokens\": 0, \"estimated_cost_usd\": 0.0}}'"
    )
    chars = SYSTEM_PROMPT_CHARS
    return [
        fx("fx_llm_responses"),
        f"""
chosen AS (
  SELECT p.n, p.domain, p.context, p.pages, p.home_status, p.in_kb AND w.p = 'rules' AS in_kb,
         CASE WHEN w.p = 'rules' THEN p.company_name ELSE s.c_name END AS company_name,
         CASE WHEN w.p = 'rules' THEN p.company_overview ELSE w.p || ' says it sells tools. It has buyers.' END AS company_overview,
         CASE WHEN w.p = 'rules' THEN p.target_audience ELSE 'Teams buying tools' END AS target_audience,
         CASE WHEN w.p = 'rules' THEN p.contacts ELSE ['info@x.io'] END AS contacts,
         CASE WHEN w.p = 'rules' THEN p.n_leaders ELSE 1 END AS n_leaders,
         CASE w.p WHEN 'A' THEN {tokens(f"({chars} + length({prompt('p.context')}))")}
                  WHEN 'B' THEN {tokens(f"length({prompt('p.context')})")} ELSE p.input_tokens END AS input_tokens,
         CASE w.p WHEN 'A' THEN {tokens(f"length({dump})")} WHEN 'B' THEN {tokens("length(r.raw_json)")}
                  ELSE p.output_tokens END AS output_tokens,
         CASE w.p WHEN 'B' THEN 75 ELSE 150 END AS pin, CASE w.p WHEN 'B' THEN 300 ELSE 600 END AS pout,
         w.p AS provider, CASE w.p WHEN 'B' THEN 'gemini-2.5-flash' ELSE 'gpt-4o-mini' END AS model
  FROM {lead} p JOIN site s ON s.n = p.n JOIN body b ON b.n = p.n
  JOIN (SELECT n, CASE WHEN n % 5 = 0 THEN 'A' WHEN n % 2 = 0 THEN 'B' ELSE 'rules' END AS p FROM site) w ON w.n = p.n
  LEFT JOIN fx_llm_responses r ON r.domain = p.domain AND r.provider = w.p)""",
        """
chosen_leader AS (
  SELECT l.* FROM leader l JOIN chosen c ON c.domain = l.domain WHERE c.provider = 'rules'
  UNION ALL
  SELECT domain, 1, 'Ada Stone', 'CEO', CAST(NULL AS VARCHAR) FROM chosen WHERE provider <> 'rules')""",
    ]


def searched(lead: str, leader: str) -> list[str]:
    """CTEs ``final_leader`` and ``query_log`` over long-form leaders."""
    return [
        fx("fx_search_results"),
        f"""
hit AS (
  SELECT query, rank, coalesce({first_profile('href')}, {first_profile('body')}) AS url,
         {strip("split_part(split_part(title, '-', 1), '|', 1)")} AS name
  FROM fx_search_results)""",
        f"""
asked AS (
  SELECT l.domain, l.leader_no, '"' || l.name || '" "' || c.company_name || '" site:linkedin.com/in' AS query
  FROM {leader} l JOIN {lead} c ON c.domain = l.domain
  WHERE coalesce(l.linkedin_url, '') = ''
    AND l.domain IN (SELECT domain FROM {leader} WHERE linkedin_url IS NULL))""",
        f"""
broad AS (
  SELECT c.domain, q.no, '"' || c.company_name || q.words || ' site:linkedin.com/in' AS query
  FROM {lead} c CROSS JOIN (VALUES (1, '" founder CEO CTO'), (2, '" leadership team')) AS q(no, words)
  WHERE c.domain NOT IN (SELECT domain FROM {leader}))""",
        f"""
final_leader AS (
  SELECT l.domain, l.leader_no, l.name, l.role, coalesce(f.url, l.linkedin_url) AS linkedin_url
  FROM {leader} l LEFT JOIN (
    SELECT a.domain, a.leader_no, arg_min(h.url, h.rank) AS url
    FROM asked a JOIN hit h ON h.query = a.query WHERE h.rank <= 2 AND h.url IS NOT NULL
    GROUP BY a.domain, a.leader_no) f ON f.domain = l.domain AND f.leader_no = l.leader_no
  UNION ALL
  SELECT b.domain, row_number() OVER (PARTITION BY b.domain ORDER BY b.no, h.rank), h.name, 'Leadership Team', h.url
  FROM broad b JOIN hit h ON h.query = b.query WHERE h.rank <= 3 AND h.url IS NOT NULL)""",
        """
query_log AS (
  SELECT domain, string_agg(query, '|' ORDER BY no) AS queries FROM (
    SELECT domain, leader_no AS no, query FROM asked UNION ALL SELECT domain, no, query FROM broad WHERE no = 1)
  GROUP BY domain)""",
    ]


def record_columns(lead: str, leader: str, searches: str) -> str:
    score = (
        "(50 + CASE WHEN length(c.company_overview) > 30 THEN 20 ELSE 0 END "
        "+ CASE WHEN length(c.target_audience) > 15 THEN 15 ELSE 0 END "
        "+ CASE WHEN ls.leaders IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN len(c.contacts) > 0 THEN 5 ELSE 0 END) / 100"
    )
    return f"""
record AS (
  SELECT c.domain, c.company_name, c.company_overview, c.target_audience, {join('c.contacts')} AS contact_points,
         array_to_string(c.contacts, ', ') AS contact_text,
         coalesce(ls.leaders, '') AS key_leadership, {score} AS data_confidence_score, c.pages AS pages_crawled,
         {searches} AS search_queries_used, c.input_tokens, c.output_tokens,
         c.input_tokens + c.output_tokens AS total_tokens,
         CAST({cost('c.input_tokens', 'c.output_tokens', 'c.pin', 'c.pout')} AS DOUBLE) AS estimated_cost_usd,
         CAST(c.home_status AS BIGINT) AS home_status, c.provider
  FROM {lead} c
  LEFT JOIN (SELECT domain, {_LEADER_TEXT} AS leaders FROM {leader} GROUP BY domain) ls ON ls.domain = c.domain
  {"LEFT JOIN query_log q ON q.domain = c.domain" if searches != "''" else ""})"""


_FLAT = (
    "domain, company_name, company_overview, target_audience, contact_points, key_leadership, "
    "data_confidence_score, pages_crawled, search_queries_used, input_tokens, output_tokens, "
    "total_tokens, estimated_cost_usd"
)
_REPORT = (
    "domain, company_name, company_overview, target_audience, contact_text AS contact_points, "
    "key_leadership, data_confidence_score, input_tokens, output_tokens, estimated_cost_usd"
)


def _given(include_failed: bool = False, max_chars: int | None = 12000) -> list[str]:
    return [fx("fx_site_pages"), SITE, BODY, GIVEN_ROWS, contexts(include_failed, max_chars)]


def _records() -> list[str]:
    return [*_given(), *rule_leads(False), record_columns("lead", "leader", "''")]


def enrich_sql(with_responses: bool, compat: bool) -> str:
    lead, leader = ("chosen", "chosen_leader") if with_responses else ("lead", "leader")
    return _with(
        fx("fx_site_pages"), fx("fx_seeds"), SITE, BODY, CRAWLED_ROWS, contexts(compat, 12000),
        *rule_leads(compat),
        *(responded() if with_responses else []),
        *searched(lead, leader),
        record_columns(lead, "final_leader", "coalesce(q.queries, '')"),
        body=f"SELECT s.seed_no, {', '.join('r.' + c.strip() for c in _FLAT.split(','))}, r.home_status, "
        "r.provider, CAST(NULL AS VARCHAR) AS error FROM fx_seeds s JOIN record r ON r.domain = s.domain",
    )


def lead_sql(compat: bool) -> str:
    return _with(
        *_given(include_failed=compat), *rule_leads(compat),
        body=f"""
SELECT c.domain, c.company_name, c.company_overview, c.target_audience, {join('c.contacts')} AS contact_points,
       coalesce(ls.leaders, '') AS key_leadership,
       CAST(CASE WHEN c.in_kb THEN 0.95 WHEN len(c.contacts) > 0 OR c.n_leaders > 0 THEN 0.7 ELSE 0.5 END AS DOUBLE)
         AS data_confidence_score,
       c.input_tokens, c.output_tokens
FROM lead c LEFT JOIN (SELECT domain, {_LEADER_TEXT} AS leaders FROM leader GROUP BY domain) ls ON ls.domain = c.domain""",
    )


# -- links by construction -------------------------------------------------------------
# link_no, href, resolved, same site, canonical form of a kept link; {D} domain, {N} site, {U} page URL
_NAV = [
    (1, "/about", "https://{D}/about", 1, "https://{D}/about"),
    (2, "/about/", "https://{D}/about/", 1, "https://{D}/about"),
    (3, "/pricing?ref={N}#top", "https://{D}/pricing?ref={N}#top", 1, "https://{D}/pricing"),
    (4, "#x", "{U}#x", 1, "{U}"),
    (5, "mailto:hi@x.io", "mailto:hi@x.io", 0, ""),
    (6, "/blog", "https://{D}/blog", 1, "https://{D}/blog"),
    (7, "https://jobs.{D}/careers", "https://jobs.{D}/careers", 1, "https://jobs.{D}/careers"),
    (8, "https://other.org/team", "https://other.org/team", 0, "https://other.org/team"),
    (9, "team", "https://{D}/team", 1, "https://{D}/team"),
    (10, "/contact-us", "https://{D}/contact-us", 1, "https://{D}/contact-us"),
    (11, "/company", "https://{D}/company", 1, "https://{D}/company"),
    (12, "https://www.linkedin.com/in/ada-stone-{N}/", "https://www.linkedin.com/in/ada-stone-{N}/", 0,
     "https://www.linkedin.com/in/ada-stone-{N}"),
]


def _nav_links() -> str:
    rows = ", ".join(
        f"({no}, {_q(href)}, {_q(full)}, {same}, {_q(canon)})" for no, href, full, same, canon in _NAV
    )

    def fill(x: str) -> str:
        return f"replace(replace(replace({x}, '{{D}}', s.d), '{{N}}', CAST(s.n AS VARCHAR)), '{{U}}', p.url)"

    return f"""
nav AS (
  SELECT s.n AS site_id, CAST(p.page_no AS BIGINT) AS page_no, CAST(l.link_no AS BIGINT) AS link_no, p.url AS page_url,
         {fill('l.href')} AS href, {fill('l.full_url')} AS full_url, l.same_site, {fill('l.canon')} AS canon
  FROM fx_site_pages p JOIN site s ON s.n = p.site_id
  CROSS JOIN (VALUES {rows}) AS l(link_no, href, full_url, same_site, canon)
  WHERE l.link_no < 12 OR s.n % 3 = 0)"""


_KEYWORDS = "|".join(TARGET_KEYWORDS)
_DEDUP = f"""
kept AS (
  SELECT site_id, page_no, canon AS url, row_number() OVER (PARTITION BY site_id, page_no ORDER BY min(link_no)) AS link_no
  FROM nav
  WHERE same_site = 1 AND NOT regexp_matches(href, {_q(SKIPPED_HREF)}) AND canon <> page_url
    AND regexp_matches(lower(substr(canon, length('https://'))), '/.*({_KEYWORDS})')
  GROUP BY site_id, page_no, canon)"""


def _nav(body: str, *more: str) -> str:
    return _with(fx("fx_site_pages"), SITE, _nav_links(), *more, body=body)


def _fx(name: str, body: str) -> str:
    return _with(fx(name), body=body)


def _leader_text_sql(forms: str, compat: bool) -> str:
    matches = _leader_matches("fx_leader_text", "site_id", "txt", compat)
    return _fx(
        "fx_leader_text",
        f"""SELECT t.site_id, coalesce(string_agg(m.name || ' (' || m.role || ')', '; ' ORDER BY m.leader_no), '') AS leaders
FROM fx_leader_text t LEFT JOIN (SELECT * FROM {matches} WHERE form IN ({forms})) m ON m.site_id = t.site_id
GROUP BY t.site_id""",
    )


def _open_leads() -> list[str]:
    return [fx("fx_lead_companies"), fx("fx_lead_leaders"),
            "open_lead AS (SELECT domain, company AS company_name FROM fx_lead_companies)"]


def _searched_sql(condition: str) -> str:
    return _with(
        *_open_leads(), *searched("open_lead", "fx_lead_leaders"),
        body=f"""SELECT domain, CAST(leader_no AS BIGINT) AS leader_no, name, role, linkedin_url
FROM final_leader WHERE domain {condition} (SELECT domain FROM fx_lead_leaders)""",
    )


_REASONS = """
  SELECT r.*, CASE
    WHEN NOT json_valid(raw_json) THEN 'malformed_json'
    WHEN json_type(raw_json, '$.company_name') IS NULL THEN 'missing:company_name'
    WHEN CAST(json_extract(raw_json, '$.data_confidence_score') AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'score_out_of_range'
    END AS reason
  FROM fx_llm_responses r"""

_STATUS = """
status AS (
  SELECT s.d AS domain,
         CASE WHEN n % 5 = 0 OR n % 2 = 0 THEN NULL
              WHEN n % 5 = 1 THEN 'malformed_json' WHEN n % 5 = 2 THEN 'score_out_of_range'
              WHEN n % 5 = 3 THEN 'missing:company_name' ELSE 'malformed_json' END AS error
  FROM site s)"""

_PRICED = f"""
priced AS (
  SELECT c.*, {cost('c.input_tokens', 'c.output_tokens', 'coalesce(p.in_milli, d.in_milli)', 'coalesce(p.out_milli, d.out_milli)')} AS cost,
         coalesce(p.in_milli, d.in_milli) AS in_milli, coalesce(p.out_milli, d.out_milli) AS out_milli
  FROM fx_calls c LEFT JOIN fx_model_prices p ON p.model = lower(c.model)
  CROSS JOIN (SELECT in_milli, out_milli FROM fx_model_prices WHERE model = 'default') d)"""

_TOTALS = (
    "count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
    "CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens, CAST(round(sum(cost), 6) AS DOUBLE) AS estimated_cost_usd"
)


def _calls(body: str) -> str:
    return _with(fx("fx_calls"), fx("fx_model_prices"), _PRICED, body=body)


def _pages_sql(body: str) -> str:
    return _with(fx("fx_site_pages"), SITE, BODY, GIVEN_ROWS, body=body)


def statements() -> dict[str, str]:
    docs_deny = DENIED
    loose = f"replace(text, '. ', '. ' || {NL} || ' ' || {NL} || chr(9) || {NL})"
    lines = f"array_to_string(list_transform(string_split(regexp_replace({loose}, {_q(LINE_BREAK)}, {NL}, 'g'), {NL}), lambda s: {strip('s')}), {NL})"
    tidy = strip(f"regexp_replace({lines}, '\\n{{3,}}', {NL2}, 'g')")
    cut = truncate("text", 12000)
    title_name = strip("split_part(split_part(title, '-', 1), '|', 1)")
    clean = "lower(split_part(replace(replace(domain, 'https://', ''), 'http://', ''), '/', 1))"
    frontier = _with(
        fx("fx_site_pages"), SITE, BODY, CRAWLED_ROWS,
        body="SELECT domain, CAST(page_no AS BIGINT) AS page_no, url, CAST(status_code AS BIGINT) AS status_code, error FROM page_rows",
    )
    return {
        "seed_domains": _fx("fx_seeds", "SELECT seed_no, domain FROM fx_seeds"),
        "seed_files": _fx("fx_seeds", "SELECT row_number() OVER (ORDER BY seed_no) - 1 AS seed_no, domain FROM fx_seeds"),
        "pages_scan": "SELECT page_id, url, length(html) AS html_chars FROM pages",
        "sink_json_roundtrip": _with(*_records(), body=f"SELECT {_FLAT} FROM record"),
        "sink_csv_roundtrip": _with(*_records(), body=f"SELECT {_REPORT} FROM record"),
        "sink_csv_lines_roundtrip": _with(*_records(), body=f"SELECT {_REPORT} FROM record"),
        "report_flat": _with(*_records(), body=f"SELECT {_REPORT} FROM record"),
        "completeness_score": _with(*_records(), body="SELECT domain, data_confidence_score FROM record"),
        "url_normalize": _fx(
            "fx_raw_seeds",
            f"SELECT seed_no, CASE WHEN starts_with({strip('domain')}, 'http://') OR starts_with({strip('domain')}, 'https://') "
            f"THEN {strip('domain')} ELSE 'https://' || {strip('domain')} END AS url FROM fx_raw_seeds",
        ),
        "url_clean_domain": _fx("fx_raw_seeds", f"SELECT seed_no, {clean} AS domain FROM fx_raw_seeds"),
        "company_name_from_domain": _fx(
            "fx_raw_seeds", f"SELECT seed_no, {company(clean)} AS company_name FROM fx_raw_seeds"
        ),
        "link_resolve": _fx(
            "fx_links", "SELECT site_id, CAST(link_no AS BIGINT) AS link_no, href, absolute FROM fx_links"
        ),
        "link_canonical": "SELECT page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') AS url FROM pages",
        "link_same_site": _nav("SELECT site_id, page_no, link_no, full_url AS url FROM nav WHERE same_site = 1"),
        "link_target_path": _nav(
            "SELECT site_id, page_no, link_no, path FROM (SELECT *, CASE WHEN starts_with(full_url, 'https://') "
            "THEN regexp_extract(full_url, '^https://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM nav) "
            f"WHERE regexp_matches(lower(path), {_q(_KEYWORDS)})"
        ),
        "link_skip_filter": _nav(
            f"SELECT site_id, page_no, link_no, href FROM nav WHERE NOT regexp_matches(href, {_q(SKIPPED_HREF)})"
        ),
        "links_dedup": _nav("SELECT site_id, page_no, link_no, url FROM kept", _DEDUP),
        "links_top_k": _nav(
            "SELECT p.site_id, CAST(p.page_no AS BIGINT) AS page_no, "
            "coalesce(string_agg(k.url, '|' ORDER BY k.link_no) FILTER (WHERE k.link_no <= 4), '') AS links_4, "
            "coalesce(string_agg(k.url, '|' ORDER BY k.link_no) FILTER (WHERE k.link_no <= 5), '') AS links_5 "
            "FROM fx_site_pages p LEFT JOIN kept k ON k.site_id = p.site_id AND k.page_no = p.page_no GROUP BY 1, 2",
            _DEDUP,
        ),
        "html_strip": _pages_sql(
            "SELECT n AS site_id, CAST(page_no AS BIGINT) AS page_no, CAST(0 AS BIGINT) AS script_hits, "
            "CAST(0 AS BIGINT) AS style_hits, CAST(0 AS BIGINT) AS nav_hits, CAST(0 AS BIGINT) AS footer_hits, "
            "CAST(1 AS BIGINT) AS body_hits FROM page_rows"
        ),
        "html_strip_hidden": _pages_sql(
            "SELECT n AS site_id, CAST(page_no AS BIGINT) AS page_no, CAST(0 AS BIGINT) AS hidden_hits, length(markdown) AS chars FROM page_rows"
        ),
        "html_markdown": _pages_sql(
            "SELECT n AS site_id, CAST(page_no AS BIGINT) AS page_no, markdown FROM page_rows"
        ),
        "html_links": (
            "SELECT page_id, unnest(generate_series(1, len(h))) AS link_no, unnest(h) AS href FROM "
            "(SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS h FROM pages)"
        ),
        "text_collapse_ws": f"SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT doc_id, {tidy} AS t FROM documents)",
        "emails_extract": _fx(
            "fx_site_pages",
            f"SELECT site_id, CAST(page_no AS BIGINT) AS page_no, {join(emails('html'))} AS emails FROM fx_site_pages",
        ),
        "emails_extract_documents": f"SELECT doc_id, {join(emails('text', docs_deny))} AS emails FROM documents",
        "emails_denied": _fx(
            "fx_site_pages",
            "SELECT site_id, CAST(page_no AS BIGINT) AS page_no, email FROM (SELECT site_id, page_no, "
            f"unnest(regexp_extract_all(html, {_q(EMAIL)})) AS email FROM fx_site_pages) WHERE regexp_matches(lower(email), {_q(_DENY)})",
        ),
        "linkedin_urls": _fx(
            "fx_site_pages",
            f"SELECT site_id, CAST(page_no AS BIGINT) AS page_no, {join(profile_urls('html'))} AS linkedin_urls FROM fx_site_pages",
        ),
        "linkedin_first_person": _fx(
            "fx_site_pages",
            f"SELECT site_id, CAST(page_no AS BIGINT) AS page_no, {first_profile('html')} AS linkedin_url FROM fx_site_pages",
        ),
        "page_contacts": _pages_sql(
            f"SELECT r.n AS site_id, CAST(r.page_no AS BIGINT) AS page_no, {join('b.emails')} AS emails, {join('b.urls')} AS linkedin_urls "
            "FROM page_rows r JOIN body b ON b.n = r.n"
        ),
        "page_contacts_given_pages": (
            f"SELECT page_id, {join(emails('html', docs_deny))} AS emails, {join(profile_urls('html'))} AS linkedin_urls FROM pages"
        ),
        "context_truncate": f"SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT doc_id, {cut} AS t FROM documents)",
        "overview_sentences": (
            "SELECT doc_id, " + overview("text", "'Doc' || doc_id", True) + " AS overview FROM documents"
        ),
        "leaders_name_role": _leader_text_sql("1", False),
        "leaders_name_role_compat": _leader_text_sql("1", True),
        "leaders_role_name": _leader_text_sql("2", False),
        "leaders_role_name_compat": _leader_text_sql("2", True),
        "leaders_union": _leader_text_sql("1, 2", False),
        "token_estimate": (
            f"SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, {tokens('length(text)')} AS tokens FROM documents "
            f"UNION ALL SELECT 'conversation', conv_id, turn, {tokens('length(text)')} FROM conversations"
        ),
        "search_title_name": _fx(
            "fx_search_results",
            f"SELECT query, CAST(rank AS BIGINT) AS rank, {title_name} AS name FROM fx_search_results",
        ),
        "kb_left_join": _with(
            fx("fx_seeds"), fx("fx_kb"),
            body="SELECT s.seed_no, s.domain, CASE WHEN k.domain IS NULL THEN 'rules' ELSE 'kb' END AS branch, "
            f"coalesce(k.name, {company('s.domain')}) AS company_name, coalesce(k.icp, {_q(DEFAULT_AUDIENCE)}) AS target_audience "
            "FROM fx_seeds s LEFT JOIN fx_kb k ON k.domain = s.domain",
        ),
        "kb_anti": _with(
            fx("fx_seeds"), fx("fx_kb"),
            body="SELECT seed_no, domain FROM fx_seeds s WHERE NOT EXISTS (SELECT 1 FROM fx_kb k WHERE k.domain = s.domain)",
        ),
        "cost_by_model": _calls(
            "SELECT call_id, model, CAST(in_milli AS BIGINT) AS in_milli, CAST(out_milli AS BIGINT) AS out_milli FROM priced"
        ),
        "call_cost": _calls("SELECT call_id, CAST(cost AS DOUBLE) AS cost FROM priced"),
        "cost_totals": _calls(f"SELECT {_TOTALS} FROM priced"),
        "cost_totals_by_model": _calls(f"SELECT lower(model) AS model, {_TOTALS} FROM priced GROUP BY 1"),
        "crawl_frontier": frontier,
        "crawl_stored_pages": frontier,
        "crawl_given_pages": (
            "SELECT url AS domain, CAST(0 AS BIGINT) AS page_no, url, CAST(200 AS BIGINT) AS status_code, "
            "CAST(NULL AS VARCHAR) AS error FROM pages"
        ),
        "leader_url_override": _with(
            SITE, BODY, fx("fx_kb_leaders"), _kb_leaders(),
            body="SELECT domain, CAST(leader_no AS BIGINT) AS leader_no, name, linkedin_url FROM kb_leader",
        ),
        "leader_search_fill": _searched_sql("IN"),
        "broad_search_leaders": _searched_sql("NOT IN"),
        "provider_fallback": _with(
            *_given(), *rule_leads(False), *responded(),
            body=f"""
SELECT c.domain, c.provider, c.model, c.company_name, c.company_overview, c.target_audience,
       {join('c.contacts')} AS contact_points, coalesce(ls.leaders, '') AS key_leadership, c.input_tokens, c.output_tokens
FROM chosen c LEFT JOIN (SELECT domain, {_LEADER_TEXT} AS leaders FROM chosen_leader GROUP BY domain) ls ON ls.domain = c.domain""",
        ),
        "domain_contacts": _pages_sql(
            f"SELECT d AS domain, {join('emails')} AS emails, {join('urls')} AS linkedin_urls FROM body"
        ),
        "domain_contact_rows": _pages_sql(
            "SELECT d AS domain, 'email' AS kind, unnest(emails) AS contact FROM body "
            "UNION ALL SELECT d, 'linkedin', unnest(urls) FROM body"
        ),
        "domain_context": _with(*_given(False, None), body="SELECT domain, context FROM profile"),
        "domain_context_all": _with(*_given(True, None), body="SELECT domain, context FROM profile"),
        "domain_pages": _with(*_given(), body="SELECT domain, pages AS pages_crawled FROM profile"),
        "batch_summary": _with(
            *_records(), _STATUS,
            body="""
SELECT count(*) AS total_domains, count(*) FILTER (WHERE s.error IS NULL) AS successful_domains,
       count(*) FILTER (WHERE s.error IS NOT NULL) AS failed_domains,
       CAST(sum(r.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(r.output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(r.total_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(CAST(r.estimated_cost_usd AS DECIMAL(18,6))) AS DOUBLE) AS estimated_cost_usd
FROM record r JOIN status s ON s.domain = r.domain""",
        ),
        "batch_failures": _with(
            SITE, fx("fx_seeds"), _STATUS,
            body="SELECT f.seed_no, f.domain, CASE WHEN s.error IS NULL THEN 'ok' ELSE 'failed' END AS status, s.error "
            "FROM fx_seeds f JOIN status s ON s.domain = f.domain",
        ),
        "search_top_k": _fx(
            "fx_search_results", "SELECT query, CAST(rank AS BIGINT) AS hit_no, href FROM fx_search_results WHERE rank <= 3"
        ),
        "contacts_union_kb": _with(
            SITE, BODY, fx("fx_kb"),
            body=f"SELECT k.domain, {join('list_sort(list_distinct(list_append(b.emails, k.contact)))')} AS contact_points "
            "FROM fx_kb k JOIN body b ON b.d = k.domain",
        ),
        "extraction_confidence": "SELECT domain, data_confidence_score FROM (" + lead_sql(False) + ")",
        "needs_search": _with(
            *_open_leads(),
            body="SELECT domain FROM open_lead WHERE domain NOT IN (SELECT domain FROM fx_lead_leaders) "
            "OR domain IN (SELECT domain FROM fx_lead_leaders WHERE linkedin_url IS NULL)",
        ),
        "search_queries": _with(
            *_open_leads(), *searched("open_lead", "fx_lead_leaders"),
            body="""
SELECT o.domain, coalesce(r.queries, '') AS queries_run, coalesce(q.queries, '') AS queries_logged
FROM open_lead o LEFT JOIN query_log q ON q.domain = o.domain
LEFT JOIN (SELECT domain, string_agg(query, '|' ORDER BY no) AS queries FROM (
  SELECT domain, leader_no AS no, query FROM asked UNION ALL SELECT domain, no, query FROM broad) GROUP BY domain) r
  ON r.domain = o.domain""",
        ),
        "llm_validate": _fx(
            "fx_llm_responses",
            f"SELECT domain, provider, model, CAST(reason IS NULL AS BIGINT) AS valid, reason FROM ({_REASONS})",
        ),
        "llm_quarantine": _fx(
            "fx_llm_responses",
            f"SELECT domain, provider, reason, raw_json FROM ({_REASONS}) WHERE reason IS NOT NULL",
        ),
        "prompt_build": _with(
            *_given(),
            body=f"""
SELECT domain, provider, user_prompt, {tokens('(length(user_prompt) + extra)')} AS input_tokens FROM (
  SELECT p.domain, v.provider, v.extra, {prompt('p.context')} AS user_prompt
  FROM profile p JOIN body b ON b.n = p.n CROSS JOIN (VALUES ('A', {SYSTEM_PROMPT_CHARS}), ('B', 0)) AS v(provider, extra))""",
        ),
        "lead_heuristic": lead_sql(False),
        "lead_heuristic_compat": lead_sql(True),
        "enrich_full": enrich_sql(False, False),
        "enrich_full_compat": enrich_sql(False, True),
        "enrich_with_responses": enrich_sql(True, False),
    }
