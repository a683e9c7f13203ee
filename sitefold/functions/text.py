"""Text extraction as built-in column expressions.

Everything here stays inside the JVM: no Python function runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
# Characters that Python's str.strip() and \s treat as white space. Spark's own
# trim removes only U+0020, so they are always passed explicitly.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = "[^" + WS[1:]
LINE_BREAK = r"\r\n|[\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PROFILE_OR_COMPANY = r"(?i)https?://(?:www\.)?linkedin\.com/(?:in|company)/[a-zA-Z0-9%_-]+/?"
PROFILE = r"(?i)https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9%_-]+/?"

DENIED_SUFFIXES = (
    "example.com", "domain.com", "sentry.io", "wixpress.com", "schema.org",
    "png", "jpg", "jpeg", "svg", "webp", "gif", ".css", ".js",
)

ROLES_AFTER_NAME = "Founder|CEO|CTO|VP|Co-Founder|Chief Executive Officer|President"
ROLES_BEFORE_NAME = "Founder|CEO|CTO|Co-Founder"

TRUNCATION_MARKER = "\n... [Content truncated for token optimization] ..."
DEFAULT_AUDIENCE = "Developers, businesses, and enterprise teams seeking software solutions."
STOCK_OVERVIEW = " provides digital products and services."
# ----------------------------------------------------------------------------

# The same matches as EMAIL, in linear time. A match can only begin where a run
# of local-part characters begins, or where the match before it ended (\G), and
# the run is never given back because it cannot contain "@". Without this, a
# long run without "@" (a hash, inlined data) costs its length squared.
_EMAIL_LINEAR = (
    r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
)

_NO_STRINGS = "array<string>"
_NO_LEADERS = "array<struct<name:string,role:string,linkedin_url:string>>"


def bound(value: Column, fn) -> Column:
    """Evaluate ``value`` once and apply ``fn`` to it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def empty_strings() -> Column:
    return F.array().cast(_NO_STRINGS)


def strip(col: Column) -> Column:
    """Remove leading and trailing white space, any Unicode kind."""
    return F.btrim(col, F.lit(WHITESPACE))


def denied_pattern(suffixes: Sequence[str] = DENIED_SUFFIXES) -> str:
    return "(" + "|".join(re.escape(s) for s in suffixes) + ")$"


def is_denied_email(email: Column, suffixes: Sequence[str] = DENIED_SUFFIXES) -> Column:
    """Suffix test without a dot boundary: ``mydomain.com`` is denied too."""
    return F.lower(email).rlike(denied_pattern(suffixes))


def _around_at(text: Column) -> Column:
    """``text`` without what is not next to an "@": no address is lost, none is added.

    An address lies in a run of its characters and "@". Of the pieces between two "@" only the
    runs at both ends can take part; the middle becomes a space, so the pattern, which is
    costly for each character, sees little more than the addresses.
    """

    def run(value: Column) -> Column:
        return F.regexp_extract(value, "^[a-zA-Z0-9._%+-]*+", 0)

    def ends(piece: Column) -> Column:
        return bound(
            run(piece),
            lambda head: F.when(F.length(head) == F.length(piece), piece).otherwise(
                F.concat(head, F.lit(" "), F.reverse(run(F.reverse(piece))))
            ),
        )

    return F.array_join(F.transform(F.split(text, "@", -1), ends), "@")


def emails(text: Column, suffixes: Sequence[str] = DENIED_SUFFIXES) -> Column:
    """Sorted distinct lower-case e-mail addresses in ``text``."""
    found = F.transform(F.regexp_extract_all(_around_at(text), F.lit(_EMAIL_LINEAR), F.lit(0)), F.lower)
    kept = F.filter(found, lambda e: ~e.rlike(denied_pattern(suffixes)))
    return F.when(
        F.contains(text, F.lit("@")), F.array_sort(F.array_distinct(kept))
    ).otherwise(empty_strings())


def linkedin_urls(text: Column) -> Column:
    """Sorted distinct personal and company profile URLs, case kept."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(PROFILE_OR_COMPANY), F.lit(0)),
        lambda u: F.rtrim(u, F.lit("/")),
    )
    kept = F.filter(found, lambda u: u.contains("/in/") | u.contains("/company/"))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), empty_strings())


def first_profile(text: Column) -> Column:
    """First personal profile URL, or null."""
    return F.nullif(F.rtrim(F.regexp_extract(text, PROFILE, 0), F.lit("/")), F.lit(""))


def collapse_whitespace(text: Column) -> Column:
    """Strip every line, keep at most one blank line in a row, strip the ends."""
    lines = F.split(F.regexp_replace(text, LINE_BREAK, "\n"), "\n")
    stripped = F.array_join(F.transform(lines, strip), "\n")
    return strip(F.regexp_replace(stripped, "\n{3,}", "\n\n"))


def truncate(text: Column, max_chars: int = 15000) -> Column:
    return F.when(
        F.length(text) > max_chars,
        F.concat(F.substring(text, 1, max_chars), F.lit(TRUNCATION_MARKER)),
    ).otherwise(text)


def token_estimate(text: Column) -> Column:
    return estimate_from_length(F.length(text))


def estimate_from_length(chars: Column) -> Column:
    n = F.coalesce(chars, F.lit(0)).cast("bigint")
    return F.when(n == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(n / 4))
    ).cast("bigint")


def sentences(text: Column, skip_page_headers: bool = True) -> Column:
    """Stripped pieces longer than 20 characters, cut at ". " and line ends."""
    pieces = F.filter(
        F.transform(F.split(text, "\\. |\n"), strip), lambda s: F.length(s) > 20
    )
    if skip_page_headers:
        pieces = F.filter(pieces, lambda s: ~s.rlike("^--- PAGE: .* ---$"))
    return pieces


def overview(text: Column, company_name: Column, skip_page_headers: bool = True) -> Column:
    """First two sentences, or a stock line naming the company."""
    stock = F.concat(company_name, F.lit(STOCK_OVERVIEW))
    return bound(
        F.slice(sentences(text, skip_page_headers), 1, 2),
        lambda lead: F.when(
            F.size(lead) == 2, F.concat(F.array_join(lead, ". "), F.lit("."))
        ).otherwise(stock),
    )


def name_role_pattern(compat: bool = False) -> str:
    dash = "[,-–]" if compat else r"[,\-–]"
    return rf"([A-Z][a-z]+{WS}+[A-Z][a-z]+){WS}*{dash}{WS}*({ROLES_AFTER_NAME})"


def role_name_pattern(compat: bool = False) -> str:
    dash = "[,-–:]" if compat else r"[,\-–:]"
    return rf"({ROLES_BEFORE_NAME}){WS}*{dash}{WS}*([A-Z][a-z]+{WS}+[A-Z][a-z]+)"


def _leaders(text: Column, pattern: str, roles: str, name_group: int, role_group: int,
             compat: bool, cap: int) -> Column:
    """One pass over ``text`` for the whole matches; their groups come from the short matches.

    A match holds nothing that depends on the text around it, so the pattern finds the same
    groups in it. A text without any role word is not searched.
    """
    leaders = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda match: F.struct(
            strip(F.regexp_extract(match, pattern, name_group)).alias("name"),
            strip(F.regexp_extract(match, pattern, role_group)).alias("role"),
            F.lit(None).cast("string").alias("linkedin_url"),
        ),
    )
    # The reference counts repeats against the cap; by default each leader counts once.
    found = F.slice(leaders if compat else F.array_distinct(leaders), 1, cap)
    has_role = reduce(or_, [F.contains(text, F.lit(role)) for role in roles.split("|")])
    return F.when(has_role.isNull() | has_role, found).otherwise(F.array().cast(_NO_LEADERS))


def leaders_name_role(text: Column, compat: bool = False, cap: int = 3) -> Column:
    """Leaders written as "First Last, Role"."""
    return _leaders(text, name_role_pattern(compat), ROLES_AFTER_NAME, 1, 2, compat, cap)


def leaders_role_name(text: Column, compat: bool = False, cap: int = 3) -> Column:
    """Leaders written as "Role: First Last"."""
    return _leaders(text, role_name_pattern(compat), ROLES_BEFORE_NAME, 2, 1, compat, cap)


def leaders(text: Column, compat: bool = False, cap: int = 3) -> Column:
    """Matches of the first form, then of the second; duplicates across forms stay."""
    return F.concat(leaders_name_role(text, compat, cap), leaders_role_name(text, compat, cap))


def name_from_title(title: Column) -> Column:
    head = F.substring_index(F.substring_index(title, "-", 1), "|", 1)
    return strip(head)


def list_literal(items: Column) -> Column:
    """Render an array of plain strings the way Python prints a list."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    )
