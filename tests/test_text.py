"""Text expressions against Python's own string and regex behaviour."""

import random
import re

from pyspark.sql import functions as F

from sitefold.functions import text

# fixed values
DENIED = ("example.com", "domain.com", "sentry.io", "wixpress.com", "schema.org",
          "png", "jpg", "jpeg", "svg", "webp", "gif")


def test_emails_properties(column):
    """Random text: what comes out is a sorted set of allowed matches, and none is missed."""
    rng = random.Random(11)
    parts = ["a", "B.c", "@", "@@", "x.io", ".com", " ", "\n", "-", "_%+", "mydomain.com", "é", ".png",
             "@acme.io", "info@acme.io", "..", "1", "<", ">", "@x.c", ".js"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    pattern = re.compile(text.EMAIL)
    for value, found in zip(texts, column(texts, text.emails)):
        matches = {m.group().lower() for m in pattern.finditer(value)}
        assert found == sorted(set(found)) and set(found) <= matches
        for mail in matches.difference(found):  # left out for its domain or its ending only
            assert mail.endswith(DENIED) or mail.endswith((".css", ".js")), mail
        assert not any(mail.endswith(DENIED) for mail in found)


def test_emails_cases(column):
    cases = {
        "a@b.com.x@y.org": [".x@y.org", "a@b.com"], "a@b.com@c.org": ["a@b.com"], "": [], "x" * 3000: [],
        "desk@harbour.io,DESK@HARBOUR.IO": ["desk@harbour.io"], "logo@2x.png pier@north.io": ["pier@north.io"],
    }
    assert column(list(cases), text.emails) == list(cases.values())


def test_emails_stay_linear_on_long_runs(column):
    assert column(["a" * 2_000_000], text.emails) == [[]]
    assert column(["a" * 500_000 + " x@y.io"], text.emails) == [["x@y.io"]]


def test_contacts_in_prose(column):
    prose = ("Ring the pier office (pier@north-harbour.io) or, at night, NIGHT@north-harbour.io; "
             "bounce@mail.sentry.io is a machine. Captain: https://linkedin.com/in/mara-holt/ - "
             "the port itself is at http://www.linkedin.com/company/north-harbour")
    assert column([prose], text.emails) == [["night@north-harbour.io", "pier@north-harbour.io"]]
    assert column([prose], text.linkedin_urls) == [
        ["http://www.linkedin.com/company/north-harbour", "https://linkedin.com/in/mara-holt"]
    ]


def test_linkedin_case_rules(column):
    cases = ["HTTPS://LinkedIn.com/in/Ada/", "https://linkedin.com/IN/ada", "http://linkedin.com/school/x", ""]
    assert column(cases, text.linkedin_urls) == [["HTTPS://LinkedIn.com/in/Ada"], [], [], []]
    assert column(cases, text.first_profile) == [
        "HTTPS://LinkedIn.com/in/Ada", "https://linkedin.com/IN/ada", None, None
    ]


def test_deny_list_has_no_dot_boundary(column):
    assert column(["a@mydomain.com", "a@x.io"], text.is_denied_email) == [True, False]
    assert column(["a@example.com"], lambda c: text.emails(c, ["x.org"])) == [["a@example.com"]]


def test_collapse_whitespace_properties(column):
    """No outer white space, no two blank lines in a row, and the same visible lines in order."""
    rng = random.Random(5)
    parts = ["a", "b c", "\n", "\n", "\r\n", "\r", " ", "\t", " ", " ", "\x0b", "\x1c", "　", "\x85", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    for value, got in zip(texts, column(texts, text.collapse_whitespace)):
        assert got == got.strip() and "\n\n\n" not in got
        assert all(line == line.strip() for line in got.split("\n"))
        assert [x for x in got.split("\n") if x] == [x.strip() for x in value.splitlines() if x.strip()]


def test_collapse_whitespace_cases(column):
    cases = {"a\n\n\n\nb": "a\n\nb", "a\nb": "a\nb", " a \n \n\t b": "a\n\nb", "\n\n": "", "a\r\n\r\nb": "a\n\nb"}
    assert column(list(cases), text.collapse_whitespace) == list(cases.values())


def test_strip_covers_every_python_space(column):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(text.WHITESPACE) == spaces
    assert column([s + "x" + s for s in spaces], text.strip) == ["x"] * len(spaces)
    assert column(spaces, lambda c: c.rlike(f"^{text.WS}$")) == [True] * len(spaces)


def test_truncate(column):
    assert len(text.TRUNCATION_MARKER) == 51
    got = column(["abc", "abcd", "éééé", "😀😀😀😀"], lambda c: text.truncate(c, 3))
    assert got == ["abc", "abc" + text.TRUNCATION_MARKER, "ééé" + text.TRUNCATION_MARKER,
                   "😀😀😀" + text.TRUNCATION_MARKER]


def test_token_estimate(column):
    assert column(["", "a", "abcd", "a" * 11, None], text.token_estimate) == [0, 1, 1, 2, 0]


def test_overview(column):
    from pyspark.sql import functions as F

    page = "--- PAGE: https://acme.io/about ---\nAcme builds developer tools. It ships them to every team.\nshort"
    name = F.lit("Acme")
    assert column([page, "tiny", ""], lambda c: text.overview(c, name)) == [
        "Acme builds developer tools. It ships them to every team..",
        "Acme provides digital products and services.",
        "Acme provides digital products and services.",
    ]
    assert column([page], lambda c: text.overview(c, name, skip_page_headers=False)) == [
        "--- PAGE: https://acme.io/about ---. Acme builds developer tools."
    ]


def _pairs(rows):
    return [[(x["name"], x["role"]) for x in row] for row in rows]


def test_leaders_strict_and_compat(column):
    cases = ["Jane Roe, CEO", "Jane Roe CEO", "Jane Roe – CTO", "Jane Roe - VP", "Jane Roe — CTO",
             "Jane Roe, CEO Jane Roe, CEO Al Poe, CTO Ed Fox, VP Di Oak, VP"]
    assert _pairs(column(cases, text.leaders_name_role)) == [
        [("Jane Roe", "CEO")], [], [("Jane Roe", "CTO")], [("Jane Roe", "VP")], [],
        [("Jane Roe", "CEO"), ("Al Poe", "CTO"), ("Ed Fox", "VP")],
    ]
    compat = _pairs(column(cases, lambda c: text.leaders_name_role(c, compat=True)))
    # in the range form a letter may stand for the dash, and the name loses it
    assert compat[1] == [("Jane Ro", "CEO")]
    assert compat[5] == [("Jane Roe", "CEO"), ("Jane Roe", "CEO"), ("Al Poe", "CTO")]
    pattern = re.compile(text.name_role_pattern(True).replace(text.WS, r"\s"))
    assert compat == [[(a, b) for a, b in pattern.findall(c)][:3] for c in cases]
    assert _pairs(column(["CTO: Bo Lind, Founder - Al Poe"], text.leaders_role_name)) == [
        [("Bo Lind", "CTO"), ("Al Poe", "Founder")]
    ]


def test_leaders_search_a_text_once_for_each_form(spark, column):
    df = spark.createDataFrame([("Ada Stone, CEO",), (None,)], "context string")
    found = df.select(text.leaders(F.col("context")).alias("l"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(context", plan)) == 2
    assert "Contains(context" in plan or "Contains(" in plan
    assert found.collect()[1]["l"] is None
    assert column(["no one here", "CEO", ""], text.leaders) == [[], [], []]


def test_leaders_keep_repeats_across_forms(column):
    got = _pairs(column(["Ada Stone, CEO: Ada Stone"], text.leaders))
    assert got == [[("Ada Stone", "CEO"), ("Ada Stone", "CEO")]]


def test_title_and_list(column):
    assert column(["Bo Lind - CTO | X", "Di Vale | Profile", "Jean-Luc P"], text.name_from_title) == [
        "Bo Lind", "Di Vale", "Jean"
    ]
    from pyspark.sql import functions as F

    assert column(["a,b", ""], lambda c: text.list_literal(F.filter(F.split(c, ","), lambda x: x != ""))) == [
        "['a', 'b']", "[]"
    ]


def test_email_pattern_sees_only_what_is_next_to_an_at(column):
    filler = "no address here, " * 200
    values = [f"{filler}<i>a.b@c.io</i>{filler}x@y.de.z@w.org {filler}", f"{filler}@{filler}", "a@b@c.com", "@", ""]
    short = column(values, text._around_at)
    assert all(len(s) < 100 for s in short) and short[2:] == values[2:]
    assert column(values, text.emails) == [[".z@w.org", "a.b@c.io", "x@y.de"], [], ["b@c.com"], [], []]
