"""The one Python step: HTML to Markdown and hrefs, in Arrow batches.

Rows keep their partition: the job is a map, needs no shuffle and drops the HTML
column on the way out. It reads each page once for both the text and the links.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sitefold.functions import text

# --- fixed values -----------------------------------------------------------
STRIPPED_TAGS = frozenset((
    "script", "style", "svg", "noscript", "iframe", "form", "nav", "footer", "header",
    "button", "input", "select", "textarea", "picture", "path", "symbol",
))
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
VOID_TAGS = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
))
# ----------------------------------------------------------------------------

#: Marks before a line inside quotes; without a bound nested quotes cost their depth squared.
MOST_QUOTES = 64
_UNSEEN = STRIPPED_TAGS | {"head"}
_BLOCKS = frozenset(("p", "div"))
_HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
_CODE = frozenset(("code", "kbd", "tt"))
#: Tags that Markdown knows; the others write nothing.
_MARKED = _BLOCKS | _CODE | frozenset(_HEADINGS) | frozenset((
    "a", "br", "hr", "ul", "ol", "li", "blockquote", "pre", "dl", "dt", "dd", "table", "tr", "td", "th",
))
# text that Markdown would read as a list item or a rule
_LIST_LIKE = re.compile(r"(?m)^(\s*)(\d+(?=\.\s)|(?=\+\s|-[\s-]))")
_BRACKETS = re.compile(r"([\\\[\]()])")

# Well-formed markup, which most pages are made of: text, and after it an end tag, start tag,
# comment, doctype or the end. A "<" that begins none of them is the last group; it sends the
# page to the tolerant scanner.
_NAME = r"[a-zA-Z][a-zA-Z0-9:-]*"
_ATTR = r"""[a-zA-Z_:@][\w:.@-]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`]*[^\s"'<>=`/](?=[\s>])))?"""


def _tokens(element: str) -> re.Pattern:
    return re.compile(
        rf"([^<]*+)(?:</({_NAME})\s*>|<({_NAME})((?:\s+{_ATTR})*)\s*(?:{element}(/?)>)"
        r"|<!--(?!-?>)(?:(?!--!>)(?:.|\n))*?-->|<!(?:doctype|DOCTYPE)\b[^>\[]*>|\Z|(<))",
        re.ASCII,
    )


_TOKEN = _tokens("")
# The same, but an element that holds text only, as most do, is one match.
_ELEMENT = _tokens(r">([^<]*+)</\3\s*>|")
_ATTRS = re.compile(r"""([a-zA-Z_:@][\w:.@-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""", re.ASCII)
_RAW_TEXT = frozenset(("script", "style"))
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in _RAW_TEXT}

# What the tolerant scanner takes for the parts of a tag. An attribute begins after white
# space, a slash or a quote; an open quote that is never closed is not a value.
_TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
_SPACE_OR_SLASH = re.compile(r"[\s/]*")
_INNER_SPACE = re.compile(r"(?:\s|/(?!>))*")
_LOOSE_ATTR = re.compile(
    r"""(?<=['"\s/])([^\s/>][^\s/=>]*)(\s*=+\s*('[^']*'|"[^"]*"|(?!['"])[^>\s]*))?(?:\s|/(?!>))*"""
)
_SECTION_NAME = re.compile(r"[a-zA-Z][-_.a-zA-Z0-9]*")
_END_TAG = re.compile(r"</\s*([a-zA-Z][-.a-zA-Z0-9:_]*)\s*>")
_CLOSERS = {
    "comment": re.compile(r"--\s*>"),
    "section": re.compile(r"\]\s*\]\s*>"),
    "condition": re.compile(r"\]\s*>"),
}
_SECTIONS = dict.fromkeys(("temp", "cdata", "ignore", "include", "rcdata"), "section") | dict.fromkeys(
    ("if", "else", "endif"), "condition"
)


def _escape(value: str) -> str:
    return _BRACKETS.sub(r"\\\1", value)


def _escape_first(line: str) -> str:
    """What ``_LIST_LIKE`` does to a single line."""
    found = _LIST_LIKE.match(line)
    return line if found is None else f"{found[0]}\\{line[found.end():]}"


_LINKS_AND_LISTS = frozenset(("a", "ol"))
_NO_ATTRS: dict[str, str] = {}


def _attributes(tag: str, attr_text: str) -> dict[str, str]:
    """The attributes that matter: of links and lists, and styles of any element."""
    if not (tag in _LINKS_AND_LISTS or "style" in attr_text.lower()):
        return _NO_ATTRS
    if "&" in attr_text:
        return {
            name.lower(): unescape(double or single or bare)
            for name, double, single, bare in _ATTRS.findall(attr_text)
        }
    return {
        name.lower(): double or single or bare for name, double, single, bare in _ATTRS.findall(attr_text)
    }


class LooseScanner:
    """Tags and text of markup of any form, in time in proportion to its length.

    What is not closed is text, from its "<" to the next ">" or, where none follows, to the next
    "<". Finding out that something is not closed may take a look at all that
    follows, and a page may be full of such openings. So what a look has found is kept: from
    where on no ">" and no end of a comment or section follows, and at which places within
    a start tag the rest of the page does not close it. No place is looked at twice.
    """

    def __init__(self, html: str, reader: "PageReader"):
        self.html, self.reader = html, reader
        self.last_end = html.rfind(">")
        self.unclosed = dict.fromkeys(_CLOSERS, len(html) + 1)  # from there on there is no such end
        self.dead: set[int] = set()
        self.run = 0, 0  # the last run of characters of tag names

    def name_stop(self, at: int) -> int:
        """Where the tag name that begins at ``at`` stops; a run may hold many openings."""
        if not self.run[0] <= at < self.run[1]:
            self.run = at, _TAG_NAME.match(self.html, at).end()
        return self.run[1]

    def next_end(self, at: int) -> int:
        return self.html.find(">", at) if at <= self.last_end else -1

    def closer(self, kind: str, at: int) -> int:
        """Where the first end of this kind after ``at`` stops, or -1."""
        if at >= self.unclosed[kind]:
            return -1
        found = _CLOSERS[kind].search(self.html, at)
        if found is None:
            self.unclosed[kind] = at
            return -1
        return found.end()

    def read(self) -> None:
        html, size, at = self.html, len(self.html), 0
        while at < size:
            opening = html.find("<", at)
            if opening < 0:
                opening = size
            if at < opening:
                self.reader.handle_data(unescape(html[at:opening]))
            if opening == size:
                return
            at = opening
            after = self.markup(at)
            if after is None:  # raw text to the end of the page
                return
            if after < 0:
                after = self.next_end(at + 1) + 1 or html.find("<", at + 1)
                if after < 0:
                    after = at + 1
                self.reader.handle_data(unescape(html[at:after]))
            at = after

    def markup(self, at: int) -> int | None:
        """Where the markup that begins at ``at`` stops, -1 if it is not closed."""
        html = self.html
        second = html[at + 1 : at + 2]
        if second.isascii() and second.isalpha():
            return self.start_tag(at)
        if second == "/":
            return self.end_tag(at)
        if second == "?":
            return self.next_end(at + 2) + 1 or -1
        if second == "!":
            if html.startswith("<!--", at):
                return self.closer("comment", at + 4)
            if html.startswith("<![", at):
                name = _SECTION_NAME.match(html, at + 3)
                kind = name and _SECTIONS.get(name[0].lower())
                if kind:
                    return self.closer(kind, at + 3)
            return self.next_end(at + 2) + 1 or -1
        self.reader.handle_data("<")
        return at + 1

    def end_tag(self, at: int) -> int:
        if self.next_end(at + 1) < 0:
            return -1
        plain = _END_TAG.match(self.html, at)
        if plain:
            self.reader.handle_endtag(plain[1].lower())
            return plain.end()
        name = _TAG_NAME.match(self.html, at + 2)
        if name:
            self.reader.handle_endtag(name[0].lower())
            return self.next_end(name.end()) + 1
        return self.next_end(at + 2) + 1

    def tag_stop(self, at: int) -> int:
        """Where the start tag stops: after its ">", or before what cannot be part of a tag."""
        html, seen = self.html, []
        place = self.name_stop(at + 1)
        if place not in self.dead:
            seen.append(place)
            place = _SPACE_OR_SLASH.match(html, place).end()
        while place not in self.dead:
            seen.append(place)
            attr = _LOOSE_ATTR.match(html, place)
            if attr is None:
                following = html[place : place + 1]
                if following == ">":
                    return place + 1
                if following == "/" and html.startswith("/>", place):
                    return place + 2
                if following and not (following.isascii() and following.isalpha() or following in "=/"):
                    return place
                break
            place = attr.end()
        self.dead.update(seen)
        return -1

    def start_tag(self, at: int) -> int | None:
        html, stop = self.html, self.tag_stop(at)
        if stop < 0:
            return -1
        name_stop = self.name_stop(at + 1)
        attrs, place = {}, _INNER_SPACE.match(html, name_stop).end()
        while place < stop:
            attr = _LOOSE_ATTR.match(html, place)
            if attr is None:
                break
            value = attr[3] if attr[2] else ""
            if value[:1] in ("'", '"') and value[:1] == value[-1:]:
                value = value[1:-1]
            attrs[attr[1].lower()] = unescape(value)
            place = attr.end()
        end = html[place:stop].strip()
        if end not in (">", "/>"):
            self.reader.handle_data(html[at:stop])
            return stop
        tag = html[at + 1 : name_stop].lower()
        self.reader.open(tag, attrs)
        if end == "/>":
            if tag not in VOID_TAGS:
                self.reader.pop()
        elif tag in _RAW_TEXT:
            raw = re.compile(rf"</\s*{tag}\s*>", re.I).search(html, stop)
            return raw and raw.start()
        return stop


class PageReader:
    """One pass over a page: an open-element stack that feeds a Markdown writer."""

    def __init__(self) -> None:
        self.hrefs: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.open_tags: defaultdict[str, int] = defaultdict(int)
        self.hidden = False
        self.out: list[str] = []
        self.breaks = 0          # line ends owed before the next text
        self.gap = False         # a space owed before the next text
        self.fresh = True        # nothing written yet in this item: owe nothing
        self.quotes = self.pre = self.code = 0
        self.lists: list[list] = []
        self.after_list = False
        self.links: list[tuple[str, str] | None] = []
        self.pending_link: str | None = None
        self.header_row = self.next_cell = False
        self.cells = 0

    # -- tree ---------------------------------------------------------------
    def open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "a" and "href" in attrs:
            self.hrefs.append(attrs["href"])
        hidden = (
            self.hidden
            or tag in _UNSEEN
            or ("style" in attrs and bool(HIDDEN_STYLE.search(attrs["style"])))
        )
        self.stack.append((tag, self.hidden))
        self.open_tags[tag] += 1
        self.hidden = hidden
        if not hidden and tag in _MARKED:
            self.mark(tag, attrs, True)
        if tag in VOID_TAGS:
            self.pop()

    def handle_endtag(self, tag):
        if self.open_tags[tag]:
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        tag, outer = self.stack.pop()
        self.open_tags[tag] -= 1
        if not self.hidden and tag in _MARKED:
            self.mark(tag, _NO_ATTRS, False)
        self.hidden = outer
        return tag

    def finish(self) -> str:
        while self.stack:
            self.pop()
        return "".join(self.out)

    def read_well_formed(self, html: str) -> bool:
        """Feed ``html`` if all of it is well-formed markup; False at the first part
        that is not, with the reader then to be thrown away."""
        pos, stack, open_tags, hrefs = 0, self.stack, self.open_tags, self.hrefs
        while pos is not None:
            tokens, pos = _ELEMENT.finditer(html, pos), None
            for found in tokens:
                words, closed, tag, attr_text, only, slash, stray = found.groups()
                if words and not self.hidden:
                    self.handle_data(unescape(words) if "&" in words else words)
                if closed:
                    closed = closed.lower()
                    if self.hidden and stack and stack[-1][0] == closed:  # nothing to write
                        self.hidden = stack.pop()[1]
                        open_tags[closed] -= 1
                    else:
                        self.handle_endtag(closed)
                elif tag:
                    tag = tag.lower()
                    attrs = _attributes(tag, attr_text) if attr_text else _NO_ATTRS
                    stays_hidden = self.hidden and tag not in VOID_TAGS  # whatever it is
                    if stays_hidden:
                        if tag == "a" and "href" in attrs:
                            hrefs.append(attrs["href"])
                        if only is not None:  # opened and closed without a trace
                            continue
                        stack.append((tag, True))
                        open_tags[tag] += 1
                    else:
                        self.open(tag, attrs)
                    if only is not None:
                        if only and not self.hidden:
                            self.handle_data(unescape(only) if "&" in only else only)
                        self.handle_endtag(tag)
                    elif slash:
                        if tag not in VOID_TAGS:
                            self.pop()
                    elif tag in _RAW_TEXT:
                        end = _RAW_END[tag].search(html, found.end())
                        if end is None:
                            return False
                        pos = end.start()
                        break
                elif stray:
                    return False
        return True

    # -- Markdown -----------------------------------------------------------
    def handle_data(self, data):
        if self.hidden or not data:
            return
        if self.pending_link is not None:
            if data == self.pending_link and re.match(r"[a-zA-Z+]+://", data):
                self.pending_link = self.links[-1] = None
                return self.put(f"<{data}>")
            self.pending_link = None
            self.put("[")
        if self.pre:
            return self.put(data)
        if not self.code:
            data = _LIST_LIKE.sub(lambda m: m.group(0) + "\\", data) if "\n" in data else _escape_first(data)
        # runs of white space as one space each
        words = " ".join(data.split())
        if data[0].isspace():
            self.gap = True
        if words and data[-1].isspace():
            words += " "
        self.put(words)

    def put(self, data: str) -> None:
        if not data:
            return
        prefix = ">" * min(self.quotes, MOST_QUOTES) + " " * bool(self.quotes)
        if self.pre and prefix:
            data = data.replace("\n", "\n" + prefix)
        if self.fresh:
            self.fresh = self.gap = False
            self.breaks = 0
        if self.breaks:
            self.out.append(("\n" + prefix) * self.breaks)
        elif self.gap:
            self.out.append(" ")
        self.gap = False
        self.breaks = 0
        self.out.append(data)
        self.after_list = False

    def paragraph(self) -> None:
        self.breaks = 2

    def line(self) -> None:
        self.breaks = self.breaks or 1

    def mark(self, tag: str, attrs: dict, start: bool) -> None:
        if tag in _BLOCKS:
            if not self.links and not self.next_cell:
                self.paragraph()
        elif tag in _HEADINGS:
            self.paragraph()
            if start:
                self.put(_HEADINGS[tag])
        elif tag == "a":
            self.link(attrs, start)
        elif tag == "br":
            if start:
                self.put("\n" + ("> " if self.quotes else ""))
        elif tag == "hr":
            if start:
                self.paragraph()
                self.put("* * *")
                self.paragraph()
        elif tag in ("ul", "ol"):
            if start:
                if not self.lists and not self.after_list:
                    self.paragraph()
                self.lists.append([tag, int(attrs["start"]) - 1 if attrs.get("start", "").isdigit() else 0])
            else:
                if self.lists:
                    self.lists.pop()
                if not self.lists:
                    self.paragraph()
                self.after_list = True
        elif tag == "li":
            self.line()
            if start:
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.put("* " if kind[0] == "ul" else f"{kind[1]}. ")
                self.fresh = True
        elif tag == "blockquote":
            self.paragraph()
            if start:
                self.put("> ")
                self.fresh = True
            self.quotes += 1 if start else -1
        elif tag == "pre":
            self.paragraph()
            self.pre += 1 if start else -1
        elif tag in _CODE:
            if not self.pre:
                self.put("`")
            self.code += 1 if start else -1
        elif tag in ("dl", "dt", "dd"):
            if tag == "dl":
                self.paragraph()
            elif not start:
                self.line()
        elif tag in ("table", "tr", "td", "th"):
            self.table(tag, start)

    def link(self, attrs: dict, start: bool) -> None:
        if start:
            href = attrs.get("href")
            usable = href is not None and not href.startswith("#")
            self.links.append((href, attrs.get("title", "")) if usable else None)
            self.pending_link = href if usable else None
            return
        target = self.links.pop() if self.links else None
        if target is None:
            return
        if self.pending_link is not None:
            self.pending_link = None
            self.put("[")
        href, title = target
        note = ' "' + _escape(title) + '"' if title.strip() else ""
        self.breaks = 0
        self.put("](" + _escape(href) + note + ")")

    def table(self, tag: str, start: bool) -> None:
        if tag == "table":
            self.paragraph()
            self.header_row, self.next_cell = start, False
        elif tag == "tr":
            if start:
                self.cells = 0
                return
            self.next_cell = False
            self.line()
            if self.header_row:
                self.put("|".join(["---"] * self.cells))
                self.line()
                self.header_row = False
        elif start:
            if self.next_cell:
                self.put("| ")
            self.next_cell = True
            self.cells += 1


class LinkReader(PageReader):
    """The same pass without Markdown: links, and the errors that writing it would have raised."""

    def handle_data(self, data):
        pass

    def mark(self, tag: str, attrs: dict, start: bool) -> None:
        if tag == "ol" and attrs.get("start", "").isdigit():
            int(attrs["start"])


def read_page(html: str | None, reader_of: type[PageReader] = PageReader) -> tuple[str, list[str], str | None]:
    """Markdown before white space is collapsed, raw hrefs in order, error text."""
    if not html:
        return "", [], None
    reader = reader_of()
    try:
        if not reader.read_well_formed(html):
            reader = reader_of()
            LooseScanner(html, reader).read()
        return reader.finish(), reader.hrefs, None
    except Exception as err:  # one bad page must not end the job
        return "", [], f"{type(err).__name__}: {err}"


# Workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


SLICE_BYTES = 8_000_000


def _slices(batches: Iterator[pa.RecordBatch], html_col: str) -> Iterator[pa.RecordBatch]:
    """Small pieces without a copy: few pages, and few bytes, are Python strings at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(html_col)), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and (held + size > SLICE_BYTES or row - start == 256):
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        yield batch.slice(start)


def parse_html(pages: DataFrame, html_col: str = "html", contents: bool = True) -> DataFrame:
    """Replace ``html_col`` by ``markdown``, ``hrefs`` and ``parse_error``.

    Filter and prune ``pages`` first: nothing is pushed through a Python step. Without
    ``contents`` there is no Markdown (it is empty); links and errors are the same.
    """
    reader_of = PageReader if contents else LinkReader
    kept = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType(
        kept
        + [
            T.StructField("markdown", T.StringType()),
            T.StructField("hrefs", T.ArrayType(T.StringType())),
            T.StructField("parse_error", T.StringType()),
        ]
    )
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, html_col):
            parsed = [read_page(h, reader_of) for h in batch.column(html_col).to_pylist()]
            markdown, hrefs, errors = zip(*parsed) if parsed else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names]
                + [
                    pa.array(markdown, pa.string()),
                    pa.array(hrefs, pa.list_(pa.string())),
                    pa.array(errors, pa.string()),
                ],
                names=[*names, "markdown", "hrefs", "parse_error"],
            )

    parsed = pages.mapInArrow(run, schema)
    return parsed.withColumn("markdown", text.collapse_whitespace(F.col("markdown"))) if contents else parsed


def scan_contacts(
    pages: DataFrame, html_col: str = "html", denied=text.DENIED_SUFFIXES
) -> DataFrame:
    """:func:`parse_html` plus ``emails`` and ``linkedin_urls`` of HTML and Markdown.

    A match never crosses a line end, so the contacts of both texts together are
    the union of the contacts of each. The HTML is scanned before the Python step,
    which is then the last to see it.
    """

    def union(a: Column, b: Column) -> Column:
        return F.array_sort(F.array_union(a, b))

    html = F.coalesce(F.col(html_col), F.lit(""))
    parsed = parse_html(
        pages.withColumn("emails", text.emails(html, denied)).withColumn(
            "linkedin_urls", text.linkedin_urls(html)
        ),
        html_col,
    )
    md = F.col("markdown")
    failed = F.col("parse_error").isNotNull()
    none = text.empty_strings()
    return parsed.withColumn(
        "emails", F.when(failed, none).otherwise(union(F.col("emails"), text.emails(md, denied)))
    ).withColumn(
        "linkedin_urls",
        F.when(failed, none).otherwise(union(F.col("linkedin_urls"), text.linkedin_urls(md))),
    )
