"""HTML expressions over regular markup, and a table function over a real parser for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Character references that occur in titles, by name (fixed values); numeric ones are read by their number.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "copy": "©", "reg": "®", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "middot": "·", "bull": "•",
}


def unescape(text: Column) -> Column:
    """Character references of :data:`ENTITIES`, ``&amp;`` (last, so that nothing is read twice) and numeric ones replaced."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"), F.lit(1)))
    text = F.when(F.size(codes) == 0, text).otherwise(F.aggregate(codes, text, lambda t, c: F.replace(t, F.concat(F.lit("&#"), c, F.lit(";")), _char(c))))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _char(code: Column) -> Column:
    """The character of a code point, written in decimal or, after an x, in hexadecimal."""
    digits = F.when(F.lower(code).startswith("x"), F.substring(code, 2, 10)).otherwise(F.hex(code.cast("int")))
    return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")


def feed_links(xml: Column) -> Column:
    """The links of RSS items and Atom entries, in order, without empty ones."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)(<(?:item|entry)\b.*?</(?:item|entry)>)"), F.lit(1))

    def link(x: Column) -> Column:
        rss = F.trim(F.regexp_extract(x, r"(?is)<link>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</link>", 1))
        atom = F.trim(F.regexp_extract(x, r"(?is)<link\b[^>]*href\s*=\s*[\"']([^\"']+)[\"']", 1))
        return F.coalesce(F.nullif(rss, F.lit("")), F.nullif(atom, F.lit("")))

    return F.filter(F.transform(items, link), lambda x: x.isNotNull())


def title(html: Column) -> Column:
    """Text of the first ``<title>``, character references replaced, white space collapsed, trimmed; '' if there is none."""
    return F.trim(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))


def section(html: Column, tag: str) -> Column:
    """Markup inside the first element ``tag``; '' if there is none."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def hrefs(html: Column) -> Column:
    """All href values of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def anchors(html: Column) -> Column:
    """array(struct(href, text)) of anchors, text in lower case without tags."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))
    return F.transform(
        whole,
        lambda a: F.struct(
            F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
            F.lower(F.trim(F.regexp_replace(a, r"(?s)<[^>]*>", ""))).alias("text"),
        ),
    )


def metas(html: Column) -> Column:
    """array(struct(name, content)) of meta elements, in lower case; '' for a missing attribute."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))

    def attr(m: Column, name: str) -> Column:
        return F.lower(F.regexp_extract(m, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1))

    return F.transform(whole, lambda m: F.struct(attr(m, "name").alias("name"), attr(m, "content").alias("content")))


class _Parser(HTMLParser):
    SECTIONS = ("header", "footer", "nav", "main")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str]] = []
        self.open: dict[str, list[str]] = {}
        self.seen: set[str] = set()
        self.link: tuple[str, list[str]] | None = None
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "a" and a.get("href"):
            self.link = (a["href"], [])
        elif tag == "meta":
            self.rows.append(("meta", a.get("name", ""), a.get("content", "")))
        elif tag in self.SECTIONS and tag not in self.seen:
            self.seen.add(tag)
            self.open[tag] = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.link:
            self.rows.append(("link", self.link[0], "".join(self.link[1]).strip()))
            self.link = None
        elif tag in self.open:
            self.rows.append(("section", tag, "".join(self.open.pop(tag)).strip()))

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.link:
            self.link[1].append(data)
        for parts in self.open.values():
            parts.append(data)


@F.udtf(returnType=T.StructType().add("kind", "string").add("name", "string").add("value", "string"))
class html_parts:  # noqa: N801
    """Rows (kind, name, value) of a page: links (href, text), metas (name, content) and the first header, footer, nav and main (tag, text)."""

    def eval(self, html: str) -> Iterator[tuple[str, str, str]]:
        if html:
            p = _Parser()
            p.feed(html)
            p.close()
            for tag, parts in p.open.items():
                p.rows.append(("section", tag, "".join(parts).strip()))
            yield from p.rows
