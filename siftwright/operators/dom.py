"""HTML parsing, once per page: a tolerant tree walk on the standard library's parser that feeds all other operators.

`parse` gives one row per page with its nodes nested, so text, links, metas, sections
and address blocks come from a single pass and no page is parsed twice. The text of a page
is kept once (`flow`); nodes point into it, so that deep nesting costs nothing. Only short
elements carry their own text too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "iframe", "svg"}
BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "header", "footer", "nav", "aside", "address", "blockquote", "pre", "form", "dl", "dt", "dd"}
WORDED = {"a", "address", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "script", "td", "th", "title"}  # elements that carry their own text
FOOT = re.compile(r"foot|bottom|legal", re.I)
NOISE_TAGS = {"nav", "aside", "header", "footer", "form"}
NOISE = re.compile(r"(?:^|[\s_-])(?:nav|navigation|menu|sidebar|cookie|banner|breadcrumb|advert|ad|ads|popup|modal|social|share|newsletter|widget|comments?|related)(?:$|[\s_-])", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Page(HTMLParser):
    """Nodes in document order, each with its own text; unclosed elements end with their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.flow: list[str] = []
        self.at = 0
        self.main: list[str] = []
        self.title: list[str] = []
        self.lang = None

    def _state(self) -> tuple[bool, bool, bool]:
        top = self.open[-1][1] if self.open else None
        return (top["in_footer"], top["in_noise"], top["in_main"]) if top else (False, False, False)

    def close_from(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        for _, node in self.open[i:]:
            node["end"], node["last"] = self.at, len(self.nodes) - 1
        del self.open[i:]

    def _add(self, data: str) -> None:
        self.flow.append(data)
        self.at += len(data)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES and self.open and self.open[-1][0] in CLOSES[tag]:
            self.close_from(-1)
        if tag in BLOCKS and tag != "br" and self.open and self.open[-1][0] == "p":
            self.close_from(-1)
        footer, noise, main = self._state()
        attrs = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = attrs.get("lang")
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        node = {
            "ord": len(self.nodes), "tag": tag, "last": len(self.nodes), "attrs": attrs, "own": [], "start": self.at, "end": self.at,
            "in_footer": footer or tag == "footer" or bool(FOOT.search(named)),
            "in_noise": noise or tag in NOISE_TAGS or bool(NOISE.search(named)) or attrs.get("role") in ("navigation", "banner", "complementary"),
            "in_main": main or tag in ("main", "article"),
        }
        self.nodes.append(node)
        if tag in BLOCKS:
            self._break()
        if tag not in VOID:
            self.open.append((tag, node))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_from(i)
                break
        if tag in BLOCKS:
            self._break()

    def _break(self):
        self._add("\n")
        self.main.append("\n")

    def handle_data(self, data):
        if any(t in SILENT for t, _ in self.open):
            for t, node in self.open[::-1]:
                if t == "script" and node:
                    node["own"].append(data)
                    break
            return
        if any(t == "title" for t, _ in self.open):
            self.title.append(data)
            self.open[-1][1]["own"].append(data)
            return
        self._add(data)
        if not self._state()[1]:
            self.main.append(data)


def lines(parts: list[str]) -> str:
    """Text by lines: single spaces within one, no empty ones doubled."""
    rows = [" ".join(x.split()) for x in "".join(parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows)).strip()


def page(html: str | None) -> dict:
    parser, error = Page(), None
    try:
        parser.feed(html or "")
        parser.close()
    except Exception as e:  # a broken page keeps what was read so far, and says why it ended
        error = f"{type(e).__name__}: {e}"[:200]
    parser.close_from(0)
    flow = "".join(parser.flow)
    own = lambda n: " ".join(("".join(n["own"]) if n["tag"] in ("script", "title") else flow[n["start"] : n["end"]]).split()) if n["tag"] in WORDED else None
    nodes = [{**{k: n[k] for k in ("ord", "last", "tag", "attrs", "in_footer", "in_noise", "in_main", "start", "end")}, "text": own(n)} for n in parser.nodes]
    text = "\n".join(x for x in lines(parser.flow).split("\n") if x)
    main = "\n".join(x for x in lines(parser.main).split("\n") if x)
    return {"title": " ".join("".join(parser.title).split()) or None, "lang": parser.lang, "text": text, "main_text": main if len(main) >= 100 else text, "flow": flow, "nodes": nodes, "error": error}


COLUMNS = ["page_id", "url", "title", "lang", "text", "main_text", "flow", "nodes", "error"]


def parse(pages: DataFrame) -> DataFrame:
    """COLUMNS of pages (page_id, url, html). A null html is an empty page; error says why a broken page ended early."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield pd.DataFrame([{"page_id": r.page_id, "url": r.url, **page(r.html)} for r in b.itertuples()], columns=COLUMNS)

    schema = "page_id long, url string, title string, lang string, text string, main_text string, flow string, nodes array<struct<ord:int,last:int,tag:string,attrs:map<string,string>,in_footer:boolean,in_noise:boolean,in_main:boolean,start:int,end:int,text:string>>, error string"
    return pages.select("page_id", "url", "html").mapInPandas(run, schema)


def select(tag: str, nodes: str = "nodes") -> Column:
    """The nodes of a tag."""
    return F.filter(nodes, lambda n: n["tag"] == tag)


def text_of(n: Column, flow: str | Column = "flow") -> Column:
    """The text of any node, cut from that of its page; lines as the blocks in it."""
    cut = F.substring(F.col(flow) if isinstance(flow, str) else flow, n["start"] + 1, n["end"] - n["start"])
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def attr(n: Column, name: str) -> Column:
    """An attribute of a node; null without it."""
    return n["attrs"][name]


def sections(parsed: DataFrame) -> DataFrame:
    """(page_id, kind, ord, text): headings, paragraphs of over 10 characters, list items, table cells and address blocks."""
    kinds = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "paragraph", "li": "list", "td": "table", "th": "table", "address": "address"}
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    rows = parsed.select("page_id", F.explode("nodes").alias("n")).select("page_id", F.try_element_at(kind, "n.tag").alias("kind"), "n.ord", "n.text")
    return rows.where("kind is not null and text <> '' and (kind <> 'paragraph' or length(text) > 10)")


def around(text: Column, keyword: str, before: int = 50, after: int = 200) -> Column:
    """The text around the first occurrence of a keyword in any case; null without one."""
    at = F.locate(keyword.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + len(keyword) + after))
