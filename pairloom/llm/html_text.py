"""Main text of web pages by removing what recurs across the pages of a site.

Every element's subtree gets a hash of its tags and text. Spark counts, per host, on
how many pages each subtree occurs; a subtree on many pages of its host is part of the
site's template and is deleted wherever it occurs. What the markup itself names as
menu, header, footer, sidebar, notice, advert, form, script, style or comment goes as
well. The rest of the article (of the body, if a page marks no article) is the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import first_column, pinned, text_slices, tidied
from pairloom.llm.url_filter import host_and_path
from pairloom.operators.joins import lookup_join

# High, because a passage that a third of all articles quote is not a template.
LEAST_PAGES, LEAST_SHARE = 20, 0.8

# HTML elements by their role, and names that sites give to what is not the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select textarea input svg head object menu dialog title".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr dt dd li".split()) | frozenset(["li", "dt", "dd"])
_SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _SAME.items()}
_SCOPE = frozenset("html body table td th article section main div blockquote li ul ol button object template".split())
_NAMES = frozenset(
    "ad ads adsbox advert adverts advertisement advertising sponsor sponsored promo banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer colophon cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond disqus replies "
    "skip pagination pager toolbar widget".split())
# Words beside such a name that do not change what it names.
_PLAIN = frozenset(
    "area bar block body bottom box btn button buttons col column container content desktop group icon icons inner item items left level link links list "
    "main mobile outer page panel primary right row secondary section site slot small sticky title top unit wrap wrapper global fixed has".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>(){3}", re.S)
_COMMENT = re.compile(r"<[!?]")
# Tags with a quote that nothing closes, after which quotes are no longer trusted: each costs a look at the whole rest of the page.
_ODD_QUOTES = 50
_NAME = re.compile(r"[a-z0-9]+")


def _is_boilerplate(tag: str, attributes: str, nested: bool) -> bool:
    """Whether the markup itself says that an element is not part of the article."""
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden":
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name == "role":
            if value in _ROLES:
                return True
        elif tag == "article":
            # Comments may be articles of their own; the article itself may say that it has comments.
            if nested and "comment" in value:
                return True
        elif any(_names_boilerplate(word) for word in value.split()):
            return True
    return False


def _names_boilerplate(word: str) -> bool:
    """Whether a class or id names boilerplate: ``cookie-notice`` and ``site-header`` do, ``article-header`` and ``related-work`` do not."""
    parts = [p for p in _NAME.findall(word) if not p.isdigit()]
    return not _NAMES.isdisjoint(parts) and all(p in _NAMES or p in _PLAIN for p in parts)


class _Page:
    """One pass over a page: elements with their parents and subtree hashes, and text blocks in order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.hashes = ["#"], [0], [False], [0]
        self.blocks: list[tuple[int, str]] = []
        self.stack, self.digests = [0], [xxhash.xxh3_64()]
        self.run: list[str] = []
        self.open_tags: dict[str, int] = {}
        self.block_of = [0]
        at = odd = 0
        lowered, last, finder = None, source.rfind(">"), _TAG
        while True:
            # Behind the last bracket no tag ends; looking for one at every place would be quadratic.
            match = finder.search(source, at) if at <= last else _COMMENT.search(source, at)
            if match is None or at > last:
                self.text(source[at:match.start() if match else len(source)])
                break
            self.text(source[at:match.start()])
            at = match.end()
            slash, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if match[5] and ('"' in attributes or "'" in attributes):
                odd += 1
                finder = _PLAIN_TAG if odd >= _ODD_QUOTES else finder
            if not name:
                continue
            tag = name.lower()
            if slash:
                self.close(tag)
                continue
            self.open(tag, attributes)
            if tag in _VOID or attributes.endswith("/") and tag in ("svg", "path"):
                self.pop()
            elif tag in _RAW:
                lowered = source.lower() if lowered is None else lowered
                end = lowered.find("</" + tag, at) if len(lowered) == len(source) else -1
                if len(lowered) != len(source):
                    found = re.compile("</" + tag, re.I).search(source, at)
                    end = found.start() if found else -1
                stop = len(source) if end < 0 else end
                if tag not in _DROPPED:
                    self.text(source[at:stop])
                at = stop
        while len(self.stack) > 1:
            self.pop()
        self.flush()

    def text(self, value: str) -> None:
        if value and not self.dropped[self.stack[-1]]:
            value = entities.unescape(value) if "&" in value else value
            self.run.append(value)
            self.digests[-1].update(" ".join(value.split()))

    def flush(self) -> None:
        if self.run:
            value = " ".join("".join(self.run).split())
            self.run.clear()
            if value:
                # The block belongs to the innermost element that is a block itself.
                self.blocks.append((self.block_of[self.stack[-1]], value))

    def open(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self.close_if_open(frozenset(["p"]), _SCOPE)
        if tag in _SAME:
            self.close_if_open(*_SAME[tag])
        if tag in _BLOCK:
            self.flush()
        elif tag in ("br", "img", "wbr"):
            self.run.append("" if tag == "wbr" else " ")
        parent = self.stack[-1]
        nested = tag == "article" and self.open_tags.get(tag, 0) > 0
        dropped = self.dropped[parent] or _is_boilerplate(tag, attributes, nested)
        if dropped and not self.dropped[parent]:
            self.flush_inline()
        self.tags.append(tag)
        self.parents.append(parent)
        self.dropped.append(dropped)
        self.hashes.append(0)
        self.stack.append(len(self.tags) - 1)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.block_of.append(len(self.tags) - 1 if tag in _BLOCK else self.block_of[parent])
        self.digests.append(xxhash.xxh3_64(tag))

    def flush_inline(self) -> None:
        self.run.append(" ") if self.run else None

    def pop(self) -> None:
        node = self.stack[-1]
        if self.tags[node] in _BLOCK:
            self.flush()
        self.stack.pop()
        self.open_tags[self.tags[node]] -= 1
        digest = self.digests.pop().intdigest()
        self.hashes[node] = digest - (1 << 63)
        if not self.dropped[node]:
            self.digests[-1].update(digest.to_bytes(8, "little"))

    def close(self, tag: str) -> None:
        if tag == "br":
            self.run.append(" ")
            return
        if self.open_tags.get(tag):
            while self.tags[self.stack[-1]] != tag:
                self.pop()
            self.pop()

    def close_if_open(self, tags: frozenset, bounds: frozenset) -> None:
        if not any(self.open_tags.get(t) for t in tags):
            return
        for node in reversed(self.stack):
            if self.tags[node] in tags:
                while self.stack[-1] != node:
                    self.pop()
                self.pop()
                return
            if self.tags[node] in bounds or not node:
                return

    def main(self) -> list[bool]:
        """For each element whether it lies in the article: in an article, else in main, else anywhere."""
        for wanted in ("article", "main"):
            within = [False] * len(self.tags)
            for node in range(1, len(self.tags)):
                within[node] = within[self.parents[node]] or self.tags[node] == wanted and not self.dropped[node]
            if any(within):
                return within
        return [True] * len(self.tags)

    def subtrees(self) -> set[int]:
        """Hashes of the elements that hold text of the article."""
        within, out = self.main(), set()
        for node, _ in self.blocks:
            while node and within[node]:
                out.add(self.hashes[node])
                node = self.parents[node]
        return out

    def main_text(self, template: set[int]) -> str:
        within = self.main()
        gone = [False] * len(self.tags)
        for node in range(1, len(self.tags)):
            gone[node] = gone[self.parents[node]] or self.dropped[node] or self.hashes[node] in template
        return "\n".join(value for node, value in self.blocks if within[node] and not gone[node])


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """``host`` and ``template``: the subtree hashes on at least ``least_pages`` pages and ``share`` of the host's pages.

    A subtree counts once per page; counts are summed inside the tasks first, so a hot
    host is no hot task. A host's list is at most 1 / share times as long as its pages
    have subtrees on average.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            hosts, hashes = [], []
            for host, source in zip(first_column(part, "host").to_pylist(), first_column(part, "html").to_pylist(), strict=True):
                found = _Page(source or "").subtrees()
                hosts += [host] * (len(found) + 1)
                hashes += [None, *found]  # the page itself
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "subtree"])

    counts = pinned(pages.select("host", "html").mapInArrow(tidied(run), "host string, subtree bigint").groupBy("host", "subtree").agg(F.count("*").alias("n")).where(f"subtree is null or n >= {least_pages}"))
    sizes = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    many = counts.where("subtree is not null").join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return many.groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """``key``, ``url`` and ``text`` of each page: its article's blocks in order, one per line.

    A null or empty page has empty text; a null url has an empty host; repeated rows
    repeat; other columns are ignored, whatever their names; an empty table gives an
    empty result. Pages are parsed twice and never shuffled while the templates are
    small enough to be looked up.
    """
    host, _ = host_and_path(pages[url])
    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"), host.alias("host"), pages[html].alias("html"))
    known = lookup_join(rows, pinned(site_templates(rows, least_pages, share)), "host", "left", spread_by=["key", "url"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [_Page(h or "").main_text(set(t or ())) for h, t in zip(first_column(part, "html").to_pylist(), first_column(part, "template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([first_column(part, "key"), first_column(part, "url"), pa.array(texts, pa.string())], names=[key, "url", "text"])

    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    return known.select("key", "url", "html", "template").mapInArrow(tidied(run), schema)
