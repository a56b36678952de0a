"""Main text of web pages: templates of a site are found by counting element subtrees per host, and removed.

Every page is cut into elements, each with a hash of its subtree (tag, class, id, texts, children). Spark counts for each
host on how many different pages a subtree stands; one that recurs is a template of the site and is deleted. Pages count
as different where the longest text outside of the subtree differs, so that copies of one article make no template.
Then elements go whose tag, role, class or id says that they are menus, headers, footers, sidebars, notices, adverts,
forms, reader comments, scripts or styles, and the text of the page's articles is what stays: of its <article>, else its
<main> or an element marked as article body, else of its whole body. Within an article only containers (div, section, ...)
that hold less than half of its text can be templates, and its own <header> stays: paragraphs that pages share are text.

Character references are decoded, white space (Unicode's) becomes one blank, also where blocks meet and at <br>; text is
not cut or changed otherwise. A null or empty page, or one that is nothing but templates, gives an empty text. A page
whose url is null or has no host is cleaned without templates of a site. Broken markup is read as browsers do: missing
end tags are implied, stray ones ignored, an open comment or script takes the rest. Ids are not looked at, repeated rows
stay, an empty table gives an empty one; other columns stay, those named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardspark.llm._staging import Staging, fresh, join_counted
from yardspark.llm._words import pieces

#: A subtree is a template from so many different pages of its host on.
MANY = 5
#: Templates (8 bytes each) that are broadcast at most; more meet their pages in joins.
BROADCAST_TEMPLATES = 1 << 22

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no markup; none of it is text of the page.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_END_OF_RAW = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I).search for t in _RAW}
#: Elements that go with all they hold.
_DROPPED = frozenset("head nav aside footer form fieldset button select option optgroup datalist label input output noscript template svg canvas audio video object dialog menu search".split())
#: Those of them whose articles are not the page's either.
_NEVER = frozenset("nav aside footer dialog template noscript".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of an article that may be templates.
_CONTAINERS = frozenset("div section aside nav footer form figure details dialog table".split())
_IN_HEAD = frozenset("head meta link base noscript template".split())
#: An open element of the first kind ends where one of this tag begins, unless one of the second kind lies between.
_ENDS = {
    "li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_NOT_IN_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend body head html".split())
_KEEPS_P = frozenset("table td th caption button object template".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words of class or id.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond responses reply replies discussion"
    " adsbygoogle aside disqus sidebar sidebars widget widgets rail related recommended recommendations breadcrumb breadcrumbs pagination pager nav navbar navigation menu menus footer toolbar paywall".split()
)
_OUTER_MARKS = frozenset("header masthead topbar skip logo branding search copyright".split())
#: Words that rule out also what holds articles: theirs are not the page's.
_OTHERS = frozenset("comment comments commentlist respond responses reply replies discussion disqus related recommended recommendations".split())
#: Beginnings of the class names of articles that are not the page's.
_OTHER_ARTICLE = re.compile(r"(?:^|\s)(?:ad|ads|advert|sponsored|promo|comments?|reply|related|recommended|teaser)(?![a-z0-9])", re.I).search
#: Words after which a class's next word says what is there or not, but not what the element is.
_ABOUT = frozenset("no non not has have with without hide show".split())
_BODIES = frozenset(("article-body", "articlebody", "article-content", "article__body", "post-content", "post-body", "entry-content", "story-body", "main-content"))

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|(\Z)))"  # comments
    r"|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>"  # declarations and what is read like them
    r"|<(/?)([a-zA-Z][^\t\n\f\r />]*)((?:[^=>]++|=[\t\n\f\r ]*(?:\"[^\"]*\"|'[^']*'|))*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\t\n\f\r "'=/]+)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r "']+)))?""")
_TOLD = re.compile("class|id|role|hidden|style|itemprop", re.I).search
_NAME_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])").findall
_HIDDEN = re.compile(r"display\s*:\s*none", re.I).search


class Element:
    """An element with its range of text pieces; drop: its markup says that it is no text of the page."""

    __slots__ = ("tag", "name", "parent", "first", "last", "drop", "others", "body", "inside", "within", "holds", "parts", "digest")

    def __init__(self, tag: str, name: str, parent: Element | None, first: int):
        self.tag, self.name, self.parent, self.first, self.last = tag, name, parent, first, first
        self.drop = self.others = self.body = self.holds = False  # holds: an article of the page, or <main>
        self.within = parent is not None and (parent.within or parent.tag == "article")
        self.inside = self.within or (parent is not None and (parent.inside or parent.tag == "main"))
        self.parts, self.digest = [], b""

    def judge(self, attributes: dict[str, str]) -> None:
        tag, words = self.tag, set()
        for name in self.name.split():
            said = [w.lower() for w in _NAME_WORDS(name)]
            for before, w, after in zip(["", *said], said, [*said[1:], ""], strict=False):
                if before not in _ABOUT and after != "free":
                    words.update((w, before + w))  # side-bar is a sidebar
        role = attributes.get("role", "").lower()
        self.body = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody" or not _BODIES.isdisjoint(self.name.lower().split())
        if tag in ("html", "body", "main"):
            return
        self.drop = tag in _DROPPED or role in _ROLES or (tag == "header" and not self.inside) or "hidden" in attributes or bool(_HIDDEN(attributes.get("style", "")))
        if tag == "article":
            self.drop = self.drop or bool(_OTHER_ARTICLE(self.name))
        elif not self.body:
            self.others = not words.isdisjoint(_OTHERS)
            self.drop = self.drop or not words.isdisjoint(_MARKS) or not (self.inside or tag in _HEADINGS or words.isdisjoint(_OUTER_MARKS))


class Page:
    """The elements of a page and the pieces of its text; pieces of one blank stand where blocks meet."""

    def __init__(self, source: str):
        self.text: list[str] = []
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.opened: dict[str, int] = {}
        at, end = 0, source.rfind(">") + 1
        while found := _TAG.search(source, at, end):
            self._words(source[at : found.start()])
            at = found.end()
            if found[1] is not None:  # an open comment
                at = len(source)
            if tag := found[3]:
                tag = tag.lower()
                if found[2]:
                    self._end(tag)
                else:
                    self._start(tag, found[4])
                    if tag in _RAW:
                        close = _END_OF_RAW[tag](source, at)
                        at = close.start() if close else len(source)
                        end = max(end, at)
        self._words(source[at:])
        while self.open:
            self._close()

    def _words(self, raw: str) -> None:
        if not raw:
            return
        if self.open and self.open[-1].tag == "head" and raw.strip():
            self._close()
        raw = entities.unescape(raw) if "&" in raw else raw
        self.text.append(raw)
        if self.open:
            self.open[-1].parts.append(" ".join(raw.split()).encode("utf-8", "replace"))

    def _close(self) -> None:
        e = self.open.pop()
        self.opened[e.tag] -= 1
        if e.tag in _BLOCK:
            self.text.append(" ")
        e.last = len(self.text)
        e.digest = blake2b(b"\0".join([e.tag.encode(), e.name.encode("utf-8", "replace"), *e.parts]), digest_size=8).digest()
        if any(e.parts):
            if self.open:
                self.open[-1].parts.append(e.digest)
        else:
            e.digest = b""  # without text
        e.parts = []

    def _close_until(self, ends: frozenset[str], bounds: frozenset[str]) -> None:
        if not any(self.opened.get(t) for t in ends):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in ends:
                while len(self.open) > i:
                    self._close()
                return
            if self.open[i].tag in bounds:
                return

    def _start(self, tag: str, rest: str) -> None:
        block = tag in _BLOCK
        if tag in ("br", "hr"):
            self.text.append(" ")
        if tag in _VOID or tag in _RAW:
            return
        if self.open and self.open[-1].tag == "head" and block and tag not in _IN_HEAD:
            self._close()
        if tag in _NOT_IN_P and self.opened.get("p"):
            self._close_until(frozenset(("p",)), _KEEPS_P)
        if tag in _ENDS:
            self._close_until(*_ENDS[tag])
        attributes = {}
        if rest and _TOLD(rest):
            for name, a, b, c in _ATTRIBUTE.findall(rest):
                attributes.setdefault(name.lower(), entities.unescape(a or b or c))
        if not block and tag not in _DROPPED and not attributes:
            return
        parent = self.open[-1] if self.open else None
        e = Element(tag, f"{attributes.get('class', '')} {attributes.get('id', '')}".strip(), parent, len(self.text))
        e.judge(attributes)
        if not block and not e.drop and not e.body:
            return
        if block:
            self.text.append(" ")
        up = parent if e.body and not e.drop and not e.within else None
        while up is not None and not up.holds:
            up.holds, up = True, up.parent
        self.elements.append(e)
        self.open.append(e)
        self.opened[tag] = self.opened.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.opened.get(tag):
            self.text.append(" ")
        if not self.opened.get(tag):
            return
        block = tag in _BLOCK
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                while len(self.open) > i:
                    self._close()
                return
            if not block and self.open[i].tag in _BLOCK:
                return

    def candidates(self) -> list[Element]:
        """The elements that may be templates of the site: those with text that hold no article and, within one, are
        containers of less than half of its text."""
        size = np.cumsum([0] + [len(t) for t in self.text])
        out, outer = [], {}
        for e in self.elements:
            p = e.parent
            outer[id(e)] = top = e if e.tag in ("article", "main") and not e.inside else outer.get(id(p)) if p is not None else None
            if not e.digest or e.holds or e.tag in ("html", "head", "body", "main", "article"):
                continue
            if not e.inside or (e.tag in _CONTAINERS and 2 * (size[e.last] - size[e.first]) < size[top.last] - size[top.first]):
                out.append(e)
        return out

    def around(self, held: list[Element]) -> list[str]:
        """For each element the longest piece of the page's text outside of it, the first of equally long ones."""
        before, after, best = [""], [""], ""
        for t in self.text:
            best = t if len(t) > len(best) else best
            before.append(best)
        best = ""
        for t in reversed(self.text):
            best = t if len(t) >= len(best) else best
            after.append(best)
        after.reverse()
        return [max(before[e.first], after[e.last], key=len) for e in held]

    def main_text(self, templates: set[int]) -> str:
        """The page's text without templates (ids of elements) and what its markup rules out."""
        for marks in (True, False):  # where the words of classes leave nothing, they meant something else
            gone = [e for e in self.elements if id(e) in templates or (e.drop and (marks or e.tag in _DROPPED) and not (e.holds and not e.others and e.tag not in _NEVER))]
            lost = np.zeros(len(self.text) + 1, np.int64)
            for e in gone:
                lost[e.first] += 1
                lost[e.last] -= 1
            free = np.cumsum(lost) == 0
            for kind in ("article", "body", ""):
                kept = np.zeros(len(self.text) + 1, np.int64)
                for e in self.elements if kind else []:
                    if e.tag == "article" if kind == "article" else e.body:
                        kept[e.first] += 1
                        kept[e.last] -= 1
                if not kind:
                    kept[0] += 1
                words = "".join(t if k else " " for t, k in zip(self.text, (free & (np.cumsum(kept) > 0))[:-1].tolist(), strict=True)).split()
                if words:
                    return " ".join(words)
        return ""


def host_of(url: Column) -> Column:
    """The host of a url in small letters, null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def _key(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def _keys(host: str | None, held: list[Element]) -> list[int]:
    start = (host or "").encode()
    return [_key(start, e.digest) for e in held]


def _marks(rows: DataFrame, with_row: bool) -> DataFrame:
    """(key, around) of every candidate of every page (host, html), a page's equal ones once; with the page's row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for place, (host, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if host and source:
                    page = Page(source)
                    held = page.candidates()
                    own = (batch.column(2)[place].as_py(),) if with_row else ()
                    out += {(*own, k, _key(t.encode("utf-8", "replace"))) for k, t in zip(_keys(host, held), page.around(held), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2 + with_row)], names=["row", "key", "around"][not with_row :])

    return rows.mapInArrow(run, "row long, key long, around long" if with_row else "key long, around long")


def site_templates(pages: DataFrame, html: str = "html", url: str = "url", many: int = MANY) -> DataFrame:
    """(key, pages, times) of the subtrees that stand on at least `many` different pages of a host; times: on all pages."""
    marks = _marks(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")), False)
    each = marks.groupBy("key", "around").agg(F.count("*").alias("n"))  # so that a host's menu does not meet in one task
    return each.groupBy("key").agg(F.count("*").alias("pages"), F.sum("n").alias("times")).filter(F.col("pages") >= many)


def _texts(rows: DataFrame, at: tuple[int, int], drop: int, templates: Callable[[], Callable[[list[int], list[int] | None], list[bool]]], listed: int | None) -> DataFrame:
    """rows with text and n_chars; at: places of host and html; listed: place of each page's own templates; the last
    `drop` columns are left out."""
    fields = rows.schema.fields[: len(rows.columns) - drop]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates()
        for batch in pieces(batches, 128):
            own = batch.column(listed).to_pylist() if listed is not None else [None] * batch.num_rows
            out = []
            for host, source, mine in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), own, strict=True):
                page = Page(source or "")
                held = page.candidates() if host else []
                out.append(page.main_text({id(e) for e, t in zip(held, known(_keys(host, held), mine), strict=True) if t}))
            text = pa.array([t.encode("utf-8", "replace").decode() for t in out], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], text, pa.array([len(t) for t in out], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def extract(pages: DataFrame, html: str = "html", url: str = "url", many: int = MANY, most: int = BROADCAST_TEMPLATES) -> DataFrame:
    """pages with `text`, their main text, and `n_chars`, its code points.

    Pages are read twice, to count subtrees and to extract; up to `most` templates are broadcast as sorted numbers.
    With more of them each page's own templates are found by joins, and the numbered pages written once.
    """
    spark = pages.sparkSession
    pages = pages.drop("text", "n_chars") if html not in ("text", "n_chars") else pages.drop(*({"text", "n_chars"} - {html}))
    stage = Staging(spark, "html")
    found = stage.put(site_templates(pages, html, url, many), "templates")
    host_, row_, own_ = fresh(pages, "host", "row", "own")
    place = pages.columns.index(html)
    keep = pages.withColumn(host_, host_of(F.col(url)))
    if found.count() <= most:
        keys = np.sort(np.array([r[0] for r in found.select("key").collect()], np.int64))
        shared = spark.sparkContext.broadcast(keys)

        def by_number() -> Callable[[list[int], list[int] | None], list[bool]]:
            known = shared.value

            def check(wanted: list[int], _: list[int] | None) -> list[bool]:
                if not len(known) or not wanted:
                    return [False] * len(wanted)
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                return (known[at] == np.array(wanted)).tolist()

            return check

        return _texts(keep, (len(pages.columns), place), 1, by_number, None)
    numbered = stage.put(keep.withColumn(row_, F.monotonically_increasing_id()), "pages")
    total = numbered.count()
    marks = _marks(numbered.select(F.col(host_).alias("host"), F.col(html).alias("html"), F.col(row_).alias("row")), True).select("row", "key").distinct()
    hits = join_counted(marks, found.select("key", "times"), ["key"], "times", total)
    mine = hits.groupBy(F.col("row").alias(row_)).agg(F.collect_set("key").alias(own_))
    joined = numbered.join(mine.hint("shuffle_hash"), row_, "left").select(*pages.columns, host_, own_)
    return _texts(joined, (len(pages.columns), place), 2, lambda: lambda wanted, own: [k in (own or []) for k in wanted], len(pages.columns) + 1)
