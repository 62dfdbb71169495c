"""Main text of web pages by the distribution of line blocks.

Markup is stripped so that every block of a page becomes a line. A line weighs as many characters as stand outside of links; on
a page that marks its article, all of a line in the article counts and nothing outside it. The weights of so many lines in a row
are a block; where the blocks surge to a level the main text begins, where they dive to nothing it ends, and lines between are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Lines of a block, and its characters where the main text begins (fewer on pages that nowhere have so many).
WINDOW, SURGE = 3, 80

#: Elements that end a line where they begin and where they end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, and ends at their end tag alone.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements without any main text.
DROPPED = frozenset("nav aside footer form button select datalist dialog menu noscript template svg canvas object audio video search".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An element of a class or id that has one of these words holds no main text.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription social share sharing related "
    "recommended comment comments disqus respond widget toolbar pagination pager login signup paywall".split()
)
#: A name that begins so tells of something elsewhere on the page, like `with-sidebar`.
ELSEWHERE = frozenset("no has have with without is hide show".split())
#: Names of an article's own element.
ARTICLE_NAMES = frozenset("articlebody article-body article-content article-text post-content post-body entry-content story-body".split())
#: What an opening tag of a key ends first: the elements, and those that bound the search for them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "a": ({"a"}, {"td", "th", "table"})}
_ENDS |= {"dt": _ENDS["dd"], "th": _ENDS["td"]}

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_OPEN_END = re.compile(r"<[a-zA-Z/!?]")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _has_dropped_name(names: str) -> bool:
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[0] not in ELSEWHERE and not DROPPED_NAMES.isdisjoint(words):
            return True
    return False


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(text):
        out.setdefault(key.lower(), unescape(next(filter(None, values), "")))
    return out


class Lines:
    """The lines of a page as its tags come: text, characters outside of links, and the mark (2: in an article, 1: in the page's main part, 0)."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, int]] = []
        self._held: list[tuple[str, bool]] = []
        self._breaks = 0
        #: Open elements: name, whether dropped, mark, whether in a link; each has what its parent has.
        self._open: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
        self._read(page)

    def _end_line(self) -> None:
        if self._held:
            text = " ".join("".join([t for t, _ in self._held]).split())
            linked = sum(len("".join(t.split())) for t, link in self._held if link)
            if text:
                self.lines.append((text, max(0, len(text) - linked - text.count(" ")) if linked else len(text), self._open[-1][2]))
            self._held = []

    def _text(self, raw: str) -> None:
        if not self._open[-1][1]:
            self._held.append((unescape(raw) if "&" in raw else raw, self._open[-1][3]))
            if self._breaks and not raw.isspace():
                self._breaks = 0

    def _break(self) -> None:
        """A line break is white space; two in a row end the line."""
        self._breaks += 1
        if self._breaks > 1:
            self._end_line()
        else:
            self._held.append((" ", False))

    def _close(self, names: set[str], bounds: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of a name with all in it, unless one of the bounds lies between."""
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in names:
                del self._open[k:]
                return
            if self._open[k][0] in bounds:
                return

    def _start(self, name: str, text: str) -> None:
        if name in BLOCKS:
            self._end_line()
            self._close({"p"}, BLOCKS - {"p"})
        if name in _ENDS:
            self._close(*_ENDS[name])
        if name in VOID:
            return
        _, dropped, mark, link = self._open[-1]
        if not dropped:
            is_article = name == "article"
            if name in DROPPED or (name == "header" and not mark):
                dropped = True
            elif text and not text.isspace():
                has = _attributes(text)
                role, named = has.get("role", "").lower(), f"{has.get('class', '')} {has.get('id', '')}"
                is_article |= role == "article" or has.get("itemprop", "").lower() == "articlebody" or not ARTICLE_NAMES.isdisjoint(named.lower().split())
                if role == "main":
                    mark = max(mark, 1)
                if name in ("article", "main"):
                    dropped = bool({"comment", "comments"} & {w.lower() for w in _WORD.findall(named)})
                elif name not in ("html", "body") and not is_article:
                    dropped = role in DROPPED_ROLES or ((not mark or "header" not in named.lower()) and _has_dropped_name(named))
            mark = 2 if is_article else max(mark, 1) if name == "main" else mark
            if dropped and name in BLOCKS:
                self.lines.append(("", 0, 0))
        self._open.append((name, dropped, mark, link or name == "a"))

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._end_line()
        if name == "br":
            self._break()
        elif name not in VOID:
            self._close({name}, frozenset() if name in BLOCKS - {"p"} else BLOCKS - {name})

    def _read(self, page: str) -> None:
        last = page.rfind(">") + 1
        rest = _OPEN_END.search(page, last)
        end, at = rest.start() if rest else len(page), 0
        while at < end and (tag := _TAG.search(page, at, max(last, at))):
            if tag.start() > at:
                self._text(page[at : tag.start()])
            at = tag.end()
            if not tag[2]:
                continue
            name = tag[2].lower()
            if tag[1]:
                self._end(name)
            elif name == "br":
                self._break()
            elif name in RAW:
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = stop.start() if stop else len(page)
                self._start(name, "")
            else:
                self._start(name, tag[3])
                if tag[3].endswith("/") and name in ("svg", "canvas", "object"):
                    self._end(name)
        if at < end:
            self._text(page[at:end])
        self._end_line()


def _between(weights: list[int], surge: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines from a surge of the blocks to the next dive, without the lines of no weight at both ends."""
    n = len(weights)
    blocks, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += weights[i] - (weights[i + WINDOW] if i + WINDOW < n else 0)
        blocks[i] = total
    level = min(surge, max(blocks, default=0))
    i = 0
    while i < n:
        if not blocks[i]:
            i += 1
            continue
        first = i
        while i < n and blocks[i]:
            i += 1
        if max(blocks[first:i]) >= level:
            inside = [k for k in range(first, i) if weights[k]]
            if inside:
                yield inside[0], inside[-1] + 1


def main_text(page: str, surge: int = SURGE) -> list[str]:
    """The blocks of a page's main text."""
    lines = Lines(page).lines
    mark = max((m for text, _, m in lines if text), default=0)
    weights = [(len(text) if m >= mark else 0) if mark else w for text, w, m in lines]
    found = [range(a, b) for a, b in _between(weights, 1 if mark else surge)]
    return [lines[k][0] for r in found for k in r if lines[k][0] and (weights[k] or not mark)]


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_column: str = "html") -> DataFrame:
    """The columns `keep`, text and n_chars (code points) of every page: its main text, one line for each block.

    Left out are elements of navigation, headers outside of the article, footers, asides, forms, scripts and styles, and
    those whose role, class or id names such a part, a notice, an advert or readers' comments. Character references are
    decoded, white space within a block is one space; a line break is white space, two end a block. Null and empty pages and
    pages without text give an empty text. A page is one row's work, whatever other rows there are: no shuffle, and
    repeated rows, null ids, empty tables and other columns do no harm.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = pages.select(*keep)
    shape = kept.withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    schema = to_arrow_schema(shape)

    def step(batches):
        for batch in batches:
            for part in pieces(batch, len(keep), 16 << 20):
                texts = ["\n".join(main_text(html or "")) for html in part.column(len(keep)).to_pylist()]
                arrays = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return pages.select(*keep, F.col(html_column).cast("string").alias("__html")).mapInArrow(step, shape)
