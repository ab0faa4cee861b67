"""The main text of web pages by line-block distribution.

Markup is stripped and the page becomes lines: every block element starts a
new one, an empty line stands where a section begins or ends, and WINDOW of
them where a part of the page's frame (navigation, forms and the like) was
taken out.  The text lengths of each window of WINDOW lines are summed, with
characters in article and main counted ARTICLE times and links elsewhere not
at all.  A surge is where the sums first reach the peak a main text has, a dive
where they last do; a page that never reaches it has its highest sum for a peak.
Between the two all is kept but blocks of links.  Before the surge and after the
dive what is marked as prose (headings, paragraphs, items, whole sentences)
is kept as well; on pages with an article, only what lies in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Lines in a window.
WINDOW = 3
#: Characters that a window of main text has at its peak.
PEAK = 80
#: Part of a block that may be link text.
LINKS = 0.5
#: Times that a character in article or main counts.
ARTICLE = 16

# Elements by their role in HTML.
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "select", "title", "xmp", "noembed", "noframes"}
_FRAME = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "fieldset", "label"}
_MAIN = {"article", "main"}
_SECTION = {"html", "head", "body", "section", "div", "table", "article", "main"}
_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "address", "hr", "br", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "details", "summary", "center", "hgroup", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = _HEADING | {"p", "li", "dt", "dd", "pre", "blockquote", "figcaption", "address", "td", "th", "caption"}
_ENDS = tuple(".!?…:;。！？\"»”)")
# Start tags that imply an end tag, and what such an end does not reach beyond.
_CLOSED_BY = {"p": (_BLOCK | _SECTION | _FRAME) - {"br", "button", "label", "option"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_HOLD = (_SECTION | _FRAME | {"ul", "ol", "dl", "blockquote", "td", "th", "figure", "details"}) - {"button", "label"}
# Names of frame parts, and words that may stand beside them in a name.
_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad advert advertisement adbox banner sponsor sponsored promo cookie notice alert popup modal newsletter subscribe consent "
    "signup login search share social related recommended breadcrumb pagination comment disqus respond complementary contentinfo copyright widget toolbar".split()
)
_BESIDE = frozenset("site page top bottom left right main primary secondary global sticky mobile desktop google box bar list link button section area block unit slot container wrapper wrap inner form".split())
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*?)(?:>|\Z)""", re.S)


def _frame_name(name: str) -> str:
    """What part of the frame a class, id or role names as a whole: header, frame, or nothing (has-sidebar and entry-header name none)."""
    parts = [x for x in re.split(r"[-_]", name.lower()) if x and not x.isdigit()]
    known = [x for x in parts if x in _NAMES or x[-1:] == "s" and x[:-1] in _NAMES]
    if not known or not all(x in known or x in _BESIDE or x[-1:] == "s" and x[:-1] in _BESIDE for x in parts):
        return ""
    return "header" if set(known) == {"header"} else "frame"


def _named(attributes: str) -> str:
    found = {_frame_name(x) for a, *values in _ATTRIBUTE.findall(attributes) if a.lower() in ("class", "id", "role") for x in "".join(values).split()}
    return "frame" if "frame" in found else "header" if "header" in found else ""


class _Element:
    __slots__ = ("name", "frame", "framed", "holds_main")

    def __init__(self, name: str, frame: str) -> None:
        self.name, self.frame, self.framed, self.holds_main = name, frame, False, False


def _parsed(page: str) -> list[tuple[str, str | _Element]]:
    """Text, and where elements open and close; end tags that HTML implies are put in."""
    out: list[tuple[str, str | _Element]] = []
    open_: list[_Element] = []
    n_open: dict[str, int] = {}  # spares the search for what is not open

    def close(k: int) -> None:
        while len(open_) > k:
            out.append(("close", x := open_.pop()))
            n_open[x.name] -= 1

    at = 0
    while True:
        m = _TAG.search(page, at)
        if text := page[at : m.start() if m else len(page)]:
            out.append(("text", text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if name in _RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        outer = name in _SECTION or name in _FRAME
        if closing:
            for k in range(len(open_) - 1, -1, -1) if n_open.get(name) else ():
                if open_[k].name == name:
                    close(k)
                    break
                # An end tag of a small element does not end a section, nor one of an inline element a block.
                if not outer and (open_[k].name in _SECTION or open_[k].name in _FRAME or name not in _BLOCK and open_[k].name in _BLOCK):
                    break
            else:
                if name in _BLOCK:
                    out.append(("break", name))
            continue
        if name in _VOID or m[3].endswith("/"):
            if name in _BLOCK:
                out.append(("break", name))
            continue
        for k in range(len(open_) - 1, -1, -1) if any(n_open.get(n) and name in by for n, by in _CLOSED_BY.items()) else ():
            n = open_[k].name
            if name in _CLOSED_BY.get(n, ()):
                close(k)
            elif n in _HOLD:
                break
        frame = "header" if name == "header" else "frame" if name in _FRAME else ""
        if name not in ("html", "body", *_MAIN) and name not in _HEADING and frame != "frame":
            frame = max(frame, _named(m[3]), key=("", "header", "frame").index)
        new = _Element(name, frame)
        if name in _MAIN:
            for x in reversed(open_):
                if x.holds_main:
                    break
                x.holds_main = True
        open_.append(new)
        n_open[name] = n_open.get(name, 0) + 1
        out.append(("open", new))
    close(0)
    return out


class _Line:
    __slots__ = ("text", "linked", "main", "heading", "prose")

    def __init__(self, text: str = "", linked: int = 0, main: bool = False, heading: bool = False, prose: bool = False) -> None:
        self.text, self.linked, self.main, self.heading, self.prose = text, linked, main, heading, prose


def _lines(page: str) -> list[_Line]:
    lines: list[_Line] = []
    parts: list[str] = []
    linked = frame = main = links = heading = prose = 0

    def end_line(empty: int = 0) -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            lines.append(_Line(text, linked, main > 0, heading > 0, prose > 0 or text.endswith(_ENDS)))
        parts.clear()
        linked = 0
        have = 0
        while lines and have < empty and not lines[-1 - have].text:
            have += 1
        if lines:
            lines.extend(_Line() for _ in range(empty - have))

    for kind, x in _parsed(page):
        if kind == "text":
            if not frame:
                text = html.unescape(x)
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        if kind == "break":
            end_line()
            continue
        step, name = (1 if kind == "open" else -1), x.name
        if kind == "open":
            # What the page calls a header is one of the article within it.
            x.framed = not x.holds_main and (x.frame == "frame" or x.frame == "header" and not main)
        framed = x.framed
        if framed:
            end_line(WINDOW)
        elif name in _SECTION or name in _FRAME:
            end_line(1)
        elif name in _BLOCK:
            end_line()
        frame += step * framed
        main += step * (name in _MAIN)
        links += step * (name == "a")
        heading += step * (name in _HEADING)
        prose += step * (name in _PROSE)
    end_line()
    return lines


def window_sums(weights: list[int]) -> list[int]:
    """Of each line the weights of the window that begins at it."""
    return [sum(weights[k : k + WINDOW]) for k in range(len(weights))]


def surge_and_dive(weights: list[int]) -> tuple[int, int, int]:
    """The peak that the sums reach, and the lines where they first and last do; the surge is behind the dive where there is no text."""
    n, sums = len(weights), window_sums(weights)
    peak = min(PEAK, max(sums, default=0))
    high = [k for k in range(n) if peak and sums[k] >= peak]
    if not high:
        return peak, n, -1
    # The last high window counts as far as it needs to reach the peak.
    return peak, high[0], next(j for j in range(high[-1], n) if sum(weights[high[-1] : j + 1]) >= peak)


def main_text(page: str | None) -> str:
    """The main text of one page; empty if it has none."""
    lines = _lines(page or "")
    n = len(lines)
    marked = any(x.main for x in lines)
    linking = [False] * n  # lines of blocks that are links for the most part
    k = 0
    while k < n:
        end = k
        while end < n and lines[end].text:
            end += 1
        block = lines[k:end]
        if sum(x.linked for x in block if not x.main) > LINKS * sum(len(x.text) for x in block):
            linking[k:end] = [not (x.main or x.heading) for x in block]
        k = max(end, k + 1)
    weights = [len(x.text) * ARTICLE if x.main else 0 if out else max(0, len(x.text) - x.linked) for x, out in zip(lines, linking, strict=True)]
    peak, surge, dive = surge_and_dive(weights)
    kept = lambda k, x: surge <= k <= dive or x.heading or x.prose and not x.linked * 2 > len(x.text)
    return " ".join(x.text for k, x in enumerate(lines) if x.text and not linking[k] and (x.main or not marked or weights[k] >= peak) and kept(k, x))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    A null page counts as empty; a page without main text has the empty text.
    Null ids and repeated rows are rows of their own; other columns are
    ignored.  No shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), whole(F.col(html_col)).alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
