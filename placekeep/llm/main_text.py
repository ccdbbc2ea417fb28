"""Main text of web pages.

Events of the standard library's streaming parser become lines, one for each
block of the page, with their text-to-tag ratio. The ratios are smoothed with a
Gaussian; a threshold of their spread divides the lines into content and
boilerplate, and the regions (articles, sections, boxes) with content lines are
selected, and so are short regions between them that aren't mostly links.
Elements marked as menus, adverts, comments and the like are left out, unless
they hold most of the text of a page without article or main element; marks of an outermost article or main element
don't count. An article or main element is one region with all it holds;
whether it is selected is up to its lines, as with any other region. A selected
region is returned whole, its short lines included.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placekeep.llm.common import map_rows

#: Elements that are never main text.
HIDDEN = frozenset("aside button canvas datalist dialog embed fieldset footer form head iframe input label menu nav noembed noframes noscript option script select style svg template textarea title video audio".split())
#: Elements without content.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are a region of their own.
REGION = frozenset("article aside body div footer form header html main nav section table td".split())
#: Words of class, id and role values that mark boilerplate.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tagcloud toolbar topbar tracking widget".split()
)
#: Words that add nothing to a compound name of marks; any other word makes it another name.
NEUTRAL = frozenset("area bar block box btn button buttons container inner item items link links list section site widget wrap wrapper".split())
_WORDS = re.compile(r"[a-z]+")
#: Lines of a region between selected ones that is selected with them, at most.
BETWEEN = 3
#: Characters given to the parser at a time.
CHUNK = 1 << 16
#: Spread of the Gaussian, in lines.
SIGMA = 1.0


def is_mark(name: str) -> bool:
    """Whether all words of a class, id or role name are marks or neutral, one at least a mark."""
    words = _WORDS.findall(name)
    return not MARKS.isdisjoint(words) and all(w in MARKS or w in NEUTRAL for w in words)


class Lines(HTMLParser):
    """Collects (text, tags, region number, characters in links) of each visible block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool, int, bool]] = []
        self.hidden, self.region, self.semantic = False, 0, False
        self.regions = 1
        #: Regions of article and main elements.
        self.main: set[int] = set()
        self.mark, self.link = 0, False
        # The marked element around each marked element; 0 is none.
        self.around = [0]
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = 0
        self.blocks: list[tuple[list[tuple[str, int, bool]], int, int]] = []

    def flush(self) -> None:
        if self.parts:
            self.blocks.append((self.parts, self.tags, self.region))
            self.parts, self.tags = [], 0

    def lines(self) -> list[tuple[str, int, int, int]]:
        size = [0] * len(self.around)
        for parts, _, _ in self.blocks:
            for data, mark, _ in parts:
                size[mark] += len(data.strip())
        total = sum(size)
        # Beside an unmarked article or main element a mark holds whatever its size.
        beside = any(r in self.main and not mark and data.strip() for parts, _, r in self.blocks for data, mark, _ in parts)
        for m in range(len(size) - 1, 0, -1):
            size[self.around[m]] += size[m] if self.around[m] else 0
        shown = [True]
        for m in range(1, len(size)):
            shown.append(shown[self.around[m]] and not beside and 2 * size[m] > total)
        out, tags = [], 0
        for parts, n, region in self.blocks:
            tags += n
            text = " ".join("".join(data for data, mark, _ in parts if shown[mark]).split())
            if text:
                out.append((text, tags, region, sum(len(data.strip()) for data, mark, link in parts if link and shown[mark])))
                tags = 0
        return out

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                self.end_implied(tag)
        elif tag == "br":
            self.parts.append((" ", self.mark, False))
        self.tags += 1
        if tag in VOID:
            return
        self.stack.append((tag, self.hidden, self.region, self.semantic, self.mark, self.link))
        marked = unseen = False
        self.link = self.link or tag == "a"
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                marked = marked or any(map(is_mark, value.lower().split()))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                unseen = True
        if tag in ("html", "body"):
            return
        if tag in ("article", "main"):
            if self.semantic:
                self.hidden = self.hidden or unseen
                self.enter(marked)
            elif unseen or not marked:
                # A marked one is no more than what is around it.
                self.hidden, self.mark = unseen, 0
            if not self.semantic and not self.hidden:
                self.semantic = True
                self.region, self.regions = self.regions, self.regions + 1
                self.main.add(self.region)
            return
        self.enter(marked)
        self.hidden = self.hidden or unseen or tag in HIDDEN or tag == "header" and not self.semantic
        if tag in REGION and not self.semantic:
            self.region, self.regions = self.regions, self.regions + 1

    def enter(self, marked: bool) -> None:
        if marked:
            self.around.append(self.mark)
            self.mark = len(self.around) - 1

    def end_implied(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if self.stack[i][0] in REGION or self.stack[i][0] in ("ul", "ol", "dl", "tbody"):
                return

    def pop_to(self, i: int) -> None:
        _, self.hidden, self.region, self.semantic, self.mark, self.link = self.stack[i]
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop_to(i)
                return
            if self.stack[i][0] in ("article", "main") and tag not in REGION:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append((data, self.mark, self.link))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def main_text(html: str | None) -> str:
    """Blocks of the selected regions, joined by newlines."""
    if not html:
        return ""
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    parser.flush()
    lines = parser.lines()
    if not lines:
        return ""
    raw = np.array([len(t) / (1 + n) for t, n, _, _ in lines], dtype=float)
    ratios = smoothed(raw)
    # A line also needs some ratio of its own, or content would lend its to the menu beside it.
    content = (ratios >= ratios.std()) & (raw >= ratios.std() / 2)
    # Where no line stands out, the one of greatest smoothed ratio decides.
    chosen = {r for (_, _, r, _), on in zip(lines, content) if on} or {lines[int(ratios.argmax())][2]}
    kept = [i for i, x in enumerate(lines) if x[2] in chosen]
    for a, b in list(zip(kept, kept[1:])):
        if b - a <= BETWEEN + 1:
            kept.extend(i for i in range(a + 1, b) if 2 * lines[i][3] <= len(lines[i][0]))
    return "\n".join(lines[i][0] for i in sorted(kept))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars (code points) for each page.

    Null and empty pages, and pages without visible text, give the empty text.
    Repeated rows give repeated results; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> list:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    kinds = dict(pages.dtypes)
    return map_rows(pages.select(id_col, url_col, html_col), run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
