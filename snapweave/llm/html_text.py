"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams its events into lines: a line is the text between two tags of
block elements, with the number of tags it took. A line's ratio is its characters by its tags;
lines inside elements that are boilerplate by their tag or their class, id or role (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) have ratio 0. A class or
id is a cue as a whole name (``related-posts``, not ``related-work``); ids of headings, paragraphs and
sections, which generators make from headings, only if they name a page part for certain. Doubtful
cues (forms, headers of articles, a class that only starts or ends with a cue word, topic words) hold
unless the element has a line of prose in the content cluster of the article. No cue holds for an element with
nearly all of the page's content (computed as if there were no cues) if no prose of an article is outside of
it; a main role and the common classes of articles count as the element. The ratios are smoothed with a Gaussian and clustered by a threshold, their standard deviation; lines at
or above it are content. The content lines select the region of the page: the article or main
elements if they hold most of the content's characters (main if it holds more than its articles do),
else the smallest container that holds all of them; a headline outside belongs to it. The text is every line
of that region that is not boilerplate, short ones included, so that the threshold places the
article and does not thin it out.

Defined cases: null html counts as empty and gives the empty text; a page without markup is one
line; unclosed and stray tags are tolerated; character references are decoded; null ids and URLs pass
through; repeated rows are extracted one by one; an empty table gives no rows; other columns do not
matter. A page is held in memory by one task at a time; time and memory are linear in its size, however deep
its elements are.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose tags are part of a line; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q "
                   "ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr "
                   "math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle "
                   "merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts "
                   "mprescripts mtable mtr mtd mlabeledtr maction".split())
#: A formula's source beside the formula, never shown.
UNSEEN = frozenset(("annotation", "annotation-xml"))
#: Never article text, whatever they hold.
HARD = frozenset("script style noscript template head title nav footer aside button select textarea iframe svg "
                 "canvas object audio video menu dialog datalist".split())
CONTENT = frozenset(("article", "main"))
NEVER = frozenset(("html", "body", *CONTENT))
CONTAINERS = frozenset("html body main article section div td center fieldset table tbody tr".split())
CUES = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo "
                 "promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
                 "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
                 "subscription signup share sharing social related recommended widget toolbar login search "
                 "copyright pagination pager disclaimer".split())
COMMENTS = frozenset("comment comments disqus respond reply replies discussion".split())
#: Words that name a place or a part; beside a cue word they leave it a whole cue name.
PLACES = frozenset("site page top bottom left right main primary secondary global local mobile desktop box bar block "
                   "container wrapper wrap area list lists link links button buttons icon icons inner outer form item "
                   "items post posts article articles story stories content section panel text title heading message "
                   "media card this us cta module unit slot row col column group inline sticky floating thread feed "
                   "author body meta".split())
#: Cue words that are also topics: an id of one alone is in doubt, the last ones a class as well.
TOPICS = frozenset("advertising advertisement advertisements promotion sponsor banner navigation cookie cookies consent "
                   "gdpr alert newsletter subscribe subscription login search social related share sharing recommended "
                   "copyright toolbar notice notices disclaimer discussion respond reply replies comment".split())
DOUBT = frozenset("notice notices alert disclaimer discussion respond".split())
#: Ids that say for certain what a section is.
SURE = frozenset("comments disqus_thread related-posts related-articles related-stories related-content related-links "
                 "cookie-notice cookie-banner cookie-consent share-buttons social-links social-share sidebar footer "
                 "navbar breadcrumbs newsletter-signup".split())
#: Prefixes that page software gives its names.
VENDORS = frozenset("jp wp fb js".split())
#: Classes that say an element is the article, as the element does.
ARTICLES = frozenset("hentry h-entry entry-content post-body".split())
BLOCKS = frozenset("div section td center fieldset table tbody tr ul ol dl aside article form".split())
NO, DOUBTFUL, SOFT, CUE, HIDDEN = range(5)
#: Least characters of a line that answers for a doubtful element, and how many times more of them than
#: of other content make such elements the page's text.
PROSE, OUTWEIGH = 40, 3
#: Share of the content's characters that elements must hold to be the page's text, or to be no boilerplate
#: whatever their names say.
MOST, NEARLY = 0.9, 0.95
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An element of these bounds what a start tag closes implicitly.
SCOPES = frozenset("html body div article main section ul ol dl table td th aside nav form blockquote".split())
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
                           "main nav ol p pre section table ul".split())
RADIUS, SIGMA = 2, 1.0


def compound(word: str) -> list[str]:
    """A name's part as its two words, where it is a cue word and a place run together."""
    if word not in CUES | COMMENTS | PLACES:
        for i in range(2, len(word)):
            if word[:i] in CUES | COMMENTS and word[i:] in PLACES:
                return [word[:i], word[i:]]
    return [word]


def cue(name: str, tag: str, is_id: bool, section: bool) -> int:
    """What a class or id says of its element."""
    if is_id and section:
        return CUE if name.lower() in SURE else NO
    if is_id and tag not in BLOCKS:
        return NO
    parts = [q for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p for q in compound(p.lower())]
    if len(parts) > 1 and parts[0] in VENDORS:
        del parts[0]
    if not parts or not {"has", "with", "no"}.isdisjoint(parts):
        return NO
    ends = {parts[0], parts[-1]}
    words = {p for p in parts if not p.isdigit()}
    comments = bool(ends & COMMENTS) and tag not in ("html", "body", "main")
    if not comments and (tag in NEVER or not ends & CUES):
        return NO
    if not words <= CUES | COMMENTS | PLACES:
        # An article is no container of its page's parts.
        return DOUBTFUL if tag in BLOCKS and tag != "article" and not is_id else NO
    if words <= DOUBT or is_id and len(parts) == 1 and words <= TOPICS:
        return NO if tag == "article" or tag not in BLOCKS else DOUBTFUL
    return HIDDEN if comments else CUE


def boilerplate(tag: str, attrs: list, in_article: bool) -> tuple[int, bool]:
    """``NO``; ``DOUBTFUL``: unless it holds prose of the article; ``SOFT``: unless it holds an article;
    ``CUE``: an article in it is in doubt; ``HIDDEN``: whatever it holds. And whether a class, id or role
    alone says so."""
    if tag in HARD:
        return HIDDEN, False
    level = {"header": DOUBTFUL if in_article else SOFT, "form": DOUBTFUL}.get(tag, NO)
    names: list[tuple[str, bool]] = []
    by_name = NO
    for k, v in attrs:
        v = v or ""
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
            return HIDDEN, False
        if k == "role" and v in ROLES:
            by_name = CUE
        if k in ("class", "id"):
            names += [(n, k == "id") for n in v.split()]
    # Document generators mark sections by the element or by a class.
    section = tag == "section" or any(not i and re.fullmatch(r"section|level[1-6]|sect[1-6]", n) for n, i in names)
    by_name = max([by_name, *[cue(n, tag, i, section) for n, i in names]])
    return max(level, by_name), by_name > max(level, DOUBTFUL)


class Line:
    """A line's text, its tags, and the element it is in; once the page is read, whether it is off and
    its chain of doubtful elements."""

    __slots__ = ("text", "tags", "element", "skip", "doubts")

    def __init__(self, text, tags, element):
        self.text, self.tags, self.element, self.skip, self.doubts = text, tags, element, False, 0


class Page(HTMLParser):
    """The lines of a page and its elements, which have numbers: a parent's is less than its child's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kinds, self.parents, self.levels, self.named, self.tags_of = ["html"], [0], [NO], [False], ["html"]
        self.open = [0]
        self.places = {"html": [0]}  # where in ``open`` the elements of a tag are
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.open[-1]))
            self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in ("html", "body") and self.places.get(tag) or tag in VOID:
            return
        self.close_implied(tag)
        kind = tag
        for k, v in attrs:
            if k == "role" and v == "main":
                kind = "main"
            elif k == "class" and kind not in CONTENT and not ARTICLES.isdisjoint((v or "").lower().split()):
                kind = "article"
        inside = tag == "header" and any(self.places.get(k) for k in CONTENT)
        level, named = boilerplate(tag, attrs, inside)
        if kind != tag and named:
            level, named = NO, False
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.kinds))
        self.parents.append(self.open[-2])
        for values, value in ((self.kinds, kind), (self.levels, level), (self.named, named), (self.tags_of, tag)):
            values.append(value)

    def close(self, at: int | None = None):
        """Closes the elements from place ``at`` on; without one, ends the page."""
        if at is None:
            super().close()
            return
        for n in self.open[at:]:
            self.places[self.tags_of[n]].pop()
        del self.open[at:]

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close_implied(self, tag):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS_CLOSE_P else set())
        if ends and (at := self.last(ends)) > 0 and at >= self.last(SCOPES):
            self.close(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if (at := self.last((tag,))) > 0:
            self.close(at)

    def handle_data(self, data):
        if self.tags_of[self.open[-1]] not in UNSEEN:
            self.parts.append(data)

    # --- the page once it is read ---

    def tops(self, kind: str) -> list[int]:
        """For each element the outermost one of ``kind`` that it is or is in, -1 if none."""
        out = []
        for n, (k, up) in enumerate(zip(self.kinds, self.parents)):
            above = out[up] if n else -1
            out.append(above if above >= 0 else n if k == kind else -1)
        return out

    def within(self, marked) -> list[bool]:
        out = []
        for n, up in enumerate(self.parents):
            out.append(n in marked or n > 0 and out[up])
        return out

    def sums(self, weights: dict[int, int] | list[int]) -> list[int]:
        """The weight of each element with all that is in it."""
        total = [0] * len(self.kinds)
        for n, w in weights.items():
            total[n] += w
        for n in range(len(total) - 1, 0, -1):
            total[self.parents[n]] += total[n]
        return total

    def weighed(self, lines) -> list[int]:
        weights: dict[int, int] = {}
        for x in lines:
            weights[x.element] = weights.get(x.element, 0) + len(x.text)
        return self.sums(weights)

    def judge(self, void: set[int]) -> None:
        """Sets what lines are off or in doubt; cues of the elements of ``void`` do not count."""
        # Chains of doubtful elements, and the same without forms: an article in a form is not in doubt.
        self.doubtful, self.next = [0], [0]
        state = [(NO, 0, 0)]
        for n in range(1, len(self.kinds)):
            above, doubts, formless = state[self.parents[n]]
            kind, level = self.kinds[n], NO if n in void else self.levels[n]
            if kind == "main" and above < HIDDEN:
                above, doubts, formless = NO, 0, 0
            elif kind == "article" and above < HIDDEN:
                doubts = formless
                if above == CUE:
                    doubts = formless = self.chain(n, formless)
                above = NO
            if level == DOUBTFUL:
                level = NO
                same = doubts == formless
                doubts = self.chain(n, doubts)
                if kind != "form":
                    formless = doubts if same else self.chain(n, formless)
            state.append((max(level, above), doubts, formless))
        for x in self.lines:
            level, x.doubts, _ = state[x.element]
            x.skip = level > DOUBTFUL

    def chain(self, n: int, rest: int) -> int:
        self.doubtful.append(n)
        self.next.append(rest)
        return len(self.next) - 1

    def voided(self) -> set[int]:
        """Elements whose cue is void: as long as no line of an article is seen, the outermost one with
        most content, if what is seen is next to nothing beside it (comments: if nothing is seen)."""
        cues = [n for n, c in enumerate(self.named) if c]
        void: set[int] = set()
        if not cues:
            return void
        self.judge(set(cues))
        if all(x.skip for x in self.lines):
            return void
        # The content that the page would have if it had no cues.
        content = self.weighed([self.lines[i] for i in content_lines(self.lines, True)])
        marked = [max(m, a) for m, a in zip(self.tops("main"), self.tops("article"))]
        while True:
            self.judge(void)
            seen = [x for x in self.lines if not x.skip]
            if any(marked[x.element] >= 0 for x in seen):
                return void
            hidden = self.within(set(cues) - void)
            outer = [n for n in cues if n not in void and not hidden[self.parents[n]]]
            best = max(outer, key=lambda n: (self.levels[n] != HIDDEN, content[n], -n), default=0)
            shown = sum(len(x.text) for x in seen if len(x.text) >= PROSE)
            if not best or not content[best] or shown > (1 - NEARLY) * content[best] or shown and self.levels[best] == HIDDEN:
                return void
            void.add(best)


def smoothed(ratios: list[float]) -> list[float]:
    kernel = [math.exp(-i * i / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]
    total = sum(kernel)
    n = len(ratios)
    return [sum(k * ratios[i + j] for j, k in zip(range(-RADIUS, RADIUS + 1), kernel) if 0 <= i + j < n) / total
            for i in range(n)]


def content_lines(lines: list[Line], doubtful: bool) -> list[int]:
    """The numbers of the lines whose smoothed ratio reaches the threshold."""
    off = [x.skip or x.doubts > 0 and not doubtful for x in lines]
    smooth = smoothed([0.0 if o else len(x.text) / max(1, x.tags) for x, o in zip(lines, off)])
    mean = sum(smooth) / len(smooth)
    limit = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    found = [i for i, s in enumerate(smooth) if s >= limit and not off[i]]
    return found or [i for i, o in enumerate(off) if not o]


def region(page: Page, content: list[int]) -> list[bool]:
    """Whether the lines of each element are the text's."""
    lines, kinds, parents = page.lines, page.kinds, page.parents
    chosen = [lines[i] for i in content]
    top = {kind: page.tops(kind) for kind in ("main", "article", "h1")}
    tops = {kind: {n for x in chosen if (n := top[kind][x.element]) >= 0} for kind in CONTENT}
    mass = sum(len(x.text) for x in chosen)
    holds = {kind: sum(len(x.text) for x in chosen if top[kind][x.element] >= 0) >= MOST * mass for kind in CONTENT}
    heads = [x for x in lines if top["h1"][x.element] >= 0 and not x.skip]  # a headline above the text belongs to it
    marked: set[int] = set()
    if holds["main"] and not tops["main"] <= tops["article"]:
        marked = tops["main"]
    elif holds["article"]:
        # Articles side by side are one text, also those too short for a content line.
        above = {parents[n] for n in tops["article"]}
        filled = page.weighed(lines)
        marked = tops["article"] | {n for n, k in enumerate(kinds) if k == "article" and parents[n] in above and filled[n]}
    if marked:
        inside = page.within(marked)
        if not any(inside[x.element] for x in heads):
            inside = page.within(marked | {top["h1"][x.element] for x in heads if not x.doubts})
        return inside
    # The smallest container of all of them.
    held = page.sums({x.element: 1 for x in (*chosen, *heads)})
    n = max(n for n, c in enumerate(held) if c == held[0])
    while kinds[n] not in CONTAINERS:
        n = parents[n]
    return page.within({n})


def main_text(html: str) -> str:
    page = Page()
    page.feed(html)
    page.close()
    page.end_line()
    lines = page.lines
    page.judge(page.voided())
    if not any(not x.skip for x in lines):
        return ""
    # Places of the article by what is not in doubt, unless nearly all prose is in doubt.
    content, wide = content_lines(lines, False), content_lines(lines, True)
    prose = [i for i in wide if lines[i].doubts and len(lines[i].text) >= PROSE]
    if sum(len(lines[i].text) for i in prose) > OUTWEIGH * sum(len(lines[i].text) for i in content):
        content = wide
    if not content:
        return ""
    inside = region(page, content)
    marked, title = [max(m, a) for m, a in zip(page.tops("main"), page.tops("article"))], page.tops("h1")
    heads = [i for i, x in enumerate(lines) if title[x.element] >= 0 and marked[x.element] >= 0]
    # Doubtful elements that hold prose or the headline of the text, and with them whole chains.
    kept, seen = set(), {0}
    for i in (*prose, *heads):
        link = lines[i].doubts if inside[lines[i].element] else 0
        while link not in seen:
            seen.add(link)
            kept.add(page.doubtful[link])
            link = page.next[link]
    fine = [True]
    for n, rest in zip(page.doubtful[1:], page.next[1:]):
        fine.append(n in kept and fine[rest])
    return " ".join(x.text for x in lines if not x.skip and fine[x.doubts] and inside[x.element])


def extract_batch(batch) -> dict:
    texts = [main_text(h) for h in batch.column(2).to_pylist()]
    return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars``."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        text_or_empty(html_col).alias("html"))
    return map_batches(rows, extract_batch, f"id {kind}, url string, text string, n_chars bigint")


def query(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
