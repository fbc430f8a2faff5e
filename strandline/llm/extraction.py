"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame

from strandline.llm.common import with_text_columns

# The elements of HTML by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MEDIA = frozenset("iframe svg object canvas audio video".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg object canvas audio video".split())
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu fieldset head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar sidebars aside footer masthead topbar header "
    "cookie cookies consent gdpr notice notices disclaimer popup modal overlay banner newsletter subscribe subscription signup signin login "
    "comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations widget widgets skip".split()
)
NEUTRAL_NAMES = frozenset("area bar block body bottom box button buttons center container content footer group holder inner item items left link links list main middle outer page panel right row section site slot text top unit wrap wrapper".split())
KEPT_TAGS = frozenset("html body main article".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
BARRIERS = frozenset("table ul ol dl select td th li body article section div blockquote".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


HINTED = 0.3  # what remains of the density of an element that its tag or name makes suspect
SHARE = 0.2  # of the main subtree's sum, from which a subtree beside it belongs to the text
MOST_HINTED = 0.5  # of the main subtree's sum, up to which a suspect element inside goes
NO_HINT, DOUBTFUL, BY_NAME, BY_TAG, HIDDEN = range(5)
LINKED = 0.25  # share of links from which an element of a doubtful name is what the name says
SHORT = 80  # or characters up to which it is
# Names that parts of articles bear as well.
DOUBTFUL_NAMES = frozenset("related discussion share sharing promotion replies notice notices".split())


def _is_noise_name(name: str) -> bool:
    """Whether a class or id says noise as a whole: every part of it names noise or nothing in particular, and one names noise."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in NEUTRAL_NAMES for p in parts)


def _hint(tag: str, attributes: str, in_article: bool) -> int:
    """Whether the element's tag, role or name makes it a menu, header, footer, sidebar, notice, advert, form or reader comments; or it is hidden."""
    found = BY_TAG if tag in NOISE_TAGS or tag == "header" and not in_article else NO_HINT
    if not attributes or attributes.isspace():
        return found
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        if tag in KEPT_TAGS or in_article and value.lower() in ("header", "banner"):
            continue
        if key == "role" and value.strip().lower() in NOISE_ROLES or key in ("class", "id") and any(map(_is_noise_name, value.split())):
            doubtful = in_article and key != "role" and all(x.lower() in DOUBTFUL_NAMES for x in value.split() if _is_noise_name(x))
            found = max(found, DOUBTFUL if doubtful else BY_NAME)
    return found


class _Page:
    """All elements of a page in page order, with what stands in each of them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.hint = ["#root"], [-1], [NO_HINT]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.texts: list[tuple[int, int, str]] = []  # node, number of the text block, text
        stack: list[int] = [0]
        open_: dict[str, int] = {}
        block = links = at = 0

        def text(part: str) -> None:
            if part:
                node = stack[-1]
                part = entities.unescape(part) if "&" in part else part
                self.texts.append((node, block, part))
                n = len(part.strip())
                self.chars[node] += n
                if links:
                    self.link_chars[node] += n

        def pop_to(names: tuple[str, ...]) -> None:
            nonlocal links, block
            while True:
                tag = self.tag[stack.pop()]
                open_[tag] -= 1
                links -= tag == "a"
                block += tag in BLOCKS
                if tag in names:
                    return

        def in_scope(names: tuple[str, ...]) -> bool:
            for node in reversed(stack):
                if self.tag[node] in names:
                    return True
                if self.tag[node] in BARRIERS:
                    return False
            return False

        unclosed: set[str] = set()
        while m := MARKUP.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if open_.get(tag):
                    pop_to((tag,))
                elif tag in BLOCKS or tag == "br":
                    block += 1
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/") or tag in ("script", "style"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at) if tag not in unclosed else None
                    if end is None and tag in MEDIA:  # never closed: what follows is the page
                        unclosed.add(tag)
                    else:
                        at = end.end() if end else len(source)
                continue
            if tag in VOID:
                self.tags[stack[-1]] += 1
                if tag in ("br", "hr", "img"):
                    self.texts.append((stack[-1], block, " "))
                block += tag == "hr"
                continue
            if tag in BLOCKS and open_.get("p") and in_scope(("p",)):
                pop_to(("p",))
            if tag in CLOSES and any(open_.get(x) for x in CLOSES[tag]) and (in_scope(CLOSES[tag])):
                pop_to(CLOSES[tag])
            block += tag in BLOCKS
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.hint.append(_hint(tag, attributes, bool(open_.get("article"))))
            self.chars.append(0)
            self.link_chars.append(0)
            self.tags.append(1)
            self.link_tags.append(tag == "a")
            links += tag == "a"
            stack.append(len(self.tag) - 1)
            open_[tag] = open_.get(tag, 0) + 1
        text(source[at:])
        # what stands in an element counts for all around it; doubtful names hold where density agrees
        for i in range(len(self.tag) - 1, 0, -1):
            if self.hint[i] != HIDDEN:
                for column in (self.chars, self.tags, self.link_chars, self.link_tags):
                    column[self.parent[i]] += column[i]
            if self.hint[i] == DOUBTFUL:
                self.hint[i] = BY_NAME if self.chars[i] < SHORT or self.link_chars[i] > LINKED * self.chars[i] else NO_HINT

    def densities(self) -> list[float]:
        """Composite text density of every element: characters a tag, lowered by the share of links in it and in the page.

        The logarithm's base is the inner expression of the published formula itself: its own logarithm is
        one on pages without links.
        """
        body = next((i for i, tag in enumerate(self.tag) if tag == "body"), 0)
        links = self.link_chars[body] / max(self.chars[body], 1)
        out = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
            base = math.log(c / max(c - lc, 1) * lc + links * c + math.e)
            out.append(c / t * math.log(max(c / lc * t / lt, 1.0)) / base if c else 0.0)
        return out


def _selected(page: _Page, hints: bool = True) -> list[bool]:
    """Which elements belong to the main text; without `hints` densities alone say so."""
    parent, n = page.parent, len(page.tag)
    suspect = [h if hints or h == HIDDEN else NO_HINT for h in page.hint]
    density = page.densities()
    weight = [1.0] * n
    for i in range(1, n):
        weight[i] = weight[parent[i]] * (0.0 if suspect[i] == HIDDEN else HINTED if suspect[i] else 1.0)
        density[i] *= weight[i]
    total = [0.0] * n
    for i in range(n - 1, 0, -1):
        total[parent[i]] += density[i]
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    main = max(range(body, n), key=lambda i: (total[i], -i))
    if total[main] == 0.0:
        main = body
    most = total[main]
    path = [main]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    threshold = min(density[i] for i in path)
    if hints:  # the article around it
        main = next((i for i in reversed(path) if page.tag[i] in ("article", "main")), main)
    holds = set(path)
    keep = [False] * n
    keep[main] = True
    for i in range(1, n):
        worth = max(total[i], density[i])
        if i in holds:
            keep[i] = keep[i] or keep[parent[i]]
        elif keep[parent[i]]:
            keep[i] = suspect[i] not in (BY_TAG, HIDDEN) and (suspect[i] != BY_NAME or worth >= MOST_HINTED * most)
        elif parent[i] in holds and not suspect[i]:
            # beside the way to the body: as dense as the sparsest step of that way, and no small part
            keep[i] = density[i] >= threshold > 0 and worth >= SHARE * most
    return keep


def main_text(source: str | None, hints: bool = True) -> str:
    """The main text of one page: blocks in page order, white space inside each and between them one space."""
    if not source:
        return ""
    page = _Page(source)
    keep = _selected(page, hints)
    blocks: dict[int, list[str]] = {}
    for node, block, part in page.texts:
        if keep[node]:
            blocks.setdefault(block, []).append(part)
    cleaned = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(x for x in cleaned if x)


def _extract():
    def compute(pages: list[str]) -> dict[str, list]:
        texts = [main_text(page) for page in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return compute


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    For every element the density is characters per tag, lowered by links; an element's sum is that of its
    children's densities. The subtree with the largest sum is the main text (with the `article` or `main`
    around it), and so is what stands beside its way to the body, is as dense as the sparsest step of that way
    and has a fifth of its sum. Tags, roles and whole names of menus, headers, footers, sidebars, notices,
    adverts, forms and comments are hints: they lower densities, and inside the main text what they name
    goes, unless the main text lies in it or, for names, it holds half of the sum. Names that parts of articles bear
    as well, as "related" or "discussion", count there only for elements that are short or full of links. Hidden elements go. Null, empty and text-free pages give the empty text. Pages are independent rows: repeated ones
    give repeated rows, an empty table none; extra columns are not read.
    """
    return with_text_columns(pages.select("page_id", "url", "html"), _extract, "text string, n_chars long")
