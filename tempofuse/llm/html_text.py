"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering (operator 3).

The standard parser's events are turned into lines of text (a line ends where a block begins or ends). Each line has a
ratio of its own text, links not counted, to the tags met since the line before. What elements and names say of a line
is evidence that lowers its ratio. Ratios are smoothed along the page with a Gaussian and parted into two clusters at
the threshold that keeps both tightest. The region of content is the smallest part of the page that holds most of the
high cluster's text; its lines are the text, but for those that evidence speaks against.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Lines on either side that the smoothing weighs with the Gaussian.
SIGMA = 1.5
#: Share of a line in links beyond which it is a menu, if its smoothed ratio is low or evidence speaks against it.
LINK_SHARE = 0.6
#: Share of the high cluster's text that the region holds at least.
HELD = 0.8
#: Share of the page's text, links not counted, that elements of page furniture may take before they count as not closed.
FURNITURE_SHARE = 0.8
#: What a ratio is multiplied with: not of the article; perhaps not of it; nothing known.
NEVER, DOUBT, CLEAR = 0.0, 0.3, 1.0

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without text for readers.
_SILENT = frozenset("script style noscript template head title button select option textarea iframe object svg canvas video audio dialog".split())
#: Elements of page furniture, and of them those that an article may have as a part of it.
_FURNITURE = frozenset("nav footer aside form menu header".split())
_OWN = frozenset(("header",))
_MAIN = frozenset(("article", "main"))
#: Class, id or role names, whole, of parts that are not the article.
_NEVER = frozenset(
    (
        "ad ads ad-slot ad-container ad-wrapper adsbygoogle advert adverts advertisement advertising banner-ad sponsored sponsor promo promotion "
        "comments comment-list commentlist comment-section comments-area comment-form reader-comments disqus disqus_thread respond "
        "sidebar side-bar site-sidebar cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr newsletter newsletter-signup subscribe signup "
        "breadcrumb breadcrumbs menu navbar nav navigation main-menu site-nav pagination pager skip-link toolbar modal popup overlay notice notification "
        "share-buttons sharing social social-share share-links related-posts related-articles related-links footer site-footer page-footer contentinfo complementary search-form login"
    ).split()
)
#: Of these, names that parts of an article have too: a story's promotion, a restaurant's menu, a picture's caption. In an
#: article they are evidence only.
_OFTEN_OWN = frozenset("promo promotion menu overlay social sharing toolbar consent respond".split())
#: Words within such names that are evidence only.
_DOUBTED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|comments?|cookies?|discussion|footer|header|login|masthead|menu|nav|newsletter|popup|promo\w*|recommended|related|replies|search|share|sidebar|social|sponsor\w*|teaser|toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)
_PARAGRAPH_ENDS = _BLOCK - {"body", "html", "head"}
#: A start tag that ends an open element of the same family, and what such an element cannot reach out of.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Line:
    __slots__ = ("factor", "furniture", "heading", "linked", "main", "part", "tags", "text")

    def __init__(self):
        self.text: list[str] = []
        self.tags = self.linked = self.main = self.part = 0
        self.factor, self.furniture, self.heading = CLEAR, False, False


class _Reader(HTMLParser):
    """Lines of text in page order. Each event takes time that does not depend on how many elements are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: of each open element: tag, silent, factor of it and all around it, inside furniture, outermost article, part
        self.open: list[tuple[str, bool, float, bool, int, int]] = []
        self.at: dict[str, list[int]] = {}  # places in open, by tag
        self.silent = self.links = 0
        self.unclosed = False  # whether some furniture has no end tag
        self.parents = [0]  # the part that each part is in; part 0 is the page
        self.now = Line()
        self.lines: list[Line] = []

    def _break(self) -> None:
        if any(x.strip() for x in self.now.text):
            self.lines.append(self.now)
            self.now = Line()
        else:  # tags between lines weigh on the next
            self.now.text = []
        if self.open:
            tag, _, self.now.factor, self.now.furniture, self.now.main, self.now.part = self.open[-1]
            self.now.heading = tag == "h1"
        else:
            self.now.factor, self.now.furniture, self.now.main, self.now.part, self.now.heading = CLEAR, False, 0, 0, False

    def _pop(self, k: int, ended: bool = False) -> None:
        """Close the elements from place k on; the one at k has its own end tag, or not."""
        while len(self.open) > k:
            tag, silent, *_ = self.open.pop()
            self.unclosed |= tag in _FURNITURE and not (ended and len(self.open) == k)
            self.at[tag].pop()
            self.silent -= silent
            self.links -= tag == "a"

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, or -1."""
        k = -1
        for t in tags:
            if (at := self.at.get(t)) and at[-1] > k:
                k = at[-1]
        return k

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._break()
            if tag in _PARAGRAPH_ENDS and (k := self._last(("p",))) >= 0:
                self._pop(k)
            elif tag in _SIBLINGS and (k := self._last(_SIBLINGS[tag])) > self._last(_BARRIERS[tag]):
                self._pop(k)
            if tag in _MAIN and (k := min((self.at[t][0] for t in ("nav", "aside", "footer", "form", "menu") if self.at.get(t)), default=-1)) >= 0:
                self._pop(k)  # no page has its article inside these: they were not closed
        if tag == "br":
            self.now.text.append(" ")
        self.now.tags += 1
        if tag in _VOID:
            return
        _, _, factor, furniture, main, part = self.open[-1] if self.open else ("", False, CLEAR, False, 0, 0)
        silent = tag in _SILENT
        said = dict(attrs) if attrs else {}
        if said and ("hidden" in said or said.get("aria-hidden") == "true" or "display:none" in (said.get("style") or "").replace(" ", "").lower()):
            silent = True
        if tag in _FURNITURE and not (main and tag in _OWN):
            factor, furniture = NEVER, True
        elif said and tag not in ("html", "body", "main", "article", "h1"):
            names = " ".join(said.get(k) or "" for k in ("class", "id", "role")).lower()
            if names.strip():
                found = _NEVER.intersection(names.split())
                if found - _OFTEN_OWN or (found and not main):
                    factor = NEVER
                elif found or _DOUBTED.search(names):
                    factor = min(factor, DOUBT)
        if tag in _BLOCK and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd"):
            self.parents.append(part)
            part = len(self.parents) - 1
        if not main and (tag in _MAIN or said.get("role") in ("main", "article")):
            main = part or len(self.parents)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, silent, factor, furniture, main, part))
        self.silent += silent
        self.links += tag == "a"
        if tag in _BLOCK:
            self._break()

    def handle_endtag(self, tag):
        self.now.tags += 1
        if tag in _BLOCK:
            self._break()
        k = self._last((tag,))
        if k >= 0:
            self._pop(k, True)
        if tag in _BLOCK:
            self._break()

    def handle_data(self, data):
        if self.silent:
            return
        if not self.now.text and self.open and (inner := self.open[-1])[2] < self.now.factor:
            self.now.factor = inner[2] if data.strip() else self.now.factor  # a line that begins in an inline element of a name
        self.now.text.append(data)
        if self.links:
            self.now.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Weighted by a Gaussian of the distance in lines; at the edges by what there is."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """Boundary between the two clusters of x that are tightest about their means."""
    s = np.sort(x)
    if len(s) < 2 or s[0] == s[-1]:
        return float(s[0]) if len(s) else 0.0
    n, run, square = np.arange(1, len(s)), np.cumsum(s), np.cumsum(s * s)
    within = (square[:-1] - run[:-1] ** 2 / n) + (square[-1] - square[:-1] - (run[-1] - run[:-1]) ** 2 / (len(s) - n))
    k = int(np.argmin(within))
    return float((s[k] + s[k + 1]) / 2)


def _region(weight: np.ndarray, part: np.ndarray, parents: list[int]) -> np.ndarray:
    """Of each part, whether it is in the smallest part that holds at least HELD of the weight of all lines."""
    held = np.bincount(part, weights=weight, minlength=len(parents))
    for p in range(len(parents) - 1, 0, -1):  # a part comes after the one that it is in
        held[parents[p]] += held[p]
    root = 0
    for p in range(1, len(parents)):  # at most one part in another holds so much
        if parents[p] == root and held[p] >= HELD * held[0]:
            root = p
    inside = np.zeros(len(parents), dtype=bool)
    inside[root] = True
    for p in range(root + 1, len(parents)):
        inside[p] = inside[parents[p]]
    return inside


def extract(html: str) -> str:
    """The article's lines, joined by line breaks; empty if there are none.

    Elements that are not closed end where the next of their kind, or an article, begins. Where almost all text of a
    page is within page furniture that is not closed, such as a menu without an end, that evidence is given up. The region
    grows to the outermost article or main element around it, and to the page's first heading before it. Within the
    region a line goes only if evidence speaks against it for certain, or perhaps and its smoothed ratio is low, or if
    its ratio is low and it is mostly links outside any article.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._break()
    reader._pop(0)
    lines = [(" ".join("".join(b.text).split()), b) for b in reader.lines]
    if not lines:
        return ""
    size = np.array([len(t) for t, _ in lines])
    linked = np.minimum([b.linked for _, b in lines], size)
    own = size - linked
    factor = np.array([b.factor for _, b in lines])
    furniture = np.array([b.furniture for _, b in lines])
    if reader.unclosed and own[furniture].sum() > FURNITURE_SHARE * own.sum():
        factor[furniture] = np.where([b.heading for _, b in lines], CLEAR, DOUBT)[furniture]
    level = smooth(np.log1p(factor * own / np.maximum([b.tags for _, b in lines], 1)))
    high = (level >= threshold(level)) & (factor > NEVER)
    if not high.any():
        high = factor > NEVER
    part = np.array([b.part for _, b in lines])
    main = np.array([b.main for _, b in lines])
    inside = _region((own * high).astype(float), part, reader.parents)[part]
    mains = np.unique(main[inside & high & (main > 0)])
    if len(mains):  # the region grows to the articles that it is in or holds
        within = np.isin(main, mains)
        inside = (inside & ~(main == 0)) | within if own[high & within].sum() >= HELD * own[high].sum() else inside | within
    elif inside.any():
        heads = np.flatnonzero(np.array([b.heading for _, b in lines]) & (factor > NEVER))
        if len(heads) and heads[0] < np.flatnonzero(inside)[0]:
            inside[heads[0]] = True
    menu = (linked > LINK_SHARE * size) & (main == 0)
    keep = inside & (factor > NEVER) & (high | ((factor == CLEAR) & ~menu))
    return "\n".join(t for (t, _), k in zip(lines, keep, strict=True) if k)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points); columns of these names are replaced.

    Null html is the empty page, whose text is empty. Pages are read one by one, so repeated rows give the same text.
    """
    schema = StructType([f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")] + StructType.fromDDL("text string, n_chars long").fields)
    kept = schema.names[:-2]

    def run(batches):
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column(batch.schema.names.index(html_col)).to_pylist()]
            columns = [batch.column(batch.schema.names.index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
