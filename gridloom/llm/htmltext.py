"""Main text of web pages: the maximum-scoring contiguous region of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrowtext import as_text, map_rows
from gridloom.runtime import free_name, quoted, table

# No part of these is tried twice at one place, so a scan takes time in proportion to the page, whatever is in it.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)

# Names of elements by what they do in a page.
RAW = frozenset("script style noscript template textarea title iframe svg canvas object".split())
#: Of those, what runs to the end of the page where it isn't closed; the others then count as a tag without content.
ENDLESS = frozenset("script style textarea title".split())
#: Formulas: parts of a sentence, whose tags neither count for nor against it.
MATH = frozenset("annotation math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav header footer aside form menu button select option label fieldset dialog head".split())
CLOSED_BY = {"p": "p div article section ul ol li table h1 h2 h3 h4 h5 h6 blockquote pre nav header footer aside form main figure hr dl".split(), "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"]}
#: What a class, id or role says of an element that isn't the article: one whole name in it, made of such words only.
_SIDE_WORD = r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|widget\w*|footer|header|masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|comment-?list|replies|reply|disqus|form|search\w*|toolbar|pagination|pager|tags?|navigation|complementary|contentinfo)"
SIDE = re.compile(rf"{_SIDE_WORD}(?:[_-]{_SIDE_WORD})*", re.I)

#: Scores of a word before anything is learned, by where it stands; what isn't here has none.
PRIOR = {"any": 1.0, "p": 1.0, "h1": 0.5, "h2": 0.5, "h3": 0.5, "blockquote": 0.5, "pre": 0.5, "link": -1.0, "inside": 3.0, "beside": -4.0, "side": -5.0, **{f"in {x}": -5.0 for x in OUTSIDE}}
#: Never learned, as the labels are made of them.
FIXED = ("inside", "beside")
#: Bounds of a word's score and of a tag's; a tag that no labelled page has, and an inline one.
MOST, TAG_BOUNDS, TAG, INLINE_TAG = 4.0, (-3.0, -0.1), -1.0, -0.2
#: What a run of words against the text costs at most, and a tag in such a place.
AGAINST, TAG_AGAINST = -1.5, -0.1
#: Names of classes that a word stands in, so many from the innermost outwards.
NAMES = 8
#: Words of one context weigh as so many at most in learning; the pull back to PRIOR.
CONTEXT_WORDS, PULL = 30.0, 1.0


@dataclass
class Token:
    """A tag (name starts with / where it closes) or a run of text; context: what PRIOR and learned weights know of
    where it stands, a tag within its own element."""

    tag: str
    text: str
    context: tuple[str, ...]
    block: int  # number of the block that a text belongs to
    article: int  # the innermost article or main element, as numbered; -1 without


@dataclass
class _Side:
    """An element that its name, class, id or role takes for a side of the page, and what lies directly under it;
    ``_settle`` adds what lies in sides within it."""

    up: int
    by_words: bool  # whether holding most of the words clears it
    marks: tuple[str, ...]
    mains: int = 0
    articles: int = 0
    paragraphs: int = 0
    plain: int = 0
    stays: bool = False


@dataclass
class _Open:
    """An element not closed yet: what its texts know of where they stand."""

    name: str
    place: str
    side: int
    link: bool
    article: int
    main: int
    names: tuple[str, ...]
    block: int  # place in the stack of the innermost element that isn't inline


def tokens(page: str) -> list[Token]:
    """Tags and texts in order, in one scan. Comments, declarations and the content of scripts and such are left out.

    An element is a side of the page by its name or by its class, id or role, with all below it. It is none if it holds
    main, or an article while none lies outside of sides, or (by its class, id or role, or a form) more than half of the
    page's words in paragraphs; in a page without paragraphs, of its words that aren't links. A side says of the words
    in it where they stand, and nothing that lies around it does.
    Unclosed elements end where their parent does, or where HTML lets the next one close them; stray ends are ignored.
    A tag cut off by the end of the page is dropped. Time is in proportion to the page, however deep elements nest.
    """
    out: list[tuple[str, str, str, bool, int, int, int, tuple[str, ...], int]] = []
    stack: list[_Open] = []
    open_: Counter[str] = Counter()
    sides: list[_Side] = []
    boxes: list[tuple[str, int]] = []  # articles and mains: name, innermost side
    whole = _Side(-1, True, ())
    unclosed: set[str] = set()
    nowhere = _Open("", "", -1, False, -1, -1, (), -1)
    at, block, n = 0, 0, len(page)

    def put(tag: str, text: str, o: _Open | None = None) -> None:
        o = o or (stack[-1] if stack else nowhere)
        out.append((tag, text, o.place, o.link, o.side, o.article, o.main, o.names, block))

    def add_text(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            put("", text)
            o = stack[-1] if stack else nowhere
            about = sides[o.side] if o.side >= 0 else whole
            words = len(text.split())
            about.paragraphs += words if o.place == "p" else 0
            about.plain += 0 if o.link else words

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add_text(page[at:])
            break
        add_text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[0].endswith(">"):
            break
        if m[1]:
            closed = None
            if open_[name]:
                while closed is None or closed.name != name:
                    closed = stack.pop()
                    open_[closed.name] -= 1
                    if closed.name not in INLINE:
                        block += 1
            elif name not in INLINE:
                block += 1
            put("/" + name, "", closed)
            continue
        if name in RAW:
            if name == "svg" and m[3].endswith("/") or name in unclosed:
                continue
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ENDLESS:
                at = n
            else:
                unclosed.add(name)
            continue
        if name not in INLINE:
            block += 1
        last = stack[-1].block if stack else -1
        if last >= 0 and name in CLOSED_BY.get(stack[last].name, ()):  # an unclosed p or li that this element ends
            for o in stack[last:]:
                open_[o.name] -= 1
            del stack[last:]
        found = [x for a in ATTRIBUTE.findall(m[3]) for x in (a[1] or a[2] or a[3]).split()] if m[3] else []
        o = stack[-1] if stack else nowhere
        side = o.side
        nested = name == "article" and open_["article"] > 0
        by_name = name in OUTSIDE and not (name == "header" and (open_["article"] or open_["main"]))
        by_word = bool(found and (name not in ("body", "html", "article", "main") or nested) and any(map(SIDE.fullmatch, found)))
        if by_name or by_word:
            sides.append(_Side(side, name == "form" or not by_name, (f"in {name}",) if by_name else ("side",)))
            side = len(sides) - 1
        article, main = o.article, o.main
        if name in ("article", "main") and not by_word:
            about = sides[side] if side >= 0 else whole
            about.articles += name == "article"
            about.mains += name == "main"
            boxes.append((name, side))
            article, main = (len(boxes) - 1, main) if name == "article" else (article, len(boxes) - 1)
        names = (*(f".{x.lower()}" for x in found), *o.names)[:NAMES] if found else o.names
        new = _Open(name, o.place if name in INLINE else name, side, o.link or name == "a", article, main, names, o.block if name in INLINE else len(stack))
        put(name, "", new)
        if name not in VOID and not m[3].endswith("/"):
            stack.append(new)
            open_[name] += 1
    _settle(sides, whole)
    return _placed(out, sides, boxes)


def _settle(sides: list[_Side], whole: _Side) -> None:
    """Say which sides stay; see ``tokens``. Outer ones come first, as what they hold may free an article."""
    free, own = whole.articles, [x.articles for x in sides]
    for x in reversed(sides):
        up = sides[x.up] if x.up >= 0 else whole
        for count in ("mains", "articles", "paragraphs", "plain"):
            setattr(up, count, getattr(up, count) + getattr(x, count))
    count = "paragraphs" if whole.paragraphs else "plain"
    for x, mine in zip(sides, own):
        outer = x.up >= 0 and sides[x.up].stays
        most = x.by_words and 2 * getattr(x, count) > getattr(whole, count)
        x.stays = outer or not (x.mains or x.articles and not free or most)
        if outer:
            x.marks = sides[x.up].marks
        if not x.stays:
            free += mine


def _placed(out: list[tuple], sides: list[_Side], boxes: list[tuple[str, int]]) -> list[Token]:
    """Tokens with their contexts. Where an article lies outside of sides, words stand inside or beside it; else where a
    main does, of that."""
    free = [side < 0 or not sides[side].stays for _, side in boxes]
    kinds = {name for (name, _), ok in zip(boxes, free) if ok}
    made: dict[tuple, tuple[str, ...]] = {}
    result = []
    for tag, text, place, link, side, article, main, names, block in out:
        box = article if "article" in kinds or article >= 0 and not kinds else main
        stays = side >= 0 and sides[side].stays
        key = (place, link, side if stays else -1, box if stays or not kinds else box >= 0 and free[box], names)
        context = made.get(key)
        if context is None:
            where = sides[side].marks if stays else () if not kinds else ("inside",) if box >= 0 and free[box] else ("beside",)
            context = made[key] = ("any", *((place,) if place else ()), *(("link",) if link else ()), *where, *dict.fromkeys(names))
        result.append(Token(tag, text, context, block, box))
    return result


@dataclass
class Weights:
    """words: score of a word, summed over its context (PRIOR where nothing was learned); tags: of a tag."""

    words: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, context: tuple[str, ...]) -> float:
        known = self.__dict__.setdefault("_known", {})
        x = known.get(context)
        if x is None:
            x = max(-MOST, min(MOST, sum(self.words.get(c, 0.0) for c in context)))
            if len(known) < 100_000:
                known[context] = x
        return x

    def of(self, t: Token) -> float:
        """Words score each where they are for the text; a run of words against it scores once, so that what follows a
        long advert within an article isn't cut off."""
        if t.tag:
            if self.word(t.context) < 0:
                return TAG_AGAINST
            bare = t.tag.lstrip("/")
            return self.tags.get(t.tag, 0.0 if bare in MATH else INLINE_TAG if bare in INLINE else TAG)
        words = len(t.text.split())
        x = self.word(t.context)
        return words * x if x > 0 else max(AGAINST, x) if words else 0.0


def learn(pages: list[str]) -> Weights:
    """Weights from pages that mark their article with one article or main element: of tags the log-odds to lie within
    it, bounded and negative; of contexts by logistic regression on whether words lie within it, pulled to PRIOR."""
    seen: dict[tuple[str, ...], list[int]] = {}
    inside, outside, used = Counter(), Counter(), Counter()
    for page in pages:
        found = tokens(page)
        for mark in ("article", "main"):
            opens = [i for i, t in enumerate(found) if t.tag == mark]
            closes = [i for i, t in enumerate(found) if t.tag == "/" + mark]
            if len(opens) == 1 and len(closes) == 1:
                break
        else:
            continue
        used.update({c for t in found for c in t.context if c.startswith(".")})
        for i, t in enumerate(found):
            within = opens[0] < i < closes[0]
            if t.tag:
                (inside if within else outside)[t.tag] += 1
            elif words := len(t.text.split()):
                seen.setdefault(tuple(c for c in t.context if c not in FIXED), [0, 0])[within] += words
    w = Weights()
    if not seen:
        return w
    # names of classes that one page alone has say nothing of others
    names = sorted({c for context in seen for c in context if not c.startswith(".") or used[c] > 2})
    at = {c: i for i, c in enumerate(names)}
    x = np.zeros((len(seen), len(names)))
    for row, context in enumerate(seen):
        x[row, [at[c] for c in context if c in at]] = 1.0
    counts = np.array(list(seen.values()), float)
    n = counts.sum(1)
    y, weight = counts[:, 1] / n, CONTEXT_WORDS * n / (n + CONTEXT_WORDS)
    prior = np.array([PRIOR.get(c, 0.0) for c in names])
    beta = prior.copy()
    for _ in range(25):  # Newton's method; the pull makes the Hessian regular
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + PULL * (beta - prior)
        beta = beta - np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + PULL * np.eye(len(names)), slope)
    w.words |= dict(zip(names, beta.tolist()))
    w.tags = {t: max(TAG_BOUNDS[0], min(TAG_BOUNDS[1], math.log((inside[t] + 0.5) / (outside[t] + 0.5)))) for t in inside | outside}
    return w


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum above zero, the first of equals; (0, 0) without one."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, span = run, (start, i + 1)
    return span


def region(found: list[Token], scores: list[float]) -> list[Token]:
    """The tokens of the best run, without the words in it that score against the text, such as adverts."""
    start, end = best_run(scores)
    return [t for t, s in zip(found[start:end], scores[start:end]) if t.tag or s >= 0]


def extract(page: str, weights: Weights) -> str:
    """The words of the best region; blocks joined by line breaks, white space within one made single spaces."""
    found = tokens(page)
    blocks: dict[int, list[str]] = {}
    for t in region(found, [weights.of(t) for t in found]):
        if not t.tag:
            blocks.setdefault(t.block, []).append(t.text)
        elif t.tag == "br":
            blocks.setdefault(t.block, []).append(" ")
    texts = (" ".join("".join(b).split()) for _, b in sorted(blocks.items()))
    return "\n".join(t for t in texts if t)


def fit(pages: DataFrame, most_pages: int = 400, key: str = "page_id", content: str = "html") -> Weights:
    """Weights from at most ``most_pages`` labelled pages (those that mark their article), chosen by hash of the key.

    They are counted first, and each takes part by that share of the hash's range, so that about as many pages come to
    the driver from any number of tasks.
    """
    marked = pages.where(quoted(content).rlike("(?i)<(article|main)[ >]")).select(quoted(key).alias("k"), quoted(content).alias("h"))
    n = marked.count()
    draw = F.pmod(F.xxhash64("k", F.xxhash64("h")), F.lit(1 << 31))
    rows = marked.where(draw < F.lit(int((1 << 31) * min(1.0, 1.2 * most_pages / max(1, n))))).select("h", draw.alias("d")).collect()
    return learn([r["h"] for r in sorted(rows, key=lambda r: (r["d"], r["h"]))[:most_pages]])


def add_text(pages: DataFrame, weights: Weights, content: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole page; empty for null, empty and wordless pages. No shuffle."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(column):
        return column.map(lambda h: extract(h or "", weights))

    return pages.withColumn(free_name(pages, into), run(quoted(content).cast("string")))


def texts(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row; repeated rows each give a row, null keys and urls stay null.

    Null, empty and wordless pages have an empty text, an empty table gives no row (and nothing to learn from: PRIOR
    then holds). Pages are read whole, whatever their length, one at a time. Other columns may have any name.
    """
    weights = weights or fit(pages)

    def work():
        def step(columns):
            keys, urls, bodies = columns
            out = [extract(h, weights) for h in bodies]
            return [keys, urls, out, [len(t) for t in out]]

        return step

    slim = pages.select("page_id", "url", as_text(F.col("html")).alias("h"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(slim, {"page_id": "page_id", "url": "url", "h": "h"}, f"page_id {kind}, url string, text string, n_chars long", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "pages"))
