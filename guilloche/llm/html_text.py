"""Main-text extraction by two-pass block rules.

A page is cut into blocks; elements that hold no prose (scripts, controls, menus, footers and
the like, hidden ones) are not read. Pass one decides by what a block consists of: stop-word
density and length make it text, link density boilerplate. Position and names shift that
threshold, as a block may then be open: links in a list of the article, prose in a box named as a
notice or in a named box beside the article that holds most of the prose. Boxes that repeat, each with a date
and the same short link, are comments. Pass two gives an open block, mostly a short one, the
label of its nearest decided neighbours, tipped by names and position. A page on which nothing is clearly
text is decided by its best open block.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)>"""
    r"""|<[!?/][^>]*(?:>|\Z)"""
    r"""|<[A-Za-z][^>]*\Z""",
    re.S,
)
#: A whole attribute: name and, if it has one, value.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[a-z]+|[A-Z]+[a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never main text; ``header`` is one outside the article.
_NOT_TEXT = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
_BLOCK = _HEADINGS | _NOT_TEXT | frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure header hgroup hr html legend li main ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is read up to their end tag, as no markup.
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
#: Elements that end where one of them starts, unless a boundary lies between.
_ENDS_P = _BLOCK - {"br", "option", "body", "html", "head", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Elements that are a paragraph themselves: a name on one is about it alone, on any other about all within.
_OWN = _HEADINGS | frozenset("blockquote caption dd dt figcaption p pre summary td th".split())
#: Elements that a list of comments may consist of.
_ITEMS = frozenset("article div li section tr".split())
#: Boundaries that no implied end and no end tag of another element crosses.
_SCOPE = frozenset("caption html object table td template th".split())
_LISTED = frozenset("dd dt li".split())
_LISTS = frozenset("dl ol ul menu".split())
_TABLE = frozenset("caption table tbody td tfoot th thead tr".split())

#: Parts of class and id names and what they weigh: notices, adverts, menus and the like; names that only hint at them.
_STRONG, _WEAK = 6, 1
_AGAINST = dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices"
    " notification notifications overlay pager pagination paywall popup promo promotion recommended related sidebar sidenav signup sponsor sponsored subscribe subscription teaser teasers toolbar topbar".split(),
    _STRONG,
) | dict.fromkeys("dialog privacy replies reply respond search share sharing skip social tags widget widgets".split(), _WEAK)
#: Weak names that are as clear as strong ones where the name says nothing else.
_ALONE = frozenset("dialog replies respond search share sharing skip social tags".split())
#: Parts that say where or what kind of box it is, and nothing of its content.
_NEUTRAL = frozenset("area bar block body bottom box button buttons col column container content footer group header holder icon inner item items left link links list main outer page panel post primary right row section site slot space text title top unit wrap wrapper zone".split())
#: Parts that turn a name into one that only mentions what follows.
_MENTIONS = frozenset("has no not with without".split())
_FOR = frozenset("article articlebody content entry main post story".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NEVER_NEGATIVE = frozenset("html body main".split())

#: The commonest function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from had has have he in is it not of on or she that the their they this to was were which with you"
    " als auf auch aus bei das dem den der des die durch ein eine einer es für im ist mit nicht sich sie sind um und von war wie wird zu zum zur"
    " au aux avec ce cette dans de des du elle en est et il la le les mais ne ou par pas plus pour que qui sa se son sur un une"
    " al como con del el ella es esta este la las lo los más no o para pero por que se si sin su sus una y".split()
)
#: Words from which a block counts as long, share of stop words of a text block.
LONG_WORDS, STOP_SHARE = 12, 0.12
#: Shares of linked characters of a block that holds links, and of one made of them.
LINK_SHARE, ALL_LINKS = 0.5, 0.9
#: Share of stop words in the long blocks of a page below which its language has no list here.
NO_LIST_SHARE = 0.04
#: Blocks of prose that may outvote the name of the box they are in.
OUTVOTE = 3
#: Words of a link that is the same in each comment, and of a line with its date.
ACTION_WORDS, DATED_WORDS = 3, 14
#: Day and month or year in digits, or with one word between.
_DATE = re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\d{1,2}\.?\s+[^\W\d]+\.?,?\s+\d{4}|[^\W\d]+\s+\d{1,2},?\s+\d{4}|\d+\s+[^\W\d]+\s+ago\b|\d{1,2}:\d{2}")
#: Letters of scripts that put no blanks between words; two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")


def name_weight(name: str, in_article: bool = True) -> int:
    """What one class or id name says against its element: 0, ``_WEAK`` or ``_STRONG``.

    A name counts in full if its last part does, or all its parts but neutral ones; a part
    elsewhere only hints. ``with-sidebar`` and the like merely mention something. A header
    outside the article counts if its name does not speak of the article.
    """
    parts = [p.lower() for p in _PART.findall(name)]
    if not in_article and parts[-1:] == ["header"] and _FOR.isdisjoint(parts):
        return _STRONG
    found = [_AGAINST[p] for p in parts if p in _AGAINST]
    if not found or not _MENTIONS.isdisjoint(parts):
        return 0
    rest = [p for p in parts if p not in _NEUTRAL or p in _AGAINST]
    if all(p in _AGAINST for p in rest):
        return _STRONG if max(found) == _STRONG or all(p in _ALONE for p in rest) else _WEAK
    return _STRONG if _AGAINST.get(parts[-1]) == _STRONG else _WEAK


class Seen(NamedTuple):
    """What an element's tag and attributes say: nothing within is prose; its name is that of a notice, advert or the like; it is named for an article, or is one."""

    never: bool = False
    against: bool = False
    named: bool = False
    article: bool = False
    other: bool = False  # has another name that says something
    signature: str = ""  # its classes


class Block(NamedTuple):
    """A block's text and linked characters; whether it lies in what holds no prose, in a box or is a paragraph with a name against it, in a box named for an article, in the article, in a heading, in a list; the innermost boxes around it, and the innermost one with a name of another kind."""

    words: str
    linked: int
    never: bool
    boxed: bool
    hinted: bool
    named: bool
    article: bool
    heading: bool
    listed: bool
    items: tuple[int, ...]
    place: int


def evidence(tag: str, attrs: str, in_article: bool) -> Seen:
    never = tag in _NOT_TEXT or tag == "header" and not in_article
    against = named = other = False
    article, signature = tag in ("article", "main"), ""
    if attrs and tag not in _NEVER_NEGATIVE:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                signature = value if name == "class" else signature
                for one in value.split():
                    against |= name_weight(one, in_article) == _STRONG
                    parts = {p.lower() for p in _PART.findall(one)}
                    named |= not _FOR.isdisjoint(parts)
                    other |= not parts <= _NEUTRAL
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                never = True
            elif name == "role" and value.lower() in _ROLES:
                never = True
            elif name == "itemprop" and "articleBody" in value:
                article = True
    if never or against:
        named = article = False
    return Seen(never, against, named, article, other and not named, signature)


class _Reader:
    """Open elements of a page and what they add up to, each push and pop in constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Seen, bool]] = []  # tag, what it says, inline
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        self.items: list[int] = []  # numbers of the open boxes that may be comments
        self.kinds: list[tuple[str, str]] = []  # of all such boxes: tag and class
        self.places: list[int] = []  # numbers of the open boxes with another name, outside the article
        self.n_places, self.around = 0, set()  # how many there were, and those with an article inside
        self.never = self.boxed = self.hinted = self.named = self.articles = self.dropped = self.headings = 0

    def _count(self, entry: tuple, by: int) -> None:
        tag, seen, inline = entry
        if inline:
            self.dropped += by * (seen.never or seen.against)
        else:
            self.never += by * seen.never
            self.boxed += by * (seen.against and tag not in _OWN)
            self.hinted += by * (seen.against and tag in _OWN)
            self.named += by * seen.named
            self.articles += by * seen.article
            self.headings += by * (tag in _HEADINGS)

    def push(self, tag: str, seen: Seen) -> None:
        entry = (tag, seen, tag not in _BLOCK)
        k = len(self.stack)
        self.at.setdefault(tag, []).append(k)
        if tag in _SCOPE:
            self.scopes.append(k)
        if not entry[2]:
            self.blocks.append(k)
        if tag in _ITEMS:
            self.items.append(len(self.kinds))
            self.kinds.append((tag, seen.signature))
        if seen.other and not entry[2]:
            self.places.append(self.n_places)
            self.n_places += 1
        if (seen.article or seen.named) and not self.articles:
            self.around.update(self.places)
        self.stack.append(entry)
        self._count(entry, 1)

    def cut(self, k: int) -> None:
        """Close the element at ``k`` and all within it."""
        while len(self.stack) > k:
            entry = self.stack.pop()
            if not entry[0]:
                continue
            self.at[entry[0]].pop()
            if entry[0] in _SCOPE:
                self.scopes.pop()
            if not entry[2]:
                self.blocks.pop()
            if entry[0] in _ITEMS:
                self.items.pop()
            if entry[1].other and not entry[2]:
                self.places.pop()
            self._count(entry, -1)

    def last(self, *tags: str) -> int:
        return max((a[-1] for t in tags if (a := self.at.get(t))), default=-1)

    def imply(self, tags: tuple[str, ...], boundary: int) -> None:
        if (k := self.last(*tags)) > boundary:
            self.cut(k)

    def start(self, tag: str) -> None:
        """Close what the start of ``tag`` ends."""
        scope = self.scopes[-1] if self.scopes else -1
        if tag in _ENDS_P:
            self.imply(("p",), max(scope, self.last("button")))
        if tag in ("article", "main") and not self.articles:  # a menu or page header that nobody closed
            self.imply(("nav", "header"), scope)
        if shut := _CLOSES.get(tag):
            self.imply(shut, self.last("table", "template") if tag in _TABLE else max(scope, self.last(*(_LISTS if tag == "li" else ("dl", "select")))))

    def end(self, tag: str) -> None:
        """Close the open element of an end tag; one that would cross a boundary is ignored.

        An inline element around open blocks ends without them.
        """
        k = self.last(tag)
        if k < 0 or k < (self.last("table", "template") if tag in _TABLE and tag != "table" else self.scopes[-1] if self.scopes and tag not in _SCOPE else -1):
            return
        if tag not in _BLOCK and self.blocks and self.blocks[-1] > k:
            self._count(self.stack[k], -1)
            self.at[tag].pop()
            self.stack[k] = ("", Seen(), True)
        else:
            self.cut(k)


def blocks_of(page: str) -> tuple[list[Block], set[int], set[int]]:
    """Blocks of a page in order, the numbers of the boxes that are comments, and of those with another name around the article.

    One pass, in time proportional to the page however its elements are nested.
    """
    out: list[Block] = []
    open_, text, link = _Reader(), [], []
    linked, at, n, timed = 0, 0, len(page), False
    unclosed: set[str] = set()
    dated: set[int] = set()  # boxes with a date
    actions: dict[tuple[str, str, str], set[int]] = {}  # kind of box and text of a short link -> the boxes

    def close_block() -> None:
        nonlocal linked, timed
        if text:
            if words := " ".join("".join(text).split()):
                items = tuple(open_.items[-2:])
                out.append(Block(words, linked, open_.never > 0, open_.boxed > 0, open_.hinted > 0, open_.named > 0, open_.articles > 0, open_.headings > 0, bool(open_.blocks) and open_.stack[open_.blocks[-1]][0] in _LISTED, items, open_.places[-1] if open_.places else -1))
                if timed or words.count(" ") < DATED_WORDS and _DATE.search(words):
                    dated.update(items)
            text.clear()
        linked, timed = 0, False

    def close_link() -> None:
        short = " ".join("".join(link).split())
        link.clear()
        if short and short.count(" ") < ACTION_WORDS:
            for i in open_.items[-2:]:
                actions.setdefault((*open_.kinds[i], short), set()).add(i)

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not open_.dropped:
            decoded = html.unescape(raw) if "&" in raw else raw
            text.append(decoded)
            if open_.at.get("a"):
                linked += len("".join(decoded.split()))
            if open_.at.get("a") or open_.at.get("button"):
                link.append(decoded)

    while at < n:
        first = page.find("<", at)
        if first < 0:
            add(page[at:])
            break
        add(page[at:first])
        m = _TOKEN.match(page, first)
        if m is None:  # a bare sign
            add("<")
            at = first + 1
            continue
        at = m.end()
        if not (tag := m["tag"] or m["tag2"]):
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag in _BLOCK:
            close_block()
        if end:
            if tag in ("a", "button"):
                close_link()
            open_.end(tag)
            continue
        timed = timed or tag == "time"
        if tag in _VOID:
            continue
        if tag in _RAW:
            found = None if tag in unclosed else _RAW[tag].search(page, at)
            if found:
                at = found.start()
            elif tag in ("script", "style"):
                break
            else:  # never closed: what follows is not its content
                unclosed.add(tag)
            continue
        open_.start(tag)
        open_.push(tag, evidence(tag, attrs, open_.articles > 0))
        if tag in ("a", "button"):
            link.clear()
    close_block()
    comments = set().union(*[both for boxes in actions.values() if len(both := boxes & dated) > 1])
    return out, comments, open_.around


def density(block: Block, stop_list: bool) -> bool | None:
    """What a block's own words say: text, boilerplate or neither."""
    words = block.words
    size, tokens = len(words) - words.count(" "), words.split(" ")
    n = _length(words, tokens)
    if block.linked > ALL_LINKS * size or block.linked > LINK_SHARE * size and n < 2 * LONG_WORDS:
        return False
    if n >= LONG_WORDS and not block.heading and (not stop_list or _stops(tokens) >= STOP_SHARE * n):
        return True
    return None


def _length(words: str, tokens: list[str]) -> int:
    return max(len(tokens), 0 if words.isascii() else len(_UNSPACED.findall(words)) // 2)


def _stops(tokens: list[str]) -> int:
    return sum(t.strip(".,;:!?()\"'").lower() in STOP_WORDS for t in tokens)


def labels_of(found: list[Block], comments: set[int], around: set[int], dense: list[bool | None]) -> list[bool | None]:
    """Labels after pass one: densities, moved by position and names; None where a block is open."""
    size = [len(b.words) if d else 0 for b, d in zip(found, dense)]
    prose = [not b.never and not comments.intersection(b.items) for b in found]
    # A name that would take all of the prose, several blocks in one box, says nothing. An article, or
    # else what is named like one, holds most of the prose or is none.
    total, boxed = sum(n for n, p in zip(size, prose) if p), [(n, b.items) for n, b, p in zip(size, found, prose) if n and p and b.boxed]
    names = len(boxed) < OUTVOTE or sum(n for n, _ in boxed) < total or not set.intersection(*[set(i) for _, i in boxed])
    free = [p and not (names and b.boxed) for b, p in zip(found, prose)]
    real = any(b.article for b, f in zip(found, free) if f)
    within = [f and (b.article if real else b.named) for b, f in zip(found, free)]
    article = any(within) and 2 * sum(n for n, w in zip(size, within) if w) >= sum(n for n, f in zip(size, free) if f)
    out: list[bool | None] = []
    for b, d, f, w in zip(found, dense, free, within):
        if not f or article and not w and not b.named and b.place >= 0 and b.place not in around:  # a box with a name of its own beside the article
            out.append(False)
        elif d is None and names and b.hinted:
            out.append(False)
        elif d is False and article and b.article and not b.hinted and (b.heading or b.listed):  # sources and the like
            out.append(None)
        else:
            out.append(d)
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: its text blocks in order, joined by one blank."""
    found, comments, around = blocks_of(page or "")
    # Without a list for its language a page is judged by length, links and structure.
    long = [(t, n) for b in found if not (b.never or b.boxed or b.heading) for t in [b.words.split(" ")] if (n := _length(b.words, t)) >= LONG_WORDS]
    stop_list = sum(_stops(t) for t, _ in long) >= NO_LIST_SHARE * sum(n for _, n in long)
    dense = [density(b, stop_list) for b in found]
    labels = labels_of(found, comments, around, dense)
    if True not in labels and None in labels:
        labels[max((i for i, x in enumerate(labels) if x is None), key=lambda i: (2 * found[i].article + found[i].named, len(found[i].words), -i))] = True
    # Open blocks: both nearest decided neighbours, or the only one, must be text; in the article one is
    # enough. A heading asks the one after it.
    after, following = [None] * len(found), None
    for i in range(len(found) - 1, -1, -1):
        after[i] = following
        following = labels[i] if labels[i] is not None else following
    before, out = None, []
    for i, label in enumerate(labels):
        if label is None:
            around = [after[i]] if found[i].heading and after[i] is not None and not found[i].article else [x for x in (before, after[i]) if x is not None]
            label = any(around) if found[i].article else bool(around) and all(around)
        else:
            before = label
        if label:
            out.append(found[i].words)
    return " ".join(out)


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` for each row of ``pages``, from the whole page.

    A null or empty page, or one of boilerplate alone, gives the empty text. Cut-off pages and
    elements that nobody closes are read to the end of the page. A page is parsed in time
    proportional to its length. Rows are judged one by one, so ties, repeated rows and empty
    tables need nothing; other columns are left out.
    """
    rows = pages.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(keep))]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
