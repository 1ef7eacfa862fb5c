"""A forgiving reader of HTML: containers with their generalised paths, and text blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import xxhash

# Element names of the HTML standard, grouped by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg".split())
DROPPED = frozenset(
    "head nav footer aside form script style title textarea noscript iframe noembed noframes template svg "
    "button select option input fieldset dialog menu object canvas audio video annotation annotation-xml".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br"}
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
SIBLINGS = frozenset("li dd dt tr td th option".split())
# Words in class, id and role that mark what is not part of an article.
UNWANTED = frozenset(
    "ad ads advert advertisement advertising adbox banner breadcrumb breadcrumbs byline-share comment comments "
    "commentlist consent cookie cookies disclaimer disqus dropdown footer footnote-nav gdpr header-nav masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo "
    "promotion promoted recommended related respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags-nav toc toolbar widget alert complementary contentinfo search".split()
)
# Second words that make a name such as comment-list one of a part of the page; other words, as
# in notice-period, make it the name of a subject.
PARTS = frozenset(
    "area bar block body box button buttons column container content feed footer form group header holder icons inner "
    "item items left link links list main menu outer overlay panel post posts primary right row secondary section slot "
    "space strip top bottom tray unit wrap wrapper zone".split()
)
# First words of the same kind.
PLACES = frozenset(
    "site page main top bottom left right global primary secondary header footer sticky user reader mobile desktop "
    "side post entry article blog local page".split()
)
# In these, only a class or role that is one of the words as a whole counts: names tell of a subject.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt td th".split())
# These hold the article, whatever their classes say of the page.
NEVER_UNWANTED = frozenset("html body main article".split())
# First words of classes that tell of a layout, not of the element itself.
STATES = frozenset("has no with without left right".split())
SUBSTANTIAL = 0.05  # share of a page's text from which a container's own text may be a part of the article
_TOKEN = re.compile(
    r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*)(?:>|\Z)"
    r"|!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))",
    re.S,
)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


def _remembered(function: Callable, most: int = 4096) -> Callable:
    """``function`` with its last results kept; unlike ``lru_cache`` it can travel by value."""
    known: dict = {}

    def inner(*args):
        if args not in known:
            if len(known) >= most:
                known.clear()
            known[args] = function(*args)
        return known[args]

    return inner


@dataclass(slots=True)
class Element:
    name: str
    path: str
    wanted: bool  # neither it nor an ancestor is boilerplate
    linked: bool
    container: int | None  # index into the page's containers
    article: bool


@dataclass
class Page:
    containers: list[tuple[str, int | None]] = field(default_factory=list)  # path, parent container
    blocks: list[tuple[int | None, str, int]] = field(default_factory=list)  # container, text, linked characters


def _first(match: re.Match) -> str:
    return next((g for g in match.groups() if g is not None), "")


@_remembered
def unwanted(attributes: str, textual: bool = False) -> bool:
    for match in _MARKS.finditer(attributes):
        if textual and match[0][:2].lower() == "id":
            continue
        for token in _first(match).lower().split():
            words = _WORDS.findall(token)
            if token in UNWANTED or not textual and _compound(words):
                return True
    return False


def _compound(words: list[str]) -> bool:
    """Whether the words of a name tell of a part of the page that is no article."""
    if not words or words[0] in STATES and len(words) > 1:
        return False
    if len(words) == 1:
        return words[0] in UNWANTED
    first, last = words[0] in UNWANTED, words[-1] in UNWANTED
    return first and all(w in PARTS or w in UNWANTED for w in words[1:]) or last and all(
        w in PLACES or w in UNWANTED for w in words[:-1]
    )


@_remembered
def step(name: str, attributes: str) -> str:
    """One step of a path: the tag and its sorted classes, with digits generalised."""
    match = _CLASS.search(attributes) if attributes else None
    classes = sorted({re.sub(r"\d+", "#", c) for c in _first(match).split()}) if match else []
    return ".".join([name, *classes])


def below(path: str, last: str) -> str:
    """The path of a container inside the one at ``path``: ``depth:hash>step``."""
    depth = int(path.partition(":")[0] or 0) + 1
    return f"{depth}:{xxhash.xxh64_hexdigest(f'{path}>{last}')}>{last}"


def depth_of(path: str) -> int:
    return int(path.partition(":")[0])


@_remembered
def _end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I)


def read(source: str) -> Page:
    """The page by ``_read``, and by tags alone if its classes leave nothing."""
    page = _read(source, True)
    return page if page.blocks else _read(source, False)


def _read(source: str, by_class: bool) -> Page:
    """Containers and text blocks of a page, boilerplate left out.

    Open tags are closed where HTML closes them or where an ancestor ends; stray end tags
    are ignored, and a page may break off anywhere. White space in a block becomes one
    space. A header element is boilerplate unless it stands inside an article. A container's
    path is named by its depth, a hash of its steps, and its last step, so that what is kept
    of a page grows with its size and not with its depth.
    """
    page, stack, buffer, linked = Page(), [], [], 0
    root = Element("", "", True, False, None, False)

    def flush() -> None:
        nonlocal linked
        if not buffer:
            return
        text = "".join(buffer)
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            page.blocks.append((top.container, text, min(linked, len(text))))
        buffer.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and top.wanted:
            buffer.append(text)
            if top.linked:
                linked += len(text)

    def close(count: int) -> None:
        nonlocal top
        for _ in range(count):
            if stack[-1].name in BLOCKS:
                flush()
            stack.pop()
            top = stack[-1] if stack else root

    top, at = root, 0
    while at < len(source):
        match = _TOKEN.search(source, at)
        if match is None:
            say(source[at:])
            break
        say(source[at : match.start()])
        at = match.end()
        name, attributes = match[2], match[3]
        if name is None:
            if match[4]:
                say(html.escape(match[4]))
            continue
        name = name.lower()
        if match[1]:
            if top.name == name:
                close(1)
                continue
            depth = next((i for i, e in enumerate(reversed(stack), 1) if e.name == name), 0)
            if depth:
                close(depth)
            elif name == "p":
                flush()
            continue
        if name in CLOSES_P and stack and top.name not in CONTAINERS:
            depth = next((i for i, e in enumerate(reversed(stack), 1) if e.name in CONTAINERS or e.name == "p"), 0)
            if depth and stack[-depth].name == "p":
                close(depth)
        if name in SIBLINGS and top.name == name:
            close(1)
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if name in RAW:
            end = _end(name).search(source, at)
            at = end.end() if end else len(source)
            continue
        inside = top.article or name in ("article", "main")
        refused = name in DROPPED or name == "header" and not top.article
        if by_class and attributes and name not in NEVER_UNWANTED:
            refused = refused or unwanted(attributes, name in TEXTUAL)
        path = below(top.path, step(name, attributes)) if name in CONTAINERS else top.path
        container = top.container
        if name in CONTAINERS and top.wanted and not refused:
            page.containers.append((path, container))
            container = len(page.containers) - 1
        element = Element(name, path, top.wanted and not refused, top.linked or name == "a", container, inside)
        stack.append(element)
        top = element
    close(len(stack))
    flush()
    return page


def scores(page: Page) -> list[tuple[str, float]]:
    """``(path, share)`` for each container path of a page, best first.

    A block gives its unlinked characters to its own container, half of them to the next
    container out and a quarter to the one after. Articles and main elements count double,
    the body half. Shares of a page sum to 1; ties go to the outer, then the smaller path.
    """
    earned = [0.0] * len(page.containers)
    for container, text, linked in page.blocks:
        worth = float(len(text) - linked)
        for _ in range(3):
            if container is None:
                break
            earned[container] += worth
            worth, container = worth / 2, page.containers[container][1]
    total: dict[str, float] = {}
    for (path, _), worth in zip(page.containers, earned):
        name = path.rpartition(">")[2].partition(".")[0]
        weight = {"article": 2.0, "main": 2.0, "body": 0.5}.get(name, 1.0)
        total[path] = total.get(path, 0.0) + worth * weight
    whole = sum(total.values())
    if not whole:
        return []
    return sorted(((p, w / whole) for p, w in total.items() if w), key=lambda x: (-x[1], depth_of(x[0]), x[0]))


def shares(page: Page) -> dict[str, float]:
    """For each container path, the share of the page's unlinked text that stands in it directly."""
    whole = sum(len(text) - linked for _, text, linked in page.blocks)
    out = {path: 0.0 for path, _ in page.containers}
    for container, text, linked in page.blocks:
        if container is not None and whole:
            out[page.containers[container][0]] += (len(text) - linked) / whole
    return out


def extract(page: Page, path: str | None, more: frozenset[str] = frozenset()) -> str | None:
    """Blocks inside the containers at ``path`` or ``more`` in page order, or None if the page has none.

    Of containers in ``more`` that lie around one at ``path``, only their own text counts.
    Where a container stands in an article, or else in a main element, all of that belongs.
    """
    size = len(page.containers)
    around, whole = [False] * size, [None] * size
    for i in range(size - 1, -1, -1):
        own, parent = page.containers[i]
        if parent is not None and (around[i] or own == path):
            around[parent] = True
    chosen, direct = [False] * size, [False] * size
    for i, (own, parent) in enumerate(page.containers):
        name = own.rpartition(">")[2].partition(".")[0]
        above = whole[parent] if parent is not None else None
        if name in ("article", "main") and (above is None or name == "article" and above[0] == "main"):
            above = (name, i)
        whole[i] = above
        direct[i] = own in more
        chosen[i] = own == path or own in more and not around[i]
    for i in range(size):
        if chosen[i] and whole[i] is not None:
            chosen[whole[i][1]] = True
    for i, (_, parent) in enumerate(page.containers):
        chosen[i] = chosen[i] or parent is not None and chosen[parent]
    if not any(chosen) and not any(direct):
        return None
    return "\n".join(text for c, text, _ in page.blocks if c is not None and (chosen[c] or direct[c]))
