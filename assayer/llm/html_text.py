"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass decides each block by
the density of stop words, its length and the density of links. What encloses a block is
one feature more. Elements that never hold an article (menus, headers, footers, asides,
forms, hidden ones) turn it away, and so do those whose name says nothing but advert, notice
or reader comment, as their prose has the density of an article. All other names (side,
legal, search, share ...) turn away only what density does not find good, and only where
nothing good stands in the same wrapper: a wrapper with an odd name around an article is no
sidebar. A block of an article that density turns away is open. In the second pass open blocks inherit the label of the
nearest decided neighbours, those of the same article or main element before others; a
heading inherits from what follows it.

Each page is judged in the task that reads it; there is no shuffle.

Defined cases: a null or empty page, or one without main text, gives the empty text;
broken markup is read as browsers do: an unclosed tag or comment ends with the page, and a
head that is not closed ends with the first tag that no head holds; a wrapper whose names
speak both for an article and against it says nothing; long paragraphs in languages
without a list of stop words are open; equal rows get equal texts, one each; an empty table
gives no rows; all other columns are carried along, but one with a result's name gives way
to it.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Frequent function words of English, German, French, Spanish and Russian, and such signs of Chinese and Japanese.
STOP_WORDS = frozenset(
    """the of and to in a is that for it on was as with be by this are from at or an not have which you but his they all one we can there
    der die das und in zu den von mit ist des für im dem nicht ein eine auf als auch es an werden aus er hat dass sie nach wird bei
    de la le et les des en un du une que est pour qui dans par sur au pas ne se ce il sont plus avec son
    el los las y del por con su para como lo al no más o pero sus ha este sí porque esta entre cuando muy
    и в не на что с по как это из а к у за от но же бы для о то все так его
    的 是 了 在 不 有 和 这 我 の に は を た が で と""".split()
)
# Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that often stay unclosed, so nothing hangs on their end.
LOOSE = frozenset("p li dt dd tr td th option html body".split())
#: Elements whose content is never text of the article.
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button select option iframe object svg canvas audio video map fieldset".split())
MAIN_TAGS = frozenset(["article", "main"])
#: Whole words of a class or id; a wrapper that says that it has, or lacks, such a part is none.
BOILER_NAME = regex.compile(
    r"(?:^|[\s_-])(?<!(?:has|with|no|without|show|hide)[_-])(?:ads?|adverts?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side|widget|menu|nav\w*|"
    r"breadcrumbs?|masthead|header|footer|foot|copyright|legal|share|sharing|social|related|recommend\w*|comments?|respond|replies|reply|disqus|login|signup|search|pagination|pager|toolbar|skip)(?:$|[\s_\d-])",
    regex.I,
)
# Names of what holds prose that is not the article's, and words that say nothing beside them.
OWN_PROSE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription comment comments respond response replies reply disqus sidebar".split())
PLAIN_PARTS = frozenset("list area section box wrapper wrap container thread bar item items inner outer text body block form content message row col column slot unit top bottom left right js the".split())
PARTS = regex.compile(r"[_\-\d]+|(?<=[a-z])(?=[A-Z])")
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|xmp)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*>?"
    r"|<[a-z][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    regex.I | regex.S,
)
MAIN_NAME = regex.compile(r"(?:^|\s)(?:content|main|article|post|entry|story)(?:[_-]?(?:body|content|text|main))?(?:$|\s)", regex.I)
NAMES = regex.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", regex.I)
#: Signs of scripts that put no blanks between words are words of their own.
WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\W\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+")
#: What ends a sentence.
STOP_MARK = regex.compile(r"[.!?。！？؟।…]")
#: What a head holds; any other tag ends a head that is not closed.
HEAD_TAGS = frozenset("title meta link base style script noscript template object".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

SHORT_WORDS, LONG_CHARS = 12, 70
MANY_STOPS, SOME_STOPS = 0.2, 0.08
MANY_LINKS, SOME_LINKS = 0.5, 0.25

GOOD, BAD, OPEN = 1, -1, 0
SURE, HINT = 2, 1


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    boiler: bool = False
    #: The innermost wrapper whose name hints at boilerplate, 0 for none.
    hint: int = 0
    main: int = 0
    heading: bool = False
    text: str = ""
    label: int = OPEN


def _own_prose(value: str) -> bool:
    """Whether a name of a class or id says advert, notice or comment, and nothing else."""
    for name in value.split():
        parts = {p.lower() for p in PARTS.split(name) if p}
        if parts & OWN_PROSE and parts <= OWN_PROSE | PLAIN_PARTS:
            return True
    return False


def _boiler(tag: str, attrs: str, in_main: bool) -> int:
    """SURE for elements that hold no article, HINT for those that a name speaks against, else 0."""
    if tag in BOILER_TAGS and not (in_main and tag == "header"):
        return SURE
    if tag in ("html", "body") or not attrs:
        return 0
    hint = 0
    for name, *values in NAMES.findall(attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in BOILER_ROLES):
            return SURE
        if name in ("class", "id") and not MAIN_NAME.search(value):
            if _own_prose(value):
                return SURE
            if BOILER_NAME.search(value):
                hint = HINT
    return hint


def _is_main(tag: str, attrs: str) -> bool:
    if tag in MAIN_TAGS:
        return True
    if tag not in ("div", "section", "td") or not attrs:
        return False
    named = [(name.lower(), next((v for v in values if v), "")) for name, *values in NAMES.findall(attrs)]
    return any((n == "role" and v.lower() == "main") or (n in ("class", "id") and MAIN_NAME.search(v) is not None and not BOILER_NAME.search(v)) for n, v in named)


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, whether it is sure boilerplate, the hint and the main element around
    opened: Counter[str] = Counter()  # of each tag on the stack
    boilers, hint, hints, main, mains, links = 0, 0, 0, 0, 0, 0
    now = Block()

    def cut() -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.parts)).split()) if now.parts else ""
        if text:
            now.text = text
            found.append(now)
        now = Block(boiler=boilers > 0, hint=hint, main=main)

    def leave(at: int) -> None:
        nonlocal boilers, hint, main
        for name, sure, hint, main in reversed(stack[at:]):  # noqa: B007
            opened[name] -= 1
            boilers -= sure
        del stack[at:]

    def enter(tag: str, kind: int) -> None:
        nonlocal boilers, hint, hints
        stack.append((tag, kind == SURE, hint, main))
        opened[tag] += 1
        boilers += kind == SURE
        if kind == HINT:
            hints += 1
            hint = hints

    in_head = False
    for m in TOKEN.finditer(page):
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not in_head:
                    now.parts.append(piece)
                    if links:
                        now.linked += len(piece)
            continue
        tag = tag.lower()
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
            if not m["close"] and m["attrs"] and tag == "span" and (kind := _boiler("span", m["attrs"], main > 0)):
                cut()
                enter(tag, kind)
                now.boiler, now.hint = boilers > 0, hint
            elif m["close"] and tag == "span" and stack and stack[-1][0] == "span":
                leave(len(stack) - 1)
                cut()
            continue
        if tag == "head":
            in_head = not m["close"]
            continue
        if tag not in HEAD_TAGS:
            in_head = False
        if m["close"]:
            # An end tag without a beginning is passed over; else what it ends lies on the stack, and is taken off it.
            if opened[tag] > 0:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in VOID and not m["attrs"].endswith("/") and tag not in LOOSE:
            kind = _boiler(tag, m["attrs"], main > 0)
            enter(tag, kind)
            if not kind and _is_main(tag, m["attrs"]):
                mains += 1
                main = mains
        cut()
        now.heading = tag in HEADINGS and not m["close"]
        links = 0
        if not m["close"] and tag in ("p", "li", "td", "th", "dt", "dd") and m["attrs"] and (kind := _boiler(tag, m["attrs"], True)):
            now.boiler |= kind == SURE
            if kind == HINT:
                hints += 1
                now.hint = hints
    cut()
    good = {b.hint for b in found if b.hint and not b.boiler and density(b) == GOOD}
    for b in found:
        b.boiler |= b.hint > 0 and b.hint not in good
    return found


def density(block: Block) -> int:
    """What stop words, length and links say, whatever encloses the block."""
    text = block.text
    words = WORD.findall(text.lower())
    links = block.linked / max(1, len("".join(block.parts)))
    if links > MANY_LINKS or text[0] == "©":
        return BAD
    if len(words) < SHORT_WORDS or len(text) < LONG_CHARS:
        return BAD if links > SOME_LINKS else OPEN
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if stops >= MANY_STOPS and links <= SOME_LINKS:
        return GOOD
    # Long, with few stop words: prose of a language without a list has sentences at least.
    return OPEN if stops >= SOME_STOPS or STOP_MARK.search(text) else BAD


def first_pass(block: Block) -> int:
    """By density, but for what boilerplate encloses; what an article encloses is open where density turns it away."""
    label = density(block)
    if block.boiler:
        return BAD
    return OPEN if block.main and label == BAD else label


def second_pass(blocks: list[Block]) -> None:
    """Open blocks inherit from the nearest decided neighbours; a neighbour of the same main element counts first."""
    n = len(blocks)
    sides: list[list[tuple[int, int] | None]] = [[None] * n, [None] * n]
    same: list[list[tuple[int, int] | None]] = [[None] * n, [None] * n]
    for side, order in ((0, range(n)), (1, range(n - 1, -1, -1))):
        last = None
        last_in: dict[int, tuple[int, int]] = {}
        for i in order:
            b = blocks[i]
            sides[side][i], same[side][i] = last, last_in.get(b.main)
            if b.label != OPEN:
                last = (i, b.label)
                if not b.boiler:
                    last_in[b.main] = last
    for i, b in enumerate(blocks):
        if b.label != OPEN:
            continue
        before, after = (same if b.main else sides)[0][i], (same if b.main else sides)[1][i]
        near = [x for x in ([after] if b.heading and after else [before, after]) if x]
        if not near:
            b.label = GOOD if b.main else BAD
            continue
        best = min(abs(x - i) for x, _ in near)
        labels = {label for x, label in near if abs(x - i) == best}
        # Between the two: an article's block is its text, and so is a block of sentences.
        b.label = GOOD if labels == {GOOD} or (len(labels) > 1 and (b.main or STOP_MARK.search(b.text) is not None)) else BAD


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    for b in blocks:
        b.label = first_pass(b)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == GOOD)


def extracted(df: DataFrame, column: str = "html") -> DataFrame:
    """df with `text` and `n_chars` in place of the html column."""
    kept = [c for c in df.columns if c not in (column, "text", "n_chars")]
    fields = [f for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("_page").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    return df.select(*kept, df[column].alias("_page")).mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
