"""Main text of web pages by the consensus of their hosts.

1. Each page's containers (elements that hold blocks) are scored by the text in them, links
   counted against them. The innermost one with at least nine tenths of the page's score, widened to
   those around it as long as they add nothing but text without links (a headline, a lead), is the page's vote.
   Its path is generalised: tags and classes from the top down, classes without digits.
2. Votes are counted for each host in Spark; the path with most votes (then most text, then the
   first in the alphabet) comes first, and all others with two votes or more follow: a host's other templates.
3. Every page is read again with its host's paths: the blocks in all containers on the first one, or,
   if that holds less than half of what the page's own choice does, on the own choice if other pages share it, else on the next
   path that holds as much. A choice of one page alone counts only where its host's first path holds nothing.

Blocks in menus, footers, sidebars, notices, adverts, forms and reader comments are left out, by
tag or by class, id and role, and so are page headers; a header within an article holds its headline
and stays. A class, id or role counts if its last piece is such a word (and the first does not say ``no`` or ``has``),
or if its other pieces only name a box; ``article``, ``main`` and headings are never judged by theirs. A container
with most of the page's text without links is not left out by its names if it holds an h1 or ``main``, or if less than a tenth of that text
stands outside the parts left out; if that tenth is still not reached, no names are looked at. Character references are decoded, white space within a block becomes one space, and
blocks are joined by a line feed, in page order.

Defined results: a missing, empty or textless page gives an empty text. A page cut off within a tag or a
comment loses that tag; other broken markup is read as browsers do in the main: a block ends a
paragraph, an end tag closes what is open inside it or is ignored. Rows that repeat are treated one by
one. A url without a host votes with all others like it. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableops.llm.frames import sent_if_small
from tableops.llm.texts import slices
from tableops.llm.urls import host_of
from tableops.plans.scratch import written

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CLASS = re.compile(r"""(?:^|[\s"'/])class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_TOKEN = re.compile(r"[^\s\"']+")
_DIGITS = re.compile(r"\d+")

#: Elements whose content is not markup.
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
#: Elements that stand within a line; every other one starts and ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold one block each; they are not on paths.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr caption figcaption summary address option legend center thead tbody tfoot".split())
#: Elements that are never part of an article.
APART = frozenset("nav aside form footer button select menu dialog noscript template head svg math object canvas audio video map fieldset datalist".split())
#: Words of classes, ids and roles of parts that are not the article's.
NOT_MAIN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar sidebars aside widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer footnav masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login share sharing social related recommended recommendations popular trending search hidden complementary contentinfo".split()
)
#: Pieces that may follow or precede those words, and pieces that say that the part stands beside or is missing.
BOXES = frozenset("area areas bar block blocks body box boxes button buttons container content form group holder icons inner item items left link links list menu outer panel post posts primary right secondary section slot text title unit wrap wrapper top bottom main site page cat".split())
BESIDE = frozenset("no not without has with hide".split())
#: These are the page's outside an article and its own inside.
HEADERS = frozenset(("header", "head", "hero"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Elements that are nested deeper are not on paths (their text is that of the last one that is); browsers stop there too.
DEEPEST = 512


class Block(NamedTuple):
    path: str
    text: str
    linked: int


def named(rest: str, among: frozenset[str]) -> bool:
    """Does a class, id or role of a tag name one of the parts ``among``?"""
    for value in _NAMES.findall(rest):
        for token in _TOKEN.findall(value.lower()):
            pieces = _WORD.findall(token)
            if not pieces or pieces[0] in BESIDE or among.isdisjoint(pieces):
                continue
            if pieces[-1] in among or all(x in among or x in BOXES for x in pieces):
                return True
    return False


def blocks(html: str) -> list[Block]:
    """The blocks of a page outside the parts that are not the article's, with the paths of their containers."""
    out, lost = _blocks(html)
    if not lost:
        return out
    kept = sum(len(b.text) - b.linked for b in out)
    total = kept + sum(n for n, _, outermost in lost.values() if outermost)
    large = frozenset(at for at, (n, main, _) in lost.items() if 2 * n > total and (main or 10 * kept < total))
    if large:
        out, _ = _blocks(html, large)
        kept = sum(len(b.text) - b.linked for b in out)
    return _blocks(html, None)[0] if 10 * kept < total else out


def _blocks(html: str, spared: frozenset[int] | None = frozenset()) -> tuple[list[Block], dict[int, list]]:
    """The blocks, and for each container left out by its names: text without links in it, whether it holds an h1 or main, whether it is in no other.

    ``spared`` are the places of containers whose names are not looked at; None spares all.
    """
    out: list[Block] = []
    lost: dict[int, list] = {}
    by_name: list[tuple[int, int]] = []  # depth and place of the containers that are left out by name
    apart = 0  # depth of the first one that is left out by tag, from 1
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, left out, in an article
    words: list[str] = []
    path, left_out, in_article, linked, in_link = "", False, False, 0, False
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked, in_link
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text and not left_out:
                out.append(Block(path, text, min(linked, len(text))))
            elif text and by_name and not apart:
                for _, place in by_name:
                    lost[place][0] += max(0, len(text) - linked)
            words.clear()
        linked, in_link = 0, False

    def cut(depth: int) -> None:
        nonlocal path, left_out, in_article, apart
        del stack[depth:]
        while by_name and by_name[-1][0] > depth:
            by_name.pop()
        apart = apart if apart <= depth else 0
        path, left_out, in_article = stack[-1][1:] if stack else ("", False, False)

    while at < end:
        found = _TAG.search(html, at)
        stop = found.start() if found else end
        if stop > at:
            words.append(html[at:stop])
            linked += (stop - at) * in_link
        if not found:
            break
        at = found.end()
        slash, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if tag in RAW:
            if not slash:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else end
            if tag != "textarea":
                flush()
            continue
        inline = tag in INLINE
        if tag == "br":
            words.append(" ")
            continue
        if not inline:
            flush()
            if stack and stack[-1][0] == "p":
                cut(len(stack) - 1)
        elif tag == "a":
            in_link = not slash
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    cut(i)
                    break
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        out_tag = tag in APART or tag == "header" and not in_article
        judged = "=" in rest and spared is not None and at not in spared and tag not in ARTICLE and tag not in HEADINGS
        out_name = judged and not out_tag and (named(rest, NOT_MAIN) or not in_article and named(rest, HEADERS))
        out_now = left_out or out_tag or out_name
        if tag in ("h1", "main") and not apart:
            for _, place in by_name:
                lost[place][1] = True
        if out_now:
            flush()
            in_article = in_article or tag in ARTICLE
            stack.append((tag, path, True, in_article))
            left_out = True
            if out_tag:
                apart = apart or len(stack)
            elif out_name:
                lost[at] = [0, False, not by_name]
                by_name.append((len(stack), at))
        elif not inline and tag not in LEAVES:
            classes = _CLASS.search(rest) if "=" in rest else None
            label = tag
            if classes:
                kept = sorted({c for c in _DIGITS.sub("", classes.group(1).strip("\"'").lower()).split() if c})
                label = ".".join([tag, *kept])
            if len(stack) < DEEPEST:
                path = f"{path}>{label}"
            in_article = in_article or tag in ARTICLE
            stack.append((tag, path, False, in_article))
    flush()
    return out, lost


def within(path: str, of: str) -> bool:
    return path == of or path.startswith(of + ">") or not of


def chosen(found: list[Block]) -> tuple[str, int]:
    """The path of the innermost container with nine tenths of the page's score, widened by text without links, and its score."""
    levels: list[dict[str, tuple[int, int]]] = [{}]

    def add(depth: int, path: str, gain: int, linked: int) -> None:
        levels.extend({} for _ in range(depth + 1 - len(levels)))
        score, links = levels[depth].get(path, (0, 0))
        levels[depth][path] = score + gain, links + linked

    for block in found:
        add(block.path.count(">"), block.path, len(block.text) - 2 * block.linked, block.linked)
    for depth in range(len(levels) - 1, 0, -1):
        for path, (score, linked) in levels[depth].items():
            add(depth - 1, path[: path.rfind(">")], score, linked)
    scores = {path: score for level in levels for path, (score, _) in level.items()}
    links = {path: linked for level in levels for path, (_, linked) in level.items()}
    best = ("", scores.get("", 0))
    for path, score in sorted(scores.items(), key=lambda x: (x[0].count(">"), -x[1], x[0])):
        if 10 * score >= 9 * scores[""] > 0 and within(path, best[0]):
            best = (path, score)
    around = best[0][: best[0].rfind(">")] if best[0] else ""
    while around and links[around] == links[best[0]]:
        best = (around, scores[around])
        around = around[: around.rfind(">")]
    return best


def main_text(html: str, path: str | None, others: Sequence[str] = ()) -> str:
    """The text under ``path``, its host's first, or under another one that holds the page's article."""
    found = blocks(html)
    own, most = chosen(found)

    def enough(path: str) -> bool:
        return 2 * sum(len(b.text) - 2 * b.linked for b in found if within(b.path, path)) >= most

    if path is not None and own in others and (own and within(path, own) or not enough(path)):
        path = own
    elif path is not None and not enough(path):
        path = next((x for x in others if enough(x)), path)
    kept = [b.text for b in found if within(b.path, path)] if path is not None else []
    if not kept:
        kept = [b.text for b in found if within(b.path, own)]
    return "\n".join(kept)


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The path that most pages of each host vote for, and the others with two votes or more: host, path, votes, others."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                best = [chosen(blocks(x)) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array([p for p, _ in best], pa.string()), pa.array([s for _, s in best], pa.int64())], names=["host", "path", "score"])

    texts = pages.select(F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    votes = texts.mapInArrow(vote, "host string, path string, score long").where("score > 0")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    place = F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")
    best = votes.groupBy("host").agg(F.min(place).alias("best"), F.array_sort(F.collect_list(F.when(F.col("votes") > 1, place))).alias("shared"))
    others = F.filter(F.col("shared.path"), lambda x: x != F.col("best.path"))
    return best.select("host", F.col("best.path").alias("path"), (-F.col("best.v")).alias("votes"), others.alias("others"))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, path (its host's)."""
    winners = written(host_paths(pages, url, html).select("host", "path", "others"), "host-paths")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).join(sent_if_small(winners), "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x, p, o or ()) for x, p, o in zip(*[part.column(c).to_pylist() for c in ("html", "path", "others")], strict=True)]
                made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *made, part.column("path")], names=["page_id", "url", "text", "n_chars", "path"])

    return rows.mapInArrow(read, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, path string")
