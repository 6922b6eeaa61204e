"""Operator 6 - main text of pages by consensus container paths.

Each page's containers are scored by the paragraphs they hold; the best one
votes, with its score, for its generalised path (tags with their classes, digits
and order left out).  Votes are summed per host in Spark and every host's first
path wins.  Pages are then extracted again from the containers on the winning
path; a page without it uses its own best.

Votes are pre-aggregated, so a host gives one row for each of its paths.  The
winners are broadcast where they measure ``BROADCAST_BYTES`` or less, and pages
stay where they are; else hosts with more than one in ``cluster.HOT`` of all
pages are broadcast, which are few, and the others are joined by a shuffle.

A page is read once from left to right.  Each element knows whether it is on
the winning path so far, what it lies in and the nearest list or table part
above it, so work grows with the page and not with its depth.

A block is the text between two block-level tags; character references are
decoded, white space inside it is one space, empty blocks go, blocks are joined
by one newline.  Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments are known by tag, role, class or id.

Cases: null html is empty (text ''); a null url or one without ``://`` has the
host ''; unclosed and crossed tags end with what holds them; rows that repeat a
page_id are each extracted; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import join_hot, materialise

BROADCAST_BYTES = 32 << 20
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
#: Elements and roles that are never main text.
OFF_TAGS = frozenset("head nav aside footer form menu dialog select button fieldset option optgroup".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of classes and ids that mark what is not main text.
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner sidebar sidebars aside menu menus submenu"
    " nav navbar navigation topnav breadcrumb breadcrumbs crumbs footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing"
    " social follow related recommended recommendations newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices notification alert popup modal"
    " overlay widget widgets pagination pager search searchbox form skip copyright legal disclaimer tags taglist hidden paywall outbrain taboola".split()
)
MAIN_WORDS = frozenset("article main content body post entry story text".split())
ENDS = {  # what an opening tag ends, up to the element that holds both
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_SCOPES = tuple(dict.fromkeys(ENDS.values()))
_SCOPE_OF = {tag: _SCOPES.index(way) for tag, way in ENDS.items()}
_SCOPED = frozenset(tag for ends, until in _SCOPES for tag in ends | until)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(eq=False)
class Element:
    tag: str
    step: str  # tag and classes, generalised
    off: bool
    parent: Element | None
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    depth: int = 0
    on: bool = True  # its path is the winning one as far as it goes
    near: tuple = ()  # for each scope the nearest element, itself included, that ends there or that is ended
    inside: bool = False
    dead: bool = False
    under: bool = False

    @property
    def path(self) -> str:
        steps, e = [], self
        while e is not None:
            steps.append(e.step)
            e = e.parent
        return ">".join(reversed(steps))


def _element(tag: str, raw: str, parent: Element | None) -> Element:
    off, classes = tag in OFF_TAGS or bool(parent and parent.off), []
    if raw.strip(" /\n\t\r"):
        for name, value in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), entities.unescape(value.strip("\"'"))
            if name in ("class", "id"):
                words = _WORD.findall(_CAMEL.sub(" ", value).lower())
                if name == "class":
                    classes += [re.sub(r"[\d>]+", "", c) for c in value.lower().split()]
                if not off and tag not in ("html", "body", "article", "main") and not OFF_WORDS.isdisjoint(words):
                    off = True
            elif name == "role" and value.lower() in OFF_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                off = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                off = True
    step = tag + "".join("." + c for c in sorted({c for c in classes if c}))
    return Element(tag, step, off, parent)


def parse(text: str, path: str | None = None) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """Block-level elements in page order, and blocks: (element, text, characters in links); elements are held against ``path``."""
    steps = path.split(">") if path else []
    top: Element | None = None
    open_: Counter[str] = Counter()  # tags from the top to the root
    endless: set[str] = set()  # tags whose end does not come any more
    everything: list[Element] = []
    blocks: list[tuple[Element, str, int]] = []
    run: list[str] = []
    linked, link, quiet = 0, 0, 0  # quiet: depth in inline elements that are not main text
    inline: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal linked
        if run:
            own = " ".join("".join(run).split())
            if own:
                blocks.append((top, own, min(linked, len(own))))
            run.clear()
        linked = 0

    def text_at(s: str) -> None:
        nonlocal linked
        if not quiet and s:
            s = entities.unescape(s)
            run.append(s)
            if link:
                linked += len(s.strip())

    def close_to(e: Element) -> None:
        nonlocal top
        while top is not e:
            open_[top.tag] -= 1
            top = top.parent

    root = Element("", "", False, None, depth=1, near=(None,) * len(_SCOPES))
    top = root
    at, size = 0, len(text)
    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            text_at(text[at:])
            break
        if m.start() > at:
            text_at(text[at : m.start()])
        at = m.end()
        closing, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not raw.rstrip().endswith("/") and tag not in endless:
                end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(text, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else size if tag in ("script", "style", "textarea", "title", "iframe") else at
            continue
        if tag in BLOCK:
            flush()
            link, quiet = 0, 0
            inline.clear()
            if closing:
                if open_[tag]:
                    e = top
                    while e.tag != tag:
                        e = e.parent
                    close_to(e.parent)
                continue
            if tag in ENDS:
                ends, until = ENDS[tag]
                scope = _SCOPE_OF[tag]
                e, to = top.near[scope], top
                while e is not None and e.tag not in until:
                    to = e.parent
                    e = to.near[scope]
                close_to(to)
            else:
                while top.tag == "p":  # a block ends an open paragraph
                    close_to(top.parent)
            if tag in VOID:
                continue
            new = _element(tag, raw, top)
            new.depth = top.depth + 1
            new.on = top.on and new.depth <= len(steps) and new.step == steps[new.depth - 1]
            new.near = tuple(new if tag in ends or tag in until else above for (ends, until), above in zip(_SCOPES, top.near, strict=True)) if tag in _SCOPED else top.near
            everything.append(new)
            open_[tag] += 1
            top = new
            continue
        if tag == "br":
            if not quiet:
                run.append(" ")
            continue
        if tag in VOID:
            continue
        if closing:
            for i in range(len(inline) - 1, -1, -1):
                if inline[i][0] == tag:
                    for name, off in inline[i:]:
                        quiet -= off
                        link -= name == "a"
                    del inline[i:]
                    break
        elif not raw.rstrip().endswith("/"):
            off = _element(tag, raw, None).off
            inline.append((tag, off))
            quiet += off
            link += tag == "a"
    flush()
    return everything, blocks


def _mark(elements: list[Element], chosen: set[Element]) -> None:
    """Which elements hold main text below one of ``chosen``; of a header there, its headings."""
    for e in elements:
        above = e.parent
        if e in chosen:
            e.inside = True
        elif above.inside:
            e.inside, e.dead = True, above.dead or e.off
            e.under = e.tag == "header" or e.tag not in HEADINGS and above.under


def best_container(elements: list[Element], blocks) -> Element | None:
    """The element with most paragraph text that is not links; the earlier one of equals."""
    for e, own, linked in blocks:
        if e.off or e.tag in ("", "header"):
            continue
        value = 1 + own.count(",") + min(len(own) / 100, 3)
        p, share = e, 1.0
        if e.tag in HEADINGS or e.tag in ("p", "pre", "blockquote", "li", "td", "dd", "dt"):
            p = e.parent
        while p is not None and p.tag and share > 0.1:
            p.score += value * share
            p.chars += len(own)
            p.linked += linked
            share /= 2
            p = p.parent
    best, most = None, 0.0
    for e in elements:
        if e.off or e.tag == "header" or not e.score:
            continue
        words = set(_WORD.findall(e.step))
        value = e.score * (1 - e.linked / max(e.chars, 1)) + (25 if e.tag in ("article", "main") else 5 if not MAIN_WORDS.isdisjoint(words) and e.tag != "body" else 0)
        if value > most:
            best, most = e, value
    if best is not None:
        best.score = most
    return best


def extract(text: str, path: str | None = None) -> str:
    """Main text from the containers on ``path``; without such, from the page's own best."""
    elements, blocks = parse(text, path)
    goal = path.count(">") + 1 if path else 0
    on = [e for e in elements if e.on and e.depth == goal and not e.off] if path else []
    if not on:
        own = best_container(elements, blocks)
        if own is None:  # text without containers
            return "\n".join(b for e, b, _ in blocks if e.tag == "")
        on = [own]
    _mark(elements, set(on))
    return "\n".join(own for e, own, _ in blocks if e.inside and not e.dead and not e.under)


def vote(text: str) -> tuple[str, float] | None:
    own = best_container(*parse(text))
    return (own.path, own.score) if own is not None else None


def host_of(url):
    """The url's host as a Column: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()), F.lit(""))


def _texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _vote(batches):
    """Each page's host, and the path and score of its best container; nulls where it has none."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            own = batch.slice(lo, 256)
            found = [vote(x) or (None, None) for x in _texts(own.column(1))]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], names=["host", "path", "score"])


def _again(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            own = batch.slice(lo, 256)
            text = [extract(x, p) for x, p in zip(_texts(own.column(2)), own.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), own.column(3)], names=["page_id", "url", "text", "n_chars", "path"]
            )


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, score, votes, pages: the winning path of each host (null where no page of it has a container), and how many pages it has."""
    ballots = pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(_vote, "host string, path string, score double")
    # scores as whole hundredths, so that sums do not depend on their order
    votes = ballots.groupBy("host", "path").agg(F.sum(F.round(F.col("score") * 100).cast("long")).alias("score"), F.count("*").alias("votes"))
    # the first of (score, votes, path), as the least of a struct: one row for each path of a host comes together in part sums
    best = F.min_by(F.struct("path", "score", "votes"), F.struct((-F.coalesce("score", F.lit(-1))).alias("s"), (-F.col("votes")).alias("n"), "path"))
    return votes.groupBy("host").agg(best.alias("best"), F.sum("votes").alias("pages")).select("host", "best.*", "pages")


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (that of the host, if any page of it had a container)."""
    winners = materialise(host_paths(pages).select("host", "path", "pages"))
    size, total = winners.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("path"), F.lit(0)) + 32), F.sum("pages")).first()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    if (size or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        joined = join_hot(rows, winners, "host", F.col("pages"), int(total), "left")
    kind = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "path").mapInArrow(_again, f"page_id {kind}, url string, text string, n_chars long, path string")
