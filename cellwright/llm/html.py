"""Main text of web pages by union-free wrappers inferred for each host.

Every page is read as a stream of block elements and text.  Within a page, siblings of one label
(tag with class and id words) fold into a repeated group; across the pages of a host the streams
of children are aligned level by level, by label: what both have merges, what one lacks becomes
optional, and text that differs becomes a slot, while text that is the same on every page stays
fixed.  The outcome is a regular expression without unions, kept as a tree; at levels with more
than ``WIDTH`` labels the further siblings fold into one repeated group.  Alignment by label is
commutative and associative, so a host's wrapper does not depend on how its pages are dealt.

From the wrapper each host gets its rules.  The article is where the text of the slots is: from
the root one goes down to the child that holds most of it, over all pages of the host, as long
as one child does and no heading is left behind.  Only where this is close do names decide: a
container named or tagged as an article on that way, or one elsewhere with at least half as much
text.  Template text is what a path says alike on ``LEAST_PAGES`` different pages, and items that
``ITEM_PAGES`` pages of a group share; it goes inside the article too, unless it is most of it.
Pages that the wrapper does not describe, and hosts of a few pages, go by names first.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments outside
the article go by element or by name; an element that holds most of a page's text is none of
them, whatever its name.  In the article a name alone drops nothing: the wrapper must show that
the element is template or a group of its own, and a paragraph or heading is never dropped by
name.  Text of inline elements goes only if it is hidden.

Inference merges on the map side, then over salted groups of at most ``FAN_IN`` partial
wrappers, level by level, so no host's pages ever meet in one task.  Rules of all hosts are sent
to executors only below ``BROADCAST_BYTES``; beyond it pages are joined by host and salt.

Defined results: null and empty pages have empty text; pages without a usable url share the
host ""; very long pages are read whole, in linear time, quotes and tags left open included;
repeated rows give repeated results; columns other than page_id, url and html are not looked at,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import shared_checkpoint

FAN_IN = 64
#: Hosts that a task merges before it hands its partial wrappers on.
HOSTS_HELD = 512
BROADCAST_BYTES = 16 << 20
#: Different pages from which a node's text that never changes counts as template.
LEAST_PAGES = 4
#: The same for one item among the changing ones of a group.
ITEM_PAGES = 8
#: Children of different labels that a wrapper describes at one level, the last being a group of all further ones.
WIDTH = 256
FOLDED = "*"
#: Share of a node's slot text that one child must hold to be gone down to.
SHARE = 0.5
#: Rules are joined to pages through so many salts.
SALTS = 16

#: Elements whose text is no markup: without an end they take the rest of the page.
RAW = frozenset("script style title textarea".split())
#: Elements that go with all they hold; without an end only their start tag goes (and what svg draws).
REPLACED = frozenset("noscript template iframe svg canvas object".split())
#: What may stand in a head; anything else closes it.
HEAD = frozenset("html head base basefont bgsound link meta noscript script style template title".split())
#: Elements of HTML that end an svg element left open.
BREAKOUT = re.compile(r"<(?:/?(?:article|body|div|main|section)|address|aside|b|blockquote|br|center|code|dd|dl|dt|em|figure|footer|form|h[1-6]|header|hr|i|img|li|nav|ol|p|pre|small|span|strong|table|ul)[\s/>]|</(?:p|li|td|tr|table|ul|ol)[\s>]", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside form button select option dialog menu fieldset datalist input".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners nav navbar navigation menu "
    "menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets related recommended share sharing social cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments reply replies discussion disqus respond pagination pager toolbar copyright legal hidden skip feedback".split()
)
MAIN_WORDS = frozenset("article content post entry story main maincontent articlebody".split())
#: Elements of prose: they are no containers, and their repetition says nothing against an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote br hr dt dd td th tr".split())
HEADINGS = frozenset("h1 h2 h3".split())
LISTS = frozenset("ul ol dl li figure figcaption".split())
#: Elements whose end may be left out, and what ends them.
IMPLIED = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]),
}
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
IN_TAG = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


Token = tuple[int, int, bool, str | None, str]


def tokens(page: str) -> Iterator[Token]:
    """(start, end, closing, tag, attributes) of all tags and comments, tag None for the latter, in one pass.

    A quoted value may hold ">"; a quote that is never closed is an ordinary character.
    """
    at, unclosed = 0, set()
    while (found := OPENING.search(page, at)) is not None:
        if found[2] is None:
            comment = found[0] == "<!--"
            end = page.find("-->" if comment else ">", found.end())
            at = len(page) if end < 0 else end + (3 if comment else 1)
            if end >= 0 or comment:
                yield found.start(), at, False, None, ""
            continue
        end = found.end()
        while (mark := IN_TAG.search(page, end)) is not None and mark[1]:
            end = mark.end()
            if mark[1] not in unclosed:
                close = page.find(mark[1], end)
                if close < 0:
                    unclosed.add(mark[1])
                else:
                    end = close + 1
        if mark is None:
            return
        at = mark.end()
        yield found.start(), at, bool(found[1]), found[2].lower(), page[found.end() : mark.start()]


def label_of(tag: str, attributes: str) -> tuple[str, int]:
    """An element's label, and 2 if it is furniture by its tag or hidden, 1 if by a word of its names, else 0."""
    if not attributes or attributes.isspace():
        return tag, 2 * (tag in FURNITURE)
    words: set[str] = set()
    hidden = False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name in ("class", "id", "role"):
            words.update(WORDS.findall(value))
        else:
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(HIDING.search(value))
    comment = tag == "article" and "comment" in words and MAIN_WORDS.isdisjoint(words - {"article"})
    return ".".join([tag, *sorted(words)]), 2 if tag in FURNITURE or hidden or comment else int(by_word(tag, words))


def by_word(tag: str, words: Iterable[str]) -> bool:
    return tag not in ("body", "html", "article", "main") and tag not in PROSE and not FURNITURE_WORDS.isdisjoint(words)


def is_main(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in ("article", "main") or tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words)


Block = tuple[tuple[str, ...], int, str, tuple[int, ...]]


def read_page(page: str | None) -> list[Block]:
    """The blocks of a page in order: labels of the open elements, drop level (as of ``label_of``), raw text, numbers of the elements.

    An element that is furniture by a word only, but named as an article too or holding most of
    the text, is none.
    """
    blocks: list[Block] = []
    if not page:
        return blocks
    tags: list[str] = []
    labels: list[str] = []
    numbers: list[int] = []
    hard: list[bool] = []
    worded: dict[int, int] = {}  # text of the elements that are furniture by a word
    inline_dropped: list[str] = []
    run: list[str] = []
    at, skip, until = 0, None, 0
    ends: dict[str, dict[int, int]] = {}  # of replaced elements, by where their content starts

    def end_of(tag: str, start: int) -> int | None:
        if tag not in ends:
            opened, ends[tag] = [], {}
            for _, end, closing, name, attributes in tokens(page):
                if name != tag:
                    continue
                if closing:
                    if opened:
                        ends[tag][opened.pop()] = end
                elif not attributes.endswith("/"):
                    opened.append(end)
        return ends[tag].get(start)

    def close() -> None:
        for open_elements in (tags, labels, numbers, hard):
            open_elements.pop()

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            if not text.isspace():
                blocks.append((tuple(labels), 2 * (bool(hard) and hard[-1]), text, tuple(numbers)))

    for start, end, closing, tag, attributes in tokens(page):
        if skip is not None:  # inside raw text only its own end counts
            if tag is None or not closing or tag != skip:
                continue
            skip, at = None, end
            continue
        if start < until:  # inside a replaced element
            continue
        if start > at and not inline_dropped:
            if tags and tags[-1] == "head" and not page[at:start].isspace():
                flush()
                close()
            run.append(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if tag in INLINE:
                if inline_dropped and inline_dropped[-1] == tag:
                    inline_dropped.pop()
            elif tag in tags:
                flush()
                while True:
                    last = tags[-1]
                    close()
                    if last == tag:
                        break
            else:
                flush()
            continue
        if tags and tags[-1] == "head" and tag not in HEAD:
            flush()
            close()
        if tag in REPLACED:
            if not attributes.endswith("/"):
                over = end_of(tag, at)
                if over is None and tag == "svg":
                    shown = BREAKOUT.search(page, at)
                    over = shown.start() if shown else len(page)
                at = until = at if over is None else over
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                over = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if over is None:
                    at = len(page)
                    break
                skip = tag
                at = until = over.start()
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                run.append(" " if tag == "br" else "")
            elif inline_dropped or label_of(tag, attributes)[1] == 2:
                inline_dropped.append(tag)
            continue
        flush()
        inline_dropped.clear()
        while tags and tag in IMPLIED.get(tags[-1], ()):
            close()
        if tag in VOID or attributes.endswith("/"):
            continue
        label, level = label_of(tag, attributes)
        if tag == "header" and any(map(is_main, labels)):
            level = 2 * hidden_by(attributes)
        if level == 1 and not is_main(label):
            worded[at] = 0
        tags.append(tag)
        labels.append(label)
        numbers.append(at)
        hard.append(level == 2 or tag == "head" or bool(hard) and hard[-1])
    if skip is None and at < len(page) and not inline_dropped:
        run.append(page[at:])
    flush()
    if not worded:
        return blocks
    total = 0
    for _, level, text, inside in blocks:
        if not level:
            total += len(text)
            for number in inside:
                if number in worded:
                    worded[number] += len(text)
    furniture = {number for number, size in worded.items() if 2 * size <= total}
    return [(labels, level or int(not furniture.isdisjoint(inside)), text, inside) for labels, level, text, inside in blocks]


def hidden_by(attributes: str) -> bool:
    return label_of("", attributes)[1] == 2


# A wrapper's node: [label, repeated, optional, text, children by label, items, contexts, size]; text
# is null for none, true for a slot, else the digest of the fixed text.  Items are the digests that
# every page with the node has in it; contexts are the ``ITEM_PAGES`` smallest digests of what those
# pages say (inside a named article: of what the article says), so that copies of one page count
# once.  Size is the number of characters of the node's own text on all pages, without furniture.


def new_node(label: str) -> list:
    return [label, False, False, None, {}, [], [], 0]


def digest(*texts: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest("\n".join(texts))


def page_tree(blocks: list[Block]) -> list:
    root = new_node("")
    inside = [any(map(is_main, labels)) for labels, *_ in blocks]
    whole = digest(*(text for _, level, text, _ in blocks if not level))
    article = digest(*(text for main, (_, level, text, _) in zip(inside, blocks, strict=True) if main and level < 2))
    last: dict[int, int] = {}  # the element that a node was last met in
    for labels, level, text, numbers in blocks:
        node, main = root, False
        root[6] = [whole]
        for label, number in zip(labels, numbers, strict=True):
            main = main or is_main(label)
            found = node[4].get(label)
            if found is None:
                found = node[4][label] = new_node(label)
            elif last[id(found)] != number:
                found[1] = True
            last[id(found)] = number
            node = found
            node[6] = [article if main else whole]
        mark = digest(text)
        node[3] = mark if node[3] is None or node[3] == mark else True
        node[5].append(mark)
        if not level:
            node[7] += len(text)
    return settled(root)


def settled(node: list) -> list:
    node[5] = sorted(set(node[5]))
    node[4] = folded({label: settled(child) for label, child in node[4].items()})
    return node


def merge(one: list, other: list) -> list:
    """The wrapper of both: children aligned by label merge, others become optional, differing texts slots."""
    children = {}
    for label in one[4].keys() | other[4].keys():
        a, b = one[4].get(label), other[4].get(label)
        if a is not None and b is not None:
            children[label] = merge(a, b)
        else:
            c = a or b
            children[label] = [c[0], c[1], True, *c[3:]]
    text = one[3] if one[3] == other[3] else True
    if one[3] is None or other[3] is None:
        text = one[3] if other[3] is None else other[3]
    items = one[5] if one[5] == other[5] else sorted(set(one[5]) & set(other[5]))
    contexts = sorted({*one[6], *other[6]})[:ITEM_PAGES]
    return [one[0], one[1] or other[1], one[2] or other[2], text, folded(children), items, contexts, one[7] + other[7]]


def split_label(label: str) -> tuple[str, list[str]]:
    tag, *words = label.split(".")
    return tag, words


def folded(children: dict[str, list]) -> dict[str, list]:
    """At most ``WIDTH`` children: those of the smallest label digests, the others one repeated group of unlike siblings.

    A label that is among the smallest of all pages is so on each page, so the order of merging
    does not matter.
    """
    if len(children) <= WIDTH:
        return children
    named = sorted((label for label in children if label != FOLDED), key=lambda label: (digest(label), label))
    rest = [children[label] for label in named[WIDTH - 1 :]] + [c for label, c in children.items() if label == FOLDED]
    group = rest[0]
    for child in rest[1:]:
        group = merge(group, child)
    return {label: children[label] for label in named[: WIDTH - 1]} | {FOLDED: [FOLDED, True, True, *group[3:]]}


def varies(node: list) -> bool:
    return node[3] is True or any(map(varies, node[4].values()))


def lists(node: list) -> bool:
    """Whether a node holds a repeated group other than plain prose."""
    return any(c[1] and split_label(c[0])[0] not in PROSE or lists(c) for c in node[4].values())


def slot_sizes(node: list, sizes: dict[int, int]) -> int:
    """Characters of text that is not template in a node and below, noted in ``sizes`` for every node."""
    fixed = isinstance(node[3], str) and len(node[6]) >= LEAST_PAGES
    total = (0 if fixed else node[7]) + sum(slot_sizes(c, sizes) for c in node[4].values())
    sizes[id(node)] = total
    return total


def article_paths(wrapper: list) -> set[tuple[str, ...]]:
    """Paths of the host's article containers, see the module docstring; none if it is the whole page."""
    sizes: dict[int, int] = {}
    slot_sizes(wrapper, sizes)
    node, path, way = wrapper, (), []
    while True:
        titled = any(split_label(c[0])[0] in HEADINGS and sizes[id(c)] for c in node[4].values())
        below = [c for c in node[4].values() if c[0] != FOLDED and split_label(c[0])[0] not in PROSE | LISTS]
        best = max(below, key=lambda c: (sizes[id(c)], c[0]), default=None)
        if titled or best is None or not sizes[id(best)] or sizes[id(best)] < SHARE * sizes[id(node)]:
            break
        node, path = best, (*path, best[0])
        way.append(path)
    named: dict[tuple[str, ...], int] = {}

    def walk(at: list, to: tuple[str, ...]) -> None:
        for child in at[4].values():
            here = (*to, child[0])
            if is_main(child[0]):
                named[here] = sizes[id(child)]
            else:
                walk(child, here)

    walk(wrapper, ())
    on_way = [p for p in way if p in named]
    if on_way:
        chosen, size = on_way[0], named[on_way[0]]
    elif split_label(path[-1] if path else "")[0] in ("", "html", "body"):
        chosen, size = None, 0
    else:
        chosen, size = path, sizes[id(node)]
    others = {p for p, n in named.items() if n and 2 * n >= size and p != chosen}
    if chosen is None or chosen in named:
        tagged = {p for p in others | ({chosen} if chosen else set()) if split_label(p[-1])[0] in ("article", "main")}
        return tagged or others | ({chosen} if chosen else set())
    return others or {chosen}


def rules(wrapper: list) -> dict:
    """What pages need of the wrapper, as a tree of children "c" by label.

    "m": an article container.  "f": digests of template text: of a node whose text never
    changes, on ``LEAST_PAGES`` different pages or more, and of the items of a group that all of
    at least ``ITEM_PAGES`` different pages have.  "x": an element in an article with a furniture
    word that is no part of it: on ``LEAST_PAGES`` different pages or more, and never changing,
    repeated, or holding a repeated group other than prose.  A wrapper without any slot, as of a
    host with copies of one page, says nothing about template.
    """
    chosen = article_paths(wrapper)

    def walk(node: list, path: tuple[str, ...], inside: bool, template: bool) -> dict:
        out: dict = {}
        if path in chosen:
            out["m"] = 1
            inside, template = True, varies(node)
        elif inside and by_word(*split_label(node[0])) and len(node[6]) >= LEAST_PAGES and (template and not varies(node) or node[1] or lists(node)):
            out["x"] = 1
        if template:
            if isinstance(node[3], str) and len(node[6]) >= LEAST_PAGES:
                out["f"] = [node[3]]
            elif node[5] and len(node[6]) >= ITEM_PAGES:
                out["f"] = node[5]
        below = {label: walk(child, (*path, label), inside, template) for label, child in node[4].items()}
        if not below.get(FOLDED):  # else all names are needed, to tell which ones are folded
            below = {label: rule for label, rule in below.items() if rule}
        return out | {"c": below} if below else out

    return walk(wrapper, (), False, varies(wrapper))


def place(labels: tuple[str, ...], rule: dict) -> tuple[bool, frozenset[str], bool]:
    """Of a path: whether it lies in an article container, its template texts, and whether it is furniture in the article."""
    main, at, gone = False, rule, False
    for label in labels:
        below = at.get("c", {})
        at = below.get(label, below.get(FOLDED, {}))
        main = main or "m" in at
        gone = gone or "x" in at
    return main, frozenset(at.get("f", ())), gone


def main_text(page: str | None, rule: dict | None) -> str:
    """The article's text: the blocks in article containers, else all, without furniture and template."""
    blocks = read_page(page)
    known = {labels: place(labels, rule or {}) for labels in {b[0] for b in blocks}}
    inside = [known[labels][0] for labels, *_ in blocks]
    if not any(inside):  # no wrapper, or a page that it does not describe
        named = [[x for x in labels if is_main(x)] for labels, *_ in blocks]
        tagged = any(split_label(x)[0] in ("article", "main") for found in named for x in found)
        inside = [any(not tagged or split_label(x)[0] in ("article", "main") for x in found) for found in named]
    article = any(inside)
    read = []
    for keep, (labels, level, text, _) in zip(inside, blocks, strict=True):
        _, fixed, gone = known[labels]
        if (keep or not article) and level < (2 if keep else 1) and not gone:
            read.append((fixed, text))
    left = [text for fixed, text in read if not fixed or digest(text) not in fixed]
    if article and 2 * sum(map(len, left)) < sum(len(text) for _, text in read):
        left = [text for _, text in read]  # what is most of an article is no template in it
    out = (" ".join(entities.unescape(text).split()) for text in left)
    return "\n".join(t for t in out if t)


def host_of(url: Column) -> Column:
    """Lower-case host of a url, "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages): the inferred wrapper of each host as JSON."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list, int]] = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["html"], strict=True):
                tree = page_tree(read_page(page))
                before = held.get(host)
                held[host] = (merge(before[0], tree), before[1] + 1) if before else (tree, 1)
            if len(held) > HOSTS_HELD:
                yield table(held)
                held = {}
        yield table(held)

    def table(held: dict[str, tuple[list, int]]) -> pd.DataFrame:
        return pd.DataFrame([(h, json.dumps(w), n) for h, (w, n) in held.items()], columns=["host", "wrapper", "pages"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "wrapper"])
        wrapper = None
        for text in rows["wrapper"]:
            wrapper = json.loads(text) if wrapper is None else merge(wrapper, json.loads(text))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper)], "pages": [int(rows["pages"].sum())]})

    schema = "host string, wrapper string, pages long"
    partial = shared_checkpoint(pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInPandas(infer, schema))
    while True:
        most = partial.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return partial
        groups = -(-most // FAN_IN)
        dealt = partial.withColumn("part", F.pmod(F.xxhash64("wrapper", "pages", F.monotonically_increasing_id()), F.lit(groups)))  # any dealing gives one wrapper
        partial = shared_checkpoint(dealt.groupBy("host", "part").applyInPandas(join, schema))


def host_rules(found: DataFrame) -> DataFrame:
    """(host, rule): what a page of the host needs, as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [json.dumps(rules(json.loads(w))) for w in batch["wrapper"]]
            yield pd.DataFrame({"host": batch["host"], "rule": made})

    return found.mapInPandas(run, "host string, rule string")


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""
    rule = shared_checkpoint(host_rules(wrappers(pages)))
    size = rule.agg(F.sum(F.octet_length("rule") + F.octet_length("host"))).first()[0] or 0
    keys = ["host"]
    if size <= BROADCAST_BYTES:
        rule = F.broadcast(rule)
    else:  # a host may hold a third of all pages
        keys.append("salt")
        rule = rule.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, text in zip(batch["html"], batch["rule"], strict=True):
                if text is not None and text not in known:
                    known = {} if len(known) > 10_000 else known
                    known[text] = json.loads(text)
                texts.append(main_text(page, known.get(text)))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    rows = rows.join(rule, keys, "left").select("page_id", "url", "html", "rule")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
