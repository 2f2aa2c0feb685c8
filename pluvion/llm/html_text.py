"""Main text of web pages by consensus host paths.

Every page scores its containers by the text they hold; the path of the best one, as tags with generalised classes,
is the page's vote. Spark sums the votes of each host. Each page is then extracted again from the container that its
host's winning paths name; a page where these hold next to nothing of its running text falls back on its own vote.

Paths travel as hashes, each made from its parent's, so a page takes memory in proportion to its length, however deep it
is. Class names are a sign, not a verdict: a name that says nothing but menu, notice, advert and the like takes an element
out, unless the element holds an article or nearly all running text of the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import table, with_fields

#: Paths with this share of a host's votes win (so at most 1 / SHARE of them).
SHARE = 0.1
#: A winning path (but of an article or main) holds at least this share of a page's running text, or the page's own vote
#: counts.
LEAST = 0.1
#: An article or main on a winning path with less running text than this is a teaser, unless it has the share LEAST.
TEASER = 200
#: On a page without article or main, an element with this share of its running text is no boilerplate, whatever its name.
MOST = 0.8

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Their text is never the article's.
DROP = frozenset(
    "head script style noscript template textarea title iframe object svg annotation annotation-xml canvas audio video nav footer header "
    "aside form button select option optgroup datalist label fieldset input dialog menu xmp noembed noframes".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr svg math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded "
    "mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mlabeledtr "
    "maction semantics annotation annotation-xml".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split()
)
CONTAINERS = frozenset("article main section div body td blockquote".split())
#: A class, id or role that has one of these words, and else only NEUTRAL ones, is not the article's.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar notice notices "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist disqus reply replies respond responses feedback discussion reactions share sharing social related recommended widget pagination pager search "
    "contentinfo complementary copyright disclaimer skip".split()
)
NEUTRAL = frozenset(
    "a an and area author bar block body bottom box card cards count button buttons by col column container first form global group inner item items "
    "last left link links list main media of on our outer page panel posts primary reader readers region right row secondary section site slot small "
    "stories sub the thread to tools top unit us user users visitor visitors wrap wrapper your".split()
)
NEVER_BOILERPLATE = frozenset("html body main article".split())
ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}


def is_boilerplate(name: str) -> bool:
    """Whether a class, id or role says nothing but boilerplate: `cookie-notice` does, `entry-header` doesn't."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    return not BOILERPLATE.isdisjoint(words) and all(w in BOILERPLATE or w in NEUTRAL for w in words)


class Page:
    """Elements and text blocks of one page."""

    def __init__(self, text: str):
        self.parent, self.tag, self.path, self.dropped, self.suspect = [-1], [""], [b""], [False], [False]
        self.holder, self.box = [0], [0]  # the nearest element that is not inline, and the nearest container
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._parse(text)
        self._judge()

    def _open(self, tag: str, attributes: str, up: int) -> int:
        names, suspect = "", False
        if attributes and "=" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                kind = m[1].lower()
                if kind not in ("class", "id", "role"):
                    continue
                value = html.unescape(m[2] or m[3] or m[4] or "")
                suspect = suspect or (tag not in NEVER_BOILERPLATE and any(map(is_boilerplate, value.split())))
                if kind == "class":
                    names = "." + ".".join(sorted(set(re.sub(r"\d+", "#", value).split())))
        inline, node = tag in INLINE, len(self.tag)
        self.parent.append(up), self.tag.append(tag), self.suspect.append(suspect and not inline)
        self.dropped.append(self.dropped[up] or tag in DROP or (inline and suspect))
        self.holder.append(self.holder[up] if inline else node)
        self.box.append(node if tag in CONTAINERS else self.box[up])
        self.path.append(self.path[up] if inline else xxhash.xxh64_digest(self.path[up] + f">{tag}{names}".encode()))
        return node

    def _parse(self, text: str) -> None:
        stack, opened, parts, links, at, block = [0], {}, [], 0, 0, 0

        def close_block():
            nonlocal parts, links
            if parts:
                joined = "".join(parts)
                joined = SPACE.sub(" ", html.unescape(joined) if "&" in joined else joined).strip()
                if joined:
                    self.blocks.append((block, joined, links))
            parts, links = [], 0

        def add(piece: str):
            nonlocal links, block
            if not self.dropped[stack[-1]]:
                if not parts:
                    block = self.holder[stack[-1]]
                parts.append(piece)
                if any(self.tag[n] == "a" for n in stack[-4:]):
                    links += len(piece)

        def pop(tag: str, stop):
            if not opened.get(tag):
                return
            for i in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[i]]
                if name == tag:
                    for node in stack[i:]:
                        opened[self.tag[node]] -= 1
                    del stack[i:]
                    return
                if name in stop:
                    return

        while True:
            m = TOKEN.search(text, at)
            if m is None:
                add(text[at:])
                break
            if m.start() > at:
                add(text[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if not (m[1] or m[4]):
                if tag == "br":
                    add(" ")
                    continue
                if tag not in INLINE and not self.dropped[stack[-1]]:  # what is dropped doesn't cut a sentence
                    close_block()
                if tag in CLOSES_P:
                    pop("p", CONTAINERS)
                if tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                    pop(tag, ("ul", "ol", "table", "dl", "select", "menu"))
                if tag in VOID:
                    continue
                node = self._open(tag, m[3] or m[6] or "", stack[-1])
                if tag in RAW:
                    end = ENDS[tag].search(text, at)
                    at = text.find(">", end.end()) + 1 if end else len(text)
                    at = at or len(text)
                    continue
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
            else:
                if tag not in INLINE and not self.dropped[stack[-1]]:
                    close_block()
                pop(tag, () if tag not in INLINE else CONTAINERS)
        close_block()

    def _judge(self) -> None:
        """Takes the blocks of suspect elements out, but of those that hold an article or nearly all running text."""
        if any(self.suspect):
            chars, article = [0] * len(self.tag), [t in ("article", "main") for t in self.tag]
            for node, text, links in self.blocks:
                chars[node] += len(text) if self._running(text, links) else 0
            for node in range(len(self.tag) - 1, 0, -1):
                chars[self.parent[node]] += chars[node]
                article[self.parent[node]] |= article[node]
            for node in range(1, len(self.tag)):
                guilty = self.suspect[node] and not article[node] and (article[0] or chars[node] < MOST * max(chars[0], 1))
                self.dropped[node] |= guilty or self.dropped[self.parent[node]]
            self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    @staticmethod
    def _running(text: str, links: int) -> bool:
        return len(text) >= 20 and links <= len(text) / 2

    def vote(self) -> int:
        """The element that holds most of the running text; 0, the page itself, if there is none."""
        scores: dict[int, float] = {}
        for node, text, links in self.blocks:
            if not self._running(text, links):
                continue
            value = 1 + text.count(",") + min(len(text) / 100, 3.0)
            weight, up = 1.0, self.box[node]
            while up > 0 and weight > 0.2:
                scores[up] = scores.get(up, 0.0) + value * weight
                weight /= 2
                up = self.box[self.parent[up]]
        if not scores:
            return 0
        best = max(scores, key=lambda n: (scores[n], -n))
        up = best
        while up > 0:  # an article's parts lie in the article
            if self.tag[up] in ("article", "main"):
                return up
            up = self.parent[up]
        return best

    def below(self, roots: set[int]) -> list[tuple[int, str, int]]:
        """Blocks below any of these elements, in page order."""
        inside = [0 in roots]
        for node in range(1, len(self.tag)):
            inside.append(node in roots or inside[self.parent[node]])
        return [b for b in self.blocks if inside[b[0]]]

    def extract(self, paths: list[bytes]) -> str:
        total = sum(len(text) for _, text, links in self.blocks if self._running(text, links))
        for path in paths:
            roots = {n for n in range(1, len(self.tag)) if self.path[n] == path and self.tag[n] not in INLINE and not self.dropped[n]}
            found = self.below(roots) if roots else []
            held = sum(len(text) for _, text, links in found if self._running(text, links))
            sure = held >= TEASER and any(self.tag[n] in ("article", "main") for n in roots)
            if found and (sure or held >= LEAST * total):
                return "\n".join(text for _, text, _ in found)
        return "\n".join(text for _, text, _ in self.below({self.vote()}))


def _votes(batches):
    for batch in batches:
        paths = []
        for text in batch.column(1).to_pylist():
            page = Page(text or "")
            paths.append(page.path[page.vote()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary())], ["host", "path"])


def _texts(batches):
    for batch in batches:
        texts = [Page(text or "").extract(paths or []) for text, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], [*batch.schema.names[2:], "text"])


def host_of(url):
    """The lower-case host of a URL column, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths with at least SHARE of the votes of pages(url, html) of a host, most votes first.

    A page without running text casts no vote. Votes are summed before they are shuffled, so a host with most of the
    pages is as light as any.
    """
    voted = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path binary")
    votes = stored(voted.where("octet_length(path) > 0").groupBy("host", "path").agg(F.count("*").alias("n")))
    total = votes.groupBy("host").agg(F.sum("n").alias("total"))
    strong = votes.join(total, "host").where(F.col("n") >= SHARE * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return strong.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text, the article's blocks joined by newlines; the whole html of every page is read, null as empty.

    Character references are decoded; white space inside a block becomes one space. Text is empty where a page has none. A
    null url, or one without a host, belongs to the host ''. Long and deep pages take memory in proportion to their length.
    A column of pages named text is replaced, all others stay whatever their names. Rows repeat as they do in pages; equal
    votes go to the path whose hash is smaller; an empty table gives an empty result.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"]
    winners = stored(winning_paths(pages))
    rows = pages.select(F.struct("html", host_of(F.col("url")).alias("host"), F.struct(*keep).alias("row")).alias("page"))
    joined = rows.join(winners, F.col("page.host") == F.col("host"), "left").select("page.html", "paths", "page.row")
    done = joined.mapInArrow(_texts, with_fields(joined.select("row"), "text string"))
    return done.select("row.*", "text")


def op6_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_consensus_paths": op6_consensus_paths}
