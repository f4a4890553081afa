"""HTML extraction by consensus: pages vote for the path of their best container, hosts take the path most voted for.

A page is read into containers (elements that hold blocks) and blocks of text. What stands in navigation, headers,
footers, sidebars, forms, notices, adverts and comments, told by tag, role or class name, counts for nothing; but a header
within an article is the article's heading. Names tell if they say nothing else (menu, site-footer, comment-list). Where an unwanted
word stands beside others (modal-logic, menu-planning), and for related, notice, side and such, the name counts against a
container only if it doesn't hold the greater part of the page's text, so that no article is lost by its name. The best container gathers the most text that is not link text.
Its path, tags and classes from the root with digits made alike, is the page's vote; Spark counts the votes of each host,
and each page is read again with its host's winning path. A page without that path falls back on its own best container.

Tags end as browsers end them: quotes count only in attributes' values, and a tag that the page's end cuts off is no text.
But a quote that is never closed ends at the next >, so that it doesn't take the rest of the page. Reading takes time in
proportion to the page, however broken.

Null and empty html give an empty text. Repeated rows each get their own row; an empty table gives none. Pages of a host that
is null or can't be told vote together as the empty host. Extra columns are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import lower_ascii, read, stored

NAME, SKIP, ATTRIBUTE, EQUALS, BARE = (re.compile(p) for p in (r"[^\s/>]+", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
#: Elements whose content is no markup, to their end tag, or else to the page's end; others that are left out whole if they end.
RAW, WHOLE = set("script style textarea title iframe xmp noembed noframes".split()), set("svg template".split())
CONTAINERS = set("html head body div section article main aside nav header footer form ul ol dl table tbody tr td th figure details fieldset noscript menu dialog center".split())
#: Elements that end the block before them.
BREAKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre blockquote figcaption address caption thead tfoot option summary legend button select".split())
UNWANTED_TAGS = set("head nav header footer aside form noscript menu dialog fieldset".split())
UNWANTED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words of class names and ids that tell what is no article.
UNWANTED_WORDS = re.compile(
    r"ads?|advert\w*|sidebar|nav|navbar|navigation|menu|footer|comments?|replies|cookies?|consent|sponsor\w*|breadcrumbs?|popup|modal"
    r"|newsletter|subscribe|signup|login|pagination|pager|outbrain|taboola"
)
#: Words that tell less, and words that stand beside them and say nothing themselves.
DOUBTFUL = set("banner side header notice notices alert alerts promo promos promotion share sharing social related recommended recommendations overlay widget widgets toolbar disclaimer copyright skip masthead aside".split())
BESIDE = set("posts post articles links link buttons button box bar block list wrap wrapper container section area inner item items stories news top bottom left right site page msg message content text col column row group panel".split())
#: Words that stand beside the unwanted ones too, and say no more.
ALSO_BESIDE = set("main primary secondary global user users reader readers my mobile desktop sticky fixed form slot unit thread tree first second".split())
#: The share of a page's text from which on a container is no side matter, whatever its doubtful name.
MAIN_SHARE = 0.5
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HINTS = {"article": 1.3, "main": 1.2}


def told_by(names: str) -> tuple[bool, bool]:
    """Whether the class names tell that a container is unwanted, and whether they only make one doubt it.

    A name tells if it is made of unwanted words and of words that say nothing; beside other words (modal-logic,
    menu-planning) an unwanted word makes a doubt, and a doubtful one says nothing.
    """
    doubt = False
    for name in names.split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if any(UNWANTED_WORDS.fullmatch(w) for w in words):
            if all(UNWANTED_WORDS.fullmatch(w) or w in DOUBTFUL or w in BESIDE or w in ALSO_BESIDE for w in words):
                return True, False
            doubt = True
        elif any(w in DOUBTFUL for w in words) and all(w in DOUBTFUL or w in BESIDE for w in words):
            doubt = True
    return False, doubt


class Tags:
    """A page's tags in order, each character looked at a fixed number of times."""

    def __init__(self, source: str):
        self.source = source
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where what comes next, or -1; once it doesn't, that is not sought again."""
        if what in self.gone:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def closing(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends, after its end tag; -1 if it has none."""
        if f"</{tag}" in self.gone:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.source, at)
        if not m:
            self.gone.add(f"</{tag}")
            return -1
        end = self.find(">", m.end())
        return len(self.source) if end < 0 else end + 1

    def attributes(self, at: int) -> tuple[int, dict[str, str]]:
        """Where the tag ends whose name ends at a place, and its attributes."""
        source, found = self.source, {}
        while True:
            at = SKIP.match(source, at).end()
            if at >= len(source):
                return at, found
            if source[at] == ">":
                return at + 1, found
            name = ATTRIBUTE.match(source, at)
            at, value = name.end(), ""
            if equals := EQUALS.match(source, at):
                at = equals.end()
                quote = source[at : at + 1]
                if quote in ("'", '"') and quote:
                    end = self.find(quote, at + 1)
                    if end < 0:
                        end = self.find(">", at + 1)
                        end = len(source) if end < 0 else end
                        value, at = source[at + 1 : end], end
                    else:
                        value, at = source[at + 1 : end], end + 1
                else:
                    end = BARE.match(source, at).end()
                    value, at = source[at:end], end
            found.setdefault(name[0].lower(), value)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, dict[str, str]]]:
        """(start, end, tag, whether it ends an element, attributes); comments and such have no tag."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            after = source[start + 1 : start + 2]
            closes = after == "/"
            first = source[start + 2 : start + 3] if closes else after
            if first.isascii() and first.isalpha():
                name = NAME.match(source, start + 1 + closes)
                tag = name[0].lower()
                end, found = self.attributes(name.end())
                if not closes and tag in RAW | WHOLE:
                    content = self.closing(tag, end)
                    end = content if content >= 0 else len(source) if tag in RAW else end
                yield start, end, tag, closes, found
            elif source.startswith("<!--", start):
                end = self.find("-->", start + 2)
                end = len(source) if end < 0 else end + 3
                yield start, end, "", False, {}
            elif after in ("!", "?", "/") and after:
                end = self.find(">", start)
                end = len(source) if end < 0 else end + 1
                yield start, end, "", False, {}
            else:
                at = start + 1
                continue
            at = end


class Page:
    """Containers as [path, parent, wanted, doubtful, score], blocks as (container, text, size of links) in page order."""

    def __init__(self, source: str | None):
        self.containers: list[list] = [["", -1, True, False, 0.0]]
        self.blocks: list[tuple[int, str, int]] = []
        self.links = 0
        self.held: list[str] = []
        self.open = [(0, "")]
        source = source or ""
        in_link, at = 0, 0
        for start, end, tag, closes, found in Tags(source):
            if start > at:
                self.text(source[at:start], in_link)
            at = end
            if tag == "a":
                in_link = 0 if closes else 1
            if tag in BREAKS:
                self.end_block()
                if tag in CONTAINERS:
                    self.leave(tag) if closes else self.enter(tag, found)
        if at < len(source):
            self.text(source[at:], in_link)
        self.end_block()
        self.weigh()

    def text(self, raw: str, in_link: int) -> None:
        if self.containers[self.open[-1][0]][2]:
            self.held.append(raw)
            self.links += in_link * len(raw)

    def end_block(self) -> None:
        if self.held:
            text = " ".join(html_lib.unescape("".join(self.held)).split())
            if text:
                self.blocks.append((self.open[-1][0], text, self.links))
            self.held, self.links = [], 0

    def enter(self, tag: str, found: dict[str, str]) -> None:
        if tag == "body":
            self.leave("head")
        up = self.open[-1][0]
        path, _, wanted, _, _ = self.containers[up]
        names, own = found.get("class", "").lower(), found.get("id", "").lower()
        step = ".".join([tag, *sorted(re.sub(r"\d+", "0", names).split())])
        named = tag not in ("html", "body", "article", "main")
        told, doubt = (told_by(f"{names} {own}") if names or own else (False, False)) if named else (False, False)
        title = tag == "header" and any(t == "article" for _, t in self.open)  # an article's own heading
        wanted = wanted and not (
            (tag in UNWANTED_TAGS and not title)
            or told
            or found.get("role", "").lower() in UNWANTED_ROLES
            or found.get("aria-hidden", "").lower() == "true"
            or HIDDEN.search(found.get("style", "").lower())
            or "hidden" in found
        )
        self.containers.append([f"{path}/{step}", up, bool(wanted), doubt, 0.0])
        self.open.append((len(self.containers) - 1, tag))

    def leave(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                return

    def weigh(self) -> None:
        """Which containers of doubtful names are wanted, and every container's score."""
        held = [0] * len(self.containers)
        for k, text, _ in self.blocks:
            held[k] += len(text)
        for k in range(len(held) - 1, 0, -1):  # parents come before what they hold
            held[self.containers[k][1]] += held[k]
        for k, c in enumerate(self.containers):
            c[2] = c[2] and (k == 0 or self.containers[c[1]][2]) and not (c[3] and held[k] < MAIN_SHARE * held[0])
        self.blocks = [b for b in self.blocks if self.containers[b[0]][2]]
        for k, text, links in self.blocks:
            worth = max(0, len(text) - 2 * links)
            for share in (1.0, 0.6, 0.3):
                self.containers[k][4] += share * worth
                k = self.containers[k][1]
                if k < 0:
                    break

    def best(self) -> tuple[str, float]:
        """The path of the container with the highest score, and the score; the outer one of equal ones."""
        worth = [c[4] * HINTS.get(c[0].rpartition("/")[2].partition(".")[0], 1.0) if c[2] else -1.0 for c in self.containers]
        k = worth.index(max(worth))
        return self.containers[k][0], worth[k]

    def within(self, path: str) -> str:
        """The text of all containers with the path."""
        inside = [False] * len(self.containers)
        for k, (own, up, wanted, _, _) in enumerate(self.containers):
            inside[k] = wanted and (own == path or (up >= 0 and inside[up]))
        return " ".join(text for k, text, _ in self.blocks if inside[k])


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, path, score)."""
    for batch in batches:
        best = [Page(x).best() for x in batch.column(1).to_pylist()]
        arrays = [batch.column(0), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "score"])


def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, path) to (page_id, url, text)."""
    for batch in batches:
        texts = []
        for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            page = Page(source)
            texts.append((page.within(path) if path is not None else "") or page.within(page.best()[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of each row."""
    host = lower_ascii(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, score double").where("score > 0")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    winner = F.max_by("path", F.struct("n", F.round("score"), "path")).alias("path")
    # A row for each host: Spark broadcasts it if it is small, and else splits the hosts that hold many pages.
    winners = stored(counted.groupBy("host").agg(winner), "host-paths")
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(reread, "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, and its length in code points."""
    return main_texts(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
