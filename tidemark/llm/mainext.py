"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags.  Words score 1, tags at most 0, by what
was learned from labelled pages, those whose markup names their only article:
how often a tag (with its class, and with the block it stands in) is outside of
the article.  Blocks that labelled pages have outside only make the words
within them score a little less than 0, and so does text directly in such a
block as ``body``.  One linear scan finds the best contiguous region.  Words
that score below 0 are left out of it (adverts, notices, forms, comments),
references are decoded and white space is evened.

What no labelled page has shown goes by more general evidence: the tag and its
class in any block, and at last what HTML itself says of ``nav``, ``footer``,
``aside``, ``form`` and the like, and the few class names that mean just that.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_workers, rows_of, table

# HTML's own elements.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics annotation svg g path tspan".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SILENT = "script|style|template|title|textarea|select|iframe|object|canvas|audio|video|head"
#: By HTML's definition not part of the content around them; counts where labelled pages don't say.
ASIDE = frozenset("nav footer aside form button dialog menu".split())
ROLES = frozenset("=navigation =banner =contentinfo =complementary =search =form =dialog =alert".split())
NAMED = frozenset("ad ads advert advertisement sidebar comments notice".split())

PIECES = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SILENT})(?=[\s/>])(?![^>]*/>)[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """Texts (kind ""), opening ("<") and closing (">") tags; tags with their name and their sorted classes, ids and roles (after "=")."""
    at = 0
    for m in PIECES.finditer(html):
        if m.start() > at:
            yield "", html[at : m.start()], ""
        at = m.end()
        if name := m[3] or m[6]:
            named = sorted({"=" * (what.lower() == "role") + w for what, *v in NAMES.findall(m[4] or m[7] or "") for w in "".join(v).lower().split()})
            yield ">" if (m[2] or m[5]) else "<", name.lower(), ".".join(w.replace("<", "") for w in named)
    if at < len(html):
        yield "", html[at:], ""


class Open:
    """The open elements, as a browser would keep them: a closing tag ends all that were opened since its own."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str]] = []  # name, key

    def enter(self, name: str, named: str) -> str:
        """Opens an element; its key tells tag, classes and the tag of the block around it."""
        key = f"{name}.{named}<{self.block()[0]}"
        if name not in VOID:
            self.stack.append((name, key))
        return key

    def leave(self, name: str) -> str:
        """Closes an element; the key it was opened with, a bare one if it wasn't."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                key = self.stack[i][1]
                del self.stack[i:]
                return key
        return f"{name}.<"

    def block(self) -> tuple[str, str]:
        return next((x for x in reversed(self.stack) if x[0] not in INLINE), ("", ""))


def anywhere(key: str) -> str:
    """A key without the block around it."""
    return key.partition("<")[0]


def label(html: str) -> tuple[list[tuple[str, str, str]], int, int] | None:
    """Tokens, and first and last one of the only article, without its own tags; None if the page doesn't say."""
    page = list(tokens(html))
    opens = [i for i, t in enumerate(page) if t[:2] == ("<", "article")]
    closes = [i for i, t in enumerate(page) if t[:2] == (">", "article")]
    return (page, opens[0] + 1, closes[0]) if len(opens) == len(closes) == 1 and opens[0] < closes[0] else None


def evidence(html: str) -> Iterator[tuple[str, int]]:
    """Of a labelled page: a key and whether it is outside of the article (1), inside (0), or open around it (2), once for each element.

    What stands within an element that is outside says nothing of its own.
    """
    gold = label(html)
    if gold is None:
        return
    page, first, last = gold
    open_, at = Open(), []
    for i, (kind, name, named) in enumerate(page[:first]):
        if kind == "<":
            open_.enter(name, named)
            at += [i] * (name not in VOID)
        elif kind:
            open_.leave(name)
            del at[len(open_.stack) :]
    around = set(at)
    yield from ((key, 2) for _, key in open_.stack)
    open_, outer = Open(), 0  # so many elements are open down to the outermost outside one
    for i, (kind, name, named) in enumerate(page):
        if kind == "<":
            key = open_.enter(name, named)
            if first <= i < last:
                yield key, 0
            elif i not in around and not outer:
                yield key, 1
                outer = len(open_.stack) if name not in VOID else 0
        elif kind:
            open_.leave(name)
            if len(open_.stack) < outer:
                outer = 0


@dataclass
class Weights:
    """How often labelled pages have a key inside and outside of articles, and which are open around articles."""

    inside: Counter = field(default_factory=Counter)
    outside: Counter = field(default_factory=Counter)
    around: frozenset = frozenset()

    LEAST = 3  # elements that say something of a key
    WORD = -0.05  # outside of articles: low enough never to be taken in, high enough to pass over to what follows
    UNKNOWN = 0.4

    def __post_init__(self) -> None:
        self.shares: dict[str, float] = {}
        for key in self.inside.keys() | self.outside.keys():
            n = self.inside[key] + self.outside[key]
            if n >= self.LEAST:
                self.shares[key] = (self.outside[key] + 0.1) / (n + 0.2)

    def share(self, key: str) -> float:
        """How surely an element is outside of articles."""
        own, _, block = key.partition("<")
        name, _, named = own.partition(".")
        if key in self.shares:
            return self.shares[key]
        if named and own in self.shares:
            return self.shares[own]
        words = frozenset(named.split("."))
        if name in ASIDE or words & ROLES or words & NAMED or name == "header" and block in ("body", "html", ""):
            return 0.95
        return self.UNKNOWN

    def tag(self, key: str) -> float:
        return -0.02 - max(0.0, 2 * self.share(key) - 1)

    def shuns(self, key: str) -> bool:
        """Whether all that is within the element is outside of articles."""
        return self.share(key) > 0.9 and key not in self.around and not key.startswith(("article.", "main.", "body.", "html."))

    def bare(self, key: str) -> bool:
        """Whether text directly in the element is outside of articles, as in what stands around them."""
        return key in self.around and not key.startswith("article.")


def scored(html: str, weights: Weights) -> Iterator[tuple[str, str, float, bool]]:
    """Kind, text or tag name, score, and whether it is unwanted, of each token."""
    open_, shunned = Open(), 0  # so many elements are open down to the outermost unwanted one
    for kind, name, named in tokens(html):
        if not kind:
            out = bool(shunned) or weights.bare(open_.block()[1])
            yield kind, name, (weights.WORD if out else 1.0) * len(name.split()), out
            continue
        if kind == "<":
            key = open_.enter(name, named)
            if not shunned and name not in VOID and weights.shuns(key):
                shunned = len(open_.stack)
            yield kind, name, 0.0 if shunned else weights.tag(key), bool(shunned)
        else:
            was = bool(shunned)
            key = open_.leave(name)
            if len(open_.stack) < shunned:
                shunned = 0
            yield kind, name, 0.0 if was else weights.tag(key), was


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous scores of the greatest sum, the first of equal ones; (0, 0) if none is positive."""
    best, sum_, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        sum_ += s
        if sum_ <= 0:
            sum_, start = 0.0, i + 1
        elif sum_ > best:
            best, found = sum_, (start, i + 1)
    return found


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the best region in order, without unwanted ones."""
    page = list(scored(html or "", weights))
    first, last = region([t[2] for t in page])
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if s := " ".join(htmllib.unescape("".join(run)).split()):
            blocks.append(s)
        run.clear()

    for kind, name, _, out in page[first:last]:
        if kind and name not in INLINE:
            end()
        elif not kind and not out:
            run.append(name)
    end()
    return " ".join(blocks)


def fit(pages: DataFrame, sample: int = 1000) -> Weights:
    """Weights from at most ``sample`` different pages that mark one article (those of least hash, with their copies); without any, general ones.

    A key counts once a page; ties between hashes can't split copies.
    """
    on_workers(pages.sparkSession)
    rows = pages.where(F.lower("html").contains("<article")).select("html", F.xxhash64("html").alias("h"))
    # Only hashes are ordered; texts stay where they are read.
    cut = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    if cut is None:
        return Weights()
    rows = rows.where(F.col("h") <= cut).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (part,) in rows_of(batches, "html"):
            for h in part:
                counts.update({(k, where) for key, where in set(evidence(h)) for k in {key} | ({anywhere(key)} if where != 2 else set())})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["k", "place", "n"])

    # What fewer than LEAST pages show says nothing, so as many keys are left as the sample's pages have in common.
    got = rows.mapInArrow(run, "k string, place int, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
    got = got.join(got.groupBy("k").agg(F.sum("n").alias("all")).where(F.col("all") >= Weights.LEAST), "k").collect()
    inside, outside = (Counter({r["k"]: r["n"] for r in got if r["place"] == w}) for w in (0, 1))
    return Weights(inside, outside, frozenset(r["k"] for r in got if r["place"] == 2))


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``; null and empty pages, and such without words, have empty text.

    Very long pages are read whole; of equally good regions the first counts;
    repeated rows are told each; an empty table gives no rows; other columns
    are ignored.
    """
    shared = on_workers(pages.sparkSession).sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, part in rows_of(batches, "page_id", "url", "html"):
            texts = [main_text(h, shared.value) for h in part]
            cols = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``, weights from those of them that mark their article; edge cases as in ``fit`` and ``extracted``."""
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
