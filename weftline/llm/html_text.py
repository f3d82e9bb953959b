"""Main text of web pages; what a host repeats on its pages is told by a suffix array."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.suffix_dedup import merged, repeats
from weftline.llm.workers import map_batches
from weftline.session import materialize

#: A run of so many words on two pages of a host is boilerplate, unless an article element holds it.
MIN_WORDS, GRAM = 8, 4

# Fixed values of HTML.
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)"""
    r"""|<[!?/A-Za-z][^>]*(?:>|\Z)""",  # declarations, and tags with an open quote
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: Elements that never belong to the article, and words in class, id or role that tell the same.
_CHROME = set(
    "nav footer aside form script style noscript template iframe svg canvas object button select option menu dialog head "
    "textarea title".split()
)
_CHROME_WORDS = set(
    "nav navbar navigation menu sidebar sidebars footer header masthead banner cookie cookies consent gdpr notice notices "
    "alert ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments "
    "respond disqus share sharing social related breadcrumb breadcrumbs pagination popup modal overlay newsletter "
    "subscribe subscription signup login search toolbar widget skip complementary contentinfo".split()
)
#: Words in class or id of an element that holds the article where no ``article`` or ``main`` does.
_CONTENT_WORDS = set("article post story entry content".split())
#: How strongly a zone claims to be the article; the strongest on a page is it.
_CLAIMS = {"chrome": -1, "plain": 0, "content": 1, "main": 2, "article": 3}
_SPLIT = re.compile(r"[^A-Za-z]+")


def _zone(name: str, attributes: str, parent: str) -> str:
    """The zone, one of _CLAIMS, of an element below one of zone ``parent``."""
    if parent == "chrome" or name in _CHROME or name == "header" and parent == "plain":
        return "chrome"
    found: set[str] = set()
    if attributes and "=" in attributes:
        for match in _ATTRIBUTE.finditer(attributes):
            key = match[1].lower()
            value = match[2] or match[3] or match[4] or ""
            if key in ("class", "id", "role"):
                for one in value.lower().split():
                    found.update(w for w in _SPLIT.split(one) if w) if key != "role" else found.add(one)
    if parent != "plain":  # an article has a header of its own
        found -= {"header", "masthead"}
    if name in ("body", "html"):
        return parent
    if found & _CHROME_WORDS:
        return "chrome"
    own = "plain"
    if name == "article":
        own = "article"
    elif name == "main" or "main" in found:
        own = "main"
    elif found & _CONTENT_WORDS:
        own = "content"
    return max(parent, own, key=_CLAIMS.__getitem__)


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; white space is one space, references are decoded."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()  # elements on the stack by name, so that an end tag without one costs nothing
    zone, at, size = "plain", 0, len(page)

    def close() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((zone, text))
            parts.clear()

    while at < size:
        match = _TAG.search(page, at)
        if match is None:
            parts.append(page[at:])
            break
        if match.start() > at:
            parts.append(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        name, ends = match[2].lower(), bool(match[1])
        if name not in _INLINE:
            close()
        if ends:
            if opened[name]:
                while stack:
                    held, _ = stack.pop()
                    opened[held] -= 1
                    if held == name:
                        break
                now = stack[-1][1] if stack else "plain"
                if now != zone:
                    close()
                    zone = now
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else size
        if name in _CLOSES_P and opened["p"]:  # an open paragraph ends here, with what it left open
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    if stack[k][1] != zone:
                        close()
                    opened.subtract(held for held, _ in stack[k:])
                    del stack[k:]
                    zone = stack[-1][1] if stack else "plain"
                    break
                if stack[k][0] not in _INLINE:
                    break
        if name in _VOID or match[3].endswith("/") and name not in _RAW:
            continue
        inner = _zone(name, match[3], stack[-1][1] if stack else "plain")
        if inner != zone:
            close()
        stack.append((name, inner))
        opened[name] += 1
        zone = inner
    close()
    return out


#: What becomes of a block: it is no part of the article, the host's runs in it go, or it stays as it is.
_OUT, _JUDGED, _KEPT = 0, 1, 2


def _parsed(page: str | None) -> tuple[str, list[int], list[int]]:
    """All blocks of a page as lines, where each ends in words, and what becomes of each (_OUT, _JUDGED or _KEPT)."""
    lines, ends, verdicts, words = [], [], [], 0
    found = blocks(page or "")
    best = max((_CLAIMS[zone] for zone, _ in found), default=0)
    for zone, text in found:
        lines.append(text)
        words += len(text.split(" "))
        ends.append(words)
        if zone == "chrome" or _CLAIMS[zone] < best:
            verdicts.append(_OUT)
        else:
            verdicts.append(_KEPT if best >= _CLAIMS["main"] else _JUDGED)
    return "\n".join(lines), ends, verdicts


def unique_runs(lines: str, ends: list[int], verdicts: list[int], passages: list[tuple[int, int]]) -> str:
    """The article among ``lines``: blocks that stay as they are, and the others without the words that the host repeats."""
    repeated = set()
    for first, last in passages:
        repeated.update(range(first, last))
    kept, begin = [], 0
    for line, end, verdict in zip(lines.split("\n"), ends, verdicts, strict=False):
        if verdict != _OUT:
            kept += [w for k, w in enumerate(line.split(" "), begin) if verdict == _KEPT or k not in repeated]
        begin = end
    return " ".join(kept)


_PARSED = "page_id long, url string, row long, host long, lines string, ends array<int>, verdicts array<int>"


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    All blocks of a host's pages are laid end to end in a suffix array, those of articles too; word runs of MIN_WORDS
    that two pages of the host share are boilerplate. Markup checks what the array marks: it tells which blocks can be the
    article (those in ``article``, else in ``main``, else in an element called ``content`` or the like, else all) and
    which are not (menus, footers, forms, adverts, comments and the like, by element, class, id or role). What the elements
    ``article`` and ``main`` hold stays whole; a name alone proves less, so other blocks lose the host's runs.
    Blocks are joined in page order by one space.

    A null or empty page has an empty text; a null url is a host of its own;
    pages of a host with the same html are one page, whatever their ids and urls, so they are no
    evidence against each other, and each gives a row. No rows give no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.xxhash64(host, F.coalesce("html", F.lit(""))).alias("row"),
        F.xxhash64(host).alias("host"),
        "html",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                found = list(zip(*[_parsed(page) for page in batch.column(4).to_pylist()], strict=True))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                columns = [pa.array(v, t) for v, t in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["page_id", "url", "row", "host", "lines", "ends", "verdicts"])

    parsed = materialize(map_batches(rows, run, _PARSED), "blocks", compression="zstd")
    # Copies of a page are told from others by their row, whatever ids stand around them.
    streams = parsed.select("row", F.col("row").alias("doc"), F.col("host").alias("scope"), F.col("lines").alias("text"))
    runs = merged(repeats(streams, MIN_WORDS, GRAM)).select("row", "passages")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                unique_runs(lines, ends, verdicts, [(p["first"], p["last"]) for p in passages or []])
                for lines, ends, verdicts, passages in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    judged = parsed.join(runs, "row", "left").select("page_id", "url", "lines", "ends", "verdicts", "passages")
    texts = map_batches(judged, finish, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op6_host_suffix_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_host_suffix_text": op6_host_suffix_text}
