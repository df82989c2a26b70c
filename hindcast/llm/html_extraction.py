"""Main text of web pages by consensus paths of each host.

Every page scores its containers: a block of text gives its length without links to its parent and half of that to
its grandparent. The best container's path of tags and generalised classes is the page's vote. Votes are summed by
host and path in Spark (summed before the shuffle, so a hot host costs no more than its paths), and the pages are
read again with their host's winning path; a page without it uses its own best.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by
tag, role and class wherever they stand.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hindcast.llm.common import BROADCAST_ROWS, checkpointed, small_batches, spread_join, text_of

#: Fixed names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
CONTAINERS = frozenset("article main section div body td".split())
#: An opening tag of the key closes an open element of the value, up to the named border.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: What is not the article.
DROP_TAGS = frozenset("head nav header footer aside form button select option datalist noscript template iframe object svg math canvas audio video dialog menu script style textarea title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
DROP_CLASSES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus reply replies footer masthead related recommended share sharing social newsletter subscribe subscription signup popup modal overlay widget widgets pagination pager skip".split())
#: Names that begin so tell what a part has or lacks, not what it is (has-sidebar, no-comments).
ABOUT = frozenset("no not has have with without is hide show".split())
OWN_HEADERS = frozenset("article entry post story content page-title".split())

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^<>]*\Z""", re.S)
ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LEAST_BLOCK = 25


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(s)} if s and not s.isspace() else {}


def _dropped(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROP_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in DROP_ROLES:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] in ABOUT or parts[-1] == "free":
            continue
        if not DROP_CLASSES.isdisjoint(parts) or ("header" in parts and OWN_HEADERS.isdisjoint(parts)):
            return True
    return False


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A step of a generalised path: the tag and its classes, numbers made alike."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "N", c) for c in attrs.get("class", "").lower().split()})])


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(paths of the containers around it, outermost first; text; characters in links) of each block that isn't left out."""
    out: list = []
    # An open element: tag, path up to it, whether it's left out, the containers' paths around and including it.
    stack: list[tuple[str, str, bool, tuple[str, ...]]] = [("", "", False, ())]
    words: list[str] = []
    links, in_link, at, n = 0, False, 0, len(page)

    def close_block() -> None:
        nonlocal links
        if words:
            if text := " ".join(html_lib.unescape("".join(words)).split()):
                out.append((stack[-1][3], text, links))
            words.clear()
        links = 0

    def pop_to(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                close_block()
                del stack[k:]
                return

    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not stack[-1][2]:
            words.append(page[at:end])
            links += (end - at) * in_link
        if not m:
            break
        at, tag = m.end(), (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = False
            if tag in BLOCKS or stack[-1][2]:
                pop_to(tag)
            elif tag == "br":
                words.append(" ")
            continue
        attrs = _attributes(m[3] if m[2] else m[6])
        if tag == "br" or tag == "wbr":
            words.append(" " if tag == "br" else "")
        elif tag in BLOCKS:
            close_block()
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if stack[k][0] == "p" and not stack[k][2]:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
            if tag in IMPLIED:
                ends, border = IMPLIED[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in border:
                        break
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
        if tag == "a":
            in_link = True
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else n
            continue
        if tag in VOID or (m[3] or m[6] or "").endswith("/") and tag not in BLOCKS:
            continue
        above = stack[-1]
        left_out = above[2] or _dropped(tag, attrs)
        if tag in BLOCKS or left_out and (not above[2] or tag == above[0]):
            if left_out and not above[2] and tag not in BLOCKS:
                words.append(" ")
            path = f"{above[1]}>{_step(tag, attrs)}"
            stack.append((tag, path, left_out, (*above[3], path) if tag in CONTAINERS else above[3]))
    close_block()
    return out


def best_path(found: list) -> tuple[str, float]:
    """The path of the container with the highest score, and the score; ('', 0) without text in containers."""
    scores: dict[str, float] = {}
    for around, text, links in found:
        worth = max(0, len(text) - 2 * links) if len(text) >= LEAST_BLOCK else 0
        for path, share in zip(reversed(around[-2:]), (1.0, 0.5), strict=False):
            scores[path] = scores.get(path, 0.0) + worth * share * (1.5 if path.rpartition(">")[2].split(".")[0] in ("article", "main") else 1.0)
    return max(((p, s) for p, s in scores.items() if s > 0), key=lambda x: (x[1], x[0]), default=("", 0.0))


def main_text(page: str, path: str | None) -> str:
    """The blocks inside the containers at path, or inside the page's best if it has none there; all blocks if none scores."""
    found = blocks(page)
    inside = [x for x in found if path in x[0]] if path else []
    if not inside:
        own = best_path(found)[0]
        inside = [x for x in found if own in x[0]] if own else found
    return "\n".join(x[1] for x in inside)


def host(url: str = "url"):
    """The host of a URL in lower case; null or odd URLs share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """w_host, w_path, n: of each host the path with most votes (equal votes by score, then by path), and all its votes."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_path(blocks(x)) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([p for p, _ in best], pa.string()), pa.array([float(round(s)) for _, s in best], pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host().alias("host"), text_of("html").alias("html")).mapInArrow(vote, "host string, path string, score double")
    summed = votes.where("path != ''").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path"))
    all_ = F.sum("n").over(Window.partitionBy("host"))
    return summed.withColumns({"first": first, "all": all_}).where("first = 1").select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), F.col("all").alias("n"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    A null html is an empty page, with an empty text; pages without a host share one; repeated rows are extracted
    each; other columns are not read. White space of any kind becomes one space, a line break within a block too.
    """
    small_batches(pages.sparkSession)
    winners = checkpointed(winning_paths(pages))
    count, total = winners.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, p) for x, p in zip(batch.column("html").to_pylist(), batch.column("w_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), text_of("html").alias("html"), host().alias("host"))
    if count <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(winners), F.col("host") == F.col("w_host"), "left")
    else:  # pages are shuffled by host, hot hosts dealt over several tasks
        rows = spread_join(rows, winners, "host", "w_host", "n", total, "left")
    rows = rows.select("page_id", "url", "html", "w_path")
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
