"""Main text of web pages by the maximum-scoring subsequence of words and tags (operator 13)."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.llm.shared import slices

BATCH_BYTES = 4 << 20
#: Labelled pages that the weights are learnt from, about.
SAMPLE = 4000
#: Bounds of a weight, in natural logarithms of odds.
LEAST, MOST = 0.05, 8.0
#: Weights of words and tags that no labelled page has.
UNSEEN_WORD, UNSEEN_TAG = 1.0, -0.25
#: Weight of the tags that mark the main text themselves: a region that crosses one must gain 25 sure words by it.
EDGE = -25 * MOST

# The elements of HTML by what they do.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button datalist title".split())
APART = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "aside", "form": "form", "dialog": "notice", "head": "head"}
LABEL = frozenset(["article", "main"])
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
KNOWN = INLINE | VOID | BLOCKS
#: Elements that end when one of their kind begins.
SIBLINGS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Block elements before which an open paragraph ends.
ENDS_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Words in class, id or role that tell what a part of a page is for.
PURPOSES = {
    "ad": "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager tabs toc",
    "header": "header masthead topbar",
    "footer": "footer contentinfo copyright",
    "aside": "sidebar aside complementary related recommended share sharing social widget",
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription paywall",
    "form": "form login signup search",
    "comments": "comment comments commentlist discussion replies reply respond disqus",
}
PURPOSE_OF = {word: purpose for purpose, words in PURPOSES.items() for word in words.split()}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
HINT = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def purpose(name: str, hints: str, labelled: bool) -> tuple[str | None, bool]:
    """What a part of a page is for, if not for its main text, and whether an element of main text within it changes nothing; ``labelled``: it lies in such an element."""
    if name in APART:
        return APART[name], True
    if name == "header" and not labelled:
        return "header", False
    if not hints or name in LABEL or name in ("body", "html"):
        return None, False
    for found in HINT.finditer(hints):
        kind, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and re.search(r"display\s*:\s*none", value):
            return "hidden", True
        if kind in ("class", "id", "role"):
            for word in PART.findall(CAMEL.sub(" ", value).lower()):
                if word in PURPOSE_OF and not (labelled and PURPOSE_OF[word] == "header"):
                    return PURPOSE_OF[word], PURPOSE_OF[word] == "comments"
    return None, False


def pieces(page: str) -> Iterator[tuple[str, str | None, bool, bool]]:
    """The page in order: ``(kind, text, block, labelled)``.

    ``kind`` of a text is the block element around it, that of a tag, which has no text, its name, with ``/`` in front if it ends; after a colon comes the
    purpose of the part it lies in, if that isn't the main text. ``block``: a tag that parts blocks. ``labelled``: within an element that marks the main text.
    """
    open_: list[tuple[str, str | None, bool]] = []
    labels, at, size, find = 0, 0, len(page), TAG.search

    def kind(name: str | None = None, what: str | None = None) -> str:
        if open_:
            name, what = name or open_[-1][0], what or open_[-1][1]
        return f"{name or 'body'}:{what}" if what else name or "body"

    def close(i: int) -> None:
        nonlocal labels
        labels -= sum(name in LABEL for name, _, _ in open_[i:])
        del open_[i:]

    while at < size:
        tag = find(page, at)
        if tag is None:
            yield kind(), page[at:], False, labels > 0
            return
        if tag.start() > at:
            yield kind(), page[at : tag.start()], False, labels > 0
        at = tag.end()
        name = tag[2] or tag[5]
        if name is None:
            continue
        name, ends, hints = name.lower(), (tag[1] or tag[4]) == "/", tag[3] or tag[6] or ""
        block = name not in INLINE
        if not ends and name in UNREAD:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else size
            yield kind(name, "unread"), None, block, labels > 0
            continue
        if ends:
            yield kind(f"/{name}"), None, block, labels > 0 and name not in LABEL
            # An end without a beginning ends nothing.
            i = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None) if name in BLOCKS else None
            if i is not None:
                close(i)
            continue
        if name not in BLOCKS or name in VOID or hints.endswith("/"):
            yield kind(name), None, block, labels > 0
            continue
        if open_ and (open_[-1][0] in SIBLINGS.get(name, ()) or open_[-1][0] == "p" and name in ENDS_P or (open_[-1][0], name) == ("head", "body")):
            close(len(open_) - 1)
        what, firm = open_[-1][1:] if open_ else (None, False)
        if name in LABEL and not firm:
            what = None
        elif not what:
            what, firm = purpose(name, hints, labels > 0)
        yield f"{name}:{what}" if what else name, None, block, labels > 0
        open_.append((name, what, firm))
        labels += name in LABEL


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights of words by the element around them (``w `` in front) and of tags (``t ``), from about ``sample`` labelled pages.

    Pages are labelled by their ``article`` and ``main`` elements; the sample is drawn by a hash of page_id. A word's weight is the logarithm of its odds of lying
    in the main text, at least ``LEAST``; a tag's that of lying outside, taken negative. The table has a row per name that HTML knows, whatever the pages hold. Without labelled pages: an empty table, and the fixed weights hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page_bytes, BATCH_BYTES):
            counts: dict[str, list[int]] = {}
            for page in batch.column("html").to_pylist():
                found = list(pieces(page))
                if not any(labelled for *_, labelled in found):
                    continue
                for kind, text, _, labelled in found:
                    n = 1 if text is None else len(text.split())
                    if n and kind.removeprefix("/") in KNOWN - LABEL:
                        counts.setdefault(f"w {kind}" if text else f"t {kind}", [0, 0])[labelled] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([x[i] for x in counts.values()], pa.int64()) for i in (0, 1))], ["key", "outside", "inside"])

    total = pages.count()
    chosen = pages.where("html is not null")
    if total > sample:
        chosen = chosen.where(F.pmod(F.xxhash64("page_id"), F.lit(total)) < sample)
    rows = chosen.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "key string, outside long, inside long")
    out = {}
    for key, outside, inside in rows.groupBy("key").agg(F.sum("outside"), F.sum("inside")).collect():
        odds = math.log((inside + 1) / (outside + 1))
        out[key] = min(max(odds, LEAST), MOST) if key[0] == "w" else max(min(odds, -LEAST), -MOST)
    return out


def score(kind: str, text: str | None, weights: dict[str, float]) -> float:
    """A piece's score: words positive, tags negative; words and tags never seen have fixed weights. A part with another purpose is left out anyway, so it counts almost nothing."""
    if ":" in kind:
        return 0.0 if text else -LEAST
    if text is None and kind.removeprefix("/") in LABEL:
        return EDGE
    return len(text.split()) * weights.get(f"w {kind}", UNSEEN_WORD) if text else weights.get(f"t {kind}", UNSEEN_TAG)


def main_text(page: str, weights: dict[str, float]) -> str:
    """The blocks of the best contiguous region of ``page``, one to a line.

    One scan keeps the best sum that ends at each piece and starts anew where it would be negative. Parts of the region that have another purpose are left out.
    """
    found = list(pieces(page))
    best = now = 0.0
    start, region = 0, (0, 0)
    for i, (kind, text, _, _) in enumerate(found):
        if now <= 0:
            now, start = 0.0, i
        now += score(kind, text, weights)
        if now > best:
            best, region = now, (start, i + 1)
    blocks, held = [], []
    for kind, text, block, _ in [*found[slice(*region)], ("/body", None, True, False)]:
        if text is not None:
            if ":" not in kind:
                held.append(text)
        elif block:
            if words := html.unescape("".join(held)).split():
                blocks.append(" ".join(words))
            held = []
        elif kind in ("br", "/br"):
            held.append(" ")
    return "\n".join(blocks)


def page_bytes(batch: pa.RecordBatch) -> list[int]:
    return pc.binary_length(batch.column("html")).fill_null(0).to_pylist()


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points; they replace columns of the same name.

    Character references are decoded, white space within a block is one space, blocks are joined by newlines. Null and empty pages, and pages of menus
    alone, give an empty text. Pages without any tag are one block. Pages of any length are read whole; repeated rows give equal texts. Empty table: no rows.
    """
    base = pages.drop("text", "n_chars")
    rows = base.select(F.struct(*(F.col(f"`{c}`") for c in base.columns if c != "html")).alias("row"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page_bytes, BATCH_BYTES):
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("html"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "html", "text", "n_chars"])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
    return out.select(*(F.col("html") if c == "html" else F.col(f"row.`{c}`") for c in base.columns), "text", "n_chars")
