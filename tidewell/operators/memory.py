"""What a chat remembers: each answered question becomes an item of its store or joins the one it resembles."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import state
from tidewell.operators.retrieval import MEMORY

# Items of a store, least score of a merge, least lengths, lines and sources kept, an answer that says nothing.
MOST_ITEMS, MERGE_SCORE, LEAST_QUESTION, LEAST_ANSWER, MOST_LINES, MOST_SOURCES = 200, 0.72, 8, 40, 6, 8
NO_ANSWER = "문서에서는 답을 만들지 못했습니다"
TOKEN = re.compile(r"[가-힣]{2,}|[A-Za-z0-9_.:/-]{2,}")
K1, B, FLOOR = 1.5, 0.75, 0.25


def token_list(text: str) -> list[str]:
    return TOKEN.findall(text.lower()) or ["empty"]


def gram_set(text: str) -> set[str]:
    joined = re.sub(r"\s+", "", text.lower())
    return {joined[k : k + 2] for k in range(max(1, len(joined) - 1))} - {""}


def okapi(asked: list[str], counts: list[Counter]) -> list[float]:
    """Okapi scores of a store's items; a negative idf becomes ``FLOOR`` of the mean idf."""
    df = Counter(word for c in counts for word in c)
    idf = {word: math.log((len(counts) - n + 0.5) / (n + 0.5)) for word, n in df.items()}
    low = FLOOR * sum(idf.values()) / len(idf)
    sizes = [c.total() for c in counts]
    mean = sum(sizes) / len(sizes)
    weight = {word: low if idf[word] < 0 else idf[word] for word in asked if word in idf}
    return [sum(weight.get(w, 0.0) * c[w] * (K1 + 1) / (c[w] + K1 * (1 - B + B * n / mean)) for w in asked) for c, n in zip(counts, sizes, strict=True)]


def indexed(item: dict) -> dict:
    """An item with the words and grams of its question and similar lines, counted once per change."""
    text = " ".join([item["question"], *item["similar"]])
    return item | {"counts": Counter(token_list(text)), "grams": gram_set(text)}


def nearest(question: str, items: list[dict]) -> tuple[float, int]:
    """Blended score and place of the item most like a question, of ties the last."""
    asked, grams = token_list(question), gram_set(question)
    raw = okapi(asked, [i["counts"] for i in items])
    top = max(raw) or 1.0
    share = lambda mine, theirs: len(mine & theirs) / len(mine) if mine else 0.0
    parts = ((r / top, share(grams, i["grams"]), share(set(asked), i["counts"].keys())) for r, i in zip(raw, items, strict=True))
    return max((sum(w * p for w, p in zip(MEMORY, three, strict=True)), k) for k, three in enumerate(parts))


def tidy_lines(lines: list[str], question: str) -> list[str]:
    """Different lines of 8 to 180 characters other than the question, the first six."""
    tidy = (re.sub(r"\s+", " ", x).strip(" \"'`") for x in lines)
    return list(dict.fromkeys(x for x in tidy if 8 <= len(x) <= 180 and x != question.strip()))[:MOST_LINES]


def remember(now: object, values: tuple) -> tuple[object, tuple]:
    """A step of ``state.folded``: values (question, answer, similar, sources); ``number, item_id, merged, question, similar, answer, sources`` of the item, nulls if nothing is kept.

    ``number`` counts a store's items; ``item_id`` is numbered within what the store holds at the time, so it repeats once the store is full.
    """
    made, items = now or (0, [])
    question, answer = ((x or "").strip() for x in values[:2])
    similar, sources = ([] if x is None else [y for y in x if y is not None] for x in values[2:])
    if len(question) < LEAST_QUESTION or len(answer) < LEAST_ANSWER or answer.startswith(NO_ANSWER):
        return (made, items), (None, None, False, None, None, None, None)
    score, at = nearest(question, items) if items else (0.0, 0)
    merged = score >= MERGE_SCORE
    if merged:
        old = items[at]
        item = old | {"similar": tidy_lines([question, *similar, *old["similar"]], old["question"])}
        if len(answer) > len(old["answer"]):
            item |= {"answer": answer, "sources": sources[:MOST_SOURCES]}
        items = [*items[:at], indexed(item), *items[at + 1 :]]
    else:
        made += 1
        item = {"number": made, "item_id": f"m{len(items) + 1:04d}", "question": question, "similar": tidy_lines(similar, question), "answer": answer, "sources": sources[:MOST_SOURCES]}
        items = [*items, indexed(item)][-MOST_ITEMS:]
    return (made, items), (item["number"], item["item_id"], merged, item["question"], item["similar"], item["answer"], item["sources"])


def remembered(exchanges: DataFrame, store: str, order: list[str]) -> DataFrame:
    """Every exchange (``question, answer, similar, sources``) with the item it became or joined, in the order of its store.

    A store's exchanges depend on each other and stream through one task in order; its state is 200 items at most.
    """
    rows = exchanges.withColumns({"asked": F.col("question"), "said": F.col("answer"), "alike": F.col("similar"), "named": F.col("sources")})
    kinds = "number bigint, item_id string, merged boolean, question string, similar array<string>, answer string, sources array<string>"
    return state.folded(rows.drop("question", "answer", "similar", "sources"), store, order, ["asked", "said", "alike", "named"], remember, kinds).drop("asked", "said", "alike", "named")


def stored(rows: DataFrame, store: str, order: list[str]) -> DataFrame:
    """The items a store holds after its exchanges: the last 200, each as its latest exchange left it."""
    last = F.row_number().over(Window.partitionBy(store, "number").orderBy(*(F.desc(c) for c in order)))
    newest = F.row_number().over(Window.partitionBy(store).orderBy(F.desc("number")))
    items = rows.where("number is not null").withColumn("_n", last).where("_n = 1").withColumn("_n", newest).where(F.col("_n") <= MOST_ITEMS)
    return items.select(store, "number", "item_id", "question", "similar", "answer", "sources")
