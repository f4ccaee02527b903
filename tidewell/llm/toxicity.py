"""Toxicity scores by a counterfactual-regularised classifier (operator 9)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.llm.shared import slices, text_bytes, written

# Identity terms by language; terms of one list stand for each other in a swap.
IDENTITY = (
    ("women", "men", "muslims", "christians", "jews", "immigrants", "gays", "lesbians", "blacks", "whites", "asians"),
    ("woman", "man", "muslim", "christian", "jewish", "immigrant", "gay", "lesbian", "black", "white", "asian"),
    ("frauen", "männer", "muslime", "christen", "juden", "einwanderer", "schwule", "lesben"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "homosexuels", "lesbiennes"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "homosexuales", "lesbianas"),
)
GROUP = {term: group for group in IDENTITY for term in group}
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
BATCH_BYTES = 2_000_000


def features(word: str) -> list[str]:
    """The word itself and its prefixes, marked with a star."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if k <= len(word))]


def counted(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def swapped(words: Counter[str]) -> list[Counter[str]]:
    """Versions of a sentence with every identity term replaced: by the next of its list, and by the one after."""
    if not words.keys() & GROUP.keys():
        return []
    out = []
    for step in (1, 2):
        new: Counter[str] = Counter()
        for w, n in words.items():
            group = GROUP.get(w)
            new[group[(group.index(w) + step) % len(group)] if group else w] += n
        out.append(new)
    return out


class Classifier:
    """Logistic regression on log counts of words and word prefixes."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, list[str]] = {}

    def logit(self, words: Counter[str]) -> float:
        found: Counter[str] = Counter()
        for w, n in words.items():
            parts = self.known.get(w)
            if parts is None:
                if len(self.known) > 400_000:
                    self.known = {}
                parts = self.known[w] = [f for f in features(w) if f in self.weights] or NONE
            for f in parts:
                found[f] += n
        return self.bias + sum(self.weights[f] * math.log1p(n) for f, n in found.items())

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(counted(text))))))


NONE: list[str] = []


def bag(words: Counter[str], wanted: dict[str, int] | None = None) -> Counter:
    """Counts of a sentence's features; with ``wanted``, of those by their number."""
    out: Counter = Counter()
    for w, n in words.items():
        for f in features(w):
            if wanted is None:
                out[f] += n
            elif f in wanted:
                out[wanted[f]] += n
    return out


def shares(labelled: DataFrame) -> DataFrame:
    """``feature, toxic, clean``: in how many toxic and clean documents each feature is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES // 4):
            sums: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                sums[toxic].update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
            names = sorted(sums[0].keys() | sums[1].keys())
            counts = [pa.array([sums[y][f] for f in names], pa.int64()) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["feature", "toxic", "clean"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def chosen(counts: DataFrame, n1: int, n0: int, least_z: float, least_docs: int) -> list[str]:
    """Features whose share of documents differs between the labels by ``least_z`` standard errors, and identity terms."""
    p = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    error = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    far = F.abs(F.col("toxic") / n1 - F.col("clean") / n0) >= least_z * error
    rows = counts.where(((F.col("toxic") + F.col("clean") >= least_docs) & (error > 0) & far) | F.col("feature").isin(*GROUP))
    return sorted(r["feature"] for r in rows.select("feature").collect())


def vectors(labelled: DataFrame, names: list[str]) -> DataFrame:
    """``toxic, at, value`` and, per swap of identity terms, ``gaps`` (at, value): the changes of the log counts."""
    column = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = counted(text)
                logs = {f: math.log1p(n) for f, n in bag(own, column).items()}
                gaps = []
                for other in swapped(own):
                    new = {f: math.log1p(n) for f, n in bag(other, column).items()}
                    gap = {f: d for f in new.keys() | logs.keys() if (d := new.get(f, 0.0) - logs.get(f, 0.0))}
                    gaps.append({"at": list(gap), "value": list(gap.values())})
                out.append({"toxic": toxic, "at": list(logs), "value": list(logs.values()), "gaps": gaps})
            yield pa.RecordBatch.from_pylist(out, schema=VECTOR)

    return labelled.select("text", "toxic").mapInArrow(run, "toxic int, at array<int>, value array<double>, gaps array<struct<at:array<int>,value:array<double>>>")


CELLS = [("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]
VECTOR = pa.schema([("toxic", pa.int32()), *CELLS, ("gaps", pa.list_(pa.struct(CELLS)))])


def solve(rows: list, names: list[str], penalty: float, ridge: float, steps: int) -> Classifier:
    """Minimise log loss + ``penalty`` * mean squared change of the logit under swaps + ``ridge`` * squared weights."""
    labels = np.array([r["toxic"] for r in rows], np.float64)
    gaps = [g for r in rows for g in r["gaps"]]

    def matrix(items: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.repeat(np.arange(len(items)), [len(x["at"]) for x in items])
        return i, np.array([c for x in items for c in x["at"]], np.int64), np.array([v for x in items for v in x["value"]], np.float64)

    x, d = matrix(rows), matrix(gaps)
    w, bias, m = np.zeros(len(names)), math.log(labels.mean() / (1 - labels.mean())), len(rows)
    step, speed, rate = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0.1
    for t in range(1, steps + 1):
        z = np.bincount(x[0], x[2] * w[x[1]], m) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        change = np.bincount(d[0], d[2] * w[d[1]], max(1, len(gaps)))
        slope = np.bincount(x[1], x[2] * error[x[0]], len(names)) / m + 2 * ridge * w
        slope += 2 * penalty * np.bincount(d[1], d[2] * change[d[0]], len(names)) / max(1, len(gaps))
        both = np.append(slope, error.mean())
        step, speed = 0.9 * step + 0.1 * both, 0.999 * speed + 0.001 * both**2
        move = rate * (step / (1 - 0.9**t)) / (np.sqrt(speed / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Classifier({f: float(v) for f, v in zip(names, w, strict=True) if v}, float(bias))


def learn(
    docs: DataFrame, labels: DataFrame, most_rows: int = 8_000, penalty: float = 1.0, ridge: float = 1e-5, least_z: float = 5.0, least_docs: int = 5, steps: int = 500
) -> Classifier:
    """Fit on at most ``most_rows`` labelled documents, the first by a hash of doc_id.

    Features are counted and chosen by Spark; only the sample's vectors over the chosen ones reach the driver.
    Rows with a null label or text are left out. Without rows of both kinds the score is the share of toxic rows for
    every text, 0 when there are none.
    """
    marked = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # The hash picks the sample from labels alone, so that texts of other rows aren't moved.
    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most_rows)
    rows = written(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic"))
    n = rows.agg(F.count("*").alias("all"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n1, n0 = n["toxic"], n["all"] - n["toxic"]
    if not n1 or not n0:
        share = n1 / max(1, n["all"])
        return Classifier({}, math.log((share + 1e-9) / (1 - share + 1e-9)))
    names = chosen(shares(rows), n1, n0, least_z, least_docs)
    names = sorted({*names, *GROUP})
    return solve(vectors(rows, names).collect(), names, penalty, ridge, steps)


def toxicity(docs: DataFrame, model: Classifier, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score, predicted`` (replacing columns of these names) for every whole text; 1 from ``threshold`` on.

    Null and empty texts get the model's bias as score. Repeated rows get a result each. One narrow stage: columns
    that aren't needed are best dropped before, as every column passes through the tasks' batches.
    """
    base = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            scores = pa.array([shared.value.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    kinds = StructType([*base.schema.fields, StructField("score", DoubleType())])
    return base.mapInArrow(run, kinds).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
