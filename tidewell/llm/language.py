"""Language identification by cross-parsing entropy (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import slices, text_bytes

CLASSES = 64
#: Digits of spelled letters.
BASE = CLASSES // 2
BLOCK = 2048
BATCH_BYTES = 4_000_000
UNKNOWN = "und"


def letters(text: str, place: dict) -> np.ndarray:
    """The text as letter classes: 0 between words, runs of it joined; a letter without a class is as ``class_table`` says."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table, digits = place["table"], place["digits"]
    codes = table[np.minimum(points, len(table) - 1)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    if digits:
        spelled = codes >= CLASSES
        sizes = np.where(spelled, digits, 1)
        at, rank = (np.cumsum(sizes) - sizes)[spelled], codes[spelled] - CLASSES
        codes = np.repeat(codes, sizes)
        for k in range(digits):
            codes[at + k] = BASE + (rank // BASE ** (digits - 1 - k)) % BASE
    return codes.astype(np.uint8)


def class_table(samples: list[str]) -> tuple[np.ndarray, int]:
    """Classes of code points, and the digits of letters without a class of their own; 0 if there are none.

    Up to 62 letters: one class each, and letters that the samples lack share the last. Beyond, the most frequent 31 have one each
    and every other letter is spelled as so many digits of base 32, classes 32 to 63, so that no two letters of the
    samples look alike in any script; letters that the samples lack share one spelling. Spelled letters have ``CLASSES`` plus a number in the table.
    """
    points = np.frombuffer("".join(samples).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found, n = np.unique(points, return_counts=True)
    own = [p for p in found[np.lexsort((found, -n))] if p < 0x30000 and chr(p).isalpha()]
    fits = len(own) <= CLASSES - 2
    single, others = (own, []) if fits else (own[: BASE - 1], own[BASE - 1 :])
    last = CLASSES - 1 if fits else CLASSES + len(others)
    table = np.array([last if chr(p).isalpha() and not 0xD800 <= p < 0xE000 else 0 for p in range(0x30000)] + [0], np.int32)
    table[single] = np.arange(1, len(single) + 1)
    table[others] = CLASSES + np.arange(len(others))
    digits = 0
    while not fits and BASE**digits <= len(others):
        digits += 1
    return table, digits


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nexts


def transitions(samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One table for all languages: entry ``state * CLASSES + class`` is the next state's row start times 2.

    Its lowest bit says that the longest match ended there: the next state is then the root's successor, or for
    a class that the language lacks a last state, behind which every step starts a new phrase.
    """
    rows, roots, base = [], [], 0
    for codes in samples:
        nexts = automaton(codes)
        nexts.append({})
        root = np.full(CLASSES, base + len(nexts) - 1, np.int64)
        for c, s in nexts[0].items():
            root[c] = base + s
        table = np.repeat(root[None, :] * CLASSES * 2 + 1, len(nexts), 0)
        table[0] -= 1
        for s, to in enumerate(nexts):
            if to:
                table[s, list(to)] = (np.fromiter(to.values(), np.int64) + base) * CLASSES * 2
        rows.append(table.astype(np.int32))
        roots.append(base * CLASSES * 2)
        base += len(nexts)
    return np.concatenate(rows).ravel(), np.array(roots, np.int32)


def phrases(texts: list[np.ndarray], table: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Number of longest-match phrases of each text in each language, shape (texts, languages).

    Texts are cut into blocks of ``BLOCK`` letters, at whose ends a phrase ends too; all blocks are walked in step.
    """
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // BLOCK) for t in texts])
    flat = np.concatenate([np.zeros(0, np.uint8), *texts])
    first, sizes = [], []
    at = 0
    for t in texts:
        for k in range(0, len(t), BLOCK):
            first.append(at + k)
            sizes.append(min(BLOCK, len(t) - k))
        at += len(t)
    out = np.zeros((len(texts), len(roots)), np.int64)
    if not first:
        return out
    sizes, first = np.array(sizes), np.array(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, first, owner = sizes[order], first[order], owner[order]
    steps = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    state = np.repeat(roots[:, None], len(sizes), 1)
    found = np.zeros((len(roots), len(sizes)), np.int32)
    for t in range(int(sizes[0])):
        n = int(steps[t])
        s = table[(state[:, :n] >> 1) + flat[first[:n] + t]]
        found[:, :n] += s & 1
        state[:, :n] = s
    np.add.at(out, owner, found.T + 1)
    return out


class Model:
    """Labelled sample text per language, its automata, and the table of letter classes."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        table, digits = class_table([samples[x] for x in self.names])
        self.place = {"table": table, "digits": digits}
        codes = [letters(samples[x], self.place) for x in self.names]
        self.bits = np.log2(np.array([max(2, len(c)) for c in codes]))
        self.table, self.roots = transitions(codes) if codes else (np.zeros(CLASSES, np.int32), np.zeros(0, np.int32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [letters(t or "", self.place) for t in texts]
        cost = phrases(codes, self.table, self.roots) * self.bits
        names, scores = [], []
        for code, row in zip(codes, cost, strict=True):
            if not code.any() or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            others = np.delete(row, best)
            names.append(self.names[best])
            scores.append(float(1 - row[best] / others.min()) if len(others) else 1.0)
        return names, scores


def learn(labelled: DataFrame, most_chars: int = 30_000, most_rows: int = 200, row_chars: int = 4_000) -> Model:
    """A model from rows with ``text`` and non-null ``lang``.

    The sample is bounded: of each language at most ``most_rows`` whole texts of at most ``row_chars`` characters, the first
    by a hash of the text, as far as ``most_chars`` characters go; what is missing then comes from the first ``row_chars``
    characters of longer texts. Only that sample reaches the driver.
    """
    size = F.length("text")
    rows = labelled.where(F.col("lang").isNotNull() & (size > 0))
    rows = rows.select("lang", (size > row_chars).cast("int").alias("long"), F.xxhash64("text").alias("h"), F.substring("text", 1, row_chars).alias("text"))
    turn = Window.partitionBy("lang", "long").orderBy("h", "text")
    parts = -(-most_chars // row_chars)
    picked = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most_rows).where((F.col("long") == 0) | (F.col("turn") <= parts)).collect()
    samples: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["long"], r["turn"])):
        have = samples.setdefault(r["lang"], "")
        if len(have) < most_chars:
            samples[r["lang"]] = f"{have} {r['text']}"[:most_chars]
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text.

    The language whose sample needs the fewest bits, phrases times the logarithm of the sample's length, wins; ties
    go to the first name. ``score`` is one minus its cost over the second best's. ``und`` and 0 for null texts,
    texts without a letter, or a model without languages. One narrow stage.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
