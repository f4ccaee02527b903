import random
import re
from collections import defaultdict

from tidewell.llm.components import components
from tidewell.llm.near_dedup import near_duplicates
from tidewell.llm.queries import op8_near_dedup

from .conftest import SF, words


def brute(rows, size):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + min(size, len(w))]) for i in range(len(w) - min(size, len(w)) + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows))


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op8_near_dedup(spark, SF).collect())) == brute(rows, 4)


def test_chains_and_large_groups(spark):
    """A chain whose ends are unlike, and a group of copies each with some words changed: pairs are often below 0.8."""
    r = random.Random(5)
    text = words(120, 11).split()
    rows, doc = [], 1000
    for _ in range(12):
        text = [*text[8:], *words(8, doc).split()]
        rows.append((doc, " ".join(text)))
        doc -= 1
    base = words(150, 12).split()
    for k in range(150):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(len(copy))] = f"new{k}"
        rows.append((2000 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs).collect())) == brute(rows, 5)


def test_hard_cases(odd_docs, no_docs):
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(odd_docs).collect()]
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (11, 4, False), (7, 7, True), (None, 4, False)} <= set(rows)
    assert len(rows) == odd_docs.count() and near_duplicates(no_docs).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 520)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {(x["node"], x["component"]) for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(x, root(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
