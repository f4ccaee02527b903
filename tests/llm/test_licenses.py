import re

from tidewell.llm.licenses import TEMPLATES, license_scan
from tidewell.llm.queries import op3_licenses

from .conftest import SF, words


def test_query_finds_every_notice(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r["doc_id"], r["license"]) for r in op3_licenses(spark, SF).collect()}
    short = {k: v.lower() for k, v in TEMPLATES.items() if not k.endswith("-text")}
    want = {(r["doc_id"], k) for r in docs for k, v in short.items() if v in r["text"].lower()}
    assert want and want <= got and {x for x in got if x[1] in short} - want == set()


def test_long_templates_edits_and_negatives(spark):
    long = TEMPLATES["Apache-2.0-text"]
    w = long.split()
    edited = " ".join("changed" if i == 20 else x for i, x in enumerate(w))
    rows = [(1, words(300, 1) + " " + long + " " + words(200, 2)), (2, edited), (3, words(500, 3)), (4, " ".join(w[: len(w) // 2])), (5, long.upper()), (6, None), (7, ""), (8, "one two")]
    rows += [(100 + k, words(k, k) + " " + TEMPLATES["GPL-text"]) for k in range(20)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): r for r in license_scan(docs).collect()}
    assert {(1, "Apache-2.0-text"), (2, "Apache-2.0-text"), (5, "Apache-2.0-text")} <= set(got)
    assert got[1, "Apache-2.0-text"]["containment"] == 1.0 and 0.8 <= got[2, "Apache-2.0-text"]["containment"] < 1
    assert {(100 + k, "GPL-text") for k in range(20)} <= set(got)
    assert not {d for d, _ in got} & {3, 4, 6, 7, 8}
    assert license_scan(docs.where("false")).count() == 0 and license_scan(docs, {}).count() == 0


def plain_shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_all_templates_by_brute_force(spark):
    # Every template within words, and the notices of the data: containment of whole sets at the best place, numbers exact.
    texts = [(k, words(60, k) + " . " + t + " . " + words(60, 900 + k)) for k, t in enumerate(TEMPLATES.values())]
    texts += [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("text ilike '%licens%' and length(text) < 8000").collect()]
    known = {name: plain_shingles(t) for name, t in TEMPLATES.items()}
    want = set()
    for doc_id, text in texts:
        own = plain_shingles(text)
        for name, h in known.items():
            digits = [sum(any(c in "0123456789" for c in x) for x in g) for g in h]
            marks = {g for g, d in zip(h, digits, strict=True) if d == max(digits) > 0}
            places = [set(own[max(i - len(set(h)), 0) : i + len(set(h))]) for i, g in enumerate(own) if g in set(h)] if set(own) & set(h) else []
            if any(len(set(h) & p) >= 0.8 * len(set(h)) and (not marks or marks & p) for p in places):
                want.add((doc_id, name))
    rows = license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"]) for r in rows}
    assert got == want and len(rows) == len(got)
    assert not any(name.startswith("GPL-2.0") and "gpl v3" in dict(texts)[d].lower() for d, name in got)
    best = {}
    for r in rows:
        if r["best"]:
            best.setdefault(r["doc_id"], []).append(r["license"])
    assert {d for d, _ in got} == set(best)
    for k, name in enumerate(TEMPLATES):
        assert [TEMPLATES[x].lower() for x in best[k] if known[x] == known[name]], (name, best[k])


def test_no_python_in_the_plan(spark):
    plan = op3_licenses(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
