import hashlib

from tidewell.llm import warc
from tidewell.llm.queries import op5_warc
from tidewell.llm.shared import shared_folder

from .conftest import SF


def brute(pages):
    out = []
    data = [(p, (h or "").encode()) for p, _, h in pages]
    top = {}
    for p, b in data:
        if len(b) >= 1000:
            top[b] = max(top.get(b, p), p)
    for p, b in data:
        owner = top.get(b, p)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if owner == p else "revisit", None if owner == p else owner))
    return sorted(out)


def test_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    assert sorted(map(tuple, op5_warc(spark, SF).collect())) == brute(pages.collect())


def test_hard_cases_and_lookup(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "a b\r\n: c", "é" * 500), (4, "u", "é" * 500), (5, "u", "é" * 499), (6, "u", "é" * 499), (7, "u", "x" * 3_000_000), (8, "u", "\r\n\r\n" * 300)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc.warc_round_trip(pages).collect())) == brute(rows)
    assert warc.warc_round_trip(pages.where("false")).count() == 0
    folder = shared_folder(spark)
    index = warc.write_bundles(pages, folder)
    got = warc.lookup(spark, index, spark.createDataFrame([(3,), (4,), (99,), (4,)], "page_id long"), folder).collect()
    assert sorted((r["page_id"], r["record_type"], bytes(r["payload"] or b"").decode()) for r in got) == [(3, "revisit", ""), (4, "response", "é" * 500)]
