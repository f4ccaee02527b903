"""Benchmark decontamination with a positional inverted index (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.native_text import lowered, raw_words, small, words
from tidewell.llm.shared import written


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text`` and ``d, k``: doc_id (0 for null) and a hash of the row's id and text, which together name a row's content."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), F.col("text").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("doc_id", "text").alias("k"))


def phrases(items: DataFrame, size: int) -> DataFrame:
    """``phrase, terms, items``: every distinct window of ``size`` consecutive words of the items' texts, or a shorter item whole."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = own.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))
    return written(cut.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("phrase", F.xxhash64("terms")))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, d, k, pos`` for every place of the wanted ``terms`` (term) in the documents."""
    places = keyed(docs).select("d", "k", F.posexplode(raw_words(F.col("text"))).alias("pos", "raw"))
    return places.select("d", "k", "pos", lowered(F.col("raw")).alias("term")).join(small(terms, F.octet_length("term")), "term")


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df``: number of places of each wanted term."""
    places = docs.select(F.explode(raw_words(F.col("text"))).alias("raw")).select(lowered(F.col("raw")).alias("term"))
    return places.join(small(terms, F.octet_length("term")), "term").groupBy("term").agg(F.count("*").alias("df"))


def rarest(found: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """``phrase, term, off, turn, needed``: the ``most`` rarest terms of each phrase, whose terms all occur somewhere."""
    spread = found.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term")).join(counts, "term")
    lists = spread.groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("all")).where("size(all) = n")
    picked = lists.select("phrase", F.least("n", F.lit(most)).alias("needed"), F.posexplode(F.slice("all", 1, most)).alias("turn", "one"))
    return picked.select("phrase", "one.term", "one.off", "turn", "needed")


def candidates(docs: DataFrame, found: DataFrame, most: int = 2) -> DataFrame:
    """``d, k, phrase, start``: where the offset-adjusted lists of each phrase's rarest terms meet."""
    terms = written(found.select(F.explode("terms").alias("term")).distinct())
    rare = written(rarest(found, frequencies(docs, terms), most))
    index = written(postings(docs, rare.select("term").distinct()))
    placed = index.join(small(rare, F.octet_length("term")), "term").select("d", "k", "phrase", (F.col("pos") - F.col("off")).alias("start"), "turn", "needed")
    have = sum((F.max(F.when(F.col("turn") == t, 1).otherwise(0)) for t in range(most)), F.lit(0))
    return placed.where("start >= 0").groupBy("d", "k", "phrase", "start", "needed").agg(have.alias("have")).where("have = needed").drop("have", "needed")


def union_length(hits: Column) -> Column:
    """Words in the union of hits (start, n), sorted by start."""
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).alias("total"))

    def step(a: Column, h: Column) -> Column:
        stop = F.greatest(a["stop"], h["start"] + h["n"])
        return F.struct(stop.alias("stop"), (a["total"] + stop - F.greatest(F.least(a["stop"], stop), h["start"])).alias("total"))

    return F.aggregate(F.array_sort(hits), zero, step, lambda a: a["total"])


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, rare_terms: int = 2) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items, contaminated`` (replacing columns of these names).

    A window of ``size`` consecutive item words (a shorter item is one window) that occurs in a document, word
    for word, hits those of its words; ``items`` are the sorted ids, as strings, of items with such windows.

    Terms are counted over all documents; the places of each window's ``rare_terms`` rarest terms are stored as a positional
    index; lists shifted by the term's offset are intersected; what is left is compared with the document's words. A term that a
    third of all places hold is counted with map-side sums, and becomes a list only where a window has none rarer.
    All other columns, whatever their names, come back as they were. Null text: no words. Repeated rows each get the result. No items or no documents: no hits, no rows.
    """
    added = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    base = docs.drop(*added)
    found = phrases(items, size)
    places = candidates(base, found, rare_terms).join(small(found, F.size("terms") * 16 + F.size("items") * 16), "phrase")
    lists = written(places.groupBy("d", "k").agg(F.collect_list(F.struct("start", "terms", "items")).alias("hits")))
    # Lists grow with the documents, so this join is dealt by key at every size.
    rows = keyed(base).join(lists.hint("merge"), ["d", "k"], "left")
    rows = rows.withColumn("n_words", F.size(raw_words(F.col("text"))).cast("long"))
    own = F.when(F.col("hits").isNotNull(), words(F.col("text")))
    rows = rows.withColumn("own", own).withColumn("hits", F.filter("hits", lambda h: F.slice("own", h["start"] + 1, F.size(h["terms"])) == h["terms"]))
    spans = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), F.size(h["terms"]).alias("n")))
    rows = rows.withColumn("n_hit", F.coalesce(union_length(spans), F.lit(0)).cast("long"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    rows = rows.withColumn("items", F.coalesce(ids, F.array().cast("array<string>"))).withColumn("n_items", F.size("items").cast("long"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0).select(*(F.col(f"row.`{c}`") for c in base.columns), *added)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 20, size: int = 10) -> DataFrame:
    """``doc_id, item_id, pos``: all words of an item's window within ``slop`` words before or after its rarest word at ``pos``, in any order."""
    found = written(phrases(items, size).select("phrase", F.array_distinct("terms").alias("terms"), "items"))
    counts = frequencies(docs, written(found.select(F.explode("terms").alias("term")).distinct()))
    rare = written(rarest(found, counts, 1))
    index = postings(docs, rare.select("term").distinct())
    places = index.join(rare.select("phrase", "term"), "term").join(found, "phrase").select("d", "k", "pos", "terms", "items")
    lists = places.groupBy("d", "k").agg(F.collect_list(F.struct("pos", "terms", "items")).alias("near"))
    rows = keyed(docs).join(lists, ["d", "k"]).withColumn("own", words(F.col("text")))

    def close(h: Column) -> Column:
        start = F.greatest(h["pos"] + 1 - slop, F.lit(1))
        return F.size(F.array_except(h["terms"], F.slice("own", start, h["pos"] + 1 + slop - start + 1))) == 0

    kept = rows.select("row.doc_id", F.explode(F.filter("near", close)).alias("h"))
    return kept.select("doc_id", F.explode("h.items").alias("item_id"), "h.pos").distinct()
