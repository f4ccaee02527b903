"""Training-data curation: labels, leak removal, splits, quotas, mixes and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import SPACE, mojibake, normal
from tidewell.operators.latest import best_per_key
from tidewell.operators.retrieval import small


def hash_order(key: Column, seed: int = 0) -> Column:
    """A number that orders keys at random but always alike, for shuffles, samples and picks."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_split(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: a share ``ratio`` of rows, at least one, is ``val``, picked by hash order.

    Exactly ``round(n * ratio)`` rows. The border hash is found by counting hashes by their first four digits, so that only the rows
    of one of 65,536 groups are ranked, wherever they are many.
    """
    marked = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_g", F.substring("_h", 1, 4))
    groups = marked.groupBy("_g").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.greatest(F.round(F.sum("n").over(Window.partitionBy()) * ratio), F.lit(1)).cast("long")
    borders = groups.select("_g", "n", (wanted - before).alias("room"))
    placed = marked.join(F.broadcast(borders), "_g")
    inner = Window.partitionBy("_g").orderBy("_h", key)
    cut = placed.where("room > 0 and room < n").withColumn("_r", F.row_number().over(inner)).withColumn("split", F.when(F.col("_r") <= F.col("room"), "val").otherwise("train"))
    rest = placed.where("not (room > 0 and room < n)").withColumn("split", F.when(F.col("room") >= F.col("n"), "val").otherwise("train"))
    return rest.select(*df.columns, "split").unionByName(cut.select(*df.columns, "split"))


def without_leaks(train: DataFrame, evaluation: DataFrame, key: Column) -> DataFrame:
    """Training rows whose key is no evaluation row's; nulls stay."""
    left = train.withColumn("_key", key)
    return left.join(evaluation.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def spaceless(text: Column) -> Column:
    """Lower case without blanks; other white space stays."""
    return F.replace(F.lower(text), F.lit(" "), F.lit(""))


def without_self_repeats(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """The first row, by ``seq``, of each key."""
    return best_per_key(df.withColumn("_key", key), ["_key"], [F.asc(seq)]).drop("_key")


def containment(docs: DataFrame, items: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, item_id``: items whose normal form is part of a document's.

    Instead of testing every pair, an item is looked up by its rarest run of ``size`` words, and only documents that hold the run
    are tested. Items of fewer words are looked up by their rarest word. Words are cut at blanks.
    An item that could start or end within a word is found only if the word is whole.
    """

    def runs(words: Column, n: int) -> Column:
        # Words are fetched by index: a slice would copy the whole array each time.
        found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<bigint>"))

    own = items.select("item_id", normal(F.col("text")).alias("item")).where("item <> ''").withColumn("words", F.split("item", " "))
    pieces = []
    for n, part in ((size, own.where(F.size("words") >= size)), (1, own.where(F.size("words") < size))):
        keys = part.select("item_id", "item", F.explode(F.array_distinct(runs(F.col("words"), n))).alias("run"))
        rows = docs.select("doc_id", normal(F.col("text")).alias("form")).where("form <> ''")
        places = rows.select("doc_id", F.split("form", " ").alias("words")).select("doc_id", F.explode(F.array_distinct(runs(F.col("words"), n))).alias("run"))
        found = places.join(F.broadcast(keys.select("run").distinct()), "run")
        counts = found.groupBy("run").agg(F.count("*").alias("df"))
        rarest = best_per_key(keys.join(counts, "run"), ["item_id", "item"], [F.asc("df"), F.asc("run")])
        pairs = found.join(F.broadcast(rarest.select("run", "item_id", "item")), "run").select("doc_id", "item_id", "item")
        pieces.append(pairs.join(rows, "doc_id").where(F.contains(F.concat(F.lit(" "), "form", F.lit(" ")), F.concat(F.lit(" "), "item", F.lit(" ")))).select("doc_id", "item_id"))
    return pieces[0].unionByName(pieces[1]).distinct()


def request_candidates(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Jobs that become review candidates: usable text, and neither id nor text is known; of equal texts the first job.

    ``jobs``: ``job_id, prompt``. ``known``: ``origin_id, job_id, prompt``, deleted ones included, so that none comes back.
    """
    fresh = jobs.where(~mojibake(F.col("prompt"))).withColumn("prompt", F.trim(F.regexp_replace("prompt", rf"^{SPACE}|{SPACE}$", "")))
    for left, right in (("job_id", "origin_id"), ("job_id", "job_id"), ("prompt", "prompt")):
        seen = known.select(F.col(right).alias(left)).where(F.col(left).isNotNull()).distinct()
        fresh = fresh.join(seen, left, "left_anti")
    return best_per_key(fresh, ["prompt"], [F.asc("job_id")]).select("job_id", "prompt")


def feedback_labels(feedback: DataFrame) -> DataFrame:
    """Samples derived from feedback: ``origin_id, kind, source``, none, one or more per row.

    ``feedback``: ``origin_id, vote, source, has_answer`` (its comment holds an answer), ``has_parsed, prompt, image_path``.
    A like confirms the parsed answer, a dislike with an answer corrects it; a pipeline failure with an image gives a
    segment sample and never a prompt sample.
    """
    failure = F.col("source") == "pipeline_failure"
    vote = F.lower("vote")
    kind = F.when(~failure & (vote == "dislike") & F.col("has_answer"), "correction").when(~failure & (vote == "like") & F.col("has_parsed"), "like")
    prompt = F.when(kind.isNotNull() & (F.coalesce("prompt", F.lit("")) != ""), F.struct(F.lit("prompt").alias("kind"), kind.alias("source")))
    segment = F.when(failure & F.col("image_path").isNotNull(), F.struct(F.lit("segment").alias("kind"), F.lit("pipeline_failure").alias("source")))
    rows = feedback.select("origin_id", F.explode(F.array_compact(F.array(prompt, segment))).alias("made"))
    return rows.select("origin_id", "made.kind", "made.source")


def repeated(df: DataFrame, times: int, mark: str) -> DataFrame:
    """Rows ``times`` times over, with ``stream`` = ``mark`` and ``copy`` from 1."""
    return df.withColumn("stream", F.lit(mark)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def capped_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows picked by hash order, all if there are fewer."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)


def training_mix(approved: DataFrame, seed_rows: DataFrame, pseudo: DataFrame, evaluation: DataFrame, pseudo_most: int, approved_times: int = 3, seed_times: int = 2) -> DataFrame:
    """Streams with their repetition, without rows whose normal text is in the evaluation set."""
    parts = [repeated(approved, approved_times, "approved"), repeated(seed_rows, seed_times, "seed"), repeated(capped_sample(pseudo, "doc_id", pseudo_most), 1, "pseudo")]
    mixed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return without_leaks(mixed, evaluation, normal(F.col("text")))


def quota_sample(items: DataFrame, quotas: dict[str, int], total: int, seed: int = 0) -> DataFrame:
    """``item_id, stratum``: up to each stratum's quota, the rarest first, no item twice, at most ``total``.

    ``items``: ``item_id, stratum``, one row for each stratum an item is in. One pass per stratum, rarest first: items in hash
    order, without those taken before. Ranks are top-k limits, so nothing is sorted whole.
    """
    counts = {r["stratum"]: r["n"] for r in items.where(F.col("stratum").isin(*quotas)).groupBy("stratum").agg(F.countDistinct("item_id").alias("n")).collect()}
    taken, left = None, total
    for name in sorted(counts, key=lambda x: (counts[x], x)):
        rows = items.where(F.col("stratum") == name).select("item_id").distinct()
        if taken is not None:
            rows = rows.join(taken, "item_id", "left_anti")
        n = min(quotas[name], left)
        rows = capped_sample(rows, "item_id", n, seed).withColumn("stratum", F.lit(name))
        taken = rows if taken is None else taken.unionByName(rows)
        left -= min(n, counts[name])
        if left <= 0:
            break
    return items.select("item_id", "stratum").where("false") if taken is None else taken.orderBy(hash_order(F.col("item_id"), seed)).limit(total)


def retrain_gate(approved: DataFrame, trained: DataFrame, key: str, least: int) -> DataFrame:
    """One row: how many approved rows the last training hasn't seen, and whether that is enough."""
    fresh = approved.join(trained.select(key).distinct(), key, "left_anti")
    return fresh.agg(F.count("*").alias("n_new")).withColumn("retrain", F.col("n_new") >= least)


def accepted_augmentation(made: DataFrame, train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Generated rows to keep: parsed again as meant, in neither set by normal text, the first of equal texts.

    ``made``: ``seq, text, wanted, parsed``.
    """
    good = made.where(F.col("parsed").eqNullSafe(F.col("wanted")))
    key = normal(F.col("text"))
    for other in (train, evaluation):
        good = without_leaks(good, other, key)
    return without_self_repeats(good, key, "seq")


def label_issues(images: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """``image_id, issue``: images without labels, labels without image, bad classes, short or out-of-range polygons.

    ``labels``: ``image_id, cls, points`` (array of coordinates from 0 to 1, two for a point).
    """
    have = labels.groupBy("image_id").agg(
        F.max((F.col("cls") < 0) | (F.col("cls") >= n_classes)).alias("bad_class"),
        F.max(F.size("points") < 6).alias("short_polygon"),
        F.max(F.exists("points", lambda p: (p < 0) | (p > 1))).alias("out_of_range"),
    )
    both = images.select("image_id", F.lit(True).alias("image")).join(have.withColumn("label", F.lit(True)), "image_id", "full")
    issues = [F.when(F.col("label").isNull(), "no_label"), F.when(F.col("image").isNull(), "no_image"), *(F.when(F.col(x), x) for x in ("bad_class", "short_polygon", "out_of_range"))]
    return both.select("image_id", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def remapped(labels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels with the class numbers of another vocabulary; classes without a match go. ``mapping``: ``cls, new_cls``, counted and, if small, sent to the labels: a class's rows are not gathered."""
    return labels.join(small(mapping), "cls").withColumn("cls", F.col("new_cls")).drop("new_cls")


def instruction_records(cases: DataFrame, template: str) -> DataFrame:
    """Training lines from cases by source, origin and vote, in the order of the rules.

    ``cases``: ``case_id, source, vote, prompt, answer, corrected`` (answer given by the user). Pipeline failures never
    count; a like or a case without a vote uses the answer, a dislike its correction. ``{prompt}`` and ``{response}``
    in the template are replaced.
    """
    answer = F.when(F.col("source") == "pipeline_failure", None).when(F.lower("vote") == "dislike", F.col("corrected")).otherwise(F.col("answer"))
    rows = cases.withColumn("_answer", answer).where(F.col("_answer").isNotNull() & (F.trim(F.coalesce("prompt", F.lit(""))) != ""))
    text = F.replace(F.replace(F.lit(template), F.lit("{prompt}"), F.trim("prompt")), F.lit("{response}"), F.col("_answer"))
    return rows.select("case_id", text.alias("line"))


def with_default_source(rows: DataFrame, default: str = "pseudo", vote: str = "like") -> DataFrame:
    """Pseudo-labels: no source, or the user's, becomes ``default``; no vote becomes ``vote``."""
    source = F.when(F.col("source").isNull() | (F.col("source") == "user"), default).otherwise(F.col("source"))
    return rows.withColumn("source", source).withColumn("vote", F.coalesce("vote", F.lit(vote)))


def vote_summary(cases: DataFrame, usable: Column, image: Column) -> DataFrame:
    """One row: cases, records, skipped, with_image, and the votes with their numbers as sorted text."""
    votes = cases.groupBy(F.coalesce("vote", F.lit("none")).alias("v")).agg(F.count("*").alias("n"), F.count_if(usable).alias("u"), F.count_if(image).alias("i"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("v", "n"))), lambda x: F.concat(x["v"], F.lit(":"), x["n"].cast("string"))), ",")
    return votes.agg(F.sum("n").alias("cases"), F.sum("u").alias("records"), (F.sum("n") - F.sum("u")).alias("skipped"), F.sum("i").alias("with_image"), listed.alias("votes"))


def template_corpus(words: DataFrame, templates: dict[str, int], key: str, word: str, seed: int = 0) -> DataFrame:
    """A text per word, its template picked by hash with the templates' weights. ``{}`` is the word's place."""
    total, upto, pick = sum(templates.values()), 0, None
    at = F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), F.lit(total))
    for template, weight in templates.items():
        upto += weight
        text = F.replace(F.lit(template), F.lit("{}"), F.col(word))
        pick = F.when(at < upto, text) if pick is None else pick.when(at < upto, text)
    return words.select(key, pick.alias("text"))


def replay_mix(hard: DataFrame, rest: DataFrame, evaluation: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``key, stream``: hard cases and a hash-picked ``share`` of the others, none of them in the evaluation set."""
    bucket = F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), F.lit(1000))
    others = rest.join(hard.select(key), key, "left_anti").where(bucket < int(share * 1000))
    mixed = hard.select(key, F.lit("hard").alias("stream")).unionByName(others.select(key, F.lit("replay").alias("stream")))
    return mixed.join(evaluation.select(key).distinct(), key, "left_anti")


def review_cases(rows: DataFrame, key: str, score: str, least: float, most: float) -> DataFrame:
    """Cases worth a look: pending ones with a score from ``least`` to below ``most``."""
    return rows.where((F.col("status") == "pending") & (F.col(score) >= least) & (F.col(score) < most)).select(key, score)


def class_prompts(labels: DataFrame, key: str, label: str, templates: list[str], seed: int = 0) -> DataFrame:
    """``key, text``: one sentence per image over its different classes, its template picked by hash."""
    names = labels.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(label)), " and ").alias("_names"))
    at = F.pmod(F.crc32(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), F.lit(len(templates))).cast("int")
    return names.select(key, F.replace(F.element_at(F.array(*map(F.lit, templates)), at + 1), F.lit("{}"), F.col("_names")).alias("text"))


def vision_accepted(candidate: DataFrame, base: DataFrame, map_drop: float, hard: list[str], most_map_drop: float = 0.005, step: float = 0.02) -> DataFrame:
    """One row: whether a detector is taken. Both: ``scenario, pick, leak`` as shares, null where not measured.

    Refused if the general score drops by more than ``most_map_drop``, or in any scenario picks drop or leaks rise by more
    than ``step``; taken if a hard scenario gains more than ``step`` in either.
    """
    rows = candidate.join(base.select("scenario", F.col("pick").alias("p0"), F.col("leak").alias("l0")), "scenario")
    worse = F.coalesce(F.col("pick") < F.col("p0") - step, F.lit(False)) | F.coalesce(F.col("leak") > F.col("l0") + step, F.lit(False))
    gain = F.coalesce(F.col("leak") < F.col("l0") - step, F.lit(False)) | (F.coalesce("pick", F.lit(0.0)) > F.coalesce("p0", F.lit(0.0)) + step)
    out = rows.agg(F.count_if(worse).alias("worse"), F.count_if(gain & F.col("scenario").isin(*hard)).alias("better"))
    return out.withColumn("accepted", F.lit(map_drop <= most_map_drop) & (F.col("worse") == 0) & (F.col("better") > 0))
