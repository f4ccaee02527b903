"""Answers of a model: JSON out of text, canonical values, scores per field, votes between answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names an answer may hold.
EFFECTS = ["remove_bg", "blur", "crop", "none", "remove_object"]
POSITIONS = ["front", "back", "left", "right", "center", "largest", "smallest"]
FIELDS = ["target", "effect", "intensity", "crop", "position", "rank", "count", "attributes"]

#: An answer's values as they stand in the JSON: one reading gives all.
RAW = "target string, effect string, intensity string, crop string, selector struct<position: string, rank: string, count: string, attributes: string>"


def phrase(text: Column) -> Column:
    """Lower case, underscores as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "_", " "), r"\s+", " "))


def string_list(raw: Column) -> Column:
    """A list of strings from a value of JSON; one string is a list of itself, anything else null."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.startswith("{") | (raw == ""), None).when(raw.isNotNull(), F.array(raw))


def looked_up(name: Column, known: dict[str, str]) -> Column:
    """The canonical form of a name, null if it isn't known. The vocabulary is a fixed list of words, part of the plan."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), name)


def canonical(name: Column, known: dict[str, str]) -> Column:
    """A name as the vocabulary has it: as it is, without a plural ending, then by its longest known tail of words; else unchanged.

    ``known`` maps names and aliases to names.
    """
    words = F.split(name, " ")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: looked_up(F.array_join(F.slice(words, i, F.greatest(F.size(words) - i + 1, F.lit(0))), " "), known))
    es = F.when(name.endswith("es"), looked_up(F.left(name, F.length(name) - 2), known))
    s = F.when(name.endswith("s"), looked_up(F.left(name, F.length(name) - 1), known))
    return F.coalesce(looked_up(name, known), es, s, F.get(F.array_compact(tails), F.lit(0)), name)


def whole_1_50(raw: Column) -> Column:
    return F.when(raw.between(1, 50), raw)


def parsed(df: DataFrame, text: Column, known: dict[str, str], effects: dict[str, str]) -> DataFrame:
    """``df`` with ``answer``, a struct of target, effect, intensity, crop, position, rank, count, attributes; null if the text has no usable answer.

    The JSON is the outermost ``{...}`` of the text, also within a code fence. Usable: at least one target and an effect that is known, directly or by alias (``effects``).
    Of equal names in an object the last counts. Intensity is cut to 0..100 toward zero, 15 if it is no number; rank 1 is null; attributes are the first five different ones. What is read more than
    once is a column of its own, so that a value is taken from the JSON, and a phrase made, once.
    """
    rows = df.withColumn("_o", F.regexp_extract(text, r"(?s)\{.*\}", 0))
    rows = rows.withColumn("_j", F.when(F.json_object_keys("_o").isNotNull(), F.from_json("_o", RAW)))
    raw = {"_t": F.col("_j.target"), "_e": F.col("_j.effect"), "_a": F.col("_j.selector.attributes"), "_p": phrase(F.col("_j.selector.position")), "_i": F.col("_j.intensity").try_cast("double").cast("int")}
    raw |= {f"_{c}": F.col(f"_j.selector.{c}").try_cast("double").cast("int") for c in ("rank", "count")}
    raw["_c"] = F.lower(F.trim(F.col("_j.crop"))).isin("true", "1", "yes")
    rows = rows.withColumns(raw)
    rows = rows.withColumns({
        "_t": F.transform(F.filter(string_list(F.col("_t")), lambda x: F.trim(x) != ""), phrase), "_a": F.transform(string_list(F.col("_a")), phrase),
        "_e": F.lower(F.trim(F.coalesce(F.nullif("_e", F.lit("")), F.lit("remove_bg")))),
    })
    rows = rows.withColumns({
        "_t": F.array_distinct(F.transform("_t", lambda x: canonical(x, known))), "_e": F.coalesce(looked_up(F.col("_e"), effects), F.col("_e")),
        "_a": F.slice(F.array_distinct(F.filter("_a", lambda x: x != "")), 1, 5),
    })
    rank = whole_1_50(F.col("_rank"))
    answer = F.struct(
        F.col("_t").alias("target"), F.col("_e").alias("effect"), F.least(F.greatest(F.coalesce("_i", F.lit(15)), F.lit(0)), F.lit(100)).alias("intensity"),
        (F.coalesce("_c", F.lit(False)) | (F.col("_e") == "crop")).alias("crop"), F.when(F.col("_p").isin(*POSITIONS), F.col("_p")).alias("position"),
        F.when(rank > 1, rank).alias("rank"), whole_1_50(F.col("_count")).alias("count"), F.coalesce("_a", F.array().cast("array<string>")).alias("attributes"),
    )
    return rows.withColumn("answer", F.when((F.size("_t") > 0) & F.col("_e").isin(*EFFECTS), answer)).drop("_o", "_j", *raw)


def answer_lines(rows: DataFrame) -> DataFrame:
    """``line, n``: the usable answers as lines of JSON, and how often each comes.

    Answers are counted first, so a line is made once per different answer; those that are null are left out by their count, as a filter on the
    answer would be worked out before it, all steps once more.
    """
    counts = rows.groupBy("answer").agg(F.count("answer").alias("n")).where("n > 0")
    return counts.select(canonical_json(F.col("answer")).alias("line"), "n").groupBy("line").agg(F.sum("n").alias("n"))


def canonical_json(answer: Column) -> Column:
    """One line of JSON with keys in their fixed order; an empty selector is null."""
    empty = answer["position"].isNull() & answer["rank"].isNull() & answer["count"].isNull() & (F.size(answer["attributes"]) == 0)
    selector = F.when(~empty, F.struct(answer["position"].alias("position"), answer["rank"].alias("rank"), answer["count"].alias("count"), answer["attributes"].alias("attributes")))
    return F.to_json(F.struct(*(answer[c].alias(c) for c in FIELDS[:4]), selector.alias("selector")), {"ignoreNullFields": "false"})


def flattened(answer: Column) -> Column:
    """An answer for comparison: sorted targets and attributes, and a count of 1 where there is a position but no count."""
    parts = {c: answer[c] for c in FIELDS} | {"target": F.sort_array(answer["target"]), "attributes": F.sort_array(F.array_distinct(answer["attributes"]))}
    parts["count"] = F.coalesce(answer["count"], F.when(answer["position"].isNotNull(), 1))
    return F.struct(*(parts[c].alias(c) for c in FIELDS))


def scored(df: DataFrame, pred: str, gold: str) -> DataFrame:
    """``df`` with a boolean per field, ``exact`` and ``valid``; all false without a prediction."""
    rows = df.withColumn("_p", flattened(F.col(pred))).withColumn("_g", flattened(F.col(gold))).withColumn("valid", F.col(pred).isNotNull())
    rows = rows.withColumns({f"{c}_ok": F.col("valid") & F.col(f"_p.{c}").eqNullSafe(F.col(f"_g.{c}")) for c in FIELDS})
    exact = F.lit(True)
    for c in FIELDS:
        exact = exact & F.col(f"{c}_ok")
    return rows.withColumn("exact", exact).drop("_p", "_g")


def field_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Share of right answers per field, of exact and of valid ones, per ``by``."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(share(f"{c}_ok").alias(c) for c in FIELDS), share("exact").alias("exact"), share("valid").alias("valid"))


def winners(votes: DataFrame, won: DataFrame, answer: str) -> DataFrame:
    """The whole answer of each winner: the first sample with its set, or sample 0 with the winner's set where no sample has it.

    ``votes``: prompt_id, pos, set, ``answer``; ``won``: prompt_id, set.
    """
    first = votes.groupBy("prompt_id", "set").agg(F.min_by(answer, "pos").alias("own"))
    zero = votes.groupBy("prompt_id").agg(F.min_by(answer, "pos").alias("zero"))
    out = won.join(first, ["prompt_id", "set"], "left").join(zero, "prompt_id")
    return out.select("prompt_id", "set", F.coalesce("own", "zero").alias(answer), F.col("own").isNull().alias("replaced"))


def needed_samples(votes: DataFrame, heuristic: DataFrame) -> DataFrame:
    """The samples that had to be asked for: the first alone where it agrees with the heuristic (prompt_id, agreed)."""
    rows = votes.join(heuristic.select("prompt_id", "agreed"), "prompt_id", "left")
    first = F.max(F.when(F.col("pos") == 0, F.col("set"))).over(Window.partitionBy("prompt_id"))
    return rows.withColumn("_first", first).where((F.col("pos") == 0) | ~F.coalesce(F.col("_first") == F.col("agreed"), F.lit(False))).drop("_first", "agreed")


def first_success(tries: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """The first successful try of each key."""
    return tries.where(ok).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def next_step(status: Column, retries: Column, hard: Column) -> Column:
    """Where a job goes after validation: effects, one retry of a fallback, or feedback first (also for hard examples)."""
    return F.when((status == "ok") & ~hard, "effect_applier").when((status == "fallback") & (retries < 1), "retry_segmentor").otherwise("feedback_then_effects")


def hard_example(least: Column, threshold: float) -> Column:
    """Whether the least confidence is under the threshold; never where that is 0."""
    return F.coalesce(least < threshold, F.lit(False)) & F.lit(threshold > 0)


def stray_numbers(answer: Column, context: Column) -> Column:
    """Numbers in an answer that its context lacks; the digits 1 to 9 alone don't count."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_sort(F.array_except(F.array_except(numbers(answer), numbers(context)), F.array(*(F.lit(str(k)) for k in range(1, 10)))))


def route(text: Column, routes: dict[str, list[str]], default: str) -> Column:
    """The route with most key words in the text; of ties the first, without any the default."""
    low = F.lower(text)
    hits = [(name, sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))) for name, words in routes.items()]
    best = F.greatest(*(h for _, h in hits), F.lit(0))
    out = F.when(best == 0, default)
    for name, h in hits:
        out = out.when(h == best, name)
    return out


def clean_lines(lines: Column, question: Column, most: int = 6) -> Column:
    """Lines of 8 to 180 characters, stripped, each once and none equal to the question; the first ``most``."""
    tidy = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^[ \"'`]+|[ \"'`]+$", ""))
    return F.slice(F.array_distinct(F.filter(tidy, lambda x: F.length(x).between(8, 180) & (x != F.trim(question)))), 1, most)


def similar_questions(text: Column, swaps: list[tuple[str, str]], most: int = 3) -> Column:
    """Up to ``most`` versions of a question with one word swapped."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*(F.when(text.contains(a), F.replace(text, F.lit(a), F.lit(b))) for a, b in swaps)))), 1, most)


def serial(text: Column) -> Column:
    """A serial number for comparison: upper case, letters and digits only."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def masked_email(email: Column) -> Column:
    """The first two characters (one of a short name) and at least two stars before the domain."""
    local, domain = F.substring_index(email, "@", 1), F.when(email.contains("@"), F.regexp_replace(email, "^[^@]*@", "")).otherwise("")
    n = F.when(F.length(local) > 2, 2).otherwise(F.least(F.length(local), F.lit(1)))
    return F.concat(F.left(local, n), F.repeat(F.lit("*"), F.greatest(F.length(local) - n, F.lit(2))), F.lit("@"), domain)


def password_problem(password: Column, least: int = 8, most: int = 64) -> Column:
    """``length`` or ``kinds`` (a letter and a digit are needed); null if there is none."""
    return F.when(~F.length(password).between(least, most), "length").when(~(password.rlike("[A-Za-z]") & password.rlike(r"\d")), "kinds")


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """A word with the particle that fits its last syllable; other scripts count as ending in a vowel."""
    code = F.ascii(F.right(word, F.lit(1)))
    return F.concat(word, F.when(code.between(44032, 55203) & ((code - 44032) % 28 != 0), after_consonant).otherwise(after_vowel))


def attribute_pair(text: Column, colours: dict[str, str], parts: dict[str, str]) -> Column:
    """``colour, part`` of a phrase; names and aliases (mapped to names) are tried longest first, as whole words."""
    padded = F.concat(F.lit(" "), phrase(text), F.lit(" "))

    def first(known: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for name in sorted(known, key=lambda x: (len(x), x)):
            out = F.when(padded.contains(f" {name} "), known[name]).otherwise(out)
        return out

    return F.struct(first(colours).alias("colour"), first(parts).alias("part"))


def default_intensity(intensity: Column, text: Column, default: int = 15) -> Column:
    """The intensity a text states; the default where it has no digit."""
    return F.when(text.rlike(r"\d"), intensity).otherwise(default)


def iso_time(text: Column) -> Column:
    """An ISO time as UTC; without a zone it is UTC already, otherwise null if it can't be read."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(F.concat(text, F.lit("Z"))))
