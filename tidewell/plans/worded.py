"""Queries over prompts read by key words, and their SQL. Prompts are put together from orders' columns: openings, words for things, joints and closings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.vocabulary import KOREAN, WORDS
from tidewell.operators import answers, wording
from tidewell.sources.tables import table

VOCABULARY = WORDS | {"trees": "tree", "stuffed toy": "teddy bear", "toy": "toy"}
NOUNS = list(VOCABULARY)
OPENINGS = ["", "Keep the ", "please remove the ", "ignore the ", "왼쪽 두 번째 ", "빨간 모자 쓴 ", "Just a ", "don't touch the ", 'all but "My  Cup": ', "the third largest ", "가장 큰 ", "erase the black t-shirt and "]
JOINTS = [" and the ", ", ", "와 ", " 말고 ", "은 그대로 두고 ", "만 남기고 ", "는 지우고 ", ". Remove ", "s, a ", "이 ", " but not the "]
CLOSINGS = ["", "만 지워줘", " 지워줘", "만 남겨줘", ", blur: 40", " crop", " 빼고 다 지워줘", "s, please", " 3마리만 남겨", " 흐리게 강도 250", "를 삭제해", " in a white old jacket", " 하나", "도 지우지 마"]


def chosen(values: list[str], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    made = F.concat(chosen(OPENINGS, k), chosen(NOUNS, k * 7 + c), chosen(JOINTS, F.floor(k / 8)), chosen(NOUNS, c), chosen(CLOSINGS, F.floor(c / 3) + k))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("prompt"))


def document_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often documents mention the words of a list, and where."""
    words = {w: w for w in DOCUMENT_WORDS}
    found = wording.with_mentions(wording.tidy(F.col("text")), words)
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("m"))
    return each.groupBy("doc_id", F.col("m.name").alias("name")).agg(F.count("*").alias("n"), F.min("m.start").cast("long").alias("first"), F.sum(F.col("m.start").cast("long")).alias("places"))


#: Words that stand in, and within other words of, the documents.
DOCUMENT_WORDS = ("the", "then", "of", "in", "ing", "that", "thing", "nicht", "die", "der", "que", "de la", "la", "only", "on", "est")


def worded_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = wording.with_targets(prompts(spark, sf_dir), "prompt", VOCABULARY)
    return read.select("o_orderkey", F.array_join(wording.quoted_or(F.col("prompt"), F.col("target")), ",").alias("target"), "erase")


def worded_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = wording.with_targets(prompts(spark, sf_dir), "prompt", VOCABULARY)
    # A column of its own, so that each word is looked for in a text that was made once.
    read = read.withColumn("lower", wording.tidy(F.col("prompt")))
    return read.withColumn("e", wording.effect(F.col("lower"), F.col("erase"))).select("o_orderkey", "e.effect", "e.crop", "e.intensity")


def worded_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts(spark, sf_dir).withColumn("s", wording.selector(wording.tidy(F.col("prompt"))))
    return rows.select("o_orderkey", "s.position", "s.rank", "s.count", F.array_join("s.attributes", ",").alias("attributes"))


COLOURS = {"red": "red", "neon yellow": "neon yellow", "yellow": "yellow", "fluorescent": "neon yellow", "dark red": "red"}
ITEMS = {"hat": "hat", "vest": "vest", "waistcoat": "vest", "safety hat": "helmet"}
TONES, THINGS = ["Red", "neon  yellow", "yellowish", "fluorescent", "dark red", "yellow neon", "", "blue"], ["hat", "vest of", "waistcoat", "hats", "Safety hat", "", "car"]


def attribute_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", chosen(TONES, F.col("p_partkey")), F.col("p_type"), chosen(THINGS, F.col("p_size")), F.col("p_name"))
    pair = answers.attribute_pair(text, COLOURS, ITEMS)
    return table(spark, sf_dir, "part").select("p_partkey", pair["colour"].alias("colour"), pair["part"].alias("part"))


PHRASED = [*KOREAN, "dog", "", "강", "TV"]


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat(F.col("c_name"), F.lit(" "), chosen(PHRASED, F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", answers.particle(word, "을", "를").alias("phrase"))


QUERIES = {f.__name__: f for f in (worded_targets, worded_effects, worded_selectors, document_mentions, attribute_pairs, particles)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def pick(values: list[str], place: str) -> str:
    return f"{listed(values)}[1 + ({place}) % {len(values)}]"


def holds(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def named(text: str, known: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {holds(text, words)} THEN {quoted(name)}" for name, words in known.items()) + " END"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def found_sql(words: dict[str, str]) -> str:
    """SQL that gives ``m`` (key, start, stop, name): the mentions in the table ``texts`` (key, t), places from 1."""
    particles, longer = wording.PARTICLES, wording.LONG_PARTICLES
    latin = "NOT regexp_matches(substring(t, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[A-Za-z]') AND regexp_matches(substring(t, i + n), '^($|[^A-Za-z]|es|s($|[^\\p{L}]))')"
    hangul = f"regexp_matches(substring(t, i + n, 6), '^($|[^가-힣]|[{particles}]|{longer})')"
    single = f"(n > 1 OR NOT regexp_matches(substring(t, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[가-힣]') AND (NOT regexp_matches(substring(t, i + n, 2), '^[이가][가-힣]') OR regexp_matches(substring(t, i + n, 2), '^[이가][{particles}]')))"
    return f"""words AS (SELECT unnest({listed(words)}) AS word, unnest({listed(words.values())}) AS name, unnest(range({len(words)})) AS place),
near AS (SELECT key, t, word, name, place, length(word) AS n FROM texts JOIN words ON contains(t, word)),
spots AS (SELECT *, unnest(range(1, length(t) - n + 2)) AS i FROM near),
cand AS (SELECT key, i AS start, i + n AS stop, name, row_number() OVER (PARTITION BY key ORDER BY n DESC, place, i) AS rank FROM spots
  WHERE substring(t, i, n) = word AND CASE WHEN regexp_full_match(word, '[ -~]*') THEN {latin} ELSE {hangul} AND {single} END),
grown AS (SELECT key, rank, [{{'a': start, 'b': stop, 'name': name}}] AS kept FROM cand WHERE rank = 1
  UNION ALL SELECT c.key, c.rank, CASE WHEN len(list_filter(g.kept, lambda k: k.a < c.stop AND c.start < k.b)) > 0 THEN g.kept ELSE list_append(g.kept, {{'a': c.start, 'b': c.stop, 'name': c.name}}) END
  FROM grown g JOIN cand c ON c.key = g.key AND c.rank = g.rank + 1),
m AS (SELECT key, x.a AS start, x.b AS stop, x.name AS name FROM (SELECT key, unnest(arg_max(kept, rank)) AS x FROM grown GROUP BY key))"""


def rule_sql(rule: wording.Rule) -> str:
    parts = [matches(rule.side, rule.holds)]
    if rule.within:
        parts.append(matches("clause", rule.within))
    if rule.unless:
        parts.append(f"NOT {matches(rule.side, rule.unless)}")
    return " AND ".join(parts)


PROMPTS = f"""prompts AS (SELECT o_orderkey AS key, {pick(OPENINGS, 'o_orderkey')} || {pick(NOUNS, 'o_orderkey * 7 + o_custkey')} || {pick(JOINTS, 'o_orderkey // 8')} || {pick(NOUNS, 'o_custkey')}
  || {pick(CLOSINGS, 'o_custkey // 3 + o_orderkey')} AS prompt FROM orders),
texts AS (SELECT key, prompt, regexp_replace(lower(prompt), '^\\s+|\\s+$', '', 'g') AS t FROM prompts)"""
ROLE = "CASE " + " ".join(f"WHEN {rule_sql(r)} THEN '{r.role}'" for r in wording.RULES) + " END"
LED = "CASE " + " ".join(f"WHEN {rule_sql(r)} THEN {str(r.side == 'before').lower()}" for r in wording.RULES) + " END"
TARGETS = f"""{PROMPTS}, {found_sql(VOCABULARY)},
gaps AS (SELECT m.*, substring(t, coalesce(lag(stop) OVER w, 1), start - coalesce(lag(stop) OVER w, 1)) AS before, substring(t, stop, coalesce(lead(start) OVER w, length(t) + 1) - stop) AS after FROM m JOIN texts USING (key) WINDOW w AS (PARTITION BY key ORDER BY start)),
sides AS (SELECT *, substring(after, 1, {wording.HEAD}) AS head, regexp_extract(after, {quoted(wording.CLAUSE)}, 1) AS clause, {matches('after', wording.JOINED)} AS joined FROM gaps),
roles AS (SELECT key, start, name, {ROLE} AS own, {LED} AS led, {rule_sql(wording.LONE)} AS lone, {matches('head', wording.ONLY)} AS only_one, coalesce(lag(joined) OVER (PARTITION BY key ORDER BY start), false) AS linked FROM sides),
chains AS (SELECT *, count(*) FILTER (NOT linked) OVER (PARTITION BY key ORDER BY start) AS chain FROM roles),
taken AS (SELECT *, coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY key, chain ORDER BY start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  CASE WHEN last_value(CASE WHEN own IS NOT NULL THEN led END IGNORE NULLS) OVER p THEN last_value(own IGNORE NULLS) OVER p END, 'neutral') AS role
  FROM chains WINDOW p AS (PARTITION BY key, chain ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lists AS (SELECT key, list(name ORDER BY start) FILTER (lone) AS l, list(name ORDER BY start) FILTER (role = 'keep') AS k, list(name ORDER BY start) FILTER (role = 'erase') AS e,
  list(name ORDER BY start) FILTER (role = 'neutral') AS u, list(name ORDER BY start) FILTER (role = 'except') AS x, bool_or(own = 'keep' AND only_one) AS kept_alone FROM taken GROUP BY key),
picked AS (SELECT texts.key, prompt, t, CASE WHEN l IS NOT NULL AND NOT coalesce(kept_alone, false) THEN l WHEN k IS NOT NULL THEN k WHEN e IS NOT NULL AND NOT {matches('t', wording.WANTS_KEPT)} THEN e
  WHEN u IS NOT NULL THEN u WHEN x IS NOT NULL THEN x WHEN e IS NOT NULL THEN e ELSE ['person'] END AS target,
  CASE WHEN l IS NOT NULL AND NOT coalesce(kept_alone, false) THEN true WHEN k IS NOT NULL THEN false ELSE e IS NOT NULL AND NOT {matches('t', wording.WANTS_KEPT)} END AS erase FROM texts LEFT JOIN lists USING (key)),
read AS (SELECT key, prompt, t, erase, list_filter(target, lambda v, i: list_position(target, v) = i) AS target FROM picked)"""
QUOTES = quoted("[\"'“”](.+?)[\"'“”]")
TOKEN = r"coalesce(nullif(regexp_extract(t, '(첫|두|세|네|다섯|\d)\s*(?:번째|째)', 1), ''), nullif(regexp_extract(t, '\b(second|third|fourth|fifth)\b', 1), ''))"
RANK = "coalesce(TRY_CAST(token AS INT), CASE token " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in wording.ORDINALS.items()) + " END)"
COUNT = r"CASE WHEN TRY_CAST(regexp_extract(t, '(\d{1,2})\s*(?:명|마리|개|대)', 1) AS INT) IS NOT NULL THEN greatest(TRY_CAST(regexp_extract(t, '(\d{1,2})\s*(?:명|마리|개|대)', 1) AS INT), 1) WHEN regexp_matches(t, '한\s*(?:명|마리|개|대)|하나') THEN 1 END"


def attribute_sql(colour: str, words: list[str]) -> str:
    tail = "CASE " + " ".join(f"WHEN contains(t, {quoted(w)}) THEN substring(t, instr(t, {quoted(w)}) + {len(w)}, {wording.NEAR})" for w in words) + " END"
    return f"CASE WHEN {holds('t', words)} THEN concat_ws(' ', {quoted(colour)}, {named(tail, wording.PART_WORDS)}) END"


REMOVES = f"(erase OR {holds('t', wording.REMOVE_WORDS)} AND NOT {holds('t', wording.KEEP_WORDS)})"
NUMBER = r"TRY_CAST(regexp_extract(t, '(?:intensity|강도|blur)\s*[:=]?\s*(\d{1,3})', 1) AS INT)"
LATIN = "regexp_replace(regexp_replace(lower(trim({0})), '_', ' ', 'g'), '\\s+', ' ', 'g')"


def longest_sql(known: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(p, {quoted(f' {n} ')}) THEN {quoted(known[n])}" for n in sorted(known, key=lambda x: (-len(x), x))) + " END"


ORACLE_SQL = {
    "worded_targets": f"""WITH RECURSIVE {TARGETS}, q AS (SELECT *, regexp_extract_all(prompt, {QUOTES}, 1) AS quotes FROM read)
SELECT key AS o_orderkey, CASE WHEN len(quotes) = 0 THEN array_to_string(target, ',') ELSE coalesce(nullif(array_to_string(list_filter(list_transform(quotes, lambda v: trim(v)), lambda v: v <> ''), ','), ''), 'person') END AS target, erase FROM q""",
    "worded_effects": f"""WITH RECURSIVE {TARGETS} SELECT key AS o_orderkey, CASE WHEN {REMOVES} THEN 'remove_object' WHEN {holds('t', wording.CROP_WORDS)} THEN 'crop' WHEN {holds('t', wording.BLUR_WORDS)} THEN 'blur' ELSE 'remove_bg' END AS effect,
{holds('t', wording.CROP_WORDS)} AS crop, CASE WHEN {NUMBER} IS NULL THEN 15 ELSE least({NUMBER}, 100) END AS intensity FROM read""",
    "worded_selectors": f"""WITH {PROMPTS}, k AS (SELECT *, {TOKEN} AS token FROM texts)
SELECT key AS o_orderkey, {named('t', wording.POSITION_WORDS)} AS position, nullif({RANK}, 1) AS rank, {COUNT} AS count, concat_ws(',', {', '.join(attribute_sql(c, w) for c, w in wording.COLOUR_WORDS.items())}) AS attributes FROM k""",
    "attribute_pairs": f"""SELECT p_partkey, {longest_sql(COLOURS)} AS colour, {longest_sql(ITEMS)} AS part FROM (SELECT p_partkey, ' ' || {LATIN.format(f"concat_ws(' ', {pick(TONES, 'p_partkey')}, p_type, {pick(THINGS, 'p_size')}, p_name)")} || ' ' AS p FROM part)""",
    "particles": f"""SELECT c_custkey, w || CASE WHEN unicode(right(w, 1)) BETWEEN 44032 AND 55203 AND (unicode(right(w, 1)) - 44032) % 28 <> 0 THEN '을' ELSE '를' END AS phrase
FROM (SELECT c_custkey, c_name || ' ' || {pick(PHRASED, 'c_custkey')} AS w FROM customer)""",
}
