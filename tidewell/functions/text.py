"""Text expressions: normal forms, grams, tokens, hashes. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it; Java's class lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
# What counts as a token, and as a phrase, of lower-cased text.
TOKEN = "([가-힣]{2,}|[A-Za-z0-9_.:/-]{2,})"
PHRASE = "([가-힣]{2,}|[a-z0-9_.:/-]{3,})"


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def compact(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), SPACE, "")


def characters(text: Column) -> Column:
    """A text's characters as an array; empty for empty text. Grams need it as a column of its own, so that it is made once a row."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_grams(chars: Column, sizes: tuple[int, ...]) -> Column:
    """All grams of the given sizes, in order, repeats included; fewer characters than a size give none of it.

    ``chars`` must be a plain column. Characters are fetched by index, so the work is linear in the text.
    """

    def of(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))
        return F.when(F.size(chars) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes)) if len(sizes) > 1 else of(sizes[0])


def each(array: str) -> Column:
    """A row per element that isn't null.

    Not the bare column: Spark would infer a filter on it and work all steps that lead to the column into that filter.
    """
    return F.explode(F.filter(array, lambda x: x.isNotNull()))


def padded(text: Column) -> Column:
    """The normal form between two blanks."""
    return F.concat(F.lit(" "), normal(text), F.lit(" "))


def with_padded_grams(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the grams of two and three characters of the padded normal form; blank grams are left out."""
    rows = df.withColumn("_chars", characters(padded(F.col(text)))).withColumn(name, char_grams(F.col("_chars"), (2, 3)))
    return rows.withColumn(name, F.filter(name, lambda g: F.trim(g) != "")).drop("_chars")


def with_gram_set(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the distinct two-character grams of the compact form; one character is its own gram, empty text has none."""
    rows = df.withColumn("_chars", characters(compact(text)))
    found = F.when(F.size("_chars") >= 2, F.array_distinct(char_grams(F.col("_chars"), (2,)))).otherwise(F.col("_chars"))
    return rows.withColumn(name, found).drop("_chars")


def with_hashed_grams(df: DataFrame, text: str, name: str, width: int) -> DataFrame:
    """``df`` with the cell (crc32 modulo ``width``) of every gram of two and three characters of the compact form.

    A text of one character is its own gram; an empty one has the gram ``empty``.
    """
    rows = df.withColumn("_chars", characters(compact(F.col(text))))
    short = F.when(F.size("_chars") == 1, F.col("_chars")).otherwise(F.array(F.lit("empty")))
    found = F.when(F.size("_chars") >= 2, char_grams(F.col("_chars"), (2, 3))).otherwise(short)
    return rows.withColumn(name, F.transform(found, lambda g: F.pmod(F.crc32(g), F.lit(width)).cast("int"))).drop("_chars")


def tokens(text: Column) -> Column:
    """Runs of two or more Hangul syllables or of ASCII letters, digits and ``_.:/-``; ``empty`` if there are none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))
    # Bound by a lambda, so that the pattern is run once a row.
    return F.get(F.transform(F.array(found), lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("empty")))), F.lit(0))


def overlap(query: Column, other: Column) -> Column:
    """Share of the query's distinct elements that the other array has; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, other)) / F.size(query)).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    """A vector scaled to length 1; zeros stay."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sha1_remainder(text: Column) -> Column:
    """The 160-bit SHA-1 number modulo 10: powers of 16 above the first leave 6, so parts of 15 digits add up."""
    digest = F.sha1(text)
    parts = [F.conv(F.substring(digest, at, n), 16, 10).cast("long") % 10 for at, n in ((1, 10), (11, 15), (26, 15))]
    return (6 * (parts[0] + parts[1]) + parts[2]) % 10


def split_name(key: Column) -> Column:
    """A fixed split of ids: a tenth to ``val``, the rest to ``train``."""
    return F.when(sha1_remainder(key) == 0, "val").otherwise("train")


#: ``sha1_remainder`` of an expression in DuckDB.
def sha1_remainder_sql(text: str) -> str:
    digits = f"list_transform(string_split(sha1({text}), ''), lambda c: strpos('0123456789abcdef', c) - 1)"
    return f"((6 * list_sum({digits}[1:39]) + {digits}[40]) % 10)"


def mojibake(text: Column) -> Column:
    """Text that looks wrongly decoded, or is blank: letters of U+0080 to U+00FF but no Hangul."""
    return text.isNull() | (F.regexp_replace(text, SPACE, "") == "") | (text.rlike(r"[\x{80}-\x{ff}]") & ~text.rlike("[가-힣]"))
