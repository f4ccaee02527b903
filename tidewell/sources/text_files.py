"""Readers of JSON folders and lines, the section chunker, and table copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_folder(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per file, with its name as ``case_id``; files that hold something else are skipped."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    parsed = rows.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("case_id"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.trim("value").alias("v"))
    good = parsed.where(F.try_parse_json("v").isNotNull() & F.startswith("v", F.lit("{")))
    return good.select("case_id", "r.*")


def json_lines(spark: SparkSession, path: str, schema: StructType, source: str | None = None) -> DataFrame:
    """JSON lines with ids ``name_0001`` by line number; blank and bad lines are skipped, but counted.

    Line numbers need a file's lines in one order, so each file is read whole by one task, in parallel with the others.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), "value")
    lines = files.select("stem", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    good = lines.where((F.trim("line") != "") & F.try_parse_json("line").isNotNull() & F.startswith(F.trim("line"), F.lit("{")))
    name = F.concat("stem", F.lit("_"), F.format_string("%04d", F.col("pos") + 1))
    out = good.select(name.alias("id"), F.from_json("line", schema).alias("r")).select("id", "r.*")
    return out if source is None else out.withColumn("source", F.lit(source))


def windows(body: Column, whole: int = 1100, size: int = 900, shared: int = 180, least: int = 30) -> Column:
    """A text in windows of ``size`` characters that share ``shared`` with the next; up to ``whole`` characters stay whole.

    A whole text under ``least`` characters gives none. The text is cut once into the steps between windows, and each gets the start of what follows:
    ``substring`` would count characters from the text's start for every window.
    """
    step = size - shared
    steps = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def joined(b: Column) -> Column:
        after = lambda i: F.concat(*(F.coalesce(F.get(b, i + k), F.lit("")) for k in range(1, 1 - -shared // step)))
        return F.transform(b, lambda x, i: F.concat(x, F.substring(after(i), 1, shared)) if shared else x)

    # Bound by a lambda, so that the text is cut once a row.
    cut = F.get(F.transform(F.array(steps), joined), F.lit(0))
    short = F.when(F.length(body) >= least, F.array(body)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(body) <= whole, short).otherwise(cut)


def trimmed(text: Column) -> Column:
    """``text`` without ``\\s`` at its ends; only its ends are looked at, except where the pattern's ``$`` stands before a last line separator."""
    last = F.endswith(text, F.lit("\x85")) | F.endswith(text, F.lit("\u2028")) | F.endswith(text, F.lit("\u2029"))
    return F.when(last, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.btrim(text, F.lit(" \t\n\x0b\f\r")))


def chunks(docs: DataFrame, key: str = "doc_id", least: int = 30) -> DataFrame:
    """``key, section, part, title, text``: sections that start at a heading of level 1 to 3, cut in windows.

    A window that doesn't start with a heading gets its section's title (first line, 120 characters at most) in front.
    """
    pieces = F.when(F.contains("text", F.lit("\n#")), F.split("text", r"\n(?=#{1,3} )")).otherwise(F.array("text"))
    parts = docs.select(key, F.posexplode(F.transform(pieces, trimmed)).alias("section", "body"))
    title = F.substring(trimmed(F.regexp_replace(F.substring_index("body", "\n", 1), "^[# ]+", "")), 1, 120)
    parts = parts.where(F.length("body") >= least).withColumn("title", title)
    cut = parts.select(key, "section", "title", F.posexplode(windows(F.col("body"))).alias("part", "window"))
    text = F.when(F.startswith("window", F.lit("#")), F.col("window")).otherwise(F.concat("title", F.lit("\n"), "window"))
    return cut.select(key, "section", "part", "title", text.alias("text"))


def missing_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The target with the source's rows whose key it lacks; columns that only the source has are left out."""
    new = source.select([c for c in source.columns if c in target.columns]).join(target.select(key), key, "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def refreshed(stored: DataFrame, current: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A store brought up to date: the rows to hold now, and the stale keys to delete."""
    return current, stored.select(key).join(current.select(key), key, "left_anti")


def safe_names(files: DataFrame, job: str, index: str, name: str) -> DataFrame:
    """``files`` with ``out_name``, a name for each file's result that no other file of its ``job`` gets.

    The first file of a name, by ``index``, gives ``stem_result.ext``, later ones ``stem_0007_result.ext`` with their index. If the numbered name is the plain one of
    another file of the job, a digest of the index goes behind the number. ``index`` tells the files of a job apart.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    number = F.when(F.col(index) < 10_000, F.lpad(F.col(index).cast("string"), 4, "0")).otherwise(F.col(index).cast("string"))
    made = lambda *more: F.concat(stem, *more, F.lit("_result"), ext)
    rows = files.withColumns({"_plain": made(), "_numbered": made(F.lit("_"), number)})
    first = F.row_number().over(Window.partitionBy(job, "_plain").orderBy(index)) == 1
    taken = rows.select(job, F.col("_plain").alias("_numbered"), F.lit(True).alias("_taken")).distinct()
    rows = rows.withColumn("_first", first).join(taken, [job, "_numbered"], "left")
    again = made(F.lit("_"), number, F.lit("_"), F.md5(F.col(index).cast("string")))
    out = F.when(F.col("_first"), F.col("_plain")).when(F.col("_taken"), again).otherwise(F.col("_numbered"))
    return rows.withColumn("out_name", out).select(*(F.col(f"`{c}`") for c in files.columns), "out_name")


def coco_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, file_name, width, height, annotations`` of COCO files: one row per image with the list of its annotations."""
    schema = (
        "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:long,name:string>>, "
        "annotations array<struct<image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>"
    )
    files = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.input_file_name())
    images = files.select("file", F.explode("images").alias("i")).select("file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    names = files.select("file", F.explode("categories").alias("c")).select("file", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    notes = files.select("file", F.explode("annotations").alias("a")).select("file", "a.*").where("coalesce(iscrowd, 0) = 0").join(names, ["file", "category_id"], "left")
    lists = notes.groupBy("file", "image_id").agg(F.sort_array(F.collect_list(F.struct("label", "area", "bbox"))).alias("annotations"))
    return images.join(lists, ["file", "image_id"], "left").drop("file")


def polygon_lines(lines: DataFrame, key: str, text: str, mapping: dict[int, int]) -> DataFrame:
    """``key, cls, points`` from label lines ``cls x1 y1 x2 y2 ...``; lines under seven tokens and classes without a match go."""
    rows = lines.select(key, F.explode(F.split(text, "\n")).alias("_line")).select(key, F.split(F.trim("_line"), r"\s+").alias("_t")).where(F.size("_t") >= 7)
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    cls = F.element_at(table, F.get("_t", F.lit(0)).try_cast("int"))
    points = F.transform(F.slice("_t", 2, F.size("_t") - 1), lambda x: x.try_cast("double"))
    return rows.select(key, cls.alias("cls"), points.alias("points")).where("cls is not null")


def owner_folders(spark: SparkSession, path: str, user: str) -> DataFrame:
    """The folders whose ``owner.json`` names a user."""
    rows = spark.read.schema("user_id string").json(path, multiLine=True).withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1))
    return rows.where(F.col("user_id") == user).select("folder")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    df.write.mode("overwrite").json(path)


def run_manifest(records: DataFrame, kind: str, key: str, most: int = 5) -> DataFrame:
    """One line of JSON: how many records of each kind a run made, and the first ``most`` as samples."""
    counts = records.groupBy(kind).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("counts"), F.sum("n").alias("records"))
    shown = records.orderBy(key).limit(most).agg(F.sort_array(F.collect_list(F.struct(key, kind))).alias("samples"))
    return counts.crossJoin(F.broadcast(shown)).select(F.to_json(F.struct("records", "counts", "samples")).alias("manifest"))
