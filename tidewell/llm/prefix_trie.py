"""The tree of conversation prefixes by prefix-doubling naming (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import dealt, forget, written

#: Conversations whose number ends in two zeros lend their first turns to the others of their hundred.
FAMILY = 100
#: The least number of turns that is never lent.
LENT = 6
#: Low bits of ``monotonically_increasing_id`` that count rows within a task.
WITHIN = 33
#: Low bits of a conversation's number that share one row while the ends of a node are gathered.
CHUNK_BITS = 12
#: Prefixes that one block row is copied to at a time.
COPIES = 1 << 12


def lent_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string")) % LENT).cast("int")


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` written in one order across all tasks (if columns are given) with ``part``, the task, and ``at``, the place within it."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    rows = df.withColumn("number", number).withColumn("part", F.shiftright("number", WITHIN)).withColumn("at", F.col("number").bitwiseAND((1 << WITHIN) - 1))
    return written(rows.drop("number"))


def numbered(df: DataFrame, name: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with dense numbers from 0 in ``name``, in the given order, and the written table behind it.

    A task's rows are counted where they lie; only a row per task is summed up and sent to all.
    """
    rows = placed(df, *order)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn(name, F.col("before") + F.col("at")).drop("part", "at", "before"), rows


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, p, name, chars, n``: each rebuilt conversation's turns by place, and ``c, n``: its number of turns (also 0).

    ``name`` numbers the distinct (role, text) in their order, ``chars`` counts the text's code points. A conversation of
    any length is spread over tasks by range; a place in it is its task's share plus the shares before.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text"))
    )
    kinds, kinds_rows = numbered(turns.select("role", "text").distinct(), "name", "role", "text")
    named = turns.join(dealt(kinds), ["role", "text"]).select("c", "turn", "name", F.length("text").alias("chars"))
    rows = placed(named, "c", "turn", "name")
    forget(kinds_rows)

    by = Window.partitionBy("c")
    shares = rows.groupBy("c", "part").agg(F.min("at").alias("low"), F.count("*").alias("share"))
    before = F.coalesce(F.sum("share").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = written(shares.select("c", "part", (before - F.col("low")).alias("shift"), F.sum("share").over(by).alias("own")))
    first = rows.where(F.col("c") % FAMILY == 0).join(dealt(shares), ["c", "part"]).withColumn("p", F.col("at") + F.col("shift")).where(F.col("p") < LENT - 1)
    heads = first.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("p", "name", "chars"))).alias("head")).withColumnRenamed("c", "base")

    each = shares.select("c", "own").distinct().withColumn("h", lent_turns(F.col("c"))).withColumn("base", F.col("c") - F.col("c") % FAMILY)
    head = F.expr("slice(coalesce(head, array()), 1, h)")
    convs = each.join(dealt(heads), "base", "left").withColumn("head", head)
    convs = written(convs.select("c", "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))

    borrowed = convs.select("c", "n", F.explode("head").alias("t")).select("c", "t.p", "t.name", "t.chars", "n")
    kept = rows.join(dealt(shares.select("c", "part", "shift")), ["c", "part"]).join(dealt(convs), "c")
    place = F.col("at") + F.col("shift")
    kept = kept.where(place >= F.col("h")).select("c", (place - F.col("h") + F.size("head")).alias("p"), "name", "chars", "n")
    out = written(borrowed.unionByName(kept))
    forget(rows)
    forget(shares)
    return out, convs.select("c", "n")


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k the named blocks ``c, p, name, n``: turns p * 2**k to (p + 1) * 2**k - 1 of conversation c.

    Equal blocks have equal names. A level joins the distinct pairs of halves with their numbers, so ``levels`` rounds do.
    """
    out = [turns.select("c", "p", "name", "n")]
    for _ in range(levels):
        half = F.col("p").bitwiseAND(1)
        pairs = out[-1].groupBy("c", F.shiftright("p", 1).alias("q")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"), F.max("n").alias("n")
        )
        pairs = written(pairs.where("left is not null and right is not null"))
        names, rows = numbered(pairs.select("left", "right").distinct(), "name")
        out.append(written(pairs.join(dealt(names), ["left", "right"]).select("c", F.col("q").alias("p"), "name", "n")))
        forget(rows)
        forget(pairs)
    return out


def prefixes(turns: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``c, d, key, up, chars, last``: each prefix of d turns of each conversation.

    The binary digits of d cut the prefix into blocks, the largest first; ``key`` is the list of their names, so prefixes
    of one length are equal if and only if their keys are. ``up`` is the key of the prefix one turn shorter.
    """
    parts = []
    for k, level in enumerate(levels):
        size = 1 << k
        # A block with an even number p is a part of the prefixes that end within the block after it.
        low = (F.col("p") + 1) * size
        high = F.least(F.col("n"), low + (size - 1))
        d = level.where(F.col("p").bitwiseAND(1) == 0).select("c", "n", "name", low.alias("low"), high.alias("high"))
        if size > COPIES:
            d = d.withColumn("low", F.explode(F.expr(f"sequence(low, high, {COPIES}L)"))).withColumn("high", F.least("high", F.col("low") + (COPIES - 1)))
        d = d.select("c", "n", F.lit(-k).alias("k"), "name", F.explode(F.sequence("low", "high")).alias("d"))
        parts.append(d.select("c", "n", "k", "name", F.explode(F.array(F.struct("d", F.lit(True).alias("own")), F.struct((F.col("d") + 1).alias("d"), F.lit(False).alias("own")))).alias("x")))
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    held = held.where("x.d <= n").select("c", "n", "k", "name", "x.d", "x.own", F.lit(None).cast("int").alias("chars"))
    last = turns.select("c", "n", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("name"), (F.col("p") + 1).alias("d"), F.lit(None).cast("boolean").alias("own"), "chars")
    digits = {c: F.sort_array(F.collect_list(F.when(F.col("own") == own, F.struct("k", "name")))) for c, own in (("key", True), ("up", False))}
    out = held.unionByName(last).groupBy("c", "d").agg(*(x.alias(c) for c, x in digits.items()), F.max("chars").alias("chars"), F.max("n").alias("n"))
    return out.select("c", "d", F.col("key.name").alias("key"), F.col("up.name").alias("up"), "chars", (F.col("d") == F.col("n")).alias("last"))


def digests(chunks: DataFrame) -> DataFrame:
    """``d, conv_id, ends_sha256``: SHA-256 of each node's ids, comma-joined in order; ``chunks`` has d, conv_id, chunk and ids, a text.

    The chunks of a node stream through one hash, so a node with very many ends needs time but no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["d", "conv_id", "ends_sha256"])

        for batch in batches:
            for d, conv_id, ids in zip(*(batch.column(c).to_pylist() for c in ("d", "conv_id", "ids")), strict=True):
                if node == (d, conv_id):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (d, conv_id), hashlib.sha256(ids.encode())
            if done:
                yield closed()
                done = []
        if node:
            done.append((*node, state.hexdigest()))
            yield closed()

    rows = chunks.repartition("d", "conv_id").sortWithinPartitions("d", "conv_id", "chunk")
    return rows.select("d", "conv_id", "ids").mapInArrow(run, "d long, conv_id long, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``d, conv_id, leaves, saved`` of the nodes of ``nodes`` (d, conv_id, parent, leaves, saved), summed over their subtrees.

    Pointers to ancestors double in reach each round: a node's sum over all less than 2**k below, and the sums of those 2**k below it, give its sum over all less than 2**(k+1) below.
    """
    depth = nodes.agg(F.max("d")).first()[0] or 0
    held, step = nodes.withColumnRenamed("parent", "above"), 1
    while step <= depth:
        sums = held.where("above is not null").groupBy((F.col("d") - step).alias("d"), F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        # Only nodes whose ancestor has itself one as far up keep a pointer.
        jump = held.where("above is not null").select((F.col("d") + step).alias("d"), F.col("conv_id").alias("above"), F.col("above").alias("next"))
        added = [F.col(a) + F.coalesce(F.col(b), F.lit(0)) for a, b in (("leaves", "l"), ("saved", "s"))]
        after = held.join(dealt(sums), ["d", "conv_id"], "left").join(dealt(jump), ["d", "above"], "left")
        after = written(after.select("d", "conv_id", F.col("next").alias("above"), added[0].alias("leaves"), added[1].alias("saved")))
        if step > 1:
            forget(held)
        held, step = after, 2 * step
    return held.select("d", "conv_id", "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix tree of the rebuilt conversations of ``conversations`` (conv_id, turn, role, text).

    A conversation's turns are ordered by turn (null first; ties by role, then text) and its first h turns replaced by those
    of the first conversation of its hundred (``lent_turns``). Each distinct sequence of first turns is a node, from the root
    without turns on: ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree: (n_convs - 1) times the last text's code points), ``ends_sha256``.

    Null roles and texts are empty ones; rows whose conv_id is null belong to no conversation and are left out; repeated rows
    are turns of their own. Other columns are not read, whatever their names. Long texts are only compared and counted.
    Empty table: no rows, also no root.
    """
    turns, convs = rebuilt_turns(conversations)
    longest = convs.agg(F.max("n")).first()[0] or 0
    levels = blocks(turns, max(longest, 1).bit_length() - 1)
    rooted = convs.select("c", F.lit(0).cast("long").alias("d"), F.expr("cast(array() as array<bigint>)").alias("key"), F.expr("cast(null as array<bigint>)").alias("up"), F.lit(0).alias("chars"), (F.col("n") == 0).alias("last"))
    every = written(prefixes(turns, levels).unionByName(rooted))
    for used in [*levels[1:], turns]:
        forget(used)

    keyed = written(every.groupBy("d", "key").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("up").alias("up")))
    chunk = F.shiftright("c", CHUNK_BITS).alias("chunk")
    ends = every.where("last").groupBy("d", "key", chunk).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))
    names = keyed.select("d", "key", "conv_id")
    shas = digests(ends.join(dealt(names), ["d", "key"]).drop("key"))
    above = names.select((F.col("d") + 1).alias("d"), F.col("key").alias("up"), F.col("conv_id").alias("parent"))
    nodes = written(keyed.join(dealt(above), ["d", "up"], "left").select("d", "conv_id", "parent", "n_convs", "chars"))
    marks = written(shas)
    forget(every)
    forget(keyed)

    # Below a node of one conversation there is one leaf and nothing to save: only shared nodes are summed.
    below = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    nodes_counted = written(nodes.join(dealt(below), ["d", "conv_id"], "left").na.fill(0, ["n_children", "lone"]))
    forget(nodes)
    own = (F.col("n_children") == 0).cast("long") + F.col("lone")
    shared = nodes_counted.where("n_convs > 1").select("d", "conv_id", "parent", own.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = subtree_sums(shared)
    out = nodes_counted.join(dealt(sums), ["d", "conv_id"], "left").join(dealt(marks), ["d", "conv_id"], "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
