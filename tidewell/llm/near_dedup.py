"""MinHash near-duplicate detection (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.shared import dealt, forget, slices, text_bytes, written

BATCH_BYTES = 1_000_000
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Share of equal minima below which a pair is not checked on full sets: five standard errors below 0.8.
SLACK = 5 * (0.8 * 0.2 / HASHES) ** 0.5
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def universal() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the hash family ``(a * x + b) >> 32``."""
    r = np.random.default_rng(8)
    return r.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, HASHES, np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``size``-word shingles; a shorter text's words are one shingle."""
    words = [t.encode().translate(LOWER).split() if t else [] for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    hashes = pd.util.hash_array(np.array(distinct, dtype=object), categorize=False)[codes]
    out, at = [], 0
    for ws in words:
        n = len(ws)
        h = hashes[at : at + n]
        at += n
        width = min(size, n)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            total = total * STEP + h[k : n - width + 1 + k]
        out.append(np.unique(mixed(total + np.uint64(width))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of every set under every hash of the family; sets must not be empty."""
    a, b = universal()
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), first)
    return out


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, set_key`` (equal for equal sets), ``minima`` (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            full = [s for s in sets if len(s)]
            minima = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                    pa.array([next(minima).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "minima"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n_shingles long, set_key string, minima binary"))


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key per row and band."""
    parts = minima.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * STEP + parts[:, :, k])
    return key


def banded(nodes: DataFrame) -> DataFrame:
    """``bucket, node``: one row per band of each node's minima, in buckets that hold two nodes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = band_keys(np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES))
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node, pa.int64())], ["bucket", "node"])

    rows = written(nodes.select("node", "minima").mapInArrow(run, "bucket long, node long").distinct())
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    out = written(rows.join(dealt(shared), "bucket"))
    forget(rows)
    return out


def hubs_of(placed: DataFrame) -> DataFrame:
    """``bucket, node, component, weight, hub, hub_component, hub_weight``: each place (bucket, node, component, n) with its bucket's hub.

    The hub is the node that shares most buckets' places, the likely centre of a group of copies. The order of nodes is the
    same in all buckets, so a group's buckets mostly agree on their hub.
    """
    weight = placed.groupBy("node").agg(F.sum("n").alias("weight"))
    rows = placed.join(dealt(weight), "node")
    best = rows.groupBy("bucket").agg(F.max(F.struct("weight", "node", "component")).alias("top"))
    hubs = best.select("bucket", F.col("top.node").alias("hub"), F.col("top.component").alias("hub_component"), F.col("top.weight").alias("hub_weight"))
    return rows.join(dealt(hubs), "bucket")


def first_pairs(buckets: DataFrame) -> DataFrame:
    """Each node with the heaviest of its buckets' hubs: a pair per node."""
    best = hubs_of(buckets.withColumn("component", F.col("node"))).groupBy("node").agg(F.max(F.struct("hub_weight", "hub")).alias("top"))
    return best.select("top.hub", "node").where("hub <> node")


def further_pairs(placed: DataFrame, most: int = 2) -> DataFrame:
    """Each node with ``most`` of its buckets' hubs that are in another component by now: those it shares most buckets with."""
    other = hubs_of(placed).where("component <> hub_component").groupBy("node", "hub").agg(F.count("*").alias("shared"), F.first("hub_weight").alias("hub_weight"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("shared", "hub_weight", "hub")), asc=False), 1, most)
    return other.groupBy("node").agg(best.alias("best")).select(F.explode("best.hub").alias("hub"), "node")


def alike(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (hub, node) of which the share of equal minima is at least ``least``.

    Only the low bytes of the minima travel: equal minima have equal low bytes, so no pair is lost, and the few that
    agree by chance are checked on full sets like the others.
    """

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in minima], pa.binary())], ["node", "low"])

    marks = written(nodes.select("node", "minima").mapInArrow(low, "node long, low binary"))
    a = marks.select(F.col("node").alias("hub"), F.col("low").alias("low_a"))
    both = pairs.join(dealt(marks.withColumnRenamed("low", "low_b")), "node").join(dealt(a), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("low_a", "low_b"))
            keep = pa.array((p == q).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node")], ["hub", "node"]).filter(keep)

    return both.select("hub", "node", "low_a", "low_b").mapInArrow(run, "hub long, node long").distinct()


def linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (hub, node) whose full sets have ``100 * intersection >= percent * union``, as ``u, v``.

    A hub's text meets its nodes' texts in tasks of about a thousand nodes each: a hub with many nodes is dealt to
    as many tasks as it needs, and rows stream through, the hub's first.
    """
    pairs = written(pairs)
    ids = pairs.select("hub").union(pairs.select("node")).distinct().withColumnRenamed("hub", "doc_id")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(dealt(ids), "doc_id", "left_semi"))
    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / 1000).cast("int").alias("shares"))
    members = pairs.join(dealt(shares), "hub").select("hub", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), F.lit(1).alias("role"), "node")
    heads = shares.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), F.col("hub").alias("node"))
    rows = members.unionByName(heads).join(dealt(texts.withColumnRenamed("doc_id", "node")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, []
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            found = []
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            for h, role, node, s in zip(*(batch.column(c).to_pylist() for c in ("hub", "role", "node")), sets, strict=True):
                if role == 0:
                    own = [*own, s] if h == hub else [s]
                    hub = h
                    continue
                for o in own if h == hub else ():
                    both = len(np.intersect1d(o, s, assume_unique=True))
                    if 100 * both >= percent * (len(o) + len(s) - both) > 0:
                        found.append((h, node))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    placed = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", "role")
    out = written(placed.mapInArrow(run, "u long, v long"))
    forget(texts)
    forget(pairs)
    return out


def facing(placed: DataFrame, left: int, right: int) -> DataFrame:
    """``bucket, i, j, role, node, component, minor``: the places of every bucket with several components, set against each other in blocks.

    A bucket's nodes outside its largest component (``minor``) are cut into blocks i of about ``left`` nodes, role 0; all its nodes into
    blocks j of about ``right`` nodes, role 1. Every block i meets every block j, so every pair of nodes of different
    components meets, while a node of the largest component travels once per ``left`` minor nodes and not once per node.
    """
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("n")).where("parts > 1")
    blocks = sizes.select("bucket", F.col("top.component").alias("major"), F.ceil((F.col("n") - F.col("top.n")) / left).cast("int").alias("a"), F.ceil(F.col("n") / right).cast("int").alias("b"))
    rows = placed.select("bucket", "node", "component").join(dealt(written(blocks)), "bucket").withColumn("minor", F.col("component") != F.col("major"))
    own, every = (lambda n: F.pmod(F.xxhash64("node"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    few = rows.where("minor").select("bucket", own("a").alias("i"), every("b").alias("j"), F.lit(0).alias("role"), "node", "component", "minor")
    return few.unionByName(rows.select("bucket", every("a").alias("i"), own("b").alias("j"), F.lit(1).alias("role"), "node", "component", "minor"))


def meetings(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple], list[tuple], bool]]:
    """``(group, left, right, last)`` from rows sorted by bucket, i, j, role: a group's left block whole, with its right block in portions."""
    group, left, right = None, [], []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "role", *columns)), strict=True):
            if r[:3] != group:
                if group is not None:
                    yield group, left, right, True
                group, left, right = r[:3], [], []
            (right if r[3] else left).append(r[4:])
            if len(right) == 512:
                yield group, left, right, False
                right = []
    if group is not None:
        yield group, left, right, True


def promising(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The rows of ``facing`` that have a partner in their group: of another component and with enough equal minima.

    A pair that several buckets hold counts in the one of its first shared band.
    """
    columns = ("node", "component", "minor", "minima")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked: set[int] = set()
        for group, left, right, last in meetings(batches, columns):
            out = []
            if left and right:
                a, b = (np.frombuffer(b"".join(r[3] for r in x), np.uint32).reshape(-1, HASHES) for x in (left, right))
                same, first = np.zeros((len(a), len(b)), np.uint8), np.full((len(a), len(b)), BANDS, np.uint8)
                for band in reversed(range(BANDS)):
                    whole = np.ones(same.shape, bool)
                    for k in range(band * ROWS, (band + 1) * ROWS):
                        equal = a[:, k, None] == b[None, :, k]
                        same += equal
                        whole &= equal
                    first[whole] = band
                own = int(np.flatnonzero(band_keys(a[:1])[0].view(np.int64) == group[0])[0])
                (na, ca, _), (nb, cb, mb) = (tuple(np.array([r[k] for r in x]) for k in range(3)) for x in (left, right))
                ok = (same >= least * HASHES) & (first == own) & (ca[:, None] != cb[None, :]) & (~mb[None, :] | (na[:, None] < nb[None, :]))
                marked.update(np.flatnonzero(ok.any(axis=1)).tolist())
                out = [(1, *right[y][:3]) for y in np.flatnonzero(ok.any(axis=0))]
            if last:
                out += [(0, *left[x][:3]) for x in sorted(marked)]
                marked = set()
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(FACING, (*group, *r), strict=True)) for r in out], schema=FACING_SCHEMA)

    placed = rows.join(dealt(nodes.select("node", "minima")), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "role")
    return written(placed.select("bucket", "i", "j", "role", *columns).mapInArrow(run, "bucket long, i int, j int, role int, node long, component long, minor boolean"))


FACING_SCHEMA = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("role", pa.int32()), ("node", pa.int64()), ("component", pa.int64()), ("minor", pa.bool_())])
FACING = FACING_SCHEMA.names


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    flat, owner = np.concatenate(left), np.repeat(np.arange(len(left)), [len(s) for s in left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(right), len(left)), np.int64)
    for k, s in enumerate(right):
        a, b = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[k] = np.bincount(owner[at], minlength=len(left))
    return out.T


def cross_links(placed: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, size: int, percent: int, left: int = 256, right: int = 4096) -> DataFrame:
    """Links ``u, v`` between components that share a bucket: the exact way for what hubs miss.

    Full sets of promising rows meet in the groups of ``facing``; a group compares all its pairs and keeps those links alone that join two components
    not joined in it before, a spanning forest. A task holds one left block's sets and a portion of the right's.
    """
    rows = promising(facing(placed, left, right), nodes, least)
    ids = rows.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(dealt(ids), "doc_id", "left_semi")
    rows = rows.join(dealt(texts.withColumnRenamed("doc_id", "node")), "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, parts, sets, root = None, [], [], [], {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in slices(batches, text_bytes, BATCH_BYTES):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")), strict=True))
            role, node, part = (batch.column(c).to_pylist() for c in ("role", "node", "component"))
            own = shingle_sets(batch.column("text").to_pylist(), size)
            found, at = [], 0
            while at < len(keys):
                if keys[at] != group:
                    group, ids, parts, sets, root = keys[at], [], [], [], {}
                stop = at
                while stop < len(keys) and keys[stop] == group and role[stop] == role[at]:
                    stop += 1
                if role[at] == 0:
                    ids, parts, sets = ids + node[at:stop], parts + part[at:stop], sets + own[at:stop]
                elif sets:
                    both = common(sets, own[at:stop])
                    sizes = [np.array([len(s) for s in x]) for x in (sets, own[at:stop])]
                    apart = np.array(parts)[:, None] != np.array(part[at:stop])[None, :]
                    for x, y in zip(*np.nonzero(apart & (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))), strict=True):
                        a, b = top(parts[x]), top(part[at + y])
                        if a != b:
                            root[a] = b
                            found.append((ids[x], node[at + y]))
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return written(rows.select("bucket", "i", "j", "role", "node", "component", "text").mapInArrow(run, "u long, v long"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: groups linked by a Jaccard similarity of ``percent`` or more.

    Words are split at ASCII white space after lower-casing A-Z; a set holds the distinct ``size``-word shingles.
    1. Minima under ``HASHES`` universal hashes; rows with equal sets become one node, its least doc_id.
    2. ``BANDS`` bands of ``ROWS`` minima give buckets: a pair at 0.8 shares none once in 300,000 times.
    3. Each node is checked against the heaviest hub of its buckets, then against up to two hubs that are in another component
       by then: first by equal minima, then on full sets.
    4. Components by large-star and small-star. Where a bucket still holds several components, the nodes outside its largest are
       compared with all in blocks, by minima and then on full sets, so no candidate pair within a bucket stays untested;
       a block emits a spanning forest of verified links.
    5. Components again; each row gets the least doc_id reachable. ``kept``: the row has that doc_id.

    Texts without words and null texts link with nothing. Rows of one doc_id are versions of one document and
    share a component. A null doc_id takes part; alone, its component is null and it is kept.
    """
    marked = signed(docs, size)
    classes = written(marked.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("minima").alias("minima")))
    nodes = classes.where("node is not null").select("node", "minima")
    buckets = banded(nodes)
    least = percent / 100 - SLACK
    links = linked(alike(first_pairs(buckets), nodes, least), docs, size, percent)

    def located(groups: DataFrame) -> DataFrame:
        return buckets.select("bucket", "node", "n").join(dealt(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))

    links = links.unionByName(linked(alike(further_pairs(located(written(components(links)))), nodes, least), docs, size, percent))
    groups = written(components(links))
    more = cross_links(located(groups), nodes, docs, least, size, percent)
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    of = classes.select("set_key", "node").join(dealt(groups), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    lone = marked.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = marked.where("set_key is not null").join(dealt(of), "set_key", "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return rows.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
