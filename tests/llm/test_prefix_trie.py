"""The prefix tree against a plain one in Python."""

import hashlib
import zlib
from collections import defaultdict

from tidewell.llm import prefix_trie


def brute(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    below = defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = sum(saved[x] for x in below[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    sha = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(below[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def check(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(df).select(*names).collect())
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string"


def test_hard_cases(spark):
    rows = [(c, i or None, None if i % 3 else "user", f"turn {i * (c % 3 if c % 100 > 50 else 1)}") for c in (0, 1, 2, 99, 100, 101, 155, 160, 205, -3, -105) for i in range(abs(c) * 7 % 20)]
    # Null ids, null turns, ties, repeated rows, a base without a conversation, a long text, a borrower without turns of its own.
    rows += [(None, 1, "a", "b"), (7, None, None, None), (7, None, "a", None), (7, 3, "x", "same"), (7, 3, "x", "same"), (300, 1, "u", "only"), (301, 1, "u", "é" * 50000), (705, 1, "u", "v")]
    check(spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA))


def test_long_and_common(spark):
    # One long conversation, one that very many share whole, and one first turn of all.
    rows = [(400, i, "u", f"t{i % 7}") for i in range(150)] + [(c, i, "u", f"s{i}") for c in range(500, 560) for i in range(5)]
    check(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
