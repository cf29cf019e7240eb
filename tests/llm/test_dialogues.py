"""The conversation trie against plain dictionaries."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from lectern.llm import dialogues


def plain(rows):
    """Nodes of rows (conv_id, turn, role, text) by whole paths."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn, digest, role, text))
    turns = {c: [x[3:] for x in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, t in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = sum(saved[x] for x in children[path]) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if built[c] == p))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def talks():
    rows = []
    for c in range(1, 121):
        shared = [("user", f"hello {c % 3}"), ("assistant", "hi é 🙂"), ("user", f"ask {c % 7 // 3}")]
        rows += [(c, i, role, text) for i, (role, text) in enumerate((shared + [("assistant", f"answer {c % 11 // 4}")] * (c % 9))[: c % 13])]
    rows += [(c, i, "user", f"the same {i}") for c in range(1000, 1060) for i in range(12)]  # equal conversations
    rows += [(2001, None, None, None), (2001, None, "a", "b"), (2001, 3, "b", ""), (2001, 3, "a", "tie"), (2001, 3, "a", "tie"), (2002, 0, "user", "long " * 30_000), (None, 0, "user", "no id"), (-3, 0, "u", "negative")]
    return rows + [(3000, i, "u", f"only {i}") for i in range(60)]  # longer than a group of the second test


@pytest.mark.parametrize("limit", [dialogues.LIMIT, 15])
def test_nodes_equal_those_of_whole_paths(spark, limit):
    table = spark.createDataFrame([(*r, "x") for r in talks()], "conv_id long, turn long, role string, text string, depth string").repartition(5)
    got = dialogues.prefix_tree(table, limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain(talks())


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(dialogues, "PIECE", 7)
    ids = list(range(-20, 300, 3))
    got = dialogues._hashes(spark.createDataFrame([(-20, c) for c in ids] + [(1000, 1000), (1000, 1001)], "rep long, conv_id long").repartition(4)).collect()
    assert {r.rep: r.sha for r in got} == {-20: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 1000: hashlib.sha256(b"1000,1001").hexdigest()}


def test_no_conversations_have_no_nodes(spark):
    assert dialogues.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
