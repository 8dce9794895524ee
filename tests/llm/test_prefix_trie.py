"""The trie of conversations against one made of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from touchline.llm import prefix_trie
from touchline.llm.base import table


def brute(rows):
    """(conv_id, depth) -> (parent, n_convs, n_children, n_leaves, saved, digest of ends), all by walking prefixes."""
    order = lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode())
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=order)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 9, abs(c) % 5 * (1 if c > 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + turns[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)

    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[node]]
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        sums[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    out = {}
    for node, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[min(convs), len(node)] = (min(members[node[:-1]]) if node else None, len(convs), len(children[node]), *sums[node], digest, node[-1] if node else None)
    return out


def built(conversations, piece=prefix_trie.PIECE):
    turns = prefix_trie.numbered(conversations)
    rebuilt, convs = prefix_trie.branched(turns)
    nodes = prefix_trie.with_ends(prefix_trie.build(rebuilt, convs), piece)
    rows = prefix_trie.with_text(nodes, rebuilt, turns).collect()
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256, (r.role, r.text) if r.depth else None) for r in rows}, rows


@pytest.mark.parametrize("folder", ["odd", "/root/testdata/sf0.001"])
def test_as_brute_force(spark, odd_folder, folder):
    conversations = table(spark, odd_folder if folder == "odd" else folder, "conversations")
    got, rows = built(conversations)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()])
    assert len(rows) == len(got)


def test_copies_deeper_than_a_block_and_pieces_of_ends(spark):
    """Conversations that part after 20 turns, many that end in one node, and one turnless once rebuilt; ids are formatted 7 at a time."""
    r = random.Random(3)
    same = [("user", f"turn {i}") for i in range(20)]
    rows = [(5 * c, i, *t) for c in range(60) for i, t in enumerate(same[: 20 if c % 3 else 12] + ([("user", str(c))] if c % 5 == 0 else []))]
    rows += [(5 * c + 1001, 0, "user", r.choice("ab")) for c in range(40)]
    r.shuffle(rows)
    got, _ = built(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 7)
    assert got == brute(rows)
    assert max(d for _, d in got) == 21 and got[0, 0][1] == 100


def test_one_conversation_holds_most_turns(spark):
    rows = [(7, i, "user", f"t{i % 3}") for i in range(5000)] + [(c, i, "user", f"t{i}") for c in range(5) for i in range(3)] + [(None, 0, "user", "x")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = prefix_trie.numbered(conversations)
    assert sorted(x.pos for x in turns.where("conv_id = 7").collect()) == list(range(1, 5001))
    assert turns.where("conv_id = 7").selectExpr("max(pos) p", "max_by(text, pos) t").first().t == f"t{4999 % 3}"
    got, _ = built(conversations)
    assert got == brute(rows)
