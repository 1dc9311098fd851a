import hashlib
import random
import re
import zlib

import pytest

from loomtrace.llm import tries
from loomtrace.llm.tries import conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq string, cont string, pos int"


def key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """Nodes by a dictionary of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    children, below = {}, {}
    for s in members:
        if s:
            children[s[:-1]] = children.get(s[:-1], 0) + 1
    for s, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            x = below.setdefault(s[:d], [0, 0])
            x[0] += s not in children
            x[1] += saved
    return [(min(c for c, _ in m), len(s), min(c for c, _ in members[s[:-1]]) if s else None, len(m), children.get(s, 0), *below[s],
             hashlib.sha256(",".join(str(c) for c, end in sorted(m) if end).encode()).hexdigest()) for s, m in members.items()]


def order(rows):
    return sorted((tuple(-1 if x is None else x for x in r) for r in rows), key=str)


def made(seed, n=60, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None, " \n", "x y z"][:words])))
    return rows


@pytest.mark.parametrize(("seed", "container"), [(1, 3), (2, 12), (3, 1 << 14)])
def test_equals_a_dictionary_of_prefixes(spark, seed, container):
    rows = made(seed)
    rows += [(500 + i, t, "user", f"shared {t}") for i in range(20) for t in range(9 + i % 3)]  # copies of three lengths, prefixes of each other
    rows += [(900 + i, t, "user", f"chain {t}") for i in range(25) for t in range(i + 4)]  # a chain of prefixes
    rows += [(940, 0, "user", "tie"), (940, 0, "user", "other tie"), (940, None, "user", "no turn"), (940, None, "user", "no turn"), (None, 0, "user", "a")]
    got = conversation_trie(spark.createDataFrame([(*r, "s", "c", 1) for r in rows], SCHEMA).repartition(4), container)
    assert order(map(tuple, got.collect())) == order(plain(rows))


def test_a_conversation_longer_than_pieces_and_containers(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 16)
    monkeypatch.setattr(tries, "IDS", 3)
    rows = [(20, t, "user", f"turn {t} {'w ' * (t % 5)}") for t in range(300)] + [(21, t, "user", f"turn {t} {'w ' * (t % 5)}") for t in range(150)]
    rows += [(22 + i, t, "user", f"turn {t} {'w ' * (t % 5)}" if t < 40 * i else f"own {i}") for i in range(1, 5) for t in range(200)]
    rows += [(100 + i, 0, "user", "the same") for i in range(50)]
    got = conversation_trie(spark.createDataFrame([(*r, "s", "c", 1) for r in rows], SCHEMA).repartition(4), 20)
    assert order(map(tuple, got.collect())) == order(plain(rows))


def test_few_and_no_conversations(spark):
    for rows in ([], [(None, 0, "user", "a")], [(7, 0, "user", "a")], [(-3, 0, "user", "a"), (-20, 1, "user", "b"), (-20, 0, "user", "b")]):
        got = conversation_trie(spark.createDataFrame([(*r, "s", "c", 1) for r in rows], SCHEMA))
        if rows and rows[0][0] == -3:
            # The remainder keeps its sign: -3 belongs to the group of 0, which is absent.
            h = zlib.crc32(b"-3") % 4
            assert {r.conv_id for r in got.collect()} == {-20} and got.filter("depth = 0").first().n_convs == 2 and (h == 0) == (got.filter("depth = 1").count() == 2)
        else:
            assert order(map(tuple, got.collect())) == order(plain(rows))
