"""The trie against plain prefixes: nulls, ties, repeats, families, copies, one long conversation, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from docloom.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, words long, pos long, n long, depth long, prefix string, cell long, row long, h long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        if c is not None:
            own[c].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * words
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else None, len(m), children[x], leaves[x], saved[x], sha(",".join(map(str, sorted(ends[x])))))
        for x, m in members.items()
    )


def result(spark, rows):
    table = spark.createDataFrame([(*r, "d", 1, 2, 3, 4, "p", 5, 6, 7) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in prefixtrie.digest(prefixtrie.nodes(table)).collect())


ODD = [
    (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "b c"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "", "x\x1cy \t z"),
    (None, 0, "user", "lost"), (None, 1, "user", "lost"), (20, 0, "user", "ab"), (21, 0, "use", "rab"), (-3, 1, "user", "neg"), (-3, 0, "user", "neg"), (40, 1, "a", "1 2 3"),
]


@pytest.mark.parametrize(("classes", "long", "many"), [(256, 10_000, 10_000), (2, 4, 3)])
def test_trie_agrees_with_plain_prefixes(spark, monkeypatch, classes, long, many):
    monkeypatch.setattr(prefixtrie, "MOST_CLASSES", classes)
    monkeypatch.setattr(prefixtrie, "LONG", long)
    monkeypatch.setattr(prefixtrie, "MANY", many)
    monkeypatch.setattr(prefixtrie, "BUCKET_TURNS", 50)
    rows = list(ODD)
    rows += [(c, t, "user", "hot one two") for c in range(100, 160) for t in range(4)]  # copies
    rows += [(c, t, "user", "hot one two" if t < 2 else f"turn {c % 9} {t}") for c in range(200, 240) for t in range(7)]
    rows += [(c, t, "user", f"word {c} {t}") for c in range(300, 330) for t in range(c % 6)]
    rows += [(500, t, "user", f"deep {t}") for t in range(600)] + [(501, t, "user", f"deep {t}" if t < 9 else f"other {t}") for t in range(40)]
    rows += [(520 + i, t, "user", f"deep {t}") for i in range(3) for t in range(600)]
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")], [(7, 1, "user", "a")], [(3, 0, None, None), (5, 0, None, None)]])
def test_none_and_few(spark, rows):
    assert result(spark, rows) == expected(rows)
