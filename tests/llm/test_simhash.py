import random

import numpy as np
import pytest
import xxhash

from netsight.llm import graph, simhash


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, near):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a in nodes:
        for b in nodes:
            if near(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_query(documents, nasty):
    found = simhash.near_duplicates(documents(nasty)).collect()
    assert len(found) == len(nasty)
    prints = [(i, plain_print(t)) for i, t, _ in nasty]
    groups = plain_groups({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    expected = [(i, f"{p:016x}", least.get(groups[p])) for i, p in prints]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert simhash.near_duplicates(documents([])).count() == 0


def _prints(seed, many):
    """Fingerprints in dense balls of few differing bits, and far ones."""
    r = random.Random(seed)
    out = set()
    for _ in range(many):
        centre = r.getrandbits(64)
        out.add(centre)
        for _ in range(r.choice([0, 3, 40])):
            out.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    return sorted(out)


@pytest.mark.parametrize("split", [0, 3, 256])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    prints = _prints(split, 12)
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fingerprint long")
    found = {r.node: r.root for r in graph.components(simhash.links(rows)).collect()}
    groups = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    ours = {}
    for p in prints:
        ours.setdefault(found.get(simhash._signed(p), simhash._signed(p)), set()).add(p)
    theirs = {}
    for p in prints:
        theirs.setdefault(groups[p], set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_close_fingerprints_meet_whatever_the_bits():
    r = random.Random(5)
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 2)))
        x = a ^ b
        chains = [s for s in range(5) if not x & simhash._mask(s, 2)]
        good = [s for s in chains if (x & simhash._mask(s, 3)).bit_count() <= 1 and (x & simhash._mask(s, 4)).bit_count() <= 1]
        assert good


def test_components(spark):
    r = random.Random(1)
    nodes = list(range(-40, 60))
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(70)] + [(i, i + 1) for i in range(100, 140)]
    rows = spark.createDataFrame([*edges, (7, None)], "a long, b long")
    used = {n for e in edges if e[0] != e[1] for n in e}
    expected = plain_groups(used, lambda a, b: (a, b) in set(edges))
    assert {x.node: x.root for x in graph.components(rows).collect()} == expected
    assert graph.components(rows.limit(0)).count() == 0


def test_only_bounded_groups_under_long_chains():
    free = 64 - sum(simhash.WIDTHS[:4])
    assert 2 ** (free + 1) <= 1 << 14
    assert np.uint64(simhash._mask(0, 5)) == np.uint64(2**64 - 1)
