import hashlib
import math
import random

from netsight.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and free:
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s]
        for s in list(free):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                free.discard(s)
    return target


def test_targets(spark):
    r = random.Random(2)
    for k in range(6):
        sizes = {(None if i == 0 else f"s{i}" if i % 2 else f"Z{i}é"): r.choice([0, 1, 5, 50, 1000, 10**6]) for i in range(2 + 3 * k)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {x.source: x.target for x in mixing.source_targets(rows).collect()}
        expected = plain_targets(sizes)
        assert found.keys() == expected.keys()
        assert all(math.isclose(found[s], expected[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def plain_mix(rows, seed=42):
    sized = []
    for i, text, source in rows:
        text = text or ""
        plain = sum(c not in "#*$%&|<>!" and not "A" <= c <= "Z" for c in text)
        weight = max(0.1, (plain / max(1, len(text))) ** 2)
        digest = hashlib.md5(text.encode()).hexdigest()
        digits = hashlib.md5(f"{seed}:{'' if i is None else i}:{digest}".encode()).hexdigest()[:13]
        u = (int(digits, 16) + 0.5) / 16**13
        sized.append((source, -math.log(u) / weight, i is None, i or 0, len(text.encode().split()), i))
    sizes = {}
    for s in sized:
        sizes[s[0]] = sizes.get(s[0], 0) + s[4]
    target, out = plain_targets(sizes), []
    for source in sizes:
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        budget, seen = target[source] - epochs * sizes[source], 0
        for _, _, _, size, i in sorted(s[1:] for s in sized if s[0] == source):
            extra = seen < budget and seen + size / 2 <= budget
            out.append((i, size, sizes[source], size * (epochs + extra)))
            seen += size
    return out


def test_against_brute_force(documents, nasty, prose, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 4)
    r = random.Random(7)
    rows = nasty[:3] + nasty[3:9] + [
        (100 + i, prose(r.randint(1, 90), i) + r.choice(["", "%%%%", "!!!!", "ABC" * 20]), r.choice(["hot", "hot", "b", "c", None]))
        for i in range(150)
    ]
    found = mixing.mix(documents(rows)).collect()
    ours = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken) for r in found)
    plain = sorted((i is None, i or 0, *rest) for i, *rest in plain_mix([(i, t, s) for i, t, s in rows]))
    assert ours == plain
    for source in {r.source for r in found}:
        of = [r for r in found if r.source == source]
        near = sum(r.taken for r in of) - of[0].target
        assert abs(near) <= max(r.size for r in of) / 2 + 1e-6
    assert all(r.taken <= 3 * r.size for r in found)


def test_one_key_for_many_texts_and_many_equal_rows(documents, prose, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 4)
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = [(7, prose(5 + i % 9, i), "a") for i in range(120)] + [(None, prose(6, 500 + i), "a") for i in range(60)]
    rows += [(8, prose(12, 1), "a")] * 100 + [(9, prose(700, 2), "b"), (9, prose(3, 3), "b")]
    found = mixing.mix(documents(rows)).collect()
    count = lambda them: sorted((i is None, i or 0, *rest) for i, *rest in them)
    assert count((r.doc_id, r.size, r.source_size, r.taken) for r in found) == count(plain_mix(rows))
    # All equal rows: the draw is one, the cut goes through them.
    equal = [(1, prose(10, 1), "a")] * 300 + [(2, prose(10, 2), "b")] * 20
    found = mixing.mix(documents(equal)).collect()
    assert count((r.doc_id, r.size, r.source_size, r.taken) for r in found) == count(plain_mix(equal))
    assert len({r.taken for r in found if r.source == "a"}) == 2


def test_reruns_agree_on_any_partitioning(documents, nasty):
    docs = documents(nasty)
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == len(nasty)


def test_empty(documents):
    assert mixing.mix(documents([])).count() == 0
    (row,) = mixing.mix(documents([(1, None, None)])).collect()
    assert (row.size, row.taken, row.target) == (0, 0, 0.0)


def test_better_documents_come_first(documents, prose):
    rows = [(i, prose(20, i), "a") for i in range(400)] + [(1000 + i, prose(20, i).upper(), "a") for i in range(400)]
    rows += [(5000, prose(30_000, 3), "b")]
    found = mixing.mix(documents(rows)).collect()
    taken = [sum(r.taken for r in found if r.doc_id // 1000 == k) for k in (0, 1)]
    assert taken[0] >= taken[1]
