import re

import pytest

from netsight.llm import decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(text, items, window=10):
    held, names, own = set(), set(), words(text)
    for item, phrase in items:
        w = words(phrase)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            for i in range(len(own) - len(part) + 1):
                if own[i : i + len(part)] == part:
                    held.update(range(i, i + len(part)))
                    names.add("" if item is None else str(item))
    return len(own), len(held), sorted(names)


def plainly_near(text, items, near, window=10):
    """Every window against every start in the document."""
    own = words(text)
    _, _, names = plainly(text, items, window)
    held, names = set(), set(names)
    for item, phrase in items:
        w = words(phrase)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k : k + window]
            slack, missing = (near.slack, near.missing) if len(part) == window else (0, 0)
            for start in range(-window - slack, len(own) + slack + 1):
                found = []
                for j, term in enumerate(part):
                    places = [q for q in range(start + j - slack, start + j + slack + 1) if 0 <= q < len(own) and own[q] == term]
                    if places:
                        found.append(min(places, key=lambda q: (abs(q - start - j), q)))
                if len(found) >= len(part) - missing:
                    held.update(found)
                    names.add("" if item is None else str(item))
    return len(held), sorted(names)


def changed(text, every, new="zzz", instead=True):
    out = []
    for k, w in enumerate(text.split()):
        out += [w] if k % every != every - 1 else [new] if instead else [w, new]
    return " ".join(out)


@pytest.fixture
def tests(spark, prose):
    rows = [
        (1, prose(30, 50)), (2, prose(10, 51)), (10, "one two"), (3, ""), (4, None), (None, prose(12, 52)),
        (5, prose(30, 50)), (6, "karo lo " * 12), (7, prose(11, 53).upper()),
    ]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("segment,block", [(1 << 16, 1 << 20), (50, 1 << 20), (300, 20)])
def test_against_brute_force(documents, nasty, tests, prose, monkeypatch, segment, block):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items, table = tests
    rows = [r for r in nasty if len(r[1] or "") < 100_000] + [
        (20, prose(40, 1) + ", " + prose(30, 50).title() + "! " + prose(20, 2), "a"), (21, "karo lo " * 30, "a"),
        (22, " ".join(prose(30, 50).split()[:9]), "a"), (23, " ".join(prose(30, 50).split()[3:14]), "a"), (24, "One, two", "b"),
        (25, prose(12, 52), "b"), (26, prose(11, 53), "b"), (27, prose(30, 50) + " " + prose(30, 50), "b"),
    ]
    found = decontaminate.contamination(documents(rows), table).collect()
    expected = [(i, *plainly(t, items)) for i, t, _ in rows]
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, expected))


def test_very_long_document(documents, prose, tests):
    items, table = tests
    text = prose(70_000, 9) + " " + prose(30, 50) + " " + prose(100, 8)
    (row,) = decontaminate.contamination(documents([(1, text, "a")]), table).collect()
    assert row.n_words == 70_130 and row.n_hit >= 30 and {"1", "5"} <= set(row["items"])


def test_empty_tables(documents, nasty, tests):
    _, table = tests
    assert decontaminate.contamination(documents([]), table).count() == 0
    found = decontaminate.contamination(documents(nasty), table.limit(0)).collect()
    assert len(found) == len(nasty) and not any(r.n_hit or r["items"] for r in found)


def test_index_gives_back_the_texts(documents, nasty, spark):
    from netsight.session import scratch_path

    index = decontaminate.build_index(documents(nasty), "doc_id", "text", scratch_path(spark, "index"))
    got = []
    for row in index.collect():
        held = decontaminate.Segment(row.terms, row.counts, row.steps, row.lengths, row.wide)
        placed = {int(p): t for k, t in enumerate(held.names) for p in held.positions(k)}
        first = 0
        for key, n in zip(row["keys"], row.lengths, strict=True):
            got.append((key, [placed[p].decode() for p in range(first, first + n)]))
            first += n
    assert sorted(map(str, got)) == sorted(str((i, words(t))) for i, t, _ in nasty)


@pytest.mark.parametrize("segment,block,tried", [(1 << 16, 1 << 20, 1 << 18), (50, 1 << 20, 7), (300, 20, 100)])
@pytest.mark.parametrize("near", [decontaminate.Near(), decontaminate.Near(0, 1), decontaminate.Near(3, 0)])
def test_near_against_brute_force(documents, tests, prose, monkeypatch, segment, block, tried, near):
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "TRIED", tried)
    items, table = tests
    passage = prose(30, 50)
    rows = [(k, t, "a") for k, t in enumerate([
        None, "", "one", "One, two!", "one x two", passage, passage.title() + " " + passage, changed(passage, 9),
        prose(9, 1) + " " + changed(passage, 9, instead=False) + " " + prose(40, 2), " ".join(passage.split()[:8]),
        " ".join(passage.split()[22:]), " ".join(reversed(passage.split())), "karo lo " * 9, prose(200, 5), prose(10, 51),
        changed(prose(12, 52), 4), changed(passage, 2),
    ])]
    rows.append((5, passage, "a"))
    found = decontaminate.contamination(documents(rows), table, near=near).collect()
    expected = [(i, *plainly(t, items), *plainly_near(t, items, near)) for i, t, _ in rows]
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, expected))


def test_changed_passages_are_near_and_clean_texts_are_not(documents, spark, prose):
    table = spark.createDataFrame([(1, prose(60, 50))], "item_id long, text string")
    own = [f"word{k}" for k in range(400)]
    rows = [
        (1, prose(300, 1) + " " + changed(prose(60, 50), 9) + " " + prose(300, 2), "a"),
        (2, changed(prose(60, 50), 9, instead=False), "a"), (3, prose(3_000, 3), "a"), (4, " ".join(own), "a"),
    ]
    found = {r.doc_id: r for r in decontaminate.contamination(documents(rows), table, near=decontaminate.Near()).collect()}
    assert all(r.n_hit == 0 and r["items"] == [] for r in found.values())
    assert found[1].n_near >= 54 and found[2].n_near >= 54 and found[1].near_items == found[2].near_items == ["1"]
    assert found[3].n_near == found[4].n_near == 0
    assert decontaminate.contamination(documents([]), table, near=decontaminate.Near()).count() == 0
    nothing = decontaminate.contamination(documents(rows), table.limit(0), near=decontaminate.Near()).collect()
    assert len(nothing) == 4 and not any(r.n_near or r.near_items for r in nothing)
