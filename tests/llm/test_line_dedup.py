import random

import pytest

from netsight.llm import line_dedup


def plainly(rows, least):
    """Every run of lines with enough words that equals an earlier one, by comparing all with all."""
    order = sorted({(i is None, i or 0, t or "") for i, t, _ in rows}, key=lambda r: r[:2])
    lines = []
    for unnamed, i, text in order:
        kept = [(p, " ".join(x.encode().decode().split())) for p, x in enumerate(text.split("\n")) if x.encode().split()]
        lines.append((unnamed, i, text, kept))
    seen, gone = set(), {}
    for unnamed, i, text, kept in lines:
        here = []
        for a in range(len(kept)):
            total = 0
            for b in range(a, len(kept)):
                total += len(kept[b][1].split())
                if total >= least:
                    here.append((a, b, tuple(x for _, x in kept[a : b + 1])))
        here.sort()
        for a, b, run in here:
            if run in seen:
                gone.setdefault((unnamed, i, text), set()).update(range(kept[a][0], kept[b][0] + 1))
            seen.add(run)
    return gone


def after(text, gone):
    if text is None:
        return None
    return "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)


def check(documents, rows, least):
    found = line_dedup.without_repeats(documents(rows), min_words=least)
    gone = plainly(rows, least)
    expected = [(i, after(t, gone.get((i is None, i or 0, t or ""), ()))) for i, t, _ in rows]
    assert sorted(str((r.doc_id, r.text)) for r in found.collect()) == sorted(map(str, expected))
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(documents, prose, seed):
    r = random.Random(seed)
    shared = [[prose(r.choice([2, 5, 9, 30]), f"{seed}{k}{j}") for j in range(r.randint(1, 6))] for k in range(6)]
    common = prose(4, 99)
    rows = []
    for i in range(25):
        lines = []
        for _ in range(r.randint(0, 5)):
            lines += r.choice([[prose(r.randint(1, 15), r.random())], r.choice(shared), [common], [""], [" "]])
        rows.append((r.choice([i, i, i, 3]), "\n".join(lines), "a"))
    rows = list({(i, t): (i, t, s) for i, t, s in rows}.values())
    # Rows with one key are ordered by a hash of the text, which the plain form does not know.
    rows = list({i: (i, t, s) for i, t, s in rows}.values())
    assert check(documents, rows, 12)


def test_nasty(documents, nasty):
    rows = [*nasty, (None, nasty[0][1], "z")]
    check(documents, rows, 50)
    assert line_dedup.without_repeats(documents([])).count() == 0


def test_columns_stay(documents, nasty):
    docs = documents(nasty)
    found = line_dedup.without_repeats(docs)
    assert found.columns[:-1] == docs.columns and found.columns[-1] not in docs.columns


def test_one_line_of_enough_words_is_a_passage(documents, prose):
    line = prose(51, 7)
    rows = [(1, prose(5, 1) + "\n" + line + "\nend", "a"), (2, "start\n" + line, "a"), (3, line.replace(" ", "  ") + "\nx", "b")]
    found = {r.doc_id: r.text for r in line_dedup.without_repeats(documents(rows)).collect()}
    assert found == {1: rows[0][1], 2: "start", 3: "x"}


def test_equal_passages_choose_equal_fingerprints(prose):
    r = random.Random(3)
    run = [prose(r.choice([3, 8, 20]), k) for k in range(9)]
    texts = ["\n".join([prose(7, a), *run, prose(9, a + 1)]).encode() for a in (100, 200)]
    marks = []
    for text in texts:
        digests, sizes, _ = line_dedup.line_sketch(text)
        marks.append({(m, e - f) for m, f, e in line_dedup.passages(digests, sizes, 50) if f >= 1 and e <= 10})
    assert marks[0] == marks[1] and marks[0]
