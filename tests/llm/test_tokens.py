import math
import random
import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from netsight.llm import tokens

LETTERS = b"abc \n"


def model(seed=0):
    r = random.Random(seed)
    made = {bytes([b]): -9.0 - b / 64 for b in range(256)}
    for _ in range(60):
        made[bytes(r.choice(LETTERS) for _ in range(r.randint(2, 5)))] = -r.randint(1, 12) / 2
    return made


def plainly(word, scores):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        cuts = [(best[s][0] + scores[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        score, number = max(cuts)
        best.append((score, -number))
    return best[-1][1]


@given(st.lists(st.binary(max_size=12) | st.text("abc \n", max_size=30).map(str.encode), max_size=20), st.integers(0, 5))
def test_trie_agrees_with_one_word_at_a_time(words, seed):
    scores = model(seed)
    words = list(dict.fromkeys(words))
    assert tokens.count_tokens(words, tokens.Unigram.of(scores)).tolist() == [plainly(w, scores) for w in words]


@given(st.lists(st.text("abc \n", max_size=60).map(str.encode), max_size=8), st.integers(0, 5), st.integers(1, 9), st.integers(0, 12))
def test_long_words_agree_in_pieces_of_any_size(words, seed, piece, long):
    scores, kept = model(seed), (tokens.PIECE, tokens.LONG)
    words = list(dict.fromkeys(words))
    try:
        tokens.PIECE, tokens.LONG = piece, long
        found = tokens.count_tokens(words, tokens.Unigram.of(scores)).tolist()
    finally:
        tokens.PIECE, tokens.LONG = kept
    assert found == [plainly(w, scores) for w in words]


def test_longest_token():
    assert tokens.Unigram.of({bytes([b]): -1.0 for b in range(256)} | {b"abcd": -2.0, b"bc": -2.0}).longest == 4
    assert tokens.Unigram.from_ranks().longest == 128


def test_a_run_of_five_million_bytes_without_a_blank(documents):
    r = random.Random(3)
    run = "data:" + "".join(r.choices("ABCDEFabcdef0123456789+/", k=5_000_000)) + "=" * 2000
    unigram = tokens.Unigram.from_ranks()
    begun = time.perf_counter()
    whole = int(tokens.count_tokens([run.encode()], unigram)[0])
    assert time.perf_counter() - begun < 20
    (row,) = tokens.token_counts(documents([(1, run, "a")]), unigram).collect()
    assert (row.n_bytes, row.n_pretokens, row.n_tokens) == (len(run), 1, whole)
    part = run[:3000].encode()
    assert tokens.count_tokens([part], unigram).tolist() == tokens._count_on_trie([part], unigram).tolist()


def test_equal_scores_take_the_fewest_tokens():
    scores = {bytes([b]): -1.0 for b in range(256)} | {b"ab": -2.0, b"abc": -3.0}
    assert tokens.count_tokens([b"abc", b"ab", b"abcab"], tokens.Unigram.of(scores)).tolist() == [1, 1, 2]


def test_every_byte_must_be_a_token():
    try:
        tokens.Unigram.of({b"a": -1.0})
    except ValueError:
        return
    raise AssertionError


def test_pretokens_are_the_text():
    for text in (b"", b" ", b"  a  b\n\nc", "ü  x\x00y ".encode(), b"a" * 5000):
        assert b"".join(tokens.PRETOKEN.findall(text)) == text


def test_query(documents, nasty, ids):
    unigram = tokens.Unigram.from_ranks()
    found = tokens.token_counts(documents(nasty), unigram).collect()
    assert sorted((r.doc_id for r in found), key=lambda i: (i is None, i)) == ids
    for row in found:
        texts = [(t or "").encode() for i, t, _ in nasty if i == row.doc_id]
        expected = []
        for text in texts:
            cut = tokens.PRETOKEN.findall(text)
            counts = dict(zip(set(cut), tokens.count_tokens(list(set(cut)), unigram).tolist(), strict=True))
            expected.append((len(text), len(cut), sum(counts[w] for w in cut)))
        assert (row.n_bytes, row.n_pretokens, row.n_tokens) in expected
    assert tokens.token_counts(documents([]), unigram).count() == 0


def test_known_pretokens_can_be_forgotten(documents, prose, monkeypatch):
    rows = [(i, prose(50, i), "a") for i in range(20)]
    unigram = tokens.Unigram.from_ranks()
    plain = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(rows), unigram).collect()}
    for i, text, _ in rows:
        cut = tokens.PRETOKEN.findall(text.encode())
        assert plain[i] == int(sum(tokens.count_tokens([w], unigram)[0] for w in cut))
    assert math.isfinite(float(np.sum(list(plain.values()))))
