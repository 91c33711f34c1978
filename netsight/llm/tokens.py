"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text is cut into pre-tokens: a run of characters that are not blank with the space before it, or a run
of blanks. The distinct pre-tokens of a batch form a trie; the best score of a prefix is computed once
for all pre-tokens that begin with it, and the node where a pre-token ends holds its number of tokens.
The trie grows level by level, all nodes of a level in a few array operations.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import as_bytes
from netsight.session import ship_package

PRETOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: A task forgets the pre-tokens it has counted when it knows so many.
KNOWN = 1 << 20
#: Longer pre-tokens share no prefixes worth a trie level of array calls per byte; they are cut one by one.
LONG = 256
#: Bytes of a long pre-token whose tokens are looked up at a time.
PIECE = 1 << 16
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass
class Unigram:
    """Tokens with the logarithm of their chance, as a trie over bytes.

    Every single byte must be a token, so that every text can be cut.
    """

    keys: np.ndarray  # state * 256 + byte, ascending
    states: np.ndarray  # the state that the key leads to; 0 is the root
    scores: np.ndarray  # of the token that ends in a state, -inf if there is none

    @classmethod
    def of(cls, tokens: dict[bytes, float]) -> Unigram:
        steps: dict[int, int] = {}
        scores = [-np.inf]
        for token, score in tokens.items():
            state = 0
            for byte in token:
                state = steps.setdefault(state << 8 | byte, len(steps) + 1)
                if state == len(scores):
                    scores.append(-np.inf)
            scores[state] = score
        keys = np.fromiter(steps, np.int64, len(steps))
        states = np.fromiter(steps.values(), np.int64, len(steps))
        order = np.argsort(keys)
        model = cls(keys[order], states[order], np.array(scores))
        if (model.step(np.zeros(256, np.int64), np.arange(256)) < 0).any():
            raise ValueError("every single byte must be a token")
        return model

    @classmethod
    def from_ranks(cls, path: str = VOCABULARY) -> Unigram:
        """A file of tokens (base64) and ranks; the chance of a token falls with its rank (Zipf's law)."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        total = float(np.log((1 / (np.arange(len(ranks)) + 1.0)).sum()))
        return cls.of({t: -float(np.log(rank + 1.0)) - total for t, rank in ranks.items()})

    @cached_property
    def longest(self) -> int:
        """The bytes of the longest token."""
        level, length = np.zeros(1, np.int64), 0
        while len(level):
            first, last = np.searchsorted(self.keys, level << 8), np.searchsorted(self.keys, (level + 1) << 8)
            many = last - first
            level = self.states[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
            length += 1
        return length - 1

    @cached_property
    def roots(self) -> np.ndarray:
        return self.step(np.zeros(256, np.int64), np.arange(256))

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; -1 where no token goes on."""
        wanted = states << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.states[at], -1)


def count_tokens(words: list[bytes], model: Unigram) -> np.ndarray:
    """The number of tokens in the most probable cut of each word (of equal ones, the fewest tokens)."""
    if not any(len(w) > LONG for w in words):
        return _count_on_trie(words, model)
    out = np.fromiter((_count_long(w, model) if len(w) > LONG else 0 for w in words), np.int64, len(words))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    out[short] = _count_on_trie([words[i] for i in short], model)
    return out


def _tokens_at(buffer: np.ndarray, n: int, model: Unigram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, score) of the tokens that begin at one of the first n bytes, by start."""
    starts, state = np.arange(n), model.roots[buffer[:n]]
    found, length = [], 1
    while len(starts):
        score = model.scores[state]
        ends = np.flatnonzero(np.isfinite(score))
        found.append((starts[ends], np.full(len(ends), length), score[ends]))
        inside = starts + length < len(buffer)
        starts, state = starts[inside], state[inside]
        state = model.step(state, buffer[starts + length].astype(np.int64))
        starts, state, length = starts[state >= 0], state[state >= 0], length + 1
    start, size, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], size[order], score[order]


def _count_long(word: bytes, model: Unigram) -> int:
    """The same number for one word, in work that grows with its length and the tokens that begin at a byte.

    The scores of a trie's nodes on one path are those of the word's prefixes; only as many of them are
    kept as the longest token reaches ahead.
    """
    nothing = (-np.inf, 0)
    ahead = [(0.0, 0)] + [nothing] * model.longest  # best (score, -tokens) of the prefixes from here on
    for first in range(0, len(word), PIECE):
        n = min(PIECE, len(word) - first)
        reach = np.frombuffer(word, np.uint8, min(n + model.longest, len(word) - first), first)
        best = ahead + [nothing] * n
        for start, size, score in zip(*(c.tolist() for c in _tokens_at(reach, n, model)), strict=True):
            total, fewer = best[start]
            cut = (total + score, fewer - 1)
            if cut > best[start + size]:
                best[start + size] = cut
        ahead = best[n:]
    return -ahead[0][1]


def _count_on_trie(words: list[bytes], model: Unigram) -> np.ndarray:
    order = sorted(range(len(words)), key=words.__getitem__)
    lengths = np.fromiter((len(words[i]) for i in order), np.int64, len(words))
    buffer = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
    offsets = np.cumsum(lengths) - lengths
    counts = np.zeros(len(words), np.int64)
    # Of each node of the level above: its best score, its tokens, and the tokens that are still open in
    # it: (node, score and tokens before the open token, state).
    score, tokens = np.zeros(1), np.zeros(1, np.int64)
    open_node, open_score, open_tokens, open_state = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    active, node = np.flatnonzero(lengths > 0), np.zeros(int((lengths > 0).sum()), np.int64)
    depth = 0
    while len(active):
        byte = buffer[offsets[active] + depth].astype(np.int64)
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])])
        parent, letter = node[new], byte[new]
        node = np.cumsum(new) - 1
        # Open tokens of a parent go on in each of its children; a new one begins at each child.
        first = np.searchsorted(open_node, parent, side="left")
        many = np.searchsorted(open_node, parent, side="right") - first
        child = np.repeat(np.arange(len(parent)), many)
        source = np.arange(len(child)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        state = model.step(open_state[source], letter[child])
        alive = state >= 0
        child, source, state = child[alive], source[alive], state[alive]
        begun = np.arange(len(parent))
        all_node = np.concatenate([child, begun])
        by_node = np.argsort(all_node, kind="stable")
        open_node = all_node[by_node]
        open_score = np.concatenate([open_score[source], score[parent]])[by_node]
        open_tokens = np.concatenate([open_tokens[source], tokens[parent]])[by_node]
        open_state = np.concatenate([state, model.roots[letter]])[by_node]
        ends = np.flatnonzero(np.isfinite(model.scores[open_state]))
        total, number, of = open_score[ends] + model.scores[open_state[ends]], open_tokens[ends] + 1, open_node[ends]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        score = np.maximum.reduceat(total, start)
        best = np.where(total == score[of], number, np.iinfo(np.int64).max)
        tokens = np.minimum.reduceat(best, start)
        depth += 1
        done = lengths[active] == depth
        counts[active[done]] = tokens[node[done]]
        active, node = active[~done], node[~done]
    out = np.zeros(len(words), np.int64)
    out[order] = counts
    return out


def token_counts(docs: DataFrame, model: Unigram, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_pretokens, n_tokens) of every row; a null or empty text has none of them.

    Each task counts a distinct pre-token once (again only when it knows over a million others), so that
    nothing is shuffled. Repeated rows and null keys each give a row. A pre-token of over 256 bytes, as in
    a very long run without blanks, is cut on its own, byte by byte, and not remembered.
    """
    ship_package(docs.sparkSession)
    rows = as_bytes(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 512):
                part = [PRETOKEN.findall(t.as_py()) for t in texts[at : at + 512]]
                fresh = list({w for words in part for w in words if w not in known})
                if len(known) + len(fresh) > KNOWN:
                    known = {}
                    fresh = list({w for words in part for w in words})
                known.update(zip(fresh, count_tokens(fresh, model).tolist(), strict=True))
                long = [w for w in fresh if len(w) > LONG]
                sizes = [len(t.as_py()) for t in texts[at : at + 512]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("key")).slice(at, 512), pa.array(sizes, pa.int64()),
                        pa.array(map(len, part), pa.int64()),
                        pa.array([sum(map(known.__getitem__, words)) for words in part], pa.int64()),
                    ],
                    ["key", "n_bytes", "n_pretokens", "n_tokens"],
                )
                for word in long:
                    del known[word]

    counted = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_pretokens bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_pretokens", "n_tokens")
