"""Toxicity: misspelled terms of a learned lexicon, weighed by the words around them.

The lexicon (terms, and stems that many toxic words share) is learned from labelled texts and held in a
trie. A word is matched by running the Levenshtein automaton of one edit along the trie; the states that
are reached become states of one deterministic automaton, made when they are first needed. A hit between
quotation marks or beside a word of reporting speaks of abuse and counts apart from a hit that abuses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.llm.common import as_bytes, rows_of, type_of
from netsight.session import cut_lineage, ship_package

WORD = re.compile(r"\w+")
#: Marks and words that show that somebody else's words are given.
QUOTES = "\"'“”„«»‘’‹›`"
REPORTING = frozenset(
    "said says say called calls wrote writes quote quoted quotes word words term insult insulted "
    "dit disait appelé écrit citation mot mots dijo dice llamó escribió cita palabra palabras "
    "sagte sagt nannte schrieb zitat wort wörter".split()
)
AROUND = 4
#: Labelled texts that are learned from, at most.
MOST_TEXTS = 20_000
#: An entry of the lexicon occurs in so many toxic texts, and surely (by so many standard errors of the
#: logarithm of the quotient) so many times as often as in clean ones.
SUPPORT, SURE, LIFT = 4, 1.0, 10.0
STEMS = range(4, 8)
KNOWN = 1 << 19
KINDS = ("term", "near_term", "stem", "near_stem")


class Automaton:
    """All strings within one edit of an entry, or that begin so for a stem. Entries below five letters
    (stems: below six) allow no edit, as too many ordinary words are near them."""

    def __init__(self, terms: Iterable[str], stems: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem = {}, {}
        for found, entries in ((self.term, terms), (self.stem, stems)):
            for entry in entries:
                node = 0
                for letter in entry:
                    if letter not in self.children[node]:
                        self.children[node][letter] = len(self.children)
                        self.children.append({})
                    node = self.children[node][letter]
                found[node] = len(entry) >= (5 if found is self.term else 6)
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._number({0: 0}, 9)

    def _number(self, reached: dict[int, int], stem: int) -> int:
        """The state of some (node, edits) and the fewest edits of a stem seen so far (9: none)."""
        for node, edits in list(reached.items()):
            if edits == 0:  # a letter of the entry that the word leaves out
                for below in self.children[node].values():
                    reached.setdefault(below, 1)
        for node, edits in reached.items():
            if node in self.stem and edits <= self.stem[node]:
                stem = min(stem, edits)
        key = (frozenset(reached.items()), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}
        nodes, stem = self.states[state]
        for node, edits in nodes:
            below = self.children[node]
            if letter in below:
                reached[below[letter]] = min(edits, reached.get(below[letter], 9))
            if edits == 0:
                for other in (node, *below.values()):  # a letter too many, or another one
                    reached.setdefault(other, 1)
        return self._number(reached, stem)

    def match(self, word: str) -> int:
        """0: no entry; else 1 + the place in KINDS of the best match."""
        state, moves = self.start, self.moves
        for letter in word:
            after = moves.get((state, letter))
            if after is None:
                after = moves[state, letter] = self._move(state, letter)
            state = after
            if not self.states[state][0]:
                break
        nodes, stem = self.states[state]
        whole = min((e for n, e in nodes if n in self.term and e <= self.term[n]), default=9)
        return 1 if whole == 0 else 3 if stem == 0 else 2 if whole == 1 else 4 if stem == 1 else 0


def _quoted(text: str, first: int, last: int) -> bool:
    """The word from first to last stands beside a quotation mark, or inside a short quotation."""
    if text[first - 1 : first] in QUOTES and first and text[last : last + 1] in QUOTES and last < len(text):
        return True
    before, after = text[max(0, first - 60) : first], text[last : last + 60]
    return any(before.count(q) % 2 == 1 and q in after for q in '"`') or any(
        before.rfind(a) > before.rfind(b) and b in after for a, b in ("“”", "„“", "«»", "»«", "‹›", "›‹")
    )


def hits(text: str, kinds: dict[str, int]) -> list[float]:
    """Per kind the abusive hits, then the reported ones, then the number of words. kinds: of known words."""
    found = [0] * (len(KINDS) + 1)
    given = WORD.findall(text)  # lower-casing a whole text could move places and cut words
    words = [w.lower() for w in given]
    places = [i for i, w in enumerate(words) if kinds[w]]
    if places:
        spans = [m.span() for m in WORD.finditer(text)]
        for i in places:
            near = words[max(0, i - AROUND) : i + AROUND + 1]
            reported = _quoted(text, *spans[i]) or any(w in REPORTING for w in near)
            found[len(KINDS) if reported else kinds[words[i]] - 1] += 1
    return [*found, len(words)]


def _entry_counts(labelled: DataFrame) -> DataFrame:
    """(entry, stem, toxic, clean): in how many labelled texts a word occurs, or a word with a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64()),
                ],
                ["entry", "stem", "toxic", "clean"],
            )
            counts[0].clear()
            counts[1].clear()
            return made

        for text, toxic in rows_of(batches, "text", "toxic"):
            words = {w.lower() for w in WORD.findall(text.decode())}
            seen = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) > n}
            counts[int(toxic)].update(seen)
            if len(counts[0]) + len(counts[1]) > 1 << 20:
                yield flushed()
        yield flushed()

    counted = labelled.select("text", "toxic").mapInArrow(run, "entry string, stem boolean, toxic bigint, clean bigint")
    return counted.groupBy("entry", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems that are far more frequent in toxic texts than in clean ones.

    An entry must occur in SUPPORT toxic texts, and by a lower confidence bound LIFT times as often as in clean
    ones, however many texts are taught. A stem must stand for several words; longer stems and terms that
    a stem covers are left out. The entries are words of at most MOST_TEXTS texts.
    """
    n_toxic, n_clean = (labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first() or (0, 0))[:2]
    if not n_toxic:
        return [], []
    counts = _entry_counts(labelled)
    clean = F.col("clean") + 0.5
    lift = F.log(F.col("toxic") / n_toxic) - F.log(clean / ((n_clean or 0) + 1))
    error = F.sqrt(1 / F.col("toxic") - 1 / n_toxic + 1 / clean - 1 / ((n_clean or 0) + 1))
    strong = counts.where((F.col("toxic") >= SUPPORT) & (lift - SURE * error >= math.log(LIFT)))
    rows = strong.orderBy(F.desc("toxic"), "entry", "stem").collect()
    terms = {r["entry"]: r["toxic"] for r in rows if not r["stem"]}
    stems: list[str] = []
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["entry"]), r["entry"])):
        stem = r["entry"]
        if any(stem.startswith(s) for s in stems):
            continue
        if r["toxic"] > 1.5 * max((n for t, n in terms.items() if t.startswith(stem)), default=0):
            stems.append(stem)
    return [t for t in terms if not any(t.startswith(s) for s in stems)], stems


def features(docs: DataFrame, key: str, text: str, lexicon: tuple[list[str], list[str]]) -> DataFrame:
    """(key, one count per kind, reported, n_words) of every row."""
    rows = as_bytes(docs, key, text)
    names = [*KINDS, "reported", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(*lexicon), {}
        for batch in batches:
            found = []
            for (data,) in rows_of([batch], "text"):
                body = data.decode()
                if len(known) > KNOWN:
                    known = {}
                for word in {w.lower() for w in WORD.findall(body)}.difference(known):
                    known[word] = automaton.match(word)
                found.append(hits(body, known))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), *columns], ["key", *names])

    schema = f"key {type_of(rows, 'key')}, " + ", ".join(f"{n} bigint" for n in names)
    return rows.mapInArrow(run, schema)


def _inputs():
    """What the regression sees: hits of each kind, on a scale of logarithms, and their share of the words."""
    counts = [F.log1p(F.col(k).cast("double")) for k in (*KINDS, "reported")]
    return [*counts, F.log1p(100 * sum(F.col(k) for k in ("term", "stem")) / F.greatest(F.col("n_words"), F.lit(1)))]


def regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method; no weight may be negative."""
    ones = np.c_[x, np.ones(len(x))]
    used = np.ones(ones.shape[1], bool)
    while True:
        w = np.zeros(ones.shape[1])
        ridge = np.where(np.arange(len(w)) < len(w) - 1, penalty, 1e-3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(ones @ w, -30, 30)))
            slope = ones.T @ (y - p) - ridge * w
            curve = (ones * (p * (1 - p))[:, None]).T @ ones + np.diag(ridge)
            step = np.zeros_like(w)
            step[used] = np.linalg.solve(curve[np.ix_(used, used)], slope[used])
            w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-8:
                break
        bad = (w < 0) & used
        bad[-1] = False
        if not bad.any():
            return w
        used &= ~bad


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", held: int = 5
) -> DataFrame:
    """(key, held_out, score, predicted, hits of each kind) of every row.

    held_out rows, those whose crc32(key as text) is divisible by `held`, teach nothing. Of the others'
    labels, MOST_TEXTS by hash of the key teach the lexicon and the regression; of a key with several texts the
    regression sees the mean; a key with several labels
    is toxic if one says so; null labels and labels without a text are passed over. With no label, or of
    one kind only, the score is the share of toxic texts taught. A null text is empty, and an empty text
    scores like one without hits. A null key is held out. Repeated rows each give a row.
    """
    ship_package(docs.sparkSession)
    remainder = F.crc32(F.col(key).cast("string").cast("binary")) % held
    taught = labels.where(F.col(label).isNotNull() & (remainder != 0)).groupBy(F.col(key).alias("of"))
    taught = taught.agg(F.max(label).alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(MOST_TEXTS)
    taught = cut_lineage(taught.withColumn("toxic", (F.col("toxic") > 0).cast("int")))
    texts = docs.select(F.col(key).alias("of"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    labelled = cut_lineage(texts.join(taught, "of").dropDuplicates(["of", "text"]))
    lexicon = learn_lexicon(labelled)
    counted = cut_lineage(features(docs, key, text, lexicon))
    # Each label has one vote, shared by the texts that bear its key; a table of bounded size comes here.
    bearing = counted.withColumnRenamed("key", "of").join(taught, "of").groupBy("of", "toxic").agg(
        *[F.avg(F.col(n).cast("double")).alias(n) for n in (*KINDS, "reported", "n_words")]
    )
    own = bearing.select("toxic", *_inputs()).toPandas().to_numpy(float)
    own = own[np.lexsort(own.T)]  # sums of floats depend on their order
    if len(own) and 0 < own[:, 0].sum() < len(own):
        w = regression(own[:, 1:], own[:, 0]).tolist()
    else:
        share = (own[:, 0].sum() + 0.5) / (len(own) + 1) if len(own) else 0.5
        w = [0.0] * len(_inputs()) + [math.log(share / (1 - share)) if len(own) else -1.0]
    total = F.lit(w[-1])
    for x, part in zip(_inputs(), w, strict=False):
        total = total + x * part
    scored = counted.withColumn("score", 1 / (1 + F.exp(-total)))
    held_out = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % held == 0, F.lit(True))
    return scored.select(
        F.col("key").alias(key), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *KINDS, "reported",
    )
