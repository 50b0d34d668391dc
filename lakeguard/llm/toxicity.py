"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

A lexicon is learnt from labelled rows: words, and stems (prefixes of words),
that toxic documents have and others hardly do.  It is stored as a trie.  The
automaton of k edits is intersected with the trie: a state is the set of trie
nodes that a word's letters so far lead to with so many edits.  Its states are
made when a word first needs them and kept, so most words take one look-up a
letter and end after a few.  Every hit is weighed by the words around it: marks
of quotation or report before and after it speak for talking about a word rather
than using it.  A logistic model of a few counts gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import materialise, only, table

#: Labelled rows that the lexicon is learnt from, at most: those with the least hash of their doc_id.
TRAIN_ROWS = 100_000
#: Toxic documents that a term needs, and their share of all its documents and one more.
SUPPORT, PRECISION = 6, 0.85
#: The same for stems, and the letters of one.
STEM_SUPPORT, STEM_LETTERS = 10, (4, 8)
#: Letters from which a term may have one wrong, missing, extra or swapped one, and from which two.
FUZZY_LETTERS, FUZZIER_LETTERS = 4, 9
#: Words on each side of a hit that its context score looks at.
CONTEXT = 6
#: Distinct words whose matches a worker keeps, and states of an automaton.
CACHE_WORDS, CACHE_STATES = 500_000, 100_000

#: A word: letters, with digits and signs that stand in for letters.
WORD = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*")
#: Signs that are read as letters.  Fixed values.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Words that report or discuss another word.  Fixed values.
REPORTING = frozenset("said says say called calls quote quoted quotes word words term terms wrote writes means meaning reported sagte sagt wort zitat dit mot terme cite dijo dice palabra cita".split())
QUOTES = "\"“”„«»‘’"


@dataclass
class Trie:
    """Terms by letter; ``ends`` marks terms, ``stems`` prefixes whose words all count."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[bool] = field(default_factory=lambda: [False])
    stems: list[bool] = field(default_factory=lambda: [False])

    def add(self, term: str, stem: bool = False) -> None:
        node = 0
        for c in term:
            nxt = self.children[node].get(c)
            if nxt is None:
                nxt = len(self.children)
                self.children.append({})
                self.ends.append(False)
                self.stems.append(False)
                self.children[node][c] = nxt
            node = nxt
        (self.stems if stem else self.ends)[node] = True

    def exact(self, word: str) -> bool:
        node = 0
        for c in word:
            nxt = self.children[node].get(c)
            if nxt is None:
                return False
            node = nxt
            if self.stems[node]:
                return True
        return self.ends[node]

    def kind(self, word: str) -> int:
        """2 for a term, 3 for another word of a stem, else 0."""
        node, stem = 0, 0
        for c in word:
            node = self.children[node].get(c, 0)
            if not node:
                return stem
            if self.stems[node]:
                stem = 3
        return 2 if self.ends[node] else stem


class Automaton:
    """Words within k edits of a trie's terms, or that begin with a stem within k edits.

    An edit is a wrong, missing or extra letter or a swap of neighbours.  The
    automaton of k edits runs in step with the trie: a state is a set of (node,
    edits so far, letter that must follow after a swap).  A stem's last letter
    must agree: without it, or with another, a word only shares a shorter beginning.
    """

    def __init__(self, trie: Trie, k: int) -> None:
        self.trie, self.k = trie, k
        self._clear()

    def _clear(self) -> None:
        #: transitions of each state, and whether a word may end there; state 0 is the dead one, 1 that of a stem found
        self.moves: list[dict[str, int]] = [{}, {}]
        self.accepts = [False, True]
        self.sets: list[frozenset] = [frozenset(), frozenset()]
        self.numbers: dict[frozenset, int] = {}
        self.start = self._number({(0, 0, "")}) if len(self.trie.children) > 1 else 0

    def _number(self, items: set) -> int:
        """The state of these items and of what missing letters lead to."""
        children, k = self.trie.children, self.k
        every, open_ = set(items), list(items)
        while open_:
            node, e, swap = open_.pop()
            if e < k and not swap:
                for child in children[node].values():
                    if (child, e + 1, "") not in every:
                        every.add((child, e + 1, ""))
                        open_.append((child, e + 1, ""))
        if not every:
            return 0
        key = frozenset(every)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(any(self.trie.ends[node] and not swap for node, _, swap in key))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        children, stems, k = self.trie.children, self.trie.stems, self.k
        to = set()
        for node, e, swap in self.sets[state]:
            here = children[node]
            if swap:
                # the letters come as ``swap`` and c, the term has c and ``swap``
                if (first := here.get(c, 0)) and (both := children[first].get(swap, 0)):
                    if stems[both]:
                        return 1
                    to.add((both, e, ""))
                continue
            if child := here.get(c, 0):
                if stems[child]:
                    return 1
                to.add((child, e, ""))
            if e < k:
                to.add((node, e + 1, ""))
                to.update((child, e + 1, "") for child in here.values())
                to.add((node, e + 1, c))
        return self._number(to)

    def near(self, word: str) -> bool:
        if len(self.sets) > CACHE_STATES:
            self._clear()
        state, moves = self.start, self.moves
        for c in word:
            got = moves[state].get(c)
            if got is None:
                got = moves[state][c] = self._move(state, c)
            if got < 2:
                return got == 1
            state = got
        return self.accepts[state]


FEATURES = ("exact", "stem", "fuzzy", "fuzzy_stem", "quoted", "density", "any_exact")


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    #: words near a term that clean documents have
    clean: list[str] = field(default_factory=list)
    #: the shortest stems of FUZZY_LETTERS or more, which may be misspelt
    loose_stems: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    intercept: float = -2.0

    @cached_property
    def matcher(self) -> Matcher:
        """Made once a worker, so that the words that it has met stay known from task to task."""
        return Matcher(self)


class Matcher:
    """Hits of a lexicon in texts."""

    def __init__(self, model: Model) -> None:
        self.trie = Trie()
        for s in model.stems:
            self.trie.add(s, stem=True)
        terms, longer, stems = Trie(), Trie(), Trie()
        for t in model.terms:
            if len(t) >= FUZZY_LETTERS:
                (longer if len(t) >= FUZZIER_LETTERS else terms).add(t)
        for t in model.loose_stems:
            stems.add(t, stem=True)
        #: terms that may be misspelt, and stems
        self.loose, self.looser, self.loose_stems = Automaton(terms, 1), Automaton(longer, 2), Automaton(stems, 1)
        for t in model.terms:
            self.trie.add(t)
        self.seen: dict[str, int] = {w: 0 for w in model.clean}
        self.clean = dict(self.seen)

    def kind(self, word: str) -> int:
        """2 for a term, 3 for another word of a stem, 1 for a misspelt term, 4 for a word of a misspelt stem, else 0."""
        got = self.trie.kind(word)
        if not got and not word.isalpha():
            got = 1 if self.trie.exact(word.translate(STAND_INS).replace("*", "").replace("'", "")) else 0
        if not got and len(word) >= FUZZY_LETTERS:
            got = 1 if self.loose.near(word) or self.looser.near(word) else 4 if self.loose_stems.near(word) else 0
        if len(self.seen) >= CACHE_WORDS:
            self.seen = dict(self.clean)
        self.seen[word] = got
        return got

    def kinds(self, words: set[str]) -> dict[str, int]:
        """The words that are terms, with their kinds."""
        seen = self.seen
        return {w: k for w in words if (k := seen[w] if w in seen else self.kind(w))}

    def features(self, text: str) -> list[float]:
        """FEATURES of a text."""
        low = text.lower()
        words = WORD.findall(low)
        kinds = self.kinds(set(words))
        if not kinds:
            return [0.0] * len(FEATURES)
        exact = stem = fuzzy = fuzzy_stem = quoted = 0.0
        # where words stand is asked only in texts with marks of quotation
        places = list(WORD.finditer(low)) if any(q in low for q in QUOTES) else None
        for i in [i for i, w in enumerate(words) if w in kinds]:
            k = kinds[words[i]]
            told = sum(w in REPORTING for w in words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]) / CONTEXT
            marked = False
            if places:
                start, end = places[i].span()
                marked = start > 0 and low[start - 1] in QUOTES and low[end : end + 1] in QUOTES
            about = min(1.0, 0.5 * marked + told)
            quoted += about
            if k == 2:
                exact += 1 - about
            elif k == 3:
                stem += 1 - about
            elif k == 4:
                fuzzy_stem += 1 - about
            else:
                fuzzy += 1 - about
        return [np.log1p(exact), np.log1p(stem), np.log1p(fuzzy), np.log1p(fuzzy_stem), np.log1p(quoted), (exact + stem + fuzzy) / len(words) * 10, float(exact > 0)]


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lexicon(labelled: DataFrame) -> Model:
    """Terms, stems and clean words near a term, of ``labelled(text, toxic)``.

    Document counts of words and prefixes are aggregated by Spark.  All terms,
    stems and clean words near a term come back: their number grows with the
    labelled rows only, which ``train`` bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, tuple[str, ...]] = {}

        def prefixes(word: str) -> tuple[str, ...]:
            got = stems.get(word)
            if got is None:
                got = tuple(word[:k] for k in range(STEM_LETTERS[0], min(len(word) - 1, STEM_LETTERS[1]) + 1))
                if len(stems) < CACHE_WORDS:
                    stems[word] = got
            return got

        for batch in batches:
            counts = {(stem, toxic): Counter() for stem in (False, True) for toxic in (False, True)}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in set(WORD.findall((text or "").lower())) if len(w) > 2}
                counts[False, bool(toxic)].update(words)
                counts[True, bool(toxic)].update(set(chain.from_iterable(map(prefixes, words))))
            for (stem, toxic), found in counts.items():
                n, zero = pa.array(found.values(), pa.int64()), pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array([stem] * len(found), pa.bool_()), n if toxic else zero, zero if toxic else n], ["word", "stem", "yes", "no"])

    counts = labelled.select("text", "toxic").mapInArrow(run, "word string, stem boolean, yes long, no long").groupBy("word", "stem").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    enough = F.when(F.col("stem"), F.lit(STEM_SUPPORT)).otherwise(F.lit(SUPPORT))
    # written once, read for the terms and for the stems
    strong = materialise(counts.filter((F.col("yes") >= enough) & (F.col("yes") >= PRECISION * (F.col("yes") + F.col("no") + 1))))
    terms = [r[0] for r in strong.filter("not stem").select("word").collect()]
    stems = [r[0] for r in strong.filter("stem").select("word").collect()]
    def shortest(stems: list[str]) -> list[str]:
        """A stem stands for the longer ones that begin with it."""
        short: list[str] = []
        for s in sorted(stems):
            if not short or not s.startswith(short[-1]):
                short.append(s)
        return short

    model = Model(sorted(terms), shortest(stems), loose_stems=shortest([s for s in stems if len(s) >= FUZZY_LETTERS]))
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = sent.value.matcher
        for batch in batches:
            words = set().union(*(WORD.findall((text or "").lower()) for text in batch.column(0).to_pylist()))
            found = {w for w, k in matcher.kinds(words).items() if k in (1, 4)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["word"])

    clean = labelled.filter("toxic = 0").select("text").mapInArrow(near, "word string").distinct()
    model.clean = sorted(r[0] for r in clean.collect())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; row i stands for n[i] rows."""
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    w = np.zeros(design.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + penalty, design.T @ (n * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _measured(docs: DataFrame, model: Model, keep: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms of the bounded labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = sent.value.matcher
        for batch in batches:
            x = [matcher.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], [keep, "x"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of ``labels(doc_id, toxic)``, learnt from at most train_rows labelled ids outside the held-out ones.

    Null ids and labels teach nothing; an id with two labels has the greater; all
    rows of ``docs`` with a chosen id count, whole texts of any length; extra
    columns are ignored.  Without labels of both kinds, or on an empty table, the
    weights stay 0.
    """
    known = only(labels, "doc_id", "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows pairs of numbers, so the texts stay where they are
    labelled = only(docs, "doc_id", "text").join(F.broadcast(materialise(chosen)), "doc_id").select(F.col("toxic").cast("long").alias("toxic"), "text")
    model = lexicon(labelled)
    # a few distinct rows of features, rounded, with their numbers
    seen = _measured(labelled, model, "toxic").groupBy("toxic", F.transform("x", lambda v: F.round(v, 2)).alias("x")).count()
    rows = sorted(seen.collect())
    if {r[0] for r in rows} != {0, 1}:
        return model
    x, y, n = np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float), np.array([r[2] for r in rows])
    model.weights, model.intercept = _logistic(x, y, n)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, x) of every row of ``docs(doc_id, text)``; x are its FEATURES.

    Null and empty texts have no hits; whole texts of any length are read;
    repeated rows score alike; an empty table gives no rows; extra columns are ignored.
    """
    named = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    z = F.lit(float(model.intercept))
    for i, w in enumerate(model.weights.tolist()):
        z = z + F.col("x")[i] * w
    return _measured(named, model, "doc_id").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "x")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row; null and empty texts score as texts without hits, repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": query}
ORACLES: dict[str, str] = {}
