"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text, with exception phrases."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import chunks, text_column
from larkspur.llm.training import held_out, labelled_docs
from larkspur.session import checkpointed

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝɡвкмнтαοενιυρτκχ", "aeopcyxijshdqwgbkmhtaoeviuptkx", strict=True))
#: Digits and signs that stand for letters; i, l and 1 fold into one letter, since any may stand for another.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
THRESHOLD = 0.3
#: A stem has STEM letters at least and LONGEST at most and begins a word; these bound what is learned (STEMS stems and PHRASES exceptions).
STEM, LONGEST, STEMS, PHRASES = 3, 12, 2000, 500
#: A stem must stand in LEAST_ROWS toxic texts and LEAST_SHARE of them, and be ODDS times as frequent there as in the others.
LEAST_ROWS, LEAST_SHARE, ODDS = 5, 0.02, 12.0
#: Characters of a text that count as one unit of length.
UNIT = 100.0


class _Fold(dict):
    """Character folding for str.translate: letters to plain lower case without accents, digits to letters, the rest to a space."""

    def __missing__(self, c: int) -> str | None:
        ch = chr(c)
        if unicodedata.category(ch) in ("Cf", "Mn"):
            out = None
        else:
            low = "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).lower()) if unicodedata.category(x) != "Mn")
            out = "".join(SUBSTITUTES.get(x, x) for x in (HOMOGLYPHS.get(y, y) for y in low))
            out = "".join(x if x.isalpha() else " " for x in out)
        self[c] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """The text in folded letters, words parted by spaces, with one at either end."""
    return " " + text.translate(_FOLD) + " "


@dataclass
class Lexicon:
    """Weights of folded stems, phrases in which a stem does not count, and the logistic of the document score.

    stems: weight by stem (the beginning of a word); exceptions: "before word" and "word after" phrases;
    base, by_sum, by_rate: the score is logistic(base + by_sum * log1p(sum) + by_rate * log1p(sum per unit of length)).
    """

    stems: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    base: float = -3.0
    by_sum: float = 2.0
    by_rate: float = 2.0
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def hits(self, folded: str) -> Iterator[tuple[str, int, int]]:
        """(stem, start, stop) of matches at the start of words; the longest stem of a word, and not within an exception."""
        if not self.stems:
            return
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for s in self.stems:
                self._automaton.add_word(" " + s, s)
            self._automaton.make_automaton()
        best: dict[int, tuple[str, int, int]] = {}
        for end, s in self._automaton.iter(folded):
            start = end - len(s) + 1
            if start not in best or len(s) > len(best[start][0]):
                best[start] = (s, start, end + 1)
        for s, a, b in best.values():
            if not (self.exceptions and self.exceptions.intersection(phrases(folded, a))):
                yield s, a, b

    def total(self, folded: str) -> float:
        return sum(self.stems[s] for s, _, _ in self.hits(folded))

    def score(self, text: str) -> float:
        t = self.total(fold(text))
        z = self.base + self.by_sum * np.log1p(t) + self.by_rate * np.log1p(t * UNIT / (UNIT + len(text)))
        return float(1 / (1 + np.exp(-z)))


def phrases(folded: str, start: int) -> list[str]:
    """The word at `start` with the word before it and with the word after it."""
    stop = folded.find(" ", start)
    stop = len(folded) if stop < 0 else stop
    word = folded[start:stop]
    end, at = start, stop
    while end and folded[end - 1] == " ":
        end -= 1
    while at < len(folded) and folded[at] == " ":
        at += 1
    before = folded[folded.rfind(" ", 0, end) + 1 : end]
    last = folded.find(" ", at)
    after = folded[at : last if last >= 0 else len(folded)]
    return ([f"{before} {word}"] if before else []) + ([f"{word} {after}"] if after else [])


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of toxic and other texts: words in all (stem null), words that begin with a stem, and texts that have one.

    A word that a text repeats n times counts log2(1 + n), so that one text of a single word isn't evidence.
    """
    names = ["stem", "label", "words", "texts"]
    for batch in batches:
        words, texts, size = (Counter(), Counter()), (Counter(), Counter()), [0.0, 0.0]
        for text, label in zip(text_column(batch, "text").to_pylist(), batch.column(1).to_pylist(), strict=True):
            y = int(label > 0)
            stems: Counter[str] = Counter()
            for w, c in Counter(fold(text).split()).items():
                n = log2(1 + c)
                size[y] += n
                for k in range(STEM, min(len(w), LONGEST) + 1):
                    stems[w[:k]] += n
            words[y].update(stems)
            texts[y].update(stems.keys())
        for y in (0, 1):
            stems = [None, *words[y]]
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([y] * len(stems)), pa.array([size[y], *words[y].values()], pa.float64()), pa.array([0, *(texts[y][k] for k in words[y])])], names)


def choose_stems(counts: dict[str, tuple[float, float]], toxic: float, other: float) -> dict[str, float]:
    """Weights (smoothed log ratio of rates) of stems, given occurrences in toxic and other texts and words in all of each.

    Stems are taken by their log-likelihood ratio, the longest on ties; one that begins another, or is the
    beginning of another, that is already taken is left out.
    """

    def ratio(a: float, b: float) -> float:
        p = (a + b) / (toxic + other)
        return 2 * (a * np.log(max(a, 1) / (toxic * p)) + b * np.log(max(b, 1) / (other * p)))

    order = sorted(counts, key=lambda s: (-round(ratio(*counts[s]), 6), -len(s), s))
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for s in order:
        if len(chosen) == STEMS:
            break
        if s not in begun and not any(s[:k] in chosen for k in range(STEM, len(s))):
            a, b = counts[s]
            chosen[s] = float(np.log((a + 0.5) / toxic) - np.log((b + 1.5) / other))
            begun.update(s[:k] for k in range(STEM, len(s)))
    return {s: w for s, w in chosen.items() if w > 0}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    """Learn stems, weights, exception phrases and the score's curve on the bounded labelled sample.

    Without labelled rows of both classes the lexicon is empty and every text gets the same low score.
    """
    sample = checkpointed(labelled_docs(docs, labels, label))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if toxic in (0, n):
        return Lexicon({}, base=float(np.log((toxic + 1) / (n - toxic + 1))))
    of = lambda y, c: F.sum(F.when(F.col("label") == y, F.col(c)).otherwise(0))
    counts = sample.mapInArrow(_stem_counts, "stem string, label long, words double, texts long")
    counts = checkpointed(counts.groupBy("stem").agg(of(1, "words").alias("a"), of(0, "words").alias("b"), of(1, "texts").alias("rows")))
    size = counts.where("stem is null").first()
    # Few stems of the bounded sample are so much more frequent in toxic texts.
    counts = counts.where((F.col("rows") >= max(LEAST_ROWS, toxic * LEAST_SHARE)) & (F.col("a") / F.lit(max(1, size.a)) > ODDS * F.col("b") / F.lit(max(1, size.b))))
    stems = choose_stems({r.stem: (r.a, r.b) for r in counts.where("stem is not null").collect()}, size.a, size.b)
    lexicon = Lexicon(stems)

    def contexts(batches):
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, label in zip(text_column(batch, "text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                out += [(p, int(label)) for p in {p for _, at, _ in lexicon.hits(folded) for p in phrases(folded, at)}]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.int64())], ["phrase", "toxic"])

    harmless = sample.mapInArrow(contexts, "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows"))
    harmless = harmless.where((F.col("toxic") == 0) & (F.col("rows") >= LEAST_ROWS)).orderBy(F.desc("rows"), "phrase").limit(PHRASES)
    lexicon.exceptions = frozenset(r.phrase for r in harmless.collect())

    def features(batches):
        for batch in batches:
            texts = text_column(batch, "text").to_pylist()
            total = np.array([lexicon.total(fold(t)) for t in texts])
            rate = total * UNIT / (UNIT + np.array([len(t) for t in texts], float))
            yield pa.RecordBatch.from_arrays([pa.array(np.log1p(total)), pa.array(np.log1p(rate)), batch.column(1)], ["a", "b", "label"])

    rows = np.array(sample.mapInArrow(features, "a double, b double, label double").collect())
    lexicon.by_sum, lexicon.by_rate, lexicon.base = map(float, _logistic(rows[:, :2], rows[:, 2]))
    return lexicon


def with_scores(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row; a null text scores as the empty one."""
    source = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = source.value
        for batch in batches:
            column = text_column(batch, "text")
            for a, b in chunks(column):
                scores = [own.score(t) for t in column.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scores, pa.float64())], ["doc_id", "score"])

    docs = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    scored = with_scores(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
