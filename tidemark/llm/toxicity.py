"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding maps homoglyphs and accented letters to plain ones, digits and signs used for letters to
those letters, and all else to spaces. The lexicon holds word beginnings and whole words with their
log odds, learned from labelled documents; exception phrases are longer words and word pairs around
a term that labelled documents use without being toxic. Matches count from the start of a word,
the longest term at a place wins, a match inside an exception phrase counts nothing. The weights per
word and a document's total are turned into a probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.base import broadcast_object, column, slices, texts
from tidemark.session import cut_lineage

# fixed values: letters of other scripts that look like Latin ones, and signs used for letters
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɑ": "a", "ɡ": "g",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _table() -> dict[int, str]:
    table = {}
    for code in [*range(0x21, 0x250), *range(0x370, 0x530), *range(0xFF01, 0xFF5F), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFKD", chr(code)).lower()[:1]
        plain = HOMOGLYPHS.get(plain, plain)
        table[code] = SIGNS.get(plain, plain if plain.isalpha() else " ")
    for code in [*range(0x300, 0x370), *range(0x200B, 0x2010), 0xAD, 0xFEFF]:  # marks and invisible characters
        table[code] = ""
    return table


TABLE = _table()
# signs at the end of a word are decoration, not letters
TRAILING = re.compile(r"(?<=[^\W\d_])[$@0-9]+(?![\w$@])")


def fold(text: str) -> str:
    """Folded words, one space between them and one at both ends."""
    return f" {' '.join(TRAILING.sub('', text).translate(TABLE).split())} "


def terms_of(folded: str, longest: int = 10) -> set[str]:
    """Candidate terms: word beginnings of 4 letters and more, and whole words (ending in a space)."""
    out = set()
    for w in set(folded.split()):
        out.add(w + " ")
        out.update(w[:k] for k in range(4, min(len(w), longest) + 1))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    model: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def _build(self):
        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for term, weight in self.weights.items():
            machine.add_word(f" {term}", (len(term) + 1, weight))
        if len(machine):
            machine.make_automaton()
        self.automaton = machine

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(place, weight) of the longest term at each word, without those in exception phrases."""
        if self.automaton is None:
            self._build()
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            at = end - size + 1
            if weight is None:
                spared.append((at, end))
            elif at not in best or best[at][0] < size:
                best[at] = (size, weight)
        spared.sort()
        out, k, until = [], 0, -1
        for at, (_, w) in sorted(best.items()):
            while k < len(spared) and spared[k][0] <= at:
                until, k = max(until, spared[k][1]), k + 1
            if at >= until:
                out.append((at, w))
        return out

    def features(self, folded: str, found: list[tuple[int, float]]) -> tuple[float, float, float]:
        """Matched weight, the same normalised by length, and the number of matches, all damped."""
        total, words = sum(w for _, w in found), max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(100 * total / (words + 20))), float(np.log1p(len(found)))

    def score(self, folded: str, found: list[tuple[int, float]]) -> float:
        z = self.model[0] + sum(a * b for a, b in zip(self.model[1:], self.features(folded, found)))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _counts(sample: DataFrame, find) -> DataFrame:
    """Documents with each term by label: (``term``, ``toxic``, ``clean``); ``find`` gives a text's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            toxic: dict[str, int] = {}
            clean: dict[str, int] = {}
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                into = toxic if label else clean
                for term in find(fold(text)):
                    into[term] = into.get(term, 0) + 1
            keys = list(toxic.keys() | clean.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic.get(k, 0) for k in keys], pa.int64()),
                 pa.array([clean.get(k, 0) for k in keys], pa.int64())], ["term", "toxic", "clean"])

    return sample.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps of a ridge logistic regression; the intercept is not penalised."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, lexicon_size: int = 4000,
          min_documents: int = 4, min_log_odds: float = 2.5, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Lexicon:
    """A lexicon from the labelled documents.

    At most ``sample_rows`` labelled ids are used (those with the smallest hash), each with one row (of
    several the one whose text has the smallest hash), which bounds what is broadcast and fitted; at most ``lexicon_size`` terms are kept. Labels without a document, without
    an id or with a null label are passed over; without toxic documents every score is the base rate.
    """
    spark = docs.sparkSession
    chosen = labels.select(column(id_col).cast("long").alias("doc_id"), (column(label_col) > 0).alias("label"))
    chosen = chosen.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    # one row per id, so that an id with very many rows does not go beyond the bound
    sample = cut_lineage(found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label")))
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)

    def odds():
        a, b = F.col("toxic"), F.col("clean")
        return F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))

    counted = _counts(sample, terms_of).filter(F.col("toxic") >= min_documents).withColumn("odds", odds())
    best = counted.filter(F.col("odds") >= min_log_odds).orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(lexicon_size)
    weights: dict[str, float] = {}
    kept = {r.term: r for r in best.collect()}
    # a beginning that occurs in the same documents as the letters after it says less than those
    for term, row in sorted(kept.items(), reverse=True):
        shorter = kept.get(term[:-1])
        if shorter and not term.endswith(" ") and (shorter.toxic, shorter.clean) == (row.toxic, row.clean):
            del kept[term[:-1]]
    for row in sorted(kept.values(), key=lambda r: (len(r.term), r.term)):
        # a longer term stays only where it says more than its beginning
        shorter = [weights[row.term[:k]] for k in range(4, len(row.term)) if row.term[:k] in weights]
        if not shorter or row.odds > max(shorter) + 0.5:
            weights[row.term] = row.odds
    plain = Lexicon(weights, [])
    sent = broadcast_object(spark, plain)

    def phrases():
        lexicon = sent()

        def find(folded: str) -> set[str]:
            """Words that hold a matched term, alone and with the word before and after."""
            out = set()
            for at, _ in lexicon.matches(folded):
                end = folded.find(" ", at + 1)
                word = folded[at + 1:end]
                before = folded.rfind(" ", 0, at) if at else -1
                after = folded.find(" ", end + 1)
                out.add(word)
                if before >= 0:
                    out.add(folded[before + 1:end])
                if after > 0:
                    out.add(folded[at + 1:after])
            return out

        return find

    found = _counts_lazily(sample, phrases).withColumn("odds", odds())
    spared = found.filter((F.col("clean") >= min_documents) & (F.col("odds") <= 0)).orderBy(F.desc("clean"), "term").limit(lexicon_size)
    lexicon = Lexicon(weights, [r.term for r in spared.collect()])
    if not toxic or not clean:
        rate = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon(weights, [], (float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0))
    sent_whole = broadcast_object(spark, lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent_whole()
        for part in slices(batches):
            folded = [fold(t) for t in part.column("text").to_pylist()]
            table = np.array([own.features(t, own.matches(t)) for t in folded])
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)]], ["label", "a", "b", "c"])

    fitted = sample.select("text", "label").mapInArrow(measure, "label boolean, a double, b double, c double").collect()
    table = np.array(fitted, dtype=float)
    lexicon.model = _logistic(table[:, 1:], table[:, 0])
    return lexicon


def _counts_lazily(sample: DataFrame, make) -> DataFrame:
    """``_counts`` with a finder that is made once in each task."""
    state: list = []

    def find(folded: str) -> set[str]:
        if not state:
            state.append(make())
        return state[0](folded)

    return _counts(sample, find)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``score``, ``predicted``, ``n_matches``) of every row; null text is empty."""
    sent = broadcast_object(docs.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for part in slices(batches):
            scores, found = [], []
            for text in part.column("text").to_pylist():
                folded = fold(text)
                matches = own.matches(folded)
                found.append(len(matches))
                scores.append(own.score(folded, matches))
            scores = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                 pa.array(found, pa.int64())], ["doc_id", "score", "predicted", "n_matches"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
