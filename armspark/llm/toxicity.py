"""Toxicity: texts are read through a noisy channel before they are scored.

Written text may hide a word by digits and signs in place of letters (leetspeak), by separators between single letters
(spacing) and by repeated letters. Every suspicious span becomes a lattice: each character offers the letters it may stand for, a
run of one letter offers one or two of it, a separator may be dropped, and every character may mean itself. The cheapest path
under channel costs and a character language model (Viterbi over the last two symbols) is the restored span.

The language model counts symbol triples over all documents: a fixed number of symbols, so a fixed number of counts, summed
per task and then over all tasks. Words of the restored texts of about ``sample`` labelled rows (a documented bound, taken by hash) are counted
by label in Spark; the most telling ones, a fixed number, are the features of a logistic model. Scoring is one map over
the documents: no shuffle, whole texts, and nothing but the text goes in.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, whole_text

SAMPLE, FEATURES, LEAST_ROWS = 20_000, 2_048, 10
HELD_OUT_FOLD, THRESHOLD = 0, 0.5
STEPS, RATE, DECAY = 1000, 0.05, 5e-6
# Chi-square of one degree of freedom that one word in a thousand reaches by chance.
TELLING = 10.83

# Symbols: 0 white space, 1 to 26 Latin letters without their accents, then other letters, digits, other characters.
OTHER_LETTER, DIGIT, SIGN, SYMBOLS = 27, 28, 29, 30
_TABLE_SIZE = 0x3000
# What a digit or sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "§": "s",
}
SEPARATORS = " ._*-~/,'"
# Negative log probabilities of the channel: a letter written as a sign, a letter repeated, a separator put in.
SWAPPED, REPEATED, DOUBLED, PARTED = 3.0, 1.0, 4.0, 2.0
# Spans longer than this are read in consecutive pieces.
_PIECE, _CHUNK, _REMEMBERED = 4096, 1 << 20, 200_000
_SPACED = re.compile(r"(?<![^\W_])\S(?:[ ._*\-~/]\S){2,}(?![^\W_])")
_SIGNS = re.escape("".join(LEET))
_MIXED = re.compile(rf"[{_SIGNS}](?:(?<=[^\W\d_].)|(?=[^\W\d_]))|[._*\-~/](?<=[^\W\d_].)(?=[^\W\d_])|([^\W\d_])\1\1")
_LETTERS, _RUN, _MARKS = re.compile(r"[a-z]+"), re.compile(r"([a-z])\1+"), re.compile("[\u0300-\u036f]+")


def symbol_of(char: str) -> int:
    """The language model's symbol; case and accents of Latin letters are dropped."""
    if char.isspace():
        return 0
    base = unicodedata.normalize("NFKD", char)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return OTHER_LETTER if char.isalpha() else DIGIT if char.isdigit() else SIGN


def symbol_table() -> np.ndarray:
    """Symbols of all code points below a fixed one; the last entry serves those beyond (other letters)."""
    return np.array([*(symbol_of(chr(c)) for c in range(_TABLE_SIZE)), OTHER_LETTER], np.int64)


def triple_counts(text: str, table: np.ndarray, into: np.ndarray) -> None:
    """Add the symbol triples of a whole text, with white space around it; runs of white space count once."""
    before = np.zeros(2, np.int64)
    for at in range(0, len(text), _CHUNK):
        points = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        now = np.concatenate([before, table[np.minimum(points, _TABLE_SIZE)]])
        now = np.concatenate([now[:2], now[2:][(now[2:] > 0) | (now[1:-1] > 0)]])
        into += np.bincount((now[:-2] * SYMBOLS + now[1:-1]) * SYMBOLS + now[2:], minlength=SYMBOLS**3)
        before = now[-2:]
    into[(before[0] * SYMBOLS + before[1]) * SYMBOLS] += 1


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """Symbol triples over all documents."""

    def run(batches):
        table, counts = symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                triple_counts(text.as_py(), table, counts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["triple", "times"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    summed = docs.select(whole_text().alias("text")).mapInArrow(run, "triple long, times long").groupBy("triple").agg(F.sum("times").alias("times"))
    for row in summed.collect():
        counts[row.triple] = row.times
    return counts


def language_costs(counts: np.ndarray) -> list[float]:
    """-log P(c | a b), backing off from triples to pairs to single symbols by the number of kinds seen behind a context."""
    triple = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)

    def backed(table, lower):
        total, kinds = table.sum(axis=-1, keepdims=True), (table > 0).sum(axis=-1, keepdims=True)
        return (table + (kinds + 1.0) * lower) / (total + kinds + 1.0)

    single = triple.sum(axis=(0, 1))
    flat = backed(single, np.full(SYMBOLS, 1.0 / SYMBOLS))
    return (-np.log(backed(triple, backed(triple.sum(axis=0), flat)[None]))).ravel().tolist()


class Reader:
    """Restores spans under one language model; remembers a bounded number of tokens."""

    def __init__(self, costs: list[float]):
        self.costs, self.known = costs, {}

    def arcs(self, char: str, run: int) -> list[tuple[tuple[int, ...], float, str]]:
        """What a run of one character may mean: symbols, channel cost, text."""
        symbol = symbol_of(char)
        if 1 <= symbol <= 26:
            letter = chr(96 + symbol)
            if run == 1:
                return [((symbol,), 0.0, letter)]
            once = DOUBLED if run == 2 else REPEATED
            return [((symbol,), once, letter), ((symbol, symbol), 0.0 if run == 2 else REPEATED, letter * 2)]
        itself = (symbol,) if symbol in (0, SIGN) else (symbol,) * min(run, 3)
        found = [(itself, 0.0, char * run)]
        for letter in LEET.get(char, ""):
            code = ord(letter) - 96
            found.append(((code,), SWAPPED + (0.0 if run == 1 else DOUBLED if run == 2 else REPEATED), letter))
            if run > 1:
                found.append(((code, code), SWAPPED + (REPEATED if run > 2 else 0.0), letter * 2))
        if char in SEPARATORS and run == 1:
            found.append(((), PARTED, ""))
        return found

    def restore(self, span: str) -> str:
        """The likeliest meaning of a span."""
        if len(span) > _PIECE:
            return "".join(self.restore(span[i : i + _PIECE]) for i in range(0, len(span), _PIECE))
        costs = self.costs
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for found in re.finditer(r"(?s)(.)\1*", span):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            arcs = self.arcs(found[1], len(found[0]))
            for (a, b), (cost, path) in states.items():
                for symbols, channel, text in arcs:
                    x, y, total = a, b, cost + channel
                    for symbol in symbols:
                        if symbol or y:
                            total += costs[(x * SYMBOLS + y) * SYMBOLS + symbol]
                            x, y = y, symbol
                    old = following.get((x, y))
                    if old is None or total < old[0]:
                        following[x, y] = (total, (path, text))
            states = following
        path = min((cost + (costs[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0), i, p) for i, ((a, b), (cost, p)) in enumerate(states.items()))[2]
        parts = []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def words(self, span: str) -> frozenset[str]:
        """The words of a restored span."""
        found = self.known.get(span)
        if found is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            found = self.known[span] = frozenset(plain_words(self.restore(span)))
        return found


def plain_words(text: str) -> list[str]:
    """Runs of Latin letters: lower case, without accents, doubled letters once."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _LETTERS.findall(_RUN.sub(r"\1", text.lower()))


def spaced_spans(text: str) -> list[str]:
    """Runs of at least three single characters with one separator between each."""
    return [m[0] for m in _SPACED.finditer(text)]


def restored_text(text: str, reader: Reader) -> str:
    """The whole text with its suspicious spans replaced by what they mean."""
    text = _SPACED.sub(lambda m: reader.restore(m[0]), text)
    return re.sub(r"\S+", lambda m: reader.restore(m[0]) if _MIXED.search(m[0]) else m[0], text)


def restored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, restored) of every row: the text as the channel reads it. NULL text: empty."""
    shared = docs.sparkSession.sparkContext.broadcast(language_costs(corpus_counts(docs)))

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            texts = [restored_text(t.as_py(), reader) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, restored string")


def suspicious(text: str) -> set[str]:
    """Spaced spans, and tokens in which letters meet signs or digits, separators or runs of one letter."""
    found, done = set(spaced_spans(text)), 0
    text = " ".join(text.split())
    for met in _MIXED.finditer(text):
        if met.start() >= done:
            done = text.find(" ", met.end())
            done = len(text) if done < 0 else done
            found.add(text[text.rfind(" ", 0, met.start()) + 1 : done])
    return found


def words_of(text: str, reader: Reader) -> set[str]:
    """The words of the plain and of the restored text."""
    words = set(plain_words(text))
    for span in suspicious(text):
        words |= reader.words(span)
    return words


@dataclass
class Model:
    costs: list[float]
    weights: dict[str, float]
    bias: float

    def scorer(self):
        reader, weights, telling = Reader(self.costs), self.weights, set(self.weights)

        def score(text: str) -> float:
            logit = self.bias + sum(weights[w] for w in sorted(words_of(text, reader) & telling))
            return float(1.0 / (1.0 + np.exp(-min(max(logit, -40.0), 40.0))))

        return score


def telling_words(rows: DataFrame, costs: list[float], features: int) -> list[str]:
    """The words whose presence says most about the label: chi-square over the rows from ``TELLING`` on, at most ``features``."""
    shared = rows.sparkSession.sparkContext.broadcast(costs)

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = sorted(words_of(text.as_py(), reader))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label] * len(words), pa.int64())], names=["word", "label"])

    counted = rows.select("label", "text").mapInArrow(run, "word string, label long").groupBy("word").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    n, p = total.n, int(total.p)
    if not 0 < p < n:
        return []
    gap = F.col("p") * F.lit(float(n)) - F.col("n") * F.lit(float(p))
    chi2 = gap * gap / (F.col("n") * (F.lit(n) - F.col("n") + 1) * F.lit(float(p) * (n - p)))  # over n
    sure = counted.where((F.col("n") >= LEAST_ROWS) & (chi2 * F.lit(float(n)) >= TELLING))
    best = sure.orderBy(chi2.desc(), "word").limit(features)
    return sorted(r.word for r in best.select("word").collect())


def presence(rows: DataFrame, costs: list[float], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits (rows x words) and labels of the sampled rows: a fixed number of bytes per row."""
    shared = rows.sparkSession.sparkContext.broadcast((costs, {w: i for i, w in enumerate(words)}))

    def run(batches):
        costs, places = shared.value
        reader = Reader(costs)
        for batch in batches:
            packed = []
            for text in batch.column(1):
                row = np.zeros(len(places), bool)
                row[[places[w] for w in words_of(text.as_py(), reader) & places.keys()]] = True
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["label", "bits"])

    found = sorted((bytes(r.bits), r.label) for r in rows.select("label", "text").mapInArrow(run, "label long, bits binary").collect())
    bits = np.array([np.frombuffer(b, np.uint8) for b, _ in found], np.uint8).reshape(len(found), -(-len(words) // 8))
    return bits, np.array([label for _, label in found], np.float64)


def train(bits: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic weights by Adam over all rows at once; rows that look alike are one row with two counts."""
    if not len(labels) or not 0 < labels.sum() < len(labels) or not width:
        share = (labels.sum() + 0.5) / (len(labels) + 1.0)
        return np.zeros(width), float(np.log(share / (1.0 - share)))
    kinds, which = np.unique(bits, axis=0, return_inverse=True)
    which = which.ravel()
    times, positive = np.bincount(which).astype(float), np.bincount(which, weights=labels)
    at, column = np.nonzero(np.unpackbits(kinds, axis=1, count=width))
    w, mean, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    for step in range(1, STEPS + 1):
        logit = w[-1] + np.bincount(at, weights=w[column], minlength=len(kinds))
        error = (times / (1.0 + np.exp(-np.clip(logit, -40, 40))) - positive) / len(labels)
        grad = np.append(np.bincount(column, weights=error[at], minlength=width) + DECAY * w[:-1], error.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        w = w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Language model over all documents, classifier on about ``sample`` labelled rows outside the held-out fold."""
    costs = language_costs(corpus_counts(docs))
    rows = labelled_sample(docs, labels, "toxic", HELD_OUT_FOLD, sample, "toxic-sample")
    words = telling_words(rows, costs, features)
    bits, y = presence(rows, costs, words)
    weights, bias = train(bits, y, len(words))
    return Model(costs, {w: float(v) for w, v in zip(words, weights)}, bias)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    NULL or empty text: the score of a text without words. NULL doc_id: fold of the empty text. Repeated rows are scored each; repeated
    labelled rows count once. Labels that are not 0 or 1, or whose document is missing, are left out; without labels of both kinds
    every score is the same. Words of other alphabets are not restored. Other columns are ignored.
    """
    model = fit(docs, labels, sample)
    # Plain values: a broadcast is pickled by reference, and tasks need no copy of this package.
    shared = docs.sparkSession.sparkContext.broadcast((model.costs, model.weights, model.bias))

    def run(batches):
        score = Model(*shared.value).scorer()
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
