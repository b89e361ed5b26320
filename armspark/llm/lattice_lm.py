"""LM scoring: subword lattice likelihood.

A document is a run of words and one end token. The probability of a word is the sum over all its
segmentations. The edges of its lattice are the pieces of an existing public vocabulary, weighted by
unigram scores, and one edge for the whole word where training documents hold it. Piece scores start
from the rank order stored in the vocabulary file and are re-estimated on the training words by
expectation maximisation: a warm start on the most frequent words, then one full pass over all of them.

The whole-word edge weighs (c - d) / N; the discount d = n1 / (n1 + 2 n2) moves d V / N to the pieces,
whose own marginal sums to one over all words, so that the model is a proper distribution over texts.

How it runs: one pass counts words with map-side sums; the table of distinct words is the only
thing that grows, and it is shuffled, never broadcast. The ``head`` most frequent words (a fixed
number, so a bounded broadcast) are looked up in the scoring pass itself; the rest, which no longer has hot
keys, is joined by word. Texts never move.
"""

from __future__ import annotations

from collections import Counter
from math import exp, log, log10

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import fold, row_key, text_bytes, words_of
from .lattice import BYTE_PIECES, MARK, expected_counts, lattice_index, log_marginal

HEAD = 50_000
WARM_WORDS, WARM_ROUNDS = 20_000, 3
SMOOTHING = 0.1
HELD_OUT_FOLD = 1
_FLUSH = 150_000
_ROWS = 20_000


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece file in its stored order, without control pieces.

    Texts are lower-cased A-Z, so pieces with such capitals can never match and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or any("A" <= c <= "Z" for c in piece)):
            kept.append(piece)
    return kept


def rank_weights(pieces: list[str]) -> dict[str, float]:
    """Starting log weights: the stored order as Zipf ranks; the mark and the bytes are always there."""
    mass = {piece: 1.0 / (50 + i) for i, piece in enumerate(pieces)}
    mass.setdefault(MARK, 1.0 / 50)
    mass.update({piece: 1e-4 for piece in BYTE_PIECES})
    total = sum(mass.values())
    return {piece: log(value / total) for piece, value in mass.items()}


def _updated(weight: dict[str, float], expected: dict[str, float]) -> dict[str, float]:
    """Expected counts, smoothed by a share of the former weights so that no piece falls to zero."""
    seen = sum(expected.values())
    mass = {p: expected.get(p, 0.0) + SMOOTHING * (1.0 + 1e-4 * seen) * exp(w) for p, w in weight.items()}
    total = sum(mass.values())
    return {p: log(value / total) for p, value in mass.items()}


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def count_words(docs: DataFrame, held_out: str) -> DataFrame:
    """(word, c_train, c_all): sums per task first, in a dictionary of bounded size, then over all tasks."""

    def count(batches):
        train, other = Counter(), Counter()

        def drain():
            words = list(train.keys() | other.keys())
            for i in range(0, len(words), _ROWS):
                part = words[i : i + _ROWS]
                yield pa.RecordBatch.from_pydict(
                    {
                        "word": pa.array(part, pa.binary()),
                        "c_train": pa.array([train[w] for w in part], pa.int64()),
                        "c_all": pa.array([train[w] + other[w] for w in part], pa.int64()),
                    }
                )
            train.clear()
            other.clear()

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1)):
                (other if held.as_py() else train).update(words_of(text.as_py()))
                if len(train) + len(other) > _FLUSH:
                    yield from drain()
        yield from drain()

    counted = docs.select(text_bytes(), held_out).mapInArrow(count, "word binary, c_train long, c_all long")
    return counted.groupBy("word").agg(F.sum("c_train").alias("c_train"), F.sum("c_all").alias("c_all"))


def most_frequent(words: DataFrame, count: str, size: int) -> DataFrame:
    """At most ``size`` words, the most frequent ones, cut where a class of counts ends.

    A histogram of a few hundred classes gives the cut, so no task sends its own candidates to the driver.
    """
    level = F.floor(F.log2(count) * 16)
    classes = words.where(F.col(count) > 0).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = None, 0
    for row in classes:
        held += row["count"]
        if held > size:
            break
        least = row.level
    return words.where(F.lit(False)) if least is None else words.where((F.col(count) > 0) & (level >= least))


def fit_pieces(words: DataFrame, pieces: list[str]) -> dict[str, float]:
    """Log weights of the pieces. Only expected counts per piece reach the driver: the vocabulary bounds them."""
    weight = rank_weights(pieces)
    top = sorted(most_frequent(words, "c_train", WARM_WORDS).collect(), key=lambda r: bytes(r.word))
    for _ in range(WARM_ROUNDS if top else 0):
        expected: dict[str, float] = {}
        index = lattice_index(weight)
        for row in top:
            expected_counts(_text(bytes(row.word)), row.c_train, index, expected)
        weight = _updated(weight, expected)
    shared = words.sparkSession.sparkContext.broadcast(weight)

    def expect(batches):
        index = lattice_index(shared.value)
        expected: dict[str, float] = {}
        for batch in batches:
            for word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                expected_counts(_text(word), count, index, expected)
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array(list(expected), pa.string()), "expected": pa.array(list(expected.values()), pa.float64())}
        )

    sums = (
        words.where("c_train > 0")
        .select("word", "c_train")
        .mapInArrow(expect, "piece string, expected double")
        .groupBy("piece")
        .agg(F.sum("expected").alias("expected"))
    )
    found = {row.piece: row.expected for row in sums.collect()}
    return _updated(weight, found) if found else weight


def word_scores(words: DataFrame, weight: dict[str, float], total: int, discount: float, spare: float) -> DataFrame:
    """(word, c_train, log_piece, log_word): log marginals by pieces alone and of the whole model."""
    shared = words.sparkSession.sparkContext.broadcast(weight)

    def score(batches):
        index = lattice_index(shared.value)
        log_spare = log(spare)
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_piece = [log_marginal(_text(w), index) for w in names]
            full = []
            for c, piece in zip(counts, by_piece):
                value = log_spare + piece
                if c > discount:
                    whole = log((c - discount) / total)
                    value = whole + log(1.0 + exp(min(value - whole, 700.0)))
                full.append(value)
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array(names, pa.binary()),
                    "c_train": pa.array(counts, pa.int64()),
                    "log_piece": pa.array(by_piece, pa.float64()),
                    "log_word": pa.array(full, pa.float64()),
                }
            )

    return words.select("word", "c_train").mapInArrow(
        score, "word binary, c_train long, log_piece double, log_word double"
    )


_PARTS = (
    "row long, doc_id long, held_out boolean, word binary, tf long, "
    "n_tokens long, n_known long, base double, by_piece double, score double"
)


def lattice_scores(docs: DataFrame, vocabulary: str, head: int = HEAD) -> DataFrame:
    """Score every whole text of ``docs``; learn from those outside the held-out fold.

    vocabulary: path of a sentencepiece file on the driver. Returns doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-half unigram words), subword_score (pieces alone), score (the model).

    NULL or empty text: one end token. NULL doc_id: fold of the empty text. Repeated rows are scored
    and counted each. An empty table gives an empty result; without training rows the words are
    weighed by pieces alone and the end token gets one half. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", fold(F.col("doc_id")) == HELD_OUT_FOLD)
    words = materialize(count_words(rows, "held_out"), "lm-words")
    facts = words.agg(
        F.sum("c_train").alias("n"),
        F.count_if(F.col("c_train") > 0).alias("v"),
        F.count_if(F.col("c_train") == 1).alias("n1"),
        F.count_if(F.col("c_train") == 2).alias("n2"),
    ).first()
    ends = rows.where("not held_out").count()
    total, kinds = (facts.n or 0) + ends, facts.v + (ends > 0)
    discount = min(0.9, max(0.1, facts.n1 / (facts.n1 + 2 * facts.n2))) if facts.n1 else 0.5
    spare = discount * kinds / total if total else 0.5
    end_log = log((ends - discount) / total) if ends else log(0.5)

    weight = fit_pieces(words, load_pieces(vocabulary))
    scored = materialize(word_scores(words, weight, total, discount, spare), "lm-scores")
    joined = most_frequent(words, "c_all", head).select("word").join(scored, "word")
    frequent = {bytes(r.word): (r.c_train, r.log_piece, r.log_word) for r in joined.collect()}
    shared = spark.sparkContext.broadcast(frequent)
    floor = total + 0.5 * (kinds + 1)
    end_base = log10((ends + 0.5) / floor)

    def lookup(batches):
        table = shared.value
        for batch in batches:
            out: dict[str, list] = {name.split()[0]: [] for name in _PARTS.split(", ")}
            add = [column.append for column in out.values()]

            def put(*values):
                for to, value in zip(add, values):
                    to(value)

            for row, doc_id, held, text in zip(*(batch.column(i) for i in range(4))):
                row, doc_id, held = row.as_py(), doc_id.as_py(), held.as_py()
                n, known = 1, int(ends > 0)
                base, by_piece, score = end_base, end_log, end_log
                for word, tf in Counter(words_of(text.as_py())).items():
                    n += tf
                    entry = table.get(word)
                    if entry is None:
                        put(row, doc_id, held, word, tf, 0, 0, 0.0, 0.0, 0.0)
                        continue
                    c, piece, full = entry
                    known += tf if c else 0
                    base += tf * log10((c + 0.5) / floor)
                    by_piece += tf * piece
                    score += tf * full
                # The document's own row: its key holds a space, so it meets no word in the join.
                put(row, doc_id, held, b" %d" % row, 0, n, known, base, by_piece, score)
                if len(out["row"]) >= _ROWS:
                    yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)
                    for column in out.values():
                        column.clear()
            if out["row"]:
                yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    parts = row_key(rows, "row").select("row", "doc_id", "held_out", text_bytes()).mapInArrow(lookup, _PARTS)
    c = F.coalesce("c_train", F.lit(0))
    per_ln10 = 1.0 / log(10.0)
    met = parts.join(scored, "word", "left").select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("tf") * F.log10((c + 0.5) / floor)).alias("base"),
        (F.col("by_piece") + F.col("tf") * F.coalesce("log_piece", F.lit(0.0))).alias("by_piece"),
        (F.col("score") + F.col("tf") * F.coalesce("log_word", F.lit(0.0))).alias("score"),
    )
    return (
        met.groupBy("row", "doc_id", "held_out")
        .agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base_score"),
            (F.sum("by_piece") * per_ln10).alias("subword_score"),
            (F.sum("score") * per_ln10).alias("score"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(total).cast("long").alias("train_tokens"),
            "base_score",
            "subword_score",
            "score",
        )
    )


_SCHEMA = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("word", pa.binary()),
        ("tf", pa.int64()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base", pa.float64()),
        ("by_piece", pa.float64()),
        ("score", pa.float64()),
    ]
)
