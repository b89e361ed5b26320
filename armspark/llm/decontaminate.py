"""Benchmark decontamination: a BM25 index of test items, queried with every training passage.

Items are cut into segments of at most ``SEGMENT`` words; each segment is a document of the index, and the rarity of a term is its
document frequency in the training corpus. Impacts are divided by the segment's score against itself, so one threshold in
[0, 1] serves all lengths. Posting lists are cut into blocks with their largest impact, and block-max WAND finds all segments at
or above the threshold: it moves to the next segment that the sum of the lists' largest impacts can still lift to the
threshold, and skips whole blocks whose own maxima cannot. The index has a few tiers by self score, since the largest
impacts of weak segments would loosen the bounds of strong ones; a passage whose words cannot reach the threshold in a tier is not
sent there.

A retrieved item counts only if enough shingles of its question and of its answer stand in the document around the passage.

Passages overlap by half, so every segment lies whole in one. The index is dealt into shards of a bounded number of
words; each shard is a bounded broadcast and two maps over the documents (term counts, search), so no text is shuffled.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

SEGMENT = 32
PASSAGE, STRIDE = 2 * SEGMENT, SEGMENT
K1, B = 1.2, 0.75
THRESHOLD = 0.7
SHINGLE, QUESTION_OVERLAP, ANSWER_OVERLAP = 3, 0.5, 0.5
BLOCK, TIERS = 64, 6
SHARD_WORDS = 1_000_000
_PASSAGES = 512  # of a text at a time
_SIGNS = string.punctuation + "«»…“”‘’„–—¿¡·•"
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def bare(word: str) -> str:
    """A lower-case word without the signs around it; empty for a run of signs."""
    return word.strip(_SIGNS)


def tokens(text: str) -> list[str]:
    return [w for w in map(bare, text.lower().split()) if w]


class TermIds(dict):
    """Written word -> term number, ``other`` outside the index, -1 for signs; remembers a bounded number."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms, self.other = terms, len(terms)

    def __missing__(self, word: str) -> int:
        plain = word.strip(_SIGNS)
        self[word] = number = self.terms.get(plain, self.other) if plain else -1
        return number

    def of(self, words: list[str] | set[str]) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        return list(map(self.__getitem__, words))


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence or line is its answer; an item of one sentence has a question only."""
    parts = [p for p in (tokens(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


class BlockMaxIndex:
    """Posting lists of one tier by term number: ascending segment places, their impacts, and the largest impact per block."""

    def __init__(self, segments: dict, n_terms: int):
        """segments: segment -> {term number: impact}, each summing to one."""
        self.segments = sorted(segments)
        lists: dict[int, list] = {}
        for place, segment in enumerate(self.segments):
            for term, value in segments[segment].items():
                lists.setdefault(term, []).append((place, value))
        self.places, self.impacts, self.ends, self.block_max = {}, {}, {}, {}
        #: Largest impact of each term; the last entry stands for words outside the index.
        self.bound = np.zeros(n_terms + 1)
        for term, pairs in lists.items():
            at, values = zip(*pairs)
            self.places[term], self.impacts[term] = at, values
            self.ends[term] = [at[min(i + BLOCK, len(at)) - 1] for i in range(0, len(at), BLOCK)]
            self.block_max[term] = [max(values[i : i + BLOCK]) for i in range(0, len(at), BLOCK)]
            self.bound[term] = max(values)
        self._bound = self.bound.tolist()

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (segment place, score) at or above the threshold, by block-max WAND."""
        slack = threshold - 1e-9
        cursor = [[self.places[t][0], t, 0] for t in terms if t in self.places]  # current place, term, position
        found = []
        while cursor:
            cursor.sort()
            reach, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursor):
                reach += self._bound[t]
                if reach >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            at = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == at:
                pivot += 1
            # What the blocks around the pivot can give at most, and where the first of them ends.
            most, limit = 0.0, None
            for _, t, _ in cursor[: pivot + 1]:
                block = bisect_left(self.ends[t], at)
                if block < len(self.ends[t]):
                    most += self.block_max[t][block]
                    end = self.ends[t][block]
                    limit = end if limit is None or end < limit else limit
            if most < slack:
                after = (at if limit is None else limit) + 1
                if pivot + 1 < len(cursor):
                    after = min(after, max(cursor[pivot + 1][0], at + 1))
                cursor = self._advance(cursor, pivot, after)
            elif cursor[0][0] == at:
                score = sum(self.impacts[t][p] for _, t, p in cursor[: pivot + 1])
                if score >= slack:
                    found.append((at, score))
                cursor = self._advance(cursor, pivot, at + 1)
            else:
                cursor = self._advance(cursor, pivot, at)
        return found

    def _advance(self, cursor: list, pivot: int, to: int) -> list:
        kept = cursor[pivot + 1 :]
        for place, t, p in cursor[: pivot + 1]:
            if place < to:
                p = bisect_left(self.places[t], to, p)
            if p < len(self.places[t]):
                kept.append([self.places[t][p], t, p])
        return kept


class Shard:
    """The tiers of one shard and what verification needs of its items."""

    def __init__(self, rows: list[Row], df: dict[str, int], total: int, mean_length: float, texts: dict[int, str]):
        """rows: (key, n, term, tf, length); df, total: documents with the term, and all; texts: item key -> text."""
        self.terms = {term: i for i, term in enumerate(sorted({r.term for r in rows}))}
        segments: dict[tuple, dict] = {}
        for r in rows:
            rare = df.get(r.term, 0)
            idf = log(1.0 + (total - rare + 0.5) / (rare + 0.5))
            value = idf * r.tf * (K1 + 1) / (r.tf + K1 * (1 - B + B * r.length / mean_length))
            segments.setdefault((r.key, r.n), {})[self.terms[r.term]] = value
        own = {s: sum(impacts.values()) for s, impacts in segments.items()}
        order = sorted(own, key=lambda s: (own[s], s))
        size = ceil(len(order) / TIERS)
        self.tiers = [
            BlockMaxIndex({s: {t: v / own[s] for t, v in segments[s].items()} for s in order[i : i + size]}, len(self.terms))
            for i in range(0, len(order), size)
        ]
        # A row per term, so that the bounds of a word in all tiers lie together.
        self.bounds = np.stack([tier.bound for tier in self.tiers], axis=1)
        self.checks = {}
        for key, text in texts.items():
            question, answer = question_and_answer(text)
            sizes = min(SHINGLE, len(question)), min(SHINGLE, len(answer))
            self.checks[key] = (shingles(question), shingles(answer), len(question) + len(answer), *sizes)

    def leaks(self, text: str, codes: TermIds, threshold: float = THRESHOLD) -> list[tuple[int, float, float, float, int]]:
        """(item key, score, question share, answer share, word position) of every item leaked into ``text``."""
        words = text.lower().split()
        ids = np.array(codes.of(words), np.int64)
        at = np.flatnonzero(ids >= 0)
        if len(at) < len(ids):
            ids = ids[at]
        if not len(ids):
            return []
        slack = threshold - 1e-9
        spots: dict[int, list] = {}
        passages = max(1, ceil((len(ids) - PASSAGE + STRIDE) / STRIDE))
        padded = np.append(ids, np.full((passages - 1) * STRIDE + PASSAGE - len(ids), codes.other))
        windows = np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[::STRIDE]
        for first in range(0, passages, _PASSAGES):
            found = np.sort(windows[first : first + _PASSAGES], axis=1)
            # Each word once, as it is scored; the number of words outside the index is the largest and lifts nothing.
            found[:, :-1][found[:, :-1] == found[:, 1:]] = codes.other
            reached = self.bounds[found].sum(axis=1) >= slack
            for place, tier in zip(*(x.tolist() for x in np.nonzero(reached))):
                terms, start = sorted(set(found[place].tolist())), (first + place) * STRIDE
                for segment, score in self.tiers[tier].search(terms, threshold):
                    spots.setdefault(self.tiers[tier].segments[segment][0], []).append((start, score))
        out = []
        for key, hits in sorted(spots.items()):
            best = None
            question, answer, length, *sizes = self.checks[key]
            for start, score in hits:
                first, last = max(0, start - length), min(len(at), start + PASSAGE + length)
                around = tokens(" ".join(words[at[first] : at[last - 1] + 1]))
                q = len(question & shingles(around, sizes[0])) / len(question) if question else 1.0
                a = len(answer & shingles(around, sizes[1])) / len(answer) if answer else 1.0
                if q >= QUESTION_OVERLAP and a >= ANSWER_OVERLAP and (best is None or score > best[0]):
                    best = (score, q, a, start)
            if best:
                out.append((key, *best))
        return out


def _term_counts(docs: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each term: counted per task, added up over tasks; as many rows as terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        codes = TermIds({t: i for i, t in enumerate(terms)})
        seen = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                # Each written word once, then each term once: a text repeats most of its words.
                held = set(codes.of(set(text.as_py().lower().split())))
                held.discard(-1)
                seen[list(held)] += 1
        found = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["term", "df"])

    counted = docs.select(whole_text().alias("text")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {terms[r.term]: r.df for r in counted.collect()}


def index_shards(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS):
    """Yield (shard, item ids by key) for the index of ``items`` (item_id, text) with term counts of ``docs``."""

    def cut(batches):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                size = ceil(len(words) / max(1, ceil(len(words) / SEGMENT))) or 1
                for n, start in enumerate(range(0, len(words), size)):
                    part = words[start : start + size]
                    rows += [(key, n, term, tf, len(part)) for term, tf in Counter(part).items()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "n", "term", "tf", "length"]
            )

    texts = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    # Rows that repeat an id with another text are items of their own: the key tells them apart.
    texts = texts.distinct().withColumn("key", F.xxhash64("item_id", "text"))
    cuts = texts.select("key", "text").mapInArrow(cut, "key long, n long, term string, tf long, length long")
    postings = materialize(cuts, "bm25-postings")
    facts = postings.agg(F.sum("tf").alias("words"), F.countDistinct("key", "n").alias("segments")).first()
    if not facts.words:
        return
    shards = ceil(facts.words / shard_words)
    shard = F.pmod("key", F.lit(shards))
    total = docs.count()
    for k in range(shards):
        rows = postings.where(shard == k).collect()
        if rows:
            known = texts.where(shard == k).collect()
            df = _term_counts(docs, sorted({r.term for r in rows}))
            mean = facts.words / facts.segments
            yield Shard(rows, df, total, mean, {r.key: r.text for r in known}), {r.key: r.item_id for r in known}


LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word_position long"


def find_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, score, question_overlap, answer_overlap, word_position.

    Score is the share of the best segment's own BM25 score. NULL or empty texts and items without words leak nothing; items with a NULL id
    take no part. Repeated documents are reported each; repeated items once. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    names = [x.split()[0] for x in LEAK.split(", ")]
    found = None
    for shard, ids in index_shards(docs, items, **options):
        shared = docs.sparkSession.sparkContext.broadcast((shard, ids))

        def run(batches, shared=shared):
            shard, ids = shared.value
            codes = TermIds(shard.terms)
            for batch in batches:
                out = [
                    (doc.as_py(), ids[hit[0]], *hit[1:])
                    for doc, text in zip(batch.column(0), batch.column(1))
                    for hit in shard.leaks(text.as_py(), codes)
                ]
                columns = list(zip(*out)) or [[]] * len(names)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        part = rows.mapInArrow(run, LEAK)
        found = part if found is None else found.unionByName(part)
    return rows.limit(0).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in LEAK.split(", ")]) if found is None else found


def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leaked item, with their columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept, at = docs.toDF(*names), docs.columns.index("text")
    for shard, _ in index_shards(docs, items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches, shared=shared):
            shard = shared.value
            codes = TermIds(shard.terms)
            for batch in batches:
                clean = [not shard.leaks(text.as_py() or "", codes) for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.toDF(*docs.columns)
