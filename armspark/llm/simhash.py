"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits are cut into a ring of four segments. If two fingerprints differ in at most r bits, then from
some segment on every chain of l consecutive segments differs in at most l * r / 4 bits. For r = 3 that
means: one segment equal, it and the next at most one bit apart, it and the next two at most two. The first two
conditions are the join key: a fingerprint is filed under (segment, next segment) for each of the four starts, and
looked up under the 16 keys one bit away; the chain of three prunes before the full Hamming check.

Work is on distinct fingerprints, so exact copies cost one row. A key never meets in one task with more than
``hot`` filed fingerprints: beyond that its fingerprints are linked through centres instead. Every fingerprint is sent to all
strings within one flip and within two; at a centre, one that is one flip away is within three of all others
there, so a star of links is exact and no pairs are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_bytes, words_of
from .components import connected

SHINGLE, SEED, RADIUS = 3, 42, 3
SEGMENTS, WIDTH = 4, 16
HOT = 8192
_BLOCK = 8192
_BITS = 64


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a word list; bits set in more than half of the shingle hashes. No words: zero."""
    if not words:
        return 0
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _BLOCK):
        part = words[at : min(total, at + _BLOCK) + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else (part,)
        hashes = np.array([digest(b" ".join(run), SEED) for run in runs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(words_of(text.as_py()), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, dtype="<u8").view("<i8"))], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    return rows.mapInArrow(run, "doc_id long, fp long")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _filed_key(fp: Column, start: int) -> Column:
    first = F.shiftrightunsigned(fp, WIDTH * start).bitwiseAND(F.lit(0xFFFF))
    second = F.shiftrightunsigned(fp, WIDTH * ((start + 1) % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))
    return F.lit(start << 32).bitwiseOR(F.shiftleft(first, WIDTH)).bitwiseOR(second)


def _ring_keys(fp: Column) -> Column:
    """Array of (key, probe): four filed keys and the 64 keys one bit off in the second segment."""
    keys = []
    for start in range(SEGMENTS):
        key = _filed_key(fp, start)
        keys.append(F.struct(key.alias("key"), F.lit(False).alias("probe")))
        for bit in range(WIDTH):
            keys.append(F.struct(key.bitwiseXOR(F.lit(1 << bit)).alias("key"), F.lit(True).alias("probe")))
    return F.array(*keys)


def passes_ring(x: np.ndarray, start: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which differences ``x`` keep the budget of every chain from segment ``start`` on, and the radius."""
    turn = (start * WIDTH).astype(np.uint64)
    ring = (x >> turn) | (x << ((_BITS - turn) % _BITS).astype(np.uint64))
    alive = np.arange(len(x))
    for length in range(2, SEGMENTS + 1):
        mask = np.uint64((1 << (WIDTH * length)) - 1)
        alive = alive[np.bitwise_count(ring[alive] & mask) <= length * radius // SEGMENTS]
    return alive


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node reachable) that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _bucket_links(key: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among whole groups of equal keys; rows are sorted by key, filed ones first."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    found_a, found_b = [], []
    group_size = np.repeat(sizes, sizes)
    filed = ~probe
    small = group_size <= 32
    offset = 1
    rows = np.flatnonzero(small & filed & (group_size > 1))
    while len(rows):
        rows = rows[rows + offset < len(key)]
        rows = rows[key[rows + offset] == key[rows]]
        x = fp[rows] ^ fp[rows + offset]
        ok = rows[passes_ring(x, key[rows] >> np.uint64(32))]
        found_a.append(fp[ok])
        found_b.append(fp[ok + offset])
        offset += 1
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32]):
        mine = fp[s : s + n]
        filed_here = int(filed[s : s + n].sum())
        start = key[s] >> np.uint64(32)
        pairs_a, pairs_b = [], []
        for i in range(filed_here):
            x = mine[i + 1 :] ^ mine[i]
            ok = passes_ring(x, np.full(len(x), start, np.uint64))
            pairs_a.append(np.full(len(ok), mine[i], np.uint64))
            pairs_b.append(mine[i + 1 :][ok])
            if sum(map(len, pairs_a)) > 1_000_000:
                a, b = spanning(np.concatenate(pairs_a), np.concatenate(pairs_b))
                pairs_a, pairs_b = [a], [b]
        if pairs_a:
            found_a.extend(pairs_a)
            found_b.extend(pairs_b)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def ring_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``prints`` (fp) that connect all pairs within the radius."""
    filed = prints.select(F.explode(F.array(*[_filed_key(F.col("fp"), i) for i in range(SEGMENTS)])).alias("key"))
    crowded = filed.groupBy("key").count().where(F.col("count") > hot).select("key")
    near = F.array(F.col("key"), *[F.col("key").bitwiseXOR(F.lit(1 << bit)) for bit in range(WIDTH)])
    crowded = materialize(crowded.select(F.explode(near).alias("key")).distinct(), "ring-crowded")
    rows = prints.select("fp", F.inline(_ring_keys(F.col("fp"))))
    links = None
    if not crowded.isEmpty():
        links = star_links(rows.join(crowded, "key", "left_semi").select("fp").distinct())
        rows = rows.join(crowded, "key", "left_anti")

    def run(batches):
        held = None
        out_a, out_b = [], []

        def emit():
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (out_a, out_b))
            if len(a):
                a, b = spanning(a, b)
            out_a.clear()
            out_b.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

        def take(block):
            a, b = _bucket_links(*block)
            out_a.append(a)
            out_b.append(b)

        for batch in batches:
            block = (
                batch.column(0).to_numpy().view("<u8"),
                batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy().view("<u8"),
            )
            if held is not None:
                block = tuple(np.concatenate(x) for x in zip(held, block))
            key = block[0]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            if cut:
                take(tuple(x[:cut] for x in block))
            held = tuple(x[cut:] for x in block)
            if sum(map(len, out_a)) > 500_000:
                yield emit()
        if held is not None and len(held[0]):
            take(held)
        yield emit()

    sorted_rows = rows.select("key", "probe", "fp").repartition("key").sortWithinPartitions("key", "probe", "fp")
    by_ring = sorted_rows.mapInArrow(run, "a long, b long")
    return by_ring if links is None else by_ring.unionByName(links)


def star_links(prints: DataFrame) -> DataFrame:
    """The same links for fingerprints under crowded keys: exact, in proportion to their number."""
    fp = F.col("fp")
    singles = F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(_BITS)])
    flips = F.sequence(F.lit(0), F.lit(_BITS - 1))
    doubles = F.flatten(
        F.transform(
            flips,
            lambda i: F.transform(
                F.filter(flips, lambda j: j <= i),
                # i = j stands for a single flip
                lambda j: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseXOR(
                    F.when(i == j, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), j))
                ),
            ),
        )
    )
    hubs = prints.select("fp", F.explode(singles).alias("centre")).groupBy("centre").agg(F.min("fp").alias("b"))
    spread = prints.select(fp.alias("a"), F.explode(F.concat(F.array(fp), doubles)).alias("centre"))
    return spread.join(hubs, "centre").where("a <> b").select("a", "b").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    NULL or empty text: fingerprint zero, linked like any other. Rows that repeat an id are in one component if
    their texts are alike and count as rows of their own. NULL ids get the component of their text, whose id is the smallest
    that is not NULL. An empty table gives an empty result. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-firsts")
    roots = materialize(connected(ring_links(firsts.select("fp"), hot)), "simhash-roots")
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    merged = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-merged")
    classes = materialize(rooted.join(merged, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")

