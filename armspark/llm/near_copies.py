"""Near copies of 0.8 or more on five-word shingles, by wide SimHash prints and pigeonring filtering.

The 64-bit links of :mod:`simhash` stop at 3 bits, but at a similarity of 0.8 about ten of 64 bits differ. Here the distinct shingles
of a text give a print of 384 bits, a ring of 48 segments of eight bits. Two texts meet if a chain of three segments agrees but
for bits that were close calls: each text is filed under the four values that its two narrowest bits of the chain can take. In a
bucket, the next four and eight segments must stay within their proportional budgets of the radius, and the numbers of shingles within
the similarity. The full Hamming distance and then the exact similarity of the shingle sets decide.

A group of texts gives trees first, not pairs: per bucket one forest, grown over three budgets, so that texts are
joined by the closest links there are. Of the links of trees with cycles cut only the closest of each row is verified at once. Where a link of a
tree then lies between two components, because it was rejected or not verified, they meet again in rounds: each row lists its closest rows of other components, eight times as many from round to round, until no list is cut. Then every
pair within budgets is in one component, verified, or ruled out. In these rounds rows carry their whole print and the counts of their shingles in 128 parts
of the hash space: the shingles that two texts share are at most the smaller counts added up, so a pair that this or the radius rules out
never leaves the bucket, and components that are really apart cost comparisons there but hardly a row. A bucket of
more than ``hot`` rows is cut into parts that meet pairwise in tasks of their own: memory is bounded and no meeting is left out.

The 64-bit components of :mod:`simhash` are buckets too: in them the pairs of at most 3 bits are candidates, and verified like the others.

Chains are a filter with losses: by simulation a pair of similarity 0.80 has one in twenty chances to share none, of 0.83 one in fifty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_bytes, whole_text, words_of
from .components import connected
from .simhash import RADIUS as FEW
from .simhash import fingerprint, ring_links

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
LONGS = 6
RING = LONGS * 8  # segments of eight bits
CHAIN, STEP, NARROW, AHEAD = 3, 2, 2, 8
STARTS = RING // STEP
RADIUS = 75
HOT, SMALL, COUNTED = 8192, 32, 16
LEVELS = (0.3, 0.6, 1.0)  # shares of the budgets, closest links first
LISTED, MORE = 16, 8  # rows of other components that a row lists in the second round, and times as many in each later one
PARTS = 128  # of the hash space, in which shingles are counted
_BLOCK, _ROWS, _HASHES, _NODES = 255, 256, 200_000, 2048
_LANES = np.uint64(0x0101010101010101)
_WINDOW = (np.arange(STARTS)[:, None] * STEP * 8 + np.arange(CHAIN * 8)) % (RING * 8)
_P = [f"p{i}" for i in range(LONGS)]


def grams(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < SHINGLE:
        runs = [words]
    else:
        runs = zip(*(words[i:] for i in range(SHINGLE)))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(run), SEED) for run in runs), "<u8"))


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """The ``turn``-th independent 64 bits of each hash."""
    x = hashes + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tallies(sets: list[np.ndarray]) -> np.ndarray:
    """Per set and bit of the print: twice the number of hashes with it set, less the number of hashes. No set is empty."""
    sizes = np.array([len(x) for x in sets])
    hashes = np.concatenate(sets)
    ends = np.cumsum(sizes)
    # Runs of at most 255 hashes of one set: their counts fit into the bytes of one number.
    runs = -(-sizes // _BLOCK)
    first = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first, runs)
    edges = np.repeat(ends - sizes, runs) + within * _BLOCK
    ones = np.zeros((len(sets), LONGS, 8, 8), np.int64)  # set, word, byte, bit of the byte
    for turn in range(LONGS):
        x = _mixed(hashes, turn + 1)
        for bit in range(8):
            lanes = np.add.reduceat((x >> np.uint64(bit)) & _LANES, edges)
            ones[:, turn, :, bit] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return 2 * ones.reshape(len(sets), -1) - sizes[:, None]


def text_key() -> Column:
    return F.xxhash64(whole_text())


def wide_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, n, fp, p0 .. p5, narrow) of every row.

    text_key is a hash of the text, node one of the words, n is 0 without words, fp is the 64-bit print.
    """

    def run(batches):
        for batch in batches:
            ids, keys, nodes, counts, prints, sets, held = [], [], [], [], [], [], 0

            def packed():
                margin = tallies(sets)
                bits = np.packbits(margin > 0, axis=1, bitorder="little").view("<i8")
                narrow = np.argsort(np.abs(margin)[:, _WINDOW], axis=2, kind="stable")[:, :, :NARROW].astype(np.uint8)
                columns = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.array(nodes, "<u8").view("<i8")), pa.array(counts, pa.int32())]
                columns.append(pa.array(np.array(prints, "<u8").view("<i8")))
                columns += [pa.array(bits[:, i]) for i in range(LONGS)]
                columns.append(pa.array([row.tobytes() for row in narrow], pa.binary()))
                for done in (ids, keys, nodes, counts, prints, sets):
                    done.clear()
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n", "fp", *_P, "narrow"])

            for doc, text, key in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                hashes = grams(words)
                ids.append(doc.as_py())
                keys.append(key.as_py())
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED + 1))
                counts.append(len(hashes))
                prints.append(fingerprint(words))
                sets.append(hashes if len(hashes) else np.zeros(1, "<u8"))
                held += len(hashes)
                if len(ids) == _ROWS or held > _HASHES:
                    yield packed()
                    held = 0
            if ids:
                yield packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), text_key().alias("text_key"))
    schema = "doc_id long, text_key long, node long, n int, fp long, " + ", ".join(f"{p} long" for p in _P) + ", narrow binary"
    return rows.mapInArrow(run, schema)


def chain_keys(nodes: DataFrame) -> DataFrame:
    """(key, n, node, ahead): four rows for each start of a chain; ahead holds the eight segments after it."""

    def run(batches):
        turns = np.arange(STARTS) * STEP
        for whole in batches:
            for at in range(0, whole.num_rows, _NODES):
                batch = whole.slice(at, _NODES)
                rows = batch.num_rows
                ring = np.stack([batch.column(2 + i).to_numpy() for i in range(LONGS)], axis=1).astype("<i8").view(np.uint8)
                narrow = np.frombuffer(b"".join(batch.column(2 + LONGS).to_pylist()), np.uint8).reshape(rows, STARTS, NARROW)
                chain = np.zeros((rows, STARTS), np.int64)
                for i in range(CHAIN):
                    chain |= ring[:, (turns + i) % RING].astype(np.int64) << (8 * i)
                ahead = np.ascontiguousarray(ring[:, (turns[:, None] + CHAIN + np.arange(AHEAD)) % RING]).view("<i8")[:, :, 0]
                flips = np.int64(1) << narrow.astype(np.int64)
                variants = np.zeros((rows, STARTS, 1), np.int64)
                for i in range(NARROW):
                    variants = np.concatenate([variants, variants ^ flips[:, :, i : i + 1]], axis=2)
                keys = (np.arange(STARTS)[:, None] << (8 * CHAIN)) | (chain[:, :, None] ^ variants)
                per_row = STARTS << NARROW
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.reshape(-1).astype(np.int32)),
                        pa.array(np.repeat(batch.column(1).to_numpy(), per_row)),
                        pa.array(np.repeat(batch.column(0).to_numpy(), per_row)),
                        pa.array(np.repeat(ahead.reshape(-1), 1 << NARROW)),
                    ],
                    names=["key", "n", "node", "ahead"],
                )

    return nodes.select("node", "n", *_P, "narrow").mapInArrow(run, "key int, n int, node long, ahead long")


def within_budgets(x: np.ndarray, share: float = 1.0) -> np.ndarray:
    """Whether the differences ``x`` of the segments after a chain keep the proportional budgets half way and at their end."""
    per_segment = share * RADIUS / RING
    half = np.bitwise_count(x & np.uint64((1 << (4 * AHEAD)) - 1)) <= int((CHAIN + AHEAD // 2) * per_segment)
    return half & (np.bitwise_count(x) <= int((CHAIN + AHEAD) * per_segment))


def meets(x: np.ndarray, short: np.ndarray | bool, share: float = 1.0) -> np.ndarray:
    """``within_budgets``, or where ``x`` are differences of 64-bit prints (``short``), at most their radius."""
    return np.where(short, np.bitwise_count(x) <= int(share * FEW), within_budgets(x, share))


def forest(n: np.ndarray, ahead: np.ndarray, short: bool = False, levels: tuple = LEVELS) -> tuple[list, list]:
    """Fewer links than rows, within budgets, that join whatever links within each share of the budgets join: the closest first.

    A tree of one level goes on to the next as a whole. A row meets only rows not yet in its tree.
    """
    a, b = [], []
    tree = np.arange(len(n))
    for share in levels:
        order = np.argsort(tree, kind="stable")
        starts = np.searchsorted(tree[order], np.arange(len(n) + 1))
        left = np.arange(len(n))
        while len(left):
            first = tree[left[0]]
            queue = order[starts[first] : starts[first + 1]].tolist()
            mine, left = queue.copy(), left[tree[left] != first]
            while queue and len(left):
                i = queue.pop()
                low, high = np.minimum(n[left], n[i]), np.maximum(n[left], n[i])
                found = left[meets(ahead[left] ^ ahead[i], short, share) & (low >= SIMILARITY * high)]
                if not len(found):
                    continue
                joined, at = np.unique(tree[found], return_index=True)
                a += [int(i)] * len(at)
                b += found[at].tolist()
                gone = np.isin(tree[left], joined)
                queue += left[gone].tolist()
                mine += left[gone].tolist()
                left = left[~gone]
            tree[mine] = first
    return a, b


def spanning(bucket: np.ndarray, level: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (a, b) of each bucket join what all its pairs join, lowest level and earliest rows first; and which buckets give up pairs."""
    order = np.lexsort((b, a, level, bucket))
    _, at, times = np.unique(bucket, return_inverse=True, return_counts=True)
    keep, cut = np.ones(len(a), bool), np.zeros(len(times), bool)
    order = order[times[at[order]] > 2]  # two pairs close no circle
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for k, g, i, j in zip(order.tolist(), at[order].tolist(), a[order].tolist(), b[order].tolist()):
        i, j = top(i), top(j)
        if i == j:
            keep[k], cut[g] = False, True
        else:
            above[max(i, j)] = min(i, j)
    return keep, cut[at]


def most_alike(n: np.ndarray, parts: np.ndarray, i, other) -> np.ndarray:
    """Whether the shingles in common can be enough: in each part of the hash space at most the smaller count is."""
    shared = np.minimum(parts[i], parts[other]).sum(axis=-1, dtype=np.int64)
    # A count of 65535 may stand for more, which only texts of more shingles than that can have.
    return (shared >= SIMILARITY * (n[i] + n[other] - shared)) | (np.minimum(n[i], n[other]) >= 65535)


def ruled_in(n: np.ndarray, whole: tuple | None, short: np.ndarray | bool, i, other) -> np.ndarray:
    """Pairs that neither the radius nor the counts rule out; all, without ``whole``: prints and counts."""
    if whole is None or not np.size(other):
        return np.ones(np.shape(other), bool)
    prints, parts = whole
    near = np.bitwise_count(prints[i] ^ prints[other]).sum(axis=-1, dtype=np.int64) <= RADIUS
    ok = np.flatnonzero(near | short)
    pick = i[ok] if np.ndim(i) else i
    ok = ok[most_alike(n, parts, pick, other[ok])]
    out = np.zeros(len(other), bool)
    out[ok] = True
    return out


def closest(n: np.ndarray, ahead: np.ndarray, root: np.ndarray, most: int, short: bool = False, whole: tuple | None = None) -> tuple[list, list, list]:
    """Per row up to ``most`` later rows of other roots within budgets, the closest; and whether its list was cut. ``n`` ascends."""
    a, b, cut = [], [], []
    if (root == root[0]).all():
        return a, b, cut
    ends = np.searchsorted(n, n / SIMILARITY * (1 + 1e-9), side="right")
    for i, end in enumerate(ends):
        x = ahead[i + 1 : end] ^ ahead[i]
        hit = np.flatnonzero(meets(x, short) & (root[i + 1 : end] != root[i]))
        hit = hit[ruled_in(n, whole, short, i, hit + i + 1)]
        over = len(hit) > most
        if over:
            hit = hit[np.argsort(np.bitwise_count(x[hit]), kind="stable")[:most]]
        a += [i] * len(hit)
        b += (hit + i + 1).tolist()
        cut += [over] * len(hit)
    return a, b, cut


def bucket_pairs(group: np.ndarray, n: np.ndarray, node: np.ndarray, ahead: np.ndarray, root: np.ndarray, most: int = 0, whole: tuple | None = None) -> tuple:
    """Candidate pairs (a, b, open, short) in whole buckets: rows are sorted by group, then n. Open pairs come from a bucket that may hold
    others, short ones from a group with an odd number, where ``ahead`` is the 64-bit print.

    ``most`` is 0 for trees in buckets, or the length of the lists. ``whole`` holds prints and counts of the rows, if pairs are ruled out here.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    per_row = np.repeat(sizes, sizes)
    out_a, out_b, out_open, out_short = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
    short = (group & 1).astype(bool)
    rows, offset = np.flatnonzero((per_row > 1) & (per_row <= SMALL)), 1
    small = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(rows):
        rows = rows[rows + offset < len(group)]
        other = rows + offset
        alike = (group[other] == group[rows]) & (n[rows] >= SIMILARITY * n[other])
        rows, other = rows[alike], other[alike]  # n ascends: whoever is too far here stays so
        ok = meets(ahead[rows] ^ ahead[other], short[rows]) & (root[rows] != root[other])
        ok[ok] = ruled_in(n, whole, short[rows[ok]], rows[ok], other[ok])
        small.append((rows[ok], other[ok]))
        offset += 1
    rows, other = (np.concatenate(x) for x in zip(*small))
    keep, is_open = np.ones(len(rows), bool), np.zeros(len(rows), bool)
    if not most:
        x = ahead[rows] ^ ahead[other]
        level = sum(~meets(x, short[rows], share) for share in LEVELS[:-1])
        keep, is_open = spanning(group[rows], level, rows, other)
    out_a.append(node[rows[keep]])
    out_b.append(node[other[keep]])
    out_open.append(is_open[keep])
    out_short.append(short[rows[keep]])
    for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        mine = slice(s, s + size)
        if most:
            a, b, is_open = closest(n[mine], ahead[mine], root[mine], most, short[s], whole and tuple(x[mine] for x in whole))
        else:
            a, b = forest(n[mine], ahead[mine], short[s])
            is_open = [True] * len(a)
        out_a.append(node[mine][np.array(a, np.int64)])
        out_b.append(node[mine][np.array(b, np.int64)])
        out_open.append(np.array(is_open, bool))
        out_short.append(np.full(len(a), short[s]))
    a, b, marks = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_open) + 2 * np.concatenate(out_short)
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b), marks], axis=1)[a != b]
    pairs = np.unique(pairs, axis=0)
    return pairs[:, 0], pairs[:, 1], (pairs[:, 2] & 1).astype(bool), (pairs[:, 2] & 2).astype(bool)


def candidate_pairs(keys: DataFrame, hot: int = HOT, most: int = 0) -> DataFrame:
    """(a, b, open, short): candidates of all buckets of ``keys`` (key, n, node, ahead, root), each pair once. Odd keys hold 64-bit prints.

    With ``most``, rows also have ``print`` and ``counts``, by which pairs are ruled out.
    """
    # One node in sixteen tells which buckets are crowded; it decides how they are cut, not what is found.
    sampled = keys.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).groupBy("key").count()
    limit = max(1, hot // COUNTED // 2)
    crowded = sampled.where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("long").alias("parts"))
    crowded = materialize(crowded, "copies-crowded")
    tile = F.lit(0).cast("long")
    if not crowded.isEmpty():
        part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
        tiles = F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(part, j) * F.col("parts") + F.greatest(part, j)
        )
        keys = keys.join(crowded, "key", "left").withColumn(
            "tile", F.explode(F.when(F.col("parts").isNull(), F.array(tile)).otherwise(tiles))
        )
        tile = F.col("tile")
    # Buckets whose hashes agree meet as one: that adds candidates and loses none.
    odd = F.col("key").bitwiseAND(F.lit(1))
    group = F.shiftleft(F.xxhash64("key", tile), 1).bitwiseOR(odd)
    rows = keys.select(group.alias("group"), "n", "node", "ahead", "root", *(["print", "counts"] if most else []))

    def pairs_of(block):
        return bucket_pairs(*block[:5], most, block[5:] or None)

    def run(batches):
        held = None
        for batch in batches:
            block = (
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy(),
                batch.column(2).to_numpy(),
                batch.column(3).to_numpy().view("<u8"),
                batch.column(4).to_numpy(),
                *(_matrix(batch.column(5 + i), kind) for i, kind in enumerate(("<u8", "<u2") if most else ())),
            )
            if held is not None:
                block = tuple(np.concatenate(x) for x in zip(held, block))
            if not len(block[0]):
                continue
            cut = int(np.searchsorted(block[0], block[0][-1]))  # the last bucket may go on in the next batch
            held = tuple(x[cut:] for x in block)
            if cut:
                yield _pair_batch(*pairs_of(tuple(x[:cut] for x in block)))
        if held is not None and len(held[0]):
            yield _pair_batch(*pairs_of(held))

    by_group = rows.repartition("group").sortWithinPartitions("group", "n", "node")
    return by_group.mapInArrow(run, "a long, b long, open boolean, short boolean").groupBy("a", "b").agg(
        F.max("open").alias("open"), F.max("short").alias("short")
    )


def _pair_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "open", "short"])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def part_counts(sets: DataFrame) -> DataFrame:
    """(node, counts): how many of the shingles of each row of ``sets`` (node, grams) lie in each part of the hash space."""

    def run(batches):
        for batch in batches:
            counts = [np.bincount(row.values.to_numpy().view("<u8") % np.uint64(PARTS), minlength=PARTS) for row in batch.column(1)]
            packed = [np.minimum(x, 65535).astype("<u2").tobytes() for x in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "counts"])

    return sets.select("node", "grams").mapInArrow(run, "node long, counts binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, grams) of every row with words."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                if words:
                    node = xxhash.xxh64_intdigest(b" ".join(words), SEED + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array([node], "<u8").view("<i8")), pa.array([grams(words).view("<i8")], pa.list_(pa.int64()))],
                        names=["node", "grams"],
                    )

    return docs.select(text_bytes()).mapInArrow(run, "node long, grams array<long>")


def _print_bytes() -> Column:
    """The wide print of a row as bytes; their order is the same in every row, which is all that counting bits needs."""
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in _P]))


def closest_links(near: DataFrame) -> DataFrame:
    """Of the pairs ``near`` the one with the fewest differing bits for each of its nodes."""
    rest = [c for c in near.columns if c not in "ab"]
    each = [near.groupBy(s).agg(F.min_by(F.struct(o, *rest), F.struct("apart", o)).alias("best")).select(s, "best.*") for s, o in ("ab", "ba")]
    return each[0].unionByName(each[1]).distinct()


def with_roots(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` with the smallest nodes ra and rb that ``links`` (each node, its smallest node) join theirs to."""
    for s in "ab":
        pairs = pairs.join(links.toDF(s, f"r{s}"), s, "left").withColumn(f"r{s}", F.coalesce(f"r{s}", s))
    return pairs


def joined(links: DataFrame | None, found: DataFrame) -> DataFrame:
    """(a, b): each node and the smallest node that ``links`` and ``found`` join it to, if that is another."""
    every = found if links is None else links.unionByName(found)
    return materialize(connected(every).toDF("a", "b"), "copies-rounds")


def similar_links(docs: DataFrame, prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): each node of ``prints``, the wide prints of ``docs``, and the smallest node that verified links join it to, if that is another.

    They join what all pairs within budgets and the radius, or within 3 bits of the 64-bit prints, that are 0.8 or more alike join.
    """
    nodes = prints.where("doc_id IS NOT NULL AND n > 0").drop("doc_id").dropDuplicates(["node"])
    nodes = materialize(nodes, "copies-nodes")
    # Texts within 3 bits of each other are in one 64-bit component: these are buckets in which all such pairs meet.
    rings = materialize(connected(ring_links(materialize(nodes.select("fp").distinct(), "copies-fps"))), "copies-rings")
    rings = nodes.select("node", "fp").join(rings.withColumnRenamed("node", "fp"), "fp", "left")
    ring = F.shiftleft(F.coalesce("root", "fp"), 1).bitwiseOR(F.lit(1))
    rings = materialize(rings.select("node", ring.alias("ring")), "copies-rings")
    sides = {s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), *[F.col(p).alias(p + s) for p in _P]) for s in "ab"}
    apart = sum((F.bit_count(F.col(p + "a").bitwiseXOR(F.col(p + "b"))) for p in _P), F.lit(0))
    checked = links = sets = None

    def gather(wanted: DataFrame) -> None:
        """Read the shingles of nodes whose shingles are not yet read."""
        nonlocal sets
        if sets is not None:
            wanted = wanted.join(sets, "node", "left_anti")
        wanted = materialize(wanted, "copies-wanted")
        ids = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        ids = materialize(ids.select("doc_id").distinct(), "copies-ids")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
        new = shingle_sets(texts).join(wanted, "node", "left_semi").dropDuplicates(["node"])
        new = materialize(new, "copies-sets")
        sets = new if sets is None else sets.unionByName(new)

    def within_radius(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sides["a"], "a").join(sides["b"], "b").withColumn("apart", apart).where(F.col("short") | (F.col("apart") <= RADIUS))
        return materialize(near.select("a", "b", "open", "short", "na", "nb", "apart"), "copies-near")

    def verified(near: DataFrame) -> DataFrame:
        gather(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = near.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
        shared = F.size(F.array_intersect("ga", "gb"))
        return materialize(both.where(shared >= SIMILARITY * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "copies-found")

    active, most = nodes.withColumn("root", F.col("node")), 0
    while True:
        keys = chain_keys(active).withColumn("key", F.col("key").cast("long") * 2)
        keys = keys.unionByName(active.join(rings, "node").select(F.col("ring").alias("key"), "n", "node", F.col("fp").alias("ahead")))
        if most:
            keys = keys.join(active.select("node", "root", _print_bytes().alias("print"), "counts"), "node")
        else:
            keys = keys.withColumn("root", F.col("node"))
        pairs = candidate_pairs(keys, hot, most)
        if checked is not None:
            pairs = pairs.join(checked.withColumn("known", F.lit(True)), ["a", "b", "short"], "left")
        else:
            pairs = pairs.withColumn("known", F.lit(False))
        pairs = materialize(pairs.select("a", "b", "open", "short", F.coalesce("known", F.lit(False)).alias("known")), "copies-candidates")
        near = within_radius(pairs.where("NOT known"))
        if not most:
            # Of the links of larger trees only the closest of each row: what the others may join meets again in the lists, unless ruled out there.
            near = materialize(near.where("NOT open").unionByName(closest_links(near.where("open"))), "copies-first")
        new = near.select("a", "b", "short")
        checked = new if checked is None else checked.unionByName(new)
        links = joined(links, verified(near))
        doubtful = pairs.where("open").select("a", "b")
        if doubtful.isEmpty():
            return links
        roots = links.toDF("node", "root")
        if not most:
            # A pair that no tree lists is within one component, or its two components each have a link of that tree that joins nothing yet.
            doubtful = with_roots(links, doubtful).where("ra <> rb").select(F.explode(F.array("ra", "rb")).alias("root")).distinct()
            doubtful = materialize(doubtful, "copies-doubtful")
            if doubtful.isEmpty():
                return links
            active = active.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            active = materialize(active.join(doubtful, "root", "left_semi"), "copies-active")
            gather(active.select("node"))
            active = active.join(part_counts(sets.join(active.select("node"), "node", "left_semi")), "node")
        else:
            active = active.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        active = materialize(active, "copies-active")
        most = most * MORE or LISTED


def _rooted(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, root, component_id) of every row."""
    prints = materialize(wide_prints(docs), "copies-prints")
    roots = similar_links(docs, prints, hot).toDF("node", "root")
    rooted = prints.groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left")
    rooted = materialize(rooted.select("node", "first", F.coalesce("root", "node").alias("root")), "copies-rooted")
    merged = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "copies-merged")
    groups = rooted.join(merged, "root").select("node", "root", "component_id")
    return prints.select("doc_id", "text_key", "node").join(groups, "node").select("doc_id", "text_key", "root", "component_id")


def near_copy_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, component_id of every row: equal words, joined by links of 0.8 and more.

    NULL and empty texts are one group. Rows with a NULL id join the group of their words, whose id is the smallest that is not NULL.
    Repeated rows are rows of their own. An empty table gives an empty result. Other columns are ignored.
    """
    return _rooted(docs, hot).select("doc_id", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near copies, one per group.

    An id that several texts share counts once for each text: the texts stay or go by their own groups. In a group whose smallest id has several
    texts, that of the smallest hash stays. Of rows that repeat id and text one stays, the same on every run. Rows with a NULL id cannot be told
    apart and stay. Other columns pass through, whatever their names.
    """
    groups = materialize(_rooted(docs, **options), "copies-final")
    keyed = groups.where("doc_id IS NOT NULL").groupBy("doc_id", "text_key", "root", "component_id").agg(F.count(F.lit(1)).alias("times"))
    keyed = materialize(keyed, "copies-keyed")
    firsts = keyed.where("doc_id = component_id").groupBy("root").agg(F.min("text_key").alias("kept"))
    judged = keyed.join(firsts, "root").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("kept")))
    judged = materialize(judged.select("doc_id", "text_key", "stays", "times"), "copies-judged")
    # Plain names, so that no column of the input can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.struct(*docs.columns).alias("row"))
    kept = plain.join(judged.where("NOT stays").select("doc_id", "text_key"), ["doc_id", "text_key"], "left_anti")
    twice = judged.where("stays AND times > 1").select("doc_id", "text_key")
    if not twice.isEmpty():
        once = kept.join(twice, ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(twice, ["doc_id", "text_key"], "left_anti").unionByName(once)
    return kept.select(*[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, names)]).toDF(*docs.columns)
