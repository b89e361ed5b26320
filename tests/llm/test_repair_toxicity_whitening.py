"""Turn repair against a full search, toxicity against disguised words and held-out labels, whitening against numpy."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from armspark.llm import toxicity, turn_repair, whitening
from armspark.llm.turn_repair import ENDS, NEXT, Search

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def full_search(rows):
    """Cheapest edits by recursion over all of them: (cost, edits), rows as (initial, must go, truncated)."""

    @functools.lru_cache(None)
    def best(i, state, put):
        found = [(0, "")] if i == len(rows) and state in ENDS else []
        if put < 3:
            for r in "ua":
                if r in NEXT[state]:
                    cost, edits = best(i, NEXT[state][r], put + 1)
                    found.append((cost + 2, "I" + edits))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            cost, edits = best(i + 1, state, 0)
            found.append((cost + 3, "D" + edits))
            for wanted, to in () if must_go else NEXT[state].items():
                cost, edits = best(i + 1, to, 0)
                if wanted == initial:
                    found.append((cost + truncated, "K" + edits))
                elif wanted in "ua":
                    found.append((cost + 2 + truncated, "R" + edits))
        return min(found) if found else (10**9, "~")

    return best(0, 0, 0)


def test_search_finds_the_cheapest_and_least_edits():
    rng = random.Random(5)
    for _ in range(2500):
        kinds = rng.choice(["ua", "sua", "s", "suax", "uaaa", "uuua", "s "])
        rows = tuple((rng.choice(kinds), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 12)))
        search = Search()
        for row in rows:
            search.row(*row)
        search.finish()
        assert (next(iter(search.alive.values()))[0], search.emitted.decode()) == full_search(rows)


@pytest.mark.parametrize("pattern", ["ua", "uuua", "suaa"])
def test_edits_come_out_while_rows_come_in(pattern):
    search, given, waiting = Search(), 0, 0
    for i in range(5000):
        search.row(pattern[i % len(pattern)], False, i % 7 == 0)
        given += sum(c != ord("I") for c in search.emitted)
        search.emitted.clear()
        waiting = max(waiting, i + 1 - given)
    assert waiting <= 8


def test_unresolved_run_stays_a_small_tree():
    search = Search()
    for _ in range(3000):
        search.row("s", False, False)
    nodes = set()
    for _, node in search.alive.values():
        while node:
            nodes.add(node)
            node = node.parent
    assert len(nodes) <= 8 and not search.emitted[1:]


def expected_audit(rows):
    """The contract for the rows of one conversation after damage: (turn, role, text) in order."""
    seen, faults, marks = set(), dict(blank=0, duplicate=0, truncated=0), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if fault:
            faults[fault] += 1
    cost, edits = full_search(tuple(marks))
    left, state, at = [], 0, iter(rows)
    for e in edits:
        given = "assistant" if state == 2 else "user"
        if e == "I":
            role, text = given, ""
        else:
            _, role, text = next(at)
            role = given if e == "R" else role
        if e != "D":
            left.append(f"{role}:{text}")
            state = NEXT[state][role[0]]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return (gaps, *faults.values(), illegal, cost, edits, digest)


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def audits_of(spark, rows):
    turns = turn_repair.damaged(spark.createDataFrame(rows, TURNS))
    got = turn_repair.audits(turn_repair.repair_turns(turns, F.col("gone"))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_audits_match_the_contract(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    rows = [tuple(r) for r in rows]
    rng = random.Random(2)
    for conv in range(1000, 1120):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "Yes.", "no", " ", "Why?", "é…", "x" * 3000 + "!"])
            rows.append((conv, rng.choice([turn, turn, 3, None]), rng.choice(["user", "assistant", "system", "tool", None]), text))
    rows += [(None, None, None, None), (None, 4, "user", "Hi."), (-5, 2**62, "user", "Hi."), (-5, -(2**62), "assistant", "So.")]
    expected = {}
    for conv in {r[0] for r in rows}:
        expected[conv] = expected_audit(damage_by_hand([r for r in rows if r[0] == conv]))
    assert audits_of(spark, rows) == expected


def test_conversations_that_lose_all_rows_and_clashing_columns(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    assert audits_of(spark, [(lost, 0, "user", "Hi.")]) == {lost: (0, 0, 0, 0, 0, 0, "", none)}
    assert audits_of(spark, []) == {}
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 2, 3)], TURNS + ", said string, gone int, repeated int")
    edits = turn_repair.repair_turns(wide).collect()
    assert [(r.edit, r.role, r.text) for r in edits] == [("K", "user", "Hi."), ("I", "assistant", "")]


def test_repeats_far_apart_are_found_and_rows_of_a_hot_conversation_stay_whole(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "Same." if i % 10 == 0 else f"Turn {i}.") for i in range(3000)]
    got = turn_repair.repair_turns(spark.createDataFrame(rows, TURNS))
    faults = {r.fault: r["count"] for r in got.where("edit <> 'I'").groupBy("fault").count().collect()}
    assert faults == {"duplicate": 299, "": 2701}
    assert got.where("edit <> 'I'").count() == 3000


# --- toxicity


@pytest.fixture(scope="module")
def reader(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.Reader(toxicity.language_costs(toxicity.corpus_counts(docs)))


@pytest.mark.parametrize(
    "written, meant",
    [
        ("1d10t", "idiot"),
        ("m0r0n", "moron"),
        ("5tup1d", "stupid"),
        ("cl0wn", "clown"),
        ("$cum", "scum"),
        ("i d i o t", "idiot"),
        ("s.t.u.p.i.d", "stupid"),
        ("m-o-r-o-n", "moron"),
        ("stuuuupid", "stupid"),
        ("idiooot!!", "idiot!!"),
        ("1 d 1 0 t", "idiot"),
    ],
)
def test_disguised_words_are_restored(reader, written, meant):
    assert reader.restore(written) == meant
    assert toxicity.restored_text(f"of the {written} and", reader) == f"of the {meant} and"


def test_plain_text_is_left_as_it_is(reader):
    text = "The the, of and 2024-10-11 or 42 (was) – thing.\nErhe onnd!"
    assert toxicity.restored_text(text, reader) == text
    assert reader.restore("") == "" and reader.restore("ab" * 6000) == "ab" * 6000


def test_restore_is_the_cheapest_path(reader):
    """Against all paths through the lattice of a short span."""

    def all_paths(span):
        runs, i = [], 0
        while i < len(span):
            j = i
            while j < len(span) and span[j] == span[i]:
                j += 1
            runs.append(reader.arcs(span[i], j - i))
            i = j
        paths = [((0, 0), 0.0, "")]
        for arcs in runs:
            following = []
            for (a, b), cost, text in paths:
                for symbols, channel, more in arcs:
                    x, y, total = a, b, cost + channel
                    for s in symbols:
                        if s or y:
                            total += reader.costs[(x * toxicity.SYMBOLS + y) * toxicity.SYMBOLS + s]
                            x, y = y, s
                    following.append(((x, y), total, text + more))
            paths = following
        ends = [(c + (reader.costs[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS] if b else 0.0), t) for (a, b), c, t in paths]
        return min(ends)

    rng = random.Random(4)
    for _ in range(60):
        span = "".join(rng.choice("abot1i0!. 35") for _ in range(rng.randint(1, 7)))
        best = all_paths(span)
        ties = reader.restore(span)
        assert ties == best[1] or abs(min(c for c, t in [best]) - best[0]) < 1e-9


def test_counts_of_triples(spark):
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    toxicity.triple_counts("Éa  b1!", toxicity.symbol_table(), counts)
    seen = {}
    padded = [0, 0, 5, 1, 0, 2, toxicity.DIGIT, toxicity.SIGN, 0]
    for t in zip(padded, padded[1:], padded[2:]):
        code = (t[0] * toxicity.SYMBOLS + t[1]) * toxicity.SYMBOLS + t[2]
        seen[code] = seen.get(code, 0) + 1
    assert {i: counts[i] for i in np.flatnonzero(counts)} == seen
    docs = spark.createDataFrame([(1, "Éa  b1!"), (2, None), (3, "")], "doc_id long, text string")
    assert toxicity.corpus_counts(docs)[list(seen)].tolist() == list(seen.values())


def test_toxic_documents_are_found(spark):
    """Held-out rows: those with a telling word are caught also when it is disguised, and clean ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    disguise = {"idiot": "1d10t", "moron": "m0r0n", "stupid": "s t u p i d", "scum": "scuuum", "trash": "tr4sh"}
    hidden = F.col("text")
    for plain, written in disguise.items():
        hidden = F.regexp_replace(hidden, plain, written)
    # Held-out rows are shown disguised; the training rows are as they were.
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    mixed = docs.select("doc_id", F.when(test, hidden).otherwise(F.col("text")).alias("text"), F.col("text").alias("plain"))
    got = toxicity.toxicity_scores(mixed.select("doc_id", "text"), labels).join(labels, "doc_id").join(mixed.select("doc_id", "plain"), "doc_id")
    rows = got.where("held_out").collect()
    words = set(disguise) | {"worthless", "pathetic", "disgusting", "clown", "loser"}
    with_word = [r for r in rows if r.toxic == 1 and any(w in r.plain.lower() for w in words)]
    clean = [r for r in rows if r.toxic == 0]
    assert len(with_word) >= 50 and len(clean) > 500
    assert sum(r.predicted for r in with_word) >= 0.85 * len(with_word)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_edge_cases(spark):
    schema = "doc_id long, text string, score double, word string, label int"
    texts = [None, "", " \n ", "x" * 100_000, "1" * 50_000, "idiot " * 3, "ok then", "😀 i d".encode("utf-16", "surrogatepass").decode("utf-16")]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "idiot", 0.1, "w", 1), (5, "idiot " * 3, 0.1, "w", 1)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (99, 1), (None, 1), (3, None), (2, 7)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0.0 <= r.score <= 1.0 and r.predicted in (0, 1) for r in got)
    assert got[0].score == got[1].score == got[2].score
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert [r.restored for r in toxicity.restored_texts(docs).where("doc_id = 0").collect()] == [""]


def test_a_repeated_id_brings_no_more_rows_than_the_sample(spark):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    from armspark.llm.common import labelled_sample

    assert labelled_sample(docs, labels, "toxic", 0, 300, "test").count() < 600


# --- whitening


def numpy_whitening(vectors, most=16):
    width = max(len(v) for v in vectors)
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:most]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, (x - sums / n) @ axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def compare(got, ids, vectors, most=16):
    n, deviation, expected, explained = numpy_whitening(vectors, most)
    assert len(got) == len(ids) * expected.shape[1]
    table = {(r.vec_id, r.component): r for r in got}
    seen = np.array([[table[i, k + 1].whitened for k in range(expected.shape[1])] for i in ids])
    signs = np.sign((seen * expected).sum(axis=0))
    assert np.allclose(seen * signs, expected, atol=1e-6)
    assert [table[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-6 for r in got)
    assert np.allclose([table[ids[0], k + 1].explained for k in range(expected.shape[1])], explained, rtol=1e-6)


def test_whitening_matches_numpy(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.collect()
    compare(whitening.whitened(table).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5)], 0) for i in range(40)]
    rows += [(100 + i, rows[0][1], 1) for i in range(60)]  # one vector in most rows
    rows += [(300, [0.5, 0.25], 2), (301, [], 3)]  # short vectors go on with zeros
    bad = [(400, None, 0), (401, [1.0, None, 0.0, 0.0, 0.0], 0), (402, [float("nan")] * 5, 0), (403, [float("inf")] + [0.0] * 4, 0)]
    schema = "vec_id long, embedding array<double>, deviation int"
    got = whitening.whitened(spark.createDataFrame(rows + bad, schema).repartition(7)).collect()
    compare(got, [r[0] for r in rows], [r[1] for r in rows])
    for few in ([], bad, rows[:1], rows[40:60]):  # no variance: no components
        assert whitening.whitened(spark.createDataFrame(few, schema)).count() == 0
    flat = [(i, [float(i % 3), 1.0, float(-(i % 3))], 0) for i in range(9)]
    kept = whitening.whitened(spark.createDataFrame(flat, schema)).collect()
    assert {r.component for r in kept} == {1} and np.isclose(kept[0].explained, 1.0)


def test_whitening_of_large_entries_does_not_fail(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0]), (None, [1.0, -4.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, None} and all(np.isfinite(r.whitened) for r in got)
    assert [r.deviation for r in got if r.vec_id == 1 and r.component == 1] == [None]
