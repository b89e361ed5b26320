"""The text operators against brute force on small tables, with NULLs, empty texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from armspark.llm import chat, decontaminate, html_extract, lattice, lattice_lm, mixing, near_copies, quality, secrets, simhash, surrogates, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, word string, taken int, c0 int"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t or ""), "x", "y", 1, 2) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
LONG = " ".join(f"w{i}" for i in range(30_000))
MIXED = [
    (1, "the cat sat on the mat", "a"),
    (1, "the cat sat on the mat", "a"),
    (2, "", "a"),
    (3, None, None),
    (None, "no id here", "b"),
    (4, LONG, "b"),
    (5, "été \U0001f600 " + SECRET + " password: short AKIA" + "A" * 16, "c"),
    (6, SECRET, "d"),
    (7, "mail bob@mail.com and bob@mail.com or 10.1.2.3", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, MIXED)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- lattice scoring ----------------------------------------------------------------------------


def test_marginal_sums_all_segmentations():
    weight = {p: math.log(w) for p, w in {"▁": 0.1, "▁a": 0.2, "a": 0.2, "b": 0.1, "ab": 0.15, "ba": 0.25}.items()}
    weight |= {p: math.log(1e-3) for p in lattice.BYTE_PIECES}
    index = lattice.lattice_index(weight)
    for word in ("a", "ab", "abba", "baab", "aéb"):
        string, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(string) - 1):
            parts, at = [], 0
            for i, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(string[at:i])
                    at = i
            parts.append(string[at:])
            value = 1.0
            for part in parts:
                if part in weight:
                    value *= math.exp(weight[part])
                elif len(part) == 1:
                    value *= math.prod(1e-3 for _ in part.encode())
                else:
                    value = 0.0
            total += value
        assert lattice.log_marginal(word, index) == pytest.approx(math.log(total))
        expected = {}
        assert lattice.expected_counts(word, 1.0, index, expected) == pytest.approx(math.log(total))
        assert sum(n * (1 if p.startswith("<") else len(p)) for p, n in expected.items()) >= len(string) - 1e-9


def test_lattice_scores(spark, docs, none):
    for head in (2, 50_000):
        rows = lattice_lm.lattice_scores(docs, PIECES, head=head).collect()
        train = Counter()
        ends = 0
        for i, t, _ in MIXED:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
                train.update((t or "").encode().lower().split())
                ends += 1
        n, v = sum(train.values()) + ends, len(train) + 1
        want = []
        for i, t, _ in MIXED:
            words = (t or "").encode().lower().split()
            base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
            want.append((i, len(words) + 1, sum(w in train for w in words) + 1, base + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))))
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows), key=str)
        assert got == sorted(((*w[:3], round(w[3], 6)) for w in want), key=str)
        assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lattice_lm.lattice_scores(none, PIECES).count() == 0


# --- decontamination ----------------------------------------------------------------------------


def test_block_max_wand_is_exact():
    rng = np.random.default_rng(5)
    segments = {}
    for s in range(300):
        terms = rng.choice(60, rng.integers(1, 9), replace=False)
        weight = rng.random(len(terms))
        segments[s] = dict(zip(terms.tolist(), (weight / weight.sum()).tolist()))
    index = decontaminate.BlockMaxIndex(segments, 60)
    for _ in range(200):
        asked = sorted(rng.choice(60, rng.integers(1, 20), replace=False).tolist())
        for limit in (0.3, 0.7, 1.0):
            want = {s for s, w in segments.items() if sum(w.get(t, 0) for t in asked) >= limit - 1e-9}
            assert {index.segments[p] for p, _ in index.search(asked, limit)} == want


def test_leaks(spark, none):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "of"] * 40
    item = "What is " + " ".join(rng.choice(vocabulary, 40)) + "? " + " ".join(rng.choice(vocabulary, 12)) + "."
    near = item.split()
    near[10], near[30] = "changed", "other"
    fill = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, fill(150), "s") for i in range(30)]
    rows += [(100, fill(90) + " " + item.upper() + " " + fill(70), "s"), (101, " ".join(near), "s"), (102, fill(20) + " " + " ".join(near[:12]), "s")]
    rows += [(103, None, "s"), (104, "", "s"), (None, item, "s")]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (None, fill(20)), (3, "")], "item_id long, text string")
    docs = table(spark, rows)
    for size in (1_000_000, 30):
        found = decontaminate.find_leaks(docs, items, shard_words=size).collect()
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == [(100, 1), (101, 1), (None, 1)]
    kept = decontaminate.drop_leaking(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_leaking(docs, items.limit(0)).count() == len(rows)


def test_leaks_do_not_depend_on_the_passages_bounded_at_a_time(monkeypatch):
    """A long text is bounded block by block; a term is looked up once per written word of a text."""
    words = [f"w{i}" for i in range(30)]
    rows = [Row(key=1, n=0, term=w, tf=1, length=30) for w in words]
    shard = decontaminate.Shard(rows, {}, 10, 30.0, {1: " ".join(words)})
    text = " ".join(["other"] * 1000 + words + ["other"] * 500 + words)
    found = shard.leaks(text, decontaminate.TermIds(shard.terms))
    monkeypatch.setattr(decontaminate, "_PASSAGES", 3)
    codes = decontaminate.TermIds(shard.terms)
    assert [f[0] for f in found] == [1] and shard.leaks(text, codes) == found
    assert sorted(codes.of(set(text.split()))) == list(range(31)) and codes.of(["w1,", "..."]) == [codes["w1"], -1]


# --- top-k --------------------------------------------------------------------------------------


@pytest.mark.parametrize("block,sample", [(4096, 2048), (3, 8)])
def test_topk_is_exact(spark, block, sample):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(600)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)]  # a third are copies
    bad = [(5000, None), (5050, [float("nan")] * 8), (5100, [None] * 8), (None, [1.0] * 8), (5150, []), (5200, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + vectors[:2] + bad], "vec_id long, embedding array<double>, pivot int, score int")
    got = topk.nearest_rows(df, F.col("vec_id") % 50 == 0, query_block=block, sample=sample).collect()
    x = np.floor(256 * np.array([v for _, v in vectors])).astype(np.int64)
    ids = np.array([i for i, _ in vectors])
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -(10**15)
        want |= {(int(ids[q]), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(np.lexsort((ids, -score))[:5])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert topk.nearest_rows(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- secrets ------------------------------------------------------------------------------------


def test_secrets(spark, docs, none):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_spans(docs).collect())
    want = Counter()
    for i, t, _ in MIXED:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(s[3] for s in spans)
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        want[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line.encode()).hexdigest()] += 1
    assert got == want and secrets.secret_spans(none).count() == 0


def test_ownership_classes(spark):
    rows = [(i, "key AbC123xyzAbC123xyzAbC123 end", f"s{i % 5}") for i in range(40)] + [(99, "run Zz9Zz8Zz7Zz6Zz5Zz4Zz3Zz2 end", "s0")]
    out = {r.doc_id: r for r in secrets.secret_spans(table(spark, rows)).collect()}
    assert all(out[i].n_copied == 1 and out[i].spans == "" for i in range(40))
    assert out[99].n_live == 1 and out[99].spans == "generic:4:28"


# --- surrogates ---------------------------------------------------------------------------------


def test_surrogates(spark, docs, none):
    text = "Mr. John Smith called +1 (017) 555-7713 from 10.1.2.3, card 4539 1488 0343 6467. Smith: a.b@c.org! Frau Anna SMITH."
    rows = MIXED + [(50, text, "z"), (51, "Again a.b@c.org and (017) 555-7713 99", "z")]
    out = surrogates.replace_entities(table(spark, rows))
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].text == "the cat sat on the mat" and by_id[3].text is None and by_id[4].text == LONG
    new = by_id[50].text
    for gone in ("John", "Smith", "SMITH", "555-7713", "10.1.2.3", "4539 1488", "a.b@c.org"):
        assert gone not in new
    found = {k: new[s:e] for s, e, k, _ in surrogates.detect(new)}
    assert found["card"] and surrogates.luhn_ok(re.sub(r"\D", "", found["card"]))
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", new) and re.search(r"[a-z]\.[a-z]@[a-z]\.example", new)
    family = re.search(r"Mr\. (\w+) (\w+)", new)[2]
    assert new.count(family) == 2 and family.upper() in new  # one family throughout
    mail = re.search(r"\S+@\S+\.example", new)[0]
    assert mail in by_id[51].text
    assert by_id[7].text.count(re.search(r"\S+@\S+\.example", by_id[7].text)[0]) == 2
    assert surrogates.replace_entities(none).count() == 0


def test_surrogate_collisions_are_drawn_again(spark):
    rows = [("ip", f"n{i}") for i in range(40)]
    crowded = lambda kind, norm, attempt, key: f"n{zlib.crc32(f'{norm}{attempt}'.encode()) % 120}"
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, norm string"), first=crowded).collect()
    values = [r.surrogate for r in got]
    assert len(values) == 40 == len(set(values)) and not set(values) & {n for _, n in rows}


# --- mixing -------------------------------------------------------------------------------------


def test_mixture_against_sql(spark, docs, none):
    import duckdb

    rng = np.random.default_rng(4)
    rows = MIXED + [(100 + i, " ".join(["w"] * int(rng.integers(0, 60))), "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    documents = table(spark, rows).toArrow()  # noqa: F841
    want = {str(r) for r in duckdb.sql(mixing.ORACLE).select("doc_id, size, source_size, target, taken").fetchall()}
    for buckets, bins in ((3, 1 << 16), (1, 4)):
        got = mixing.mixture(table(spark, rows), buckets=buckets, bins=bins).collect()
        assert len(got) == len(rows)
        assert {str(tuple(r)) for r in got} == want
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= 30_000 for (_, t), n in taken.items())
    assert mixing.mixture(none).count() == 0
    mixed = mixing.mixed_documents(table(spark, rows))
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.where("mix_taken = 0 AND n_chars > 0").count() == 0


# --- quality ------------------------------------------------------------------------------------


def test_quality(spark, docs, none):
    rng = np.random.default_rng(6)
    good = [f"good{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good, 40)) if i % 2 else " ".join(rng.choice(good, 40)).upper() + " !!", "s") for i in range(300)]
    marks = labels(spark, [(i, i % 2, 0) for i in range(250)] + [(1, None, 0), (None, 1, 0), (9999, 0, 0)])
    out = quality.quality_scores(table(spark, rows + MIXED), marks).collect()
    assert len(out) == 300 + len(MIXED) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    unseen = [r for r in out if r.doc_id is not None and r.doc_id >= 50 and r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in unseen if r.doc_id < 300]) > 0.95
    assert quality.quality_scores(none, marks).count() == 0
    assert {r.score for r in quality.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(table(spark, rows), marks)
    assert kept.columns == docs.columns and kept.where("doc_id % 2 = 0").count() < 10 < 140 < kept.where("doc_id % 2 = 1").count()


# --- SimHash ------------------------------------------------------------------------------------


def components(prints, radius=3):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("hot", [8192, 1])
def test_ring_links_connect_all_pairs(spark, hot):
    rng = np.random.default_rng(8)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    prints = {0}
    for s in seeds:
        for _ in range(8):
            prints.add(s ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)))
    for _ in range(60):  # a crowd around one print
        prints.add(seeds[0] ^ (1 << int(rng.integers(64))))
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    links = simhash.ring_links(spark.createDataFrame(signed, "fp long"), hot=hot).collect()
    mask = (1 << 64) - 1
    assert all(((r.a & mask) ^ (r.b & mask)).bit_count() <= 64 for r in links)
    want = components(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        a, b = find(r.a & mask), find(r.b & mask)
        assert want[r.a & mask] == want[r.b & mask]
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == want


def test_near_duplicates(spark, docs, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints, first = {}, {}
    for n, (i, t, _) in enumerate(MIXED):
        w = (t or "").encode().lower().split()
        runs = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        bits = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in runs) for b in range(64)] if len(runs) < 99 else None
        prints[n] = sum(1 << b for b in range(64) if 2 * bits[b] > len(runs)) if bits else simhash.fingerprint(w)
    root = components(set(prints.values()))
    for n, (i, *_) in enumerate(MIXED):
        if i is not None:
            first[root[prints[n]]] = min(i, first.get(root[prints[n]], i))
    assert got == Counter((i, f"{prints[n]:016x}", first.get(root[prints[n]])) for n, (i, *_) in enumerate(MIXED))
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "6", "7", "None"]
    assert simhash.near_duplicates(none).count() == 0 and near_copies.keep_first(none).count() == 0


def test_tallies():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n).astype("<u8") for n in (1, 255, 256, 700)]
    for hashes, got in zip(sets, near_copies.tallies(sets)):
        for bit in (0, 63, 64, 200, 383):
            ones = int((near_copies._mixed(hashes, bit // 64 + 1) >> np.uint64(bit % 64) & np.uint64(1)).sum())
            assert got[bit] == 2 * ones - len(hashes)


@pytest.mark.parametrize("hot", [near_copies.HOT, 32])
def test_near_copies(spark, hot):
    """Groups of edited copies against all pairs: joined are 64-bit components and pairs of 0.8 or more, at least nine in ten of these."""
    rng = np.random.default_rng(4)
    rows = list(MIXED)
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 160)]
        for _ in range(60 if family == 0 else 6):
            words = list(base)
            for at in rng.choice(len(words), int(rng.integers(0, 6)), replace=False):
                words[at] = "other"
            rows.append((100 + len(rows), " ".join(words), "a"))
    df = table(spark, rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copy_groups(df, hot=hot).collect()}
    assert set(got) == {r[0] for r in rows}
    new = rows[len(MIXED) :]
    sets = [set(near_copies.grams(t.encode().lower().split()).tolist()) for _, t, _ in new]
    root, linked = {r[0]: r[0] for r in new}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(zip((r[0] for r in new), sets), 2):
        if len(x & y) >= 0.8 * len(x | y):
            linked.append((i, j))
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert sum(got[i] == got[j] for i, j in linked) >= 0.9 * len(linked) > 100
    for r in simhash.near_duplicates(df).collect():
        if r.doc_id in root:
            a, b = find(r.doc_id), find(r.component_id)
            root[max(a, b)] = min(a, b)
    assert all(find(i) == find(got[i]) for i in root)
    assert got[1] == 1 and got[2] == got[3] == 2


@pytest.mark.parametrize("most", [1, near_copies.LISTED])
def test_near_copies_past_a_rejected_tree_link(spark, monkeypatch, most):
    """Over 32 texts of one bucket that all meet through one short text which is like none of them: pairs of 0.8 or more are still found."""
    monkeypatch.setattr(near_copies, "LISTED", most)

    def bucket(docs):  # one bucket with equal segments: any two texts are within budgets
        return docs.select(F.lit(7).alias("key"), "n", "node", F.lit(5).cast("long").alias("ahead"))

    monkeypatch.setattr(near_copies, "chain_keys", bucket)
    monkeypatch.setattr(near_copies, "RADIUS", 384)
    rng = np.random.default_rng(5)
    rows = [(1, " ".join(f"r{x}" for x in range(90)), "a")]
    for pair in range(25):
        words = [f"p{pair}x{x}" for x in rng.permutation(100)]
        rows += [(10 + 2 * pair, " ".join(words), "a"), (11 + 2 * pair, " ".join([*words[:-1], "z"]), "a")]
    df = table(spark, rows)
    prints = near_copies.wide_prints(df).cache()
    ids = {r.node: r.doc_id for r in prints.collect()}
    for hot in (near_copies.HOT, 32):
        got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in near_copies.similar_links(df, prints, hot).collect()}
        assert got == {(10 + 2 * pair, 11 + 2 * pair) for pair in range(25)}


def test_near_copies_check_64_bit_links(spark):
    """Texts that repeat one line and otherwise differ have nearly the same 64-bit print and stay; an edited copy goes."""
    line = " ".join(f"licence{x}" for x in range(11))
    rows = [(i, " ".join([line] * 50 + [f"own{i}x{x}" for x in range(60)]), "a") for i in range(1, 41)]
    words = [f"w{x}" for x in range(300)]
    rows += [(50, " ".join(words), "a"), (51, " ".join([*words[:-1], "z"]), "a"), (52, "", "a"), (53, None, "a"), (54, " ".join(words).upper(), "a")]
    df = table(spark, rows)
    assert len({r.component_id for r in simhash.near_duplicates(df).collect()}) < 40
    assert sorted(r.doc_id for r in near_copies.keep_first(df).collect()) == [*range(1, 41), 50, 52]


def test_large_groups_of_near_copies_need_few_links(spark, monkeypatch):
    """One group of edited copies: all are joined, and the links that all rounds join grow with its texts, not with its buckets."""
    rng = np.random.default_rng(6)
    base, rows = [f"w{x}" for x in range(160)], []
    for i in range(400):
        words = list(base)
        for at in rng.choice(len(words), int(rng.integers(1, 3)), replace=False):
            words[at] = f"o{i}x{at}"
        rows.append((i, " ".join(words), "a"))
    joined, connected = [], near_copies.connected

    def counted(links):
        joined.append(links.count())
        return connected(links)

    monkeypatch.setattr(near_copies, "connected", counted)
    got = near_copies.near_copy_groups(table(spark, rows)).collect()
    assert len(got) == 400 and {r.component_id for r in got} == {0}
    assert sum(joined) < 5 * 400


# --- HTML ---------------------------------------------------------------------------------------


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_main_text():
    body = (
        "<nav><ul><li>menu</li></ul></nav><header>top</header><div class='ad'>buy</div><article><h1>A &amp; B &lt;c&gt;</h1>"
        "<p><b>one\n  two.<br><p>three <i>four</i>&nbsp;&copy</p><aside>side</aside><form><p>mail</p></form>"
        "<div class='comments'><p>first!</p></div><ul><li>x<li>y</ul></article><footer>end</footer>"
    )
    want = "A & B <c>\none two.\nthree four ©\nx\ny"
    assert html_extract.main_text(html_extract.parse(page(body))) == want
    assert html_extract.main_text(html_extract.parse(page("<p>plain</p><div class=cookie-notice>ok</div>"))) == "plain"
    for cut in range(len(page(body))):
        html_extract.main_text(html_extract.parse(page(body)[:cut]))  # never fails


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "nav-open", "post comments-open", "with_comments", "post--no-share"])
def test_noise_names_in_passing(name):
    text = lambda body: html_extract.main_text(html_extract.parse(page(body)))
    assert text(f"<div class='{name}'><p>text</p><div class='main-nav'>menu</div><div class='comments list'>first!</div></div>") == "text"
    assert text(f"<div>top</div><article class='{name}'><p>text</p></article>") == "text"


def test_only_article_is_never_noise():
    text = lambda body: html_extract.main_text(html_extract.parse(page(body)))
    for outer, own in itertools.product(("x", "sidebar", "widget modal"), ("x", "related", "comment")):
        assert text(f"<div>top</div><div class='{outer}'><div class=menu>m</div><article class='{own}'><p>text</p></article></div>") == "text"
    assert text("<div class=related><article>card</article></div><article class=related>card</article><article>text</article>") == "text"
    assert text("<p>text</p><div class=related><article>card</article><article>card</article></div>") == "text"


def test_style_tree_removes_repeated_branches(spark):
    rows = [(i, f"http://h.org/{i}", page(f"<div class=xa>Read our other pages</div><div class=xb><p>text {i} of its own</p></div>"), "c") for i in range(12)]
    rows += [(90, None, None, "c"), (91, "http://other.org", "", "c"), (92, "http://other.org", page("<div class=xa>Read</div>"), "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()}
    assert all(out[i] == (f"text {i} of its own", len(f"text {i} of its own")) for i in range(12))
    assert out[90] == out[91] == ("", 0) and out[92] == ("Read", 4)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_style_tree_keeps_articles_at_any_size(spark):
    """A host of 20 layouts and texts of their own gives equal texts with 100 and with 20,000 pages; its menu goes in both."""

    tags = "".join(f"<p class=l%2$s>text %1$s part {k} of its own</p>" for k in range(2))
    body = page(f"<div class=xm>Read our other pages</div><div class=xa>{tags}</div>")
    got = {}
    for size in (100, 20_000):
        df = spark.range(size).select(F.col("id").alias("page_id"), F.lit("http://h.org/").alias("url"), F.format_string(body, "id", F.chr(97 + F.col("id") % 20)).alias("html"))
        got[size] = {r.page_id: r.text for r in html_extract.extract_pages(df).where("page_id < 100").collect()}
    assert got[100] == got[20_000] == {i: f"text {i} part 0 of its own\ntext {i} part 1 of its own" for i in range(100)}


def test_style_tree_keeps_mirrored_articles(spark):
    """Two articles twice each in one layout; and an article in a wrapper that all pages share."""
    mirror = [(i, f"http://m.org/{i}", page(f"<div class=xa><p>article {i % 2}</p></div>")) for i in range(4)]
    inside = [(10 + i, f"http://n.org/{i}", page("<div class=xa><div class=xm>menu</div><article><p>one for all</p></article></div>")) for i in range(8)]
    df = spark.createDataFrame(mirror + inside, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}
    assert out == {i: f"article {i % 2}" for i in range(4)} | {10 + i: "one for all" for i in range(8)}


# --- chat ---------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[\\/|s>INST]SYim_end\n ü", max_size=40))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text
    hidden = chat.escape(text)
    assert not any(mark in hidden for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat(spark):
    turns = [(1, 2, "assistant", "b </s>"), (1, 1, "user", "a"), (1, 2, "assistant", "b </s>"), (2, None, None, None), (None, 1, "user", "<|im_end|>\n")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.with_parts(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 3 and out[1].turns_sha256 == sha("user\na\nassistant\nb </s>\nassistant\nb </s>\n")
    assert out[1].loss_sha256 == sha("b </s>b </s>") and out[1].loss_chars == 12
    assert out[2].turns_sha256 == sha("\n\n") and out[None].turns_sha256 == sha("user\n<|im_end|>\n\n")
    assert chat.read_back(chat.format_turns(chat.with_parts(df.limit(0)))).count() == 0


def test_parts_become_placeholders(spark):
    parts = [("text", "see", None, None, None, None, None), ("image", None, "a.png", 56, 30, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), None]
    df = spark.createDataFrame([(1, 1, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_turns(df).first()
    assert row.piece == "<|im_start|>user\nsee<|image_1|><|audio_2|><|document_3|><|im_end|>\n"
    assert [(a.ref, a.tokens) for a in row.attachments] == [("a.png", 6), ("b.wav", 50), ("c.pdf", 768)]


def test_groups_of_copies_give_trees_and_lists_hold_only_what_may_be_similar():
    """Pairs that leave the buckets grow with the rows, not with their square, in both kinds of round; nothing similar is ruled out."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2**63, 200).astype("<u8")
    # 25 of 200 shingles replaced in each: every two are about 0.77 alike, and near by their prints.
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(200, 25, replace=False)), rng.integers(0, 2**63, 25).astype("<u8")])) for _ in range(120)]
    n = np.array([len(x) for x in sets])
    prints = np.packbits(near_copies.tallies(sets) > 0, axis=1, bitorder="little").view("<u8")
    parts = np.stack([np.bincount(x % np.uint64(near_copies.PARTS), minlength=near_copies.PARTS) for x in sets]).astype("<u2")
    i, j = np.triu_indices(120, 1)
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    alike = shared >= near_copies.SIMILARITY * (n[i] + n[j] - shared)
    allowed = near_copies.ruled_in(n, (prints, parts), False, i, j)
    near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1) <= near_copies.RADIUS
    assert not (alike & near & ~allowed).any() and allowed.sum() < 0.2 * near.sum() and near.sum() > 500
    node, ahead, same = np.arange(120), np.zeros(120, "<u8"), np.zeros(120, np.int64)
    for size in (near_copies.SMALL, 120):
        a, b, is_open, _ = near_copies.bucket_pairs(same[:size], np.sort(n)[:size], node[:size], ahead[:size], node[:size])
        assert len(a) == size - 1 and is_open.all() and set(a) | set(b) == set(range(size))
    order = np.argsort(n, kind="stable")
    whole = (prints[order], parts[order])
    a, b, is_open, _ = near_copies.bucket_pairs(same, n[order], node, ahead, node, 1000, whole)
    assert len(a) == allowed.sum() and not is_open.any()
