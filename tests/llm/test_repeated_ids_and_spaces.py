"""Repeated ids in near-dedup, surrogate spaces smaller than their entities, long words and many entities."""

import time
import zlib

import pytest

import corpus_pipeline
from armspark.llm import near_copies, quality, surrogates

X = " ".join(f"word{i}" for i in range(60)) + "."
Y = " ".join(f"other{i}" for i in range(60)) + "."


def kept(spark, rows):
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, text_key int").repartition(3)
    got = near_copies.keep_first(docs)
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_a_repeated_id_keeps_its_distinct_text(spark):
    assert kept(spark, [(1, X), (2, X), (2, Y)]) == [(1, X), (2, Y)]
    assert kept(spark, [(2, Y), (2, Y), (2, X), (3, X)]) == sorted([(2, Y), (2, X)], key=str)
    near = X.replace("word59", "word60")
    both = kept(spark, [(5, X), (5, near), (6, Y)])
    assert len(both) == 2 and both == kept(spark, [(5, near), (6, Y), (5, X)])


def test_draws_end_where_a_shape_has_fewer_values_than_entities(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}.{c}") for a in letters for b in letters for c in ("com", "org")]
    entities = spark.createDataFrame(rows, "kind string, norm string")
    done = surrogates.assign(entities).collect()
    assert {(r.kind, r.norm) for r in done} == set(rows)
    values = [r.surrogate for r in done]
    assert len(set(values)) == len(values) and not {n for _, n in rows} & set(values)


@pytest.mark.parametrize("kind, norm, written", [("ip", "10.0.0.1", "10.0.0.1"), ("phone", "5550001234", "555-000-1234"), ("card", "4111111111111111", "4111 1111 1111 1111")])
def test_every_space_grows(kind, norm, written):
    early, late = (surrogates.surrogate(kind, norm, attempt, "k") for attempt in (0, 9))
    assert len(late) > len(early)
    put = surrogates.rendered(kind, written, late)
    assert [c for c in put if c.isalnum()] == [c for c in late if c.isalnum()]
    assert kind != "card" or surrogates.luhn_ok(late)


def test_many_entities_in_one_text_are_found_in_linear_time():
    text = " ".join(f"user{i}@mail{i}.com" for i in range(40_000))
    begun = time.time()
    found = surrogates.detect(text)
    assert len(found) == 40_000 and time.time() - begun < 5
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_the_shape_of_a_word_sees_all_of_it():
    word = b"a" * 63 + b"1Z!1Z!" * 9
    assert quality.shape_of(word) == b"a" + b"9U!" * 18
    code = quality.Codes()[word]
    assert code % quality.SHAPES == zlib.crc32(quality.shape_of(word)) % quality.SHAPES


def test_stages_take_columns_whose_names_they_use(spark):
    rows = [(1, "mail bob@mail.com now " + X, "a", 1, 2, 3, 4, 80), (2, Y, "b", 1, 2, 3, 4, 90), (2, Y, "b", 1, 2, 3, 4, 90), (None, None, None, 1, 2, 3, 4, None)]
    schema = "doc_id long, text string, source string, n_entities int, mix_target int, n int, c0 int, n_chars int"
    docs = spark.createDataFrame(rows, schema)
    done = corpus_pipeline.without_pii(spark, docs, "")
    assert done.schema == docs.schema and done.count() == 4
    first = done.where("doc_id = 1").first()
    assert "bob@" not in first.text and first.n_chars == len(first.text) and first.n_entities == 1
    mixed = corpus_pipeline.weighted_mix(spark, docs, "")
    assert mixed.columns == [*docs.columns, "mix_target_", "mix_taken", "mix_copies"]
    assert mixed.where("mix_target = 2").count() == mixed.count()
