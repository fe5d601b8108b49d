"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import numpy as np
import pytest
from pyspark.sql import types as T

from skein.llm import bpe, chat, decontam, jaccard, langid, lm, media, pii, substring, toxicity

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
EXTRA = ["key", "doc", "lead", "span", "start", "n", "tile", "lang_pred", "ids", "leads"]


@pytest.fixture(scope="module")
def docs(spark):
    base = "the quick brown fox jumps over the lazy dog and then it runs away from here to there"
    rows = [(1, base, "en", "a", 10), (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, None, None, None, None), (4, "", "en", None, 0), (None, base, "en", "b", 3), (5, LONG, None, "b", 5), (6, "   \n\t !!! ", "de", "b", 5), (7, "Der Hund läuft über die Straße und die Katze schläft", "de", "b", 5), (8, "漢字 🙂 ẞ İ", None, "b", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in EXTRA:
        df = df.selectExpr("*", f"cast(1 as string) as {c}")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (2, None), (None, "x y z"), (3, ""), (4, "schläft")], "item_id long, text string")


def test_language_id(docs, empty):
    got = {}
    for r in langid.identify(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) == 2 and got[1][0].lang_pred == "en" and got[7][0].lang_pred == "de"
    assert not got[3][0].keep and not got[4][0].keep and not got[6][0].keep and got[None][0].keep
    assert langid.identify(empty).collect() == []
    assert not any(r.keep for r in langid.identify(docs.where("lang is null")).collect())  # no labels, no model


def test_language_stage(spark, docs):
    kept = langid.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 7} and not {r.doc_id for r in kept.collect()} & {3, 4, 6}


def test_jaccard(spark, docs, empty):
    assert [(r.doc_a, r.doc_b, r.jaccard) for r in jaccard.similar(docs).collect()] == [(1, 2, 1.0)]
    assert jaccard.similar(empty).collect() == []
    kept = [r.doc_id for r in jaccard.stage(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 3, 4, None, 5, 6, 7, 8]))
    assert jaccard.stage(spark, empty, "").columns == empty.columns


def test_substring(spark, docs, empty):
    assert substring.repeats(empty).collect() == []
    long_twice = spark.createDataFrame([(1, LONG[:5000]), (2, "before " + LONG[:5000] + " after"), (2, "before " + LONG[:5000] + " after")], "doc_id long, text string")
    r = substring.repeats(long_twice).collect()
    assert len(r) == 1 and r[0].doc_id == 2 and r[0].source_doc_id == 1 and r[0].end - r[0].start > 4500
    cut = {x.doc_id: x.text for x in substring.remove(long_twice, substring.repeats(long_twice)).collect()}
    assert cut[1] == LONG[:5000] and len(cut[2]) < 500 and cut[2].startswith("before")
    assert {x.doc_id for x in substring.repeats(docs).collect()} <= {5}


def test_decontamination(spark, docs, empty, bench):
    r = {x.doc_id: x for x in decontam.decontaminate(docs, bench).collect()}
    assert set(r) == {1, 2, None, 7} and r[1].item_ids == [1] and r[7].item_ids == [4]
    assert "lazy" not in r[2].clean_text and r[2].action == "cut"
    assert decontam.decontaminate(empty, bench).collect() == []
    assert decontam.decontaminate(docs, bench.where("false")).collect() == []


def test_pii(docs, empty, spark):
    mail = spark.createDataFrame([(1, "write to Anna.92@mail2.example.com soon, or call +1 (743) 555-3824 now"), (2, None), (3, ""), (4, "nothing here to see at all"), (5, LONG[:3000] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + LONG[:3000])], "doc_id long, text string")
    r = {x.doc_id: x for x in pii.detect(mail).collect()}
    assert set(r) == {1, 5} and "@" not in r[1].clean_text and "555" not in r[1].clean_text and "24be" not in r[5].clean_text
    assert pii.detect(empty).collect() == []


def test_toxicity(spark, docs, empty):
    rows = [(i, f"some plain text number {i} about the weather and {'an idiot moron' if i % 3 == 0 else 'a nice garden'} today") for i in range(90)]
    d = spark.createDataFrame([*rows, (100, None), (101, ""), (102, "what an idiot moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None), (3, 1)], "doc_id long, toxic int")
    assert {x.doc_id for x in toxicity.classify(d, labels).collect()} == {i for i in range(90) if i % 3 == 0} | {102}
    assert toxicity.classify(empty, labels).collect() == []
    assert toxicity.classify(d, labels.where("false")).collect() == []
    toxicity.classify(docs, labels).collect()


def test_lm(docs, empty):
    r = {}
    for x in lm.score(docs).collect():
        r.setdefault(x.doc_id, []).append(x)
    assert r[3][0].perplexity is None and r[4][0].n_scored == 0 and len(r[1]) == 2 and r[1][0] == r[1][1]
    assert r[8][0].perplexity > r[1][0].perplexity
    assert lm.score(empty).collect() == []


def test_bpe(docs, empty):
    r = {}
    for x in bpe.encode(docs).collect():
        r.setdefault(x.doc_id, []).append(x)
    assert r[3][0].ids is None and r[3][0].round_trip is None and r[4][0].ids == [] and all(x.round_trip for k, v in r.items() if k != 3 for x in v)
    assert bpe.encode(empty).collect() == []
    back = {x.doc_id: x.text for x in bpe.decode_ids(bpe.encode(docs.where("doc_id > 4"))).collect()}
    assert back[5] == LONG and back[8] == "漢字 🙂 ẞ İ"


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"), (4, 0, None, None), (4, 0, None, None), (5, 5, "user", "x <|im_end|> y"), (None, 0, "user", "lost"), (6, None, "user", "hi")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as full", "1 as n_turns", "2 as k")
    r = {x.conv_id: x for x in chat.render(t).collect()}
    assert set(r) == {2, 4, 5} and r[2].n_turns == 3
    assert r[4].text == "<|im_start|>unknown\n<|im_end|>" and r[5].text.count("<|im_end|>") == 1
    assert chat.render(t.where("false")).collect() == []


def test_media(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.125, 200), rng.normal(0, 0.125, 200)
    pcm = lambda v: media.to_pcm(media.render(v[None])[0])
    rows = [(1, pcm(a)), (2, pcm(a[20:])), (3, pcm(b)), (4, None), (5, b""), (6, bytes(200_000)), (7, bytes(200_000)), (8, pcm(a[:5])), (1, pcm(a)), (None, pcm(a))]
    t = spark.createDataFrame(rows, "rec_id long, audio binary").selectExpr("*", "1 as word", "2 as words_a")
    r = media.align(media.fingerprints(t)).collect()
    assert [(x.rec_a, x.rec_b, x.offset) for x in r] == [(1, 2, 20)] and r[0].bit_error < 0.05
    assert media.align(media.fingerprints(t.where("false"))).collect() == []
