"""What a review found missing, each against a plain computation of the whole."""

import random
import re

import numpy as np

from skein.llm import _text, decontam, langid, lm, media, toxicity


def test_parts_of_the_benchmark_give_what_one_set_gives(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words[:40])), (2, " ".join(words[10:50])), (3, "no words of it")], "doc_id long, text string")
    items = [(k, " ".join(words[:11])) for k in range(4)] + [(9, " ".join(words[11:21])), (10, " ".join(words[30:39]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = lambda: sorted((r.doc_id, r.item_ids, r.spans, r.share, r.action, r.clean_text) for r in decontam.decontaminate(docs, bench).collect())
    want = plain()
    monkeypatch.setattr(decontam, "BROADCAST_CHARS", 1)
    assert plain() == want and len(want) == 2


def test_recordings_with_up_to_a_quarter_of_their_bits_differing_match(spark):
    a = np.random.default_rng(0).integers(1, 1 << 31, 40).astype(np.int32)
    rows = []
    for k, flip in ((2, 0x00FF0000), (3, 0x03FF0000)):
        b = a.copy()
        b[4:] ^= flip
        rows.append((k, b.tolist()))
    prints = spark.createDataFrame([(1, a.tolist()), *rows], "rec_id long, words array<int>")
    got = {(r.rec_a, r.rec_b): r.bit_error for r in media.align(prints).collect()}
    assert got[1, 2] == 0.225 and (1, 3) not in got


def test_lm_tells_all_characters_apart(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüßéèáó .,;:!?", k=400))) for i in range(40)]
    rows += [(100 + i, "1" * 200) for i in range(3)] + [(200, "".join(rng.choices("0123456789", k=200))), (201, "".join(map(chr, range(0x4E00, 0x4E00 + 200)))), (202, "\U0001f642" * 50)]
    r = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert r[200].perplexity > 2 * r[100].perplexity and r[201].perplexity > 2 * r[100].perplexity
    assert all(r[i].n_scored == len(t) for i, t in rows)


def test_toxicity_says_nothing_without_features(spark):
    d = spark.createDataFrame([(1, "you vile idiot moron"), (2, "what an idiot moron"), (3, "a garden in the sun"), (4, "rain on the roof"), (5, "completely harmless text about trees"), (6, "!!! 12 ..."), (None, None)], "doc_id long, text string")
    few = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.classify(d, few).collect() == []
    assert toxicity.classify(d, few.where("toxic = 1")).collect() == []
    assert {r.doc_id for r in toxicity.classify(d, few, least_rows=1).collect()} == {1, 2}
    weight = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    assert toxicity.scores(["!!! 12 ...", "", None, "words that it doesn't know"], weight, 3.0).tolist() == [0, 0, 0, 0]


def test_toxicity_scores_are_those_of_a_plain_sum():
    rng = np.random.default_rng(1)
    weight = np.append(rng.normal(0, 1, 1 << toxicity.BITS), 0).astype(np.float32)
    texts = ["some words, and MORE words", "", "x", "äöü 12 straße geht", "words " * 500]
    got = toxicity.scores(texts, weight, -0.5)
    for t, s in zip(texts, got):
        ((_, _, cp, bounds),) = _text.chunks([t]) if t else [(0, 0, np.zeros(0, np.uint32), np.zeros(2, np.int64))]
        f, _ = langid.features(cp, bounds, toxicity.ORDERS, toxicity.BITS)
        own = {int(x) for x in f.ravel() if x < 1 << toxicity.BITS}
        z = sum(float(weight[x]) for x in own) - 0.5
        assert abs(s - (1 / (1 + np.exp(-z)) if own else 0)) < 1e-4


def test_language_scores_are_those_of_a_plain_sum():
    rng = np.random.default_rng(2)
    model = np.log(rng.random((1 << langid.BITS, 4)).astype(np.float32) + 0.01)
    model = np.concatenate((model, np.zeros((1, 4), np.float32)))
    texts = ["some words", "Straße, Haus und Hof 12", "漢字かな", "a", "", None, "x" * 3000]
    best, _ = langid.score(texts, ["a", "b", "c"], model)
    for t, got in zip(texts, best):
        total = np.zeros(4)
        letters = re.sub(r"[^\w]|[\d_]", " ", (t or "").lower())
        letters = re.sub(" +", " ", letters)
        for order in langid.ORDERS:
            for i in range(len(letters) - order + 1):
                cp = np.array([ord(c) for c in letters[i : i + order]], np.uint32)
                f, _ = langid.features(cp, np.array([0, len(cp)]), (order,), langid.BITS)
                total += model[f[0, 0]]
        assert got == (["a", "b", "c", langid.UNKNOWN][total.argmax()] if total.any() else langid.UNKNOWN)


def test_recordings_against_all_pairs_and_offsets(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.125, (60, 64))
    noisy = base[rng.integers(0, 60, 60)] + rng.normal(0, 0.02, (60, 64))
    cut = [v[k:] for v, k in zip(base[:20], rng.integers(1, 20, 20))]
    pcm = [media.to_pcm(media.render(np.asarray(v)[None])[0]) for v in [*base, *noisy, *cut]]
    words = media.of_pcm(pcm, media.thresholds())
    want = set()
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            for offset in range(-len(words[b]) + media.OVERLAP, len(words[a]) - media.OVERLAP + 1):
                x, y = words[a][max(0, offset) :], words[b][max(0, -offset) :]
                n = min(len(x), len(y))
                if n >= media.OVERLAP and np.bitwise_count(x[:n] ^ y[:n]).sum() <= media.ERRORS * 32 * n:
                    want.add((a, b))
    prints = spark.createDataFrame([(i, w.view(np.int32).tolist()) for i, w in enumerate(words)], "rec_id long, words array<int>")
    got = media.align(prints).collect()
    for r in got:
        x, y = words[r.rec_a][max(0, r.offset) :], words[r.rec_b][max(0, -r.offset) :]
        n = min(len(x), len(y))
        assert n == r.n_overlap and abs(np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n) - r.bit_error) < 1e-6
    found = {(r.rec_a, r.rec_b) for r in got}
    assert found <= want and len(want) > 40 and len(found) >= 0.9 * len(want)


def test_every_offset_of_two_recordings_is_tried(spark):
    """A motif that recurs where the recordings don't match has more equal places than the true offset."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 1 << 31, 60), rng.integers(1, 1 << 31, 60)
    a[:8] = b[52:] = rng.integers(1, 1 << 31, 8)  # overlap of 8 words only
    b[10:14] = a[10:14]
    b[14:52] = a[14:52] ^ 0x000F0000
    b[0:10] = a[0:10] ^ 0x000F0000
    rows = [(1, a.astype(np.int32).tolist()), (2, b.astype(np.int32).tolist())]
    (r,) = media.align(spark.createDataFrame(rows, "rec_id long, words array<int>")).collect()
    assert r.offset == 0


def test_stages_on_nulls_repeats_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    base = "the quick brown fox jumps over the lazy dog and then it runs away from here to there"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, base, "en", "a", 10), (1, base, "en", "a", 10), (1, "another text that has the same number as the one before", "en", "a", 1), (2, base, "en", "a", 10), (3, None, None, None, None), (4, "", "en", None, 0), (None, base, "en", "b", 3), (None, None, None, None, None), (5, "mail me at " + "word " * 30_000 + " john.smith@mail3.example.com", "en", "b", 5)]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", *[f"'z' as `{c}`" for c in ("_row", "gone", "nth", "name", "_gone", "a.b", "doc", "key")])
    docs.sparkSession.createDataFrame([(1, "fox jumps over the lazy dog and then it"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, str(tmp_path))
            got = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns and all(r["a.b"] == "z" for r in got)
            if table is not docs:
                assert got == []
                continue
            if name == "language_id":
                assert {r.doc_id for r in got} == {1, 2, 5, None} and len(got) >= 5
            elif name == "ngram_jaccard":
                assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "3", "4", "None", "None", "5"])
            elif name == "decontamination":
                assert len(got) == 9 and "lazy" not in next(r.text for r in got if r.doc_id == 2)
            elif name == "pii":
                assert len(got) == 9 and sum(r.text is None for r in got) == 2
            else:
                assert len(got) == 9 and [r.ids for r in got if r.doc_id in (3, 4)] == [None, []]
