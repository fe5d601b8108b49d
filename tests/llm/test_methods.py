"""What SQL can't express, against brute force, an exact round trip or held-out accuracy."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from skein.llm import _text as X
from skein.llm import bpe, chat, decontam, jaccard, langid, lm, pii, substring, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def _words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_words_are_those_of_a_regex(texts):
    for _, _, cp, bounds in X.chunks([t for _, t, _ in texts]):
        w = X.Words(cp, bounds)
        assert len(w) == sum(len(_words(t)) for _, t, _ in texts)


def test_language_id_held_out(texts, spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    langs, model = langid.train(d.where("doc_id % 2 = 0"))
    odd = [(t, lang) for i, t, lang in texts if i % 2]
    got, _ = langid.score([t for t, _ in odd], langs, model)
    assert np.mean([a == b for a, (_, b) in zip(got, odd)]) > 0.95


def test_jaccard_against_all_pairs(spark, texts):
    rng = random.Random(3)
    rows = [(i, t) for i, t, _ in texts]
    for k in range(60):  # near copies with words changed
        i, t = rng.choice(rows[:150])
        w = t.split(" ")
        for _ in range(rng.randrange(0, 1 + len(w) // 8)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        rows.append((10_000 + k, " ".join(w)))
    grams = {}
    for i, t in rows:
        w = _words(t)
        g = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
        if g:
            grams[i] = g
    ids = sorted(grams)
    truth = {}
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = grams[ids[a]], grams[ids[b]]
            if min(len(x), len(y)) >= 0.6 * max(len(x), len(y)) and (j := len(x & y) / len(x | y)) >= 0.6:
                truth[ids[a], ids[b]] = round(j, 6)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= set(truth) and len(set(got)) >= 0.97 * len(truth)
    assert all(abs(truth[k] - v) < 1e-4 for k, v in got.items())


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.doc: r.root for r in jaccard.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_substring_finds_passages_and_nothing_else(spark, texts):
    rng = random.Random(1)
    base = [" ".join(f"{w}{i}x{j}" for j, w in enumerate(_words(t)[:400])) for i, t, _ in texts if len(_words(t)) > 150][:60]  # no two share a word
    passages = [" ".join(f"p{k}w{j}" for j in range(55)) for k in range(10)]
    rows, has = [], {}
    for i, t in enumerate(base):
        w = t.split(" ")
        if i % 2:
            k, at = rng.randrange(10), rng.randrange(len(w))
            w[at:at] = passages[k].split(" ")
            has[i] = k
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.start, r.end, r.source_doc_id) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {k: min(i for i in has if has[i] == k) for k in set(has.values())}
    later = {i for i in has if first[has[i]] != i}
    assert set(got) <= later and len(got) >= 0.95 * len(later)
    for i, (s, e, source) in got.items():
        assert source == first[has[i]] and rows[i][1][s:e] == passages[has[i]]


def test_substring_against_all_windows_of_fifty_words(spark):
    """All words of repeated windows of 50 words, by dictionary, against the passages found, on the documents of sf0.01."""
    rows = duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()
    seen, want, at = set(), {}, {}
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"[^\W_]+", t.lower())]
        w = [t.lower()[s:e] for s, e in spans]
        at[i] = spans
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if g in seen:
                want.setdefault(i, set()).update(range(k, k + 50))
            seen.add(g)
    got = {}
    for r in substring.repeats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        got.setdefault(r.doc_id, set()).update(k for k, (s, e) in enumerate(at[r.doc_id]) if r.start <= s and e <= r.end)
    both = sum(len(got.get(i, set()) & x) for i, x in want.items())
    assert both >= 0.99 * sum(map(len, want.values())) and both == sum(map(len, got.values()))
    assert sum(i in got for i in want) >= 0.99 * len(want)


def test_runs_are_maximal_and_equal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 3, 60), rng.integers(0, 3, 50)
        i, j, n = rng.integers(0, 30), rng.integers(0, 20), rng.integers(5, 25)
        b[j : j + n] = a[i : i + n]
        for s, e, f in substring.runs(a.astype(np.uint64), b.astype(np.uint64), np.array([i]), np.array([j]), 5):
            assert (a[s:e] == b[f : f + e - s]).all() and s <= i < e
            assert s == 0 or f == 0 or a[s - 1] != b[f - 1]
            assert e == 60 or f + e - s == 50 or a[e] != b[f + e - s]


def test_recompression_is_local():
    rng = np.random.default_rng(2)
    inner = rng.integers(1, 50, 400).astype(np.uint64)
    parses = []
    for k in range(2):
        a, b = rng.integers(1, 50, 30 + k).astype(np.uint64), rng.integers(1, 50, 40).astype(np.uint64)
        whole = X.mix(np.concatenate((a, inner, b)))
        _, first = substring.recompress(whole, np.zeros(len(whole), np.int64))
        parses.append({int(f) - len(a) for f in first if 0 <= f - len(a) < 400})
    assert {x for x in parses[0] if 60 <= x < 340} == {x for x in parses[1] if 60 <= x < 340}


def test_decontamination_against_brute_force(spark, texts):
    bench = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    grams = {}
    for i, t in bench:
        w = _words(t)
        for k in range(max(1, len(w) - 7)):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = {}
    for i, t, _ in texts:
        w = _words(t)
        found = set().union(*[grams.get(tuple(w[k : k + 8]), set()) for k in range(len(w))])
        if found:
            want[i] = sorted(found)
    got = {r.doc_id: r.item_ids for r in decontam.op6_decontamination(spark, SF).collect()}
    assert got == want


def test_pii_gradients_and_held_out_spans():
    prose = [" ".join(random.Random(k).choices("the on er th hean ation ly ing ed of and".split(), k=200)) for k in range(20)]
    texts, labels = pii.examples(prose, 1500, 96, 1)
    model = pii.Tagger(4)
    code = np.stack([pii.classes(np.frombuffer(t.encode("utf-32-le"), "<u4")) for t in texts[:3]]).astype(np.int64).T[:16].copy()
    gold = labels[:3].T[:16]
    _, grads = model.step(code, gold)
    for key in ("uf", "ub", "w", "a"):
        old, eps = model.p[key][1, 1], 2e-2
        model.p[key][1, 1] = old + eps
        up = model.step(code, gold)[0]
        model.p[key][1, 1] = old - eps
        down = model.step(code, gold)[0]
        model.p[key][1, 1] = old
        assert abs((up - down) / (2 * eps) - grads[key][1, 1]) < 2e-4
    trained = pii.Tagger().train(texts, labels, steps=250)
    t2, l2 = pii.examples(prose, 200, 96, 2)
    found = trained.viterbi(trained.emissions(np.stack([pii.classes(np.frombuffer(t.encode("utf-32-le"), "<u4")) for t in t2]).astype(np.int64).T.copy())).T
    assert (found == l2).mean() > 0.96


def test_viterbi_bound_is_exact():
    rng = np.random.default_rng(4)
    model = pii.Tagger(4)
    model.p["a"] = rng.normal(0, 1, (6, 6)).astype(np.float32)
    e = rng.normal(0, 1, (12, 6, 300)).astype(np.float32)
    e[:, 0, :200] += 4
    got = model.viterbi(e.copy())
    for n in range(0, 300, 7):
        best = e[0, :, n].astype(float)
        back = []
        for t in range(1, 12):
            s = best[:, None] + model.p["a"]
            back.append(s.argmax(0))
            best = s.max(0) + e[t, :, n]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[:, n].tolist() == path[::-1]


def test_pii_windows_agree_with_the_whole():
    model = pii.Tagger(4)
    rng = random.Random(0)
    t = "".join(rng.choices("abc 123@.\n", k=3000))
    cp, bounds = next(X.chunks([t]))[2:]
    tag = pii.labels_of(model, cp, bounds)
    assert len(tag) == 3000
    alone = pii.labels_of(model, *next(X.chunks([t[:700]]))[2:])
    assert (alone[:600] == tag[:600]).mean() > 0.99


def test_toxicity_held_out():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("thernaedionis", k=rng.randrange(2, 9))) for _ in range(400)]
    bad = ["grumblefoul", "snarkvile", "nastigon"]
    texts, y = [], []
    for k in range(600):
        w = rng.choices(vocabulary, k=rng.randrange(20, 200))
        if k % 4 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        y.append(k % 4 == 0)
    y = np.array(y)
    sets = []
    for lo, hi, doc, bucket in toxicity.present(texts[:400]):
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        sets += [bucket[s:e] for s, e in zip(at, at[1:])]
    count = lambda pick: sum(np.bincount(s, minlength=1 << toxicity.BITS) for s, p in zip(sets, pick) if p)
    ratio = toxicity.ratios(count(y[:400]), count(~y[:400]), y[:400].sum(), (~y[:400]).sum())
    used = [s[ratio[s] != 0] for s in sets]
    weight, intercept = toxicity.fit(used, y[:400], ratio)
    s = toxicity.scores(texts[400:], weight, intercept) >= 0.5
    assert s[y[400:]].mean() > 0.95 and s[~y[400:]].mean() < 0.02


def _tokens(t):
    return [x[k : k + lm.LONGEST] for x in re.findall(r" ?[^\W_]+|[\W_]", t) for k in range(0, len(x), lm.LONGEST)]


def test_lm_tokens_are_those_of_a_regex(texts):
    for _, _, cp, bounds in X.chunks([t for _, t, _ in texts]):
        w = lm.Tokens(cp, bounds)
        pieces = ["".join(map(chr, cp[s : s + n])) for s, n in zip(w.start, w.size)]
        want = [_tokens(t) for _, t, _ in texts]
        assert [pieces[k] for k in w.word] == [x for t in want for x in t]
        before = [(a, b) for t in want for a, b in zip([None, None, *t], [None, *t][: len(t)])]
        name = [*pieces, None]
        assert [(name[a], name[b]) for a, b in zip(w.older, w.context)] == before


def test_lm_against_all_seatings():
    """Two restaurants and their parent: the predictive probabilities of all seatings, weighed, against those sampled."""
    n, context, to_lower, base = np.array([3, 2, 2, 1]), np.array([0, 0, 1, 1]), np.array([0, 1, 0, 2]), np.array([0.5, 0.3, 0.2])
    (du, su), (dl, sl) = ((x[k] for x in (lm.DISCOUNT, lm.STRENGTH)) for k in (4, 3))
    rising = lambda s, d, t: np.prod([s + d * i for i in range(1, t)])
    count = lambda d, n, t: np.exp(lm.stirling(d)[n, t])
    mean, whole = np.zeros(4), 0.0
    for t in itertools.product(*[range(1, k + 1) for k in n]):
        t = np.array(t)
        tc = np.bincount(context, t)
        weight = np.prod([count(du, a, b) for a, b in zip(n, t)]) * np.prod([rising(su, du, int(k)) for k in tc])
        below = np.bincount(to_lower, t).astype(int)
        for t0 in itertools.product(*[range(1, k + 1) for k in below]):
            t0 = np.array(t0)
            w = weight * np.prod([count(dl, a, b) for a, b in zip(below, t0)]) * rising(sl, dl, int(t0.sum())) * np.prod(base**t0)
            # the parents' restaurant has as many customers as the tables above, which their process must seat
            w /= np.prod([sl + i for i in range(1, below.sum())])
            p0 = (below - dl * t0 + (sl + dl * t0.sum()) * base) / (below.sum() + sl)
            p = (n - du * t + ((su + du * tc) / (np.bincount(context, n) + su))[context] * p0[to_lower] * (np.bincount(context, n) + su)[context]) / (np.bincount(context, n) + su)[context]
            mean, whole = mean + w * p, whole + w
    got = lm.gibbs([lm.Level(4, context * 8 + to_lower, 8), lm.Level(3, np.arange(3), 8)], [to_lower], n, base, np.random.default_rng(0), 50, 4000)
    assert np.abs(got - mean / whole).max() < 0.03


def test_lm_predictions_are_distributions():
    """What restaurants give to their dishes and what they leave to words never seen make 1."""
    rng = np.random.default_rng(0)
    two, word = np.divmod(np.unique(rng.integers(0, 400, 300)), 20)
    n = rng.integers(1, 50, len(two)).astype(float)
    level = lm.Level(4, two * 20 + word, 20)
    base = np.full(len(n), 1 / 20)
    level.seat(n, base, rng)
    left = (lm.STRENGTH[4] + lm.DISCOUNT[4] * np.bincount(level.at, level.tables)) / (np.bincount(level.at, n) + lm.STRENGTH[4])
    unseen = 1 - np.bincount(level.at, base)
    assert np.allclose(np.bincount(level.at, level.own(n, base)) + left * unseen, 1)


def test_lm_leaving_one_out_is_a_model_without_it():
    n, context, base = np.array([1, 4, 2, 1]), np.array([0, 0, 1, 1]), np.array([0.1, 0.2, 0.3, 0.05])
    level = lm.Level(4, context * 8 + np.arange(4), 8)
    level.tables = np.array([1.0, 2.0, 2.0, 1.0])
    got = level.left(n.astype(float), base, base / 2)
    for k in range(4):
        rest, tables = n.astype(float).copy(), level.tables.copy()
        closes = n[k] == tables[k]
        rest[k] -= 1
        tables[k] -= closes
        other = lm.Level(4, level.code, 8)
        other.tables = tables
        assert np.isclose(got[k], other.own(rest, np.where(closes & (np.arange(4) == k), base / 2, base))[k])


def test_lm_exact_tables_are_those_of_the_process():
    for n in (2, 5, 17):
        level, base, seen = lm.Level(3, np.arange(20_000), 1), np.full(20_000, 0.3), np.zeros(n + 1)
        level.seat(np.full(20_000, float(n)), base, np.random.default_rng(1))
        d, s = lm.DISCOUNT[3], lm.STRENGTH[3]
        want = np.array([0, *[np.exp(lm.stirling(d)[n, t]) * np.prod([(s + d * i) * 0.3 for i in range(t)]) for t in range(1, n + 1)]])
        seen = np.bincount(level.tables.astype(int), minlength=n + 1) / 20_000
        assert np.abs(seen - want / want.sum()).max() < 0.015


def test_lm_blocks_and_buckets_agree_with_one_machine(spark, texts):
    """The Spark plan against dictionaries of the whole corpus, in one piece and in many blocks, buckets and restaurants of a hot context."""
    rows = [(i, t) for i, t, _ in texts]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    grams, of = Counter(), {}
    for i, t in rows:
        w = _tokens(t)
        of[i] = list(zip([None, None, *w], [None, *w], w))
        grams.update(of[i])
    name = {k: i for i, k in enumerate(dict.fromkeys(x for g in grams for x in g))}
    two = {k: i for i, k in enumerate(dict.fromkeys((b, a) for a, b, _ in grams))}
    end = {k: i for i, k in enumerate(dict.fromkeys((b or "")[-lm.ENDING :] for _, b, _ in grams))}
    one, ending = np.zeros(len(two), np.int64), np.zeros(len(name), np.int64)
    for (b, _), k in two.items():
        one[k], ending[name[b]] = name[b], end[(b or "")[-lm.ENDING :]]
    cp, bounds = next(X.chunks([t for _, t in rows], 1 << 62))[2:]
    w = lm.Tokens(cp, bounds)
    pair, n = np.unique(w.pairs(cp)[0], return_counts=True)
    plan = lm.Plan(np.ones(len(pair)), pair, n)
    spelled = np.zeros(len(name))
    for s, k, x in zip(w.start, w.size, plan.spelled(w, cp)):
        spelled[name["".join(map(chr, cp[s : s + k]))]] = x
    keys = sorted(grams, key=lambda g: (two[g[1], g[0]], name[g[2]]))
    logs = dict(zip(keys, lm.predict(np.array([two[b, a] for a, b, _ in keys]), one, ending, np.array([name[c] for _, _, c in keys]), spelled, np.array([grams[k] for k in keys]), np.random.default_rng(3))))
    want = np.array([sum(logs[g] for g in of[i]) for i, _ in rows])
    whole = {r.doc_id: r for r in lm.score(d).collect()}
    got = np.array([whole[i].log_prob for i, _ in rows])
    assert np.corrcoef(got, want)[0, 1] > 0.999 and abs(got.sum() / want.sum() - 1) < 0.02
    assert all(whole[i].n_scored == len(t) for i, t in rows)
    many = {r.doc_id: r.log_prob for r in lm.score(d, 20_000, 2_000).collect()}
    split = np.array([many[i] for i, _ in rows])
    assert np.corrcoef(split, got)[0, 1] > 0.99 and abs(split.sum() / got.sum() - 1) < 0.1


def test_lm_tells_documents_that_occur_twice(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("thernaedionis", k=rng.randrange(2, 7))) for _ in range(3000)]
    once = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(150)]
    rows = list(enumerate([*once, *once[:50]]))
    r = {x.doc_id: x.perplexity for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    limit = np.quantile([r[i] for i in range(50, 150)], 0.02)
    assert all(r[i] < limit for i in [*range(50), *range(150, 200)])


def test_seating_has_the_mean_of_the_process():
    """Tables of 200 customers of one dish at base 1 against the exact expectation of the Pitman-Yor process."""
    d, s = lm.DISCOUNT[0], lm.STRENGTH[0]
    t = 1.0
    for n in range(1, 200):
        t += (s + d * t) / (s + n)
    rng = np.random.default_rng(0)
    level = lm.Level(0, np.arange(1))
    seen = []
    for _ in range(2000):
        level.tables[:] = 0
        level.seat(np.array([200.0]), np.array([1.0]), rng)
        seen.append(level.tables[0])
    assert abs(np.mean(seen) - t) < 0.05 * t


def test_bpe_is_that_of_tiktoken(texts):
    import tiktoken

    v = bpe.Vocabulary.load()
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(0)
    ours = [t for _, t, _ in texts] + ["".join(rng.choices("ab cdeé'st  \n\t漢字🙂0123!?ÿ", k=60)) for _ in range(400)] + ["", "a" * 2000, " " * 50]
    enc = bpe.Encoder(v)
    ids, b = enc.encode(ours)
    assert all(ids[s:e].tolist() == ref.encode_ordinary(t) for t, s, e in zip(ours, b, b[1:]))
    assert [x.decode() for x in bpe.decode(v, ids, b)] == ours
    assert 0 < enc.merged < enc.proposed


def test_chat_against_sql_with_snapshots(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for c in range(40):
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "c", None])) for _ in range(rng.randrange(1, 6))]
        for k in range(1, len(turns) + 1):
            if k == len(turns) or rng.random() < 0.6:
                rows += [(n, i, r, t) for i, (r, t) in enumerate(turns[:k])]
                n += 1
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.execute(chat.SQL).fetchall()
    got = [(r.conv_id, r.n_turns, r.text) for r in chat.render(df).collect()]
    assert sorted(got) == sorted(want) and len(got) < n


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "pii", "bpe"]
    out = P.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and 150 < len(ids) <= 200 and all(r.n_tokens == len(r.ids) for r in out)
