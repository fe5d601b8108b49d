"""PII: character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X
from skein.llm.decontam import replace_text

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET")
HIDDEN = 8
CLASSES = 98
#: Windows of WINDOW characters overlap by twice MARGIN; a character gets its label from the window in which it is further from the edge.
WINDOW, MARGIN = 768, 64
#: Documents, about, whose prose surrounds the labelled spans of the training set.
TRAIN_DOCS = 600
#: Characters of each of them that go to the driver.
PROSE = 4000


def _classes() -> np.ndarray:
    table = np.full(X.TABLE, 97, np.uint8)
    for i in range(X.TABLE):
        if 33 <= i < 127:
            table[i] = i - 32
        elif not 0xD800 <= i < 0xE000:
            c = chr(i)
            if c.isspace():
                table[i] = 0
            elif c.isalpha():
                table[i] = 96 if c.isupper() else 95
    return table


_table: list[np.ndarray] = []


def classes(cp: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append(_classes())
    return _table[0][np.minimum(cp, X.TABLE - 1)]


# --- labelled spans ---------------------------------------------------------


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _ip(r: random.Random) -> str:
    return ".".join(str(r.choice((r.randrange(256), r.randrange(1, 100), r.randrange(10)))) for _ in range(4))


def _span(r: random.Random, label: str, word: str) -> tuple[str, str, str]:
    """Text before, in and after a span of a label."""
    if label == "EMAIL":
        user = r.choice((word, word + "." + word[::-1], word + _digits(r, 2), word + "." + _digits(r, 2), word[:1] + "_" + word, _digits(r, 2), word + "." + _digits(r, 3)))
        host = r.choice(("mail" + _digits(r, 1) + ".example.com", word + ".org", "mail.example.de", "gmail.com", word[::-1] + ".co.uk", "example.net", word + "-" + word[::-1] + ".fr"))
        return r.choice(("", "", "", "<", "mailto:", "(")), (user + "@" + host).strip(".-_@") or "a@b.com", ""
    if label == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return "", r.choice((f"+1 ({a}) {b}-{c}",) * 4 + (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 7)}", f"+33 {r.randrange(1, 10)} " + " ".join(_digits(r, 2) for _ in range(4)), f"+49 {a} {b}{c}", f"{a}.{b}.{c}", f"+34 {a} {b} {_digits(r, 3)}")), ""
    if label == "IP":
        return "", _ip(r), r.choice(("", "", "", ":" + _digits(r, 4)))
    if label == "CARD":
        n = _digits(r, 16)
        return "", r.choice((n, n, n, " ".join(n[i : i + 4] for i in (0, 4, 8, 12)), "-".join(n[i : i + 4] for i in (0, 4, 8, 12)), n[:15])), ""
    value = "".join(r.choice(r.choice(("0123456789abcdef",) * 3 + (string.ascii_letters + string.digits,))) for _ in range(r.choice((32, 40, 40, 40, 64))))
    if r.random() < 0.3:
        alphabet = string.ascii_letters + string.digits
        value = r.choice(("AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16)), "sk-" + "".join(r.choice(alphabet) for _ in range(40)), "ghp_" + "".join(r.choice(alphabet) for _ in range(36))))
    name = r.choice(("token", "token", "token", "api_key", "secret", "password", "key"))
    before, after = r.choice((('{} = "', '"'),) * 4 + (("{}: ", ""), ("{}=", ""), ("{} = '", "'"), ('"{}": "', '"')))
    return before.format(name), value, after


def _plain(r: random.Random) -> str:
    """Something with digits or signs that is no PII."""
    y = r.choice((str(r.randrange(1900, 2100)), _digits(r, 1), _digits(r, 2), _digits(r, 3)))
    return r.choice((y, y, y + ".", f"{r.randrange(10)}.{r.randrange(10)}", f"v{r.randrange(10)}.{r.randrange(20)}.{r.randrange(10)}", f"{y}-{r.randrange(10, 13)}-{r.randrange(10, 30)}", f"{r.randrange(24)}:{r.randrange(10, 60)}", f"{r.randrange(1, 100)}%", f"({y})", f"${r.randrange(1000)}.99", f"{r.randrange(1, 999)},{_digits(r, 3)}", f"[{y}]", f"#{y}", f"{_digits(r, 5)}", f"({_digits(r, 1)})", 'key = "value"', "token", "@", "http://www.example.com/a", f"{r.randrange(1, 9)}. ", f"Section {r.randrange(9)}.{r.randrange(9)}"))


def examples(prose: list[str], count: int, length: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Windows of prose without digits into which labelled spans, and things that look like them, are put."""
    r = random.Random(seed)
    pool = [t for t in prose if len(t) > 20] or ["the and of to in is that for"]
    texts, labels = [], np.zeros((count, length), np.int64)
    for k in range(count):
        t = r.choice(pool)
        at = r.randrange(max(1, len(t) - length))
        t = re.sub(r"[0-9@]", "", t[at : at + length]) or "the"
        words = t.split(" ")
        out, tags = [], []
        for w in [*words, *words, *words][: max(len(words), 12)]:
            parts = [(w, 0)]
            p = r.random()
            junk = r.choice(("", "", ".", ",", "###", "$$$", "%%%", "&&&", "***", "!!", " |", ")", ";"))
            inner = re.sub(r"[^a-zA-Z]", "", w).lower() or "info"
            if p < 0.12:
                label = r.randrange(1, len(LABELS))
                before, value, after = _span(r, LABELS[label], inner)
                if r.random() < 0.1 and label != 5:
                    value = value.upper()
                parts += [(" " if r.random() < 0.8 or label != 1 else "", 0), (before, 0), (value, label), (after + junk, 0)]
            elif p < 0.2:
                parts += [(" " + _plain(r) + junk, 0)]
            for s, label in [*parts, (" ", 0)]:
                out.append(s)
                tags += [label] * len(s)
        cut = r.randrange(max(1, len(tags) - length))
        text = "".join(out)[cut : cut + length].ljust(length)
        got = tags[cut : cut + length]
        labels[k, : len(got)] = got
        texts.append(text)
    return texts, labels


# --- network ----------------------------------------------------------------


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """Two LSTMs over character classes, with softsign gates, and a linear-chain CRF over their states.

    Arrays are (features, windows) at each step. x: input to the gates (in, forget, out, cell) of each
    class; u: from the state before; w, b: emissions; a: transitions.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
        self.h = hidden
        self.p = {"xf": f(4 * hidden, CLASSES), "xb": f(4 * hidden, CLASSES), "uf": f(4 * hidden, hidden), "ub": f(4 * hidden, hidden), "w": f(len(LABELS), 2 * hidden), "b": f(len(LABELS), 1), "a": f(len(LABELS), len(LABELS), k=0.1)}
        for x in ("xf", "xb"):
            self.p[x][hidden : 2 * hidden] += 1

    def _states(self, code: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (steps, hidden, windows) for classes (steps, windows), read forward."""
        h, x, u = self.h, self.p["x" + side], self.p["u" + side]
        steps, n = code.shape
        out = np.empty((steps, h, n), np.float32)
        state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        pre, gate = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        for t in range(steps):
            np.take(x, code[t], axis=1, out=pre, mode="clip")
            pre += np.matmul(u, state, out=gate)
            np.abs(pre, out=gate)
            gate += 1
            pre /= gate
            if keep is not None:
                keep.append((pre.copy(), cell))
            pre[: 3 * h] += 1
            cell = pre[h : 2 * h] * cell
            cell += np.multiply(pre[:h], pre[3 * h :], out=gate[:h])
            cell *= 0.5
            np.abs(cell, out=gate[:h])
            gate[:h] += 1
            gate[:h] *= 2
            state = np.multiply(pre[2 * h : 3 * h], cell, out=out[t])
            state /= gate[:h]
        return out

    def emissions(self, code: np.ndarray) -> np.ndarray:
        """(steps, labels, windows)."""
        e = np.matmul(self.p["w"][:, : self.h], self._states(code, "f"))
        e += np.matmul(self.p["w"][:, self.h :], self._states(np.ascontiguousarray(code[::-1]), "b"))[::-1]
        return e + self.p["b"]

    def _back(self, code: np.ndarray, side: str, keep: list, out: np.ndarray, grad: np.ndarray) -> dict:
        h, u = self.h, self.p["u" + side]
        steps, n = code.shape
        dpre, du = np.empty((steps, 4 * h, n), np.float32), np.zeros_like(u)
        dh, dc = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
        for t in range(steps - 1, -1, -1):
            s, before = keep[t]
            gate = (s[: 3 * h] + 1) * 0.5
            slope = (1 - np.abs(s)) ** 2
            cell = gate[h : 2 * h] * before + gate[:h] * s[3 * h :]
            sc = _soft(cell)
            d = grad[t] + dh
            dc = dc + d * gate[2 * h :] * (1 - np.abs(sc)) ** 2
            g = np.concatenate((dc * s[3 * h :] * 0.5, dc * before * 0.5, d * sc * 0.5, dc * gate[:h])) * slope
            dc = dc * gate[h : 2 * h]
            dpre[t] = g
            if t:
                du += g @ out[t - 1].T
            dh = u.T @ g
        flat, c = dpre.transpose(1, 0, 2).reshape(4 * h, -1), code.ravel()
        return {"x" + side: np.stack([np.bincount(c, row, CLASSES) for row in flat]).astype(np.float32), "u" + side: du}

    def step(self, code: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of windows (steps, windows) with their labels."""
        kf, kb = [], []
        back = np.ascontiguousarray(code[::-1])
        of, ob = self._states(code, "f", kf), self._states(back, "b", kb)
        hs = np.concatenate((of, ob[::-1]), axis=1)
        e = (np.matmul(self.p["w"], hs) + self.p["b"]).transpose(0, 2, 1).astype(np.float64)
        a, (steps, n, k) = self.p["a"].astype(np.float64), e.shape
        ea = np.exp(a)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            m = alpha[t - 1].max(1, keepdims=True)
            alpha[t] = e[t] + m + np.log(np.exp(alpha[t - 1] - m) @ ea)
        for t in range(steps - 2, -1, -1):
            v = beta[t + 1] + e[t + 1]
            m = v.max(1, keepdims=True)
            beta[t] = m + np.log(np.exp(v - m) @ ea.T)
        z = np.logaddexp.reduce(alpha[-1], axis=1)
        marginal = np.exp(alpha + beta - z[None, :, None])
        left = np.exp(alpha[:-1] - alpha[:-1].max(2, keepdims=True))
        right = np.exp((beta[1:] + e[1:]) - (beta[1:] + e[1:]).max(2, keepdims=True))
        pair = left[:, :, :, None] * ea * right[:, :, None, :]
        da = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
        one = np.eye(k)[gold]
        np.subtract.at(da, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        at = np.arange(n)
        path = sum(e[t, at, gold[t]] for t in range(steps)) + a[gold[:-1], gold[1:]].sum(0)
        de = ((marginal - one) / (n * steps)).transpose(0, 2, 1).astype(np.float32)
        dh = np.matmul(self.p["w"].T, de)
        grads = {"w": np.einsum("tkn,thn->kh", de, hs), "b": de.sum((0, 2))[:, None], "a": (da / (n * steps)).astype(np.float32)}
        grads |= self._back(code, "f", kf, of, dh[:, : self.h]) | self._back(back, "b", kb, ob, dh[::-1, self.h :])
        return float((z - path).mean() / steps), grads

    def train(self, texts: list[str], labels: np.ndarray, steps: int = 450, batch: int = 64, seed: int = 3) -> Tagger:
        code = np.stack([classes(np.frombuffer(t.encode("utf-32-le", "replace"), "<u4")) for t in texts]).astype(np.int64)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(code), batch)
            _, grads = self.step(np.ascontiguousarray(code[pick].T), labels[pick].T)
            rate = 0.03 * (1 - 0.9 * i / steps)
            for key, g in grads.items():
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.99 * v[key] + 0.01 * g * g
                self.p[key] -= (rate * (m[key] / (1 - 0.9**i)) / (np.sqrt(v[key] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best labels (steps, windows).

        A window in which every stretch of other labels must lose against O, even with the best label at each of
        its characters and the best transitions, isn't searched: its best path is all O.
        """
        a, (steps, k, n) = self.p["a"] - self.p["a"][0, 0], e.shape
        out = np.zeros((steps, n), np.int8)
        stay, enter, leave = float(a[1:, 1:].max()), float(a[0, 1:].max()), float(a[1:, 0].max())
        most = e[:, 1].copy()
        for label in range(2, k):
            np.maximum(most, e[:, label], out=most)
        most += stay - e[:, 0]
        most[0] -= enter
        most[-1] -= leave
        total = np.cumsum(most, axis=0, dtype=np.float64)
        before = np.minimum.accumulate(np.concatenate((np.zeros((1, n)), total[:-1])), axis=0)
        search = np.flatnonzero((total - before).max(0) >= stay - enter - leave - 1e-3)
        if not len(search):
            return out
        e = np.ascontiguousarray(e[:, :, search].transpose(0, 2, 1))
        best, came = e[0], np.empty((steps, len(search), k), np.int8)
        for t in range(1, steps):
            score = best[:, :, None] + a
            came[t] = score.argmax(1)
            best = score.max(1) + e[t]
        label, at = best.argmax(1), np.arange(len(search))
        for t in range(steps - 1, -1, -1):
            out[t, search] = label
            label = came[t, at, label] if t else label
        return out


def labels_of(model: Tagger, cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The label of each character of a chunk of documents, whose windows don't cross."""
    code, out = classes(cp), np.zeros(len(cp), np.int8)
    stride = WINDOW - 2 * MARGIN
    size = np.diff(bounds)
    count = np.where(size > 0, np.maximum(1, -(-(size - 2 * MARGIN) // stride)), 0)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][doc] + nth * stride
    length = np.minimum(bounds[1:][doc] - start, WINDOW)
    core_lo = np.where(nth == 0, 0, MARGIN)
    core_hi = np.where(nth == count[doc] - 1, length, WINDOW - MARGIN)
    pad = WINDOW // 4
    for steps in range(pad, WINDOW + 1, pad):
        own = np.flatnonzero((length > steps - pad) & (length <= steps))
        for lo in range(0, len(own), 2048):
            w = own[lo : lo + 2048]
            place = start[w][None, :] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < length[w][None, :]
            found = model.viterbi(model.emissions(np.where(inside, code[np.minimum(place, len(cp) - 1)], 0).astype(np.intp)))
            take = (np.arange(steps)[:, None] >= core_lo[w][None, :]) & (np.arange(steps)[:, None] < core_hi[w][None, :]) & (found > 0)
            out[place[take]] = found[take]
    return out


def _valid(label: str, value: str) -> bool:
    n = sum(c.isdigit() for c in value)
    if label == "EMAIL":
        return "@" in value[1:-1]
    if label == "SECRET":
        return len(value) >= 16
    return {"PHONE": 7, "IP": 4, "CARD": 12}[label] <= n


def find(texts: list[str | None], model: Tagger):
    """(row, [(start, end, label)]) of each text with PII."""
    for lo, _, cp, bounds in X.chunks(texts, 2 * X.CHUNK_CHARS):
        tag = labels_of(model, cp, bounds)
        edge = np.zeros(len(tag) + 1, bool)
        edge[bounds] = True
        edge[1:-1] |= tag[1:] != tag[:-1]
        cuts = np.flatnonzero(edge)
        rows: dict[int, list] = {}
        for k in np.flatnonzero(tag[cuts[:-1]] > 0) if len(tag) else ():
            s, e, label = int(cuts[k]), int(cuts[k + 1]), LABELS[tag[cuts[k]]]
            d = int(np.searchsorted(bounds, s, "right")) - 1
            s, e = s - int(bounds[d]), e - int(bounds[d])
            value = texts[lo + d][s:e]
            s, e = s + len(value) - len(value.lstrip()), e - len(value) + len(value.rstrip())
            if s < e and _valid(label, texts[lo + d][s:e]):
                rows.setdefault(d, []).append((s, e, label))
        for d, spans in sorted(rows.items()):
            yield lo + d, spans


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, label in spans:
        out += [text[at:s], f"[{label}]"]
        at = e
    return "".join([*out, text[at:]])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, prose_chars: int = PROSE, seed: int = 5) -> Tagger:
    """A tagger fitted on labelled spans put into the prose of about train_docs documents.

    Documents, and the place in each from which prose_chars characters are taken, are chosen by hashes of doc_id and text.
    """
    rows = X.need(docs, "doc_id", "text").where("text is not null")
    n = max(1, rows.count())
    share = max(1, min(1_000_000, 1_000_000 * train_docs // n))
    name = F.xxhash64("doc_id", "text")
    room = F.greatest(F.length("text") - F.lit(prose_chars), F.lit(0)) + 1
    at = (F.pmod(F.xxhash64(name), room.cast("long")) + 1).cast("int")
    prose = rows.where(F.pmod(name, F.lit(1_000_000)) < share).select(name.alias("name"), F.substr(F.col("text"), at, F.lit(prose_chars)).alias("text")).distinct().collect()
    return Tagger().train(*examples([r["text"] for r in sorted(prose)], 4000, 96, seed))


_SPANS = "array<struct<start:int,end:int,label:string>>"


def detect(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, n_spans, spans, clean_text: one row for each row of docs with PII.

    Whole texts are read, in overlapping windows; a span may cross them. Spans are character offsets with a
    label; a span that can't be of its label (an e-mail address without "@", a number with too few digits) is dropped.
    clean_text has the label in place of each span. Null, empty and clean texts have no row; repeated rows have
    one each; a null doc_id is kept. Of an empty table nothing is learned and nothing found.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, train_docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_spans", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))), ("clean_text", pa.string())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            rows = [{"doc_id": ids[r].as_py(), "n_spans": len(s), "spans": [dict(zip(("start", "end", "label"), x)) for x in s], "clean_text": mask(texts[r], s)} for r, s in find(texts, held.value)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return X.need(docs, "doc_id", "text").mapInArrow(run, f"doc_id long, n_spans int, spans {_SPANS}, clean_text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with PII masked; all rows, same columns, n_chars follows the text.

    Null and empty texts stay as they are, as do all other columns; repeated rows are masked each on its own. Of an empty table nothing is learned.
    """
    held = spark.sparkContext.broadcast(train(docs))
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            found = dict(find(texts, held.value))
            yield replace_text(batch, names, [mask(t, found[r]) if r in found else t for r, t in enumerate(texts)]) if found else batch

    return X.map_rows(docs, run)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
