"""Media columns: chroma fingerprints of audio, and the alignment of recordings by offset histograms and bit errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X
from skein.llm.jaccard import components

RATE, FRAME, HOP = 2756, 512, 256
WIDTH = 10
#: Equal pairs of adjacent words of two fingerprints at one offset that make a candidate, words that must overlap, and the share of differing bits up to which recordings match.
HITS, OVERLAP, ERRORS = 2, 16, 0.25
#: Kind, lowest pitch class, pitch classes and frames of the filters.
FILTERS = [
    (0, 0, 3, 3), (0, 3, 3, 3), (0, 6, 3, 3), (0, 9, 3, 3), (1, 0, 6, 4), (1, 6, 6, 4), (1, 3, 6, 8), (2, 0, 4, 4),
    (2, 4, 4, 4), (2, 8, 4, 4), (2, 0, 12, 10), (3, 0, 6, 4), (3, 6, 6, 6), (3, 0, 12, 8), (4, 0, 12, 5), (5, 0, 6, 9),
]


def chroma(pcm: np.ndarray) -> np.ndarray:
    """(recordings, frames, 12): the energy of each pitch class in each frame, of length 1; 0 in silence."""
    n, size = pcm.shape
    frames = max(0, (size - FRAME) // HOP + 1)
    if not frames:
        return np.zeros((n, 0, 12), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(pcm, FRAME, axis=1)[:, ::HOP]
    power = np.abs(np.fft.rfft(view * np.hanning(FRAME).astype(np.float32), axis=2)).astype(np.float32)
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    to_class = np.zeros((len(freq), 12), np.float32)
    for b in np.flatnonzero((freq >= 60) & (freq <= 1350)):
        to_class[b, int(round(12 * np.log2(freq[b] / 440))) % 12] = 1
    out = power @ to_class
    norm = np.linalg.norm(out, axis=2, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-3)


def _values(image: np.ndarray) -> np.ndarray:
    """(recordings, words, filters): the log ratio of a filter's two areas, each from four corners of the integral image."""
    n, frames, _ = image.shape
    words = max(0, frames - WIDTH + 1)
    total = np.zeros((n, frames + 1, 13))
    total[:, 1:, 1:] = image.cumsum(1).cumsum(2)
    t = np.arange(words)

    def area(x0, x1, y0, y1):
        s = total[:, t + x1, y1] - total[:, t + x0, y1] - total[:, t + x1, y0] + total[:, t + x0, y0]
        return s / max(1, (x1 - x0) * (y1 - y0))

    out = np.empty((n, words, len(FILTERS)))
    for k, (kind, y, h, w) in enumerate(FILTERS):
        if kind == 0:
            a, b = area(0, w, y, y + h), 0.0
        elif kind == 1:
            a, b = area(0, w, y, y + h // 2), area(0, w, y + h // 2, y + h)
        elif kind == 2:
            a, b = area(0, w // 2, y, y + h), area(w // 2, w, y, y + h)
        elif kind == 3:
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
            b = area(w // 2, w, y, y + h // 2) + area(0, w // 2, y + h // 2, y + h)
        elif kind == 4:
            a, b = area(0, w, y + h // 3, y + 2 * h // 3), area(0, w, y, y + h // 3) + area(0, w, y + 2 * h // 3, y + h)
        else:
            a, b = area(w // 3, 2 * w // 3, y, y + h), area(0, w // 3, y, y + h) + area(2 * w // 3, w, y, y + h)
        out[:, :, k] = np.log1p(a) - np.log1p(b)
    return out.round(6)


def thresholds(seed: int = 11) -> np.ndarray:
    """Quartiles of the filters' values over random melodies, so that all bits are about as often 0 as 1."""
    rng = np.random.default_rng(seed)
    return np.quantile(_values(chroma(render(rng.normal(0, 0.125, (300, 64))))).reshape(-1, len(FILTERS)), (0.25, 0.5, 0.75), axis=0)


def fingerprint(pcm: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(recordings, words) of 32 bits: two, as a Gray code, for the quartile of each filter's value; 0 in silence."""
    image = chroma(pcm)
    v = _values(image)
    level = (v > cuts[0]).astype(np.uint32) + (v > cuts[1]) + (v > cuts[2])
    gray = level ^ (level >> np.uint32(1))
    heard = np.concatenate((np.zeros((len(pcm), 1)), image.sum(2).cumsum(1)), axis=1)
    silent = heard[:, WIDTH : WIDTH + v.shape[1]] <= heard[:, : v.shape[1]]
    return np.where(silent, np.uint32(0), (gray.astype(np.uint32) << np.arange(0, 32, 2, dtype=np.uint32)).sum(2, dtype=np.uint32))


def render(vectors: np.ndarray) -> np.ndarray:
    """(recordings, samples): each number is a note of 256 samples, whose pitch tells in which of four ranges it lies."""
    note = np.digitize(vectors, (-0.085, 0.0, 0.085))
    t = np.arange(HOP) / RATE
    wave = np.stack([np.sin(2 * np.pi * 440 * 2 ** (s / 12) * t) for s in (0, 3, 6, 9)]).astype(np.float32)
    return wave[note].reshape(len(vectors), -1)


def to_pcm(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()


def of_pcm(recordings: list[bytes | None], cuts: np.ndarray) -> list[np.ndarray]:
    """Fingerprints of recordings of any length (16 bit, mono, RATE); none of a null one or one that is too short."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(recordings)
    by_size: dict[int, list[int]] = {}
    for i, r in enumerate(recordings):
        if r:
            by_size.setdefault(len(r) // 2, []).append(i)
    for size, own in by_size.items():
        if size >= FRAME + (WIDTH - 1) * HOP:
            for lo in range(0, len(own), max(1, (1 << 20) // size)):
                part = own[lo : lo + max(1, (1 << 20) // size)]
                pcm = np.stack([np.frombuffer(recordings[i], "<i2", size) for i in part]).astype(np.float32) / 32767
                for i, f in zip(part, fingerprint(pcm, cuts)):
                    out[i] = f
    return out


def fingerprints(audio: DataFrame) -> DataFrame:
    """rec_id, words of a table with rec_id and a binary column audio."""
    held = audio.sparkSession.sparkContext.broadcast(thresholds())

    def run(batches):
        for batch in batches:
            words = of_pcm(batch.column("audio").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array([w.view(np.int32) for w in words], pa.list_(pa.int32()))], names=["rec_id", "words"])

    return X.need(audio, "rec_id", "audio").where("rec_id is not null").mapInArrow(run, "rec_id long, words array<int>")


def align(prints: DataFrame) -> DataFrame:
    """rec_a, rec_b, offset, n_overlap, bit_error: the pairs of recordings (rec_a < rec_b) that match.

    Recordings with two equal words in a row are brought together; of the differences of their places (rec_b starts
    so many words into rec_a) each that HITS places share is verified: at least OVERLAP words must overlap
    and at most ERRORS of their bits differ. Of those that pass, the one of most places is the offset, then that of the
    fewest errors, then the smallest. A match without HITS such places is missed, which
    about one in fourteen has, most of them near the limit of ERRORS. Null ids, null, silent and too short recordings match nothing; of rows
    that repeat a rec_id that with the least words in order counts; an empty table has no row.
    """
    one = prints.where("rec_id is not null and size(words) > 0").groupBy("rec_id").agg(F.min("words").alias("words"))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    two = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda x, y: F.shiftleft(x.cast("long"), 32) + y.cast("long"))
    at = one.select("rec_id", F.posexplode(two).alias("place", "word")).where("word <> 0")
    a, b = (at.select(F.col("rec_id").alias(f"rec_{x}"), F.col("place").alias(f"place_{x}"), "word") for x in "ab")
    hits = a.join(b, "word").where("rec_a < rec_b").groupBy("rec_a", "rec_b", (F.col("place_a") - F.col("place_b")).alias("offset")).agg(F.count("*").alias("hits")).where(F.col("hits") >= HITS)
    wa, wb = (one.select(F.col("rec_id").alias(f"rec_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    begin_a, begin_b = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    both = hits.join(wa, "rec_a").join(wb, "rec_b").withColumn("n_overlap", F.least(F.size("words_a") - begin_a, F.size("words_b") - begin_b))
    differ = F.aggregate(F.zip_with(F.slice("words_a", begin_a + 1, F.col("n_overlap")), F.slice("words_b", begin_b + 1, F.col("n_overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit((1 << 32) - 1)))), F.lit(0), lambda s, x: s + x)
    good = both.where(F.col("n_overlap") >= OVERLAP).withColumn("bit_error", F.round(differ / (F.col("n_overlap") * 32), 6)).where(F.col("bit_error") <= ERRORS)
    best = good.groupBy("rec_a", "rec_b").agg(F.min(F.struct((-F.col("hits")).alias("h"), "bit_error", "offset", "n_overlap")).alias("m"))
    return best.select("rec_a", "rec_b", "m.offset", "m.n_overlap", "m.bit_error")


def classes(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """rec_id, class_id, n_links, best_id, offset, n_overlap, bit_error: a row for each recording.

    class_id: the smallest rec_id of those it hangs together with by pairs of align(), n_links: in how many pairs it is; best_id: the
    one of the fewest errors, then the longest overlap, then the smallest rec_id, which starts offset words into it. A recording that matches none is a
    class of its own, its last four columns are null.
    """
    X.checkpoint_dir(spark)
    prints = prints.where("rec_id is not null").checkpoint()
    pairs = align(prints).checkpoint()
    both = pairs.union(pairs.select("rec_b", "rec_a", -F.col("offset"), "n_overlap", "bit_error"))
    best = F.min(F.struct("bit_error", (-F.col("n_overlap")).alias("less"), "rec_b", "offset"))
    links = both.groupBy(F.col("rec_a").alias("of")).agg(F.count("*").alias("links"), best.alias("m"))
    ids = prints.select("rec_id").distinct()
    roots = components(spark, pairs.select(F.col("rec_a").alias("a"), F.col("rec_b").alias("b")))
    return (
        ids.join(roots, F.col("rec_id") == F.col("doc"), "left").join(links, F.col("rec_id") == F.col("of"), "left")
        .select("rec_id", F.coalesce("root", "rec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("m.rec_b").alias("best_id"), "m.offset", (-F.col("m.less")).alias("n_overlap"), "m.bit_error")
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rendered from all embeddings, 64 notes each, fingerprinted and aligned: a row for each."""
    rows = X.need(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").where("vec_id is not null and embedding is not null")

    held = spark.sparkContext.broadcast(thresholds())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                words = of_pcm([to_pcm(render(np.array([v], np.float64))[0]) for v in part.column("embedding").to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([w.view(np.int32) for w in words], pa.list_(pa.int32()))], names=["rec_id", "words"])

    return classes(spark, rows.mapInArrow(run, "rec_id long, words array<int>"))
