"""N-gram Jaccard self-join: parity sketches, joined by pigeonhole in size bands, verified exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import _text as X

N = 2
THRESHOLD = 0.6
#: Blocks of a sketch that are joined, and n-grams that fall into one block on average.
SLOTS = 28
PER_BLOCK = 3
#: Blocks of fewer n-grams aren't joined, but in the bands of sets up to SMALL: one frequent n-gram would bring unrelated documents together.
LEAST, SMALL = 2, 8
#: Documents and n-grams of a tile; the tiles of a larger group are compared two by two.
TILE, ELEMENTS = 1 << 14, 1 << 22
#: Low bits of a block's name that tell the size band.
BAND = 127
_ELEMENT = np.uint64((1 << 40) - 1)


def sets(w: X.Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk's documents as (document << 40 | hash), sorted, and the bounds of the documents.

    A document with fewer than n words, but not none, has one n-gram of all its words.
    """
    at, h = w.ngrams(n)
    d = w.docs()[at] if len(at) else np.zeros(0, np.int64)
    size = np.diff(w.bounds)
    for m in range(1, n):
        if (size == m).any():
            a, g = w.ngrams(m)
            own = w.docs()[a]
            pick = size[own] == m
            d, h = np.concatenate((d, own[pick])), np.concatenate((h, g[pick]))
    key = np.unique((d.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return key, np.searchsorted(key, np.arange(len(size) + 1).astype(np.uint64) << np.uint64(40))


def blocks_of(band: np.ndarray, threshold: float) -> np.ndarray:
    """Blocks of the sketches of a size band.

    The Hamming distance of two sketches is at most the symmetric difference d
    of the sets, d <= (1 - t) / (1 + t) * (a + b) from a Jaccard of t on; so in d + 1 blocks
    one is equal. Large sets have fewer blocks than that: an equal block is
    then likely in each of the slots, not certain (see similar()).
    """
    most = (1 / threshold) ** (band + 1.0)
    d = np.floor((1 - threshold) / (1 + threshold) * 2 * most + 1e-9)
    return np.maximum(np.ceil(most / PER_BLOCK), np.minimum(d + 1, 8)).astype(np.int64)


def sketch_keys(key: np.ndarray, bounds: np.ndarray, threshold: float = THRESHOLD, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of each block that is joined.

    Each n-gram flips one of 2 ** 20 bits of its block; a block is named by the
    XOR of its set bits' hashes. Blocks of fewer than LEAST n-grams aren't joined. Sketches of few blocks are
    repeated with other hashes until all slots are used.
    """
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    element = key & _ELEMENT
    out_d, out_k = [], []
    band0 = np.floor(np.log(np.maximum(size, 1)) / -np.log(threshold) + 1e-9).astype(np.int64)
    for up in (0, 1):
        blocks = blocks_of(band0 + up, threshold)
        rounds = -(-slots // blocks)
        small = (1 / threshold) ** (band0 + up + 1.0) <= SMALL
        pick = np.arange(len(doc))
        for r in range(int(rounds.max(initial=0))):
            pick = pick[rounds[doc[pick]] > r]
            if not len(pick):
                break
            d = doc[pick]
            h = X.mix(element[pick] + np.uint64(0x632BE59BD9B4E019 * (2 * r + 1) & (1 << 64) - 1))
            k = blocks[d]
            slot = r * k + ((h >> np.uint64(32)).astype(np.int64) * k >> 32)
            use = np.flatnonzero(slot < slots)
            if not len(use):
                continue
            bit = X.mix((h[use] & np.uint64((1 << 20) - 1)) + np.uint64(0x9FB21C651E98DF25))
            at = d[use] * slots + slot[use]
            order = np.argsort(at, kind="stable")
            at, bit = at[order], bit[order]
            begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            name = np.bitwise_xor.reduceat(bit, begin)
            filled = np.diff(np.concatenate((begin, [len(at)])))
            at = at[begin]
            good = (name != 0) & ((filled >= LEAST) | (small[at // slots]))
            at, name = at[good], name[good]
            band = band0[at // slots] + up
            out_d.append(at // slots)
            out_k.append(X.mix(name ^ X.mix((band * 64 + at % slots).astype(np.uint64) + np.uint64(77))) & ~np.uint64(BAND) | np.minimum(band, BAND).astype(np.uint64))
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_d), np.concatenate(out_k)


def _sketches(batches, n, threshold, slots):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, _, cp, bounds in X.chunks(batch.column("text").to_pylist()):
            d, k = sketch_keys(*sets(X.Words(cp, bounds), n), threshold, slots)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(ids[lo + d].astype(np.int64))], names=["key", "doc"])


def _with_sets(batches, n):
    for batch in batches:
        ids, leads = batch.column("doc_id"), batch.column("leads")
        for lo, hi, cp, bounds in X.chunks(batch.column("text").to_pylist()):
            key, b = sets(X.Words(cp, bounds), n)
            raw = np.ascontiguousarray((key & _ELEMENT).view(np.uint8).reshape(-1, 8)[:, :5])
            packed = [raw[b[i] : b[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([ids[lo:hi], leads[lo:hi], pa.array(packed, pa.binary())], names=["doc", "leads", "elements"])


class Group:
    """Sets of a group's documents: elements as columns, bounds of the documents, sizes. Equal rows count once.

    A pair is compared if its parity sketches allow it: their Hamming distance is at most the
    symmetric difference of the sets, which a Jaccard of the threshold bounds; so nothing similar is lost.
    Of pairs that come together in several groups those of the smallest lead are compared.
    """

    def __init__(self, rows: pa.Table, threshold: float):
        rows = rows.combine_chunks()
        self.doc = rows.column("doc").to_numpy()
        if len(np.unique(self.doc)) < len(self.doc):
            first = {x: i for i, x in reversed(list(enumerate(zip(self.doc.tolist(), rows.column("elements").to_pylist()))))}
            rows = rows.take(pa.array(sorted(first.values()))).combine_chunks()
            self.doc = rows.column("doc").to_numpy()
        self.threshold, self.n = threshold, len(self.doc)
        packed = rows.column("elements").chunk(0)
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + self.n + 1].astype(np.int64)
        self.element = np.zeros(((offsets[-1] - offsets[0]) // 5, 8), np.uint8)
        self.element[:, :5] = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 5)
        self.element = self.element.view(np.uint64).ravel()
        self.bounds = (offsets - offsets[0]) // 5
        self.size = np.diff(self.bounds)
        self.tile = rows.column("tile").to_numpy() if rows.column("tile_a")[0] != rows.column("tile_b")[0] else None
        lead, self.smaller, held = rows.column("lead")[0].as_py(), {}, {}
        for i, leads in enumerate(rows.column("leads").to_pylist()):
            for x in leads:
                if x < lead:
                    self.smaller.setdefault(i, []).append(x)
                    held.setdefault(x, []).append(i)
        self.held = {x: np.array(own) for x, own in held.items()}

    def sketches(self) -> np.ndarray:
        """(documents, bits) of 1 and -1, about twice as many bits as a set has elements."""
        bits = 1 << max(6, int(np.ceil(np.log2(2 * max(1, len(self.element)) / self.n))))
        place = (X.mix(self.element + np.uint64(0xD1B54A32D192ED03)) & np.uint64(bits - 1)).astype(np.int64)
        out, step = np.empty((self.n, bits), np.int8), max(1, (1 << 22) // bits)
        for lo in range(0, self.n, step):
            hi = min(self.n, lo + step)
            own = np.repeat(np.arange(hi - lo), self.size[lo:hi]) * bits + place[self.bounds[lo] : self.bounds[hi]]
            out[lo:hi] = 1 - 2 * (np.bincount(own, minlength=(hi - lo) * bits) & 1).reshape(hi - lo, bits)
        return out

    def candidates(self):
        """Yields a document and those of the others that may be similar to it; each pair comes once."""
        sign, share = self.sketches(), (1 - self.threshold) / (1 + self.threshold)
        bits = sign.shape[1]
        turn = np.argsort(self.size, kind="stable")
        size = self.size[turn]
        most = np.searchsorted(size, size / self.threshold + 1e-6, "right")
        rows, width = 256, max(256, (1 << 21) // bits)
        for r in range(0, self.n, rows):
            own = turn[r : r + rows]
            a, found_i, found_j = sign[own].astype(np.float32), [], []
            for c in range(r, int(most[min(self.n, r + rows) - 1]), width):
                other = turn[c : c + width]
                room = share * (size[r : r + rows, None] + size[None, c : c + width]) + 1e-6
                near = bits - a @ sign[other].T.astype(np.float32) <= 2 * room
                near &= np.arange(c, c + len(other))[None, :] > np.arange(r, r + len(own))[:, None]
                if self.tile is not None:
                    near &= self.tile[own][:, None] != self.tile[other][None, :]
                i, j = np.nonzero(near)
                found_i.append(i)
                found_j.append(other[j])
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            order = np.argsort(i, kind="stable")
            cut = np.searchsorted(i[order], np.arange(len(own) + 1))
            j = j[order]
            for k, x in enumerate(own.tolist()):
                y = j[cut[k] : cut[k + 1]]
                y = y[self.doc[y] != self.doc[x]]
                if len(y) and x in self.smaller:
                    elsewhere = np.zeros(self.n, bool)
                    for lead in self.smaller[x]:
                        elsewhere[self.held[lead]] = True
                    y = y[~elsewhere[y]]
                if len(y):
                    yield x, y

    def jaccards(self, x: int, y: np.ndarray) -> np.ndarray:
        """The Jaccards of a document and others."""
        if not hasattr(self, "column"):
            distinct, column = np.unique(self.element, return_inverse=True)
            self.column, self.has = column.astype(np.int32), np.zeros(len(distinct), np.int8)
        own = self.column[self.bounds[x] : self.bounds[x + 1]]
        self.has[own] = 1
        both = np.empty(len(y))
        ends = np.cumsum(self.size[y])
        lo = 0
        while lo < len(y):  # a million elements at a time
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + (1 << 20), "right")))
            size = self.size[y[lo:hi]]
            begin = np.cumsum(size) - size
            at = np.arange(begin[-1] + size[-1]) + np.repeat(self.bounds[y[lo:hi]] - begin, size)
            both[lo:hi] = np.add.reduceat(self.has[self.column[at]], begin, dtype=np.int64)
            lo = hi
        self.has[own] = 0
        return both / (self.size[x] + self.size[y] - both)


def _pairs(rows: pa.Table, threshold: float) -> pa.Table:
    group, out = Group(rows, threshold), []
    for x, y in group.candidates():
        j = group.jaccards(x, y)
        use = j >= threshold - 1e-9
        a, b = group.doc[x], group.doc[y[use]]
        out.append((np.minimum(a, b), np.maximum(a, b), j[use].round(6)))
    a, b, j = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
    found = pd.DataFrame({"doc_a": a.astype(np.int64), "doc_b": b.astype(np.int64), "jaccard": j.astype(np.float64)})
    return pa.Table.from_pandas(found.groupby(["doc_a", "doc_b"], as_index=False).max() if len(np.unique(group.doc)) < group.n else found, preserve_index=False)


def _linked(rows: pa.Table, threshold: float, count: bool) -> pa.Table:
    """Each document of a group with one that it hangs together with, the smallest, and its number of links; without count only of pairs that don't hang together yet."""
    group = Group(rows, threshold)
    _, name = np.unique(group.doc, return_inverse=True)
    label, links = name.copy(), np.zeros(int(name.max()) + 1, np.int64)
    smallest = np.unique(group.doc)
    once = len(smallest) < group.n
    seen: set[tuple[int, int]] = set()
    for x, y in group.candidates():
        if not count:
            y = y[label[y] != label[x]]
            if not len(y):
                continue
        y = y[group.jaccards(x, y) >= threshold - 1e-9]
        if not len(y):
            continue
        if count:
            partner = name[y]
            if once:  # rows that repeat a doc_id are one document
                new = {(min(name[x], z), max(name[x], z)) for z in partner.tolist()} - seen
                seen |= new
                partner = np.array([a + b - name[x] for a, b in new], np.int64)
            links[name[x]] += len(partner)
            np.add.at(links, partner, 1)
        one = np.unique(np.append(label[y], label[x]))
        if len(one) > 1:
            label[np.isin(label, one)] = one[0]
    root = np.zeros(len(smallest), np.int64)
    root[name] = label
    use = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
    return pa.table({"a": smallest[use], "b": smallest[root[use]], "links": links[use]})


def groups(docs: DataFrame, n: int, threshold: float, slots: int) -> DataFrame:
    """Groups of documents that hold every candidate pair: lead, doc, leads, elements, tile, tile_a, tile_b.

    Of a block that several documents have, the smallest doc_id is the lead; the
    lead of most of a document's blocks is its home, and a block belongs to the
    smallest home of its documents. So documents with an equal block are in one group, a hot
    block costs a row a document, not one a pair, and nearly all blocks of near copies
    lead to the same group, which gets the set of each once.
    """
    rows = X.need(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    keys = rows.mapInArrow(lambda b: _sketches(b, n, threshold, slots), "key long, doc long")
    by_key = Window.partitionBy("key").orderBy("doc")
    shared = (
        keys.withColumn("lead", F.first("doc").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next", F.lead("doc").over(by_key))
        .where("lead <> doc or next is not null").select("key", "doc", "lead")
    )
    leads = F.transform("blocks", lambda x: x["lead"])
    votes = F.transform(F.array_distinct(leads), lambda x: F.named_struct(F.lit("n"), F.size(F.filter(leads, lambda y: y == x)), F.lit("less"), -x))
    homes = (
        shared.groupBy("doc").agg(F.collect_list(F.struct("key", "lead")).alias("blocks"))
        .select("doc", (-F.array_max(votes)["less"]).alias("home"), F.explode("blocks.key").alias("key"))
    )
    member = homes.withColumn("lead", F.min("home").over(Window.partitionBy("key").orderBy("home").rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("lead", "doc").agg(F.min(F.col("key").bitwiseAND(F.lit(BAND))).alias("band"))
    most = F.sum(F.pow(F.lit(1 / threshold), F.col("band") + 1))
    use = member.groupBy("lead").agg(F.count("*").alias("n"), most.alias("elements")).where("n > 1").select("lead", F.ceil(F.greatest(F.col("n") / TILE, F.col("elements") / ELEMENTS)).cast("int").alias("tiles"))
    by_doc = member.join(use, "lead").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("lead", "tiles"))).alias("leads"))
    held = rows.join(by_doc, rows["doc_id"] == by_doc["doc"]).select("doc_id", "text", "leads")
    held = held.mapInArrow(lambda b: _with_sets(b, n), "doc long, leads array<struct<lead:long,tiles:int>>, elements binary")
    return (
        held.select("doc", F.transform("leads", lambda x: x["lead"]).alias("leads"), "elements", F.explode("leads").alias("to"))
        .withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("to.tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to.tiles") - 1)))
        .select(F.col("to.lead").alias("lead"), "doc", "leads", "elements", "tile", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"))
    )


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, slots: int = SLOTS) -> DataFrame:
    """doc_a, doc_b, jaccard: the pairs (doc_a < doc_b) whose sets of word n-grams have a Jaccard of threshold or more.

    Jaccards are those of 40-bit hashes of the n-grams. Candidates come from sketches: a pair is missed only if
    all its joined blocks differ, at the threshold itself in about one case of 100,
    far above it never. Every document is compared, with any number of partners.
    Words are runs of letters and digits in lower case; a text of fewer than n words
    has one n-gram, one without words is similar to none. Null doc_ids and null
    texts have no pairs, an empty table has none; rows with the same doc_id are one document, as similar to another
    as the most similar of its texts.
    """
    held = groups(docs, n, threshold, slots)
    return held.groupBy("lead", "tile_a", "tile_b").applyInArrow(lambda g: _pairs(g, threshold), "doc_a long, doc_b long, jaccard double")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """doc, root: the smallest doc of the connected component, for all docs but the roots.

    Large-star and small-star steps, whose number grows with the logarithm of the
    size; each is checkpointed, so that a lost executor costs one step.
    """
    X.checkpoint_dir(spark)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.min("b").over(Window.partitionBy("a"))
        large = both.withColumn("m", F.least("a", low)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = F.min("b").over(Window.partitionBy("a"))
        star = large.withColumn("m", m)
        edges = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("doc"), F.col("b").alias("root"))
        mark = now


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group that hangs together by similar pairs; same columns.

    Of rows with the same doc_id and the same text one stays, rows with the same doc_id and another text all stay or go with it.
    Rows with a null doc_id or text stay, an empty table stays empty; any other column may have any name.
    """
    held = groups(docs, N, THRESHOLD, SLOTS)
    edges = held.groupBy("lead", "tile_a", "tile_b").applyInArrow(lambda g: _linked(g, THRESHOLD, False), "a long, b long, links long")
    gone, nth, name = X.fresh(docs, "gone"), X.fresh(docs, "nth"), X.fresh(docs, "name")
    kept = docs.join(components(spark, edges).select(F.col("doc").alias(gone)), docs["doc_id"] == F.col(gone), "left_anti")
    one = Window.partitionBy("doc_id").orderBy(name, "text")
    same = kept.withColumn(name, F.xxhash64("text")).withColumn(nth, F.lag("text").over(one))
    return same.where(F.col(nth).isNull() | (F.col(nth) != F.col("text")) | F.col("doc_id").isNull() | F.col("text").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def classes(spark: SparkSession, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, slots: int = SLOTS) -> DataFrame:
    """doc_id, class_id, n_links: a row for each document, the smallest doc_id of those it hangs together with by similar pairs, and its number of pairs in similar().

    A document that is similar to none is a class of its own without links; null doc_ids have no row.
    """
    held = groups(docs, n, threshold, slots)
    X.checkpoint_dir(spark)
    linked = held.groupBy("lead", "tile_a", "tile_b").applyInArrow(lambda g: _linked(g, threshold, True), "a long, b long, links long").checkpoint()
    links = linked.groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    ids = X.need(docs, "doc_id").where("doc_id is not null").distinct()
    return (
        ids.join(components(spark, linked.select("a", "b")), F.col("doc_id") == F.col("doc"), "left").join(links, F.col("doc_id") == F.col("of"), "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
