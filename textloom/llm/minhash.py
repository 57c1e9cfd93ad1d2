"""MinHash near-dedup with odd sketches.

1. One pass over the texts gives each its shingle count, a digest of its shingle set, MinHash samples folded twice: into
   band keys, and into an odd sketch (a bitmap in which each sample flips a bit, so that the XOR of two sketches holds the
   samples on which they differ, and its population count estimates the similarity).
2. Texts with equal sets become one node, so copies of any number cost a row each and nothing more.
3. Nodes that share a band key meet in a bucket; nodes that buckets join, over any number of steps, are a neighbourhood. To
   find them buckets stand for their nodes, and only links between buckets' least nodes are joined. A neighbourhood of
   bounded size is searched in one task: from a node to those of its buckets that were not reached yet, first by odd
   sketches, then on full shingle sets.
4. A larger neighbourhood is searched by all tasks. Not all pairs of a bucket are made: a hub is chosen (the node that
   meets most others over all bands), and all others are compared with it only: odd sketches first, then full sets. Links
   are joined to components. Buckets in which nodes that were no hub yet lie in several components go into the next
   round with new hubs, until there are none; any two nodes of a bucket have then been compared or are connected.

Either way, links are those between nodes that meet in a band, confirmed on full sets. At the threshold, two nodes meet in none
of the bands with a chance below 1e-6.

Tables between the steps are written in the shared folder. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import conf, documents, located, scratch, small_batches, text_of, those, written
from .kernel import U, mix, text_batches, words

#: Words a shingle; links have 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 85
BANDS, ROWS, SKETCH_BITS = 25, 5, 512
_K = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(86028121))
_A = _rng.integers(1, 1 << 64, _K, dtype=U) | U(1)
_B = _rng.integers(1, 1 << 64, _K, dtype=U)
_IN_BAND = _rng.integers(1, 1 << 64, (BANDS, ROWS), dtype=U) | U(1)
#: Most chance that two texts at the threshold meet in no band.
MISS = 1e-6
#: A neighbourhood up to these sizes is the work of one task (8 bytes a shingle); beyond, buckets get so many hubs in each
#: round after the first. Both ways compare the same pairs: those that share a bucket.
GROUP_NODES, GROUP_SHINGLES, HUBS = 4000, 4_000_000, 64
#: So many links (16 bytes each) are joined to components in one task; more, round by round over all tasks.
FEW_LINKS = 1_000_000


def bands_for(percent: int) -> int:
    """Bands, BANDS at least, with which texts at the threshold meet in none with a chance of MISS at most."""
    return max(BANDS, ceil(log(MISS) / log(1 - min(percent / 100, 0.99) ** ROWS)))


def _values(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_A, _B and _IN_BAND, with more of each for bands beyond BANDS."""
    more = np.random.Generator(np.random.PCG64(86028157)).integers(1, 1 << 64, (bands - BANDS, 3, ROWS), dtype=U)
    a, b = (np.concatenate([x, more[:, i].ravel()]) for i, x in enumerate((_A, _B)))
    return a | U(1), b, np.concatenate([_IN_BAND, more[:, 2] | U(1)])


def widest_xor(percent: int = PERCENT, samples: int = _K, bits: int = SKETCH_BITS) -> int:
    """Set bits of two sketches' XOR above which a pair is dismissed: what a similarity six standard deviations of the
    sample below the threshold gives."""
    j = percent / 100
    differing = 2 * samples * (1 - (j - 6 * sqrt(j * (1 - j) / samples)))
    return round(bits / 2 * (1 - exp(-2 * differing / bits)))


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a batch of texts, one text after another and with repeats, and where each text's begin. A text of
    1 to SHINGLE - 1 words has one: the whole sequence."""
    w = words(data, bounds, lower=True)
    hashes, at = w.runs(SHINGLE)
    counts = np.maximum(w.counts - (SHINGLE - 1), 0)
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(few):
        whole = [mix(np.array([sum(int(x) * p for x, p in zip(w.hash[w.first[t] : w.first[t + 1]], (3, 5, 7, 11), strict=False)) + int(w.counts[t]) & (1 << 64) - 1], U))[0] for t in few]
        hashes = np.insert(hashes, first[few], whole)
        counts[few] = 1
        first = np.concatenate([[0], np.cumsum(counts)])
    return hashes, first


_SIGNED = "doc_id {id}, loc string, fp binary, n bigint, digest binary, bands array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """docs: (doc_id, loc, text)."""
    n_bands, samples, (first_of, second_of, in_band) = bands, bands * ROWS, _values(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_batches(batch.column(3)):
                hashes, first = shingle_sets(data, bounds)
                size = b - a
                n, digest = np.zeros(size, np.int64), [b""] * size
                full = np.flatnonzero(np.diff(first))
                for t in full:
                    own = np.unique(hashes[first[t] : first[t + 1]])
                    n[t] = len(own)
                    digest[t] = np.array([mix(own).sum(dtype=U), mix(own ^ _A[0]).sum(dtype=U)], U).tobytes()
                least, held = np.empty((len(full), samples), U), np.empty(len(hashes), U)
                for k in range(samples if len(full) else 0):
                    np.multiply(hashes, first_of[k], out=held)
                    np.add(held, second_of[k], out=held)
                    least[:, k] = np.minimum.reduceat(held, first[full])
                bands = mix((least.reshape(len(full), n_bands, ROWS) * in_band).sum(axis=2, dtype=U) + np.arange(n_bands, dtype=U))
                bit = (mix(least[:, :_K] ^ _B) % U(SKETCH_BITS)).astype(np.int64) + np.arange(len(full))[:, None] * SKETCH_BITS
                odd = (np.bincount(bit.ravel(), minlength=len(full) * SKETCH_BITS) & 1).astype(np.uint8)
                sketch = np.packbits(odd).view(np.int64).reshape(len(full), SKETCH_BITS // 64)
                made = np.zeros(size + 1, np.int64)
                made[full + 1] = 1
                lists = lambda x: pa.ListArray.from_arrays(pa.array((np.cumsum(made) * x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, size) for i in range(3)), pa.array(n), pa.array(digest, pa.binary()), lists(bands), lists(sketch)], names=["doc_id", "loc", "fp", "n", "digest", "bands", "sketch"])

    return docs.select("doc_id", "loc", F.unhex(F.sha2("text", 256)).alias("fp"), "text").mapInArrow(run, _SIGNED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def full_sets(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, hashes: the distinct shingle hashes in order, 8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_batches(batch.column(1)):
                hashes, first = shingle_sets(data, bounds)
                rows = [np.unique(hashes[first[t] : first[t + 1]]).tobytes() for t in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, hashes binary")


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, x, y: full sets) -> (a, b) of the pairs at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in (2, 3))
                same = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _joined(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label), all links in one task: roots hook on to smaller ones until no link joins two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for batch in batches]
        if not ends:
            return
        nodes, at = np.unique(np.concatenate(ends, axis=1).ravel(), return_inverse=True)
        (x, y), label = at.reshape(2, -1), np.arange(len(nodes))
        while (label[x] != label[y]).any():
            np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
            while (label[label] != label).any():
                label = label[label]
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], names=["node", "label"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, label bigint")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(a, b) -> (node, label): for every node in a link, the least node of its component. Up to `few` links are joined in one task.
    More go round by round: labels pass along links, and each round also takes the label of one's label, so that long chains
    take few rounds."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-both")
    if links.count() <= few:
        return written(_joined(links), "near-labels")
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), "near-labels")
    while True:
        heard = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        new = labels.join(heard, F.col("node") == F.col("u")).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        new = written(new, "near-labels")
        jump = new.select(F.col("node").alias("at"), F.col("label").alias("far"))
        after = written(new.join(jump, new["label"] == jump["at"]).select("node", F.least("label", "far").alias("label"), "old"), "near-labels")
        moved = after.where("label <> old").isEmpty()
        labels = after.select("node", "label")
        if moved:
            return labels


def _xor_bits(x: Column, y: Column) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))


class _Rounds:
    """What the rounds share: nodes with sketches, and their texts' full sets, made once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, text_col: str, percent: int):
        self.nodes, self.percent = nodes, percent
        self.sets = written(full_sets(texts_of(docs, nodes, text_col)), "near-sets")
        self.tested = self.links = None

    def compare(self, pairs: DataFrame) -> bool:
        """pairs (a, b), repeats allowed. Adds to the links; tells whether there are new ones."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        if pairs.isEmpty():
            return False
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        one, two = (self.nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
        lengths = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        close = pairs.join(one, "a").join(two, "b").where(lengths & (_xor_bits(F.col("sa"), F.col("sb")) <= widest_xor(self.percent)))
        x, y = (self.sets.select(F.col("node").alias(k), F.col("hashes").alias(h)) for k, h in (("b", "x"), ("a", "y")))
        found = written(linked(close.select("a", "b").join(x, "b").join(y, "a"), self.percent), "near-links")
        if found.isEmpty():
            return False
        self.links = found if self.links is None else self.links.union(found)
        return True


def met_in_buckets(nodes: DataFrame) -> DataFrame:
    """(node, key, size): the buckets with more than one node."""
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(buckets.join(sizes, "key").select("node", "key", "size"), "near-met")


def neighbourhoods(met: DataFrame) -> DataFrame:
    """(node, key) -> (node, label): the least node of those that buckets join, over any number of steps.

    Buckets are known by their least nodes. A node belongs to the least of those it has, and links the others with that one, so
    only links between least nodes, each once, go on to components(); a node's row is joined once, whatever its group's size."""
    least = met.groupBy("key").agg(F.min("node").alias("hub"))
    own = met.join(least, "key").groupBy("node").agg(F.collect_set("hub").alias("hubs"))  # as many as bands, at most
    own = written(own.select("node", F.array_min("hubs").alias("hub"), "hubs"), "near-hubs-of")
    links = own.select(F.explode(F.array_remove("hubs", F.col("hub"))).alias("a"), F.col("hub").alias("b")).distinct()
    labels = components(links)
    return own.select("node", "hub").join(labels.select(F.col("node").alias("hub"), "label"), "hub", "left").select("node", F.coalesce("label", "hub").alias("label"))


def near_components(docs: DataFrame, nodes: DataFrame, text_col: str, percent: int, most_nodes: int = GROUP_NODES, most_shingles: int = GROUP_SHINGLES) -> DataFrame | None:
    """nodes: (node, fp, n, bands, sketch). Returns (node, label) of nodes that meet others in buckets, or None without any.

    Nodes joined by buckets, links or not, are a neighbourhood; links never leave it. A neighbourhood within both limits is
    one task's work; larger ones go round by round over all tasks."""
    met = met_in_buckets(nodes)
    if met.isEmpty():
        return None
    around = neighbourhoods(met)
    own = written(nodes.join(around.withColumnRenamed("label", "around"), "node"), "near-around")
    sizes = written(own.groupBy("around").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")), "near-sizes")
    fits = (F.col("k") <= most_nodes) & (F.col("m") <= most_shingles)
    small = own.join(sizes.where(fits), "around", "left_semi")
    labels = written(within(texts_of(docs, small, text_col, "around", "sketch", "bands"), percent), "near-within")
    large = sizes.where(~fits)
    if large.isEmpty():
        return labels
    rest = written(own.join(large, "around", "left_semi").drop("around"), "near-large")
    found = by_rounds(docs, rest, met.join(rest.select("node"), "node", "left_semi"), text_col, percent)
    return labels if found is None else labels.unionByName(found)


def texts_of(docs: DataFrame, nodes: DataFrame, text_col: str, *columns: str) -> DataFrame:
    """(node, columns, text): a text for each node, found by its digest. Only texts asked for are shuffled: Spark puts a Bloom
    filter of the digests before the shuffle."""
    spark = docs.sparkSession
    wanted = written(nodes.select("node", "fp", *columns, F.lit(1).alias("asked")), "near-wanted").where("asked = 1")
    text = text_of(text_col)
    with conf(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0", spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="1g"):
        met = docs.select(F.unhex(F.sha2(text, 256)).alias("fp"), text.alias("text")).join(wanted.select("node", "fp", *columns), "fp")
        return written(met.dropDuplicates(["node"]).select("node", *columns, "text"), "near-texts")


def within(texts: DataFrame, percent: int) -> DataFrame:
    """(node, around, sketch, bands, text) -> (node, label): components of each neighbourhood, by breadth: each node is compared
    with those of its buckets not reached yet, first by sketches, then by full sets."""
    widest = widest_xor(percent)

    def split(nodes: list[int], sketches: list, bands: list, sets: list[np.ndarray]) -> np.ndarray:
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        cut = np.cumsum([0, *map(len, sets)])
        size, sketch, keys = np.diff(cut), np.array(sketches, np.int64).view(U), np.array(bands, np.int64)
        label, mark = np.full(len(nodes), -1, np.int64), np.zeros(int(ids.max()) + 1, bool)
        for seed in np.argsort(nodes):
            if label[seed] >= 0:
                continue
            label[seed], queue = nodes[seed], [seed]
            while queue:
                u = queue.pop()
                rest = np.flatnonzero(label < 0)
                rest = rest[np.bitwise_count(sketch[rest] ^ sketch[u]).sum(axis=1) <= widest]
                rest = rest[(keys[rest] == keys[u]).any(axis=1)]
                if len(rest):
                    mark[ids[cut[u] : cut[u + 1]]] = True
                    if len(rest) < 32:
                        same = np.array([mark[ids[cut[i] : cut[i + 1]]].sum() for i in rest])
                    else:
                        same = np.add.reduceat(mark[ids].astype(np.int64), cut[:-1])[rest]
                    mark[ids[cut[u] : cut[u + 1]]] = False
                    near = rest[100 * same >= percent * (size[u] + size[rest] - same)]
                    label[near] = nodes[seed]
                    queue.extend(near.tolist())
        return label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around, nodes, sketches, bands, sets = None, [], [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(split(nodes, sketches, bands, sets), pa.int64())], names=["node", "label"])

        for batch in batches:
            for a, b, data, bounds in text_batches(batch.column(4)):
                hashes, first = shingle_sets(data, bounds)
                part = batch.slice(a, b - a)
                for t, (node, group, sketch, keys) in enumerate(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)):
                    if group != around and nodes:
                        yield out()
                        nodes, sketches, bands, sets = [], [], [], []
                    around = group
                    nodes.append(node)
                    sketches.append(sketch)
                    bands.append(keys)
                    sets.append(np.unique(hashes[first[t] : first[t + 1]]))
        if nodes:
            yield out()

    dealt = texts.select("node", "around", "sketch", "bands", "text").repartition("around").sortWithinPartitions("around", "node")
    return dealt.mapInArrow(run, "node bigint, label bigint")


def by_rounds(docs: DataFrame, nodes: DataFrame, met: DataFrame, text_col: str, percent: int) -> DataFrame | None:
    """(node, label) of nodes with links, or None without any: hubs against their buckets, round by round."""
    central = met.groupBy("node").agg(F.sum("size").alias("central"))
    open_ = written(met.select("key", "node").join(central, "node"), "near-open")
    rounds, labels = _Rounds(docs, nodes, text_col, percent), None
    hubs = open_.groupBy("key").agg(F.max_by("node", F.struct("central", "node")).alias("hub"))
    while True:
        hubs = written(hubs, "near-hubs")
        rows = open_ if labels is None else open_.select("key", "node", "central", "label")
        pairs = rows.join(hubs if labels is None else hubs.withColumnRenamed("label", "hub_label"), "key").where("node <> hub")
        if labels is not None:
            pairs = pairs.where("label <> hub_label")
        if rounds.compare(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b"))):
            labels = components(rounds.links)
        none = docs.sparkSession.createDataFrame([], "node bigint, label bigint")
        known = none if labels is None else labels
        # hubs of a bucket are done there: they met all others. What is left counts if it lies in several components
        left = open_.select("key", "node", "central").join(hubs.select("key", F.col("hub").alias("node")), ["key", "node"], "left_anti")
        left = written(left.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-left")
        apart = left.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        open_ = written(left.join(apart, "key", "left_semi"), "near-open")
        if open_.isEmpty():
            return labels
        labels = known
        # the largest component of a bucket needs no hub: each link to it starts at a hub of another
        by_label = written(open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", F.struct("central", "node")).alias("hub")), "near-by-label")
        largest = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"))
        others = by_label.join(largest, "key").where(F.col("label") != F.col("most.label"))
        hubs = others.groupBy("key", F.pmod(F.xxhash64("label"), F.lit(HUBS)).alias("_")).agg(F.max(F.struct("n", "hub", "label")).alias("h")).select("key", "h.hub", "h.label")


def _grouped(docs: DataFrame, percent: int, most_nodes: int) -> DataFrame:
    """docs: (doc_id, loc, text), texts without nulls. (doc_id, loc, fp, n, row, group: of the component, component_id) for each
    row; a row without shingles is a group of its own."""
    small_batches(docs.sparkSession)
    signed = written(signatures(docs, bands_for(percent)).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    classes = written(signed.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "near-classes")
    nodes = written(classes.select("node").join(signed, F.col("node") == F.col("row")).select("node", "fp", "n", "bands", "sketch"), "near-nodes")
    labels = near_components(docs, nodes, "text", percent, most_nodes)
    if labels is None:
        classes = classes.withColumn("label", F.col("node"))
    else:
        told = classes.join(labels, "node")
        lows = told.groupBy("label").agg(F.min("low").alias("lowest"))
        lowest = written(told.join(lows, "label").select("node", "label", "lowest"), "near-lowest")
        classes = classes.join(lowest, "node", "left").select("digest", F.coalesce("lowest", "low").alias("low"), F.coalesce("label", "node").alias("label"))
    # a class has one row on the right: AQE splits the rows of a hot class on the left
    rows = signed.select("doc_id", "loc", "fp", "n", "digest", "row").join(classes.select("digest", "low", "label"), "digest", "left")
    has = F.col("n") > 0
    return rows.select("doc_id", "loc", "fp", "n", "row", F.when(has, F.col("label")).otherwise(F.col("row")).alias("group"), F.when(has, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, most_nodes: int = GROUP_NODES) -> DataFrame:
    """A row for each row of docs: doc_id, fp (SHA-256 of the text), n_shingles, component_id, kept.

    Texts without words (null, empty, white space) have no shingles, are linked with nothing and kept. component_id is
    the smallest identifier of the component, nulls left out; kept tells whether the row has it. Identifiers are of any type that
    can be ordered. Rows that repeat an identifier are rows of their own, and all with the smallest one are kept. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    rows = _grouped(docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("loc"), text_of(text_col).alias("text")), percent, most_nodes)
    return rows.select("doc_id", "fp", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns under whatever names: of each component the one with the smallest
    identifier, nulls last; of rows that repeat it, one. Rows without words all stay. An empty table gives an empty result."""
    rows = located(docs, "near-rows")
    with scratch(docs.sparkSession) as keep:
        found = _grouped(rows.select(F.col(f"carried.`{id_col}`").alias("doc_id"), "loc", text_of(F.col(f"carried.`{text_col}`")).alias("text")), percent, GROUP_NODES)
        kept = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "loc")).alias("best")).select("best.loc")
        kept = keep(written(kept, "near-kept"))
    return those(rows, kept)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, exactly; for small tables.
OP4_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))),
c AS (WITH RECURSIVE r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b) SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
