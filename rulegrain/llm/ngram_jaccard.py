"""N-gram Jaccard join of documents by vertical partitioning of the n-gram order.

Documents are sets of word n-grams, each a 64-bit hash; the order of the hashes is the global order.
Two sets of sizes up to s that reach the threshold t differ in at most d = s * (1 - t) / t n-grams.
For each class of sizes the order is cut into more than d fragments; sets that link must agree on
whole fragments, and in any common order of fragments on one of the first d + 1 that are not empty.
The order is that of how many sets hold a fragment: a set is listed under its d + 1 rarest fragments,
about one for every six n-grams of its own, and fragments of passages that many share are left out.
(If so many fragments are empty that fewer are filled, the first n-grams in the global order are
listed too, as prefix filtering needs them.)

Documents with equal sets are one node from the start.  Nodes that share lists, directly or through others,
form a candidate group, found by joining each list's nodes to its smallest one.  A group is dealt, by size, into blocks
of a bounded number of n-grams, and every two blocks whose sizes could link meet in one task, a tile.  A tile cuts the n-grams that occur
more than once in it into fragments of the global order, counts the partial overlaps of a fragment for
all its pairs as one matrix product, and sums them.  Pairs never leave a tile: it returns at most one link for each
of its documents, enough to join what is linked.  So nothing that is shuffled or written grows with
the pairs of a group, and no link between components is missed; the products of a group of near copies
do grow with the square of its size.

Defined cases: texts without words are sets without n-grams and link with nothing; texts of fewer
words than n are one n-gram; a null id is returned with a null component; rows of one id are one document
that links through each of its texts with words; repeated rows are equal sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm import text_arrays as A
from rulegrain.llm.components import components
from rulegrain.llm.storage import Scratch

BLOCK_SETS = 2048  # sets, and
BLOCK_GRAMS = 1 << 21  # n-grams, in a block, on average
FRAGMENT_GRAMS = 1024  # n-grams in a fragment of a tile
_SETS = "doc_id bigint, n_shingles bigint, high bigint, low bigint"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Id and sorted n-gram hashes of each document."""
    for chunk in A.chunks(batches):
        words = A.words(chunk)
        hashes = A.span_hashes(chunk.data, words, A.LOWER)
        grams = A.window_hashes(hashes, width)
        for i, doc in enumerate(chunk.batch.column("doc_id").to_pylist()):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= width:
                yield doc, np.unique(grams[a:b - width + 1])
            elif b > a:
                yield doc, A.window_hashes(hashes[a:b], b - a)
            else:
                yield doc, np.zeros(0, np.uint64)


def _digest(grams: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64).tolist())


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, len(grams), *_digest(grams)) for doc, grams in _sets([batch], width)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                                             names=["doc_id", "n_shingles", "high", "low"]) if rows else \
                pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4,
                                           names=["doc_id", "n_shingles", "high", "low"])
    return run


class Cuts:
    """Size classes, each half as large again as the one before, and their numbers of fragments."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def differences(self, size: int) -> int:
        """N-grams in one but not both of two sets that link, one of them of this size."""
        return size * (self.den - self.num) // self.num

    def of(self, size: int) -> list[tuple[int, int]]:
        """(class, fragments) that a set of this size is listed in: its own class, and the next one
        if that has sets it could link with."""
        while self.low[-1] <= 2 * size:
            self.low.append(self.low[-1] * 3 // 2 + 1)
        own = next(i for i in range(len(self.low)) if self.low[i + 1] > size)
        out = [own]
        if self.num * self.low[own + 1] <= self.den * size:
            out.append(own + 1)
        cuts = []
        for c in out:
            while len(self.low) < c + 2:
                self.low.append(self.low[-1] * 3 // 2 + 1)
            most = 2 * (self.low[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)
            cuts.append((c, most + 1 + max(3, most // 4)))
        return cuts


def _listing(grams: np.ndarray, cuts: Cuts) -> Iterator[tuple[np.ndarray, int]]:
    """For each class of sizes, the signatures of a set's fragments (and n-grams), and how many of the
    most frequent ones it may leave out."""
    differ = cuts.differences(len(grams))
    if not differ:
        return  # it links with equal sets only
    mixed = A.mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    for number, pieces in cuts.of(len(grams)):
        at = (grams >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)
        head = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        found = A.mix(np.add.reduceat(mixed, head) + A.mix(at[head] + np.uint64(number << 40)))
        if len(head) < differ + 1:
            first = len(grams) - -(-cuts.num * len(grams) // cuts.den) + 1
            alone = A.mix(grams[:first] + A.mix(np.full(first, (number << 40) + (1 << 39), np.uint64)))
            yield np.concatenate([found, alone]), 0
        else:
            yield found, len(head) - differ - 1


def _list(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, met = Cuts(num, den), set()
        for batch in batches:
            nodes, classes, spare, lists = [], [], [], []
            for doc, grams in _sets([batch], width):
                node = _digest(grams)
                if doc is None or node in met:
                    continue  # an equal set of this task is listed
                met.add(node)
                for k, (found, extra) in enumerate(_listing(grams, cuts)):
                    nodes.append(node[1]), classes.append(k), spare.append(extra), lists.append(found.view(np.int64))
            sizes = np.array([len(x) for x in lists], np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array([k + 2 * x for k, x in zip(classes, spare, strict=True)], pa.int32()),
                 pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)],
                names=["node", "spare", "listed"])
    return run


def _grams(width: int, names: list[str]):
    """Adds the n-grams of the texts; rows whose set is not the one named by `low` are other texts of
    the id and go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            lows = batch.column("low").to_pylist()
            for i, (_, grams) in enumerate(_sets([batch], width)):
                if _digest(grams)[1] == lows[i]:
                    kept.append(i), found.append(grams.tobytes())
            rows = batch.select(names).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.binary())], names=[*names, "grams"])
    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one."""
    row = np.repeat(np.arange(len(left)), [len(x) for x in left])
    column = np.repeat(np.arange(len(right)), [len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)  # sorted: the global order
    place_a, place_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a = (place_a < len(shared)) & (shared[np.minimum(place_a, len(shared) - 1)] == a) if len(shared) else np.zeros(len(a), bool)
    in_b = (place_b < len(shared)) & (shared[np.minimum(place_b, len(shared) - 1)] == b) if len(shared) else np.zeros(len(b), bool)
    row, place_a = row[in_a], place_a[in_a]
    column, place_b = column[in_b], place_b[in_b]
    total = np.zeros((len(left), len(right)), np.float32)
    order_a, order_b = np.argsort(place_a, kind="stable"), np.argsort(place_b, kind="stable")
    row, place_a, column, place_b = row[order_a], place_a[order_a], column[order_b], place_b[order_b]
    uses_a, uses_b = np.bincount(place_a, minlength=len(shared)), np.bincount(place_b, minlength=len(shared))
    # a fragment is a matrix product where many sets share it, and a list of additions where few do
    for start in range(0, len(shared), FRAGMENT_GRAMS):
        end = min(start + FRAGMENT_GRAMS, len(shared))
        (a0, a1), (b0, b1) = np.searchsorted(place_a, (start, end)), np.searchsorted(place_b, (start, end))
        additions = int((uses_a[start:end] * uses_b[start:end]).sum())
        if additions * 8 < len(left) * len(right):
            times = uses_b[place_a[a0:a1]]
            first = b0 + np.searchsorted(place_b[b0:b1], place_a[a0:a1])
            at = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            np.add.at(total, (np.repeat(row[a0:a1], times), column[at]), 1)
            continue
        x, y = np.zeros((len(left), end - start), np.float32), np.zeros((len(right), end - start), np.float32)
        x[row[a0:a1], place_a[a0:a1] - start] = 1
        y[column[b0:b1], place_b[b0:b1] - start] = 1
        total += x @ y.T
    return total.astype(np.int64)


def _joined(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column reaches over the links of the table."""
    far = np.iinfo(np.int64).max
    while True:
        to_left = np.minimum(left, np.where(links, right[None, :], far).min(axis=1, initial=far))
        to_right = np.minimum(right, np.where(links, to_left[:, None], far).min(axis=0, initial=far))
        if np.array_equal(to_left, left) and np.array_equal(to_right, right):
            return left, right
        left, right = to_left, to_right


def _tile(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        sides: dict[int, dict[tuple[int, int], np.ndarray]] = {one: {}, two: {}}
        for block, doc, low, grams in zip(*(table.column(c).to_pylist() for c in ("block", "doc", "low", "grams")), strict=True):
            sides[block][doc, low] = np.frombuffer(grams, np.uint64)
        left, right = ((list(sides[b]), list(sides[b].values())) for b in (one, two))
        edges: list[tuple[int, int]] = []
        if left[0] and right[0]:
            sizes = [np.array([len(g) for g in side[1]]) for side in (left, right)]
            shared = _overlaps(left[1], right[1])
            links = den * shared >= num * (sizes[0][:, None] + sizes[1][None, :] - shared)
            ids = [np.array([d for d, _ in side[0]]) for side in (left, right)]
            for side, found in zip(ids, _joined(links, *ids), strict=True):
                moved = found < side
                edges += zip(found[moved].tolist(), side[moved].tolist(), strict=True)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})
    return run


def _one_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the different texts of one id."""
    several = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("high", "low")).alias("x"), F.max(F.struct("high", "low")).alias("y")).filter("x <> y").select("doc_id")
    named = sets.join(several, "doc_id", "left_semi").join(classes, ["high", "low"]).select("doc_id", "doc").distinct()
    least = named.groupBy("doc_id").agg(F.min("doc").alias("a"))
    return named.join(least, "doc_id").filter("a < doc").select("a", F.col("doc").alias("b"))


def join(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text): components of the
    links with den * intersection >= num * union."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = scratch.write(docs.mapInArrow(_describe(width), _SETS))
    classes = scratch.write(sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("high", "low").agg(
        F.min("doc_id").alias("doc"), F.max("n_shingles").alias("n")))
    listed = docs.mapInArrow(_list(width, num, den), "node bigint, spare int, listed array<bigint>").select(
        "node", "spare", F.explode("listed").alias("sig"))
    alike = Window.partitionBy("sig")
    several = listed.select("sig", "node", "spare", F.min("node").over(alike).alias("first"), F.max("node").over(alike).alias("last"),
                            F.count("*").over(alike).alias("uses")).filter("first <> last")
    # `spare` is twice the number to leave out, plus the class (0 or 1) it holds for
    frequent = Window.partitionBy("node", F.col("spare") % 2).orderBy(F.desc("uses"), "sig")
    rare = (several.select("sig", "node", "spare", "uses").distinct().withColumn("nth", F.row_number().over(frequent))
                   .filter(F.col("nth") > F.floor(F.col("spare") / 2)))
    lists = scratch.write(rare.select("sig", "node").join(
        classes.select(F.col("low").alias("node"), "doc", "n"), "node").select("sig", "doc", "n", F.col("node").alias("low")))
    # candidate groups
    hubs = lists.groupBy("sig").agg(F.min("doc").alias("a"))
    near = components(lists.join(hubs, "sig").filter("a < doc").select("a", F.col("doc").alias("b")), scratch)
    members = scratch.write(lists.select("doc", "n", "low").distinct().join(near.withColumnRenamed("node", "doc"), "doc", "left")
                            .withColumn("group", F.coalesce("component", "doc")).drop("component"))
    groups = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).filter("sets > 1").select(
        "group", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    known = members.join(groups, "group")
    by_size = Window.partitionBy("group").orderBy("n", "doc", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("n") + F.lit(BLOCK_GRAMS // BLOCK_SETS)
    large = known.filter("blocks > 1").withColumn("block", F.floor(
        (F.sum(weight).over(by_size) - 1) / F.lit(2 * BLOCK_GRAMS)).cast("int")).select("group", "doc", "n", "low", "block")
    placed = scratch.write(known.filter("blocks = 1").select("group", "doc", "n", "low", F.lit(0).alias("block")).unionByName(large))
    spans = placed.groupBy("group", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = spans.select("group", F.col("block").alias("two"), F.col("least").alias("two_least"))
    pairs = scratch.write(spans.join(other, "group").filter(
        (F.col("block") <= F.col("two")) & (den * F.col("most") >= num * F.col("two_least"))).select(
        "group", F.col("block").alias("one"), "two"))
    names = ["group", "doc", "low", "block"]
    # the members grow with the corpus, so they are not sent to every task at any size
    texts = docs.join(placed.hint("merge"), F.col("doc_id") == F.col("doc")).select(*names, "doc_id", "text")
    grams = texts.mapInArrow(_grams(width, names), "group bigint, doc bigint, low bigint, block int, grams binary")
    # a block goes to each of its tiles
    of_block = pairs.select("group", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"), "one", "two").groupBy(
        "group", "block").agg(F.collect_list(F.struct("one", "two")).alias("tiles"))  # as many as a group has blocks
    tiles = grams.join(of_block, ["group", "block"]).withColumn("tile", F.explode("tiles")).select(
        "group", "tile.one", "tile.two", "block", "doc", "low", "grams")
    links = tiles.groupBy("group", "one", "two").applyInArrow(_tile(num, den), "a bigint, b bigint")
    root = components(links.union(_one_id(sets, classes)), scratch)
    placed = classes.join(root.withColumnRenamed("node", "doc"), "doc", "left").select(
        "high", "low", F.coalesce("component", "doc").alias("root"))
    return sets.join(placed, ["high", "low"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
