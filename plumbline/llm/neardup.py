"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles, hashed to 64 bits; its sketch is the K smallest hashes. Documents with the same
set form one class, and only classes go on. Two sets with a likeness of `percent` or more have at least LEAST of the K smallest hashes of their union in
common, but for a chance below MISS (least_common works LEAST out); sets of up to `percent` of K hashes are their own sketches, and nothing is left to chance. So each class is
listed under a prefix of its sketch: all values but LEAST, plus one, those with the fewest listings first. Candidates are classes in a common list; the K smallest
of the union of both sketches must have LEAST in common (the same event as above, so this filter loses nothing more), and what remains is verified on the full sets.

Lists of at most FEW classes give all their pairs. Longer ones (a large group of near copies, a passage that many documents share) are cut into bands of
like size, and each member is paired with one pivot, the member whose values have the most listings. Verified links are merged into components, and
members of one component need no more pairs. Where a long list still holds several components, its members are compared by how they differ from the pivot: two sets
can only be alike if they share enough of their differences, so each member is listed under a prefix of its differences, the rare ones first (see _differences). In
these lists pairs must also have enough differences left after the common one; lists of more than DEEP members get a pivot of their own and go through the same again.
A list never holds the pivot that it came from, so this ends. Pairs are thus linear in the members of long lists, and no link is dropped.

Null, empty and word-less texts have empty sets and are linked with nothing; equal non-empty sets are linked (likeness 1). With fewer
words than a shingle the whole sequence is one shingle. Classes have numbers of their own; ids name nothing before the end. Rows without an id take part like
all others: a component is named by its smallest id, and by null if no row has one. Texts under one id are told apart by their MD5; of a component's
rows, those of the smallest key (id, MD5), rows without an id last, are kept. Repeated rows are copies of each other. An empty table gives an empty result; other
columns are ignored. Nothing that grows with the input is collected; every step is a join or an aggregate over pairs or classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Five words and 80 percent unless a caller's contract says otherwise.
WORDS, THRESHOLD = 5, 80
K, MISS = 64, 1e-6
FEW, DEEP = 48, 1024
#: Pairs of one node that take one copy of its set.
COPY = 256
#: Members of a list, about, whose differences set the order of the differences.
SAMPLE = 24
#: Entries; words that occur once fill it, and the frequent ones are soon back after it is emptied.
CACHE = 100_000


def least_common(percent: int, k: int = K, miss: float = MISS) -> int:
    """The largest m such that fewer than m of k draws hit with a chance below `miss`, each draw hitting in `percent` of all cases."""
    below, p = 0.0, percent / 100
    for m in range(k + 1):
        below += comb(k, m) * p**m * (1 - p) ** (k - m)
        if below >= miss:
            return m
    return k

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words, in order; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, np.uint64(size), dtype=np.uint64)
    for j in range(size):  # mixed after every word, so that order counts
        total = (total ^ h[j : len(h) - size + 1 + j]) * _ODD[j % 8]
        total ^= total >> np.uint64(29)
    total *= _ODD[7]
    total ^= total >> np.uint64(32)
    return np.unique(total.view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (MD5 of the text), text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(docs["text"].cast("binary"))).alias("row"), docs["text"].alias("text"))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, row, n_shingles, class (a digest of the set; null if empty), sketch (the K smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, low = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), n)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low.append(s[:K])
            offsets = np.cumsum([0, *map(len, low)]).astype(np.int32)
            flat = np.concatenate(low) if low else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "row", "n_shingles", "class", "sketch"],
            )

    return _keyed(docs).mapInArrow(run, "doc_id long, row binary, n_shingles long, class binary, sketch array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, numbers: DataFrame, n: int) -> DataFrame:
    """c, hashes (all, packed) of the classes numbered in numbers (c), from the rows that lead them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), n).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(sets, pa.binary())], names=["c", "hashes"])

    leads = classes.join(numbers, "c", "left_semi").select("c", F.col("lead.doc_id").alias("_id"), F.col("lead.row").alias("_row"))
    rows = _keyed(docs)
    rows = rows.join(leads, (rows["row"] == leads["_row"]) & rows["doc_id"].eqNullSafe(leads["_id"])).select("c", "text")
    return rows.mapInArrow(run, "c long, hashes binary").dropDuplicates(["c"])


def _likely(a, b, percent: int):
    """Whether two sketches leave their sets a chance to be alike."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    whole = F.size(union) < K
    return F.when(whole, 100 * common >= percent * F.size(union)).otherwise(common >= least_common(percent)), common / F.size(union)


def _ordered(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _close(a, b, percent: int):
    """Whether the sizes of two sets let them be alike."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_sets(pairs: DataFrame, sets: DataFrame, one: str, two: str) -> DataFrame:
    """pairs with the columns h_<one> and h_<two>. Of the first side a node may have very many pairs (a pivot): it has a copy of its set for each COPY of them, so that no task gets all
    of them. On the other side no node has more than short lists give it."""
    copies = pairs.groupBy(F.col(one).alias("c")).agg(F.ceil(F.count("*") / COPY).cast("int").alias("copies"))
    dealt = sets.join(copies, "c").select(F.col("c").alias(one), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("hashes").alias(f"h_{one}"))
    pairs = pairs.join(copies.withColumnRenamed("c", one), one).withColumn("copy", F.pmod(F.xxhash64(two), F.col("copies")).cast("int")).drop("copies")
    pairs = pairs.join(sets.select(F.col("c").alias(two), F.col("hashes").alias(f"h_{two}")), two)
    return pairs.join(dealt, [one, "copy"]).drop("copy")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(_arrays(batch, "h_u", "h_v")):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int32()))

    return _with_sets(pairs.select("u", "v"), sets, "u", "v").select("u", "v", "h_u", "h_v").mapInArrow(run, "u long, v long")


def prefixed(listed: DataFrame, kept) -> DataFrame:
    """listed: c, size, n (values of c in all), value -> c, size, rank (how often the values of c are listed, on average), value, for the values in each prefix.

    Values are ordered by the number of their listings, fewest first; the first `kept` (an expression over size and n) are the prefix. Values listed once lead to
    nobody: they take their places, the first ones, and go.
    """
    counts = listed.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    rows = listed.join(counts, "value").groupBy("c", "size", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("x"))
    single = F.col("n") - F.size("x")
    rank = (F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["df"]) + single) / F.col("n")
    first = F.slice("x", 1, F.greatest(kept - single, F.lit(0)).cast("int"))
    return rows.select("c", "size", rank.alias("rank"), F.explode(first["value"]).alias("value"))


def least_shared(d: int, size: int, p_size: int, percent: int) -> int:
    """Least number of differences from the pivot that a set shares with any other that it may be linked to, where one of both is not like the pivot.

    With d(X) the number of elements that only one of X and the pivot P has, X and Y are alike if d(X) + d(Y) - 2 |both| <= r (|X| + |Y|), r = (100 - percent) / (100 + percent).
    One of the pair, Y, is not like P: d(Y) > r (|Y| + |P|). So if X is like P, |both| > (d(X) - r |X| + r |P|) / 2. If X is not, the other may be, but
    d(Y) >= d(X) - r (|X| + |Y|) and |Y| <= 100 / percent |X| give |both| >= d(X) - (100 / percent - 1) |X|, and d(Y) - r |Y| >= (1 - r) d(Y) - r |P|, d(Y) >= 1,
    give |both| >= (d(X) - r |X| - r |P| + 1 - r) / 2.
    """
    lo, hi = 100 - percent, 100 + percent
    if hi * d <= lo * (size + p_size):
        return max(1, -(-(hi * d - lo * size + lo * p_size) // (2 * hi)))
    return max(1, d - lo * size // percent, -(-(hi * d - lo * size - lo * p_size + hi - lo) // (2 * hi)))


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The packed integers of some columns, row by row; none for null."""
    for row in zip(*(batch.column(n) for n in names), strict=True):
        yield [np.frombuffer(v.as_buffer(), dtype=np.int64) if v.is_valid else np.zeros(0, np.int64) for v in row]


def _common_differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """p, common (packed): differences that several of about SAMPLE members of each pivot's lists have, and how many have them, by element. At most SAMPLE members' sets a pivot."""
    some = members.groupBy("p").agg(F.ceil(F.count("*") / SAMPLE).alias("each"))
    sample = members.join(some, "p").where(F.pmod(F.xxhash64("c", "p"), F.col("each")) == 0).select("p", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [np.setxor1d(x, o, assume_unique=True) for x, o in _arrays(batch, "h_c", "h_p")]
            at = pa.array(np.repeat(np.arange(len(apart)), [len(a) for a in apart]))
            yield pa.RecordBatch.from_arrays([batch.column("p").take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *apart]))], names=["p", "element"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(x.as_py(), dtype=np.int64).tobytes() for x in batch.column("x")]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(found, pa.binary())], names=["p", "common"])

    seen = _with_sets(sample, sets, "p", "c").select("p", "h_p", "h_c").mapInArrow(run, "p long, element long").groupBy("p", "element").agg(F.count("*").alias("n")).where("n > 1")
    x = F.array_sort(F.collect_list(F.array("element", "n")))
    return seen.groupBy("p").agg(F.flatten(x).alias("x")).mapInArrow(packed, "p long, common binary")


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(p, c): pivots and members of their lists -> p, c, size, n (differences of the two), place, element: a row for each difference in the member's prefix.

    All members of a pivot order their differences alike: those that few of a sample have come first, and of these those that the pivot lacks. Of two linked members that are not both like the pivot, each has at least
    least_shared differences that the other has too, so the first of these in the order is in both prefixes.
    """
    ordered = members.select("p", "c").join(_common_differences(members, sets), "p", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, numbers = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
            for i, (x, o, common) in enumerate(_arrays(batch, "h_c", "h_p", "common")):
                apart, (known, times) = np.setxor1d(x, o, assume_unique=True), common.reshape(-1, 2).T
                often = np.zeros(len(apart), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, apart), len(known) - 1)
                    often = np.where(known[at] == apart, times[at], 0)
                first = np.argsort(2 * often + np.isin(apart, o, assume_unique=True), kind="stable")[: len(apart) - least_shared(len(apart), len(x), len(o), percent) + 1]
                found.append(apart[first])
                numbers.append(np.stack([np.full(len(first), i), np.full(len(first), len(x)), np.full(len(first), len(apart)), np.arange(len(first))], 1))
            row, size, n, place = np.concatenate(numbers).T
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("p").take(row), batch.column("c").take(row), *(pa.array(v) for v in (size, n, place)), pa.array(np.concatenate(found))], names=["p", "c", "size", "n", "place", "element"]
            )

    return _with_sets(ordered, sets, "p", "c").select("p", "c", "h_p", "h_c", "common").mapInArrow(run, "p long, c long, size long, n long, place long, element long")


def _enough(percent: int):
    """Over a pair's columns: whether the differences left to both after their first common one let the sets be alike."""
    lo, hi = 100 - percent, 100 + percent
    left = F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2"))
    return 2 * hi * left >= hi * (F.col("n1") + F.col("n2")) - lo * (F.col("size1") + F.col("size2"))


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches), for the nodes of links (u, v).

    Each round hooks every node to its smallest neighbour, if that is smaller, follows the hooks to their ends by labels of
    labels, which doubles the way in every step, and keeps the links between different ends. All tables of a round are written to the shared folder.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        hooks = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")))
        while not hooks.join(hooks.select(F.col("node").alias("label")), "label", "left_semi").isEmpty():
            twice = _followed(hooks, hooks)
            hooks = written(_followed(twice, twice))
        labels = written(_followed(labels, hooks))
        ends = _relabel(edges, hooks).where("lu <> lv").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v"))
        edges = written(ends.distinct())
    return labels


def _followed(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels, each replaced by its own label in `more` if it has one."""
    ends = more.select(F.col("node").alias("label"), F.col("label").alias("end"))
    return labels.join(ends, "label", "left").select("node", F.coalesce("end", "label").alias("label"))


def _relabel(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the labels of both ends; a node without a label is its own."""
    one = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    two = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    return pairs.join(one, "u", "left").join(two, "v", "left").withColumn("lu", F.coalesce("lu", "u")).withColumn("lv", F.coalesce("lv", "v"))


class _Search:
    """The full sets of some classes and the components that verified links have joined so far."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent, self.labels = sets, percent, None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows (c, ...) with the label of c."""
        if self.labels is None:
            return rows.withColumn("label", F.col("c"))
        return rows.join(self.labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))

    def verify(self, pairs: DataFrame) -> None:
        """Verifies the pairs (u, v) that lie in different components and joins those that are alike."""
        if self.labels is not None:
            pairs = _relabel(pairs.select("u", "v"), self.labels).where("lu <> lv")
        links = written(_verify(written(pairs.select("u", "v").distinct()), self.sets, self.percent))
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = components(links)
            return
        found = components(_relabel(links, self.labels).select(F.col("lu").alias("u"), F.col("lv").alias("v")))
        new = found.join(self.labels, "node", "left_anti").select("node", F.col("node").alias("label"))
        self.labels = written(_followed(self.labels.union(new), found))

    def long_lists(self, lists: DataFrame) -> None:
        """lists: k1, k2 (which list), c, size, rank. Links of members of a list with its pivot, the member of the highest rank, then those among its members, by their differences from the pivot."""
        percent, key, rest = self.percent, ["k1", "k2"], None
        while not lists.isEmpty():
            # the member of the highest rank, but of such members the one that heads most lists
            heads = lists.groupBy(*key).agg(F.max(F.struct("rank", "c"))["c"].alias("c")).groupBy("c").agg(F.count("*").alias("heads"))
            pivots = lists.join(heads, "c").groupBy(*key).agg(F.max(F.struct("heads", "rank", "c", "size")).alias("top"))
            pivots = pivots.select(*key, F.col("top.c").alias("p"), F.col("top.size").alias("p_size"))
            seated = written(lists.join(pivots, key).select(*key, "c", "size", "p", "p_size"))
            hubs = seated.where("c <> p").where(_close("size", "p_size", percent)).select(F.col("p").alias("u"), F.col("c").alias("v"))
            self.verify(hubs if rest is None else hubs.union(rest))

            at = self.labelled(seated.select(*key, "c"))
            several = at.groupBy(*key).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select(*key)
            members = written(seated.where("c <> p").join(several, key, "left_semi").select("p", "c").distinct())
            seats = written(self.labelled(_differences(members, self.sets, percent)))
            shared = ["p", "element"]
            n_seats = seats.groupBy(*shared).agg(F.count("*").alias("seats"), F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").drop("a", "b")
            seats = written(seats.join(n_seats, shared))
            short = seats.where(F.col("seats") <= DEEP)
            side = lambda i, rows=short: rows.select(*shared, *[F.col(x).alias(f"{x}{i}") for x in ("c", "size", "n", "place", "label")])
            pairs = side(1).join(side(2), shared).where("c1 < c2 AND label1 <> label2").where(_close("size1", "size2", percent)).where(_enough(percent))
            rest = pairs.select(F.col("c1").alias("u"), F.col("c2").alias("v"))
            lists = seats.where(F.col("seats") > DEEP).select(F.col("p").alias("k1"), F.col("element").alias("k2"), "c", "size", (-F.col("n")).cast("double").alias("rank"))
        if rest is not None:
            self.verify(rest)


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, row, n_shingles, component_id, first (whether no other row of its component has a smaller key)."""
    all_docs = written(sketches(docs, words))
    full = all_docs.where("class IS NOT NULL")
    # a class has a number, c, which is written with it, and a row that leads it; a sketch belongs to the class as a whole
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = full.groupBy("class").agg(F.min(lead).alias("lead"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    classes = written(classes.sortWithinPartitions("class").withColumn("c", F.monotonically_increasing_id()))
    size, k = F.col("size"), F.least("size", F.lit(K))

    exact = size - F.ceil(percent * size / 100) + 1
    kept = F.when(100 * size <= percent * K, exact).otherwise(k - least_common(percent) + 1)
    listed = classes.select("c", size, k.cast("int").alias("n"), F.explode("sketch").alias("value"))
    prefix = prefixed(listed, kept)
    # sizes of a list that differ by no more than two links may
    alike = F.max("size") * percent**2 <= F.min("size") * 100**2
    lists = prefix.groupBy("value").agg(F.count("*").alias("seats"), alike.alias("alike")).where("seats > 1")
    entries = written(prefix.join(lists, "value").select("c", "size", "rank", "value", "seats", "alike"))
    short, long = entries.where(F.col("seats") <= FEW), entries.where(F.col("seats") > FEW)

    members = short.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("c", "size"))).alias("m"))  # at most FEW
    few = members.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.lit(FEW))).alias("b"))
    few = few.where(_close("a.size", "b.size", percent)).select(F.col("a.c").alias("u"), F.col("b.c").alias("v")).distinct()
    low = classes.select("c", "sketch")
    got = few.join(low.select(F.col("c").alias("u"), F.col("sketch").alias("su")), "u").join(low.select(F.col("c").alias("v"), F.col("sketch").alias("sv")), "v")
    likely, estimate = _likely(F.col("su"), F.col("sv"), percent)
    candidates = written(got.where(likely).select("u", "v", estimate.alias("estimate")))

    # bands of sizes: sets that are alike are in one band or in neighbours, and the lists of a band hold it and the next
    band = F.floor(F.log("size") / float(np.log(100 / percent)) + 1e-9).cast("long")
    bands = F.when(F.col("alike"), F.array(F.lit(-2).cast("long"))).otherwise(F.array(band, band - 1))
    bands = written(long.select(F.col("value").alias("k1"), F.explode(bands).alias("k2"), "c", "size", "rank"))

    active = candidates.select(F.explode(F.array("u", "v")).alias("c")).union(long.select("c")).distinct()
    search = _Search(written(full_sets(docs, classes, active, words)), percent)
    # the best candidate of each class first: the rest of a group is then one component mostly
    both = candidates.union(candidates.select("v", "u", "estimate"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("estimate", F.xxhash64("v"))).alias("w"))
    search.verify(best.select(*_ordered(F.col("u"), F.col("w"))))
    search.verify(candidates)
    search.long_lists(bands)

    of = search.labelled(classes.select("c", "class", "lead"))
    of = of.select("class", "label").join(of.groupBy("label").agg(F.min("lead").alias("lead")), "label").drop("label")
    leads = F.col("lead").isNull() | (F.col("row") == F.col("lead.row")) & F.col("doc_id").eqNullSafe(F.col("lead.doc_id"))
    # rows without words are alone
    name = F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    return all_docs.drop("sketch").join(of, "class", "left").select("doc_id", "row", "n_shingles", name.alias("component_id"), leads.alias("first"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included)."""
    return grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def without_near_copies(docs: DataFrame, words: int = WORDS, percent: int = THRESHOLD) -> DataFrame:
    """docs without the rows that have a smaller key in their group, all columns."""
    gone = grouped(docs, words, percent).where("NOT first").select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row")).distinct()
    row = F.unhex(F.md5(docs["text"].cast("binary")))
    return docs.join(gone, (row == gone["_row"]) & docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def op7_neardup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, 4).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
