"""Document fingerprints by winnowing, with built-in functions only.

Every run of GRAM characters has a rolling hash: with a 64-bit hash T of each character, a character that is added shifts the hash by one bit, h = (h << 1) ^ T(new), and one that leaves
is taken off, h ^ (T(old) << GRAM). So H(xy) = (H(x) << |y|) ^ H(y), and all runs of a text are hashed by doubling, 1, 2, 4, 8 characters, without cutting them out; the bits above PLACE,
which alone count, depend on every character of a run. In every window of WINDOW consecutive hashes the
smallest is selected, the rightmost of equals, with its position. Any match of GRAM + WINDOW - 1 characters between two texts
therefore shares a selected hash. Texts are cut into overlapping pieces of PIECE windows, so that no array grows with a text but the
selection itself. A text shorter than a gram is one gram; one with fewer grams than a window is one window.

Null texts are empty; an empty text has no hashes, and two empty fingerprints are alike (1.0). Rows with equal ids are ordered by their text. Rows
without an id come last. Repeated rows are rows of their own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: GRAM and WINDOW are powers of two.
GRAM, WINDOW, PIECE = 8, 8, 512
#: Ranges of ids at most. With more rows, ranges grow; they are sorted with spilling and walked one row at a time.
RANGES = 65_536
#: Low bits of a selected value: its place within a piece, counted from the right so that the rightmost of equals is smallest.
PLACE = 10
_MASK = (1 << PLACE) - 1
SPAN = PIECE + GRAM + WINDOW - 2


def _each(value: Column, f) -> Column:
    """f(value) with value worked out once."""
    return F.transform(F.array(value), f)[0]


def _ahead(values: Column, step: int, f) -> Column:
    """f of each value, the one `step` further (NULL after the end) and its index. Arrays keep their length, as slices would copy them."""
    return _each(values, lambda v: F.transform(v, lambda x, i: f(x, F.get(v, i + step), i)))


def _placed(h: Column, i) -> Column:
    return h.bitwiseAND(F.lit(~_MASK)) + (_MASK - i)


def gram_hashes(piece: Column, whole: Column) -> Column:
    """Rolling hashes of the runs of GRAM characters, each with its place; NULL for the last GRAM - 1 characters. Of a whole text below GRAM characters, one hash of all."""
    single = F.transform(F.split(piece, F.lit("")), lambda c: F.xxhash64(c))
    rolled, step = single, 1
    while step < GRAM:
        last, joined = step * 2 == GRAM, lambda x, y, step=step: F.shiftleft(x, step).bitwiseXOR(y)
        rolled, step = _ahead(rolled, step, lambda x, y, i, last=last, joined=joined: _placed(joined(x, y), i) if last else joined(x, y)), step * 2
    short = F.array(_placed(F.aggregate(single, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseXOR(x)), 0))
    return F.when(F.length(piece) >= GRAM, rolled).otherwise(F.when(whole & (piece != ""), short).otherwise(F.array().cast("array<bigint>")))


def _select(piece: Column, whole: Column) -> Column:
    """Selected values of one piece. whole: the piece is the beginning of its text, so that it has a window however short it is."""

    def windows(h: Column) -> Column:
        step, out, n = 1, h, F.size(h) - (GRAM + WINDOW - 2)
        while step < WINDOW:
            out, step = _ahead(out, step, lambda x, y, i: F.least(x, y)), step * 2
        return F.when(n > 0, F.array_distinct(F.slice(out, F.lit(1), n))).otherwise(F.when(whole & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>")))

    return _each(gram_hashes(piece, whole), windows)


def pieces(text: Column) -> Column:
    """Overlapping pieces of SPAN characters, PIECE apart."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{SPAN}}})).{{1,{PIECE}}}"), F.lit(1))


def _selections(text: Column, begins: Column) -> Column:
    """array<array<long>>: the selection of each piece. begins: the text is the beginning of its document."""
    return F.transform(pieces(text), lambda p, i: _select(p, begins & (i == 0)))


def positioned(selections: Column) -> Column:
    """array<struct<position, hash>> by position, each once."""
    at = lambda v, k: k * PIECE + (_MASK - v.bitwiseAND(F.lit(_MASK)))
    placed = F.transform(selections, lambda s, k: F.transform(s, lambda v: F.struct(at(v, k).alias("position"), v.bitwiseAND(F.lit(~_MASK)).alias("hash"))))
    return F.array_sort(F.array_distinct(F.flatten(placed)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, hashes (array of position and hash)."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), positioned(_selections(text, F.lit(True))).alias("hashes"))


def _hashes(selections: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(selections), lambda v: v.bitwiseAND(F.lit(~_MASK))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def _print(selections: Column) -> Column:
    """128 bits of the selection with its positions, in hexadecimal. Equal texts give equal ones."""
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(F.lit("a"), selections))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("b"), selections))), 16, "0"))


def _cuts(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the table into about equal ranges."""
    got = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return sorted({int(x) for x in got})


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are not above key, found in two steps."""
    if not cuts:
        return F.lit(0)
    n = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + n] for i in range(0, len(cuts), n)]
    below = lambda edges: F.size(F.filter(edges, lambda c: c <= key))
    group = below(F.lit([g[0] for g in groups]).cast("array<bigint>")) - 1
    rows = F.array(*[F.lit(g).cast("array<bigint>") for g in groups])
    return F.when(group < 0, 0).otherwise(group * n + below(F.get(rows, F.greatest(group, F.lit(0)))))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document with the next one (by descending doc_id; after the last comes the first), worked out in ranges of ids.

    Each range also gets, as a guest, the first document of the range that follows, so that texts are shuffled once and no window
    spans more than a range. Columns: doc_id, text, sel (selections), next_text, next_hashes, hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(rows, buckets or min(RANGES, 16 * shuffle))
    bucket = _bucket(F.coalesce("doc_id", F.lit(-(1 << 63))), cuts)
    ids = rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tops = sorted(ids.collect(), key=lambda r: -r.bucket)  # at most one row a range
    order = [r.bucket for r in tops]
    guest_of = dict(zip(order, order[-1:] + order[:-1], strict=True))  # the range before, around the end
    top = {r.bucket: r.top for r in tops}
    all_ranges = range(len(cuts) + 1)
    hosts = F.lit([guest_of.get(b, 0) for b in all_ranges]).cast("array<int>")
    firsts = F.array(*[F.lit(top.get(b)).cast("long") for b in all_ranges])
    host = F.when(F.col("doc_id").eqNullSafe(F.get(firsts, F.col("bucket"))), F.get(hosts, F.col("bucket")))
    seats = F.array_compact(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("at"), F.lit(True).alias("guest")))))
    placed = rows.withColumn("bucket", bucket).withColumn("host", host).select("doc_id", "text", F.explode(seats).alias("s")).select("doc_id", "text", "s.at", "s.guest")
    dealt = placed.repartition("at").sortWithinPartitions("at", "guest", F.col("doc_id").desc_nulls_last(), "text")
    read = dealt.withColumn("sel", _selections(F.col("text"), F.lit(True))).withColumn("hashes", _hashes(F.col("sel")))
    turn = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    ahead = F.lead(F.struct("text", "hashes")).over(turn)
    # a table of one row is its own next
    both = read.withColumn("next", ahead).where("NOT guest")
    return both.select("doc_id", "text", "sel", "hashes", F.coalesce("next.text", "text").alias("next_text"), F.coalesce("next.hashes", "hashes").alias("next_hashes"))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit: the last third replaced by the beginning of the next document.

    The pieces that lie wholly before the edit are shared by both texts; only the rest is hashed again.
    """
    rows = with_next(docs)
    n = F.length("text")
    away = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("kept", n - away)
    shared = F.greatest(F.floor((F.col("kept") - SPAN) / PIECE).cast("int") + 1, F.lit(0))
    rows = rows.withColumn("shared", F.when(F.col("kept") >= SPAN, shared).otherwise(0)).withColumn("begin", F.substring("next_text", F.lit(1), F.col("n_chars").cast("int") - F.col("kept")))
    rest = F.concat(F.substring("text", F.col("shared") * PIECE + 1, F.col("kept") - F.col("shared") * PIECE), F.col("begin"))
    rows = rows.withColumn("tail", _selections(rest, F.col("shared") == 0))
    rows = rows.withColumn("edited_sel", F.concat(F.slice("sel", 1, F.col("shared")), F.col("tail")))
    edit = F.concat(F.substring("text", F.lit(1), F.col("kept")), F.col("begin"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(edit.cast("binary"), 256).alias("edited_sha256"), _print(F.col("sel")).alias("fingerprint"), _print(F.col("edited_sel")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), _hashes(F.col("edited_sel"))).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir):
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
