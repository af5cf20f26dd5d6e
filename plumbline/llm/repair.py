"""Repair of conversations: the cheapest edits that make the turns follow a grammar.

Turns must read as an optional system turn and then user and assistant in turn, ending with the assistant; nothing at all is right too. A turn is kept (0), given the role user or
assistant (1), or deleted (2: blank turns and repetitions must be); an empty turn of user or assistant may be inserted anywhere (5). Truncated turns that stay cost 5 more.

The state of the grammar is what came last: nothing, system, user or assistant. Costs to go are computed from the last turn back to the first, by state; then a walk forward from "nothing" takes, of the edits whose
cost and the cost to go after them add up to what is left, the one whose initial comes first in ASCII (D, I, K, R). As the state follows from the initials, this gives the first of all cheapest audits.
The edits are coded as K, D, U and A (kept as user or assistant), u and a (inserted).

A conversation is an array of at most MAX_ROWS turns and MAX_CHARS characters, whose edits come from a Python function of its turns' kinds, one letter a turn; all else is Spark expressions. Longer
conversations are cut into pieces of CHUNK turns of one order (see _long): a piece is a 4 x 4 matrix of costs between states, the matrices give the costs to go at the ends of the pieces, each piece is walked
from all four states, and the ends of the walks say which of them counts. Turns of a long conversation meet in one task only where the contract's digest and audit run over all of them; there they are streamed, not held.

Defined cases: null roles and texts are one space (the text is blank, the role no role), a null turn comes first, null conversations are one conversation. Turns of one number are ordered by role and the text's SHA-256. Roles count by their first
character, as it is. Repeated rows are repetitions and go. Conversations without turns, or of whom none is left, are right as they are. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, table, written

MAX_ROWS, MAX_CHARS = 10_000, 32_000_000
#: Turns a piece of a longer conversation: a power of two.
CHUNK = 4096
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
FAR = 10**9
#: States, and the state after a role's initial, where it may come.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = ["u", "u", "a", "u"]
ENDS = [0, 2 * INSERT, INSERT, 0]


def edits_of(kind: str, state: int) -> list[tuple[str, int, int]]:
    """(code, cost, state after it) of what may be done with a turn in a state, in ASCII order of the initials. kind: the role's initial if it is s, u or a, else x, as a capital if truncated; d if it must go."""
    out = [("D", DELETE, state)]
    if kind != "d":
        role, more = kind.lower(), TRUNCATED if kind.isupper() else 0
        if (state, role) in AFTER:
            out.append(("K", more, AFTER[state, role]))
        out.append((NEXT[state].upper(), REROLE + more, AFTER[state, NEXT[state]]))
    return out


STEPS = {kind: [edits_of(kind, s) for s in range(4)] for kind in "suaxSUAXd"}


def inserted(costs: list[int]) -> list[int]:
    """Costs to go by state, where turns may be inserted first."""
    c = list(costs)
    c[USER] = min(c[USER], INSERT + c[ASSISTANT])
    return [min(c[s], INSERT + c[AFTER[s, NEXT[s]]]) for s in range(4)]


def before(kind: str, after: list[int]) -> list[int]:
    """Costs to go before a turn, from those after it."""
    return inserted([min(cost + after[to] for _, cost, to in edits_of_state) for edits_of_state in STEPS[kind]])


def to_go(kinds: str, end: list[int]) -> list[list[int]]:
    """Costs to go before each turn and after the last."""
    out = [list(end)]
    for kind in reversed(kinds):
        out.append(before(kind, out[-1]))
    return out[::-1]


def matrix(kinds: str) -> np.ndarray:
    """[start, end]: the least cost of the turns of a piece between two states."""
    ends = [inserted([0 if s == end else FAR for s in range(4)]) for end in range(4)]
    return np.minimum([to_go(kinds, end)[0] for end in ends], FAR).T


def walk(kinds: str, costs: list[list[int]], state: int, last: bool = True) -> tuple[str, int]:
    """Codes of the cheapest edits from a state, the first in ASCII order of those, and the state where they end. After the last turn only the last piece inserts: others leave it to the next."""
    codes = []

    def insert() -> None:
        nonlocal state
        codes.append(NEXT[state])
        state = AFTER[state, NEXT[state]]

    for k, kind in enumerate(kinds):
        while True:
            left = costs[k][state]
            tight = [(code, to) for code, cost, to in STEPS[kind][state] if cost + costs[k + 1][to] == left]
            deletes = bool(tight) and tight[0][0] == "D"
            if deletes or INSERT + costs[k][AFTER[state, NEXT[state]]] != left:
                break
            insert()
        code, state = tight[0]
        codes.append(code)
    while last and costs[-1][state]:
        insert()
    return "".join(codes), state


@lru_cache(maxsize=50_000)
def edits(kinds: str) -> tuple[str, int]:
    """(codes, cost) for a whole conversation."""
    costs = to_go(kinds, ENDS)
    return walk(kinds, costs, NOTHING)[0], costs[0][NOTHING]


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations as the contract damages them: conv_id, turn, role, text, gone (dropped: it stands for its conversation only)."""
    said = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    how = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    base = rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].alias("turn"), F.when(how == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (how == 0).alias("gone"), F.explode(times).alias("_"))
    return base.drop("_")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _flags(rows: DataFrame, repeated: Column) -> list[Column]:
    blank = ~F.col("text").rlike(WORD)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return [blank.alias("blank"), (~blank & repeated).alias("duplicate"), (~blank & ~repeated & cut).alias("truncated")]


def _kind() -> Column:
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    return F.when(F.col("blank") | F.col("duplicate"), "d").when(F.col("truncated"), F.upper(letter)).otherwise(letter)


def _illegal(initials: Column) -> Column:
    """Adjacent initials other than su, ua and au, of an array."""
    n = F.greatest(F.size(initials) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(initials, F.lit(1), n), F.slice(initials, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def _audit(codes: Column) -> Column:
    return F.translate(codes, "UAua", "RRII")


def _lines(of: Column, codes: Column) -> Column:
    """The repaired lines of an array of turns (role, text), given the codes of the edits: insertions stand before the turn that they precede."""
    put = lambda s: F.transform(F.regexp_extract_all(s, F.lit("[ua]"), F.lit(0)), lambda x: F.when(x == "u", "user:").otherwise("assistant:"))
    own = F.regexp_extract_all(codes, F.lit("[ua]*[KDUA]"), F.lit(0))

    def lines(turn: Column, code: Column) -> Column:
        kept = F.right(code, F.lit(1))
        role = F.when(kept == "U", "user").when(kept == "A", "assistant").otherwise(turn["role"])
        line = F.when(kept == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), turn["text"])))
        return F.concat(put(code), line)

    return F.concat(F.flatten(F.zip_with(of, own, lines)), put(F.regexp_extract(codes, "[ua]*$", 0)))


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of rows (conv_id, turn, role, text, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, texts (the repaired lines; null for conversations beyond MAX_ROWS or MAX_CHARS)."""
    held = F.when(~F.col("gone"), F.length("text"))
    sizes = rows.groupBy("conv_id").agg(F.count(held).alias("n"), F.sum(held).alias("chars"))
    large = written(sizes.where((F.col("n") > MAX_ROWS) | (F.col("chars") > MAX_CHARS)).select(F.col("conv_id").alias("of")))
    here = F.col("conv_id").eqNullSafe(F.col("of"))
    if large.isEmpty():
        return _short(rows)
    return _short(rows.join(large, here, "left_anti")).unionByName(_long(rows.join(large, here, "left_semi")))


def _short(rows: DataFrame) -> DataFrame:
    rows = rows.repartition("conv_id").withColumn("digest", _digest())
    seen = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy("turn")
    rows = rows.withColumn("again", F.row_number().over(seen) > 1)
    rows = rows.select("*", *_flags(rows, F.col("again")))
    turn = F.struct("turn", "role", "digest", "again", _kind().alias("kind"), "text")
    have = ~F.col("gone")
    by = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(have, turn))).alias("turns"),
        *[F.count_if(have & F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.min(F.when(have, F.col("turn"))).alias("low"), F.max(F.when(have, F.col("turn"))).alias("high"),
    )

    @F.pandas_udf("codes string, cost long")
    def edited(kinds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([edits(k) for k in kinds], columns=["codes", "cost"])

    turns = F.col("turns")
    by = by.withColumn("e", edited(F.array_join(F.transform(turns, lambda t: t["kind"]), "")))
    numbers = F.size(F.array_distinct(F.filter(F.transform(turns, lambda t: t["turn"]), lambda x: x.isNotNull())))
    texts = _lines(turns, F.col("e.codes"))
    return by.select(
        "conv_id", _gaps(numbers).alias("gaps"), "blank", "duplicate", "truncated",
        _illegal(F.transform(turns, lambda t: F.substring(t["role"], 1, 1))).alias("illegal"), F.col("e.cost").alias("cost"), _audit(F.col("e.codes")).alias("audit"),
        F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("repaired_sha256"), texts.alias("texts"),
    )


def _gaps(numbers: Column) -> Column:
    return F.coalesce(F.col("high") - F.col("low") + 1 - numbers, F.lit(0)).cast("long")


def _long(rows: DataFrame) -> DataFrame:
    """The same for conversations of any length. Turns are put in order by ranges, so that those of one conversation are many tasks' work."""
    spark = rows.sparkSession
    # equal turns are told apart by where they were read, else copies of one turn would be one range
    keyed = rows.where("NOT gone").withColumn("digest", _digest()).withColumn("salt", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "salt"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = written(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id()))
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    narrow = turns.select("conv_id", "turn", "role", "place", *[c.alias(f"_{i}") for i, c in enumerate(_flags(turns, F.lit(False)))])
    narrow = narrow.join(first, "place", "left").withColumn("again", F.col("new").isNull())
    narrow = narrow.select("conv_id", "turn", "role", "place", F.col("_0").alias("blank"), (~F.col("_0") & F.col("again")).alias("duplicate"), (~F.col("again") & F.col("_2")).alias("truncated"))
    bits = CHUNK.bit_length() - 1
    piece = F.shiftright("place", bits)
    narrow = written(narrow.select("*", piece.alias("piece"), _kind().alias("kind"), F.substring("role", 1, 1).alias("initial")))
    pieces = narrow.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "initial"))).alias("t"))  # at most CHUNK turns
    kinds, initials = F.array_join(F.transform("t", lambda t: t["kind"]), ""), F.transform("t", lambda t: t["initial"])

    @F.pandas_udf("array<long>")
    def costs(kinds: pd.Series) -> pd.Series:
        return kinds.map(lambda k: matrix(k).ravel())

    pieces = written(pieces.select("conv_id", "piece", kinds.alias("kinds"), costs(kinds).alias("m"), _illegal(initials).alias("illegal"), F.element_at(initials, 1).alias("head"), F.element_at(initials, -1).alias("tail")))

    def ends(batch: pd.DataFrame) -> pd.DataFrame:
        """Costs to go after each piece of a conversation, and pairs of turns between pieces that are illegal."""
        batch = batch.sort_values("piece")
        go, out = ENDS, []
        for m in reversed(list(batch["m"])):
            out.append(go)
            go = [int(x) for x in np.minimum((np.asarray(m).reshape(4, 4) + np.array(go)[None, :]).min(axis=1), FAR)]
        pairs = [0, *(int(a + b not in ("su", "ua", "au")) for a, b in zip(batch["tail"][:-1], batch["head"][1:], strict=True))]
        last = [False] * (len(batch) - 1) + [True]
        return pd.DataFrame({"conv_id": batch["conv_id"], "piece": batch["piece"], "go": out[::-1], "between": pairs, "last": last, "cost": int(go[NOTHING])})

    small = pieces.select("conv_id", "piece", "m", "head", "tail")
    found = written(small.groupBy("conv_id").applyInPandas(ends, "conv_id long, piece long, go array<long>, between long, last boolean, cost long"))

    @F.pandas_udf("array<struct<codes:string,state:int>>")
    def walks(kinds: pd.Series, go: pd.Series, last: pd.Series) -> pd.Series:
        def one(k: str, g, end: bool) -> list[dict]:
            c = to_go(k, [int(x) for x in g])
            return [dict(zip(("codes", "state"), walk(k, c, s, end), strict=True)) for s in range(4)]

        return pd.Series([one(*x) for x in zip(kinds, go, last, strict=True)])

    same = [F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")), F.col("p.piece") == F.col("f.piece")]
    walked = pieces.alias("p").join(found.alias("f"), same[0] & same[1]).select("p.conv_id", "p.piece", "p.illegal", "f.between", "f.last", "f.cost", walks("p.kinds", "f.go", "f.last").alias("w"))
    walked = written(walked)

    def starts(batch: pd.DataFrame) -> pd.DataFrame:
        """The state in which each piece of a conversation starts."""
        batch = batch.sort_values("piece")
        state, out = NOTHING, []
        for ends_in in batch["to"]:
            out.append(state)
            state = int(ends_in[state])
        return pd.DataFrame({"of": batch["conv_id"], "at": batch["piece"], "start": out})

    start = walked.select("conv_id", "piece", F.transform("w", lambda x: x["state"]).alias("to")).groupBy("conv_id").applyInPandas(starts, "of long, at long, start int")
    chosen = walked.join(start, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at"))).select("conv_id", "piece", "illegal", "between", "cost", F.element_at("w", F.col("start") + 1)["codes"].alias("codes"))
    chosen = written(chosen)

    # the edits of each turn, then the lines of the repaired conversation with their texts
    by_turn = chosen.select("conv_id", "piece", F.posexplode(F.regexp_extract_all("codes", F.lit("[ua]*[KDUA]|[ua]+$"), F.lit(0))).alias("k", "code"))
    order_in = Window.partitionBy("conv_id", "piece").orderBy("place")
    numbered = narrow.select("conv_id", "piece", "place", (F.row_number().over(order_in) - 1).alias("k"))
    a, b = by_turn.alias("a"), numbered.alias("b")
    at = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.k") == F.col("b.k")), "left")
    at = at.select("a.conv_id", "a.piece", "a.k", "a.code", "b.place")
    texts = turns.select("place", F.struct("role", "text").alias("t"))
    lines = at.join(texts, "place", "left").select("conv_id", "piece", "k", _audit(F.col("code")).alias("audit"), _lines(F.filter(F.array("t"), lambda t: t.isNotNull()), F.col("code")).alias("lines"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The audit and the digest of each conversation of a sorted partition, line by line."""
        of, audit, digest, some = None, [], None, False
        result = lambda: pd.DataFrame({"of": pd.array([of[0]], dtype="Int64"), "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})
        for batch in batches:
            for conv, letters, text in zip(batch["conv_id"].astype("Int64"), batch["audit"], batch["lines"], strict=True):
                if of is None or (conv is pd.NA) != (of[0] is pd.NA) or (conv is not pd.NA and conv != of[0]):
                    if of is not None:
                        yield result()
                    of, audit, digest, some = (conv,), [], hashlib.sha256(), False
                audit.append(letters)
                for line in text:
                    digest.update((b"\n" if some else b"") + line.encode())
                    some = True
        if of is not None:
            yield result()

    streamed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "k").mapInPandas(told, "of long, audit string, repaired_sha256 string")
    numbers = narrow.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("turn").alias("numbers"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    flags = narrow.groupBy("conv_id").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pairs = chosen.groupBy("conv_id").agg((F.sum("illegal") + F.sum("between")).alias("illegal"), F.min("cost").alias("cost"))
    out = numbers.select("conv_id", _gaps(F.col("numbers")).alias("gaps"))
    for more in (flags, pairs, streamed.withColumnRenamed("of", "conv_id")):
        renamed = more.withColumnRenamed("conv_id", "_c")
        out = out.join(renamed, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return out.withColumn("texts", F.lit(None).cast("array<string>"))


def op11_repair(spark, sf_dir):
    return repaired(damaged(table(spark, sf_dir, "conversations"))).drop("texts")
