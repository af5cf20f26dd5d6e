"""Repairs against all sequences of edits of small conversations; long ones in pieces; damage and edge rows against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from plumbline.llm import repair

SF = "/root/testdata/sf0.01"


def all_edits(rows):
    """(cost, audit, repaired) of the best of all sequences of edits; rows: (role, text, kind of fault)."""
    best = None

    def go(i, cost, audit, out, inserted):
        nonlocal best
        if cost > 2 * len(rows):  # deleting everything is right
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
        else:
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*out, (r, text)], 0)
        for r in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*out, (r, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def by_dp(rows):
    """The same by costs forward: least (cost, audit) by rows read and last role, a string search of its own."""
    rows = [*rows, None]
    layer = {"": (0, "", [])}
    for row in rows:
        for _ in range(3):
            for state, (c, a, o) in list(layer.items()):
                for r in ("user", "assistant"):
                    if (state, r[0]) in {("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                        new = (c + 5, a + "I", [*o, (r, "")])
                        if r[0] not in layer or new[:2] < layer[r[0]][:2]:
                            layer[r[0]] = new
        if row is None:
            return min((x for s, x in layer.items() if s in ("", "a")), key=lambda x: x[:2])
        role, text, fault = row
        following = {}
        for state, (c, a, o) in layer.items():
            found = [(state, (c + 2, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                found += [(role[:1], (c + more, a + "K", [*o, (role, text)]))] + [(r[0], (c + 1 + more, a + "R", [*o, (r, text)])) for r in ("user", "assistant")]
            for to, new in found:
                if (to == state and new[1].endswith("D")) or (state, to) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    if to not in following or new[:2] < following[to][:2]:
                        following[to] = new
        layer = following
    raise AssertionError


def plain(rows, search=all_edits):
    """{conv_id: all columns} for (conv_id, turn, role, text) rows."""
    said = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        role, text, how = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if how != 0:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faulty = set(), []
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, kept = search(faulty)
        count = lambda f: sum(x[2] == f for x in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


def got(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


@pytest.mark.parametrize("seed", range(60))
def test_all_sequences(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), f"t{k}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for k in range(rng.randrange(0, 6))]
    letter = {"s": "s", "u": "u", "a": "a"}
    kinds = "".join("d" if f in ("blank", "duplicate") else letter.get(r[:1], "x").upper() if f else letter.get(r[:1], "x") for r, _, f in rows)
    codes, cost = repair.edits(kinds)
    want = all_edits(rows)
    assert (cost, codes.translate(str.maketrans("UAua", "RRII"))) == want[:2]
    assert by_dp(rows)[:2] == want[:2]


def rows_of(rng, conversations, most):
    texts = ["Yes.", "No!", "well", "", " \t", None, "é?", "Why? ", "ok.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", ""]
    rows = []
    for c in [*range(conversations), None]:
        for t in range(rng.randrange(0, most)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(9)}."))
    return rows + rows[:5]


def test_query_rows(spark):
    rows = rows_of(random.Random(1), 150, 7)
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, gone int, kind string")
    assert got(repair.repaired(repair.damaged(frame))) == plain(rows, by_dp)
    assert repair.repaired(repair.damaged(frame.limit(0))).count() == 0


def test_long_conversations(spark, monkeypatch):
    """Every conversation in pieces of four turns, over several ranges: the same as in one."""
    monkeypatch.setattr(repair, "MAX_ROWS", 3)
    monkeypatch.setattr(repair, "CHUNK", 4)
    rng = random.Random(2)
    rows = rows_of(rng, 12, 40) + [(77, None, "user", "Again.")] * 30
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert got(repair.repaired(repair.damaged(frame))) == plain(rows, by_dp)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op11_repair(spark, SF)) == plain(rows, by_dp)
