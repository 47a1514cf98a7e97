"""Conversation repair against all edit sequences of short conversations, and its defined results."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from geoframe.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text, deleted, truncated) of rows in order, and the counts of faults."""
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    return out, counts


def brute_force(rows):
    """The cheapest edits, least in ASCII, by trying all of them with up to two Inserts in a place."""
    rows, _ = faults(rows)
    inserts = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    choices = []
    for role, text, deleted, truncated in rows:
        own = [("D", 3, None)]
        if not deleted:
            own += [("K", truncated, f"{role}:{text}"), *(("R", 2 + truncated, f"{r}:{text}") for r in ("user", "assistant"))]
        choices.append([(["I"] * len(i) + [a], 2 * len(i) + cost, [f"{r}:" for r in i] + ([line] if line is not None else [])) for i in inserts for a, cost, line in own])
    choices.append([(["I"] * len(i), 2 * len(i), [f"{r}:" for r in i]) for i in inserts])
    for picked in itertools.product(*choices):
        lines = [x for p in picked for x in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(x[:1] if not x.startswith(":") else "-" for x in lines)):
            found = (sum(p[1] for p in picked), "".join(x for p in picked for x in p[0]), "\n".join(lines))
            best = found if best is None else min(best, found)
    return best


def solved(spark, rows, block=conversations.BLOCK):
    """Repairs without damage: audit, cost and text by conversation."""
    turns = conversations.read(spark.createDataFrame(rows, SCHEMA))
    return {r.conv_id: r for r in conversations.repair(turns).collect()}


def test_short_conversations_equal_all_edit_sequences(spark):
    dice = random.Random(5)
    pick = lambda: (dice.choice(["user", "user", "assistant", "assistant", "system", "tool", ""]), dice.choice(["Yes.", "No!", "so", " ", "well, "]))
    talks = [[pick() for _ in range(n)] for n in (0, 1, 1, 2, 2, 2, 2, *[3] * 8)]
    got = solved(spark, [(c, t, *row) for c, rows in enumerate(talks) for t, row in enumerate(rows)])
    for c, rows in enumerate(talks):
        if rows:
            want, counts = brute_force(rows), faults(rows)[1]
            assert (got[c].cost, got[c].audit, got[c].repaired) == want, rows
            assert {k: got[c][k] for k in counts} == counts


def test_blocks_of_any_size_give_the_same_trace(spark):
    dice = random.Random(9)
    rows = [(c, t, dice.choice(["user", "assistant", "system", "x"]), dice.choice(["Aha.", f"Number {t}.", "and then"])) for c in range(12) for t in range(dice.choice([1, 7, 8, 9, 40]))]
    flags = conversations.flagged(conversations.read(spark.createDataFrame(rows, SCHEMA)))
    turns = flags.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "initial", "role", "text", (F.col("blank") | F.col("duplicate")).alias("deleted"), "truncated"))).alias("turns"))
    for r in turns.select(*(conversations.cheapest("turns", b).alias(f"b{b}") for b in (1, 4, 256))).collect():
        assert r.b1 == r.b4 == r.b256


def test_a_conversation_of_thousands_of_turns(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}.") for t in range(2000)]
    got = solved(spark, rows)[1]
    letters = re.sub("I", "", got.audit)
    assert len(letters) == 2000 and got.gaps == 0
    # an Insert before the first turn, in each of the 666 pairs of users, and after the last turn; each
    # mends one fault of its own, so fewer edits can't do
    assert got.illegal == 666 and got.audit.count("I") == 668 and got.cost == 2 * 668
    roles = "".join(x[0] for x in got.repaired.split("\n"))
    assert re.fullmatch("(ua)+", roles)


def test_damage_by_kind(spark):
    keys = {}
    for t in range(400):
        keys.setdefault(zlib.crc32(f"8:{t}".encode()) % 20, t)
    rows = [(8, keys[k], "assistant", "One. Two! Three?") for k in range(6)]
    got = conversations.damage(conversations.read(spark.createDataFrame(rows, SCHEMA))).collect()
    of = lambda k: [(r.role, r.text, r.gone) for r in got if r.turn == keys[k]]
    assert of(0) == [("assistant", "One. Two! Three?", True)]
    assert of(1) == [("assistant", "", False)]
    assert of(2) == [("assistant", "One Two Three", False)]
    assert of(3) == [("assistant", "One. Two! Three?", False)] * 2
    assert of(4) == [("user", "One. Two! Three?", False)]
    assert of(5) == [("assistant", "One. Two! Three?", False)]


def test_nulls_ties_gaps_and_repeated_rows(spark):
    rows = [
        (1, None, "user", "A."), (1, 3, "assistant", "B."), (1, 7, "user", "C."), (1, 7, "user", "C."), (1, 7, "assistant", "D."),
        (2, None, None, None), (2, None, "user", "\t\r"),
        (None, 1, "user", "Hm."), (None, 1, "assistant", "Hm."),
    ]
    got = solved(spark, rows)
    # turns 3 and 7: a span of 5 with 2 numbers; of turn 7 the assistant's row comes first
    assert got[1].gaps == 3 and got[1].duplicate == 1 and got[1].illegal == 2
    assert (got[1].cost, got[1].audit) == (7, "KKIKKDI")
    assert (got[2].gaps, got[2].blank, got[2].audit, got[2].cost, got[2].repaired) == (0, 2, "DD", 6, "")
    assert got[None].audit == brute_force([("assistant", "Hm."), ("user", "Hm.")])[1] == "IKKI"


def test_conversations_without_rows_empty_tables_and_clashing_columns(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "x")], f"{SCHEMA}, place int, Kind string")
    got = conversations.damaged_and_repaired(rows).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text", ["x" * 2_000_000 + ".", "ü" * 500_000])
def test_long_texts(spark, text):
    got = solved(spark, [(1, 0, "user", text), (1, 1, "assistant", "Ok.")])[1]
    assert got.repaired == f"user:{text}\nassistant:Ok." and got.truncated == (not text.endswith("."))
