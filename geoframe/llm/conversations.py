"""Repair of conversation structure by one higher-order fold.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``.  Window functions
give each turn its place and its first fault: blank, duplicate of an earlier turn, or
truncated.  The turns of a conversation are collected in order, and ``aggregate`` folds over
them.  It carries a (cost, audit) struct for each of the four states of the pattern: nothing
yet, after the system turn, after a user turn, after an assistant turn.  ``least`` over structs
compares cost, then audit, so ties go to the audit that is least in ASCII.

Keeping only the least struct of a state is enough: audits that have used up the same turns at
the same cost differ in a turn's letter (the letters decide the cost), so neither begins with
the other, and what is added to both doesn't change their order.  An Insert right before a
Delete never is in the least audit, as ``DI`` costs the same and comes first.

In the fold each letter carries the initial that its turn ends up with (``Ku``, ``Ra``, ``Ia``,
``D-``), from which the repaired turns are read off.  The letters of an audit imply these
initials, so they don't change the order.  Long conversations are folded in blocks: a block's
four structs from each entry state, then a fold over blocks, so the work grows almost in
proportion to the turns.

Everything is SQL expressions on one shuffle by conversation.  Windows spill.  A conversation's
repaired text is one value, as its hash is one pass over the whole, so it has to fit into a value
(2 GB).

Defined results: a null in any column counts as one space in texts, roles and the key of the
damage; null turns come first and don't count for gaps; rows with a null conversation are one
conversation.  Rows of the same turn are ordered by role and text, so the result doesn't depend
on the order of reading; equal rows are duplicates.  Roles with other initials can't be kept.
A conversation without rows gives zeros, an empty audit and the hash of an empty string.  An
empty table gives no rows.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; what an undeleted truncated turn adds; white space.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
STATES = ("none", "system", "user", "assistant")
BLOCK = 256


def read(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and ``gone`` (false), nulls of role and text as one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(False).alias("gone"))


def damage(turns: DataFrame) -> DataFrame:
    """Damages turns by crc32 of ``conv_id:turn``, mod 20: 0 drops (``gone`` becomes true), 1
    empties the text, 2 removes its ``.!?``, 3 repeats the turn, 4 makes the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    hurt = turns.withColumn("_kind", kind).withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return hurt.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("gone") | (F.col("_kind") == 0)).alias("gone"),
    )


def flagged(turns: DataFrame) -> DataFrame:
    """Adds place (from 1), blank, duplicate, truncated, illegal (with the turn before) and
    fresh (first row of its turn number).  Rows that are gone come last and have no faults."""
    order = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    here = ~F.col("gone")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    placed = turns.withColumns(
        {
            "place": F.row_number().over(order),
            "initial": F.substring("role", 1, 1),
            "before": F.lag(F.substring("role", 1, 1)).over(order),
            "fresh": here & F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(order) == F.col("turn"), F.lit(False)),
        }
    )
    blank = here & (bare == "")
    again = here & ~blank & (F.row_number().over(same) > 1)
    return placed.withColumns(
        {
            "blank": blank,
            "duplicate": again,
            "truncated": here & ~blank & ~again & ~F.substring(bare, -1, 1).isin(".", "!", "?"),
            "illegal": here & F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au"),
        }
    ).drop("before")


def _plus(state: str, cost: str, trace: str) -> str:
    """SQL of the struct after more edits; a state that can't be reached stays null, which least() skips."""
    return f"if({state} is null, null, named_struct('cost', {state}.cost + {cost}, 'trace', concat({state}.trace, {trace})))"


def _states(none: str, system: str, user: str, assistant: str) -> str:
    return f"named_struct('none', {none}, 'system', {system}, 'user', {user}, 'assistant', {assistant})"


def _start(entry: str) -> str:
    zero, never = "named_struct('cost', 0L, 'trace', '')", "cast(null as struct<cost:bigint,trace:string>)"
    return _states(*(zero if s == entry else never for s in STATES))


def _step() -> str:
    """SQL of the four structs after a turn; the Inserts before it are part of the step."""
    extra = f"if(turn.truncated, {TRUNCATED}, 0)"
    letters = lambda initial: f"if(turn.initial = '{initial}', 'K{initial}', 'R{initial}')"
    price = lambda initial: f"if(turn.initial = '{initial}', 0, {RETYPE}) + {extra}"
    gone = lambda state: _plus(f"at.{state}", str(DELETE), "'D-'")
    put = lambda state, initial: f"if(turn.deleted, null, {_plus(f'at.{state}', price(initial), letters(initial))})"
    after = lambda state, added, initial: f"if(turn.deleted, null, {_plus(f'at.{state}', f'{INSERT} + {price(initial)}', f"'I{added}', {letters(initial)}")})"
    kept = f"if(turn.deleted or turn.initial <> 's', null, {_plus('at.none', extra, "'Ks'")})"
    return _states(
        gone("none"),
        f"least({gone('system')}, {kept})",
        f"least({gone('user')}, {put('none', 'u')}, {put('system', 'u')}, {put('assistant', 'u')}, {after('user', 'a', 'u')})",
        f"least({gone('assistant')}, {put('user', 'a')}, {after('none', 'u', 'a')}, {after('system', 'u', 'a')}, {after('assistant', 'u', 'a')})",
    )


def _joined() -> str:
    """SQL of the four structs after a block whose structs from each entry state are known."""
    through = lambda i, s, t: f"if(block[{i}].{t} is null, null, {_plus(f'at.{s}', f'block[{i}].{t}.cost', f'block[{i}].{t}.trace')})"
    return _states(*(f"least({', '.join(through(i, s, t) for i, s in enumerate(STATES))})" for t in STATES))


def cheapest(turns: str = "turns", block: int = BLOCK) -> Column:
    """(cost, trace) of the cheapest repair of an array of turns; the trace has two characters an edit."""
    fold = lambda part, entry: f"aggregate({part}, {entry}, (at, turn) -> {_step()})"
    each = f"transform(array({', '.join(map(_start, STATES))}), entry -> {fold(f'slice({turns}, k * {block} + 1, {block})', 'entry')})"
    blocks = f"transform(if(size({turns}) > {block}, sequence(1, cast((size({turns}) - 1) div {block} as int)), cast(array() as array<int>)), k -> {each})"
    # a system turn alone is never worth two Inserts, as its Delete is cheaper
    end = f"least(at.none, at.assistant, {_plus('at.user', str(INSERT), "'Ia'")})"
    return F.expr(f"aggregate({blocks}, {fold(f'slice({turns}, 1, {block})', _start('none'))}, (at, block) -> {_joined()}, at -> {end})")


def _repaired(turns: Column, trace: Column) -> Column:
    """The repaired turns as role:text lines."""
    pieces = F.split(trace, "(?<=[DKR][sua-])", -1)
    added = lambda piece: F.when(piece.startswith("Iu"), "user:").when(piece.startswith("Ia"), "assistant:")
    last = lambda piece: F.substring(piece, -2, 2)
    line = lambda turn, piece: F.when(last(piece).startswith("K"), F.concat(turn["role"], F.lit(":"), turn["text"])).when(last(piece) == "Ru", F.concat(F.lit("user:"), turn["text"])).when(last(piece) == "Ra", F.concat(F.lit("assistant:"), turn["text"]))
    lines = F.transform(turns, lambda turn, i: F.array(added(F.get(pieces, i)), line(turn, F.get(pieces, i))))
    return F.concat_ws("\n", F.flatten(lines), added(F.get(pieces, F.size(turns))))


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``turns`` (as from ``read`` or ``damage``): conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit and repaired, the repaired turns' lines."""
    kept = F.when(~F.col("gone"), F.struct("place", "initial", "role", "text", (F.col("blank") | F.col("duplicate")).alias("deleted"), "truncated"))
    seen = F.when(~F.col("gone"), F.col("turn"))
    count = lambda name: F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0)).alias(name)
    gathered = flagged(turns).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(kept)).alias("turns"),
        F.coalesce(F.max(seen) - F.min(seen) + 1 - F.sum(F.col("fresh").cast("long")), F.lit(0)).alias("gaps"),
        *map(count, ("blank", "duplicate", "truncated", "illegal")),
    )
    solved = gathered.withColumn("best", cheapest())
    return solved.select(
        "conv_id",
        "gaps",
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        F.col("best.cost").alias("cost"),
        F.translate("best.trace", "sua-", "").alias("audit"),
        _repaired(F.col("turns"), F.col("best.trace")).alias("repaired"),
    )


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Damages the conversations and repairs what is left; digests of the repaired text."""
    out = repair(damage(read(conversations)))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.col("repaired"), 256).alias("repaired_sha256"))
