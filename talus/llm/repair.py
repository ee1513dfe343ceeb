"""Conversation structure repair by edit distance to the alternating grammar.

A well-formed conversation reads, by the first letters of its roles,
``(s?(ua)+)?``: an optional system turn, then user and assistant in turn, or
nothing. Each turn is kept (cost 0), given the role user or assistant (1) or
deleted (2); a turn without text may be inserted (5). A turn that is blank or
that repeats an earlier one must go; a truncated one that stays costs 5 more.

Faults, order and counts are windows and aggregates over the conversation. The
repair depends on a short signature only: one letter for each turn, the initial
in lower case, in upper case if truncated, or ``-`` for a turn that must go.
Signatures are aligned with the Wagner-Fischer recurrence to every feasible
length of the grammar string; since the string alternates and ends with an
assistant, one table over (turns left, letters left) holds the alignments to
all lengths. Rows of the table are kept in a band around the number of turns
that can stay (Ukkonen): the cheapest repair found in a narrow band is the
incumbent, and the band widens until whatever leaves it costs more than the
incumbent, so the result is exact. All lengths of least cost are traced back
side by side, each by the optimal edit that sorts first, and the audit that
sorts first wins.

Memory holds one segment of the table and a row for each segment; the time for
n turns is n bands, and a band is as wide as the damage. A conversation passes
through one task, as its digest has to.

Nulls in role and text are one space; null turns come first; turns that share a
number come in the order of role and text, and equal rows are repeats. A null
conversation is one conversation. Rows that are not ``present`` only say that
their conversation exists; one without rows has an empty audit and no faults.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, RELABEL, CUT_OFF = 2, 5, 1, 5
CELLS = 1 << 20  # of the table held at once, more or less
_FAR = 1 << 40
_PLAN = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("kept", pa.list_(pa.int32())), ("roles", pa.list_(pa.string()))])


class Alignment:
    """Least costs of turning the turns from i on into the last m letters of an alternating string that ends with ``a``."""

    def __init__(self, turns: str) -> None:
        self.turns, self.n = turns, len(turns)
        # for each turn: the cost where a user (m even) or an assistant (m odd) is asked for
        self.match = np.array([[self._match(t, letter) for letter in "ua"] for t in turns], np.int64).reshape(-1, 2)
        stays = np.array([t.islower() for t in turns], np.int64)
        self.centre = [*np.cumsum(stays[::-1])[::-1].tolist(), 0]
        self.forced = DELETE * (self.n - self.centre[0])

    @staticmethod
    def _match(turn: str, letter: str) -> int:
        return _FAR if turn == "-" else (turn.lower() != letter) * RELABEL + turn.isupper() * CUT_OFF

    def solve(self) -> tuple[int, str]:
        """Least cost, and of its audits the one that sorts first."""
        width = 8
        while True:
            self._fill(width)
            best, states = self._cheapest()
            # outside the band every letter less costs a deletion, and every letter more at least as much
            if DELETE * (width + 1) > best - self.forced:
                return best, self._audit(states)
            width = min(2 * width, (best - self.forced) // DELETE)

    def _fill(self, width: int) -> None:
        self.width, self.step = width, max(1, self.n * (2 * width + 1) // CELLS)
        self.saved: dict[int, np.ndarray] = {}
        self.openings: list[tuple[int, int, np.ndarray]] = []  # (cost before, first turn, its row)
        for i, row in self._rows(self.n, None, 0):
            if i % self.step == 0 or i == self.n:
                self.saved[i] = row
            if i and self.turns[i - 1] in "sS":
                before = DELETE * (i - 1) + CUT_OFF * self.turns[i - 1].isupper()
                self.openings.append((before, i, row[self._even(i, 2)].min(initial=_FAR)))

    def _rows(self, start: int, row: np.ndarray | None, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """The rows from one turn back to another; cell j of row i stands for centre[i] - width + j letters."""
        span = np.arange(2 * self.width + 1)
        if row is None:
            letters = self.centre[start] - self.width + span
            row = np.where(letters >= 0, INSERT * letters, _FAR)
        yield start, row
        slope = INSERT * span
        for i in range(start - 1, stop - 1, -1):
            letters = self.centre[i] - self.width + span
            shift = self.centre[i] - self.centre[i + 1]
            padded = np.concatenate([[_FAR], row, [_FAR]])
            deleted = padded[1 + shift : len(row) + 1 + shift] + DELETE
            matched = padded[shift : len(row) + shift] + self.match[i][letters & 1]
            base = np.where(letters >= 0, np.minimum(deleted, matched), _FAR)
            row = np.minimum(np.minimum.accumulate(base - slope) + slope, _FAR)
            yield i, row

    def _even(self, i: int, least: int) -> slice:
        """The cells of an even number of letters, ``least`` or more."""
        low = self.centre[i] - self.width
        first = max(least, low + low % 2)
        return slice(first - low, None, 2)

    def _cheapest(self) -> tuple[int, set[tuple[int, int]]]:
        """The least cost and its targets: (letters, turn that is its system turn or -1)."""
        row = self.saved[0]
        best = min([int(row[self._even(0, 0)].min(initial=_FAR)), *[before + int(low) for before, _, low in self.openings]])
        targets = {(self._letters(0, j), -1) for j in self._at(row, 0, 0, best)}
        for before, i, low in self.openings:
            if before + low == best:
                targets |= {(self._letters(i, j), i - 1) for j in self._at(self._row(i), i, 2, best - before)}
        return best, targets

    def _at(self, row: np.ndarray, i: int, least: int, cost: int) -> list[int]:
        cells = self._even(i, least)
        return [cells.start + 2 * int(j) for j in np.flatnonzero(row[cells] == cost)]

    def _letters(self, i: int, cell: int) -> int:
        return self.centre[i] - self.width + cell

    def _row(self, i: int) -> np.ndarray:
        if i in self.saved:
            return self.saved[i]
        first = i - i % self.step
        if getattr(self, "segment", (None,))[0] != (first, self.width):
            last = min(first + self.step, self.n)
            self.segment = ((first, self.width), dict(self._rows(last, self.saved[last], first)))
        return self.segment[1][i]

    def _cost(self, i: int, letters: int) -> int:
        cell = letters - self.centre[i] + self.width
        return int(self._row(i)[cell]) if 0 <= cell <= 2 * self.width else _FAR

    def _edit(self, i: int, letters: int, system: int) -> tuple[str, tuple[int, int]]:
        """The optimal edit that sorts first and the state after it."""
        if system >= 0:
            return ("D", (letters, system)) if i < system else ("K", (letters, -1))
        cost = self._cost(i, letters)
        if i < self.n and cost == self._cost(i + 1, letters) + DELETE:
            return "D", (letters, -1)
        if letters and cost == self._cost(i, letters - 1) + INSERT:
            return "I", (letters - 1, -1)
        if i < self.n and letters:
            return "KR"[self.turns[i].lower() != "ua"[letters & 1]], (letters - 1, -1)
        return "", (0, -1)

    def _audit(self, states: set[tuple[int, int]]) -> str:
        """All optimal targets traced together: they have the same edits so far, hence stand at the same turn."""
        edits, i = [], 0
        while True:
            steps = [self._edit(i, *state) for state in states]
            edit = min(e for e, _ in steps)
            if not edit:
                return "".join(edits)
            states = {state for e, state in steps if e == edit}
            edits.append(edit)
            i += edit != "I"


@lru_cache(maxsize=1 << 14)
def plan(turns: str) -> tuple[int, str, list[int | None], list[str | None]]:
    """Cost, audit, and for each turn of the repaired conversation the place of the old turn and the new role, where there is one."""
    cost, audit = Alignment(turns).solve()
    size = len(audit) - audit.count("D")
    kept, roles, i = [], [], 0
    for edit in audit:
        if edit != "D":
            left = size - len(kept)
            kept.append(None if edit == "I" else i)
            roles.append(None if edit == "K" else ROLES["ua"[left & 1]])
        i += edit != "I"
    return cost, audit, kept, roles


def _planned(signature: Column) -> Column:
    @F.arrow_udf("struct<cost:bigint,audit:string,kept:array<int>,roles:array<string>>")
    def run(turns: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("cost", "audit", "kept", "roles"), plan(t))) for t in turns.to_pylist()], _PLAN)

    return run(signature)


def damage(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20; ``present`` is false where a row has been dropped."""
    space = F.lit(" ")
    draw = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in (conv_id, turn)])) % 20
    said = F.coalesce(F.col(text), space)
    return turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(draw == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        (draw != 0).alias("present"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair(
    turns: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (role and text of each turn)."""
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    )
    order = Window.partitionBy("conv").orderBy(F.desc("present"), F.col("turn").asc_nulls_first(), "role", "text")
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(order), initial)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("place"),
        (F.col("present") & F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))).alias("illegal"),
        (F.col("present") & F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn"))).alias("new_turn"),
    )
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1
    fault = F.when(end == "", "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    own = F.when(F.col("present"), F.struct("place", sign.alias("sign"), "role", "text"))

    def count(condition: Column) -> Column:
        return F.count_if(condition & F.col("present")).cast("bigint")

    real = F.when(F.col("present"), F.col("turn"))
    kinds = ("blank", "duplicate", "truncated")
    whole = rows.groupBy("conv").agg(
        F.coalesce(F.max(real) - F.min(real) + 1 - F.count_if("new_turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[count(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k) for k in kinds],
        F.count_if("illegal").cast("bigint").alias("illegal"),
        F.sort_array(F.collect_list(own)).alias("rows"),
    )
    whole = whole.withColumn("plan", _planned(F.array_join(F.transform("rows", lambda x: x.sign), "")))

    def turned(x: Column) -> Column:
        old = F.get(F.col("rows"), x.kept)
        return F.struct(F.coalesce(x.roles, old.role).alias("role"), F.coalesce(old.text, F.lit("")).alias("text"))

    repaired = F.transform(F.arrays_zip(F.col("plan.kept").alias("kept"), F.col("plan.roles").alias("roles")), turned)
    return whole.select(
        F.col("conv").alias(conv_id), "gaps", *kinds, "illegal", "plan.cost", "plan.audit", repaired.alias("repaired")
    )
