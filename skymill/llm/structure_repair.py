"""Cheapest repairs of conversations whose roles must read ``(s?(ua)+)?``: a shortest path over scalar weights.

A path through the rows of a conversation carries one integer. Its high digits are the cost; below them stands one
fixed-width digit per audit letter, in order, with zeros after the last, so that adding an edit adds its cost and writes its
letter at once, and the smaller integer is the cheaper edit or, at equal cost, the audit that is first in ASCII order. The
audit is read back from the digits of the smallest integer; no back pointers are kept.

Rows become one symbol each (role initial and fault), and only symbols, never texts, meet in the search. Slices of ``SLICE``
rows are solved on their own from every grammar state to every other, and a conversation composes its slices. Its texts are
hashed by one sorted stream that holds a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skymill.llm.tables import text_batches
from skymill.operators.ordered import row_index
from skymill.runtime import cut

SLICE = 4_096
LETTERS = ".DIKR"  # the audit letters by their digit, in ASCII order; zero is the end
BITS = 3
CLEAN, TRUNCATED, BLANK, DUPLICATE = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3  # what the repaired rows end with so far
INITIALS = "xsua"  # any other initial is x
ENTERS = {START: {SYSTEM, USER}, SYSTEM: {USER}, USER: {ASSISTANT}, ASSISTANT: {USER}}
ROLES = {USER: "user", ASSISTANT: "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def most_inserts(self, rows: int) -> int:
        """A bound of the rows that a cheapest edit inserts.

        Deleting all rows is an edit, which bounds the cost. And an inserted row with its partner of a user-assistant
        pair, and a system row that would be left alone, can be deleted: none is inserted where that costs less.
        """
        return 0 if self.insert > 2 * self.delete else self.delete * rows // max(self.insert, 1)


def scalar(cost: int, audit: str, width: int) -> int:
    digits = 0
    for letter in audit:
        digits = digits << BITS | LETTERS.index(letter)
    return cost << BITS * width | digits << BITS * (width - len(audit))


def read(weight: int, width: int) -> tuple[int, str]:
    digits = weight & (1 << BITS * width) - 1
    each = (digits >> BITS * (width - 1 - i) & 7 for i in range(width))
    return weight >> BITS * width, "".join(LETTERS[d] for d in each if d)


@lru_cache(maxsize=20_000)
def solve(symbols: str, inserts: int, costs: Costs, starts: tuple[int, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """``(from, to, cost, audit)`` of the smallest weight between grammar states, for each number of inserted rows."""
    width, out = len(symbols) + inserts, []
    for start in starts:
        reached = {(start, 0): 0}
        for i in range(len(symbols) + 1):
            digit = BITS * (width - 1 - i)
            for j in range(inserts):
                for state in (START, SYSTEM, USER, ASSISTANT):
                    if (w := reached.get((state, j))) is not None:
                        w += (costs.insert << BITS * width) + (LETTERS.index("I") << digit - BITS * j)
                        for after in ENTERS[state] - {SYSTEM}:
                            reached[after, j + 1] = min(w, reached.get((after, j + 1), w))
            if i == len(symbols):
                break
            fault, initial = divmod(ord(symbols[i]) - 97, 4)
            extra, before, reached = costs.truncated if fault == TRUNCATED else 0, reached, {}
            for (state, j), w in before.items():
                moves = [("D", costs.delete, state)]
                if fault in (CLEAN, TRUNCATED):
                    moves += [("K", extra, after) for after in ENTERS[state] if after == initial]
                    moves += [("R", costs.rerole + extra, after) for after in ENTERS[state] - {SYSTEM}]
                for letter, cost, after in moves:
                    v = w + (cost << BITS * width) + (LETTERS.index(letter) << digit - BITS * j)
                    reached[after, j] = min(v, reached.get((after, j), v))
        out += [(start, state, *read(w, width)) for (state, _), w in sorted(reached.items())]
    return tuple(out)


def compose(parts: list, inserts: int) -> tuple[int, str]:
    """Cost and audit of a whole conversation from those of its slices: ``(rows, entries of solve)`` in order."""
    done, sofar = 0, [(START, START, 0, "")]
    for rows, entries in parts:
        done, best = done + rows, {}
        width = done + inserts
        for a in sofar:
            for b in entries:
                if a[1] == b[0] and len(a[3]) + len(b[3]) <= width:
                    key, w = (b[1], len(a[3]) + len(b[3])), scalar(a[2] + b[2], a[3] + b[3], width)
                    best[key] = min(w, best.get(key, w))
        sofar = [(START, state, *read(w, width)) for (state, _), w in best.items()]
    width = done + inserts
    return read(min(scalar(cost, audit, width) for _, state, cost, audit in sofar if state in (START, ASSISTANT)), width)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after damage by crc32(``conv_id:turn``) % 20; other columns are left out.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 sets its role to user. A null
    role or text is one space, and so is a null id or turn in what is hashed.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def _symbol(repeated: Column) -> Column:
    last = F.expr(r"right(trim(TRAILING ' \t\n\u000b\f\r' FROM text), 1)")
    fault = F.when(last == "", BLANK).when(repeated, DUPLICATE).when(F.locate(".", last) + F.locate("!", last) + F.locate("?", last) == 0, TRUNCATED).otherwise(CLEAN)
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)
    return F.char(F.lit(97) + 4 * fault + initial)


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_c")


def repair(rows: DataFrame, conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every id of ``conversations``.

    ``rows``: ``conv_id, turn, role, text`` without null roles and texts, and ``copy``, which orders equal rows. A
    conversation is its rows by turn, nulls first, then by role and text; null ids are one conversation. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (does not
    end in ``.``, ``!`` or ``?``). Keeping costs nothing; blank and duplicate rows must be deleted; an undeleted truncated row
    costs more; any row that is not deleted may become a user or an assistant row; empty user and assistant rows may be
    inserted. Rows that repeat are duplicates of the first. Without rows: zeros, an empty audit, the hash of nothing.
    An empty table gives no row.
    """
    keyed = rows.select(_key(), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("_t"), "turn", "role", "text", "copy")
    placed = row_index(keyed, ["_c"], ["_t", "role", "text", "copy"], 1024, out="place").select("_c", "place", "turn", "role", "text", F.sha2("text", 256).alias("_sha"))
    placed = cut(placed)
    first = placed.groupBy(F.col("_c").alias("_fc"), F.col("role").alias("_fr"), F.col("_sha").alias("_fs")).agg(F.min("place").alias("_first"))
    marked = placed.join(first, (F.col("_c") == F.col("_fc")) & (F.col("role") == F.col("_fr")) & (F.col("_sha") == F.col("_fs")))
    marked = marked.select("_c", "place", _symbol(F.col("place") > F.col("_first")).alias("symbol"))
    slices = marked.groupBy("_c", F.floor(F.col("place") / SLICE).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("place", "symbol"))).alias("_s"))
    slices = cut(slices.select("_c", "slice", F.array_join(F.transform("_s", lambda x: x["symbol"]), "").alias("symbols")))
    sizes = slices.groupBy(F.col("_c").alias("_sc")).agg(F.sum(F.length("symbols")).alias("rows"))

    @F.pandas_udf("array<struct<a int, b int, cost long, audit string>>")
    def solved(symbols: pd.Series, slice_no: pd.Series, size: pd.Series) -> pd.Series:
        starts = [(START,) if k == 0 else (START, SYSTEM, USER, ASSISTANT) for k in slice_no]
        got = [solve(s, costs.most_inserts(int(n)), costs, at) for s, at, n in zip(symbols, starts, size)]
        return pd.Series([[dict(zip(("a", "b", "cost", "audit"), e)) for e in g] for g in got], index=symbols.index)

    sized = slices.join(sizes, F.col("_c") == F.col("_sc"))
    parts = sized.select("_c", "slice", "symbols", "rows", solved("symbols", "slice", "rows").alias("entries"))

    @F.pandas_udf("blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    def whole(slices_: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = []
        for ordered, n in zip(slices_, size):
            s = "".join(p["symbols"] for p in ordered)
            faults, initials = [(ord(c) - 97) // 4 for c in s], [INITIALS[(ord(c) - 97) % 4] for c in s]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            entries = [(len(p["symbols"]), [(e["a"], e["b"], e["cost"], e["audit"]) for e in p["entries"]]) for p in ordered]
            out.append((faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, *compose(entries, costs.most_inserts(int(n)))))
        return pd.DataFrame(out, columns=["blank", "duplicate", "truncated", "illegal", "cost", "audit"], index=slices_.index)

    together = parts.groupBy("_c", "rows").agg(F.sort_array(F.collect_list(F.struct("slice", "symbols", "entries"))).alias("_p"))
    results = together.select("_c", whole("_p", "rows").alias("_r")).select("_c", "_r.*")
    turns = placed.where("turn IS NOT NULL").select("_c", F.col("turn").cast("decimal(38,0)").alias("turn")).distinct()
    gaps = turns.groupBy("_c").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    known = conversations.select(_key(), "conv_id").distinct()
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    known = cut(known.join(results, "_c", "left").join(gaps, "_c", "left").select("_c", "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit")))
    lines = placed.select("_c", "place", "role", "text").unionByName(known.select("_c", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    with text_batches(rows.sparkSession):
        hashes = cut(lines.repartition("_c").sortWithinPartitions("_c", "place").mapInPandas(_hashes, "_c string, repaired_sha256 string"))
    return known.join(hashes, "_c").drop("_c")


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation's repaired rows; its audit comes first, at place -1, then its rows in order."""
    now = digest = None
    edits, state, lines = iter(()), START, 0

    def say(role: str, text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
        lines += 1

    def next_edit() -> str | None:
        """Says the rows inserted here and returns the letter that follows."""
        nonlocal state
        for letter in edits:
            if letter != "I":
                return letter
            state = ASSISTANT if state == USER else USER
            say(ROLES[state], "")
        return None

    def ended() -> list[tuple[str, str]]:
        if now is None:
            return []
        next_edit()
        return [(now, digest.hexdigest())]

    for frame in frames:
        out = []
        for key, place, role, text in zip(frame["_c"], frame["place"], frame["role"], frame["text"]):
            if place < 0:
                out += ended()
                now, digest, edits, state, lines = key, hashlib.sha256(), iter(text), START, 0
                continue
            letter = next_edit()
            if letter == "K":
                state = INITIALS.index(role[0])
                say(role, text)
            elif letter == "R":
                state = ASSISTANT if state == USER else USER
                say(ROLES[state], text)
        yield pd.DataFrame(out, columns=["_c", "repaired_sha256"])
    yield pd.DataFrame(ended(), columns=["_c", "repaired_sha256"])


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the ``damaged`` rows of a table, for every id that the table holds; its defaults are the contract's costs."""
    return repair(damaged(conversations), conversations)
