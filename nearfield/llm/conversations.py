"""Conversation structure repair by an auction for shortest paths.

The rows of a conversation, in order of turn, are to become a sequence of roles that may be trained on: nothing, or pairs of
user and assistant after one system row at most. A row may be kept, given another role, or deleted, and empty rows may be
inserted; each edit has an integer cost. Row number times the state of that grammar is a lattice whose arcs are edits, and
the cheapest edits are a shortest path.

The path is found by an auction (Bertsekas): every node has a price, and no price is higher than the cost of an arc out of it
and the price at the arc's end. The path starts with its origin alone. Where the last node's price is lower than that of its
best arc it rises to that and the path is cut back by a node; else the path grows along the best arc, until it ends at the
sink. Then prices are duals of a shortest path: an arc lies on a cheapest way just where it is tight (price equal to cost
and price at its end) and tight arcs lead on to the sink. Of the tight ways the one with the least letters is traced.

Long conversations are solved in segments from the last to the first: a segment's sink arcs carry the cheapest costs of what
follows, for each state, so its prices are exact with few rows in memory. A segment's ways end with the edit of its last row
and are no prefixes of each other, so the least letters of the whole are those of its segments in turn. Segments of equal
signs are solved once a worker.

Three shuffles: copies are found among (conversation, role, digest of the text), the slim rows (no text) of a conversation go
to one task in order, and so do the texts with the edits found. A conversation is read as a stream: of each row one letter is
held, never a text. Its digest is serial by its definition, so the rows of one conversation end in one task, in bounded memory.

Defined cases: null conv_id, role or text, and a null turn in the damage's key, are read as one space; null turns come first;
rows of one turn are in order of role, then of the digest of their text; rows without conv_id are one conversation; repeated
rows are copies, of which the first stays; a conversation without rows has zeros and the empty audit; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table

#: States of the grammar ``(s?(ua)+)?`` of role initials: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state after a user or assistant row, the only kind that may come next in each state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Costs of stopping in each state at the end of a conversation; None: it can't stop there.
STOP = (0, None, None, 0)
#: The white space that makes a text blank, and may follow its last sign.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a segment, and segments that a worker remembers.
SEGMENT, REMEMBER = 32, 20_000


def lattice(signs: str, stop: tuple[int | None, ...]) -> list[list[tuple[str, int, int]]]:
    """Arcs (letter, cost, end) of each node 4 * row + state; the last node is the sink.

    A sign is a row: ``x`` must be deleted; s, u, a, o are initials (o: any other), in capitals if the row is truncated. Rows
    are inserted before a row; after the last one only where there is no row at all, so that a segment ends with its last row.
    """
    n = len(signs)
    sink = 4 * n + 4
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(sink + 1)]
    for i in range(n + 1):
        for q in (START, SYSTEM, USER, ASSISTANT):
            out = arcs[4 * i + q]
            if i < n or not n:
                out.append(("I", INSERT, 4 * i + NEXT[q]))
            if i == n:
                if stop[q] is not None:
                    out.append(("", stop[q], sink))
                continue
            out.append(("D", DELETE, 4 * (i + 1) + q))
            if signs[i] == "x":
                continue
            extra = TRUNCATED if signs[i].isupper() else 0
            initial = signs[i].lower()
            if initial == "s" and q == START:
                out.append(("K", KEEP + extra, 4 * (i + 1) + SYSTEM))
            if initial == "ua"[NEXT[q] == ASSISTANT]:
                out.append(("K", KEEP + extra, 4 * (i + 1) + NEXT[q]))
            out.append(("R", REROLE + extra, 4 * (i + 1) + NEXT[q]))
    return arcs


def auction(arcs: list[list[tuple[str, int, int]]], origins: tuple[int, ...]) -> list[int]:
    """Prices of all nodes after a path from each origin has reached the sink, the last node.

    They hold for one origin after the other: no price is ever higher than an arc's cost and the price at its end.
    """
    sink = len(arcs) - 1
    price = [0] * len(arcs)
    for origin in origins:
        path = [origin]
        while (node := path[-1]) != sink:
            best, to = min((cost + price[end], end) for _, cost, end in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def tight(arcs: list[list[tuple[str, int, int]]], price: list[int]) -> list[list[tuple[str, int]]]:
    """(letter, end) of each node's arcs that are tight and lead to the sink over tight arcs, least letters first."""
    back: list[list[tuple[str, int]]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for letter, cost, end in out:
            if price[node] == cost + price[end]:
                back[end].append((letter, node))
    kept: list[list[tuple[str, int]]] = [[] for _ in arcs]
    seen, todo = {len(arcs) - 1}, [len(arcs) - 1]
    while todo:
        end = todo.pop()
        for letter, node in back[end]:
            kept[node].append((letter, end))
            if node not in seen:
                seen.add(node)
                todo.append(node)
    return [sorted(k) for k in kept]


@lru_cache(REMEMBER)
def segment(signs: str, stop: tuple[int | None, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each state before a segment: the cheapest cost to the end, the least letters of a cheapest way, the state after."""
    arcs = lattice(signs, stop)
    price = auction(arcs, (START, SYSTEM, USER, ASSISTANT))
    ways = tight(arcs, price)
    out = []
    for node in (START, SYSTEM, USER, ASSISTANT):
        cost, letters = price[node], []
        while node != len(arcs) - 1:
            state = node % 4
            letter, node = ways[node][0]
            letters.append(letter)
        out.append((cost, "".join(letters), state))
    return tuple(out)


def cheapest(signs: str) -> tuple[int, str]:
    """The cost of the cheapest edits of a conversation and, of those, the least letters."""
    base, stop, parts = 0, STOP, []
    for at in range(-(-len(signs) // SEGMENT) * SEGMENT, -1, -SEGMENT):
        found = segment(signs[at : at + SEGMENT], stop)
        parts.append([(letters, after) for _, letters, after in found])
        least = min(c for c, _, _ in found)  # costs are kept small, so that equal segments are found again
        base, stop = base + least, tuple(c - least for c, _, _ in found)
    state, audit = START, []
    for found in reversed(parts):
        letters, state = found[state]
        audit.append(letters)
    return base + stop[START], "".join(audit)


# ---------------------------------------------------------------- rows
def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after the damage of the contract; a dropped row stays with null role and text."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    made = rows.select("conv_id", "turn", F.when(kind == 0, None).when(kind == 4, F.lit("user")).otherwise(role).alias("role"), F.when(kind != 0, text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return made.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def signed(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault): rows without their text; fault is blank, duplicate, truncated or null.

    A row without role marks its conversation only.
    """
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select("conv_id", "turn", "role", _digest(F.col("text")).alias("digest"), (text == "").alias("blank"), (~F.substring(text, -1, 1).isin(".", "!", "?")).alias("cut"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("role").isNull(), None).when(F.col("blank"), "blank").when(earlier, "duplicate").when(F.col("cut"), "truncated")
    return slim.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows of each conversation in one partition, side by side and in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Each conversation of a sorted stream with its rows, which are read as they are asked for."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda row: row[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, most_signs: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and size."""
    held, signs = [], 0
    for row in rows:
        held.append(row)
        signs += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or signs >= most_signs:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, signs = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _judged(rows: Iterator[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit) of the signed rows of a conversation in order."""
    signs, count = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    first = turn_before = before = None
    turns = illegal = 0
    for _, turn, role, initial, fault in rows:
        if role is None:
            continue
        if turn is not None and turn != turn_before:
            first, turn_before, turns = turn if first is None else first, turn, turns + 1
        illegal += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
        sign = initial if initial in ("s", "u", "a") else "o"
        if fault is not None:
            count[fault] += 1
            sign = sign.upper() if fault == "truncated" else "x"
        signs.append(sign)
    cost, audit = cheapest("".join(signs))
    return (turn_before - first + 1 - turns if turns else 0, *count.values(), illegal, cost, audit)


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """conv_id and the report of each conversation: gaps, counts of faults, illegal neighbours, cost and audit."""
    small_batches(rows.sparkSession)
    slim = signed(rows).withColumn("turn", F.col("turn").cast("long"))
    slim = _in_order(slim, F.col("turn").asc_nulls_first(), "role", "digest", (F.coalesce("fault", F.lit("")) == "duplicate")).select("conv_id", "turn", "role", "initial", "fault")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_REPORT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(((conv, *_judged(own)) for conv, own in _conversations(batches)), to_arrow_schema(kind))

    kind = rows.sparkSession.createDataFrame([], schema).schema
    return slim.mapInArrow(run, schema)


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows of a repaired conversation, read from (role, text) as the audit says."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "user" if NEXT[state] == USER else "assistant"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        yield letter, role, text


def _woven(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The texts of each conversation in order after its report, which comes as a first row."""
    names = [f.split()[0] for f in _REPORT.split(", ")]
    texts = rows.where(F.col("role").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", _digest(F.col("text")).alias("digest"))
    both = report.select("conv_id", F.struct(*names).alias("report")).unionByName(texts, allowMissingColumns=True)
    return _in_order(both, F.col("report").isNull(), F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "report", "role", "text")


def _edits(own: Iterator[tuple]) -> tuple[dict, Iterator[tuple[str, str, str]]]:
    """The report of a woven conversation, and its repaired rows."""
    _, report, _, _ = next(own)
    return report, edited(report["audit"], ((role, text) for _, _, role, text in own))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of each conversation after its cheapest edits, of its rows as they are.

    ``rows`` has conv_id, turn, role and text without nulls in the last two; a null role only marks a conversation.
    """
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string"
    kind = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = ((conv, place, *edit) for conv, own in _conversations(batches) for place, edit in enumerate(_edits(own)[1]))
        yield from _batches(made, to_arrow_schema(kind))

    return _woven(rows, audits(rows)).mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, the report, and the SHA-256 of the repaired rows of each conversation, as ``role:text`` joined by newlines."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_REPORT}, repaired_sha256 string"
    kind = rows.sparkSession.createDataFrame([], schema).schema

    def digest(own: Iterator[tuple]) -> tuple:
        report, edits = _edits(own)
        made = hashlib.sha256()
        for k, (_, role, text) in enumerate(edits):
            made.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        return (*report.values(), made.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(((conv, *digest(own)) for conv, own in _conversations(batches)), to_arrow_schema(kind))

    return _woven(rows, audits(rows)).mapInArrow(run, schema)


def op11_repair(spark, sf_dir: str) -> DataFrame:
    """The report and the digest of the cheapest repair of each conversation of the damaged table."""
    return digests(damaged(table(spark, sf_dir, "conversations")))
