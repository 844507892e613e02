"""Conversation structure repair: the cheapest edits that make a conversation well formed, by Knuth's lightest derivation.

Role initials of a repaired conversation read ``(s?(ua)+)?``: nothing, or turns
of user and assistant, before them at most one system row. Edits: Keep (0),
Rerole to user or assistant (1), Delete (2; required for blank and duplicate
rows), Insert an empty user or assistant row (5); a truncated row that is not
deleted adds 5. Of the cheapest edit lists the one whose initials (K, R, D, I)
come first in ASCII order is taken.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statlake.llm.common import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What has been read so far (nothing, system, user, assistant) -> role initial -> what has been read then.
MOVES: dict[str, dict[str, str]] = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FINAL = ("", "a")
NAMES = {"u": "user", "a": "assistant"}
#: Rows derived at once: item keys are strings of this length, about.
SEGMENT_ROWS = 256

Axioms = dict[str, tuple[int, str]]


def lightest(rows: list[tuple[str, int]], axioms: Axioms, goals: tuple[str, ...], enough: int) -> Axioms:
    """Goal states after all ``rows`` with their least (cost, audit), in the order in which they finalise, at most ``enough``.

    Items are (rows consumed, state). Each deduction joins an item with an
    edit of the next row (or an insertion) to a further item, adding the
    edit's cost and appending its initial. The agenda pops the least (cost,
    audit) of all items; an item is final when popped first. That needs
    superior, monotone functions: costs only grow and audits only get longer,
    and of two audits of one item with equal costs neither begins the other
    (both consumed the same rows, so the rest would be insertions, which
    cost), hence appending an edit to both keeps their order.

    ``rows``: (role initial, fault) with fault 0 none, 1 must be deleted, 2
    truncated. ``axioms``: state -> (cost, audit) before the first row.
    """
    end = len(rows)
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    final: set[tuple[int, str]] = set()
    found: Axioms = {}
    while agenda and len(found) < enough:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == end and state in goals:
            found[state] = (cost, audit)
        moves = MOVES[state]
        edits = [(INSERT, "I", at, moves[r]) for r in NAMES if r in moves]
        if at < end:
            initial, fault = rows[at]
            edits.append((DELETE, "D", at + 1, state))
            if fault != 1:
                more = TRUNCATED if fault == 2 else 0
                if initial in moves:
                    edits.append((KEEP + more, "K", at + 1, moves[initial]))
                edits += [(REROLE + more, "R", at + 1, moves[r]) for r in NAMES if r in moves]
        for weight, letter, to, then in edits:
            if (to, then) not in final:
                heapq.heappush(agenda, (cost + weight, audit + letter, to, then))
    return found


class Repair:
    """The derivation of one conversation, fed in order in segments: only the least item of each state passes a border.

    At a border an audit is its base (up to the last consumed row) and its
    trailing insertions. Bases have consumed the same rows, so different ones
    differ before either ends, and a base's rank can stand for it in all later
    comparisons; the texts of audits are kept apart as linked pieces.
    """

    def __init__(self, segment_rows: int = SEGMENT_ROWS) -> None:
        self.segment_rows, self.rows = segment_rows, []
        self.axioms: Axioms = {"": (0, "")}
        self.pieces: dict[str, tuple | None] = {"": None}  # first character of an axiom's audit -> (earlier pieces, text)

    def add(self, initial: str, fault: int) -> None:
        if len(self.rows) >= self.segment_rows:
            self._pass(lightest(self.rows, self.axioms, tuple(MOVES), len(MOVES)))
            self.rows = []
        self.rows.append((initial, fault))

    def _whole(self, audit: str) -> tuple[tuple | None, str]:
        head = audit[:1] if audit[:1] in self.pieces and audit[:1] else ""
        return self.pieces[head], audit[len(head):]

    def _pass(self, found: Axioms) -> None:
        bases = sorted({audit.rstrip("I") for _, audit in found.values()})
        rank = {base: chr(0x100 + i) for i, base in enumerate(bases)}
        self.axioms = {state: (cost, rank[audit.rstrip("I")] + audit[len(audit.rstrip("I")):]) for state, (cost, audit) in found.items()}
        self.pieces = {"": None} | {rank[base]: self._whole(base) for base in bases}

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        ((cost, audit),) = lightest(self.rows, self.axioms, FINAL, 1).values()
        before, text = self._whole(audit)
        out = [text]
        while before is not None:
            before, text = before
            out.append(text)
        return cost, "".join(reversed(out))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): ``conversations`` with faults by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``present`` false: its conversation still counts), 1
    empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it the
    user's. A null id, turn, role or text reads as one space here; null ids
    and turns stay null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                spaced("role").alias("role"), spaced("text").alias("text"), code.alias("code"))
    text = (F.when(F.col("code").isin(0, 1), "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    copies = F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("code") != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


_BLANK = r"[^\x20\x09-\x0D]"
_ORDER = ("conv_id", "kind", "turn", "role", "key", "again")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation: turn (nulls first), then role, then the text's digest, then copies of a row."""
    return rows.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))


def _streamed(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*_ORDER)


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _faults(text: Column, again: Column) -> Column:
    """A row's first fault: 1 blank, 2 duplicate, 3 truncated; else 0."""
    last = F.regexp_extract(text, r"(" + _BLANK + r")[\x20\x09-\x0D]*\z", 1)
    return F.when(~text.rlike(_BLANK), 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def repair_report(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: turn gaps, rows by fault, illegal neighbours, and cost and audit of the cheapest repair.

    ``rows``: (conv_id, turn, role, text, present), as :func:`damaged` returns
    them; rows that are not present only name their conversation. Null turns
    come first; rows of one turn are ordered by role and text digest, equal
    rows are copies. Rows with a null conv_id are one conversation, returned
    with a null id. A null role or text reads as one space, so such a text is
    blank and such a role is never kept. Other columns are ignored; an empty
    table gives no rows. A conversation without present rows has zeros and an
    empty audit.

    Texts stay where they are: what travels is a row's initial, fault and
    digest. Earlier rows with equal role and text are found by a window per
    (conversation, role, text). A conversation then passes one task as a sorted
    stream, in segments, so its rows are never held together.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    seen = W.partitionBy("conv_id", "present", "role", "key").orderBy(F.col("turn").asc_nulls_first())
    narrow = (_keyed(rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "present"))
              .withColumn("fault", _faults(F.col("text"), F.lit(False)).cast("int")).drop("text")
              .withColumn("again", (F.row_number().over(seen) > 1))
              .select("conv_id", F.when(F.col("present"), 1).otherwise(0).alias("kind"), "turn", "role", "key", "again",
                      F.substring("role", 1, 1).alias("initial"),
                      F.when(F.col("again") & (F.col("fault") != 1), 2).otherwise(F.col("fault")).alias("fault")))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(conv, state):
            repair, turns, counts, illegal = state[:4]
            cost, audit = repair.finish()
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            return (conv, gaps, counts[1], counts[2], counts[3], illegal, cost, audit)

        def flush(out):
            return pa.record_batch([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out))],
                                   names=[f.split()[0] for f in _REPORT.split(", ")])

        now, state, out = None, None, []
        for batch in batches:
            for conv, kind, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "initial", "fault"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(report(now, state))
                    now, state = conv, [Repair(segment_rows), [0, 0, 0], [0] * 4, 0, None]
                if not kind:
                    continue
                turns = state[1]
                if turn is not None and (not turns[2] or turn != turns[1]):
                    turns[0], turns[1], turns[2] = turns[0] if turns[2] else turn, turn, turns[2] + 1
                state[2][fault] += 1
                if state[4] is not None and state[4] + initial not in ("su", "ua", "au"):
                    state[3] += 1
                state[4] = initial
                state[0].add(initial, 2 if fault == 3 else int(fault > 0))
            if len(out) >= 1000:
                yield flush(out)
                out = []
        if state is not None:
            out.append(report(now, state))
        if out:
            yield flush(out)

    return _streamed(narrow).mapInArrow(derive, _REPORT)


def _replayed(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Rows as they are streamed for repair, before those of a conversation its audit."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    full = _keyed(rows.where("present").select("conv_id", F.lit(1).alias("kind"), "turn", role.alias("role"), text.alias("text")))
    audits = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                           F.col("audit").alias("text"), F.lit("").alias("key"))
    return _streamed(full.unionByName(audits).withColumn("again", F.lit(False)))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, turn, role, text) of each edit in order; ('', None ...) opens a conversation."""
    audit, at, state, conv = "", 0, "", None

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = next(MOVES[state][r] for r in NAMES if r in MOVES[state])
            at += 1
            yield conv, "I", None, NAMES[state], ""

    opened = False
    for batch in batches:
        for c, kind, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "kind", "turn", "role", "text"))):
            if not kind:
                if opened:
                    yield from inserts()
                audit, at, state, conv, opened = text, 0, "", c, True
                yield conv, "", None, None, None
                continue
            yield from inserts()
            edit = audit[at]
            at += 1
            if edit == "R":
                state = next(MOVES[state][r] for r in NAMES if r in MOVES[state])
                role = NAMES[state]
            elif edit == "K":
                state = MOVES[state][role[:1]]
            yield conv, edit, turn, role, text
    if opened:
        yield from inserts()


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the rows of the repaired conversations, deleted ones left out."""
    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "position", "edit", "turn", "role", "text"])

        out, position, size = [], 0, 0
        for conv, edit, turn, role, text in _edits(batches):
            if not edit:
                position = 0
            elif edit != "D":
                out.append((conv, position, edit, turn, role, text))
                position, size = position + 1, size + len(text)
                if len(out) >= 512 or size > 1 << 22:
                    yield flush(out)
                    out, size = [], 0
        if out:
            yield flush(out)

    return _replayed(rows, report).mapInArrow(replay, "conv_id long, position long, edit string, turn long, role string, text string")


def repaired_digests(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired ``role:text`` rows joined by newlines, fed row by row."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string()))], names=["conv_id", "repaired_sha256"])

        out, now, sha, first = [], None, None, True
        for conv, edit, _, role, text in _edits(batches):
            if not edit:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha, first = conv, hashlib.sha256(), True
                if len(out) >= 1000:
                    yield flush(out)
                    out = []
            elif edit != "D":
                sha.update((("" if first else "\n") + role + ":").encode())
                sha.update(text.encode())
                first = False
        if sha is not None:
            out.append((now, sha.hexdigest()))
        if out:
            yield flush(out)

    return _replayed(rows, report).mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """:func:`repair_report` with the digest of the repaired conversation.

    The digest is one sequential hash over a conversation's texts, so these
    pass one task as a stream, row by row.
    """
    report = materialize(repair_report(rows), "repair-report")
    digests = repaired_digests(rows, report).withColumnRenamed("conv_id", "id")
    return report.join(digests, report["conv_id"].eqNullSafe(digests["id"])).drop("id")
