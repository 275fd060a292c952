"""Repair of conversations: the cheapest edits that make the turns alternate.

Roles have to read ``(s?(ua)+)?`` by their initials: nothing, or a user and an assistant by turns, after a system row perhaps.
Edits are Keep (0), Rerole to user or assistant (2), Delete (3, and a must for blank rows and duplicates) and Insert an empty
user or assistant row (2); a truncated row that stays costs 1 more. Row numbers and what the roles so far allow make a
lattice whose edges are edits. Dijkstra runs from both ends: the forward heap orders by cost and then by audit (the initials
of the edits), the reverse one by cost. They stop when no path through what is left can be as cheap as the best; then all
crossings of the best cost are closed, each is completed by the least walk over tight edges, and the least audit wins.

Conversations may have any length. Rows are dealt out by ranges of conversation and order, so a long one lies in several
partitions, and a partition goes through its rows in segments of ``SEGMENT`` rows. Of a segment that may not be a whole
conversation the best path between each two states comes out; a conversation's segments are then joined by these, a
few numbers and letters each. Only the digest of a repaired text runs over a conversation in order, piece by piece.

Defined results: a null in any column counts as one space, except that turns that are null come first and are no gap; ties
of turn are ordered by role and text, a repeated row is next to its first; roles are compared by their first letter as it is;
a conversation of which no row is left has zeros, an empty audit and the digest of an empty text; texts of any length are rows
of their own; further columns aren't looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.llm.common import cut

_WHITE = " \t\n\x0b\x0c\r"
#: What edits cost, and what ends a sentence.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ENDS = (".", "!", "?")
#: Rows of a segment.
SEGMENT = 512
#: States: nothing yet, after a system row, after a user row, after an assistant row. The role that each allows next.
STATES, ACCEPT = 4, (0, 3)
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_NEXT = ("u", "u", "a", "u")
_NAME = {"u": "user", "a": "assistant"}
#: Inserts that complete a conversation which ends in each state.
_TAIL = ("", "II", "I", "")


# -- faults, in SQL


def _spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, gone``: damaged rows by a checksum; dropped ones stay as marks without text."""
    kind = F.pmod(F.crc32(F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn"))).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """With ``fault``: b(lank), d(uplicate), t(runcated) or nothing, the first that holds. Rows are found again by a digest of their text."""
    bare = F.rtrim("text", F.lit(_WHITE))
    digest = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    again = F.row_number().over(W.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(F.col("gone"), "").when(bare == "", "b").when(again, "d").when(~F.right(bare, F.lit(1)).isin(*ENDS), "t").otherwise("")
    return digest.withColumn("fault", fault)


# -- the lattice


class Lattice:
    """Nodes (row, state) of one segment: ``initials`` and ``faults`` of its rows. ``tail`` lets it end in inserts."""

    def __init__(self, initials: Sequence[str], faults: Sequence[str], tail: bool = True):
        self.initials, self.faults, self.n, self.tail = initials, faults, len(initials), tail

    def after(self, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, cost and end of each edge from a node, in the order of letters."""
        if i < self.n:
            yield "D", DELETE, i + 1, q
        if i < self.n or self.tail:
            yield "I", INSERT, i, _STEP[q, _NEXT[q]]
        if i < self.n and self.faults[i] not in ("b", "d"):
            more = TRUNCATED if self.faults[i] == "t" else 0
            if (to := _STEP.get((q, self.initials[i]))) is not None:
                yield "K", KEEP + more, i + 1, to
            yield "R", REROLE + more, i + 1, _STEP[q, _NEXT[q]]

    def before(self, i: int, q: int) -> Iterator[tuple[int, int, int]]:
        """Cost and start of each edge into a node."""
        for p in range(STATES):
            for j in (i - 1, i):
                if j >= 0:
                    for _, cost, to, state in self.after(j, p):
                        if (to, state) == (i, q):
                            yield cost, j, p

    def cheapest(self, start: int = 0, ends: Sequence[int] = ACCEPT) -> tuple[int, str] | None:
        """The least cost, and of all paths of that cost the least audit, from a state to one of ``ends``; None if there is no path."""
        forward: dict[tuple[int, int], tuple[int, str]] = {}
        reverse: dict[tuple[int, int], int] = {}
        ahead: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
        back: list[tuple[int, int, int]] = [(0, self.n, q) for q in ends]
        best = None
        while (ahead or back) and (best is None or (ahead[0][0] if ahead else 0) + (back[0][0] if back else 0) <= best):
            if ahead and (not back or ahead[0][0] <= back[0][0]):
                cost, audit, i, q = heapq.heappop(ahead)
                if (i, q) in forward:
                    continue
                forward[i, q] = cost, audit
                if (i, q) in reverse:
                    best = min(cost + reverse[i, q], best if best is not None else cost + reverse[i, q])
                for letter, more, j, p in self.after(i, q):
                    if (j, p) not in forward:
                        heapq.heappush(ahead, (cost + more, audit + letter, j, p))
                    if (j, p) in reverse and (best is None or cost + more + reverse[j, p] < best):
                        best = cost + more + reverse[j, p]
            else:
                cost, i, q = heapq.heappop(back)
                if (i, q) in reverse:
                    continue
                reverse[i, q] = cost
                for more, j, p in self.before(i, q):
                    if (j, p) not in reverse:
                        heapq.heappush(back, (cost + more, j, p))
                    if (j, p) in forward and (best is None or cost + more + forward[j, p][0] < best):
                        best = cost + more + forward[j, p][0]
                if (i, q) in forward and (best is None or cost + forward[i, q][0] < best):
                    best = cost + forward[i, q][0]
        if best is None:
            return None
        found = [forward[v][1] + self._rest(v, reverse, ends) for v in forward.keys() & reverse.keys() if forward[v][0] + reverse[v] == best]
        for (i, q), (cost, audit) in forward.items():  # crossings between two nodes
            for letter, more, j, p in self.after(i, q):
                if cost + more + reverse.get((j, p), best + 1) == best:
                    found.append(audit + letter + self._rest((j, p), reverse, ends))
        return best, min(found)

    def _rest(self, v: tuple[int, int], reverse: dict, ends: Sequence[int]) -> str:
        """The least walk over tight edges to an end: each letter leads to one node, so the least letter is right."""
        out: list[str] = []
        while reverse[v] > 0 or v[0] < self.n or v[1] not in ends:
            letter, v = next((x, (j, p)) for x, more, j, p in self.after(*v) if reverse.get((j, p), 1 << 60) + more == reverse[v])
            out.append(letter)
        return "".join(out)

    def between(self) -> list[tuple[int, int, int, str]]:
        """Start, end, cost and audit of the best path between each two states."""
        return [(p, q, *x) for p in range(STATES) for q in range(STATES) if (x := self.cheapest(p, (q,))) is not None]


def repaired(roles: Sequence[str], texts: Sequence[str], audit: str, state: int = 0) -> list[str]:
    """``role:text`` of the rows that an audit leaves, from a state on."""
    out, rows = [], iter(zip(roles, texts))
    for letter in audit:
        if letter == "I":
            role, text = _NAME[_NEXT[state]], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = _NAME[_NEXT[state]]
        state = _STEP[state, role[:1]]
        out.append(f"{role}:{text}")
    return out


# -- segments


_SEGMENT = (
    "segment long, whole boolean, n long, first_turn long, last_turn long, turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired string, roles array<string>, texts array<string>, paths array<struct<start:int,stop:int,cost:long,audit:string>>"
)
_PAIRS = ("su", "ua", "au")


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """One row a segment, in the order of ``segment`` within a conversation.

    ``whole`` segments are conversations with their repair; others have their rows and the paths between states.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def row(conv, segment, part, whole):
        live = [r for r in part if not r["gone"]]
        roles, texts, faults = [r["role"] for r in live], [r["text"] for r in live], [r["fault"] for r in live]
        initials = [r[:1] for r in roles]
        turns = [r["turn"] for r in live if r["turn"] is not None]  # in order
        out = {"conv_id": conv, "segment": segment, "whole": whole, "n": len(live), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns))}
        out |= {"first_role": initials[0] if live else None, "last_role": initials[-1] if live else None}
        out |= {"blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": sum(x + y not in _PAIRS for x, y in zip(initials, initials[1:]))}
        if whole:
            cost, audit = Lattice(initials, faults).cheapest()
            return out | {"cost": cost, "audit": audit, "repaired": "\n".join(repaired(roles, texts, audit)), "roles": None, "texts": None, "paths": None}
        paths = [dict(zip(("start", "stop", "cost", "audit"), x)) for x in Lattice(initials, faults, tail=False).between()]
        return out | {"cost": None, "audit": None, "repaired": None, "roles": roles, "texts": texts, "paths": paths}

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        begun = True  # what is held may go on from another segment or partition
        done: list[dict] = []
        schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if held and r["conv_id"] != held[0]["conv_id"]:
                        done.append(row(held[0]["conv_id"], number, held, not begun))
                        number, held, begun = number + 1, [], False
                    elif len(held) >= most:
                        done.append(row(held[0]["conv_id"], number, held, False))
                        number, held, begun = number + 1, [], True
                    held.append(r)
                schema = schema or pa.schema([batch.schema.field("conv_id"), *_arrow_fields()])
                if len(done) >= 64:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
        if held:
            done.append(row(held[0]["conv_id"], number, held, False))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("copy")]
    dealt = rows.select("conv_id", "turn", "role", "digest", "copy", "text", "fault", "gone").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text", "fault", "gone").mapInArrow(run, f"conv_id {kind}, {_SEGMENT}")


def _arrow_fields() -> list[pa.Field]:
    longs = lambda *names: [pa.field(n, pa.int64()) for n in names]
    path = pa.struct([pa.field("start", pa.int32()), pa.field("stop", pa.int32()), pa.field("cost", pa.int64()), pa.field("audit", pa.string())])
    strings = pa.list_(pa.string())
    return [*longs("segment"), pa.field("whole", pa.bool_()), *longs("n", "first_turn", "last_turn", "turns"), pa.field("first_role", pa.string()), pa.field("last_role", pa.string()), *longs("blank", "duplicate", "truncated", "illegal", "cost"), pa.field("audit", pa.string()), pa.field("repaired", pa.string()), pa.field("roles", strings), pa.field("texts", strings), pa.field("paths", pa.list_(path))]


def choose(paths: Sequence[Sequence[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of a conversation, and start and audit of each of its segments, the last one with the inserts at its end.

    Audits that lead to different states differ before one of them ends (each ends with the same row's letter), so their
    rank is enough to compare what they go on to.
    """
    labels: dict[int, tuple[int, int]] = {0: (0, 0)}  # state: cost, rank
    steps: list[dict[int, tuple[int, str]]] = []
    for segment in paths:
        best: dict[int, tuple] = {}
        for p, q, cost, audit in segment:
            if p in labels:
                mine = (labels[p][0] + cost, labels[p][1], audit, p)
                if q not in best or mine < best[q]:
                    best[q] = mine
        ranks = {x: i for i, x in enumerate(sorted({(r, audit) for _, r, audit, _ in best.values()}))}
        labels = {q: (cost, ranks[r, audit]) for q, (cost, r, audit, _) in best.items()}
        steps.append({q: (p, audit) for q, (_, _, audit, p) in best.items()})
    cost, _, state = min((cost + INSERT * len(_TAIL[q]), rank, q) for q, (cost, rank) in labels.items())
    chosen: list[tuple[int, str]] = []
    tail = _TAIL[state]
    for step in reversed(steps):
        p, audit = step[state]
        chosen.append((p, audit + tail))
        state, tail = p, ""
    return cost, chosen[::-1]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that follow each other with the same conversation."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _joined(parts: DataFrame) -> DataFrame:
    """Conversations in several segments: a row with their numbers, and ``chosen``: segment, start and audit of each."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    longs = ("n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        for group in _conversations(batches):
            live = [r for r in group if r["n"]]
            cost, chosen = choose([[(x["start"], x["stop"], x["cost"], x["audit"]) for x in r["paths"]] for r in live])
            dated = [r for r in live if r["turns"]]
            turns = sum(r["turns"] for r in dated) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(dated, dated[1:]))
            out = {k: sum(r[k] for r in live) for k in ("n", "blank", "duplicate", "truncated", "illegal")}
            out["illegal"] += sum(x["last_role"] + y["first_role"] not in _PAIRS for x, y in zip(live, live[1:]))
            out |= {"conv_id": group[0]["conv_id"], "gaps": dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - turns if dated else 0, "cost": cost, "audit": "".join(a for _, a in chosen)}
            out["chosen"] = [{"segment": r["segment"], "start": s, "audit": a} for r, (s, a) in zip(live, chosen)]
            yield pa.RecordBatch.from_pylist([out])

    small = parts.select("conv_id", "segment", "n", "first_turn", "last_turn", "turns", "first_role", "last_role", "blank", "duplicate", "truncated", "illegal", "paths")
    ordered = small.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment")
    found = ordered.mapInArrow(_named(run, ["conv_id", *longs, "audit", "chosen"]), f"conv_id {kind}, {', '.join(f'{c} long' for c in longs)}, audit string, chosen array<struct<segment:long,start:int,audit:string>>")
    return cut(found, "joined")


def _named(run, names):
    """Columns in this order, with the types that the schema has."""
    ints = pa.struct([pa.field("segment", pa.int64()), pa.field("start", pa.int32()), pa.field("audit", pa.string())])

    def ordered(batches):
        for batch in run(batches):
            columns = [batch.column(c).cast(pa.list_(ints)) if c == "chosen" else batch.column(c).cast(pa.int64()) if pa.types.is_null(batch.column(c).type) else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ordered


def _pieces(parts: DataFrame, joined: DataFrame) -> DataFrame:
    """``conv_id, segment, repaired`` of segments that aren't whole."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (x,) = batch.slice(r, 1).to_pylist()
                lines = repaired(x["roles"], x["texts"], x["audit"], x["start"])
                text = pa.array(["\n".join(lines) if lines else None], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(r, 1), batch.column("segment").slice(r, 1), text], ["conv_id", "segment", "repaired"])

    chosen = joined.select(F.explode("chosen").alias("x")).select("x.*")
    return parts.select("conv_id", "segment", "roles", "texts").join(chosen, "segment").mapInArrow(run, f"conv_id {kind}, segment long, repaired string")


def digests(pieces: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of texts in pieces, which are read one after another; null pieces have no line."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv = digest = None
        begun = False

        def out():
            return pa.RecordBatch.from_arrays([conv, pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

        for batch in batches:
            for r in range(batch.num_rows):
                this, text = batch.column("conv_id").slice(r, 1), batch.column("repaired")[r].as_py()
                if digest is None or not this.equals(conv):
                    if digest is not None:
                        yield out()
                    conv, digest, begun = this, hashlib.sha256(), False
                if text is not None:
                    digest.update((b"\n" if begun else b"") + text.encode())
                    begun = True
        if digest is not None:
            yield out()

    ordered = pieces.select("conv_id", "segment", "repaired").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment")
    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame, most: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """A row a conversation (its faults, cost, audit and digest), and the repaired texts: ``conv_id, segment, repaired``.

    ``rows (conv_id, turn, role, text, copy, gone)`` as ``damage`` gives them; ``gone`` rows only name their conversation.
    """
    found = cut(segments(with_faults(rows), most), "segments")
    whole = found.where("whole")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    done = whole.withColumn("gaps", gaps).withColumn("repaired_sha256", F.sha2("repaired", 256)).select(*names)
    parts = found.where("not whole")
    joined = _joined(parts)
    pieces = cut(_pieces(parts, joined).unionByName(joined.select("conv_id", F.lit(-1).cast("long").alias("segment"), F.lit(None).cast("string").alias("repaired"))), "pieces")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    rest = joined.join(digests(pieces).select(F.col("conv_id").alias("c"), "repaired_sha256"), same).select(*names)
    return done.unionByName(rest), whole.select("conv_id", "segment", "repaired").unionByName(pieces.where("segment >= 0"))
