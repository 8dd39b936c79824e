"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows stand by turn (nulls first), then role and text.  Edits
make the initials of its roles read ``(s?(ua)+)?``:

* Keep: 0; Rerole to user or assistant: 2; Delete: 3, required for a blank row
  (no ``[^\\x20\\x09-\\x0D]``) and for a duplicate (role and text seen earlier);
* Insert a user or assistant row with empty text, anywhere: 2;
* an undeleted truncated row (last such character not ``[.!?]``) adds 1.

The audit holds the initials of a cheapest list of edits in order, of several
the least in ASCII.  What has been emitted so far is one of four states, so a
stretch of rows is summed up by its costs from state to state, and by the order
of its least audits from one state to the others: after a row no audit is the
prefix of another one of the same rows, so that order decides all later ties.

A stretch is repaired as Hirschberg does it: a forward vector of four costs
(with their order) and a backward one meet in its middle, the state there with
the least sum, and of equal ones the least audit, is where the repair crosses,
and both halves are repaired between known states.  Only vectors are kept.

The same works across tasks.  Rows are sorted by range over the cluster; a
leaf holds up to ``LEAF`` neighbouring rows of a conversation in one partition
and the sums of a leaf are sixteen costs and orders.  Conversations of several
leaves choose the crossings between partitions first and between the leaves of
a partition then, so a conversation of any length is never in one task; only
its digest reads the repaired rows one after the other, as a stream.

Cases: null roles and texts count as one space; a null turn stands first and
does not count in ``gaps``; rows without a conversation id are one conversation;
equal rows are counted, not kept, until they are repaired; rows that tie in
turn, role and text are equal; a conversation with no rows left has zeros, an
empty audit and the digest of the empty string; an empty table gives an empty
result.  Only the four columns are read, so other columns cannot clash.  An
audit is one string, so a conversation's edits must number below 2^31.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qtemplates.llm.common import WS_CHARS
from qtemplates.session import cut_lineage

#: Rows of a conversation, and characters of text, in a leaf (one row at least).
LEAF, LEAF_CHARS = 512, 1 << 20
#: The costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: What has been emitted: nothing, the system row, a user row last, an assistant row last.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_FAR = 1 << 60
#: State after an emitted initial.
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What a reroled or inserted row is in each state.
_OWN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Inserts that end a conversation in each state.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


@lru_cache(maxsize=None)
def edits(initial: str, forced: bool, truncated: bool) -> tuple:
    """For each state the (next state, cost, letters) that a row allows, the
    cheapest and least to each next state."""
    out = []
    for state in _STATES:
        best: dict = {state: (DELETE, "D")}
        at, inserts = state, 0
        while not forced and inserts <= 2:
            for cost, letter, to in ((KEEP, "K", _NEXT.get((at, initial))), (REROLE, "R", _NEXT[at, _OWN[at]])):
                if to is not None and (letter == "K" or initial != _OWN[at]):
                    new = (inserts * INSERT + cost + TRUNCATED * truncated, "I" * inserts + letter)
                    best[to] = min(best.get(to, (_FAR, "")), new)
            at, inserts = _NEXT[at, _OWN[at]], inserts + 1
        out.append(tuple((to, cost, letters) for to, (cost, letters) in best.items()))
    return tuple(out)


def _item(row: dict) -> tuple:
    """(edits of the row, deletes of its copies)."""
    forced = row["blank"] or row["again"]
    return edits("" if forced else row["role"][:1], forced, not forced and row["truncated"]), row["n"] - 1


def forward(items: list, lo: int, hi: int, state: int) -> tuple[list, list]:
    """Least costs from ``state`` before item ``lo`` to each state after item
    ``hi - 1``, and the order of the least audits that have them."""
    cost, order = [_FAR] * 4, [0] * 4
    cost[state] = 0
    for own, copies in items[lo:hi]:
        new: list = [(_FAR, 0, "")] * 4
        for p in _STATES:
            if cost[p] < _FAR:
                for q, c, letters in own[p]:
                    way = (cost[p] + c, order[p], letters)
                    if way < new[q]:
                        new[q] = way
        ranked = sorted((w[1:], q) for q, w in enumerate(new) if w[0] < _FAR)
        for place, (_, q) in enumerate(ranked):
            order[q] = place
        cost = [w[0] + DELETE * copies if w[0] < _FAR else _FAR for w in new]
    return cost, order


def backward(items: list, lo: int, hi: int, state: int) -> list:
    """Least costs from each state before item ``lo`` to ``state`` after item ``hi - 1``."""
    cost = [_FAR] * 4
    cost[state] = 0
    for own, copies in reversed(items[lo:hi]):
        cost = [min([_FAR, *(c + cost[q] + DELETE * copies for q, c, _ in own[p] if cost[q] < _FAR)]) for p in _STATES]
    return cost


def crossing(before: list, order: list, after: list) -> int:
    """The state with the least sum of both costs; of equal ones the least audit."""
    return min(_STATES, key=lambda q: (before[q] + after[q], order[q]))


def repaired(items: list, lo: int, hi: int, start: int, end: int) -> list[str]:
    """Letters of each item between two states."""
    if hi - lo == 1:
        own, copies = items[lo]
        return [next(letters for q, _, letters in own[start] if q == end) + "D" * copies]
    mid = (lo + hi) // 2
    cost, order = forward(items, lo, mid, start)
    q = crossing(cost, order, backward(items, mid, hi, end))
    return repaired(items, lo, mid, start, q) + repaired(items, mid, hi, q, end)


def last_state(cost: list, order: list) -> int:
    """The state in which the cheapest repair ends, least audit first."""
    return crossing(cost, order, [len(TAILS[q]) * INSERT for q in _STATES])


# ---- sums of stretches --------------------------------------------------------

def joined(a: dict, b: dict) -> dict:
    """The sums of two neighbouring stretches of a conversation."""
    costs, orders = [], []
    for p in _STATES:
        cost, order = a["cost"][4 * p:4 * p + 4], a["order"][4 * p:4 * p + 4]
        new: list = [(_FAR, 0, 0)] * 4
        for q in _STATES:
            for r in _STATES:
                c = b["cost"][4 * q + r]
                if cost[q] < _FAR and c < _FAR:
                    new[r] = min(new[r], (cost[q] + c, order[q], b["order"][4 * q + r]))
        own = [0] * 4
        for place, (_, r) in enumerate(sorted((w[1:], r) for r, w in enumerate(new) if w[0] < _FAR)):
            own[r] = place
        costs += [w[0] for w in new]
        orders += own
    return {"cost": costs, "order": orders}


def chosen(sums: list[dict], start: int, end: int) -> list[tuple[int, int]]:
    """The states (before, after) of each of some neighbouring stretches
    between two known states; crossings by halves, as within a stretch."""
    if len(sums) == 1:
        return [(start, end)]
    mid = len(sums) // 2
    one, two = _total(sums[:mid]), _total(sums[mid:])
    q = crossing(one["cost"][4 * start:4 * start + 4], one["order"][4 * start:4 * start + 4], [two["cost"][4 * p + end] for p in _STATES])
    return chosen(sums[:mid], start, q) + chosen(sums[mid:], q, end)


def _total(sums: list[dict]) -> dict:
    out = sums[0]
    for x in sums[1:]:
        out = joined(out, x)
    return out


# ---- jobs ---------------------------------------------------------------------

def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows) and the faults blank, again
    (a row with this role and text has an earlier turn) and truncated."""
    bare = F.btrim("text", F.lit(WS_CHARS))
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    key = F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))
    place = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn").alias("turn"))
    firsts = rows.groupBy(F.col("conv_id").alias("of"), key.alias("key")).agg(F.min(place).alias("first"))
    both = counted.withColumn("own", key).join(firsts, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("own") == F.col("key")))
    again = ~(F.col("first.late").eqNullSafe(F.col("turn").isNotNull()) & F.col("first.turn").eqNullSafe(F.col("turn")))
    return both.select("conv_id", "turn", "role", "text", "n", (bare == "").alias("blank"), again.alias("again"),
                       (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))


_NODE = "cost array<long>, order array<int>"
_FIGURES = "blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _figures(rows: list[dict]) -> dict:
    """Counts of the faults and turns of a leaf, with its ends."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": rows[0]["role"][:1], "last": rows[-1]["role"][:1], "low": None, "high": None, "turns": 0}
    before = None
    for r in rows:
        if r["blank"]:
            out["blank"] += r["n"]
        else:
            out["duplicate"] += r["n"] if r["again"] else r["n"] - 1
            out["truncated"] += r["truncated"] and not r["again"]
        initial = r["role"][:1]
        out["illegal"] += r["n"] - 1 + (before is not None and before + initial not in LEGAL)
        before = initial
        if r["turn"] is not None:
            out["turns"] += out["high"] != r["turn"]
            out["low"], out["high"] = r["turn"] if out["low"] is None else out["low"], r["turn"]
    return out


def _added(a: dict, b: dict) -> dict:
    """The figures of two neighbouring stretches."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL)
    out |= {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("blank", pa.bool_()), ("again", pa.bool_()), ("truncated", pa.bool_())])
_ROW_SQL = "struct<turn:long,role:string,text:string,n:long,blank:boolean,again:boolean,truncated:boolean>"
_NODE_PA = [("cost", pa.list_(pa.int64())), ("order", pa.list_(pa.int32()))]
_FIGURES_PA = [(c, pa.string() if c in ("first", "last") else pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")]


def leaves(rows: DataFrame, size: int = LEAF) -> DataFrame:
    """Leaves of all conversations: conv_id, part and seq (their order), rows,
    sums, figures, and whether the leaf is surely its conversation's only one."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("sole", pa.bool_()), ("rows", pa.list_(_ROW)), *_NODE_PA, *_FIGURES_PA])

    def leaf(conv, part, seq, sole, rows):
        items = [_item(r) for r in rows]
        ways = [forward(items, 0, len(items), p) for p in _STATES]
        return {"conv_id": conv, "part": part, "seq": seq, "sole": sole, "rows": rows, "cost": sum((w[0] for w in ways), []), "order": sum((w[1] for w in ways), [])} | _figures(rows)

    def run(batches):
        from pyspark import TaskContext
        part, seq, first, new = TaskContext.get().partitionId(), 0, True, True
        conv, rows, chars, out = None, [], 0, []
        for batch in batches:
            for r in batch.to_pylist():
                own = r.pop("conv_id")
                if rows and (own != conv or len(rows) >= size or chars >= LEAF_CHARS):
                    # a partition's first and last conversation may go on in its neighbours
                    out.append(leaf(conv, part, seq, own != conv and new and not first, rows))
                    first, new, seq = first and own == conv, own != conv, seq + 1
                    rows, chars = [], 0
                conv = own
                rows.append(r)
                chars += len(r["text"])
            if out:
                yield _batch(out, schema)
                out = []
        if rows:
            yield _batch([leaf(conv, part, seq, False, rows)], schema)

    held = marked(rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long")))
    dealt = held.sort("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return cut_lineage(dealt.mapInArrow(run, f"conv_id long, part int, seq long, sole boolean, rows array<{_ROW_SQL}>, {_NODE}, {_FIGURES}"), "leaves")


def crossings(held: DataFrame) -> DataFrame:
    """conv_id, part, seq, before, after (states) and final of the leaves that
    are not surely their conversation's only one."""
    nodes = held.filter("NOT sole").select("conv_id", "part", "seq", "cost", "order")

    def ordered(table, *by):
        return sorted(table.to_pylist(), key=lambda r: tuple(r[c] for c in by))

    def part_sum(key, table):
        total = _total(ordered(table, "seq"))
        return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "cost": pa.array([total["cost"]], pa.list_(pa.int64())), "order": pa.array([total["order"]], pa.list_(pa.int32()))})

    def across(table):
        parts = ordered(table, "part")
        total = _total(parts)
        end = last_state(total["cost"][:4], total["order"][:4])
        states = chosen(parts, START, end)
        rows = [{"conv_id": r["conv_id"], "part": r["part"], "p0": a, "p1": b, "tail": r is parts[-1]} for r, (a, b) in zip(parts, states, strict=True)]
        return pa.Table.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("p0", pa.int32()), ("p1", pa.int32()), ("tail", pa.bool_())]))

    def within(table):
        rows = ordered(table, "seq")
        states = chosen(rows, rows[0]["p0"], rows[0]["p1"])
        out = [{"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "before": a, "after": b, "final": r["tail"] and r is rows[-1]} for r, (a, b) in zip(rows, states, strict=True)]
        return pa.Table.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("final", pa.bool_())]))

    parts = nodes.groupBy("conv_id", "part").applyInArrow(part_sum, f"conv_id long, part int, {_NODE}")
    ends = parts.groupBy("conv_id").applyInArrow(across, "conv_id long, part int, p0 int, p1 int, tail boolean")
    ends = ends.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), "p0", "p1", "tail")
    placed = nodes.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))).drop("of", "at")
    return cut_lineage(placed.groupBy("conv_id", "part").applyInArrow(within, "conv_id long, part int, seq long, before int, after int, final boolean"), "crossings")


def _solved(leaf: dict) -> tuple[list[tuple], int]:
    """The (edit, role, text) of a leaf in order, and their cost."""
    items = [_item(r) for r in leaf["rows"]]
    start, end, final = leaf["before"], leaf["after"], leaf["final"]
    if start is None:  # the conversation's only leaf
        start, final = START, True
        end = last_state(leaf["cost"][:4], leaf["order"][:4])
    out, state = [], start
    for r, letters in zip(leaf["rows"], repaired(items, 0, len(items), start, end), strict=True):
        for x in letters:
            if x == "D":
                out.append((x, r["role"], r["text"]))
                continue
            initial = r["role"][:1] if x == "K" else _OWN[state]
            out.append((x, r["role"] if x == "K" else ROLES[initial], "" if x == "I" else r["text"]))
            state = _NEXT[state, initial]
    cost = leaf["cost"][4 * start + end]
    for x in TAILS[end] if final else "":
        out.append((x, ROLES[_OWN[state]], ""))
        state, cost = _NEXT[state, _OWN[state]], cost + INSERT
    return out, cost


def _located(rows: DataFrame, size: int) -> DataFrame:
    """Leaves with the states between which they are repaired; null for a
    conversation's only leaf."""
    held = leaves(rows, size)
    at = crossings(held).select(F.col("conv_id").alias("of"), F.col("part").alias("p"), F.col("seq").alias("s"), "before", "after", "final")
    return held.join(at, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")), "left").drop("of", "p", "s")


def repair(rows: DataFrame, size: int = LEAF) -> DataFrame:
    """conv_id, part, seq, pos (their order), edit, role and text of every edit;
    the repaired conversation is what remains without the edit D."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("edits", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))])

    def run(batches):
        for batch in batches:
            out = [{k: leaf[k] for k in ("conv_id", "part", "seq")} | {"edits": [dict(zip(("edit", "role", "text"), e, strict=True)) for e in _solved(leaf)[0]]} for leaf in batch.to_pylist()]
            yield _batch(out, schema)

    solved = _located(rows, size).mapInArrow(run, "conv_id long, part int, seq long, edits array<struct<edit:string,role:string,text:string>>")
    return solved.select("conv_id", "part", "seq", F.posexplode("edits").alias("pos", "e")).select("conv_id", "part", "seq", "pos", "e.*")


def digest(rows: DataFrame, ids: DataFrame, size: int = LEAF) -> DataFrame:
    """One row for each conv_id of ``ids``: gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256 of its ``rows``."""
    piece = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("kept", pa.list_(pa.string())), *_FIGURES_PA])
    figures = [c for c, _ in _FIGURES_PA]

    def solve(batches):
        for batch in batches:
            out = []
            for leaf in batch.to_pylist():
                own, cost = _solved(leaf)
                out.append({k: leaf[k] for k in ("conv_id", "part", "seq", *figures)} | {"audit": "".join(e for e, _, _ in own), "cost": cost, "kept": [f"{r}:{t}" for e, r, t in own if e != "D"]})
            yield _batch(out, piece)

    result = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                        ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def finished(conv, total, audit, cost, sha):
        gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
        return {"conv_id": conv, "gaps": gaps, "audit": "".join(audit), "cost": cost, "repaired_sha256": sha.hexdigest()} | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}

    def stream(batches):
        now, out = None, []
        for batch in batches:
            for leaf in batch.to_pylist():
                if now and now[0] != leaf["conv_id"]:
                    out.append(finished(*now))
                    now = None
                if now is None:
                    now = [leaf["conv_id"], leaf, [], 0, hashlib.sha256()]
                    some = False
                else:
                    now[1] = _added(now[1], leaf)
                now[2].append(leaf["audit"])
                now[3] += leaf["cost"]
                for row in leaf["kept"]:
                    now[4].update(("\n" + row if some else row).encode())
                    some = True
            if out:
                yield _batch(out, result)
                out = []
        if now:
            yield _batch([finished(*now)], result)

    kind = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    pieces = _located(rows, size).mapInArrow(solve, f"conv_id long, part int, seq long, audit string, cost long, kept array<string>, {_FIGURES}")
    done = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(stream, kind)
    asked = ids.select(F.col("conv_id").cast("long").alias("of")).distinct()
    all_ = asked.join(done, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_.select(F.col("of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows damaged by crc32 of ``conv_id:turn`` modulo 20 (nulls are one
    space): 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3
    repeats it, 4 sets the role user."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
                      F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fault.alias("fault")).filter("fault != 0")
    return out.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
