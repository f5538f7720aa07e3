"""Repair of conversation structure by a backward cost-to-go programme.

The roles of a conversation should read ``(s?(ua)+)?``: nothing, or exchanges of
user and assistant after at most one system turn. Edits make it so: K keeps a
turn (free), R gives it the role user or assistant (3), D deletes it (4, and the
only choice for blank turns and for those that repeat an earlier one), I inserts
an empty turn (3); a truncated turn that stays costs 3 more.

The programme runs backward over (turn, grammar state) and holds the least cost
of what follows. A forward walk then takes, of the edits that are tight with
those costs, the one whose initial is least in ASCII. A state and an edit lead
to one state, so the walk finds the least string of initials.

Turns are sorted over all tasks and cut into blocks of at most ``2 ** BLOCK_BITS``.
A conversation within a block is done there. One that crosses blocks, however
long, has a piece in each: a piece is a 4 x 4 matrix of least costs between its
edges, the matrices are multiplied backward (minimum and sum) into the costs at
every edge, pieces tell for each state at their start the state at their end,
and these maps are followed forward. So a task holds a block of turns, or a
conversation's matrices, one to 4,096 turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common
from fieldloom.session import Workspace

BLOCK_BITS = 12
#: Characters of a text that order turns of one number and role; beyond them its SHA-256 does.
TIE_CHARS = 64
BLANKS = " \t\n\x0b\x0c\r"
RULED = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
# grammar states: nothing yet, after system, after user, after an exchange
START, SYSTEM, USER, WHOLE = range(4)
FAR = 1 << 40
#: Where a turn of this initial leads from a state, and where an inserted or reroled one does, with its role.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, WHOLE: USER}, "a": {USER: WHOLE}}
GIVEN = [(USER, "user"), (USER, "user"), (WHOLE, "assistant"), (USER, "user")]
#: Least cost of an ending, by state.
END_COST = [0, 6, 3, 0]
# a turn's kind in one byte: place of its initial here, plus its marks
INITIALS = ".sua"
DROP, CUT = 4, 8


def _row_costs(kind: int, after: np.ndarray) -> np.ndarray:
    """Least costs from each state before a turn, given those after it; after may have a column for each end."""
    delete = RULED["delete"] + after
    if kind & DROP:
        best = delete
    else:
        more = RULED["truncated"] if kind & CUT else 0
        best = np.minimum(delete, RULED["rerole"] + more + after[[s for s, _ in GIVEN]])
        for state, to in NEXT.get(INITIALS[kind & 3], {}).items():
            best[state] = np.minimum(best[state], more + after[to])
    return _with_inserts(best)


def _with_inserts(best: np.ndarray) -> np.ndarray:
    ins = RULED["insert"]
    best[USER], best[WHOLE] = np.minimum(best[USER], ins + best[WHOLE]), np.minimum(best[WHOLE], ins + best[USER])
    best[START], best[SYSTEM] = np.minimum(best[START], ins + best[USER]), np.minimum(best[SYSTEM], ins + best[USER])
    return best


def _costs(kinds: bytes, end: list[int]) -> list[list[int]]:
    """Cost-to-go by place and state; as _row_costs, in plain numbers, which are faster for one column."""
    d, r, ins, cut = RULED["delete"], RULED["rerole"], RULED["insert"], RULED["truncated"]
    v0, v1, v2, v3 = end
    out = [[v0, v1, v2, v3]]
    for kind in reversed(kinds):
        if kind & DROP:
            b0, b1, b2, b3 = d + v0, d + v1, d + v2, d + v3
        else:
            more = cut if kind & CUT else 0
            to_user, to_whole = r + more + v2, r + more + v3
            b0, b1, b2, b3 = min(d + v0, to_user), min(d + v1, to_user), min(d + v2, to_whole), min(d + v3, to_user)
            initial = kind & 3
            if initial == 1:
                b0 = min(b0, more + v1)
            elif initial == 2:
                b0, b1, b3 = min(b0, more + v2), min(b1, more + v2), min(b3, more + v2)
            elif initial == 3:
                b2 = min(b2, more + v3)
        v2, v3 = min(b2, ins + b3), min(b3, ins + b2)
        v0, v1 = min(b0, ins + v2), min(b1, ins + v2)
        out.append([v0, v1, v2, v3])
    return out[::-1]


def _walk(kinds: bytes, end: list[int], state: int, last: bool) -> tuple[list[tuple[str, int, str | None]], int, int]:
    """(initial, place of the turn or -1, role given), the state at the end, the cost."""
    costs = _costs(kinds, end)
    edits, at, first = [], 0, costs[0][state]
    while True:
        now = costs[at][state]
        to, role = GIVEN[state]
        if at == len(kinds):
            if not last or now == 0:
                return edits, state, first - now
            edits.append(("I", -1, role))
            state = to
            continue
        kind, after = kinds[at], costs[at + 1]
        more = RULED["truncated"] if kind & CUT else 0
        kept = NEXT.get(INITIALS[kind & 3], {}).get(state)
        if now == RULED["delete"] + after[state]:
            edits.append(("D", at, None))
        elif now == RULED["insert"] + costs[at][to]:
            edits.append(("I", -1, role))
            state = to
            continue
        elif kept is not None and not kind & DROP and now == more + after[kept]:
            edits.append(("K", at, None))
            state = kept
        else:
            edits.append(("R", at, role))
            state = to
        at += 1


def _matrix(kinds: bytes) -> np.ndarray:
    """Least costs from each state at the start to each at the end."""
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for kind in reversed(kinds):
        out = np.minimum(_row_costs(kind, out), FAR)
    return out


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text of damaged turns: a twentieth each dropped, emptied, without end marks, repeated, made user's.

    What happens is told by the CRC-32 of ``conv:turn`` modulo 20. A null role
    or text becomes one space, as a null conversation or turn does within the
    CRC alone. Other columns go.
    """
    named = common.named
    told = F.concat_ws(":", *(F.coalesce(named(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)))
    rows = turns.select(
        named(conv_col).alias("conv"), named(turn_col).alias("turn"), F.coalesce(named(role_col), F.lit(" ")).alias("role"), F.coalesce(named(text_col), F.lit(" ")).alias("text"),
        (F.crc32(told.cast("binary")) % 20).alias("fate"),
    ).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@dataclass
class Repaired:
    """report: conv, gaps, blank, duplicate, truncated, illegal, cost, audit; turns: conv, seq, turn, role, text, edit."""

    report: DataFrame
    turns: DataFrame


def _conv_field(df: DataFrame) -> str:
    return f"conv {df.schema['conv'].dataType.simpleString()}"


def repair_conversations(turns: DataFrame, block_bits: int = BLOCK_BITS) -> Repaired:
    """Faults, cheapest edits and rebuilt turns of every conversation of turns (conv, turn, role, text).

    A turn's first fault counts: blank (no character but ASCII blanks),
    duplicate (role and text seen earlier in the conversation), truncated (its
    last such character is none of ``.!?``). illegal counts neighbours whose role
    initials are not su, ua or au; gaps the turn numbers missing between the
    least and the largest, nulls aside (0 if all are null).

    Turns go by number, null first, then by role, then by the first 64
    characters of the text, then by its SHA-256; equal turns are alike. A null
    conversation is one of its own. Null roles and texts count as one space. A
    conversation may have any number of turns, numbers may repeat, other columns
    go. An empty table gives empty results.
    """
    spark = turns.sparkSession
    work = Workspace(spark, "repair")
    rows = turns.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("head", F.left("text", F.lit(TIE_CHARS)))
    order = ["conv", "turn", "role", "head", "sha", "tie"]
    # equal turns too are parted by tie, so that no conversation, number or text is one task's
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "head")
    rows = work.save(rows.withColumn("ord", F.monotonically_increasing_id()), "rows")

    light = work.save(_light(rows), "light")
    segments = work.save(_segments(light, block_bits), "segments")
    known = work.save(_entered(segments, work), "known")
    edits = work.save(_edits(known), "edits")

    counts = light.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.sum((F.col("fault") == i).cast("long")).alias(name) for i, name in enumerate(("blank", "duplicate", "truncated"), 1)),
    )
    by_piece = edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("pieces"))
    by_piece = by_piece.withColumn("audit", F.array_join(F.col("pieces.audit"), "")).drop("pieces")
    other = by_piece.withColumnRenamed("conv", "other")
    report = counts.join(other, F.col("conv").eqNullSafe(F.col("other"))).drop("other")

    steps = edits.select("conv", F.explode("steps").alias("step")).select("conv", "step.*")
    kept = steps.where("ord IS NOT NULL").join(rows.select("ord", "turn", F.col("role").alias("own"), "text"), "ord")
    kept = kept.select("conv", "seq", "turn", F.coalesce("role", "own").alias("role"), "text", "edit")
    put_in = steps.where("ord IS NULL").select("conv", "seq", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"), "edit")
    return Repaired(report, kept.unionByName(put_in))


def _light(rows: DataFrame) -> DataFrame:
    """ord, conv, turn, fault (0 none, 1 blank, 2 duplicate, 3 truncated), kind: what the programme needs of a turn."""
    firsts = rows.groupBy("conv", "role", "sha").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("is_first"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.right(bare, F.lit(1)).isin(".", "!", "?")
    told = rows.select("ord", "conv", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("is_blank"), (~ends).alias("is_cut"))
    told = told.join(firsts, "ord", "left")
    fault = F.when(F.col("is_blank"), 1).when(F.col("is_first").isNull(), 2).when(F.col("is_cut"), 3).otherwise(0)
    initial = F.when(F.col("initial") == "s", 1).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 3).otherwise(0)
    mark = F.when(fault.isin(1, 2), DROP).when(fault == 3, CUT).otherwise(0)
    return told.select("ord", "conv", "turn", fault.alias("fault"), (initial + mark).cast("int").alias("kind"))


def _segments(light: DataFrame, block_bits: int) -> DataFrame:
    """A row for each piece of a conversation within a block: its turns, whether it may go on, and then its matrix."""

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        convs, ords, kinds = (table.column(c).to_pylist() for c in ("conv", "ord", "kind"))
        starts = [i for i in range(len(convs)) if i == 0 or convs[i] != convs[i - 1]]
        out = []
        for a, b in zip(starts, [*starts[1:], len(convs)], strict=True):
            own = bytes(kinds[a:b])
            initials = [INITIALS[k & 3] for k in own]
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
            edge = a == 0 or b == len(convs)
            out.append((ords[a], convs[a], not edge, own, ords[a:b], illegal, _matrix(own).ravel().tolist() if edge else None))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = ["seg", "conv", "closed", "kinds", "ords", "illegal", "matrix"]
    types = [pa.int64(), _arrow_type(light, "conv"), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
    schema = f"seg long, {_conv_field(light)}, closed boolean, kinds binary, ords array<long>, illegal long, matrix array<long>"
    return light.select("ord", "conv", "kind").groupBy(F.shiftright("ord", block_bits).alias("block")).applyInArrow(cut, schema)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _entered(segments: DataFrame, work: Workspace) -> DataFrame:
    """segments with the state they are entered in, the costs at their end, and whether they are the conversation's last."""
    ended = ["seg", "conv", "kinds", "ords", "illegal"]
    whole = segments.where("closed").select(*ended, F.lit(START).alias("entry"), F.array(*map(F.lit, END_COST)).cast("array<long>").alias("ends"), F.lit(True).alias("last"))
    open_ones = segments.where("NOT closed")

    def backward(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        segs, matrices, kinds = (table.column(c).to_pylist() for c in ("seg", "matrix", "edges"))
        ends, now = [], np.array(END_COST, np.int64)
        for matrix in reversed(matrices):
            ends.append(now.tolist())
            now = np.minimum((np.array(matrix, np.int64).reshape(4, 4) + now).min(axis=1), FAR)
        pairs = [INITIALS[x[1] & 3] + INITIALS[y[0] & 3] for x, y in zip(kinds, kinds[1:], strict=False)]
        between = [0, *(int(p not in ("su", "ua", "au")) for p in pairs)]
        last = [False] * (len(segs) - 1) + [True]
        return pa.table({"seg": pa.array(segs, pa.int64()), "ends": pa.array(ends[::-1], pa.list_(pa.int64())), "last": pa.array(last), "between": pa.array(between, pa.int64())})

    edges = F.concat(F.substring("kinds", 1, 1), F.substring("kinds", -1, 1)).alias("edges")
    ends = open_ones.select("conv", "seg", "matrix", edges).groupBy("conv").applyInArrow(backward, "seg long, ends array<long>, last boolean, between long")
    told = work.save(open_ones.select(*ended).join(ends, "seg"), "open")

    def across(batches):
        for batch in batches:
            found = [[_walk(kinds, ends, state, last)[1] for state in range(4)] for kinds, ends, last in zip(*(common.column(batch, c) for c in ("kinds", "ends", "last")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("seg"), batch.column("conv"), pa.array(found, pa.list_(pa.int32()))], names=["seg", "conv", "exits"])

    def forward(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        entries, state = [], START
        for exits in table.column("exits").to_pylist():
            entries.append(state)
            state = exits[state]
        return pa.table({"seg": table.column("seg"), "entry": pa.array(entries, pa.int32())})

    exits = told.mapInArrow(across, f"seg long, {_conv_field(told)}, exits array<int>")
    entries = exits.groupBy("conv").applyInArrow(forward, "seg long, entry int")
    joined = told.join(entries, "seg").select(*ended[:-1], (F.col("illegal") + F.col("between")).alias("illegal"), "entry", "ends", "last")
    return whole.unionByName(joined)


def _edits(known: DataFrame) -> DataFrame:
    """conv, seg, illegal, cost, audit, steps: the walk through each piece."""
    step = pa.struct([("ord", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string())])

    def run(batches):
        for batch in batches:
            costs, audits, steps = [], [], []
            for seg, kinds, ords, entry, ends, last in zip(*(common.column(batch, c) for c in ("seg", "kinds", "ords", "entry", "ends", "last")), strict=True):
                edits, _, cost = _walk(kinds, ends, entry, last)
                costs.append(cost)
                audits.append("".join(e for e, _, _ in edits))
                # a piece has at most three edits a turn and two more, and begins that far from the next
                steps.append([{"ord": ords[at] if at >= 0 else None, "seq": 4 * seg + i, "edit": e, "role": role} for i, (e, at, role) in enumerate(edits) if e != "D"])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), batch.column("illegal"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(steps, pa.list_(step))], names=["conv", "seg", "illegal", "cost", "audit", "steps"])

    return known.mapInArrow(common.tidy(run), f"{_conv_field(known)}, seg long, illegal long, cost long, audit string, steps array<struct<ord:long,seq:long,edit:string,role:string>>")


def turns_digest(turns: DataFrame) -> DataFrame:
    """conv, sha256 of a conversation's ``role:text`` lines in the order of seq, joined by newlines.

    Lines stream through the digest, so a task holds none of them; a digest is
    one sequence by nature, and so one conversation is one task's.
    """
    lines = turns.select("conv", "seq", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    lines = lines.withColumn("none", F.col("conv").isNull()).repartition("conv").sortWithinPartitions("none", "conv", "seq")
    conv = _arrow_type(lines, "conv")

    def run(batches):
        state, held = None, []
        for batch in batches:
            for own, line in zip(common.column(batch, "conv"), common.column(batch, "line"), strict=True):
                if state is None or own != held[-1]:
                    if state is not None:
                        held[-1] = (held[-1], state.hexdigest())
                    held.append(own)
                    state = hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            done, held = held[:-1], held[-1:]
            yield emit(done)
        if state is not None:
            yield emit([(held[0], state.hexdigest())])

    def emit(done):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv), pa.array([h for _, h in done], pa.string())], names=["conv", "sha256"])

    return lines.select("conv", "line").mapInArrow(common.tidy(run), f"{_conv_field(lines)}, sha256 string")


def audit_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = BLOCK_BITS) -> DataFrame:
    """Per conversation of turns, damaged first: its faults, the cheapest edits and the digest of what they make of it.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. A conversation that damage leaves without a turn has zeros,
    an empty audit and the digest of an empty text.
    """
    found = repair_conversations(damaged(turns, conv_col, turn_col, role_col, text_col), block_bits)
    ids = turns.select(common.named(conv_col).alias("conv_id")).distinct()
    digests = turns_digest(found.turns).withColumnRenamed("conv", "conv_d")
    out = ids.join(found.report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("conv_d")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
