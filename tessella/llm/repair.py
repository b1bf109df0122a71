"""Repair of damaged conversations by a Viterbi search whose chunks run side by side, after the rank-convergence method.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
Each row is kept (free), gets the role of user or assistant (2) or is deleted
(3; the only way for blank rows and repetitions); empty rows of user or
assistant may be put in anywhere (2); a row that ends in mid-sentence costs 1
more unless it is deleted.  Of the cheapest lists of edits the one whose
initials (D, I, K, R) come first in ASCII is taken.

Four states say what was last put out (nothing, s, u, a), and a vector of four
costs what remains to be paid from each.  Rows are dealt to chunks in order, so
that a long conversation has many.  All chunks run backwards at once, each from
a speculative vector behind its last row.  Then fix-up passes hand every chunk
the vector that its successor now has, and run it again beside its old run until
both vectors differ by a constant only: from there on nothing changes.  Where no
chunk changes any more, the vectors are those of one long run, up to constants,
which the edits' own costs make good.  After ROUNDS passes (only long stretches
that don't converge need more, such as thousands of rows of unknown roles) one
pass in order settles the rest.  With these backward costs every chunk traces
its edits from each of the four states, and a fold in order picks the real one.

No task holds more than a chunk of rows or, in the folds in order, one row of a
chunk.  What the result itself asks for stays sequential: the text digest of
one conversation is one stream of bytes (each chunk's repaired text goes by in
order, held by nobody as a whole), and its audit one string.

Rows are taken by turn, null turns first, then by role and a hash of the text;
repeated rows are alike and so need no order.  A null role or text counts as a
single space; a null conversation id is a conversation of its own.  Very long
texts are chunks of their own.  An empty table gives no rows.  Columns besides
those named aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column, kept, written

#: Rows and characters of a chunk at most; a conversation's end closes one that is half full.
ROWS, CHARS = 1024, 4_000_000
#: Fix-up passes in which all chunks run side by side.
ROUNDS = 8

_SPACE = " \t\n\x0b\x0c\r"
#: A row's code: the role's class, and bits.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FORCED, TRUNCATED, BLANK, ABSENT = 4, 8, 16, 32
_CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

#: States: nothing, s, u or a put out last.  The state that a user or assistant row leads to, and that which a kept row does.
NEXT = (2, 2, 3, 2)
KEPT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (3, USER): 2, (2, ASSISTANT): 3}
DELETE, RENAME, INSERT = 3, 2, 2
#: What remains to be paid behind the last row; also what every chunk but the last speculates on.
END = (0, 4, 2, 0)


def row_code(role: str, text: str) -> int:
    """The class of a role, and whether the text is blank or truncated."""
    kept_text = text.strip(_SPACE)
    code = _CLASS.get(role[:1], OTHER)
    if not kept_text:
        return code | BLANK | FORCED
    return code | (TRUNCATED if kept_text[-1] not in ".!?" else 0)


def _closed(v: list[int]) -> tuple[int, int, int, int]:
    """With empty rows put in where that is cheaper."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + u), min(v[1], INSERT + u), u, a


def step(code: int, behind: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Costs before a row, from those behind it."""
    v = [DELETE + x for x in behind]
    if not code & FORCED:
        more = 1 if code & TRUNCATED else 0
        for q in range(4):
            v[q] = min(v[q], RENAME + more + behind[NEXT[q]])
            if (to := KEPT.get((q, code & 3))) is not None:
                v[q] = min(v[q], more + behind[to])
    return _closed(v)


def level(v: tuple[int, ...]) -> tuple[int, ...]:
    """The vector less its least cost, so that vectors which differ by a constant are equal."""
    least = min(v)
    return tuple(x - least for x in v)


def backward(codes: bytes, right: tuple[int, ...]) -> tuple[int, ...]:
    for code in reversed(codes):
        right = step(code, right)
    return level(right)


def fixed(codes: bytes, used: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...] | None:
    """Run again from ``right`` beside the run from ``used``: the new costs on the left, or None where both runs meet."""
    for code in reversed(codes):
        if (used := level(used)) == (right := level(right)):
            return None
        used, right = step(code, used), step(code, right)
    return None if level(used) == level(right) else level(right)


def trace(codes: bytes, right: tuple[int, ...], states: list[int]) -> list[tuple[str, int, int]]:
    """Of each entering state: the least cheapest edits' initials, the leaving state and the cost.  ``right`` of END ends the conversation."""
    costs = [tuple(right)]
    for code in reversed(codes):
        costs.append(step(code, costs[-1]))
    costs.reverse()
    return [_traced(codes, costs, q) for q in states]


def _traced(codes: bytes, costs: list[tuple[int, ...]], q: int) -> tuple[str, int, int]:
    edits, paid = [], 0
    for i, code in enumerate(codes):
        behind, more = costs[i + 1], 1 if code & TRUNCATED else 0
        while True:
            left = costs[i][q]
            if DELETE + behind[q] == left:
                edits.append("D")
                paid += DELETE
                break
            if INSERT + costs[i][NEXT[q]] == left:
                edits.append("I")
                paid += INSERT
                q = NEXT[q]
                continue
            to = KEPT.get((q, code & 3))
            if to is not None and more + behind[to] == left:
                edits.append("K")
                paid += more
            else:
                to = NEXT[q]
                edits.append("R")
                paid += RENAME + more
            q = to
            break
    return "".join(edits), q, paid


def ending(q: int) -> str:
    """Edits behind the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[q]


def applied(rows, edits: str, q: int):
    """The repaired rows ``role:text`` from rows (role, text) and edits that begin in a state."""
    rows = iter(rows)
    for edit in edits:
        if edit == "I":
            role, text = "user" if NEXT[q] == 2 else "assistant", ""
            q = NEXT[q]
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "K":
                q = KEPT[q, _CLASS[role[:1]]]
            else:
                q = NEXT[q]
                role = "user" if q == 2 else "assistant"
        yield f"{role}:{text}"


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, by a hash of conversation and turn; dropped rows stay with ``present`` false."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20).alias("d"))
    rows = rows.withColumn("again", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") != 0).alias("present"))


def _numbered(names: list[str], schema: pa.Schema):
    """Rows in order get a chunk and a place in it, their code and a digest of role and text."""

    def run(batches):
        kept("repair")
        chunk, at, chars, last = TaskContext.get().partitionId() << 33, 0, 0, object()
        for batch in batches:
            convs, roles, texts, present = (column(batch, c).to_pylist() for c in ("conv", "role", "text", "present"))
            chunks, places, codes, digests = [], [], [], []
            for conv, role, text, here in zip(convs, roles, texts, present):
                if at and (at >= ROWS or chars > CHARS or conv != last and 2 * at >= ROWS):
                    chunk, at, chars = chunk + 1, 0, 0
                chunks.append(chunk)
                places.append(at)
                codes.append(row_code(role, text) if here else ABSENT)
                raw = role.encode()
                digests.append(hashlib.blake2b(len(raw).to_bytes(8, "little") + raw + text.encode(), digest_size=16).digest())
                at, chars, last = at + 1, chars + len(text), conv
            more = [pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), pa.array(codes, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, c).cast(schema.field(c).type) for c in names] + more, schema=schema)

    return run


#: Of a conversation's rows in one chunk.
SEGMENT = "conv {conv}, chunk long, n long, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first int, last int, codes binary, at_left array<int>"


def _segments(schema: pa.Schema):
    def run(key, rows: pa.Table, firsts: pa.Table) -> pa.Table:
        kept("repair")
        rows = rows.sort_by("at")
        first = set(firsts["at"].to_pylist())
        out: list[list] = []
        convs, turns, codes, places = (rows[c].to_pylist() for c in ("conv", "turn", "code", "at"))
        k = 0
        while k < len(convs):
            z = k
            while z < len(convs) and convs[z] == convs[k]:
                z += 1
            own = bytearray()
            n_turns, turn, least, blank, duplicate, truncated, illegal, before = 0, None, None, 0, 0, 0, 0, None
            for i in range(k, z):
                code = codes[i]
                if code & ABSENT:
                    continue
                if not code & BLANK and places[i] not in first:
                    code = code & ~TRUNCATED | FORCED
                    duplicate += 1
                blank += bool(code & BLANK)
                truncated += bool(code & TRUNCATED)
                illegal += before is not None and (before, code & 3) not in _LEGAL
                before = code & 3
                if turns[i] is not None and turns[i] != turn:
                    n_turns, turn, least = n_turns + 1, turns[i], turns[i] if least is None else least
                own.append(code)
            own = bytes(own)
            out.append([convs[k], key[0].as_py(), len(own), n_turns, least, turn, blank, duplicate, truncated, illegal, own[0] & 3 if own else None, own[-1] & 3 if own else None, own, list(backward(own, END))])
            k = z
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def _fixed_up(schema: pa.Schema):
    """One fix-up pass over chained segments: their new costs, and whether anything changed."""

    def run(batches):
        for batch in batches:
            cols = {c: column(batch, c).to_pylist() for c in batch.schema.names}
            lefts, changed = [], []
            for codes, used, right, left in zip(cols["codes"], cols["used"], cols["right"], cols["at_left"]):
                new = fixed(codes, tuple(used), tuple(right))
                lefts.append(left if new is None else list(new))
                changed.append(new is not None)
            arrays = [column(batch, "conv"), column(batch, "chunk"), column(batch, "next"), column(batch, "codes"), column(batch, "right"), pa.array(lefts, pa.list_(pa.int32())), pa.array(changed)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run


def _in_order(schema: pa.Schema):
    """Segments of a conversation from its end: each one's exact costs on the right."""

    def run(batches):
        conv, right = object(), END
        for batch in batches:
            rights = []
            for c, codes in zip(column(batch, "conv").to_pylist(), column(batch, "codes").to_pylist()):
                if c != conv:
                    conv, right = c, END
                rights.append(list(right))
                right = backward(codes, right)
            yield pa.RecordBatch.from_arrays([column(batch, "conv").cast(schema.field("conv").type), column(batch, "chunk"), pa.array(rights, pa.list_(pa.int32()))], schema=schema)

    return run


def _chained(segments: DataFrame, conv: str) -> DataFrame | None:
    """Exact costs on the right of the segments of conversations that have several."""
    from pyspark.sql.pandas.types import to_arrow_schema

    of = Window.partitionBy("conv").orderBy("chunk")
    places = segments.select("conv", "chunk").withColumns({"next": F.lead("chunk").over(of), "before": F.lag("chunk").over(of)})
    places = places.filter("next IS NOT NULL OR before IS NOT NULL")
    if not places.head(1):
        return None
    # a chunk has each conversation once
    both = places.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), "next")
    end = F.array(*map(F.lit, END))
    state = segments.join(both, (F.col("chunk") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c"))).select("conv", "chunk", "next", "codes", end.alias("right"), "at_left", F.lit(True).alias("changed"))
    state = written(state, "chain")
    names = state.schema
    for _ in range(ROUNDS):
        successor = state.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.col("at_left").alias("new_right"))
        found = state.join(successor, (F.col("next") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c")), "left")
        found = found.select("conv", "chunk", "next", "codes", F.col("right").alias("used"), F.coalesce("new_right", end).alias("right"), "at_left")
        state = written(found.mapInArrow(_fixed_up(to_arrow_schema(names)), names), "chain")
        if not state.filter("changed").head(1):
            return state.select("conv", "chunk", "right")
    kind = T.StructType([names["conv"], names["chunk"], names["right"]])
    ordered = state.select("conv", "chunk", "codes").repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    return ordered.mapInArrow(_in_order(to_arrow_schema(kind)), kind)


def _traces(schema: pa.Schema, names: list[str]):
    def run(batches):
        kept("repair")
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("codes", "right", "begins")]
            found = [trace(codes, tuple(right), [0] if begins else [0, 1, 2, 3]) for codes, right, begins in zip(*cols)]
            more = [pa.array([[x[k] for x in f] for f in found], t) for k, t in enumerate((pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([column(batch, c).cast(schema.field(c).type) for c in names] + more, schema=schema)

    return run


def _stitched(schema: pa.Schema):
    """Segments in order: which of the traces is the real one, and on a conversation's last segment its sums."""

    def run(batches):
        kept("repair")
        conv, q, audit, cost, sums, edge = object(), 0, [], 0, [0] * 4, [None, None, None, 0]
        for batch in batches:
            cols = {c: column(batch, c).to_pylist() for c in batch.schema.names}
            out: list[list] = []
            for i, c in enumerate(cols["conv"]):
                if c != conv:
                    conv, q, audit, cost, sums, edge = c, 0, [], 0, [0] * 4, [None, None, None, 0]
                entered, edits = q, cols["edits"][i][q]
                cost += cols["costs"][i][q]
                q = cols["leaves"][i][q]
                sums = [s + cols[k][i] for s, k in zip(sums, ("blank", "duplicate", "truncated", "illegal"))]
                least, latest, role, n_turns = edge
                if cols["n"][i]:
                    sums[3] += role is not None and (role, cols["first"][i]) not in _LEGAL
                    role = cols["last"][i]
                    if cols["turns"][i]:
                        n_turns += cols["turns"][i] - (latest is not None and latest == cols["first_turn"][i])
                        least, latest = cols["first_turn"][i] if least is None else least, cols["last_turn"][i]
                edge = [least, latest, role, n_turns]
                last = cols["is_last"][i]
                if last:
                    edits += (rest := ending(q))
                    cost += INSERT * len(rest)
                audit.append(edits)
                gaps = latest - least + 1 - n_turns if n_turns else 0
                out.append([c, cols["chunk"][i], entered, edits, cols["begins"][i] and last, last, *((gaps, *sums, cost, "".join(audit)) if last else [None] * 7)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _texts(schema: pa.Schema):
    """A chunk's repaired texts: the digest of a whole conversation, or the bytes of a part."""

    def run(key, rows: pa.Table, edits: pa.Table) -> pa.Table:
        kept("repair")
        rows = rows.sort_by("at")
        convs, roles, texts = (rows[c].to_pylist() for c in ("conv", "role", "text"))
        of: dict = {}
        for k, c in enumerate(convs):
            of.setdefault(c, []).append((roles[k], texts[k]))
        out = []
        for c, q, initials, whole in zip(*(edits[x].to_pylist() for x in ("conv", "entered", "edits", "whole"))):
            lines = list(applied(of.get(c, []), initials, q))
            raw = "\n".join(lines).encode()
            out.append([c, key[0].as_py(), hashlib.sha256(raw).hexdigest() if whole else None, None if whole or not lines else raw])
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def _streamed(schema: pa.Schema):
    """Parts of a conversation in order, through one digest."""

    def run(batches):
        conv, now, some = object(), None, False
        for batch in batches:
            out = []
            for c, raw in zip(column(batch, "conv").to_pylist(), column(batch, "part").to_pylist()):
                if now is None or c != conv:
                    if now is not None:
                        out.append([conv, now.hexdigest()])
                    conv, now, some = c, hashlib.sha256(), False
                if raw is not None:
                    now.update(b"\n" + raw if some else raw)
                    some = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, now.hexdigest()), schema)], schema=schema)

    return run


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: repaired rows' edits by chunk, the numbered rows that they belong to, and a report for each conversation.

    Rows whose ``present_col`` isn't true only name their conversation.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), present.alias("present"))
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "__tie").sortWithinPartitions(*order).drop("__tie")
    conv = rows.schema["conv"].dataType
    numbered = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("chunk long, at int, code int, digest binary").fields])
    rows = written(rows.mapInArrow(_numbered(rows.columns, to_arrow_schema(numbered)), numbered), "rows")
    known = rows.filter(f"code & {BLANK | ABSENT} = 0").groupBy("conv", "digest").agg(F.min(F.struct("chunk", "at")).alias("first")).select("first.*")
    segment = T.StructType.fromDDL(SEGMENT.format(conv=conv.simpleString()))
    segments = rows.select("conv", "turn", "chunk", "at", "code").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_segments(to_arrow_schema(segment)), segment)
    segments = written(segments, "segments")
    chain = _chained(segments, conv.simpleString())
    of = Window.partitionBy("conv").orderBy("chunk")
    placed = segments.withColumns({"begins": F.lag("chunk").over(of).isNull(), "is_last": F.lead("chunk").over(of).isNull()})
    end = F.array(*map(F.lit, END))
    if chain is None:
        placed = placed.withColumn("right", end)
    else:
        exact = chain.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), "right")
        placed = placed.join(exact, (F.col("chunk") == F.col("k")) & F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("right", F.coalesce("right", end)).drop("c", "k")
    names = [f.name for f in segment if f.name not in ("codes", "at_left")] + ["begins", "is_last"]
    traced = T.StructType([placed.schema[c] for c in names] + T.StructType.fromDDL("edits array<string>, leaves array<int>, costs array<long>").fields)
    traces = placed.mapInArrow(_traces(to_arrow_schema(traced), names), traced)
    stitched = T.StructType.fromDDL(f"conv {conv.simpleString()}, chunk long, entered int, edits string, whole boolean, is_last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    edits = traces.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_stitched(to_arrow_schema(stitched)), stitched)
    edits = written(edits, "edits")
    report = edits.filter("is_last").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return edits, rows.filter("present"), report


def repair_report(rows: DataFrame, **names: str) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema

    edits, rows, report = repair(rows, **names)
    kind = f"conv {rows.schema['conv'].dataType.simpleString()}"
    texts = T.StructType.fromDDL(f"{kind}, chunk long, whole string, part binary")
    hashed = T.StructType.fromDDL(f"{kind}, sha string")
    mine = edits.select("conv", "chunk", "entered", "edits", "whole").groupBy("chunk")
    found = rows.select("conv", "chunk", "at", "role", "text").groupBy("chunk").cogroup(mine).applyInArrow(_texts(to_arrow_schema(texts)), texts)
    found = written(found, "texts")
    parts = found.filter("whole IS NULL").repartition("conv").sortWithinPartitions("conv", "chunk").select("conv", "part")
    digests = found.filter("whole IS NOT NULL").select("conv", F.col("whole").alias("sha")).unionAll(parts.mapInArrow(_streamed(to_arrow_schema(hashed)), hashed))
    digests = digests.select(F.col("conv").alias("c"), F.col("sha").alias("repaired_sha256"))
    return report.join(digests, F.col("conv").eqNullSafe(F.col("c"))).drop("c").withColumnRenamed("conv", "conv_id")
