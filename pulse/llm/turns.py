"""Repair of conversations by their cheapest edits.

The roles of a repaired conversation read: perhaps a system turn, then user and assistant in
turn (or nothing at all). Edits are ``K``eep (0), ``R``erole to user or assistant (3), ``D``elete
(4, a must for blank and duplicate turns) and ``I``nsert an empty user or assistant turn (3); a
truncated turn that stays costs 3 more. Of the cheapest edits those whose initials, the audit,
are least in ASCII are taken. It is a Viterbi search over four states: nothing yet, after
system, after user, after assistant.

All turns are sorted by ranges and cut into blocks of bounded size; a conversation inside one
block is settled there. One that reaches over several is searched in parallel: every block
starts from the costs at the end of a conversation, a guess, and works backwards. Fix-up passes
rerun blocks from the cost vectors that other blocks ended with. A rerun stops where its
vector differs from the first run's by a constant only: from there on, all decisions are the
same. Costs of the states differ by a few units at most, so there are few distinct vectors up to
a constant, and passes end once no new one turns up. The blocks' maps (vector in, vector out) are
composed by doubling, which stitches the true costs at every border; from them each block traces
its edits, and the maps of states (in, out) are composed the same way.

Equal turns (same conversation, turn, role and text) are one row with a count, and turns equal
in role and text to an earlier one are found by the least place of each group, so neither a hot
conversation nor a hot turn is gathered. Only the digest of a whole conversation, one hash
over its text, is read in order by one task, as a stream.

Defined cases: a null role or text is one space; a null turn comes first; rows with a null
conversation are one conversation. Turns that tie are ordered by role and text. A role other
than user, assistant or system (by its first letter) cannot be kept. Extra columns are ignored.
A conversation without rows has no edits; an empty table has no conversations.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import stored

#: Turns of a block are 2 ** BLOCK_BITS at most.
BLOCK_BITS = 12
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the states where a conversation ends: user still needs an answer.
FINAL = (0, 2 * INSERT, INSERT, 0)
_TURN = {"u": USER, "a": ASSISTANT}


# --- the search inside one stretch of turns -----------------------------------------
def step(row: tuple[str, int], after: tuple) -> tuple:
    """Costs before a turn (initial of its role, fault) from the costs after it."""
    initial, fault = row
    if fault in (BLANK, DUPLICATE):
        return tuple(DELETE + x for x in after)
    more = TRUNCATED if fault == CUT else 0
    costs = [DELETE + x for x in after]
    for state in range(4):
        wanted = ASSISTANT if state == USER else USER
        stay = KEEP if _TURN.get(initial) == wanted else REROLE
        costs[state] = min(costs[state], stay + more + after[wanted])
    if initial == "s":
        costs[START] = min(costs[START], KEEP + more + after[SYSTEM])
    costs[USER] = min(costs[USER], INSERT + costs[ASSISTANT])
    costs[ASSISTANT] = min(costs[ASSISTANT], INSERT + costs[USER])
    costs[START] = min(costs[START], INSERT + costs[USER])
    costs[SYSTEM] = min(costs[SYSTEM], INSERT + costs[USER])
    return tuple(costs)


def backward(rows: list, after: tuple) -> list[tuple]:
    """Costs before every turn, and after the last."""
    out = [after]
    for row in reversed(rows):
        out.append(step(row, out[-1]))
    return out[::-1]


def level(costs: tuple) -> tuple:
    """The vector without its constant."""
    least = min(costs)
    return tuple(c - least for c in costs)


def rerun(rows: list, after: tuple, first: list[tuple]) -> tuple:
    """The vector before the first turn, from ``after``; ``first`` has an earlier run's vectors."""
    costs = after
    for k in range(len(rows) - 1, -1, -1):
        if level(costs) == level(first[k + 1]):
            return level(first[0])
        costs = step(rows[k], costs)
    return level(costs)


def trace(rows: list, costs: list[tuple], state: int) -> tuple[list[str], list[str], int]:
    """Edits of every turn with inserts before it, the roles made (k: as it is), and the last state."""
    edits, made = [], []
    for k, (initial, fault) in enumerate(rows):
        here, after = costs[k], costs[k + 1]
        letters, roles = "", ""
        more = TRUNCATED if fault == CUT else 0
        while True:
            wanted = ASSISTANT if state == USER else USER
            if DELETE + after[state] == here[state]:
                letters, roles = letters + "D", roles + "-"
            elif INSERT + here[wanted] == here[state]:
                letters, roles, state = letters + "I", roles + "ua"[wanted - USER], wanted
                continue
            elif _TURN.get(initial) == wanted and KEEP + more + after[wanted] == here[state]:
                letters, roles, state = letters + "K", roles + "k", wanted
            elif initial == "s" and state == START and KEEP + more + after[SYSTEM] == here[state]:
                letters, roles, state = letters + "K", roles + "k", SYSTEM
            else:
                letters, roles, state = letters + "R", roles + "ua"[wanted - USER], wanted
            break
        edits.append(letters)
        made.append(roles)
    return edits, made, state


def closing(state: int) -> tuple[str, str]:
    """Inserts after the last turn."""
    roles = {SYSTEM: "ua", USER: "a"}.get(state, "")
    return "I" * len(roles), roles


# --- turns in order ----------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of the rows, by a checksum of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Distinct turns with their number ``n``, the place ``seq`` and the fault of the first of them.

    Turns are sorted by ranges, so a long conversation lies in several partitions, and stored:
    places do not change afterwards.
    """
    space = F.lit(" ")
    given = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    by = ["conv_id", "turn", "role", "text"]
    one = given.groupBy(*by).agg(F.count("*").alias("n"))
    placed = one.repartitionByRange(*by).sortWithinPartitions(*by)
    bare = F.rtrim("text", F.lit(BLANKS))
    end = F.substring(bare, -1, 1)
    fault = F.when(bare == "", BLANK).when(end.isin(*".!?"), NONE).otherwise(CUT)
    placed = placed.select(F.monotonically_increasing_id().alias("seq"), *by, "n", fault.alias("fault"), F.sha2("text", 256).alias("key"))
    placed = stored(placed, "turns")
    same = ["conv_id", "role", "key"]
    groups = placed.filter(F.col("fault") != BLANK).groupBy(*same).agg(F.min("seq").alias("least"), F.count("*").alias("m"))
    groups = groups.filter("m > 1").select(*(F.col(c).alias(f"g_{c}") for c in same), "least")
    match = (F.col("conv_id").eqNullSafe(F.col("g_conv_id"))) & (F.col("role") == F.col("g_role")) & (F.col("key") == F.col("g_key"))
    narrow = placed.select("seq", "conv_id", "role", "key", "n", "fault").join(groups, match, "left")
    again = (F.col("fault") != BLANK) & (F.col("seq") > F.col("least"))
    faults = narrow.select(
        "seq", "conv_id", F.substring("role", 1, 1).alias("initial"), "n", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault")
    )
    return placed.select("seq", *by), stored(faults, "faults")


# --- conversations over several blocks -------------------------------------------------
def _block():
    return F.shiftright("seq", BLOCK_BITS).alias("block")


def long_segments(faults: DataFrame) -> DataFrame:
    """``conv_id, block, k, m``: the parts of the conversations that reach over several blocks, in order."""
    edge = faults.groupBy(_block()).agg(F.min_by(F.struct("conv_id"), "seq").alias("a"), F.max_by(F.struct("conv_id"), "seq").alias("b"))
    edge = edge.select("block", F.explode(F.array("a", "b")).alias("c")).select("block", "c.conv_id").distinct()
    within = Window.partitionBy("conv_id")
    numbered = edge.select(
        "conv_id", "block", F.row_number().over(within.orderBy("block")).alias("k"), F.count("*").over(within).alias("m")
    )
    return stored(numbered.filter("m > 1"), "segments")


def composed(maps: DataFrame, start) -> DataFrame:
    """``conv_id, k, value``: the value that reaches every step of a chain of maps.

    ``maps`` has ``conv_id, k, map``: the map of step k as an array (value in, value out),
    values counted from 0. Step 1 gets ``start``, the next one what the map makes of it.
    By doubling: after r rounds a step's map covers the 2**r steps up to it.
    """
    last = maps.agg(F.max("k")).first()[0] or 0
    done, reach = maps, 1
    while reach < last:
        before = done.select(F.col("conv_id").alias("p_conv"), (F.col("k") + reach).alias("p_k"), F.col("map").alias("p_map"))
        both = done.join(before, F.col("conv_id").eqNullSafe(F.col("p_conv")) & (F.col("k") == F.col("p_k")), "left")
        through = F.transform("p_map", lambda x: F.element_at("map", x + 1))
        done = stored(both.select("conv_id", "k", F.coalesce(through, F.col("map")).alias("map")), "maps")
        reach *= 2
    reached = done.select("conv_id", (F.col("k") + 1).alias("k"), F.element_at("map", start + 1).alias("value"))
    return reached.unionByName(maps.filter("k = 1").select("conv_id", "k", F.lit(start).alias("value")))


def _rows_of(table: pa.Table) -> list[tuple]:
    table = table.sort_by("seq")
    return list(zip(table.column("initial").to_pylist(), table.column("fault").to_pylist(), strict=True))


def _reruns(tried: list[tuple]):
    """A function that gives the vectors out of one block's part for the vectors in."""
    text = lambda vs: pa.array([",".join(map(str, v)) for v in vs])

    def run(table):
        rows = _rows_of(table)
        first = backward(rows, FINAL)
        again = pa.array([0] * len(tried))
        return pa.table({
            "conv_id": table.column("conv_id").take(again),
            "k": table.column("k").take(again),
            "v_in": text(tried),
            "v_out": text([rerun(rows, v, first) for v in tried]),
        })

    return run


def _states(table: pa.Table) -> pa.Table:
    """The state after one block's part for each state before it."""
    rows = _rows_of(table)
    costs = backward(rows, _vector(table.column("after")[0].as_py()))
    found = [trace(rows, costs, s)[2] for s in range(4)]
    return pa.table({
        "conv_id": table.column("conv_id").slice(0, 1),
        "k": table.column("k").slice(0, 1),
        "map": pa.array([found], pa.list_(pa.int32())),
    })


def _vector(text: str) -> tuple:
    return tuple(int(x) for x in text.split(","))


def borders(faults: DataFrame, segments: DataFrame) -> DataFrame:
    """``conv_id, block, after, state, last``: true costs after and state before every long part."""
    spark = faults.sparkSession
    kind = dict(faults.dtypes)["conv_id"]
    s = segments.select(F.col("conv_id").alias("s_conv"), F.col("block").alias("s_block"), "k", "m")
    own = faults.withColumn("block", F.shiftright("seq", BLOCK_BITS))
    same = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("block") == F.col("s_block"))
    parts = stored(own.join(s, same).select("conv_id", "block", "k", "m", "seq", "initial", "fault"), "parts")
    vectors, fresh, made = [], [FINAL], None
    while fresh:
        vectors += fresh
        ran = parts.groupBy("conv_id", "k").applyInArrow(_reruns(list(fresh)), f"conv_id {kind}, k int, v_in string, v_out string")
        ran = stored(ran, "reruns")
        made = ran if made is None else made.unionByName(ran)
        # few: costs of the states differ by a few units
        fresh = sorted({_vector(r[0]) for r in ran.select("v_out").distinct().collect()} - set(vectors))
    code = spark.createDataFrame([(",".join(map(str, v)), i) for i, v in enumerate(vectors)], "v string, i int")
    code = F.broadcast(code)
    # the chain of costs runs from the last part to the first
    coded = made.join(code.withColumnRenamed("i", "i_in"), F.col("v_in") == F.col("v")).drop("v")
    coded = coded.join(code.withColumnRenamed("i", "i_out"), F.col("v_out") == F.col("v")).drop("v")
    maps = coded.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list(F.struct("i_in", "i_out")))["i_out"].alias("map"))
    sizes = segments.select(F.col("conv_id").alias("s_conv"), F.col("k").alias("s_k"), "block", "m")
    joined = lambda df: df.join(sizes, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("k") == F.col("s_k")))
    back = stored(joined(maps).select("conv_id", (F.col("m") + 1 - F.col("k")).alias("k"), "m", "map"), "maps")
    m = back.filter("k = 1").select(F.col("conv_id").alias("m_conv"), "m")
    value = composed(back.drop("m"), 0).join(m, F.col("conv_id").eqNullSafe(F.col("m_conv"))).filter("k <= m")
    after = value.select("conv_id", (F.col("m") + 1 - F.col("k")).alias("k"), "value").join(code, F.col("value") == F.col("i"))
    after = stored(after.select(F.col("conv_id").alias("a_conv"), F.col("k").alias("a_k"), F.col("v").alias("after")), "after")
    at = lambda df: df.join(after, F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("k") == F.col("a_k")))
    states = at(parts).drop("a_conv", "a_k").groupBy("conv_id", "k").applyInArrow(_states, f"conv_id {kind}, k int, map array<int>")
    state = composed(stored(states, "states"), START)
    out = at(joined(state)).select("conv_id", "block", "after", F.col("value").alias("state"), (F.col("k") == F.col("m")).alias("last"))
    return stored(out, "borders")


# --- edits -----------------------------------------------------------------------------
def _traced(table: pa.Table, edges: pa.Table) -> pa.Table:
    """Edits of all turns of a block; ``edges`` has what is known at its border parts."""
    table = table.sort_by("seq")
    known = {r["conv_id"]: r for r in edges.to_pylist()}
    convs = table.column("conv_id").to_pylist()
    counts = table.column("n").to_pylist()
    rows = list(zip(table.column("initial").to_pylist(), table.column("fault").to_pylist(), strict=True))
    edits, made = [], []
    start = 0
    for k in range(1, len(rows) + 1):
        if k < len(rows) and convs[k] == convs[start]:
            continue
        part = rows[start:k]
        edge = known.get(convs[start], {"after": None, "state": START, "last": True})
        after = _vector(edge["after"]) if edge["after"] else FINAL
        own, roles, state = trace(part, backward(part, after), edge["state"])
        # equal turns after the first are duplicates
        own = [e + "D" * (n - 1) for e, n in zip(own, counts[start:k], strict=True)]
        roles = [r + "-" * (n - 1) for r, n in zip(roles, counts[start:k], strict=True)]
        if edge["last"]:
            more, more_roles = closing(state)
            own[-1] += more
            roles[-1] += more_roles
        edits += own
        made += roles
        start = k
    return pa.table({
        "conv_id": table.column("conv_id"), "seq": table.column("seq"), "n": table.column("n"), "fault": table.column("fault"),
        "edits": pa.array(edits, pa.string()), "made": pa.array(made, pa.string()),
    })


def edits_of(faults: DataFrame) -> DataFrame:
    """Adds ``edits`` and ``made`` to every turn: letters of the edits around it and the roles made."""
    kind = dict(faults.dtypes)["conv_id"]
    segments = long_segments(faults)
    own = faults.select("conv_id", "seq", "initial", "n", "fault", _block())
    out = f"conv_id {kind}, seq long, n long, fault int, edits string, made string"
    if segments.isEmpty():
        edges = faults.sparkSession.createDataFrame([], f"conv_id {kind}, block long, after string, state int, last boolean")
    else:
        edges = borders(faults, segments)
    return own.groupBy("block").cogroup(edges.groupBy("block")).applyInArrow(_traced, out)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in order (``seq, conv_id, turn, role, text``) and their edits, of conversations given as rows."""
    turns, faults = in_order(rows)
    return turns, stored(edits_of(faults), "edits")


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id, seq, place, turn, edit, role, text``."""
    each = edits.select("seq", F.posexplode(F.arrays_zip(F.split("edits", "").alias("e"), F.split("made", "").alias("r"))).alias("place", "x"))
    each = each.select("seq", "place", F.col("x.e").alias("edit"), F.col("x.r").alias("made")).filter("edit <> 'D'")
    role = F.when(F.col("made") == "u", "user").when(F.col("made") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return turns.join(each, "seq").select("conv_id", "seq", "place", "turn", "edit", role.alias("role"), text.alias("text"))


# --- digests ---------------------------------------------------------------------------
DIGEST = {
    "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long",
    "audit": "string", "repaired_sha256": "string",
}
_LEGAL = {"su", "ua", "au"}
_MADE = {"u": "user", "a": "assistant"}
_COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


class _Digest:
    """What is reported of one conversation, turn by turn."""

    def __init__(self):
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.lines = 0
        self.before: str | None = None

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def add(self, row: dict, edit: dict) -> None:
        turn, role, n, fault = row["turn"], row["role"], edit["n"], edit["fault"]
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.turns = turn, self.turns + 1
        self.blank += n if fault == BLANK else 0
        self.duplicate += n if fault == DUPLICATE else n - 1 if fault != BLANK else 0
        self.truncated += fault == CUT
        initial = role[:1]
        self.illegal += (self.before is not None and self.before + initial not in _LEGAL) + (n - 1)
        self.before = initial
        self.audit.append(edit["edits"])
        for letter, made in zip(edit["edits"], edit["made"], strict=True):
            self.cost += _COST[letter] + (TRUNCATED if letter in "KR" and fault == CUT else 0)
            if letter != "D":
                self._line(_MADE.get(made, role), "" if letter == "I" else row["text"])

    def row(self) -> list:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return [
            gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest(),
        ]


def digests(conversations: DataFrame, turns: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: faults, cost, audit and a hash of the repaired text.

    Turns and edits of a conversation meet in one task, sorted, and are read as a stream.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    turn_kind = turns.schema["turn"].dataType.simpleString()
    null = lambda t, name: F.lit(None).cast(t).alias(name)
    marks = conversations.select("conv_id").distinct().select(
        F.col("conv_id").cast(kind).alias("conv_id"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("part"),
        null(turn_kind, "turn"), null("string", "role"), null("string", "text"), null("long", "n"), null("int", "fault"),
        null("string", "edits"), null("string", "made"),
    )
    said = turns.select(
        "conv_id", "seq", F.lit(1).alias("part"), "turn", "role", "text", null("long", "n"), null("int", "fault"),
        null("string", "edits"), null("string", "made"),
    )
    done = edits.select(
        "conv_id", "seq", F.lit(2).alias("part"), null(turn_kind, "turn"), null("string", "role"), null("string", "text"),
        "n", "fault", "edits", "made",
    )
    every = marks.unionByName(said).unionByName(done)
    every = every.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "part")

    def read(batches):
        digest, conv, row, ids, out = None, None, None, [], []

        def packed():
            columns = [pa.array([r[i] for r in out], pa.string() if t == "string" else pa.int64()) for i, t in enumerate(DIGEST.values())]
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("conv_id").type), *columns], names=["conv_id", *DIGEST])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if digest is not None:
                        ids.append(conv)
                        out.append(digest.row())
                    digest, conv = _Digest(), r["conv_id"]
                elif r["part"] == 1:
                    row = r
                else:
                    digest.add(row, r)
            if out:
                yield packed()
                ids, out = [], []
        if digest is not None:
            ids.append(conv)
            out.append(digest.row())
            yield packed()

    return every.mapInArrow(read, f"conv_id {kind}, " + ", ".join(f"{c} {t}" for c, t in DIGEST.items()))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of all conversations, a part of whose rows is damaged first."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns, edits = repair(damage(given))
    return digests(given, turns, edits)
