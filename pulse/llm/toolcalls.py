"""Linking of tool calls and results in conversations.

An assistant message may hold ``{"tool_calls": [{"id", "name", "arguments", "needs"}]}``; a
message of role ``tool`` holds ``{"tool_call_id", "content"}``. Calls and results are joined
by conversation and identifier. A call comes after the calls it needs: its level is one more
than the highest of theirs. Stretches of turns are contracted to the calls that other
stretches need, then wider ones over what is left, and settled in the other order, so that the
tables grow with the logarithm of a conversation. A task holds one stretch at a time: the calls
of ``WIDTH`` turns, later the border calls of wider ones. Arguments are validated against the schema of the tool, and each call is written as canonical JSON:
sorted keys, no spaces, text as it is.

Defined cases: of repeated messages (equal conversation and turn) the least counts; of calls
with equal ids the first turn; of several results the first, with their number in
``n_results``. Messages that are not JSON of these forms are skipped; null texts, too. A call
without result has null ``result``; a result without call is a row with status ``orphan``. Needs
that name no call are errors of the call and are not waited for. Calls in a cycle of needs
have level -1 and status ``cycle``. Rows with a null conversation, turn or call id take no
part. Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import partial

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import stored

#: Tools of the conversations: properties with their types, and those that must be there.
SCHEMAS = {
    "answer": {
        "properties": {"question": "string", "turn": "integer", "words": "integer", "system": "string"},
        "required": ["question", "turn"],
    }
}
_TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
}
#: Turns of the narrowest stretch, and how many times wider the next ones are.
WIDTH = 1024
#: Parts of the calls of a chunk above which a contraction would not make it shorter.
MOST_PARTS = 2_000_000
#: Rows that a task reads before it works on the complete stretches among them.
CHUNK = 50_000
#: ``dist`` of a row that says that another stretch needs the call.
WANTED = -1
_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,needs:array<string>>>"
_RESULT = "tool_call_id string, content string"


def validate(name: str | None, arguments: str | None, schemas: dict = SCHEMAS) -> tuple[object, list[str]]:
    """Parsed arguments and what is wrong with them."""
    schema = schemas.get(name)
    if schema is None:
        return arguments, ["unknown tool"]
    try:
        value = json.loads(arguments) if arguments else {}
    except ValueError:
        return arguments, ["arguments are not JSON"]
    if not isinstance(value, dict):
        return value, ["arguments are not an object"]
    errors = [f"missing {k}" for k in schema["required"] if value.get(k) is None]
    for key in sorted(value):
        kind = schema["properties"].get(key)
        if kind is None:
            errors.append(f"unexpected {key}")
        elif value[key] is not None and (
            not isinstance(value[key], _TYPES[kind]) or (isinstance(value[key], bool) and kind != "boolean")
        ):
            errors.append(f"{key} is not {kind}")
    return value, errors


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _stretch(turn, width: int):
    """First turn of the stretch of a turn; works on columns and numbers.

    Turn 0 is in the middle of a stretch, so that wide ones hold turns of both signs.
    """
    place = turn + width // 2
    return turn - (F.pmod(place, F.lit(width)) if isinstance(turn, Column) else place % width)


def _forms(rows: pa.Table, width: int) -> tuple[dict, list, dict]:
    """Calls of complete stretches in the order of their needs.

    Returns the parts of each call (``None`` or a need, its turn, and a distance), the calls
    that wait for no cycle inside their stretch, needs first, and the turn of each call. A
    need in another stretch is a part like a settled level: nothing here waits for it.
    """
    parts: dict[tuple, list] = {}
    turns: dict[tuple, int] = {}
    columns = [rows.column(c).to_pylist() for c in ("conv_id", "call_id", "turn", "need", "need_turn", "dist")]
    for conv, call, turn, need, need_turn, dist in zip(*columns, strict=True):
        turns[conv, call] = turn
        parts.setdefault((conv, call), []).append((need, need_turn, dist))
    waits, open_needs = {}, {}
    for (conv, call), own in parts.items():
        inner = {n for n, t, _ in own if n is not None and _stretch(t, width) == _stretch(turns[conv, call], width)}
        open_needs[conv, call] = len(inner)
        for n in inner:
            waits.setdefault((conv, n), []).append((conv, call))
    order = [x for x, n in open_needs.items() if not n]
    for x in order:  # grows while it is read
        for y in waits.get(x, ()):
            open_needs[y] -= 1
            if not open_needs[y]:
                order.append(y)
    return parts, order, turns


def _contract(rows: pa.Table, width: int, most_parts: int) -> list[tuple]:
    """The wanted calls of complete stretches by levels outside their stretch only.

    Where that would be longer than ``most_parts`` parts, the rows stay as they are.
    """
    wanted = rows.filter(pa.compute.fill_null(pa.compute.equal(rows.column("dist"), WANTED), False))
    plain = rows.filter(pa.compute.fill_null(pa.compute.not_equal(rows.column("dist"), WANTED), True))
    parts, order, turns = _forms(plain, width)
    reduced: dict[tuple, dict] = {}
    size = 0
    for x in order:
        own: dict = {}
        for need, need_turn, dist in parts[x]:
            inner = need is not None and _stretch(need_turn, width) == _stretch(turns[x], width)
            for (n, t), d in reduced[x[0], need].items() if inner else [((need, need_turn), 0)]:
                have = own.get((n, t), 0)
                own[n, t] = None if d is None or dist is None or have is None else max(have, d + dist)
        reduced[x] = own if own.get((None, None), 0) is not None else {(None, None): None}
        size += len(reduced[x])
        if size > most_parts:
            return list(zip(*[plain.column(c).to_pylist() for c in plain.column_names], strict=True))
    out = []
    for conv, call in zip(wanted.column("conv_id").to_pylist(), wanted.column("call_id").to_pylist(), strict=True):
        for (need, need_turn), dist in reduced.get((conv, call), {(None, None): None}).items():
            out.append((conv, call, turns[conv, call], need, need_turn, dist))
    return out


def _settle(rows: pa.Table, width: int) -> list[tuple]:
    """``conv_id, call_id, level`` of complete stretches whose needs are all inside."""
    parts, order, _ = _forms(rows, width)
    level = dict.fromkeys(parts, -1)
    for x in order:
        own = [dist if need is None else None if level[x[0], need] < 0 else level[x[0], need] + dist for need, _, dist in parts[x]]
        level[x] = -1 if None in own else max(own)
    return [(conv, call, n) for (conv, call), n in level.items()]


def _by_stretch(rows: DataFrame, width: int, solve, schema: str) -> DataFrame:
    """``solve`` on chunks of complete stretches, which lie in one task and follow each other."""
    key = ["conv_id", _stretch(F.col("turn"), width)]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        held, size, kind = [], 0, None

        def answer(table):
            found = solve(table, width)
            return [pa.array(x, kind.field(c).type if c in kind.names else pa.int64()) for c, x in zip(names, zip(*found, strict=True), strict=True)] if found else None

        for batch in batches:
            kind = batch.schema
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            conv, turn = table.column("conv_id").to_pylist(), table.column("turn").to_pylist()
            last = (conv[-1], _stretch(turn[-1], width))
            cut = size
            while cut and (conv[cut - 1], _stretch(turn[cut - 1], width)) == last:
                cut -= 1
            if cut:
                arrays = answer(table.slice(0, cut))
                if arrays:
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
            held, size = table.slice(cut).to_batches(), size - cut
        if size:
            arrays = answer(pa.Table.from_batches(held))
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def levels(calls: DataFrame, width: int = WIDTH) -> DataFrame:
    """``conv_id, call_id, level`` of calls given with ``turn`` and ``needs``; -1 in or after a cycle.

    A call is at 0 or at the highest ``level(need) + dist`` of its rows. Stretches of ``width``
    turns are contracted to the calls that others need, written by needs in other stretches;
    then stretches ``width`` times as wide, until no need leaves its stretch. The widest are
    settled, and the narrower ones after them with the levels of what they need.
    Tables grow with the logarithm of the longest conversation, at most two a width. Turns
    are taken to be between -2**60 and 2**60.
    """
    own = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"))
    needs = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.explode(F.array_distinct("needs")).alias("need"))
    needs = needs.join(own.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn")), ["conv_id", "need"])
    base = own.withColumns({"need": F.lit(None).cast("string"), "need_turn": F.lit(None).cast("long"), "dist": F.lit(0).cast("long")})
    rows = stored(base.unionByName(needs.withColumn("dist", F.lit(1).cast("long"))), "needs")
    row_schema = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    level_schema = f"{row_schema.split(', ')[0]}, call_id string, level long"

    def leaving(rows: DataFrame, width: int) -> DataFrame:
        return rows.filter(_stretch(F.col("need_turn"), width) != _stretch(F.col("turn"), width))

    steps = [(rows, width)]
    while leaving(rows, width).limit(1).count():
        asked = leaving(rows, width).select("conv_id", F.col("need").alias("call_id"), F.col("need_turn").alias("turn")).distinct()
        asked = asked.withColumns({"need": F.lit(None).cast("string"), "need_turn": F.lit(None).cast("long"), "dist": F.lit(WANTED).cast("long")})
        rows = stored(_by_stretch(rows.unionByName(asked), width, partial(_contract, most_parts=MOST_PARTS), row_schema), "needs")
        width = min(width * steps[0][1], 1 << 62)
        steps.append((rows, width))
    found = None
    for rows, width in reversed(steps):
        if found is not None:
            away = leaving(rows, width).join(found.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"])
            away = away.withColumn("dist", F.when(F.col("level") >= 0, F.col("level") + F.col("dist")))
            away = away.withColumns({"need": F.lit(None).cast("string"), "need_turn": F.lit(None).cast("long")}).drop("level")
            inside = rows.filter(F.col("need").isNull() | (_stretch(F.col("need_turn"), width) == _stretch(F.col("turn"), width)))
            rows = inside.unionByName(away)
        found = stored(_by_stretch(rows, width, _settle, level_schema), "levels")
    return found


def link_tool_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call or orphan result of ``messages`` (conv_id, turn, role, text)."""
    one = messages.select("conv_id", "turn", "role", "text").filter("conv_id is not null and turn is not null")
    one = stored(one.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.*"), "messages")
    said = one.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c"))
    calls = said.filter("c.id is not null").groupBy("conv_id", F.col("c.id").alias("call_id")).agg(
        F.min(F.struct("turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.needs").alias("needs"))).alias("c")
    )
    calls = stored(calls.select("conv_id", "call_id", "c.*"), "calls")
    got = one.filter("role = 'tool'").select("conv_id", "turn", F.from_json("text", _RESULT).alias("r"))
    results = got.filter("r.tool_call_id is not null").groupBy("conv_id", F.col("r.tool_call_id").alias("call_id")).agg(
        F.min(F.struct("turn", F.col("r.content").alias("content"))).alias("r"), F.count("*").alias("n_results")
    )
    wanted = calls.select("conv_id", "call_id", F.explode_outer("needs").alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known"))
    unknown = (
        wanted.filter("need is not null").join(known, ["conv_id", "need"], "left").filter("known is null")
        .groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("need")).alias("lost"))
    )
    linked = (
        calls.join(results, ["conv_id", "call_id"], "full_outer")
        .join(levels(calls), ["conv_id", "call_id"], "left")
        .join(unknown, ["conv_id", "call_id"], "left")
        .select(
            "conv_id", "call_id", "turn", "name", "arguments", "needs", F.col("r.turn").alias("result_turn"),
            F.col("r.content").alias("result"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "level", "lost",
        )
    )

    def writes(batches):
        for batch in batches:
            status, errors, texts = [], [], []
            for row in batch.to_pylist():
                if row["turn"] is None:
                    status.append("orphan")
                    errors.append(["no call"])
                    texts.append(canonical({"id": row["call_id"], "result": row["result"]}))
                    continue
                value, wrong = validate(row["name"], row["arguments"], schemas)
                wrong += [f"needs unknown {x}" for x in row["lost"] or []]
                status.append("cycle" if row["level"] == -1 else "invalid" if wrong else "ok" if row["n_results"] else "open")
                errors.append(wrong)
                call = {"arguments": value, "id": row["call_id"], "name": row["name"], "needs": sorted(row["needs"] or [])}
                texts.append(canonical({"call": call, "level": row["level"], "result": row["result"]}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("conv_id", "call_id", "turn", "result_turn", "level", "n_results")]
                + [pa.array(status, pa.string()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["conv_id", "call_id", "turn", "result_turn", "level", "n_results", "status", "errors", "json"],
            )

    kinds = dict(linked.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "call_id", "turn", "result_turn", "level", "n_results"))
    return linked.mapInArrow(writes, f"{head}, status string, errors array<string>, json string")


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as calls and results.

    Every assistant turn is a call of ``answer`` with the turn before it as question (the one
    before a system turn has none) that needs the assistant turn two before; the turn after
    it is the result. Turns join by conversation and turn, so a long conversation is spread.
    """
    rows = conversations.filter("conv_id is not null and turn is not null")
    rows = rows.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.*")
    rows = stored(rows, "turns")
    at = lambda name, by: rows.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("role").alias(f"{name}_role"), F.col("text").alias(name))
    key = ["conv_id", "turn"]
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    asked = rows.filter("role = 'assistant'").select(*key, "text").join(at("before", 1), key, "left").join(at("earlier", 2).drop("earlier"), key, "left")
    call = F.struct(
        name(F.col("turn")).alias("id"),
        F.lit("answer").alias("name"),
        F.struct(
            F.when(F.col("before_role") == "user", F.col("before")).alias("question"),
            F.when(F.col("before_role") == "system", F.col("before")).alias("system"),
            "turn",
            F.size(F.split("text", " ")).alias("words"),
        ).alias("arguments"),
        F.when(F.col("earlier_role") == "assistant", F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    calls = asked.select("conv_id", (2 * F.col("turn")).alias("turn"), F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    heard = rows.filter("role <> 'assistant'").join(at("before", 1).drop("before"), key).filter("before_role = 'assistant'")
    result = F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    results = heard.select("conv_id", (2 * F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), F.to_json(result).alias("text"))
    return calls.unionByName(results)


def op8_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Linked, ordered, validated and serialised calls of all conversations."""
    linked = link_tool_calls(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return linked.withColumn("errors", F.array_join("errors", "; "))
