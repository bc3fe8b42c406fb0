"""Chat formatting: tool calls linked to results, ordered, validated, as canonical JSON.

Messages are read once, into a table of calls and results. An aggregate, partial before its
shuffle, leaves a row for each (conversation, call id) with the first result and whether there
is a call; a hash join hands it to the calls. The call side may be split, so neither a long
conversation nor an id that very many calls share ends in one task. Calls of one message are
ordered topologically by the calls that they come after; a message is one row, so the order
needs no shuffle. Arguments are checked against the tool's schema, and every record is one
line of canonical JSON: sorted keys, no spaces, no escapes of other scripts.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import Written

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
#: A row a call or a result; head: its record up to the result's value, content: that value of a result.
EVENT_FIELDS = "conv_id long, turn long, idx int, call_id string, head string, position int, error string, content string"
#: What is wrong with a call that can't be read.
MALFORMED = "malformed"
WORD = re.compile(r"[^ \t\r\x0b\x0c]+")
#: The tool of the registered query: a line of a user's turn is a call, a line of the reply its result.
LINE_TOOL = {"reply_line": {"type": "object", "required": ["line", "words"], "additionalProperties": False, "properties": {"line": {"type": "string", "minLength": 1, "maxLength": 4000}, "words": {"type": "integer", "minimum": 1, "maximum": 40}}}}


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _finite(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError(f"out of range: {text}")
    return x


def _no_constant(text: str) -> None:
    raise ValueError(f"not JSON: {text}")


def read(text: str) -> tuple[object, str] | None:
    """The value of a JSON text and its canonical form; None for what isn't JSON or has none: NaN and infinite
    numbers, lone surrogates, integers or nesting beyond what the parser takes."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
        whole = canonical(value)
        whole.encode()
        return value, whole
    except (ValueError, RecursionError):
        return None


def identifier(value: object) -> str | None:
    """An id is a string or an integer, by its digits; anything else is no id."""
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    return value if isinstance(value, str) else None


TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violation(value: object, schema: dict, at: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, bounds, lengths, pattern, items, properties), or None."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("integer", "number"):
        if not number or kind == "integer" and value != int(value):
            return f"{at}: not {kind}"
    elif kind and not isinstance(value, TYPES[kind]):
        return f"{at}: not {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if number and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: out of range"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and re.search(schema["pattern"], value) is None:
            return f"{at}: pattern"
    if isinstance(value, list) and "items" in schema:
        return next((v for i, x in enumerate(value) if (v := violation(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if v := violation(value[k], known[k], f"{at}.{k}"):
                    return v
            elif schema.get("additionalProperties") is False:
                return f"{at}.{k}: unknown"
    return None


def topological(ids: list[str | None], after: list[list[str | None]]) -> list[int | None]:
    """Each call's place in topological order, ties in given order; None in or behind a cycle. Other messages' ids and missing ones bind nothing."""
    first: dict[str, int] = {}
    for i, x in enumerate(ids):
        if x is not None:
            first.setdefault(x, i)
    waits = [{first[a] for a in x if a in first} for x in after]
    behind: list[list[int]] = [[] for _ in ids]
    for i, w in enumerate(waits):
        for j in w:
            behind[j].append(i)
    ready, place, out = [i for i, w in enumerate(waits) if not w], 0, [None] * len(ids)
    while ready:
        i = heapq.heappop(ready)
        out[i] = place
        place += 1
        for j in behind[i]:
            waits[j].discard(i)
            if not waits[j]:
                heapq.heappush(ready, j)
    return out


def checked(calls: list[dict], schemas: dict[str, dict]) -> list[tuple]:
    """(call_id, head, position, error) of one message's calls, whose values are JSON; head: the record up to the result's value."""
    ids = [identifier(c.get("id")) for c in calls]
    waits = [x if isinstance(x := c.get("after"), list) else [] for c in calls]
    places = topological(ids, [[identifier(a) for a in x] for x in waits])
    out = []
    for c, i, p in zip(calls, ids, places):
        name = c.get("name")
        schema = schemas.get(name) if isinstance(name, str) else None
        if MALFORMED in c:
            error = MALFORMED
        elif p is None:
            error = "cycle"
        elif c.get("after") is not None and not isinstance(c["after"], list):
            error = "$.after: not array"
        elif schema is None:
            error = "unknown tool"
        else:
            error = violation(c.get("arguments"), schema)
        out.append((i, f'{{"arguments":{canonical(c.get("arguments"))},"id":{canonical(i)},"name":{canonical(name)},"result":', p, error))
    return out


def tagged_events(role: str | None, turn: int | None, text: str) -> tuple[list[dict], list[tuple[str | None, str]]]:
    """Calls in ``<tool_call>`` JSON of an assistant's message; the results of a tool's message, one JSON object or a list of them.

    What can't be read is a malformed call with its text as arguments, or a result without an id with its text as content.
    """
    calls: list[dict] = []
    results: list[tuple[str | None, str]] = []
    if role == "assistant":
        for m in CALL.finditer(text):
            found = read(m[1])
            calls.append(found[0] if found and isinstance(found[0], dict) and MALFORMED not in found[0] else {"arguments": m[1].strip(), MALFORMED: True})
    elif role == "tool":
        found = read(text)
        given = found[0] if found and isinstance(found[0], list) else [found[0]] if found else []
        if given and all(isinstance(x, dict) for x in given):
            results = [(identifier(x.get("id")), canonical(x.get("content"))) for x in given]
        elif not found or given:
            results = [(None, canonical(text))]
    return calls, results


def line_events(role: str | None, turn: int | None, text: str) -> tuple[list[dict], list[tuple[str | None, str]]]:
    """A user's lines are calls, each after the line before; a reply's lines answer those of the turn before by number.
    Without a turn they have no id."""
    if role == "user":
        ids = [None if turn is None else f"{turn}:{i}" for i in range(text.count("\n") + 1)]
        return [{"id": k, "name": "reply_line", "arguments": {"line": x, "words": len(WORD.findall(x))}, "after": ids[i - 1 : i]} for i, (k, x) in enumerate(zip(ids, text.split("\n")))], []
    if role == "assistant":
        return [], [(None if turn is None else f"{turn - 1}:{i}", canonical(x)) for i, x in enumerate(text.split("\n"))]
    return [], []


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict], events=tagged_events) -> DataFrame:
    """A row for each call, and for each result without a call, of ``messages(conv_id, turn, role, text)``.

    Returns conv_id, turn, call_id, position (in topological order of its message), status
    (linked, unanswered, orphan), valid, error, json. A call of an unknown tool, with
    arguments against its schema, in a cycle, or one that can't be read (malformed) is invalid,
    and stays. Of results with one id in a conversation the first by (turn, index, content)
    counts; repeated calls each get it. A call or result without an id, or in a null
    conversation, links with nothing and is a row of its own. A null text is empty; a null
    role has no events; a null turn stays null and comes first. An empty table gives an empty
    one; other columns are not read.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(f.split() for f in EVENT_FIELDS.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                calls, results = events(role, turn, text)
                rows += [(conv, turn, i, *c, None) for i, c in enumerate(checked(calls, schemas))]
                rows += [(conv, turn, i, k, f'{{"id":{canonical(k)},"result":', None, None, v) for i, (k, v) in enumerate(results)]
            yield pa.record_batch([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=names)

    chosen = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = Written(chosen.mapInArrow(run, EVENT_FIELDS), "events").df
    is_call, keyed = F.col("content").isNull(), F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.when(~is_call, F.struct("turn", "idx", "content", "head")))
    keys = every.where(keyed).groupBy("conv_id", "call_id").agg(first.alias("r"), F.max(is_call).alias("called"))
    answers = keys.where("called and r is not null").select("conv_id", "call_id", F.col("r.content").alias("content"))
    linked = every.where(is_call & keyed).drop("content").join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    orphans = keys.where("not called").select("conv_id", "call_id", "r.*")
    calls = linked.unionByName(every.where(is_call & ~keyed)).withColumn("called", F.lit(True))
    results = orphans.unionByName(every.where(~is_call & ~keyed), allowMissingColumns=True).withColumn("called", F.lit(False))
    status = F.when(~F.col("called"), "orphan").when(F.col("content").isNull(), "unanswered").otherwise("linked")
    return calls.unionByName(results).select(
        "conv_id", "turn", "call_id", "position", status.alias("status"), (F.col("called") & F.col("error").isNull()).alias("valid"), "error",
        F.concat("head", F.coalesce("content", F.lit("null")), F.lit("}")).alias("json"),
    )
