"""JSON bodies: which strings are text, taking them out with their paths, and putting them back.

One Arrow function walks a body to (path, text) rows, detection and replacement then work on plain columns, and another
writes the replaced texts back into the body as it was written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions.jsontext import Tape, plain, quote, same
from spanveil.operators.tables import settled

# Keys and block types that decide what is text.
TEXT_KEYS = frozenset("content text input prompt system instructions output_text".split())
TEXT_BLOCKS = frozenset("tool_use tool_result server_tool_use mcp_tool_use mcp_tool_result function_call function_call_output custom_tool_call custom_tool_call_output computer_call local_shell_call shell_call web_search_call apply_patch_call file_search_call code_interpreter_call program message".split())
OPAQUE_BLOCKS = frozenset("reasoning compaction compaction_trigger computer_call_output image_generation_call item_reference mcp_list_tools tool_search_call tool_search_output additional_tools input_image input_file input_audio image output_image computer_screenshot thinking redacted_thinking container_upload web_search_call web_fetch_result".split())
OPAQUE_KEYS = frozenset("data image_url input_image input_audio file_id file signature encrypted_content redacted_data summary".split())
DATA_URLS = ("data:image/", "data:audio/", "data:video/", "data:application/octet-stream", "data:application/pdf")
COMMAND_KEYS = "command cmd script code shell url file_path path pattern".split()
TOOL_BLOCKS = ("tool_use", "server_tool_use", "mcp_tool_use")
PRESERVED = ("file_path", "path")
FILE_TOOLS = ("read", "write", "edit", "multiedit", "notebookedit")


def opaque(tape: Tape, i: int) -> bool:
    """Whether a value is looked at by nothing: by its key, as data in a string, or as a block that isn't text."""
    if tape.key[i] in OPAQUE_KEYS:
        return True
    kind, said = tape.kind[i], tape.string[i]
    return said is not None and (kind == '"' and said.startswith(DATA_URLS) or kind == "{" and said in OPAQUE_BLOCKS)


@dataclass
class Text:
    """A string that is text; one that holds JSON under `arguments` holds texts of its own."""

    at: int
    inner: tuple[Tape, list[Text]] | None = None


def texts_of(tape: Tape, everything: bool = False, skip: tuple[str, ...] = (), text: bool = False) -> list[Text]:
    """The strings of a body that are text, in order.

    everything: all strings are, as for documents handed in to be redacted; else those under text keys or text blocks.
    arguments hold JSON in a string: it is walked as text and written back as a string; other strings there stay.
    """
    out: list[Text] = []
    flag = [False] * len(tape.kind)  # of objects and lists: whether they stand in a text
    i = 0
    while i < len(flag):
        up, key, kind, said = tape.up[i], tape.key[i], tape.kind[i], tape.string[i]
        inside = text if up < 0 else flag[up] or key in TEXT_KEYS or key == "arguments"
        if key in skip or opaque(tape, i):
            i = tape.last[i]
            continue
        if kind == "{":
            flag[i] = inside or said in TEXT_BLOCKS
        elif kind == "[":
            flag[i] = inside
        elif kind == '"' and key == "arguments":
            try:
                inner = Tape(said)
            except ValueError:
                out += [Text(i)] * everything
            else:
                out.append(Text(i, (inner, texts_of(inner, everything, skip, True))))
        elif kind == '"' and (inside or everything):
            out.append(Text(i))
        i += 1
    return out


def _listed(tape: Tape, texts: list[Text], before: str = "", call: int | None = None) -> Iterator[tuple[str, str, int | None, int, int]]:
    for n, t in enumerate(texts):
        path = before + (tape.path(t.at) if not before else tape.path(t.at)[1:])
        if t.inner:
            yield from _listed(*t.inner, f"{path}!", n if call is None else call)
        else:
            start, stop = (tape.start[t.at], tape.stop[t.at]) if call is None else (0, INSIDE)
            yield path, plain(tape.string[t.at]), call, start, stop


WHOLE, INSIDE = -1, -1  # in place of a start: the body is the text; of a stop: the text stands in a string that holds JSON


def placed_texts(body: str | None, everything: bool = False, skip: tuple[str, ...] = ()) -> list[tuple[str, str, int | None, int, int]]:
    """(path, text, number of the `arguments` it stands in, start, stop) of a body; a body that isn't JSON is one text."""
    if body is None:
        return []
    try:
        tape = Tape(body)
    except ValueError:
        return [("", body, None, WHOLE, 0)]
    return list(_listed(tape, texts_of(tape, everything, skip)))


def texts_in(body: str | None, everything: bool = False, skip: tuple[str, ...] = ()) -> list[tuple[str, str, int | None]]:
    """(path, text, number of the `arguments` it stands in) of a body."""
    return [x[:3] for x in placed_texts(body, everything, skip)]


def _filled(tape: Tape, texts: list[Text], new: Iterator[str]) -> str:
    def exchanged() -> Iterator[tuple[int, str]]:
        for t in texts:
            was = tape.string[t.at]
            if t.inner:
                yield t.at, _filled(*t.inner, new)
            else:
                now = next(new)
                yield t.at, was if now is None or now == plain(was) else now

    return tape.splice(exchanged())


def with_texts(body: str | None, new: list[str] | None, everything: bool = False, skip: tuple[str, ...] = ()) -> str | None:
    """The body with its texts, in walking order, exchanged for new ones; all else stays as it is written."""
    if body is None or new is None or not len(new):
        return body
    try:
        tape = Tape(body)
    except ValueError:
        return new[0]
    return _filled(tape, texts_of(tape, everything, skip), iter(new))


def _tools(tape: Tape) -> Iterator[dict]:
    i = 0
    while i < len(tape.kind):
        if opaque(tape, i):
            i = tape.last[i]
            continue
        if tape.kind[i] == "{":
            own = {tape.key[k]: k for k in tape.items(i)}
            given = own.get("arguments", own.get("input") if tape.string[i] in TOOL_BLOCKS else None)
            name = own.get("name")
            if name is not None and tape.kind[name] == '"' and given is not None and not (tape.kind[given] == "v" and tape.text.startswith("null", tape.start[given])):
                yield {"tool": plain(tape.string[name]), "command": plain(command_of(tape, given))}
        i += 1


def command_of(tape: Tape, given: int = 0) -> str:
    """The first of the command keys that holds a text or a list of texts; what is given may be JSON in a string."""
    if tape.kind[given] == '"':
        try:
            tape, given = Tape(tape.string[given]), 0
        except ValueError:
            return ""
    if tape.kind[given] != "{":
        return ""
    own = {tape.key[k]: k for k in tape.items(given)}
    for k in COMMAND_KEYS:
        at = own.get(k, -1)
        if at < 0:
            continue
        words = list(tape.items(at)) if tape.kind[at] == "[" else [at]
        if words and all(tape.kind[w] == '"' for w in words) and (said := " ".join(tape.string[w] for w in words)):
            return said
    return ""


SLICE = 256  # bodies that a task holds as objects at once


def _by_slices(one, form: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one() of each row of the columns; only a slice of them stands beside the Arrow form at a time."""
    made = [pa.array([one(*r) for r in zip(*(c.slice(i, SLICE).to_pylist() for c in columns), strict=True)], form) for i in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(made) if made else pa.array([], form)


_TEXTS = "array<struct<path:string,text:string,call:int,start:int,stop:int>>"
_TEXT_NAMES = ("path", "text", "call", "start", "stop")
_TEXTS_FORM = pa.list_(pa.struct([(n, pa.string() if n in ("path", "text") else pa.int32()) for n in _TEXT_NAMES]))


def text_column(body: Column, everything: bool = False, skip: tuple[str, ...] = ()) -> Column:
    @F.arrow_udf(_TEXTS)
    def run(bodies: pa.Array) -> pa.Array:
        return _by_slices(lambda b: [dict(zip(_TEXT_NAMES, x, strict=True)) for x in placed_texts(b, everything, skip)], _TEXTS_FORM, bodies)

    return run(body)


def put_back(body: str | None, new: list[dict] | None, everything: bool = False, skip: tuple[str, ...] = ()) -> str | None:
    """The body with those of its texts exchanged that are new (t, not null), by their places; it is walked again only for texts in strings that hold JSON."""
    if body is None or not new or all(x["t"] is None for x in new):
        return body
    if any(x["t"] is not None and x["stop"] == INSIDE for x in new):
        return with_texts(body, [x["t"] for x in new], everything, skip)
    out, at = [], 0
    for x in new:
        if x["t"] is not None:
            if x["start"] == WHOLE:
                return x["t"]
            out += [body[at : x["start"]], quote(x["t"])]
            at = x["stop"]
    return "".join([*out, body[at:]])


def write_back(body: Column, texts: Column, everything: bool = False, skip: tuple[str, ...] = ()) -> Column:
    """body with its texts, in walking order, replaced by those of the array (t, start, stop) that are not null."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array, replaced: pa.Array) -> pa.Array:
        return _by_slices(lambda b, n: put_back(b, n, everything, skip), pa.string(), bodies, replaced)

    return run(body, texts)


def tool_calls(body: Column) -> Column:
    @F.pandas_udf("array<struct<tool:string,command:string>>")
    def run(bodies: pd.Series) -> pd.Series:
        def one(b: str | None) -> list[dict]:
            try:
                return list(_tools(Tape(b))) if b else []
            except ValueError:
                return []

        return bodies.map(one)

    return run(body)


def message_contents(body: Column) -> Column:
    """Texts of messages[].content, in order; built-in functions only."""
    messages = F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string,content:string>>")
    return F.transform(F.filter(messages, lambda m: m["content"].isNotNull()), lambda m: m["content"])


#: The number of a body in its table: request ids may be null and repeat.
ROW = "__row"
#: Where a text stands in its body, in characters.
START, STOP = "__start", "__stop"


def numbered(bodies: DataFrame) -> DataFrame:
    """bodies with a number of their own, written over all cores, since texts and bodies are joined by it."""
    from spanveil.operators.detect import spread

    return settled(spread(bodies).withColumn(ROW, F.monotonically_increasing_id()))


def explode_texts(bodies: DataFrame, everything: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """(number, request_id, body) -> (number, request_id, seq, path, text, call, and the text's place): the rows that detection and replacement take."""
    return bodies.select(ROW, "request_id", F.posexplode(text_column(F.col("body"), everything, skip)).alias("seq", "x")).select(ROW, "request_id", "seq", "x.path", "x.text", "x.call", F.col("x.start").alias(START), F.col("x.stop").alias(STOP))


def collect_texts(bodies: DataFrame, texts: DataFrame, column: str = "replaced", everything: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """Put (number, seq, column, and the text's place) back into the numbered bodies; changed says whether any text differs."""
    differs = ~F.col(column).eqNullSafe(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.when(differs, F.col(column)).alias("t"), F.col(START).alias("start"), F.col(STOP).alias("stop"))))
    joined = bodies.join(texts.groupBy(ROW).agg(F.max(differs).alias("changed"), ordered.alias("__texts")).withColumn("__texts", F.when(F.col("changed"), F.col("__texts"))), ROW, "left")
    return joined.withColumn("rewritten", write_back(F.col("body"), F.col("__texts"), everything, skip)).withColumn("changed", F.coalesce("changed", F.lit(False))).drop("__texts")


def blocked(entities: Column, block_types: list[str] | None = None) -> Column:
    """Whether a gate stops the text: an entity of the listed types, or of any when none are listed."""
    return F.exists(entities, lambda e: e["type"].isin(*block_types)) if block_types else F.size(entities) > 0


#: What gates and reports return of an entity.
SEEN = "array<struct<type:string,value:string,path:string,start:int,end:int,score:double>>"


def redact(bodies: DataFrame, strategy: str = "placeholder", gate_only: bool = False, block_types: list[str] | None = None, include_values: bool = False, everything: bool = True, preserve: tuple[str, ...] = (), overrides: dict[str, str] | None = None, fakes: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame | None]:
    """(request_id, body) -> bodies with rewritten, changed, has_pii, blocked, entities and tool_arguments, and the mapping table.

    everything: all strings of a document count, keys never; else those that a chat body holds as text. A body that isn't
    JSON is a text. Values under the keys in `preserve` stay. gate_only looks and rewrites nothing; without include_values
    entities carry no values. block_types: what a gate stops, any type when empty. Bodies are walked once for their texts
    and once to write them back. Bodies with one request id, or without any, share that request's numbers.
    """
    from spanveil.operators.detect import add_entities
    from spanveil.operators.replace import prepared, replace_prepared

    rows = numbered(bodies)
    texts = prepared(add_entities(explode_texts(rows, everything, preserve), "text", **options))
    value = (lambda e: e["value"]) if include_values else (lambda e: F.lit(None).cast("string"))
    seen = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), value(e).alias("value"), F.col("path").alias("path"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", seen.alias("e")))), lambda x: x["e"]))
    found = texts.groupBy(ROW).agg(listed.alias("entities"), F.count_distinct("call").alias("tool_arguments"))
    if gate_only:
        out, mapping = rows.withColumn("rewritten", F.col("body")).withColumn("changed", F.lit(False)), None
    else:
        replaced, mapping = replace_prepared(texts, strategy, overrides, fakes)
        out = collect_texts(rows, replaced, everything=everything, skip=preserve)
    out = out.join(found, ROW, "left").drop(ROW).withColumn("entities", F.coalesce("entities", F.expr(f"cast(array() as {SEEN})"))).withColumn("tool_arguments", F.coalesce("tool_arguments", F.lit(0)).cast("long"))
    return out.withColumn("has_pii", F.size("entities") > 0).withColumn("blocked", blocked(F.col("entities"), block_types)), mapping


def restore_bodies(bodies: DataFrame, mapping: DataFrame, everything: bool = True) -> DataFrame:
    """(request_id, body) with restored: every string of a document restored from its request's mapping, keys never."""
    from spanveil.operators.replace import restore

    rows = numbered(bodies)
    texts = explode_texts(rows, everything)
    back = restore(texts.select(ROW, "request_id", "seq", "text", START, STOP), mapping)
    return collect_texts(rows, back, "restored", everything).withColumn("restored", F.col("rewritten")).drop("rewritten", "changed", ROW)


def scan_tool_params(calls: DataFrame, strategy: str = "placeholder", tool: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(request_id, body) of tool inputs -> with rewritten, has_pii and recommendation (redact, or proceed), and the mapping.

    Given the column of the tool's name, the paths of tools that work on files stay as they are.
    """
    from functools import reduce

    if tool is None:
        out, mapping = redact(calls, strategy, **options)
    else:
        files = F.lower(F.coalesce(F.col(tool), F.lit(""))).isin(*FILE_TOOLS)
        both = [redact(calls.where(files), strategy, preserve=PRESERVED, **options), redact(calls.where(~files), strategy, **options)]
        out, mapping = (reduce(DataFrame.unionByName, x) for x in zip(*both, strict=True))
    return out.withColumn("has_pii", F.col("changed")).withColumn("recommendation", F.when(F.col("changed"), "redact").otherwise("proceed")), mapping


@F.pandas_udf(T.BooleanType())
def json_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts are the same JSON value: order of keys and writing of numbers aside; false where one isn't JSON."""

    def one(x: str | None, y: str | None) -> bool:
        try:
            return x is not None and y is not None and same(x, y)
        except ValueError:
            return False

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])
