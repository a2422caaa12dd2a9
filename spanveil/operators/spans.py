"""Arrays of entities: finding all matches with byte offsets, resolving overlaps, sanitising, merging.

An entity is struct<type string, value string, start int, end int, score double>; offsets are UTF-8 bytes, half open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "struct<type:string,value:string,start:int,end:int,score:double>"
NONE = f"cast(array() as array<{ENTITY}>)"


def entity(kind: Column, value: Column, start: Column, end: Column, score: Column) -> Column:
    return F.struct(kind.cast("string").alias("type"), value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"))


BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside functions over arrays an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], emitted: str) -> Column:
    """A left fold that emits: step(state, item) -> (state, array of what it emits); struct of the last state and all that was emitted, out.

    Items are folded in blocks, so that arrays that grow are copied once a block and not once an item.
    """
    none = F.expr(f"cast(array() as array<{emitted}>)")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def over(all_items: Column) -> Column:
        def block(acc: Column, n: Column) -> Column:
            start = F.struct(acc["state"].alias("state"), none.alias("out"))
            return F.aggregate(F.slice(all_items, n * BLOCK + 1, BLOCK), start, one, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        blocks = F.when(F.size(all_items) > 0, F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
        begin = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{emitted}>>)").alias("out"))
        return F.aggregate(blocks, begin, block, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))

    return let(items, over)


MARK = "\uffff"  # no character: hardly any text holds it
MATCH = "struct<value:string,start:int,end:int,before:string,after:string>"


def matches(text: Column, pattern: str) -> Column:
    """All non-overlapping matches, as struct<value, start, end, before, after>: before and after are the neighbours."""
    # One pass puts marks around the matches, and the text falls apart at them; a text with a mark of its own takes two.
    plain = F.contains(text, F.lit(MARK))
    parts = F.when(~plain, F.split(F.regexp_replace(text, f"(?:{pattern})", f"{MARK}$0{MARK}"), MARK, -1))
    marked = let(parts, lambda p: F.struct(F.filter(p, lambda _, i: i % 2 == 1).alias("values"), F.filter(p, lambda _, i: i % 2 == 0).alias("gaps")))
    cut = F.when(plain, F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("values"), F.split(text, f"(?:{pattern})", -1).alias("gaps"))).otherwise(marked)
    numbered = let(cut, lambda c: F.transform(c["values"], lambda v, i: F.struct(v.alias("v"), F.get(c["gaps"], i).alias("gap"), F.get(c["gaps"], i + 1).alias("next"), F.get(c["values"], i + 1).alias("then"))))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        start = acc["at"] + F.octet_length(x["gap"])
        end = start + F.octet_length(x["v"])
        before = F.right(F.when(x["gap"] == "", acc["last"]).otherwise(x["gap"]), F.lit(1))
        after = F.left(F.when(x["next"] == "", F.coalesce(x["then"], F.lit(""))).otherwise(x["next"]), F.lit(1))
        one = F.struct(x["v"].alias("value"), start.alias("start"), end.alias("end"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), x["v"].alias("last")), F.array(one)

    return fold(numbered, F.struct(F.lit(0).alias("at"), F.lit("").alias("last")), step, MATCH)["out"]


def found(text: Column, pattern: str, to_entity: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None, hint: str | Column = "") -> Column:
    """Entities of a rule; texts without the hint, which every match holds (or a plain test that it passes), cost less than a search."""
    hits = matches(text, pattern)
    hits = F.filter(hits, keep) if keep else hits
    return F.when(worth(text, hint), F.transform(hits, to_entity)).otherwise(F.expr(NONE))


def worth(text: Column, hint: str | Column) -> Column:
    if isinstance(hint, str):
        return F.contains(text, F.lit(hint)) if hint else text.isNotNull()
    return hint


def resolve(entities: Column, thresholds: Column | None = None, default: float = 0.5, allowed: list[str] | None = None) -> Column:
    """Filter by type and score, sort by start and end, and of overlapping neighbours keep the one with the higher score."""

    def passes(e: Column) -> Column:
        floor = F.coalesce(F.element_at(thresholds, e["type"]), F.lit(default)) if thresholds is not None else F.lit(default)
        ok = e["score"] >= floor
        return ok & e["type"].isin(*allowed) if allowed is not None else ok

    order = F.array_sort(F.filter(entities, passes), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"]))

    def step(last: Column, e: Column) -> tuple[Column, Column]:
        # The last entity is held back: a better one may still take its place.
        clash = last.isNotNull() & (e["start"] < last["end"])
        better = e["score"] > last["score"]
        return F.when(clash & ~better, last).otherwise(e), F.when(clash | last.isNull(), F.expr(NONE)).otherwise(F.array(last))

    return let(fold(order, F.expr(f"cast(null as {ENTITY})"), step, ENTITY), lambda d: F.concat(d["out"], F.when(d["state"].isNull(), F.expr(NONE)).otherwise(F.array(d["state"]))))


def first_wins(entities: Column) -> Column:
    """Sort by start, longer first, earlier in the array first; keep what doesn't overlap the kept one before."""
    ranked = F.transform(entities, lambda e, i: F.struct(e["start"].alias("start"), (-e["end"]).alias("shorter"), i.alias("place"), e.alias("e")))
    order = F.transform(F.array_sort(ranked), lambda x: x["e"])

    def step(stop: Column, e: Column) -> tuple[Column, Column]:
        free = e["start"] >= stop
        return F.when(free, e["end"]).otherwise(stop), F.when(free, F.array(e)).otherwise(F.expr(NONE))

    return fold(order, F.lit(-2147483648), step, ENTITY)["out"]


def sanitize(entities: Column, text: Column) -> Column:
    """Without entities that lie outside the text; then first_wins."""
    size = F.octet_length(text)
    return first_wins(F.filter(entities, lambda e: (e["start"] >= 0) & (e["end"] <= size) & (e["start"] < e["end"])))


def merge(hits: Column, entities: Column) -> Column:
    """Dictionary hits and found entities; hits come first where both begin and end alike."""
    return first_wins(F.concat(hits, entities))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets."""
    return F.decode(F.substring(text.cast("binary"), start + 1, end - start), "UTF-8")
