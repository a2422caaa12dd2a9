"""Numbers written with separators, full width or a country code: a second look at runs of digits only.

Only texts with such a run reach the Arrow function; what it adds never overlaps what was found in the text as it is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.functions import fixed
from spanveil.operators.spans import ENTITY

_SEPARATED = fixed.SEPARATORS + "－＿　"
_DIGIT = "0-9０-９"
_RUN = re.compile(f"(?:[+＋](?=[{_DIGIT}]))?[{_DIGIT}](?:[{re.escape(_SEPARATED)}.．]*[{_DIGIT}])*")
_INNER = re.compile(f"(?<=[{_DIGIT}])[{re.escape(_SEPARATED)}](?=[{_DIGIT}])")
_WIDE = re.compile("[！-～　]")
_DOTTED = re.compile(r"1[0-9]{2}\.[0-9]{4}\.[0-9]{4}")
_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
#: A text without this has no such run (as a Java pattern).
GUARD = f"[+０-９．＋]|[0-9][{re.escape(_SEPARATED)}][0-9０-９]|1[0-9]{{2}}\\.[0-9]{{4}}\\.[0-9]{{4}}"

_ENTITY_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def luhn(v: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(v))))
    return total % 10 == 0


def phone(v: str) -> bool:
    return len(v) == 11 and v.isascii() and v.isdigit() and v[:3] in fixed.PHONE_PREFIXES


def id_card(v: str) -> bool:
    if len(v) == 15:
        return v.isdigit()
    return v[:17].isdigit() and fixed.ID_CHECKS[sum(int(c) * w for c, w in zip(v[:17], fixed.ID_WEIGHTS, strict=True)) % 11] == v[17].upper()


def international(v: str) -> bool:
    return v[0] == "4" or v[:2] in ("34", "37", "65", "36", "38") or "51" <= v[:2] <= "55" or "2221" <= v[:4] <= "2720" or v[:4] == "6011" or "644" <= v[:3] <= "649" or "3528" <= v[:4] <= "3589" or "300" <= v[:3] <= "305"


def bare(v: str) -> str:
    return re.sub(r"^86", "", re.sub(r"^0086", "", v.translate(_FOLD).translate({ord(c): None for c in "+-_. "})))


_RULES = [
    (re.compile(fixed.ID_18), 0.95, "Xx0123456789", lambda v: "zh_id_card" if id_card(v) else None),
    (re.compile(fixed.ID_15), 0.85, "Xx0123456789", lambda v: "zh_id_card" if id_card(v) else None),
    (re.compile(fixed.PHONE), 0.95, "0123456789", lambda v: "zh_phone" if phone(v) else None),
    (re.compile(fixed.CARD), 0.9, "0123456789", lambda v: ("credit_card" if international(v) else "zh_bank_card") if luhn(v) else None),
    (re.compile(fixed.PHONE_DOTTED), 0.9, "0123456789", lambda v: "zh_phone" if phone(v.replace(".", "")) else None),
    (re.compile(fixed.PHONE_COUNTRY), 0.9, "0123456789", lambda v: "zh_phone" if phone(bare(v)) else None),
]


def normalise(text: str) -> tuple[str, list[int]]:
    """text without separators between digits and in half width, and the place in text of each character and the end."""
    drop = {m.start() for m in _INNER.finditer(text)}
    kept = [i for i in range(len(text)) if i not in drop]
    return "".join(text[i] for i in kept).translate(_FOLD), [*kept, len(text)]


def look_again(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, str, int, int, float]]:
    """(type, value, first byte, stop byte, score) that the runs of digits of text add to the taken byte spans."""
    out = []
    for run in _RUN.finditer(text):
        w = run[0]
        if not (w[0] in "+＋" or _INNER.search(w) or _WIDE.search(w) or _DOTTED.fullmatch(w)):
            continue
        plain, at = normalise(w)
        base = len(text[: run.start()].encode())
        for pattern, score, edge, kind_of in _RULES:
            for m in pattern.finditer(plain):
                if (m.start() and plain[m.start() - 1] in edge) or (m.end() < len(plain) and plain[m.end()] in edge):
                    continue
                if (kind := kind_of(m[0])) is None:
                    continue
                a, b = at[m.start()], at[m.end() - 1] + 1
                value = w[a:b]
                kinds = {x[0].translate(_FOLD) for x in _INNER.finditer(w) if a <= x.start() < b}
                start = base + len(w[:a].encode())
                end = start + len(value.encode())
                if len(kinds) > 1 or normalise(value)[0] != m[0] or any(s < end and start < e for s, e in taken):
                    continue
                taken.append((start, end))
                out.append((kind, value, start, end, score))
    return out


@F.pandas_udf(T.ArrayType(_ENTITY_TYPE))
def _again(text: pd.Series, found: pd.Series) -> pd.Series:
    def one(t: str | None, spans) -> list[dict]:
        taken = [(x["start"], x["end"]) for x in (spans if spans is not None else ())]
        return [dict(zip(("type", "value", "start", "end", "score"), e, strict=True)) for e in look_again(t or "", taken)]

    return pd.Series([one(t, f) for t, f in zip(text, found, strict=True)])


def add_shaped(rows: DataFrame, text: str, found: str) -> DataFrame:
    """rows with the column `found` extended by the second look.

    The function gets plain columns, blank where the guard says that there is nothing to add, and stands in a projection
    of its own, so that the optimizer neither repeats the rules for it nor builds filters of it.
    """
    worth = F.col(text).rlike(GUARD)
    given = rows.withColumn("__text", F.when(worth, F.col(text))).withColumn("__found", F.when(worth, F.col(found)))
    more = given.withColumn("__more", _again.asNondeterministic()(F.col("__text"), F.col("__found")))
    return more.withColumn(found, F.concat(F.col(found), F.coalesce("__more", F.expr(f"cast(array() as array<{ENTITY}>)")))).drop("__text", "__found", "__more")
