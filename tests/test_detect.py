import re
import time

import pytest
from pyspark.sql import functions as F

from spanveil.functions import fixed
from spanveil.operators import shapes
from spanveil.operators.detect import RULES, add_entities, detect, detect_with_dictionary
from spanveil.operators.spans import ENTITY, byte_slice

CASES = [
    ("我叫张三，手机13800138000，身份证11010519491231002X，邮箱 zhangsan@example.com，服务器 192.168.1.100，生日 1990-01-01", {("zh_person_name", "张三"), ("zh_phone", "13800138000"), ("zh_id_card", "11010519491231002X"), ("email", "zhangsan@example.com"), ("ip_address", "192.168.1.100"), ("date", "1990-01-01")}),
    ("身份证11010519491231002X，另一个110105194912310021", {("zh_id_card", "11010519491231002X")}),
    ("订单编号是12345678901234567890", set()),
    ("员工张三的身份证", {("zh_person_name", "张三")}),
    ("Visit https://example.com/a?b=1. Or bare example.org", {("url", "https://example.com/a?b=1")}),
    ("000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-6789", {("us_ssn", "123-45-6789")}),
    ("amex 378282246310005 bad 4111111111111112", {("credit_card", "378282246310005")}),
    ("password: mytoken123 api-key=abcdefgh12", {("token", "mytoken123"), ("password", "abcdefgh12")}),
    ("License plate: ABC-1234, plate ABC-9999", {("plate", "ABC-1234")}),
    ("1234.5.6.7.8", set()),
    ("2024-09-17 and 2024年12月31日", {("date", "2024-09-17"), ("date", "2024年12月31日")}),
    ("été_token=x12345678 étoken=abcdefgh1", {("token", "abcdefgh1")}),
    ("138-0013-8000 或 １３８００１３８０００ 或 +86 186 1234 5678 或 138.0013.8000", {("zh_phone", "138-0013-8000"), ("zh_phone", "１３８００１３８０００"), ("zh_phone", "+86 186 1234 5678"), ("zh_phone", "138.0013.8000")}),
    ("4111-1111 1111 1111", set()),
    ("4111 1111 1111 1111", {("credit_card", "4111 1111 1111 1111")}),
    ("", set()),
    (None, set()),
]


def test_entities_and_their_slices(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    found = add_entities(rows).select("id", F.explode("entities").alias("e"), "text").select("id", "e.type", "e.value", byte_slice(F.col("text"), F.col("e.start"), F.col("e.end")).alias("cut")).collect()
    assert all(r.value == r.cut for r in found)
    for i, (_, want) in enumerate(CASES):
        assert {(r.type, r.value) for r in found if r.id == i} == want, CASES[i][0]


def test_longer_entity_wins_over_a_dictionary_hit(spark):
    row = spark.createDataFrame([("mail BOB@x.com or bob",)], "text string").select(detect_with_dictionary(F.col("text"), {"bob": "zh_person_name", "bob@x": "plate"}, rules=["email"]).alias("e")).head()
    assert [(e.type, e.value) for e in row.e] == [("email", "BOB@x.com"), ("zh_person_name", "bob")]


@pytest.mark.parametrize("text", ["a１２-3４", "12–34　56", "+86 138-0013 8000", "１－２", "no digits", "9 · 9"])
def test_normalised_places_map_back(text):
    plain, at = shapes.normalise(text)
    assert len(plain) + 1 == len(at) and at == sorted(at)
    for i in range(len(plain)):
        assert shapes.normalise(text[at[i] : at[i] + 1])[0] == plain[i]


def test_schema_is_the_entity(spark):
    df = spark.createDataFrame([("x",)], "text string").select(detect(F.col("text")).alias("e"))
    assert df.dtypes == [("e", f"array<{ENTITY}>")]


def test_long_runs_and_marks_are_looked_at_once(spark):
    texts = ["a@b.com_x@y.org,a@b.c@d.net", "￿é u@x.org￿10.0.0.1 ￿", "x@y.org" * 3, "é a.b+c@d-e.co1m@z.de", "", "none"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: [(e.value, e.start, e.end) for e in r.e] for r in rows.select("id", RULES["email"](F.col("t")).alias("e")).collect()}
    assert got == {i: [(m.group(), len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(fixed.EMAIL, t)] for i, t in enumerate(texts)}
    began = time.time()
    long = rows.limit(1).select(F.concat(F.repeat(F.lit("a"), 300_000), F.lit(" @ u@x.org")).alias("t"))
    assert [e.value for e in long.select(RULES["email"](F.col("t")).alias("e")).first().e] == ["u@x.org"]
    assert time.time() - began < 20
