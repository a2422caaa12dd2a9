"""Deterministic fakes that keep the form of what they stand for; built-in expressions on a keyed hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions import fixed
from spanveil.functions import validators as V

# Small public pools that fakes are drawn from.
PROVINCES = "11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65".split()
BINS = "622202 622848 621700 621661 622588 622700 621483 622260".split()
GIVEN = list("伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚桂英华玉兰文志海燕红梅波辉鹏飞琳雪峰婷宇浩凯健俊帆佳欣怡晨阳悦然雨晴子涵思远博文")
MAIL_WORDS = "river stone cloud maple amber cedar lotus pearl olive quartz meadow harbor falcon willow ember lagoon summit canyon orchid breeze".split()
CITIES = {
    "北京市": "北京市", "上海市": "上海市", "天津市": "天津市", "重庆市": "重庆市", "河北省": "石家庄市 唐山市 保定市", "山西省": "太原市 大同市", "吉林省": "长春市 吉林市", "黑龙江省": "哈尔滨市 大庆市", "江苏省": "南京市 苏州市 扬州市", "浙江省": "杭州市 宁波市 金华市",
    "江西省": "南昌市 九江市", "山东省": "济南市 青岛市 威海市", "河南省": "郑州市 洛阳市 开封市", "湖北省": "武汉市 荆州市", "湖南省": "长沙市 岳阳市", "广东省": "广州市 深圳市 中山市", "海南省": "海口市 三亚市", "四川省": "成都市 乐山市", "贵州省": "贵阳市 遵义市", "甘肃省": "兰州市 天水市", "青海省": "西宁市",
}
DISTRICTS = "东城区 西城区 南城区 北城区 新城区 城关区 城中区 高新区 开发区 河东区 河西区 临江区".split()
STREETS = "人民路 中山路 和平路 解放路 建国路 青年路 花园路 学院路 滨河路 迎宾大道 文化大道 工业大道 朝阳街 光明街 胜利街 新华街".split()


def pick(value: Column, kind: str, n: int, size: int | Column, key: str) -> Column:
    """The n-th number below size that the key derives from a value."""
    h = F.sha2(F.concat(F.lit(f"{key}|{kind}|{n}|"), value).cast("binary"), 256)
    number = F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    return F.pmod(number, F.lit(size) if isinstance(size, int) else size)


def choose(value: Column, kind: str, n: int, pool: list[str], key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (pick(value, kind, n, len(pool), key) + 1).cast("int"))


def number(value: Column, kind: str, n: int, digits: int, key: str) -> Column:
    return F.lpad(pick(value, kind, n, 10**digits, key).cast("string"), digits, "0")


def fake_phone(v: Column, key: str) -> Column:
    def draw(n: int) -> Column:
        return F.concat(choose(v, "phone", n, fixed.PHONE_PREFIXES, key), number(v, "phone", n + 1, 8, key))

    return F.when(draw(0) != v, draw(0)).otherwise(draw(2))


def fake_id_card(v: Column, key: str) -> Column:
    body = F.concat(
        choose(v, "id", 0, PROVINCES, key), number(v, "id", 1, 4, key), (pick(v, "id", 2, 70, key) + 1950).cast("string"),
        F.lpad((pick(v, "id", 3, 12, key) + 1).cast("string"), 2, "0"), F.lpad((pick(v, "id", 4, 28, key) + 1).cast("string"), 2, "0"), F.lpad((pick(v, "id", 5, 998, key) + 1).cast("string"), 3, "0"),
    )
    return F.concat(body, V.id_checksum(body))


def fake_bank_card(v: Column, key: str) -> Column:
    n = F.when(F.length(v).between(16, 19), F.length(v)).otherwise(19)
    body = F.left(F.concat(choose(v, "card", 0, BINS, key), number(v, "card", 1, 6, key), number(v, "card", 2, 6, key)), n - 1)
    return F.concat(body, V.luhn_check_digit(body))


def fake_email(v: Column, key: str) -> Column:
    """The domain and the separators of the local part stay."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    parts = F.split(local, r"[._+\-]")
    marks = F.split(local, r"[^._+\-]+", -1)
    pool = F.array(*map(F.lit, MAIL_WORDS))
    words = F.transform(parts, lambda p, i: F.element_at(pool, (F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|mail|"), v, i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(len(MAIL_WORDS))) + 1).cast("int")))
    made = F.array_join(F.transform(words, lambda w, i: F.concat(F.when(i > 0, F.coalesce(F.get(marks, i), F.lit("."))).otherwise(F.lit("")), w)), "")
    return F.concat(made, number(v, "mail", 9, 3, key), F.lit("@"), domain)


def fake_ip(v: Column, key: str) -> Column:
    """Private classes stay; public addresses become public ones outside 10 and 127."""
    o = lambda n: pick(v, "ip", n, 256, key).cast("string")
    first = F.element_at(F.array(*[F.lit(str(x)) for x in range(11, 224) if x not in (127, 169, 172, 192)]), (pick(v, "ip", 7, 213 - 4, key) + 1).cast("int"))
    return (
        F.when(v.startswith("10."), F.concat_ws(".", F.lit("10"), o(1), o(2), o(3)))
        .when(v.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), o(2), o(3)))
        .when(v.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), (pick(v, "ip", 1, 16, key) + 16).cast("string"), o(2), o(3)))
        .otherwise(F.concat_ws(".", first, o(1), o(2), o(3)))
    )


def fake_date(v: Column, key: str) -> Column:
    """Separators, zero padding and a day sign stay."""
    year = (pick(v, "date", 0, 70, key) + 1950).cast("string")
    month, day = pick(v, "date", 1, 12, key) + 1, pick(v, "date", 2, 28, key) + 1
    shape = lambda n, part: F.when(F.length(part) == 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    g = lambda n: F.regexp_extract(v, "^([0-9]{4})([-/.年])([0-9]{1,2})([-/.月])([0-9]{1,2})(日?)$", n)
    return F.concat(year, g(2), shape(month, g(3)), g(4), shape(day, g(5)), g(6))


def fake_name(v: Column, key: str) -> Column:
    """Its length stays, and a double surname stays double; names joined by a dot keep the dot."""
    given = lambda k: choose(v, "name", k, GIVEN, key)
    single = choose(v, "name", 0, list(fixed.SURNAMES[:100]), key)
    double = choose(v, "name", 0, fixed.DOUBLE_SURNAMES, key)
    plain = F.when(F.left(v, F.lit(2)).isin(*fixed.DOUBLE_SURNAMES), F.concat(double, *[F.when(F.length(v) > k, given(k)).otherwise("") for k in (2, 3)])).otherwise(F.concat(single, *[F.when(F.length(v) > k, given(k)).otherwise("") for k in (1, 2, 3)]))
    return F.when(v.contains("·"), F.concat(given(1), given(2), F.lit("·"), given(3), given(4))).otherwise(plain)


def fake_address(v: Column, key: str) -> Column:
    """Province, a city of it, district, street and number."""
    places = [p + c for p, cities in CITIES.items() for c in cities.split()]
    return F.concat(choose(v, "address", 0, places, key), choose(v, "address", 1, DISTRICTS, key), choose(v, "address", 2, STREETS, key), (pick(v, "address", 3, 998, key) + 1).cast("string"), F.lit("号"))


MAKERS = {"zh_phone": fake_phone, "zh_id_card": fake_id_card, "zh_bank_card": fake_bank_card, "email": fake_email, "ip_address": fake_ip, "date": fake_date, "zh_person_name": fake_name, "zh_address": fake_address}


def fake(kind: Column | str, value: Column, key: str, dictionary: Column | None = None, off: list[str] | None = None) -> Column:
    """The fake for a value of a type, null for types that have none; a dictionary's own fake comes first."""
    out = F.lit(None).cast("string")
    if isinstance(kind, str):
        out = MAKERS[kind](value, key) if kind in MAKERS and kind not in (off or []) else out
        kind, off = F.lit(kind), list(MAKERS)
    for k, make in MAKERS.items():
        if k not in (off or []):
            out = F.when(kind == k, make(value, key)).otherwise(out)
    return F.when(~kind.isin(*fixed.IRREVERSIBLE), F.coalesce(dictionary, out) if dictionary is not None else out)


IDENTITY_KEY = "identity-card"


def fakes_of(values: DataFrame, key: str, dictionary: DataFrame | None = None, off: list[str] | None = None) -> DataFrame:
    """(type, value) distinct -> with fake, as replace() takes them: the dictionary's own (type, real, fake), else a made one."""
    rows = values.select("type", "value").distinct()
    own = F.lit(None).cast("string")
    if dictionary is not None:
        rows, own = rows.join(dictionary.select("type", F.col("real").alias("value"), F.col("fake").alias("__own")), ["type", "value"], "left"), F.col("__own")
    return rows.select("type", "value", fake(F.col("type"), F.col("value"), key, own, off).alias("fake")).where("fake is not null")


def expand_identity(card: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(type, real), one value a type, of the person that a deployment belongs to -> (type, real, fake) under a fixed key.

    The fakes are the same in every run; the dictionary's entries win, and values without a maker are left out.
    """
    own = dictionary if dictionary is not None else card.select("type", "real", F.lit(None).cast("string").alias("fake")).limit(0)
    made = fakes_of(card.select("type", F.col("real").alias("value")).where("real is not null and trim(real) <> ''"), IDENTITY_KEY).select("type", F.col("value").alias("real"), "fake")
    return own.select("type", "real", "fake").unionByName(made.join(own.select("type", "real"), ["type", "real"], "left_anti"))
