"""Checks and small functions on columns of strings; built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions import fixed


def digits_only(v: Column) -> Column:
    return v.rlike("^[0-9]+$")


def valid_phone(v: Column) -> Column:
    """Eleven digits with a known prefix."""
    return v.rlike("^1[0-9]{10}$") & F.substring(v, 1, 3).isin(*fixed.PHONE_PREFIXES)


def id_checksum(body: Column) -> Column:
    """Check character of 17 digits; empty for anything else."""
    total = F.lit(0)
    for i, w in enumerate(fixed.ID_WEIGHTS):
        total = total + F.substring(body, i + 1, 1).try_cast("int") * w
    return F.when(body.rlike("^[0-9]{17}$"), F.substring(F.lit(fixed.ID_CHECKS), total % 11 + 1, 1)).otherwise(F.lit(""))


def valid_id_card(v: Column) -> Column:
    long = v.rlike("^[0-9]{17}[0-9A-Za-z]$") & (F.upper(F.substring(v, 18, 1)) == id_checksum(F.substring(v, 1, 17)))
    return v.rlike("^[0-9]{15}$") | long


def luhn_valid(v: Column) -> Column:
    return v.rlike("^[0-9]+$") & F.call_function("luhn_check", v)


def luhn_check_digit(body: Column) -> Column:
    """The digit that makes body valid when put after it."""
    back = F.split(F.reverse(body), "")
    each = F.transform(back, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return ((10 - F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10) % 10).cast("string")


def valid_bank_card(v: Column) -> Column:
    return F.length(v).between(16, 19) & luhn_valid(v) & ~((F.length(v) == 18) & valid_id_card(v))


def valid_card(v: Column) -> Column:
    return F.length(v).between(13, 19) & luhn_valid(v)


def international_card(v: Column) -> Column:
    """By issuer prefix; other cards are bank cards."""
    two, three, four = (F.substring(v, 1, k) for k in (2, 3, 4))
    issued = two.isin("34", "37", "65", "36", "38") | v.startswith("4") | two.between("51", "55") | four.between("2221", "2720") | (four == "6011") | three.between("644", "649") | four.between("3528", "3589") | three.between("300", "305")
    return F.length(v).between(13, 19) & issued


def card_type(v: Column) -> Column:
    """credit_card or zh_bank_card; null where the check digit fails."""
    return F.when(valid_card(v), F.when(international_card(v), F.lit("credit_card")).otherwise(F.lit("zh_bank_card")))


def valid_ssn(v: Column) -> Column:
    area, group, serial = F.substring(v, 1, 3), F.substring(v, 5, 2), F.substring(v, 8, 4)
    return v.rlike(f"^{fixed.SSN}$") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


def valid_url(v: Column) -> Column:
    return F.octet_length(v).between(8, 2048) & v.rlike(r"^(?:https?|ftp)://[^/?#]")


def fold_ascii(v: Column) -> Column:
    """A-Z to a-z and nothing else, so that lengths and offsets stay."""
    return F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_width(v: Column) -> Column:
    """Full-width ASCII variants and the ideographic blank to their ASCII forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    return F.translate(v, wide, plain)


def strip_phone(v: Column) -> Column:
    return F.translate(fold_width(v), "+-_. ", "")


def valid_country_phone(v: Column) -> Column:
    return valid_phone(F.regexp_replace(F.regexp_replace(strip_phone(v), "^0086", ""), "^86", ""))


def text_hash(v: Column) -> Column:
    return F.sha2(v.cast("binary"), 256)


def outcome(status: Column) -> Column:
    """success for 2xx, error from 500 on, else blocked."""
    return F.when(status.between(200, 299), "success").when(status >= 500, "error").otherwise("blocked")


def valid_request_id(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^[A-Za-z0-9_-]{8,64}$"), F.lit(False))


def valid_conversation_id(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def host_of(target: Column) -> Column:
    """Host of a URL or host/path, without user, port and path, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(target, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/?#].*$", ""), r"^[^@]*@|:[0-9]+$", ""))


def host_matches(target: Column, pattern: str) -> Column:
    """Equal hosts; a pattern that begins with a dot matches every host that ends in it."""
    host = host_of(target)
    return host.endswith(pattern.lower()) | (host == pattern.lower().lstrip(".")) if pattern.startswith(".") else host == pattern.lower()


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def percentile_at(values: Column, q: float) -> Column:
    """values: an array; its sorted element at int(q (n - 1))."""
    return F.element_at(F.array_sort(values), F.floor(F.lit(q) * (F.size(values) - 1)).cast("int") + 1)


# Error codes by status; all others are 500.
STATUS = {400: ["invalid_request", "invalid_config"], 401: ["unauthorized"], 404: ["not_found"], 502: ["detector_timeout", "circuit_open", "upstream_error"]}
LOG_BYTES, CUT = 4096, "...[truncated]"


def status_of(code: Column) -> Column:
    """The status of an error code."""
    out = F.lit(500)
    for status, codes in STATUS.items():
        out = F.when(code.isin(*codes), status).otherwise(out)
    return out


def log_text(text: Column, with_values: bool = False) -> Column:
    """A text for the log: cut after some bytes, with a sign that says so; whole where values may be logged."""
    cut = F.concat(F.decode(F.substring(text.cast("binary"), 1, LOG_BYTES), "UTF-8"), F.lit(CUT))
    return text if with_values else F.when(F.octet_length(text) > LOG_BYTES, cut).otherwise(text)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest beginning of whole characters within so many bytes."""
    raw = F.substring(text.cast("binary"), 1, most)
    return F.when(F.octet_length(text) > most, F.regexp_replace(F.decode(raw, "UTF-8"), "\uFFFD+$", "")).otherwise(text)


def local_endpoint(url: str) -> bool:
    """Whether a backend's address is on this machine or a private network: localhost or a literal address, no other name."""
    import ipaddress
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        parts.port  # noqa: B018  a bad port is an error
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host:
        return False
    if host.lower() == "localhost" or host.lower().endswith(".localhost"):
        return True
    try:
        at = ipaddress.ip_address(host.partition("%")[0])
    except ValueError:
        return False
    at = getattr(at, "ipv4_mapped", None) or at
    private = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7")]
    return at.is_loopback or at.is_link_local or at.is_unspecified or any(at.version == n.version and at in n for n in private)
