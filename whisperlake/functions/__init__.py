"""Column functions: identifiers, times, addresses and message types."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def le_bytes_to_u64(c: Column | str) -> Column:
    """8 little-endian bytes as DECIMAL(20,0); null stays null."""
    swapped = F.regexp_replace(F.lpad(F.hex(c), 16, "0"), "(..)" * 8, "$8$7$6$5$4$3$2$1")
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def u64_to_le_bytes(c: Column | str) -> Column:
    """An unsigned number (up to 2**64 - 1, as decimal, or as the bits of a long) as 8 little-endian bytes."""
    text = F.conv(_col(c).cast("decimal(20,0)").cast("string"), 10, 16)
    return F.unhex(F.regexp_replace(F.lpad(text, 16, "0"), "(..)" * 8, "$8$7$6$5$4$3$2$1"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scid_block(c: Column | str) -> Column:
    return F.shiftrightunsigned(c, 40)


def scid_tx(c: Column | str) -> Column:
    return F.shiftrightunsigned(c, 16).bitwiseAND(F.lit(0xFFFFFF))


def scid_out(c: Column | str) -> Column:
    return _col(c).bitwiseAND(F.lit(0xFFFF))


def scid_format(c: Column | str) -> Column:
    """block x transaction x output."""
    return F.when(_col(c).isNotNull(), F.concat_ws("x", *(f(c).cast("string") for f in (scid_block, scid_tx, scid_out))))


def scid_parse(c: Column | str) -> Column:
    """Inverse of scid_format, a block from 2**23 on as the bits of a negative long; null where the text has another shape or a part is out of range."""
    p = F.split(c, "x")
    block, tx, out = (F.try_element_at(p, F.lit(k)).try_cast("long") for k in (1, 2, 3))
    fine = F.regexp_like(_col(c), F.lit("^[0-9]+x[0-9]+x[0-9]+$")) & (block < 1 << 24) & (tx < 1 << 24) & (out < 1 << 16)
    return F.when(fine, F.shiftleft(block, 40) + F.shiftleft(tx, 16) + out)


#: Message types on the wire.
TYPE_CODES = {"ca": 1, "na": 2, "cu": 3, "ping": 4, "pong": 5}
TYPE_NAMES = {1: "channel_announcement", 2: "node_announcement", 3: "channel_update", 4: "ping", 5: "pong"}


def type_code(c: Column | str, strict: bool = False) -> Column:
    out = F.lit(None).cast("int")
    for word, code in TYPE_CODES.items():
        out = F.when(_col(c) == word, F.lit(code)).otherwise(out)
    return F.coalesce(out, F.raise_error(F.lit("unknown message type")).cast("int")) if strict else out


def type_name(c: Column | str, otherwise: str | None = None, known: tuple[int, ...] = (1, 2, 3, 4, 5)) -> Column:
    out = F.lit(otherwise).cast("string")
    for code in known:
        out = F.when(_col(c) == code, F.lit(TYPE_NAMES[code])).otherwise(out)
    return out


def message_hash(*c: Column | str) -> Column:
    """A 64-bit key of the columns; it serves equality only."""
    return F.xxhash64(*c)


def micros_to_ts(c: Column | str, strict: bool = False) -> Column:
    n = _col(c).try_cast("long")
    if strict:
        n = F.coalesce(n, F.raise_error(F.lit("bad timestamp")).cast("long"))
    return F.timestamp_micros(n)


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def time_bucket(width: str, c: Column | str = "net_timestamp") -> Column:
    return F.window(c, width).start


def epoch_diff(later: Column | str, earlier: Column | str) -> Column:
    """Seconds between two timestamps, as DOUBLE."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def parse_time_window(text: str, most_hours: int = 72) -> str:
    """``<n>m``, ``<n>h`` or ``<n>d`` as an interval string; over 0 and up to ``most_hours``."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([mhd])\s*", text)
    if not m:
        raise ValueError(f"not a time window: {text!r}")
    minutes = int(m[1]) * {"m": 1, "h": 60, "d": 1440}[m[2]]
    if not 0 < minutes <= 60 * most_hours:
        raise ValueError(f"a window is over 0 and up to {most_hours} h: {text!r}")
    return f"{minutes} minutes"


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_H = "[0-9a-fA-F]{1,4}"
IPV6 = "^(?:" + "|".join([
    rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:", *(rf"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)), rf":(?:(?::{_H}){{1,7}}|:)",
]) + ")$"


def host_of(address: Column | str) -> Column:
    """An address without its port: [v6]:port, host:port, or as it is."""
    a = F.trim(_col(address))
    bare = F.regexp_extract(a, r"^([^:]+):[0-9]+$", 1)
    return F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).when(bare != "", bare).otherwise(a)


def is_clearnet(address: Column | str) -> Column:
    h = host_of(address)
    return F.coalesce(F.regexp_like(h, F.lit(IPV4)) | F.regexp_like(h, F.lit(IPV6)), F.lit(False))


def is_tor(address: Column | str) -> Column:
    return F.coalesce(F.contains(_col(address), F.lit("onion")), F.lit(False))


def net_type(sockets: Column | str) -> Column:
    """none, clearnet, tor or both, of a comma-separated list."""
    parts = F.split(F.coalesce(_col(sockets), F.lit("")), ",")
    clear, tor = F.exists(parts, lambda a: is_clearnet(a)), F.exists(parts, lambda a: is_tor(a))
    return F.when(clear & tor, "both").when(clear, "clearnet").when(tor, "tor").otherwise("none")


def ip_reachability(address: Column | str) -> Column:
    """Could a stranger reach the address: public IPs, v3 onions and host names; null for an empty address."""
    h = F.lower(host_of(address))
    o = [F.try_element_at(F.split(h, r"\."), F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    barred4 = (
        (h == "0.0.0.0") | (o[0] == 10) | (o[0] == 127) | (o[0] >= 240) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168))
        | ((o[0] == 100) & o[1].between(64, 127)) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 192) & (o[1] == 0) & (o[2] == 2))
        | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100)) | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
    )
    barred6 = h.isin("::", "::1", "0:0:0:0:0:0:0:0", "0:0:0:0:0:0:0:1") | F.regexp_like(h, F.lit("^(f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):"))
    return (
        F.when(h == "", None).when(F.regexp_like(h, F.lit(IPV4)), ~F.coalesce(barred4, F.lit(False))).when(F.regexp_like(h, F.lit(IPV6)), ~barred6)
        .when(h.endswith(".onion"), F.length(h) == 62).otherwise(True)
    )


def parse_peer_specifier(c: Column | str) -> Column:
    p = F.split(c, "@", 2)
    return F.struct(F.try_element_at(p, F.lit(1)).alias("pubkey"), F.try_element_at(p, F.lit(2)).alias("address"))


def explode_sockets(nodes: DataFrame, whole_record: bool = False) -> DataFrame:
    """(pubkey, address, valid) for each address of ``sockets``; with ``whole_record`` one bad address makes all bad."""
    each = nodes.select("pubkey", F.filter(F.transform(F.split(F.coalesce("sockets", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "").alias("list"))
    good = lambda a: is_clearnet(a) | is_tor(a)
    every = F.forall("list", good)
    return each.select("pubkey", F.explode("list").alias("address"), every.alias("all_valid")).select("pubkey", "address", (F.col("all_valid") if whole_record else good(F.col("address"))).alias("valid"))


#: What marks an address as one of its own host, and as an onion service with a port.
LOCALHOST = ("127.0.0.1", "localhost", "0.0.0.0", "[::]")
ONION = ".onion:"


def address_class(address: Column | str) -> Column:
    a = _col(address)
    local = reduce(Column.__or__, [F.contains(a, F.lit(x)) for x in LOCALHOST])
    return F.when(local, "localhost").when(F.contains(a, F.lit(ONION)), "onion").otherwise("remainder")


#: Upper edges of the age classes, in seconds.
RECENCY = {"hour": 3600, "day": 86400, "week": 7 * 86400, "two_weeks": 14 * 86400, "month": 28 * 86400, "three_months": 84 * 86400, "six_months": 168 * 86400, "year": 336 * 86400}


def recency_bin(age_seconds: Column | str) -> Column:
    out = F.lit("other")
    for name, edge in reversed(RECENCY.items()):
        out = F.when(_col(age_seconds) <= edge, name).otherwise(out)
    return out


#: The suffixes that are cut from an alias.
SUFFIXES = ("com", "org", "net", "io", "de", "xyz", "co", "biz", "uk", "us", "ca", "jp", "cz", "network", "me")


def alias_clean(c: Column | str) -> Column:
    """Without one trailing domain suffix; then names that begin with LNT and a dot become empty."""
    return F.regexp_replace(F.regexp_replace(c, rf"\.({'|'.join(SUFFIXES)})$", ""), r"^LNT\..*$", "")


def age_days(first_seen: Column | str, now: int) -> Column:
    return F.floor((F.lit(now) - _col(first_seen)) / 86400).cast("long")


def address_dedupe(addresses: Column | str) -> Column:
    """Each address once, in the order of first sight."""
    return F.array_distinct(_col(addresses))


def endpoint_preference(addresses: Column | str) -> Column:
    """Clearnet before tor, each in the given order."""
    a = address_dedupe(addresses)
    return F.concat(F.filter(a, lambda x: ~is_tor(x)), F.filter(a, lambda x: is_tor(x)))


def has_sockets(c: Column | str) -> Column:
    return F.coalesce(_col(c) != "", F.lit(False))


def has_balance(balances: Column | str) -> Column:
    return F.coalesce(F.size(balances) > 0, F.lit(False))


def text_of(ts: Column | str) -> Column:
    """A timestamp as text, to the second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
