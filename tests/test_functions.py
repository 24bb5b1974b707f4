import pytest
from pyspark.sql import functions as F

from whisperlake import functions as fn


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n", [0, 1, 2, 2**31, 2**63 - 1, 2**63, 2**64 - 1, 0x8081828384858687])
def test_le_bytes(spark, n):
    raw = n.to_bytes(8, "little")
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    assert int(df.select(fn.le_bytes_to_u64("b")).first()[0]) == n
    back = df.select(fn.u64_to_le_bytes(fn.le_bytes_to_u64("b"))).first()[0]
    assert bytes(back) == raw


def test_null_bytes_stay_null(spark):
    assert spark.createDataFrame([(None,)], "b binary").select(fn.le_bytes_to_u64("b")).first()[0] is None


def test_scid(spark):
    assert one(spark, fn.scid_format("s"), s=1028579933714841601) == "935488x1067x1"
    assert one(spark, fn.scid_parse("t"), t="935488x1067x1") == 1028579933714841601
    for bad in ("", "1x2", "axbxc", "1x99999999x1", "1x2x70000"):
        assert one(spark, fn.scid_parse("t"), t=bad) is None


def test_types(spark):
    assert [one(spark, fn.type_code("t"), t=t) for t in ("ca", "na", "cu", "ping", "pong", "x")] == [1, 2, 3, 4, 5, None]
    assert one(spark, fn.type_name("t", "other", (1, 2, 3)), t=4) == "other"
    with pytest.raises(Exception, match="unknown message type"):
        one(spark, fn.type_code("t", strict=True), t="x")


@pytest.mark.parametrize(
    ("address", "clear", "reach"),
    [("[::1]:9735", True, False), ("1.2.3.4:9735", True, True), ("100.64.0.1:1", True, False), ("240.0.0.1:1", True, False), ("192.0.2.1:1", True, False), ("10.0.0.1", True, False),
     ("172.16.0.1", True, False), ("[2001:db8::5]:9735", True, True), ("[fd00::1]:1", True, False), ("a" * 56 + ".onion:9735", False, True), ("abc.onion:1", False, False), ("node.example.com:9735", False, True), ("256.1.1.1", False, True), ("", False, None)],
)
def test_addresses(spark, address, clear, reach):
    assert one(spark, fn.is_clearnet("a"), a=address) is clear
    assert one(spark, fn.ip_reachability("a"), a=address) is reach


def test_net_type(spark):
    assert [one(spark, fn.net_type("s"), s=s) for s in ("1.2.3.4:1", "x.onion:1", "1.2.3.4:1,x.onion:1", "junk", "")] == ["clearnet", "tor", "both", "none", "none"]


def test_explode_sockets_policies(spark):
    df = spark.createDataFrame([("a", "1.2.3.4:1,junk"), ("b", ""), ("c", None)], "pubkey string, sockets string")
    assert {(r.address, r.valid) for r in fn.explode_sockets(df).collect()} == {("1.2.3.4:1", True), ("junk", False)}
    assert {(r.address, r.valid) for r in fn.explode_sockets(df, whole_record=True).collect()} == {("1.2.3.4:1", False), ("junk", False)}


def test_small_ones(spark):
    assert fn.parse_time_window("90m") == "90 minutes" and fn.parse_time_window("3d") == "4320 minutes"
    for bad in ("0h", "4d", "x", "5w"):
        with pytest.raises(ValueError):
            fn.parse_time_window(bad)
    assert one(spark, fn.recency_bin("a"), a=3600) == "hour" and one(spark, fn.recency_bin("a"), a=336 * 86400 + 1) == "other"
    assert one(spark, fn.alias_clean("a"), a="node.com") == "node" and one(spark, fn.alias_clean("a"), a="LNT123") == "LNT123" and one(spark, fn.alias_clean("a"), a="LNT.123") == ""
    assert one(spark, fn.parse_peer_specifier("a"), a="key@h:1@2").address == "h:1@2"
    df = spark.createDataFrame([(["x.onion:1", "1.2.3.4:1", "x.onion:1"],)], "a array<string>")
    assert df.select(fn.endpoint_preference("a")).first()[0] == ["1.2.3.4:1", "x.onion:1"]
