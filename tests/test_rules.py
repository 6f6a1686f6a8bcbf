"""Truth tables of the rule language, in columns and in single values."""

import itertools
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import match, net, text
from wardline.operators import machine
from wardline.operators.assets import INLINE, Assets, asset_table, lookup, validate_assets
from wardline.plans.directives import Directive, Rule, correlation_key, fan_out, keep_valid, pinned, rule_matches, unpinned, validate
from wardline.plans.sample import ASSETS

CSV = [
    ("1000, 1001", "1231", False), ("!1231, 1001", "1231", False), ("1000, !1231", "1231", False), ("1231, !1231", "1231", True), ("!1231, 1231", "1231", False),
    ("!1000, !1001", "1231", True), ("!1000, 1001", "1231", True), ("1001, !1000", "1231", True), ("!1000, 1231", "1231", True), ("!bar, foobar, foo", "foo", True),
]
NETS = [
    ("192.168.0.0/16", "192.168.0", False), ("192.168.0/16", "192.168.0.1", False), ("192.168.0.0/16", "192.168.0.1", True), ("!10.0.0.1/16", "192.168.0.1", True),
    ("!10.0.0.1/16, 192.168.0.0/24", "192.168.0.1", True), ("!192.168.0.1/16", "192.168.0.1", False), ("10.0.0.0/16, !192.168.0.1/16", "192.168.0.1", False),
    ("10.0.0.0/16, !192.168.0.1/16, 192.168.0.0/16", "192.168.0.1", False),
]
TEXTS = [
    ("exact phrase", "exact phrase", True), ("exact phrase", "other", False), ("!exact phrase", "exact phrase", False), ("!exact phrase", "other", True), (" Exact Phrase ", "exact PHRASE", True),
    ("foo,bar,qux", "foo", True), ("foo,bar,qux", "bar", True), ("foo,bar,qux", "qux", True), ("foo,bar,qux", "baz", False), ("foo,!bar,qux", "bar", False), ("foo,bar,!qux", "qux", False),
    ("!foo,bar,qux", "foo", False), ("!foo, foo, bar, qux", "foo", False), ("foo, !foo, bar, qux", "foo", True),
]


@pytest.mark.parametrize(("table", "column", "single"), [(CSV, text.value_in_list, match.value_in_list), (NETS, net.address_in_list, match.address_in_list), (TEXTS, text.text_matches, match.text_matches)])
def test_truth_tables(spark, table, column, single):
    row = spark.range(1).select(*(column(F.lit(term), rule).alias(f"c{i}") for i, (rule, term, _) in enumerate(table))).first()
    for i, (rule, term, want) in enumerate(table):
        assert row[i] == want and single(term, rule) == want, (rule, term)


def test_columns_equal_single_values(spark):
    rng = random.Random(8)
    ips = [f"{rng.choice([10, 192, 8])}.{rng.randrange(3)}.{rng.randrange(3)}.{rng.randrange(4)}" for _ in range(60)] + ["", "x", "1.2.3", "1.2.3.256", "01.2.3.4"]
    lists = [", ".join(rng.choice(["", "!"]) + f"{rng.choice([10, 192, 8])}.{rng.randrange(3)}.0.{rng.randrange(4)}/{rng.choice([8, 16, 24, 30, 32])}" for _ in range(rng.randrange(1, 4))) for _ in range(40)] + ["bad, 10.0.0.0/8"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", *(net.address_in_list(F.col("ip"), c).alias(str(k)) for k, c in enumerate(lists))).collect()
    for r, (k, c) in itertools.product(rows, enumerate(lists)):
        assert r[k + 1] == match.address_in_list(r["ip"], c), (r["ip"], c)


def test_scalars(spark):
    r = spark.range(1).select(text.epoch_seconds(F.lit("2018-10-21T16:32:12+07:00")), text.epoch_seconds(F.lit("x")), net.ip_to_long(F.lit("1.2.3.4")), net.is_private(F.lit("172.20.0.1")), net.is_private(F.lit("8.8.8.8")), net.is_private(F.lit("x"))).first()
    assert tuple(r) == (1540114332, None, 16909060, True, False, None)
    assert [match.reference(x) for x in (":1", ":123", "noref", "")] == [1, 123, None, None]
    assert net.is_private_any("fe80::1") and not net.is_private_any("2001:db8::1") and net.is_private_any("x") is None
    assert match.address_in_list("2001:db8::1", "2001:db8::5") and not match.address_in_list("2001:db8::1", "!2001:db8::5")


@pytest.mark.parametrize(("start", "end", "inside", "outside"), [("00:00", "01:00", ["00:30", "01:00"], ["01:01"]), ("22:00", "01:00", ["23:00", "00:10"], ["12:00", "21:59"]), ("01:00", "01:30", ["01:30"], ["00:59", "01:31"])])
def test_time_of_day(spark, start, end, inside, outside):
    df = spark.createDataFrame([(t,) for t in inside + outside], "t string").select("t", text.in_time_of_day(F.concat(F.lit("2024-01-01 "), "t", F.lit(":59")).cast("timestamp"), start, end).alias("ok"))
    assert {r["t"] for r in df.where("ok").collect()} == set(inside)


BASE = {"event_id": "1", "plugin_id": 1001, "plugin_sid": 50001, "product": "IDS", "category": "Malware", "subcategory": "C&C Communication", "src_ip": "192.168.0.1", "dst_ip": "8.8.8.200", "src_port": 31337, "dst_port": 80, "src_home": True, "dst_home": False, "custom_data1": "Deny", "custom_data2": "", "custom_data3": "x"}
RULES = [
    (Rule(1, plugin_id=1001, plugin_sid=[50001], from_="HOME_NET"), True), (Rule(1, plugin_id=1002, plugin_sid=[50001]), False), (Rule(1, plugin_id=1001, plugin_sid=[50002]), False),
    (Rule(1, plugin_id=1001, plugin_sid=[50002, 50001], from_="!HOME_NET"), False), (Rule(1, plugin_id=1001, plugin_sid=[50001], to="HOME_NET"), False), (Rule(1, plugin_id=1001, plugin_sid=[50001], to="!HOME_NET"), True),
    (Rule(1, plugin_id=1001, plugin_sid=[50001], to="8.8.8.0/24"), True), (Rule(1, plugin_id=1001, plugin_sid=[50001], to="!8.8.8.200"), False), (Rule(1, plugin_id=1001, plugin_sid=[50001], port_from="31337"), True),
    (Rule(1, plugin_id=1001, plugin_sid=[50001], port_to="!80"), False), (Rule(1, plugin_id=1001, plugin_sid=[50001], port_to="443, 80"), True), (Rule(1, plugin_id=1001, plugin_sid=[50001], custom_data1="deny"), True),
    (Rule(1, plugin_id=1001, plugin_sid=[50001], custom_data1="!deny"), False), (Rule(1, plugin_id=1001, plugin_sid=[50001], custom_data2="x"), False), (Rule(1, plugin_id=1001, plugin_sid=[50001], custom_data3="ANY"), True),
    (Rule(1, type="TaxonomyRule", product=["IDS"], category="Malware"), True), (Rule(1, type="TaxonomyRule", product=["Firewall"], category="Malware"), False), (Rule(1, type="TaxonomyRule", product=["IDS"], category="malware"), False),
    (Rule(1, type="TaxonomyRule", product=["IDS"], category="Malware", subcategory=["Other"]), False), (Rule(1, type="TaxonomyRule", product=["IDS"], category="Malware", subcategory=["Other", "ANY"]), True),
    (Rule(1, type="TaxonomyRule", product=["IDS"], category="Malware", custom_data1="other"), True), (Rule(1, type="Other"), False),
]


def test_rule_matching(spark):
    row = spark.createDataFrame([BASE]).select(*(rule_matches(r).alias(f"c{i}") for i, (r, _) in enumerate(RULES))).first()
    for i, (r, want) in enumerate(RULES):
        assert row[i] == want and machine.matches(BASE, r, None) == want, r


def test_assets(spark):
    a = Assets(ASSETS)
    ips = ["192.168.0.1", "192.168.0.2", "8.8.8.200", "10.0.0.33", "10.0.0.7", "", "x"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    one = {r["ip"]: r for r in df.select("ip", a.home("ip").alias("home"), a.value("ip").alias("value"), a.name("ip").alias("name"), a.networks("ip").alias("networks"), a.whitelisted("ip").alias("whitelisted")).collect()}
    two = {r["ip"]: r for r in lookup(df, asset_table(spark, ASSETS)).collect()}
    for ip in ips:
        assert all(one[ip][k] == two[ip][k] for k in ("home", "value", "name", "networks", "whitelisted")), ip
    assert one["192.168.0.1"]["value"] == 5 and one["192.168.0.1"]["name"] == "firewall" and one["192.168.0.1"]["networks"] == ["192.168.0.0/16"] and one["8.8.8.200"]["networks"] == []
    with pytest.raises(ValueError):
        Assets([ASSETS[0]] * (INLINE + 1))
    assert validate_assets([{"name": "", "cidr": "x", "value": 0}]) and not validate_assets(ASSETS)


def _directive(**kw):
    base = dict(id=1, name="n", priority=3, kingdom="k", category="c", rules=[Rule(1, plugin_id=1, plugin_sid=[1]), Rule(2, plugin_id=1, plugin_sid=[1], from_=":1", to="ANY")])
    return Directive(**(base | kw))


def test_validation():
    assert validate(_directive()).directive
    low = validate(_directive(priority=9, rules=[Rule(1, plugin_id=1, plugin_sid=[1], occurrence=5, reliability=99), Rule(2, plugin_id=1, plugin_sid=[1])]))
    assert low.directive.priority == 1 and low.directive.rules[0].occurrence == 1 and low.directive.rules[0].reliability == 10 and len(low.warnings) == 2
    second = Rule(2, plugin_id=1, plugin_sid=[1])
    for bad in (
        {"name": ""}, {"kingdom": ""}, {"category": ""}, {"rules": [second]}, {"rules": [Rule(0, plugin_id=1, plugin_sid=[1]), second]}, {"rules": [second, second]},
        {"rules": [Rule(1, type="X"), second]}, {"rules": [Rule(1, plugin_id=0, plugin_sid=[1]), second]}, {"rules": [Rule(1, plugin_id=1, plugin_sid=[]), second]}, {"rules": [Rule(1, type="TaxonomyRule", product=["a"]), second]},
        {"rules": [Rule(1, plugin_id=1, plugin_sid=[1], from_=":1"), second]}, {"rules": [Rule(1, plugin_id=1, plugin_sid=[1]), Rule(2, plugin_id=1, plugin_sid=[1], from_=":2")]}, {"rules": [Rule(1, plugin_id=1, plugin_sid=[1], port_to="65535"), second]},
        {"rules": [Rule(1, plugin_id=1, plugin_sid=[1], to="1.2.3"), second]}, {"rules": [Rule(1, plugin_id=1, plugin_sid=[1]), Rule(2, plugin_id=1, plugin_sid=[1], custom_data1=":9")]},
    ):
        assert validate(_directive(**bad)).errors, bad
    kept, checks = keep_valid([_directive(), _directive(), _directive(id=2, disabled=True)])
    assert len(kept) == 1 and len(checks) == 2
    assert Directive.of(_directive().raw()) == _directive()


def test_partition_keys(spark):
    d = _directive()
    assert pinned(d) == ("src_ip",) and unpinned([d]) == []
    assert pinned(_directive(rules=[Rule(1, from_="10.0.0.0/8"), Rule(2, from_=":1")])) == () and pinned(_directive(rules=[Rule(1), Rule(2, from_="ANY")])) == ()
    df = spark.createDataFrame([(1, "a", 0)], "directive_id int, src_ip string, x int")
    assert df.select(correlation_key([d])).first()[0] == "a" and df.select(correlation_key([d], unique_ids=False)).first()[0] == ""


def test_fan_out(spark):
    e = spark.createDataFrame([(1001, 5, "IDS", "error"), (1001, 9, "IDS", "error"), (1, 1, "x", "y")], "plugin_id int, plugin_sid int, product string, category string")
    mixed = _directive(rules=[Rule(1, plugin_id=1001, plugin_sid=[5]), Rule(2, type="TaxonomyRule", product=["IDS"], category="error")])
    taxonomy = _directive(id=2, rules=[Rule(1, type="TaxonomyRule", product=["IDS"], category="error")])
    assert sorted((r["directive_id"], r["plugin_sid"]) for r in fan_out(e, [mixed, taxonomy]).collect()) == [(1, 5), (2, 5), (2, 9)]


def test_ipv6_columns(spark):
    rng = random.Random(6)
    texts = ["::", "::1", "1::", "2002:c0a8:1::1", "fe80::1", "FC00::a", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4"]
    texts += [":", "", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7:8::", "::1.2.3", "::1.2.3.456", "1.2.3.4", "x", ":1::2", "1::2:", "::1.2.3.4:5"]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, ~(((1 << 64) - 1) << 32), (1 << 40) - 1]))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", net.ip6_to_hex("ip").alias("h"), net.is_private("ip").alias("p")).collect()
    for r in rows:
        a = net.address(r["ip"])
        assert r["h"] == (f"{a[1]:032x}" if a and a[0] == 6 else None), r["ip"]
        assert r["p"] == net.is_private_any(r["ip"]), r["ip"]
    lists = ["2002:c0a8:1::/48", "!fe80::/10", "::/0", "!1.2.3.0/24,2002::1", "fe80::/10,bad,!::/0"]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", *(net.address_in_list("ip", c).alias(str(k)) for k, c in enumerate(lists))).collect()
    assert all(r[k + 1] == match.address_in_list(r["ip"], c) for r in rows for k, c in enumerate(lists))


def test_ipv6_assets_both_plans(spark, sf):
    from wardline.operators import assets
    from wardline.plans import catalogue

    made = catalogue.queries()["event_asset_v6"](spark, sf).count()
    one = assets.Assets(catalogue._V6)
    ips = catalogue._six(spark, sf).select("ip").distinct()
    joined = {r["ip"]: tuple(r)[1:] for r in assets.lookup(ips, assets.asset_table(spark, catalogue._V6)).drop("whitelisted").collect()}
    inline = {r["ip"]: tuple(r)[1:] for r in ips.select("ip", one.home("ip"), one.value("ip"), one.name("ip"), one.networks("ip")).collect()}
    assert made and joined == inline and any(v[2] for v in inline.values())


def test_keys_are_split_only_where_that_is_sound(spark):
    from wardline.plans.directives import Directive, Rule, names_v6

    d = lambda to: Directive(1, "n", 1, "k", "c", [Rule(1, from_="ANY", to=to), Rule(2, from_=":1", to=":1")])
    assert [names_v6([d(x)]) for x in ("ANY", "10.0.0.0/8, 1.2.3.4", "10.0.0.1, 2002::/16", "!::1")] == [False, False, True, True]


def test_ipv6_expressions_stay_small(spark):
    """An address stands in the plan a few times and not once for every use of every part of it."""
    from wardline.operators.assets import Assets
    from wardline.plans import catalogue

    df = spark.createDataFrame([("2002:c0a8:1::0.0.0.1",)], "ip string")
    a = Assets(catalogue._V6)
    for c in (net.ip6_to_hex("ip"), net.address_in_list("ip", "10.0.0.0/8, !2002:c0a8:1::/48"), a.home("ip"), a.value("ip"), a.name("ip"), a.networks("ip")):
        plan = df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert len(plan) < 10_000, len(plan)
