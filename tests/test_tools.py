"""Sources, normalisation, harvest, enrichment, tools and flow control."""

import json

import pytest
from pyspark.sql import functions as F

from wardline.operators import alarms, enrich, harvest, normalize, tools
from wardline.plans.directives import Rule
from wardline.schemas import EVENT
from wardline.sources import files


def test_event_round_trip(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event_id": "1", "plugin_id": 3, "odd": 1}\nnot json\n')
    rows = files.read_events(spark, str(tmp_path)).orderBy("event_id").collect()
    assert rows[1]["plugin_id"] == 3 and rows[1]["title"] == "" and rows[0]["src_port"] == 0
    got = files.parse_events(spark.createDataFrame([('{"event_id": "2", "dst_port": 7}',), ("broken",)], "value string")).orderBy("event_id").collect()
    assert got[1]["dst_port"] == 7 and got[1]["rcvd_time"] > 0 and got[0]["event_id"] == ""


def test_configuration_files(spark, tmp_path):
    rule = {"stage": 1, "type": "PluginRule", "plugin_id": 1, "plugin_sid": [1], "occurrence": 1, "from": "ANY", "to": "ANY", "port_from": "ANY", "port_to": "ANY"}
    good = {"id": 1, "name": "n", "priority": 1, "kingdom": "k", "category": "c", "rules": [rule, rule | {"stage": 2, "from": ":1"}]}
    (tmp_path / "directives_a_1.json").write_text(json.dumps({"directives": [good, good | {"id": 2, "name": ""}]}, indent=1))
    (tmp_path / "directives_b_1.json").write_text(json.dumps({"directives": [good | {"id": 3}, good | {"id": 4, "disabled": True}]}))
    (tmp_path / "assets_x.json").write_text(json.dumps({"assets": [{"name": "a", "cidr": "10.0.0.0/8", "value": 2}]}, indent=1))
    (tmp_path / "intel_x.json").write_text(json.dumps({"intel_sources": [{"name": "a", "plugin": "Wise", "enabled": True}, {"name": "b", "enabled": False}]}))
    kept, checks = files.load_directives(spark, str(tmp_path))
    assert [d.id for d in kept] == [1, 3] and len(checks) == 3
    assert [d.id for d in files.load_directives(spark, str(tmp_path), node="b")[0]] == [3]
    assert [n for n, _ in files.list_configs(spark, str(tmp_path), "a")] == ["assets_x.json", "directives_a_1.json", "intel_x.json"]
    assert files.validate_directory(spark, str(tmp_path)) == (3, 4)
    assert files.load_assets(spark, str(tmp_path))[0]["value"] == 2 and len(files.load_sources(spark, str(tmp_path), "intel")) == 1
    assert files.validate_upload("assets_x.json", (tmp_path / "assets_x.json").read_bytes()) is None
    assert files.validate_upload("../x.json", b"{}") and files.validate_upload("assets_x.json", b'{"assets": []}') and files.validate_upload("assets_x.json", b"{")


def test_nessus(spark, tmp_path):
    head = '"Plugin ID",CVE,CVSS,Risk,Host,Protocol,Port,Name,Synopsis,Description,Solution,"See Also","Plugin Output"\n'
    (tmp_path / "nessus_a.csv").write_text(head + '1,CVE-1,7.5,High,10.0.0.4,tcp,80,"Old ""server""","two\nlines",d,s,a,o\n2,,,Low,10.0.0.4,tcp,80,Banner,x,d,s,a,o\n')
    scans = files.read_nessus(spark, str(tmp_path))
    assert [r["result"] for r in enrich.scan_results(scans).collect()] == ['High - Old "server" (CVE-1)']
    assert enrich.vulnerabilities_of(scans, "10.0.0.4", 80).count() == 2
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "nessus_b.csv").write_text(head + "x,CVE-1,7.5,High,10.0.0.4,tcp,80,n,s,d,s,a,o\n")
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        files.read_nessus(spark, str(bad)).collect()


def test_sid_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("plugin\tid\tsid\ttitle\tcategory\tkingdom\np\t1\t2\tb\t\tk\np\t1\t1\ta\tc\t\n")
    rows = files.read_sids(spark, str(tmp_path / "a.tsv"), category="none")
    assert [r["category"] for r in rows.orderBy("sid").collect()] == ["c", "none"]
    files.write_sids(rows, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert text[0].startswith("plugin\tid\tsid") and text[1].split("\t")[2] == "1"
    assert files.parse_tsv("a\tb\n1\t\n", {"b": "x"}) == [{"a": "1", "b": "x"}]


def test_config():
    assert files.EngineConfig().medium_risk == (3, 6)
    for bad in ({"mode": "x"}, {"min_eps": 2000}, {"medium_risk": (6, 3)}, {"medium_risk": (1, 6)}):
        with pytest.raises(ValueError):
            files.EngineConfig(**bad)


def test_normalize(spark):
    raw = spark.createDataFrame([("app", "2024-01-02 03:04:05", "hit", None, "x"), ("app", "bad", "unknown", "10.0.0.1", "80"), ("other", "", "hit", "", "")], "app string, at string, title string, src string, port string")
    m = normalize.PluginMapping("app", plugin_id=9, identify={"app": "app"}, fields={"timestamp": "es:at", "title": "es:title", "sensor": "s", "src_ip": "es:src", "dst_ip": "1.1.1.1", "dst_port": "es:port", "custom_label1": "p", "custom_data1": "es:src"}, time_format="yyyy-MM-dd HH:mm:ss", sids={"hit": 4})
    rows = normalize.normalize(raw, m).collect()
    assert len(rows) == 1 and rows[0]["timestamp"] == "2024-01-02T03:04:05Z" and rows[0]["plugin_sid"] == 4 and rows[0]["src_ip"] == "0.0.0.0" and rows[0]["dst_port"] == 0 and rows[0]["custom_label1"] == ""
    assert set(normalize.normalize(raw, m).columns) == {f.name for f in EVENT.fields}
    assert rows[0]["event_id"] == normalize.normalize(raw, m).first()["event_id"]
    with pytest.raises(ValueError, match="gone"):
        normalize.normalize(raw, normalize.PluginMapping("app", fields={"title": "es:gone"}))
    with pytest.raises(ValueError):
        normalize.PluginMapping.template("x")
    assert "plugin_sid" in normalize.PluginMapping.template("SID").fields
    hids = normalize.host_agent(spark.createDataFrame([('{"groups": "a, b", "message": "say \\"x\\""}',)], "m string"), "m", "groups string, message string").first()
    assert hids["groups"] == ["a", "b"] and hids["message"] == "say x"
    hosts = normalize.resolve_hosts(spark.createDataFrame([("srv", "0.0.0.0"), ("no", "2.2.2.2")], "dst_host string, dst_ip string"), spark.createDataFrame([("srv", "1.2.3.4")], "host string, ip string"))
    assert {r["dst_ip"] for r in hosts.collect()} == {"1.2.3.4", "2.2.2.2"}


def test_sid_upsert():
    base = {1: {"title": "a"}, 2: {"title": "b"}}
    got = harvest.upsert_sids(base, [{"title": "a"}, {"title": "c"}, {"title": 'say "x"'}, {"title": "c"}], "p", 9)
    assert {s: r["title"] for s, r in got.items()} == {1: "a", 2: "b", 3: "c", 4: "say 'x'"}
    assert harvest.upsert_sids({}, [{"title": "z"}], "p", 9, 50)[50]["title"] == "z"


def test_harvest_exists(spark):
    df = spark.createDataFrame([(None,), ("x",)], "a string")
    assert harvest.exists(df, "a") and not harvest.exists(df.where("a is null"), "a")


def test_providers(spark, tmp_path):
    assert enrich.providers("intel") == ["Wise"] and enrich.providers("vuln") == ["Nessus"] and enrich.provider("vuln", "x") is None
    with pytest.raises(ValueError):
        enrich.register("intel", "Wise")(object)
    (tmp_path / "w.json").write_text(json.dumps({"term": "8.8.8.8", "body": "[{field: 'a.activity', len: 9, value: 'Scanning'}, {field: 'a.id', len: 2, value: 'xy'}]"}))
    (p,) = enrich.enabled("intel", [{"plugin": "Wise", "enabled": True, "config": json.dumps({"path": str(tmp_path)})}, {"plugin": "None", "enabled": True}])
    assert [tuple(r) for r in p.table(spark).collect()] == [("Wise", "8.8.8.8", "a.activity: Scanning")]

    def check(term):
        if term == "bad":
            raise RuntimeError
        return [("p", term + "!")]

    assert [tuple(r) for r in enrich.check_each(spark.createDataFrame([("a",), ("bad",), ("a",)], "term string"), check).where("error is null").select("term", "provider", "result").collect()] == [("a", "p", "a!")]
    failed = enrich.check_each(spark.createDataFrame([("bad",)], "term string"), check).first()
    assert failed["term"] == "bad" and failed["result"] is None and failed["error"]

    def slow(term):
        import time

        time.sleep(3 if term == "hangs" else 0)
        return [("p", term)]

    rows = enrich.check_each(spark.createDataFrame([("hangs",), ("quick",)], "term string").coalesce(1), slow, seconds=1).collect()
    assert {(r["term"], r["result"], r["error"]) for r in rows} == {("hangs", None, "TimeoutError"), ("quick", "quick", None)}


def test_attach_and_latest(spark):
    c = spark.createDataFrame([("a", 10, 1, 1, 3, "x"), ("a", 10, 2, 2, 5, None), ("a", 10, 3, 3, 4, None)], "alarm_id string, created_time bigint, update_time bigint, seq bigint, risk int, vuln string")
    r = alarms.upsert_latest(c, ("vuln",)).first()
    assert (r["risk"], r["update_time"], r["vuln"]) == (5, 2, "x")
    hits = spark.createDataFrame([("a", "p", "t", "r")], "alarm_id string, provider string, term string, result string")
    assert enrich.attach(c, hits, "intel_hits").first()["intel_hits"][0]["term"] == "t"


def test_partitions_and_compaction(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (86400, 2), (86401, 3)], "t bigint, x int")
    files.write_by_day(df, str(tmp_path / "d"), "t")
    files.write_by_day(df.where("x = 3"), str(tmp_path / "d"), "t")
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 3]
    assert files.compact(spark, str(tmp_path / "d"), str(tmp_path / "e"), 1) == 2
    here, rest = alarms.move_day(df, "t", "1970-01-02")
    assert here.count() == 2 and rest.count() == 1


def test_directive_tools(spark):
    sids = spark.createDataFrame([(7, 3, "b", "c", ""), (7, 1, "a", "c", "k"), (7, 2, "a", "c", "k"), (7, 0, "z", "", ""), (7, 9, "", "", "")], "id int, sid int, title string, category string, kingdom string")
    rows = tools.generate_directives(sids, "X EVENT_TITLE", "K", 3, 7, 10, (10, 12)).orderBy("id").collect()
    assert [(r["id"], r["name"], r["kingdom"], r["sids"]) for r in rows] == [(11, "X a", "k", [1, 2]), (13, "X b", "K", [3])]
    assert [(s["occurrence"], s["timeout"], s["reliability"]) for s in rows[0]["stages"]] == [(1, 0, 7), (10, 3600, 10), (10000, 21600, 10)]
    ids = spark.range(1, 8).select(F.col("id").cast("int").alias("id"))
    assert [r["file"] for r in tools.split_in(ids, 3).orderBy("id").collect()] == [1, 1, 2, 2, 3, 3, 3]
    assert [r["file"] for r in tools.split_by_count(ids, 3).orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError):
        tools.split_in(ids, 8)


def test_xml_conversion():
    text = """<?xml version="1.0"?><directive id="5" name="n" priority="2"><rule name="r1" plugin_id="7" plugin_sid="1,2" occurrence="1" from="HOME_NET" to="ANY" port_from="ANY" port_to="ANY" reliability="1">
    <rules><rule name="r2" plugin_id="7" plugin_sid="1:PLUGIN_SID" occurrence="5" from="1:SRC_IP" to="ANY" port_from="ANY" port_to="1:DST_PORT" time_out="60" reliability="3"/><rule name="r3" product="1,9" category="4" subcategory="2" occurrence="2" from="ANY" to="ANY"/></rules></rule><rule name="lost" product="1" category="4"/></directive>"""
    names = tools.Names({5: (1, 2)}, {1: "K"}, {2: "C"}, {1: "IDS"}, {4: "Malware"}, {(2, 4): "Worm"})
    (d,), warnings = tools.convert_xml(text, names)
    assert (d.kingdom, d.category, d.priority) == ("K", "C", 2) and [r.stage for r in d.rules] == [1, 2, 3] and len(warnings) == 1
    assert d.rules[1] == Rule(2, "PluginRule", "r2", 7, [1, 2], occurrence=5, from_=":1", to="ANY", port_from="ANY", port_to=":1", reliability=3, timeout=60)
    assert (d.rules[2].type, d.rules[2].product, d.rules[2].category, d.rules[2].subcategory) == ("TaxonomyRule", ["IDS"], "Malware", ["Worm"])
