"""Captured text and bytes to samples."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import at, rel
from sparktide.sources import exposition as X
from sparktide.sources import host as H
from sparktide.sources.delta_json import read_delta_json
from sparktide.sources.remote_write import _put, _put_varint, decode_remote_write, remote_write_rejects

def family(name, kind, *lines):
    """One family in exposition text: (suffix, labels, value) per line."""
    out = [f"# HELP {name} about {name}", f"# TYPE {name} {kind}"]
    for suffix, labels, value in lines:
        pairs = ",".join(f'{k}="{v}"' for k, v in labels.items())
        out.append(f"{name}{suffix}{'{' + pairs + '}' if pairs else ''} {value}")
    return "\n".join(out) + "\n\n"


def bodies(spark, *texts, labels=None):
    rows = [(str(i), at(0), labels or {"job": "node"}, 15.0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "target string, scrape_ts timestamp, target_labels map<string,string>, interval_s double, body string")


def test_all_families(spark):
    text = (
        family("pump_strokes_total", "counter", ("", {"pump": "north"}, 71), ("", {"pump": "south"}, 8.25))
        + family("tank_level", "gauge", ("", {}, -3))
        + family("weigh_grams", "summary", *[("", {"quantile": q}, v) for q, v in (("0.25", 11), ("0.75", 19))], ("_sum", {}, 640), ("_count", {}, 41))
        + family("fill_seconds", "histogram", *[("_bucket", {"le": b}, n) for b, n in (("0.5", 2), ("30", 6), ("+Inf", 9))], ("_sum", {}, 77.5), ("_count", {}, 9))
    )
    rows = X.parse_exposition(bodies(spark, text)).collect()
    found = {(r.name, *sorted((k, v) for k, v in r.labels.items() if k != "job")): r.value for r in rows}
    assert found == {
        ("pump_strokes_total", ("pump", "north")): 71, ("pump_strokes_total", ("pump", "south")): 8.25, ("tank_level",): -3,
        ("weigh_grams", ("quantile", "0.25")): 11, ("weigh_grams", ("quantile", "0.75")): 19, ("weigh_grams_sum",): 640, ("weigh_grams_count",): 41,
        ("fill_seconds_bucket", ("le", "0.5")): 2, ("fill_seconds_bucket", ("le", "30")): 6, ("fill_seconds_bucket", ("le", "+Inf")): 9,
        ("fill_seconds_sum",): 77.5, ("fill_seconds_count",): 9}
    assert len(rows) == len(found) and all(r.labels["job"] == "node" and rel(r.ts) == 0 for r in rows)


def test_components_without_their_label_carry_nothing(spark):
    text = family("h", "histogram", ("_bucket", {"le": "1"}, 2), ("_bucket", {"other": "1"}, 3), ("", {}, 4), ("_count", {}, 2)) + family("s", "summary", ("", {}, 5), ("_sum", {}, 6))
    assert sorted((r.name, r.value) for r in X.parse_exposition(bodies(spark, text)).collect()) == [
        ("h_bucket", 2), ("h_count", 0), ("h_count", 2), ("h_sum", 0), ("h_sum", 0), ("s_count", 0), ("s_sum", 6)]


def test_missing_sums_and_counts_are_zero(spark):
    text = (
        '# TYPE h histogram\nh_bucket{z="1", le="2",a="x y"} 3 77000\nh_bucket{le="4",a="x y",z="1"} 5 77000\nh_count{a="x y",z="1"} 5 77000\nh_sum{a="q\\"r"} 2\n'
        '# TYPE s summary\ns{quantile="0.5"} 1\n# TYPE g gauge\ng_sum 4\nplain_count 2\n'
    )
    rows = X.parse_exposition(bodies(spark, text, labels={"job": "j"})).collect()
    got = sorted((r.name, r.labels.get("a", ""), r.labels.get("z", ""), r.value, r.ts.timestamp() if r.ts.year == 1970 else 0) for r in rows if r.value == 0)
    assert got == [("h_count", 'q"r', "", 0, 0), ("h_sum", "x y", "1", 0, 77), ("s_count", "", "", 0, 0), ("s_sum", "", "", 0, 0)]
    assert len(rows) == 11 and all("le" not in r.labels and r.labels["job"] == "j" for r in rows if r.value == 0)


@pytest.mark.parametrize("families", [1, 64, 65, 200])
def test_few_and_many_families(spark, families):
    text = "".join(family(f"f{i}", "histogram", ("_bucket", {"le": "2000000"}, i), ("_bucket", {"le": "+Inf"}, i)) for i in range(families))
    twice = text + "# TYPE f0 counter\n"
    rows = X.parse_exposition(bodies(spark, text, twice)).collect()
    assert {r.target for r in rows} == {"0"}
    found = {(r.name, r.labels.get("le")): r.value for r in rows}
    assert len(rows) == len(found) == 4 * families
    for i in range(families):
        assert found[(f"f{i}_bucket", "2e+06")] == found[(f"f{i}_bucket", "+Inf")] == i and found[(f"f{i}_sum", None)] == found[(f"f{i}_count", None)] == 0


def test_lines(spark):
    text = (
        'a{x="q\\"b\\\\c\\nd",job="own",} 1e3 1700000000123\n'
        "b +Inf\nc NaN\n\td_total   -0.5  \n# a comment\n#TYPE is no type line here\n"
        '# TYPE h histogram\nh_bucket{le="1000000"} 3.7\nh_other{le="0.50"} 1\n'
    )
    rows = {r.name: r for r in X.parse_exposition(bodies(spark, text)).collect()}
    assert rows["a"].labels == {"x": 'q"b\\c\nd', "job": "own"} and rows["a"].value == 1000
    assert rows["a"].ts.timestamp() == pytest.approx(1700000000.123)
    assert rows["b"].value == float("inf") and rows["c"].value != rows["c"].value and rows["d_total"].value == -0.5
    assert rows["h_bucket"].labels["le"] == "1e+06" and rows["h_bucket"].value == 3
    assert rows["h_other"].labels["le"] == "0.50"


def test_cut_marks_inside_lines(spark):
    df = bodies(spark, 'a{x="p\u0001q"} 1\n', "a\u0001b\u00011\u0001\n")
    assert [(r.target, r.labels["x"]) for r in X.parse_exposition(df).collect()] == [("0", "p\u0001q")]
    assert [r.target for r in X.exposition_rejects(df).collect()] == ["1"]


@pytest.mark.parametrize("broken", [
    "ok 1\nbad\n", "a 1 2 3\n", 'a{x="1} 2\n', 'a{x="1" y="2"} 2\n', "a{x='1'} 2\n", 'a{x="\\q"} 2\n', "0a 1\n", "a one\n",
    "# TYPE a wrong\na 1\n", "# TYPE a\n", "# TYPE a gauge\n# TYPE a gauge\na 1\n",
    "a 1\n# TYPE a gauge\n", "# HELP a one\n# HELP a two\na 1\n", 'a{x="1",x="2"} 2\n', "a 1",
])
def test_a_broken_body_is_rejected_whole(spark, broken):
    df = bodies(spark, broken, "fine 1\n")
    assert [r.name for r in X.parse_exposition(df).collect()] == ["fine"]
    assert [r.target for r in X.exposition_rejects(df).collect()] == ["0"]


def test_status(spark):
    df = bodies(spark, "a 1\n", "b 1\n").withColumn("status", F.when(F.col("target") == "0", 500).otherwise(200))
    assert [r.name for r in X.parse_exposition(df).collect()] == ["b"]


def snap(spark, file, content):
    return spark.createDataFrame([("h1", file, at(0), content, {"zone": "z"})],
                                 "host string, file string, ts timestamp, content string, labels map<string,string>")


def read(df):
    out = {}
    for r in df.collect():
        own = {k: v for k, v in r.labels.items() if k not in ("instance", "zone")}
        assert r.labels["instance"] == "h1" and r.labels["zone"] == "z"
        out[(r.name, *sorted(own.items()))] = r.value
    return out


def row(*cells, width=0):
    return " ".join(str(c).rjust(width) for c in cells) + "\n"


def test_proc_stat(spark):
    """Ticks are hundredths of a second; the first line sums up the others."""
    ticks = {cpu: [1000 * cpu + 10 * k for k in range(10)] for cpu in range(3)}
    text = row("cpu", *(sum(t[k] for t in ticks.values()) for k in range(10))) + "".join(row(f"cpu{c}", *t) for c, t in ticks.items()) + "intr 5\nctxt 6\n"
    got = read(H.parse_proc_stat(snap(spark, "stat", text)))
    assert len(got) == 8 * 3
    for cpu, t in ticks.items():
        for k, mode in enumerate(H.CPU_MODES):
            assert got["node_cpu_seconds_total", ("cpu", str(cpu)), ("mode", mode)] == t[k] / 100


def test_meminfo(spark):
    sizes = {"MemTotal": 8192, "MemFree": 77, "MemAvailable": 4100, "Buffers": 12, "Cached": 345}
    others = {"Active(file)": 5, "HugePages_Total": 3}
    text = "".join(f"{k}:{v:>12} kB\n" for k, v in sizes.items()) + f"Active(file): {others['Active(file)']} kB\nDirty: few kB\n"
    got = read(H.parse_meminfo(snap(spark, "meminfo", text)))
    assert {k: got[(f"node_memory_{k}_bytes",)] for k in sizes} == {k: v * 1024 for k, v in sizes.items()}
    assert not any("(" in name for (name, *_) in got)


def test_diskstats(spark):
    """Fields after the name: reads, merged, sectors, ms, writes, merged, sectors, ms and more; sectors are 512 bytes."""
    def line(name, *fields):
        return row(259, 3, name, *fields, *[0] * (14 - len(fields)))

    text = line("nvme7n1", 31, 1, 64, 9, 17, 2, 80, 4) + line("loop4", 5, 5, 5, 5, 5, 5, 5, 5) + row(259, 4, "short", 1, 2)
    got = read(H.parse_diskstats(snap(spark, "diskstats", text)))
    assert [got[name, ("device", "nvme7n1")] for name in H.DISK_COUNTERS] == [31, 64 * 512, 17, 80 * 512] and len(got) == 4


def test_netdev(spark):
    """Eight receive fields, then the transmit ones; two lines of heading."""
    def line(name, received, sent):
        return f"{name:>9}:" + row(*received, *[0] * 6, *sent, *[0] * 6, width=5)

    text = "Inter-|   Receive | Transmit\n face |bytes |bytes\n" + line("wlp9s0", (5001, 51), (6002, 62)) + line("veth3", (7, 1), (8, 2))
    got = read(H.parse_netdev(snap(spark, "net/dev", text)))
    assert [got[name, ("device", "wlp9s0")] for name in H.NETWORK_COUNTERS] == [5001, 51, 6002, 62]
    assert [got[name, ("device", "veth3")] for name in H.NETWORK_COUNTERS] == [7, 1, 8, 2] and len(got) == 8


def test_loadavg(spark):
    three = (1.5, 0.75, 2.25)
    want = {(name,): v for name, v in zip(H.LOADS, three)}
    assert read(H.parse_loadavg(snap(spark, "loadavg", row(*three, "3/81", 4711)))) == want
    assert read(H.parse_loadavg(snap(spark, "vm.loadavg", row("{", *three, "}")))) == want
    assert read(H.parse_loadavg(snap(spark, "vm.loadavg", row("{", three[0], "high", three[2], "}")))) == {}


def test_route(spark):
    """The default route is the one to address zero, in hexadecimal digits; the other tool names its interface."""
    def table(*rows):
        return "\t".join(("Iface", "Destination", "Gateway", "Flags")) + "\n" + "".join("\t".join(r) + "\n" for r in rows)

    local = ("br5", "0000FEA9", "00000000", "0001")
    default = ("wlp9s0", "0" * 8, "FE01A8C0", "0003")
    assert list(read(H.parse_route(snap(spark, "net/route", table(local, default))))) == [("node_network_primary_info", ("device", "wlp9s0"))]
    assert read(H.parse_route(snap(spark, "net/route", table(local)))) == {}
    text = "".join(f"{k:>12}: {v}\n" for k, v in {"route to": "default", "gateway": "10.9.8.7", "interface": "utun3", "flags": "<UP>"}.items())
    assert list(read(H.parse_route(snap(spark, "route", text)))) == [("node_network_primary_info", ("device", "utun3"))]


def test_mounts(spark):
    kinds = ["ext4", "tmpfs", "xfs", *H.VIRTUAL_FILESYSTEMS]
    text = "".join(row(f"/dev/d{k}", f"/mnt/{k}", kind, "rw,noatime", 0, 0) for k, kind in enumerate(kinds)) + "cut line\n"
    got = H.parse_mounts(snap(spark, "mounts", text)).collect()
    assert sorted((r.device, r.mountpoint, r.fstype) for r in got) == [(f"/dev/d{k}", f"/mnt/{k}", kind) for k, kind in enumerate(kinds[:3])]


def top_text(user=12.5, system=7.25, idle=80.25, reads=4321, read="3G", writes=987, written="512M"):
    return f"Load Avg: 1, 2, 3\nCPU usage: {user}% user, {system}% sys, {idle}% idle \nDisks: {reads}/{read} read, {writes}/{written} written.\n"


def test_macos_top(spark):
    got = read(H.parse_macos_top(snap(spark, "top", top_text())))
    assert [got["node_cpu_usage_percent", ("mode", m)] for m in ("user", "system", "idle")] == [12.5, 7.25, 80.25]
    assert [got[name, ("device", "total")] for name in H.DISK_COUNTERS] == [4321, 3 * 1024**3, 987, 512 * 1024**2]
    for broken in ({"user": "much"}, {"idle": ""}):
        assert {name for name, *_ in read(H.parse_macos_top(snap(spark, "top", top_text(**broken))))} == set(H.DISK_COUNTERS)
    for broken in ({"read": "3X"}, {"writes": "some"}):
        assert {name for name, *_ in read(H.parse_macos_top(snap(spark, "top", top_text(**broken))))} == {"node_cpu_usage_percent"}


def test_vm_stat(spark):
    """Pages of the size in the heading; names may be quoted and numbers end in a dot."""
    pages = {name: 100 + 7 * k for k, name in enumerate(H.VM_STAT_KEYS)}
    text = "Statistics: (page size of 4096 bytes)\n" + "".join(f"{k}:{v:>14}.\n" for k, v in pages.items()) + '"Pageins": 5.\nPages purged: 6.\n'
    assert read(H.parse_vm_stat(snap(spark, "vm_stat", text))) == {(f"node_memory_{H.VM_STAT_KEYS[k]}_bytes",): v * 4096 for k, v in pages.items()}
    assert read(H.parse_vm_stat(snap(spark, "vm_stat", text.replace("4096", "no")))) == {}


def test_netstat(spark):
    """Link rows only; the address is missing for some, so columns count from the end."""
    def line(name, network, address, *counters):
        return f"{name:<10}1500  {network:<12}{address:<19}" + row(*counters, width=9)

    text = line("Name", "Network", "Address", "Ipkts", "Ierrs", "Ibytes", "Opkts", "Oerrs", "Obytes", "Coll")
    text += line("utun3", "<Link#21>", "", 11, 0, 1100, 22, 0, 2200, 0) + line("en7*", "<Link#5>", "02:00:5e:10:00:01", 33, 1, 3300, 44, 2, 4400, 0)
    text += line("en7", "10.9/16", "10.9.8.7", 33, "-", 3300, 44, "-", 4400, "-")
    got = read(H.parse_netstat(snap(spark, "netstat", text)))
    assert [got[name, ("device", "utun3")] for name in H.NETWORK_COUNTERS] == [1100, 11, 2200, 22]
    assert [got[name, ("device", "en7")] for name in H.NETWORK_COUNTERS] == [3300, 33, 4400, 44] and len(got) == 8


def test_snapshots_do_not_shuffle(spark):
    plan = H.parse_host_snapshots(snap(spark, "stat", ""))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def wire(name, labels, points):
    pairs = [("__name__", name)] * bool(name) + list(labels.items())
    body = b"".join(_put(1, _put(1, k.encode()) + _put(2, v.encode())) for k, v in pairs)
    body += b"".join(_put(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _put_varint(t)) for v, t in points)
    return _put(1, body)


def test_remote_write(spark):
    snappy = pa.Codec("snappy")
    good = snappy.compress(wire("valve_open", {"site": "east"}, [(0.625, 1711111111000)]) + wire("", {"a": "b"}, [(1, 1)])
                           + wire("old", {}, [(1.5, -1000), (2.5, 0)]), asbytes=True)
    df = spark.createDataFrame([(1, good), (2, b"not snappy"), (3, good[:-4]), (4, snappy.compress(b"\x0b\x01", asbytes=True))], "no long, body binary")
    rows = decode_remote_write(df, "no").collect()
    assert sorted((r.name, r.labels.get("site"), int(r.ts.timestamp()), r.value, r.interval_s) for r in rows if r.name != "old") == [
        ("valve_open", "east", 1711111111, 0.625, 15.0)]
    assert sorted(r.value for r in rows if r.name == "old") == [1.5, 2.5] and {r.body_no for r in rows} == {1}
    assert sorted(r.body_no for r in remote_write_rejects(df, "no").collect()) == [2, 3, 4]


def test_delta_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"rows":[{"node_id":"n1","hostname":"h","metric_name":"cpu","labels":{"b":"2","a":"1"},"time":"2024-01-01T00:01:00Z","value":2.5,"anomalous":false},'
        '{"node_id":"n1","hostname":"h","metric_name":"up","time":"2024-01-01T00:02:00.5+01:00","value":1,"anomalous":false}],"watermark":"2024-01-01T00:01:00Z"}\n'
        '{"rows":[],"watermark":"2024-01-01T00:01:00Z"}\n')
    rows = read_delta_json(spark, str(tmp_path)).orderBy("metric_name").collect()
    assert [(r.metric_name, r.labels_json, rel(r.ts), r.value) for r in rows] == [
        ("cpu", '{"a":"1","b":"2"}', 60, 2.5), ("up", "{}", 120.5 - 3600, 1)]
