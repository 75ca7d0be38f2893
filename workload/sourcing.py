"""Text and binary captures made from the tables, parsed back to samples."""

from pyspark.sql import functions as F

from sparktide.functions.labels import label
from sparktide.sinks.matrix import timeseries_batches
from sparktide.sources import exposition as X
from sparktide.sources import host as H
from sparktide.sources.remote_write import decode_remote_write, encode_remote_write, remote_write_rejects
from workload.inputs import EV, events, micros, query, shard, table


def _spread(spark, sf):
    """Events over all cores: captured text is many times the size of the row it is made from."""
    return table(spark, sf, "events").repartition(spark.sparkContext.defaultParallelism, "event_id")


def bodies(spark, sf):
    """One scrape per event: a counter, a gauge with its own stamp, a histogram and a summary.

    Bodies of values above 100 carry a broken line.
    """
    text = F.concat(
        F.lit("# HELP clicks_total Events.\n# TYPE clicks_total counter\nclicks_total{type=\""), F.col("event_type"),
        F.lit("\",path=\"a\\\\b\"} "), F.col("event_id").cast("string"),
        F.lit("\n# TYPE size gauge\nsize "), F.col("value").cast("string"), F.lit(" 1704067200123\n"),
        F.lit("\n# TYPE took histogram\ntook_bucket{le=\"1000000\"} "), F.col("user_id").cast("string"),
        F.lit("\ntook_bucket{le=\"+Inf\"} "), (F.col("user_id") + 1).cast("string"),
        F.lit("\ntook_sum "), F.col("value").cast("string"), F.lit("\ntook_count "), (F.col("user_id") + 1).cast("string"),
        F.lit("\n# TYPE lag summary\nlag{quantile=\"0.50\"} "), F.col("value").cast("string"),
        F.lit("\nlag_sum 1.5\nlag_count 3\n"), F.when(F.col("value") > 100, F.lit("broken{ 1\n")).otherwise(F.lit("")),
    )
    return _spread(spark, sf).select(
        F.col("event_id").cast("string").alias("target"), F.col("ts").cast("timestamp").alias("scrape_ts"),
        F.create_map(F.lit("job"), F.lit("shop"), F.lit("type"), F.lit("target")).alias("target_labels"),
        F.lit(15.0).alias("interval_s"), text.alias("body"),
    )


_LINES = """ok AS (SELECT event_id, event_type, epoch_us(ts) AS us, value, user_id FROM events WHERE value <= 100)"""


@query("parse_exposition", f"""WITH {_LINES}
SELECT event_id, 'clicks_total' AS name, event_type AS type, 'a\\b' AS path, NULL AS bound, us AS ts_us, CAST(event_id AS DOUBLE) AS value FROM ok
UNION ALL SELECT event_id, 'size', 'target', NULL, NULL, 1704067200123000, value FROM ok
UNION ALL SELECT event_id, 'took_bucket', 'target', NULL, '1e+06', us, CAST(user_id AS DOUBLE) FROM ok
UNION ALL SELECT event_id, 'took_bucket', 'target', NULL, '+Inf', us, CAST(user_id + 1 AS DOUBLE) FROM ok
UNION ALL SELECT event_id, 'took_sum', 'target', NULL, NULL, us, value FROM ok
UNION ALL SELECT event_id, 'took_count', 'target', NULL, NULL, us, CAST(user_id + 1 AS DOUBLE) FROM ok
UNION ALL SELECT event_id, 'lag', 'target', NULL, '0.5', us, value FROM ok
UNION ALL SELECT event_id, 'lag_sum', 'target', NULL, NULL, us, 1.5 FROM ok
UNION ALL SELECT event_id, 'lag_count', 'target', NULL, NULL, us, 3.0 FROM ok""")
def exposition(spark, sf):
    out = X.parse_exposition(bodies(spark, sf))
    m = F.col("labels")
    return out.select(
        F.col("target").cast("long").alias("event_id"), "name", label(m, "type").alias("type"), label(m, "path").alias("path"),
        F.coalesce(label(m, "le"), label(m, "quantile")).alias("bound"), micros("ts"), "value",
    )


@query("exposition_rejects", "SELECT event_id FROM events WHERE value > 100")
def rejects(spark, sf):
    return X.exposition_rejects(bodies(spark, sf)).select(F.col("target").cast("long").alias("event_id"))


@query("exposition_zero_rows", """SELECT event_id, 'gap_bucket' AS name, event_type AS zone, '2.5' AS bound, CAST(user_id AS DOUBLE) AS value FROM events
UNION ALL SELECT event_id, 'gap_sum', event_type, NULL, 0 FROM events
UNION ALL SELECT event_id, 'gap_count', event_type, NULL, 0 FROM events
UNION ALL SELECT event_id, 'lag_sum', NULL, NULL, value FROM events
UNION ALL SELECT event_id, 'lag_count', NULL, NULL, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 0 END FROM events""")
def zero_rows(spark, sf):
    """A histogram without sum and count, and a summary whose count every second scrape lacks."""
    text = F.concat(
        F.lit('# TYPE gap histogram\ngap_bucket{zone="'), F.col("event_type"), F.lit('",le="2.50"} '), F.col("user_id").cast("string"),
        F.lit("\n# TYPE lag summary\nlag_sum "), F.col("value").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("\nlag_count 7\n")).otherwise(F.lit("\n")),
    )
    scrapes = _spread(spark, sf).select(
        F.col("event_id").cast("string").alias("target"), F.col("ts").cast("timestamp").alias("scrape_ts"), F.create_map(F.lit("job"), F.lit("shop")).alias("target_labels"),
        F.lit(15.0).alias("interval_s"), text.alias("body"),
    )
    m = F.col("labels")
    return X.parse_exposition(scrapes).select(F.col("target").cast("long").alias("event_id"), "name", label(m, "zone").alias("zone"), label(m, "le").alias("bound"), "value")


def snapshot(spark, sf, file, *parts):
    """One captured file per event; ``parts`` are columns or literal text."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return _spread(spark, sf).select(
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("host"), F.lit(file).alias("file"),
        F.col("ts").cast("timestamp").alias("ts"), text.alias("content"),
        F.create_map(F.lit("zone"), F.col("event_type")).alias("labels"),
    )


def readings(samples, *labels):
    m = F.col("labels")
    return samples.select(
        F.expr("CAST(substring(labels['instance'], 2) AS BIGINT)").alias("event_id"), "name",
        *[label(m, k).alias(k) for k in (*labels, "zone")], micros("ts"), "value",
    )




def _unnest(rows, *labels):
    """SQL for readings listed as (name, label values..., value expression)."""
    parts = []
    for name, *values, value in rows:
        named = ", ".join(f"{v} AS {k}" for k, v in zip(labels, values))
        parts.append(f"SELECT event_id, '{name}' AS name, {named + ', ' if named else ''}event_type AS zone, epoch_us(ts) AS ts_us, "
                     f"CAST({value} AS DOUBLE) AS value FROM events")
    return " UNION ALL ".join(parts)


_STAT = [(m, v) for m, v in zip(H.CPU_MODES, ("event_id", "user_id", "3", "event_id * 7", "5", "0", "8", "1"))]


@query("parse_proc_stat", _unnest(
    [("node_cpu_seconds_total", "CAST(user_id % 4 AS VARCHAR)", f"'{m}'", f"({v}) / 100.0::DOUBLE") for m, v in _STAT], "cpu", "mode"))
def proc_stat(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    snap = snapshot(spark, sf, "stat", "cpu  1 2 3 4 5 6 7 8 0 0\ncpu", shard(), " ", e, " ", u, " 3 ", e * 7, " 5 0 8 1 0 0\nintr 9 9\n")
    return readings(H.parse_proc_stat(snap), "cpu", "mode")


@query("parse_meminfo", _unnest([
    ("node_memory_MemTotal_bytes", "(event_id + 1000000) * 1024"), ("node_memory_MemFree_bytes", "user_id * 1024"),
    ("node_memory_Active_bytes", "7 * 1024")]))
def meminfo(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    snap = snapshot(spark, sf, "meminfo", "MemTotal:  ", e + 1000000, " kB\nMemFree:   ", u, " kB\nActive:  7 kB\nActive(anon):   9 kB\nBuffers: none\n")
    return readings(H.parse_meminfo(snap))


@query("parse_diskstats", _unnest([
    ("node_disk_reads_completed_total", "'vdb'", "event_id"), ("node_disk_read_bytes_total", "'vdb'", "user_id * 512"),
    ("node_disk_writes_completed_total", "'vdb'", "user_id + 5"), ("node_disk_written_bytes_total", "'vdb'", "(event_id + 3) * 512")], "device"))
def diskstats(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    snap = snapshot(
        spark, sf, "diskstats", " 7 2 loop2 1 1 1 1 1 1 1 1 1 1 1\n 252 16 vdb ", e, " 4 ", u, " 6 ", u + 5, " 7 ", e + 3, " 8 0 9 10 0 0\n 252 17 short 1 2\n")
    return readings(H.parse_diskstats(snap), "device")


@query("parse_netdev", _unnest([
    (n, "'eth0'", v) for n, v in zip(H.NETWORK_COUNTERS, ("event_id", "2", "user_id", "1"))] + [
    (n, "'lo'", "0") for n in H.NETWORK_COUNTERS], "device"))
def netdev(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    snap = snapshot(
        spark, sf, "net/dev", "Inter-|   Receive  |  Transmit\n face |bytes packets errs|bytes\n    lo: 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0\n  eth0: ",
        e, " 2 0 0 0 0 0 0 ", u, " 1 0 0 0 0 0 0\n")
    return readings(H.parse_netdev(snap), "device")


@query("parse_loadavg", _unnest([("node_load1", "value"), ("node_load5", "0.21"), ("node_load15", "user_id")]))
def loadavg(spark, sf):
    """Linux form for even, sysctl form for odd event ids."""
    rows = snapshot(spark, sf, "loadavg", F.col("value"), " 0.21 ", F.col("user_id"), " 2/439 9\n")
    odd = F.expr("CAST(substring(host, 2) AS BIGINT)") % 2 == 1
    mac = F.concat(F.lit("{ "), F.substring_index("content", " ", 3), F.lit(" }\n"))
    both = rows.withColumn("content", F.when(odd, mac).otherwise(F.col("content"))).withColumn(
        "file", F.when(odd, F.lit("vm.loadavg")).otherwise(F.col("file")))
    return readings(H.parse_loadavg(both))


@query("parse_route", """SELECT event_id, 'node_network_primary_info' AS name, 'eth' || (user_id % 4) AS device, event_type AS zone,
  epoch_us(ts) AS ts_us, 1.0::DOUBLE AS value FROM events WHERE event_type <> 'error'""")
def route(spark, sf):
    """Both table forms; the error events have no default route."""
    kind = F.col("event_type")
    head = "Iface\tDestination\tGateway\n"
    linux = F.concat(F.lit(head + "cni0\t00002A0A\t00000000\neth"), shard().cast("string"), F.lit("\t00000000\t0205A8C0\neth9\t00000000\t1\n"))
    mac = F.concat(F.lit("   route to: default\n  interface: eth"), shard().cast("string"), F.lit("\n      flags: <UP>\n"))
    none = F.lit(head + "cni0\t00002A0A\t00000000\n")
    rows = snapshot(spark, sf, "net/route", F.when(kind == "error", none).when(kind == "click", mac).otherwise(linux))
    rows = rows.withColumn("file", F.when(F.col("labels")["zone"] == "click", F.lit("route")).otherwise(F.col("file")))
    return readings(H.parse_route(rows), "device")


@query("parse_mounts", """SELECT event_id, '/dev/sd' || (user_id % 4) AS device, '/data' || user_id AS mountpoint, 'ext4' AS fstype FROM events
  UNION ALL SELECT event_id, 'tmpfs', '/dev', 'tmpfs' FROM events""")
def mounts(spark, sf):
    snap = snapshot(
        spark, sf, "mounts", "overlay / overlay rw 0 0\nproc /proc proc rw 0 0\ntmpfs /dev tmpfs rw,size=65536k 0 0\n/dev/sd", shard(),
        " /data", F.col("user_id"), " ext4 rw 0 0\n")
    return H.parse_mounts(snap).select(F.expr("CAST(substring(host, 2) AS BIGINT)").alias("event_id"), "device", "mountpoint", "fstype")


@query("parse_macos_top", _unnest([
    ("node_cpu_usage_percent", "'user'", "NULL", "5.74"), ("node_cpu_usage_percent", "'system'", "NULL", "8.76"),
    ("node_cpu_usage_percent", "'idle'", "NULL", "value"), ("node_disk_reads_completed_total", "NULL", "'total'", "event_id"),
    ("node_disk_read_bytes_total", "NULL", "'total'", "user_id * 1073741824"),
    ("node_disk_writes_completed_total", "NULL", "'total'", "17"), ("node_disk_written_bytes_total", "NULL", "'total'", "1.5 * 1048576")],
    "mode", "device"))
def macos_top(spark, sf):
    snap = snapshot(
        spark, sf, "top", "Processes: 704 total\nCPU usage: 5.74% user, 8.76% sys, ", F.col("value"), "% idle\nDisks: ", F.col("event_id"), "/",
        F.col("user_id"), "G read, 17/1.5M written.\n")
    return readings(H.parse_macos_top(snap), "mode", "device")


@query("parse_vm_stat", _unnest([
    ("node_memory_free_bytes", "event_id * 16384"), ("node_memory_wired_bytes", "user_id * 16384"), ("node_memory_compressed_bytes", "42 * 16384")]))
def vm_stat(spark, sf):
    snap = snapshot(
        spark, sf, "vm_stat", "Mach Virtual Memory Statistics: (page size of 16384 bytes)\nPages free:      ", F.col("event_id"),
        ".\nPages speculative:  15.\nPages wired down:   ", F.col("user_id"), ".\n\"Translation faults\":  3.\nPages stored in compressor:  42.\n")
    return readings(H.parse_vm_stat(snap))


@query("parse_netstat", _unnest(
    [(n, "'en0'", v) for n, v in zip(H.NETWORK_COUNTERS, ("event_id", "12", "5", "user_id"))]
    + [(n, "'gif0'", v) for n, v in zip(H.NETWORK_COUNTERS, ("0", "7", "0", "0"))], "device"))
def netstat(spark, sf):
    """With and without an address column; rows of other address families are skipped."""
    snap = snapshot(
        spark, sf, "netstat", "Name Mtu Network Address Ipkts Ierrs Ibytes Opkts Oerrs Obytes Coll\nen0 1500 <Link#14> 4a:af 12 0 ", F.col("event_id"), " ",
        F.col("user_id"), " 0 5 0\nen0 1500 127 localhost 12 - 1 1 - 1 -\ngif0* 1280 <Link#2> 7 0 0 0 0 0 0\n")
    return readings(H.parse_netstat(snap), "device")


@query("parse_host_snapshots", """SELECT 'node_load1' AS name, count(*) AS n, round(sum(value), 4) AS total FROM events
  UNION ALL SELECT 'node_load5', count(*), round(count(*) * 0.5, 4) FROM events
  UNION ALL SELECT 'node_load15', count(*), count(*) FROM events
  UNION ALL SELECT 'node_memory_MemFree_bytes', count(*), sum(event_id) * 1024.0 FROM events""")
def all_files(spark, sf):
    """Two file kinds in one table through all parsers."""
    both = snapshot(spark, sf, "loadavg", F.col("value"), " 0.5 1 2/439 9\n").unionByName(
        snapshot(spark, sf, "meminfo", "MemFree: ", F.col("event_id"), " kB\n"))
    out = H.parse_host_snapshots(both).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.withColumn("total", F.round("total", 4))


def wire(spark, sf):
    return encode_remote_write(timeseries_batches(events(spark, sf)))


@query("decode_remote_write", f"WITH {EV} SELECT name, shard, us // 1000 AS ts_ms, value, 15.0::DOUBLE AS interval_s FROM ev")
def remote_write(spark, sf):
    """Event samples packed into wire bodies and read back."""
    out = decode_remote_write(wire(spark, sf))
    return out.select("name", label(F.col("labels"), "shard").alias("shard"), F.unix_millis("ts").alias("ts_ms"), "value", "interval_s")


@query("remote_write_rejects", "SELECT event_id FROM events")
def bad_bodies(spark, sf):
    """A body of plain text is no Snappy block and rejected as a whole."""
    rows = table(spark, sf, "events").select("event_id", F.encode(F.concat(F.lit("\x7fno body "), "props"), "UTF-8").alias("body"))
    return remote_write_rejects(rows, "event_id").select(F.col("body_no").alias("event_id"))
