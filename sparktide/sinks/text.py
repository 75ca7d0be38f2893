"""Text outputs: exposition lines and alert payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import json_text, label_suffix, sorted_entries
from sparktide.functions.numbers import format_float

# Words and symbols of the chat message.
FIRING_WORD, FIRING_SIGN = "FIRING", "\U0001F534"
RESOLVED_WORD, RESOLVED_SIGN = "RESOLVED", "✅"


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"'))


def exposition_line(name: Column, labels: Column, value: Column, ts: Column) -> Column:
    pairs = F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    body = F.when(F.size(F.map_keys(labels)) > 0, F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))).otherwise(F.lit(""))
    millis = F.floor(F.unix_micros(ts) / 1000).cast("long").cast("string")
    return F.concat(name, body, F.lit(" "), format_float(value), F.lit(" "), millis)


def render_exposition(latest: DataFrame) -> DataFrame:
    """Lines of the latest value of each series, one untyped family per metric.

    ``latest`` is the result of ``latest_per_series``.  Rows are ordered by
    (name, series) with the family's type line first.
    """
    lines = latest.select(
        "name", F.lit(1).alias("part"), "series_id",
        exposition_line(F.col("name"), F.col("labels"), F.col("value"), F.col("ts")).alias("line"),
    )
    heads = latest.select("name").distinct().select(
        "name", F.lit(0).alias("part"), F.lit("").alias("series_id"),
        F.concat(F.lit("# TYPE "), "name", F.lit(" untyped")).alias("line"),
    )
    return heads.unionByName(lines).orderBy("name", "part", "series_id")


def write_exposition(latest: DataFrame, path: str) -> None:
    """Write the lines as text files, in order across the files."""
    render_exposition(latest).select("line").write.mode("overwrite").text(path)


def _rfc3339(ts: Column) -> Column:
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    digits = F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", "")
    whole = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), digits)), F.lit("Z"))


def _json_number(value: Column) -> Column:
    """Shortest JSON number: plain within [1e-6, 1e21), else with an exponent."""
    size = F.abs(value)
    text = format_float(value)
    # format_float turns to exponents outside [1e-4, 1e6) already
    plain = F.when(size >= 1e6, value.cast("decimal(38,10)")).otherwise(value.cast("decimal(38,24)")).cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")
    inside = (size >= 1e-6) & (size < 1e21)
    return F.when(text.contains("e") & inside, plain).otherwise(F.regexp_replace(text, r"e-0(\d)$", "e-$1"))


def _json_string(text: Column) -> Column:
    return F.regexp_extract(json_text(F.to_json(F.array(text))), r"(?s)^\[(.*)\]$", 1)


def webhook_json() -> Column:
    """JSON object of an alert event."""
    labels = F.when(
        F.size(F.map_keys("labels")) > 0,
        F.concat(F.lit(',"labels":'), json_text(F.to_json(F.map_from_entries(sorted_entries(F.col("labels")))))),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"rule":'), _json_string(F.col("rule")), F.lit(',"metric":'), _json_string(F.col("metric")), labels,
        F.lit(',"severity":'), _json_string(F.col("severity")), F.lit(',"value":'), _json_number(F.col("value")),
        F.lit(',"since":"'), _rfc3339(F.col("since")), F.lit('","firing":'), F.col("firing").cast("string"), F.lit("}"),
    )


def slack_text() -> Column:
    """One-line chat message of an alert event; the start time only while firing."""
    firing = F.col("firing")
    sign = F.when(firing, F.lit(FIRING_SIGN)).otherwise(F.lit(RESOLVED_SIGN))
    word = F.when(firing, F.lit(FIRING_WORD)).otherwise(F.lit(RESOLVED_WORD))
    since = F.when(firing, F.concat(F.lit(" (since "), F.date_format("since", "HH:mm:ss"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(
        sign, F.lit(" *"), word, F.lit("* ["), F.col("severity"), F.lit("] "), F.col("metric"),
        label_suffix(F.col("labels")), F.lit(" = "), format_float(F.col("value")), since,
    )


def alert_payloads(routed: DataFrame) -> DataFrame:
    """Routed alerts with the text their notifier sends: JSON for webhooks, a ``text`` object for Slack."""
    slack = json_text(F.to_json(F.struct(slack_text().alias("text"))))
    return routed.withColumn("payload", F.when(F.col("type") == "slack", slack).otherwise(webhook_json()))
