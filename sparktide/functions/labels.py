"""Label maps: identity, matching, merging and text forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_labels() -> Column:
    return F.create_map().cast("map<string,string>")


def sorted_entries(labels: Column) -> Column:
    """Label pairs as an array of (key, value) structs in key order."""
    return F.sort_array(F.map_entries(labels))


def _chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# The escapes of a quoted label value in a series id.
QUOTE_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]

# Characters the JSON outputs write as escapes inside strings.
JSON_ESCAPES = [
    ("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"),
    ("\u2028", "\\u2028"), ("\u2029", "\\u2029"),
]


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), _chain(text, QUOTE_ESCAPES), F.lit('"'))


def unquoted(text: Column) -> Column:
    """Undo :func:`quoted` on the text between the quotes."""
    mark = "\u0000"
    back = [("\\\\", mark)] + [(new, old) for old, new in QUOTE_ESCAPES[1:]] + [(mark, "\\")]
    return _chain(text, back)


def json_text(json: Column) -> Column:
    """JSON from ``to_json`` with the HTML-safe escapes of the wire format."""
    return _chain(json, JSON_ESCAPES)


def series_id(name: Column, labels: Column) -> Column:
    """Canonical ``name{k="v",...}`` text of a series, keys sorted.

    A MAP column cannot be ordered or used as a window key, so this string is
    the key of every grouping, window and join over series.  It is never null,
    so joins on it add no filter that would build it a second time.
    """
    name = F.coalesce(name, F.lit(""))
    pairs = F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"])))
    return F.concat(name, F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))


def series_id_from(name: Column, labels: Mapping[str, Column]) -> Column:
    """The same id where the label keys are known beforehand: no map, no lambda, all compiled."""
    pairs = [F.concat(F.lit(f"{key}="), quoted(labels[key])) for key in sorted(labels)]
    return F.concat(F.coalesce(name, F.lit("")), F.lit("{"), F.concat_ws(",", *pairs) if pairs else F.lit(""), F.lit("}"))


_ID_PAIR = r'([^",={}]+)="([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def labels_of(series: Column) -> Column:
    """Label map read back from a series id.

    Aggregations group by the id alone (a string key keeps hash aggregation;
    a map carried through ``first`` would force a sort) and rebuild the map on
    the few rows that remain.
    """
    body = F.substring(series, F.locate("{", series), F.length(series))
    keys = F.regexp_extract_all(body, F.lit(_ID_PAIR), F.lit(1))
    values = F.transform(F.regexp_extract_all(body, F.lit(_ID_PAIR), F.lit(2)), unquoted)
    return F.map_from_arrays(keys, values)


def label(labels: Column, key: str) -> Column:
    """Value of one label; null when absent."""
    return F.try_element_at(labels, F.lit(key))


def label_match(labels: Column, match: Mapping[str, str] | None) -> Column:
    """True when every wanted pair is present; a missing label equals ``""``."""
    holds = F.lit(True)
    for key, want in (match or {}).items():
        holds = holds & (F.coalesce(label(labels, key), F.lit("")) == F.lit(want))
    return holds


def merge_labels(outer: Column, own: Column) -> Column:
    """Both maps together; on a shared key the sample's own label wins."""
    extra = F.map_filter(outer, lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(extra, own)


def with_label(labels: Column, key: str, value: Column) -> Column:
    """Labels with one pair added or replaced."""
    rest = F.map_filter(labels, lambda k, _: k != F.lit(key))
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def split_name(labels: Column) -> tuple[Column, Column]:
    """The ``__name__`` entry and the remaining labels."""
    return label(labels, "__name__"), F.map_filter(labels, lambda k, _: k != F.lit("__name__"))


def metric_labels(name: Column, labels: Column) -> Column:
    """Labels with the metric name merged in as ``__name__``."""
    return with_label(labels, "__name__", name)


def _plain_pairs(labels: Column) -> Column:
    entries = F.filter(sorted_entries(labels), lambda e: e["key"] != F.lit("__name__"))
    return F.concat_ws(",", F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def label_for(labels: Column, name: Column, prefer: str | None = None) -> Column:
    """Legend text: the preferred label, else ``k=v,...``, else the name, else ``value``."""
    pairs = _plain_pairs(labels)
    text = F.coalesce(F.when(pairs != "", pairs), F.when(name != "", name), F.lit("value"))
    return F.coalesce(label(labels, prefer), text) if prefer else text


def label_suffix(labels: Column) -> Column:
    """``{k=v,...}`` in key order; nothing for an unlabelled series."""
    pairs = F.transform(sorted_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.coalesce(F.size(F.map_keys(labels)), F.lit(0)) <= 0, F.lit("")).otherwise(
        F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))
    )


def labels_json(labels: Column) -> Column:
    """Labels as a JSON object with sorted keys; ``{}`` and never null."""
    ordered = F.map_from_entries(sorted_entries(labels))
    return F.coalesce(json_text(F.to_json(ordered)), F.lit("{}"))


def short_memory_name(name: Column) -> Column:
    """Display form of a memory metric: prefix and unit suffix removed."""
    return F.regexp_replace(F.replace(name, F.lit("node_memory_"), F.lit("")), "_bytes$", "")
