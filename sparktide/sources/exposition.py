"""Captured text-exposition bodies to samples.

Input: one row per scrape with ``target``, ``scrape_ts``, ``target_labels``,
``interval_s`` and ``body``, plus ``status`` if the HTTP code was kept.  A body
is taken whole or not at all.  Bodies are split and checked inside one row and
exploded afterwards, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.binding import let
from sparktide.functions.labels import empty_labels, merge_labels, with_label
from sparktide.functions.numbers import format_float

# The exposition format.
NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
LABEL = r"[a-zA-Z_][a-zA-Z0-9_]*"
TEXT = r'"[^"\\]*+(?:\\[\\"n][^"\\]*+)*+"'
PAIR = rf"{LABEL}\s*=\s*{TEXT}"
LABELS = rf"\{{\s*(?:{PAIR}(?:\s*,\s*{PAIR})*+\s*,?\s*)?\}}"
NUMBER = r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|[iI]nf(?:inity)?|[nN]a[nN])"
SAMPLE_LINE = rf"^({NAME})(?:[ \t]*({LABELS})[ \t]*|[ \t]+)({NUMBER})(?:[ \t]+(-?\d+))?[ \t]*$"
ABOUT_LINE = rf"^#[ \t]+(TYPE|HELP)[ \t]+({NAME})(?:[ \t]+(.*))?$"
ANY_TYPE_LINE = r"^#[ \t]+TYPE[ \t]"
TYPES = ("counter", "gauge", "histogram", "summary", "untyped")

_CUT = "\u0001"


def _lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")


def _about(lines: Column) -> Column:
    """Kind, name, type and place of the lines that describe a family; a malformed type line has no type."""
    def fields(x: Column) -> Column:
        def taken(p: Column) -> Column:
            kind = F.when(F.size(p) > 2, F.get(p, F.lit(0))).when(x["text"].rlike(ANY_TYPE_LINE), F.lit("TYPE"))
            return F.struct(kind.alias("kind"), F.get(p, F.lit(1)).alias("name"), F.lower(F.get(p, F.lit(2))).alias("type"), x["at"].alias("at"))

        return let(F.split(F.regexp_replace(x["text"], ABOUT_LINE, f"$1{_CUT}$2{_CUT}$3"), _CUT), taken)

    return F.transform(F.filter(lines, lambda x: x["text"].startswith("#")), fields)


#: Widths of a binary search, as many as an array can need.
_STEPS = [1 << k for k in range(30, -1, -1)]

#: So many families are looked up in a map, which goes through its keys; that takes less time than a search by halves.
_FEW = 64


def _with_search(rows: Column, then: Callable[[Callable[[Column], Column]], Column], *, unique: bool = False) -> Column:
    """``then(find)``, where ``find`` gives the last of the sorted rows that have a name, null without any.

    A binary search, so its cost hardly grows with the rows.  With ``unique``
    names a few rows are a map; if a name is there twice nothing is found.  All
    it needs is bound once a body: a plain column would be put in place of its
    name by the optimizer, and worked out again for every line.
    """
    def search(ordered: Column, p: Column) -> Callable[[Column], Column]:
        names, steps = p["names"], p["steps"]

        def find(name: Column) -> Column:
            def forward(at: Column, step: Column) -> Column:
                return F.when((at + step <= F.size(names)) & (F.get(names, at + step - 1) <= name), at + step).otherwise(at)

            found = let(F.get(ordered, F.aggregate(steps, F.lit(0), forward) - 1), lambda f: F.when(f["name"] == name, f))
            return F.when(steps.isNull(), F.try_element_at(p["map"], name)).otherwise(found) if unique else found

        return find

    def parts(ordered: Column) -> Column:
        names = ordered["name"]
        steps = F.filter(F.array(*[F.lit(n) for n in _STEPS]), lambda n: n <= F.size(names))
        if not unique:
            return F.struct(names.alias("names"), steps.alias("steps"))
        few = F.size(names) <= _FEW
        table = F.when(few & ~_repeats(names), F.map_from_arrays(names, ordered))
        return F.struct(names.alias("names"), F.when(~few, steps).alias("steps"), table.alias("map"))

    return let(F.sort_array(rows), lambda f: let(parts(f), lambda p: then(search(f, p))))


def _with_families(typed: Column, then: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``then(family)``, where ``family`` gives the type line of a name; a body with two for one name is not taken anyway."""
    rows = F.transform(typed, lambda t: F.struct(F.coalesce(t["name"], F.lit("")).alias("name"), t["type"].alias("type"), t["at"].alias("at")))
    return _with_search(rows, then, unique=True)


def _label_keys(pairs: Column) -> Column:
    return F.regexp_extract_all(pairs, F.lit(rf"({LABEL})\s*=\s*{TEXT}"), F.lit(1))


def _repeats(array: Column) -> Column:
    return F.size(F.array_distinct(array)) < F.size(array)


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda x, i: F.struct(x.alias("text"), i.alias("at")))


def _cut_line(line: Column) -> Column:
    """Name, label text, label names, value and stamp of a sample line.

    One regular expression both checks and splits the line; a malformed line
    has no value.
    """
    parts = F.split(F.regexp_replace(line, SAMPLE_LINE, f"$1{_CUT}$2{_CUT}$3{_CUT}$4"), _CUT)
    # a line that has the cut mark in it already is taken apart group by group
    groups = F.when(line.rlike(SAMPLE_LINE), F.array(*[F.regexp_extract(line, SAMPLE_LINE, i) for i in range(1, 5)]))
    parts = F.when(line.contains(_CUT), groups).otherwise(parts)

    def fields(p: Column) -> Column:
        pairs = F.get(p, F.lit(1))
        keys = F.when(F.length(pairs) > 2, _label_keys(pairs)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.get(p, F.lit(0)).alias("name"), pairs.alias("pairs"), keys.alias("keys"),
            F.get(p, F.lit(2)).alias("value"), F.get(p, F.lit(3)).alias("stamp"),
        )

    return let(parts, fields)


def checked_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies with ``checked``: their cut ``samples``, the lines ``missing`` and whether the whole body can be taken (``ok``).

    Each line is looked at once; a sample finds the family it is a ``part`` of
    in the sorted list of the body's type lines.
    """
    body = F.coalesce("body", F.lit(""))

    def sample(x: Column, family: Callable[[Column], Column]) -> Column:
        def told(c: Column, own: Column) -> Column:
            name = c["name"]

            def belongs(end: str) -> Column:
                """Type of the family that a name with this end is a component of."""
                return F.when(name.endswith(end), family(F.left(name, F.length(name) - len(end)))["type"])

            part = (
                F.when(belongs("_bucket") == "histogram", F.lit("bucket"))
                .when(belongs("_count").isin("histogram", "summary"), F.lit("count"))
                .when(belongs("_sum").isin("histogram", "summary"), F.lit("sum"))
                .when(own["type"] == "summary", F.lit("quantile"))
                .when(own["type"] == "histogram", F.lit("bare"))
                .otherwise(F.lit("plain"))
            )
            return F.struct(c.alias("line"), part.alias("part"), F.coalesce(own["at"] > x["at"], F.lit(False)).alias("early"))

        return let(_cut_line(x["text"]), lambda c: let(family(c["name"]), lambda own: told(c, own)))

    def of_kind(about: Column, kind: str) -> Column:
        return F.filter(about, lambda x: x["kind"] == kind)["name"]

    def judged(typed: Column, about: Column, samples: Column) -> Column:
        ok = (
            ((body == "") | body.endswith("\n"))
            & F.forall(typed, lambda t: F.coalesce(t["type"], F.lit("")).isin(*TYPES))
            & ~_repeats(of_kind(about, "TYPE"))
            & ~_repeats(of_kind(about, "HELP"))
            & F.forall(samples, lambda s: s["line"]["value"].isNotNull() & ~_repeats(s["line"]["keys"]) & ~s["early"])
        )
        if "status" in bodies.columns:
            ok = ok & (F.col("status") == 200)
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), samples.alias("samples"), _missing(samples).alias("missing"))

    def of_body(lines: Column) -> Column:
        plain = F.filter(lines, lambda x: ~x["text"].startswith("#"))
        return let(_about(lines), lambda about: let(F.filter(about, lambda x: x["kind"] == "TYPE"), lambda typed: let(
            _with_families(typed, lambda family: F.transform(plain, lambda x: sample(x, family))), lambda samples: judged(typed, about, samples)
        )))

    # one expression that binds what it uses again; as columns the optimizer would work the parts out once for each use
    return bodies.withColumn("checked", let(_numbered(_lines(body)), of_body))


def exposition_rejects(bodies: DataFrame) -> DataFrame:
    """Scrapes whose body is invalid or whose status is not 200."""
    checked = checked_bodies(bodies).select(*bodies.columns, F.explode(F.when(~F.col("checked.ok"), F.array(F.lit(1)))).alias("_one"))
    return checked.drop("_one")


#: How many characters the end of a component's name has.
_ENDS = {"bucket": 7, "count": 6, "sum": 4}


def _missing(samples: Column) -> Column:
    """Lines of value 0 for the sums and counts that histograms and summaries of a body lack, one for each of their label sets."""
    def component(s: Column) -> Column:
        line = s["line"]
        cut = F.when(s["part"] == "bucket", F.lit(_ENDS["bucket"])).when(s["part"] == "count", F.lit(_ENDS["count"])).when(s["part"] == "sum", F.lit(_ENDS["sum"])).otherwise(F.lit(0))
        pairs = F.when(F.size(line["keys"]) > 0, F.zip_with(line["keys"], _label_values(line["pairs"]), lambda k, v: F.struct(k.alias("k"), v.alias("v"))))
        own = F.sort_array(F.filter(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")), lambda p: ~p["k"].isin("le", "quantile")))
        some = F.concat(F.lit("{"), F.concat_ws(",", F.transform(own, lambda p: F.concat(p["k"], F.lit('="'), p["v"], F.lit('"')))), F.lit("}"))
        # most have no label but the one that tells components apart
        bare = (F.size(line["keys"]) == 0) | ((F.size(line["keys"]) == 1) & F.get(line["keys"], F.lit(0)).isin("le", "quantile"))
        text = F.when(bare, F.lit("{}")).otherwise(some)
        return F.struct(
            F.concat(F.left(line["name"], F.length(line["name"]) - cut), F.lit(_CUT), text).alias("name"), line["stamp"].alias("stamp"), s["part"].alias("part"),
        )

    def zeros(keys: Column, part: str, last: Callable[[Column], Column]) -> Column:
        def zero(key: Column) -> Column:
            text = F.substring_index(key, _CUT, -1)
            line = F.struct(
                F.concat(F.substring_index(key, _CUT, 1), F.lit(f"_{part}")).alias("name"), text.alias("pairs"), _label_keys(text).alias("keys"),
                F.lit("0").alias("value"), last(key)["stamp"].alias("stamp"),
            )
            return F.struct(line.alias("line"), F.lit(part).alias("part"), F.lit(False).alias("early"))

        return F.transform(keys, zero)

    def lacking(found: Column) -> Column:
        def gone(part: str) -> Column:
            return F.array_except(F.array_distinct(found["name"]), F.filter(found, lambda c: c["part"] == part)["name"])

        return F.struct(gone("sum").alias("sum"), gone("count").alias("count"))

    def lines(found: Column, gone: Column) -> Column:
        stamps = F.transform(found, lambda c: F.struct(c["name"].alias("name"), c["stamp"].alias("stamp")))
        some = _with_search(stamps, lambda last: F.concat(zeros(gone["sum"], "sum", last), zeros(gone["count"], "count", last)))
        # most bodies lack none and need no search
        return F.when(F.size(gone["sum"]) + F.size(gone["count"]) > 0, some).otherwise(F.slice(samples, 1, 0))

    components = F.transform(F.filter(samples, lambda s: s["part"] != "plain"), component)
    return let(components, lambda found: let(lacking(found), lambda gone: lines(found, gone)))


def _unescape(text: Column) -> Column:
    mark = "\u0000"
    out = F.replace(text, F.lit("\\\\"), F.lit(mark))
    out = F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.when(text.contains("\\"), F.replace(out, F.lit(mark), F.lit("\\"))).otherwise(text)


def _label_values(pairs: Column) -> Column:
    return F.regexp_extract_all(pairs, F.lit(rf'{LABEL}\s*=\s*"([^"\\]*+(?:\\[\\"n][^"\\]*+)*+)"'), F.lit(1))


def _label_map(keys: Column, pairs: Column) -> Column:
    return F.when(F.size(keys) > 0, F.map_from_arrays(keys, F.transform(_label_values(pairs), _unescape))).otherwise(empty_labels())


def flatten_families(lines: DataFrame) -> DataFrame:
    """Give component rows of histograms and summaries their normal form.

    The text already has one line per component.  Bucket bounds and quantiles
    are rewritten in normal number text, counts cut to whole numbers.  Needs
    ``name``, ``labels``, ``value`` and ``part`` (bucket, count, quantile or plain).
    """
    part = F.col("part")
    told = F.when(part == "bucket", F.try_element_at("labels", F.lit("le"))).when(part == "quantile", F.try_element_at("labels", F.lit("quantile")))

    def bound(text: Column) -> Column:
        # a text is read once; reading "+Inf" costs the JVM an exception
        return F.when(text == "+Inf", text).otherwise(let(text.try_cast("double"), format_float))

    return lines.withColumn("_told", told).withColumn("_told", bound(F.col("_told"))).withColumn(
        "labels",
        F.when(part == "bucket", with_label(F.col("labels"), "le", F.col("_told")))
        .when(part == "quantile", with_label(F.col("labels"), "quantile", F.col("_told"))).otherwise(F.col("labels")),
    ).withColumn("value", F.when(part.isin("bucket", "count"), F.floor("value").cast("double")).otherwise(F.col("value"))).drop("_told")


def parse_exposition(bodies: DataFrame) -> DataFrame:
    """Samples of all valid bodies.

    The time is the line's own millisecond stamp or the scrape time; target
    labels are merged under the line's own.  A histogram or summary without its
    sum or count has one of 0.
    """
    checked = checked_bodies(bodies)
    # a rejected body explodes to nothing; filtering it away would check it twice
    taken = F.when(F.col("checked.ok"), F.concat("checked.samples", "checked.missing"))
    rows = checked.select(
        "target", "scrape_ts", F.coalesce("target_labels", empty_labels()).alias("target_labels"), "interval_s",
        F.explode(taken).alias("l"),
    ).select("target", "scrape_ts", "target_labels", "interval_s", "l.part", "l.line.*")
    own = _label_map(F.col("keys"), F.col("pairs"))
    parsed = rows.select(
        "target", "interval_s", "part", "name", own.alias("own"), "target_labels",
        F.col("value").try_cast("double").alias("value"),
        F.coalesce(F.timestamp_millis(F.when(F.col("stamp") != "", F.col("stamp")).try_cast("long")), F.col("scrape_ts")).alias("ts"),
        # components without the label that tells them apart carry no reading, nor does a histogram's bare name
        F.when(F.col("part") == "quantile", F.array_contains("keys", "quantile"))
        .when(F.col("part") == "bucket", F.array_contains("keys", "le")).otherwise(F.col("part") != "bare").alias("usable"),
    ).where("usable")
    merged = parsed.withColumn(
        "labels", F.when(F.size("own") == 0, F.col("target_labels")).otherwise(merge_labels(F.col("target_labels"), F.col("own")))
    )
    return flatten_families(merged).select("target", "name", "labels", "ts", "value", "interval_s")
