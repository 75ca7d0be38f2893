"""Alert rules over samples: conditions, hysteresis, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.functions.numbers import OPERATORS, compare_op
from sparktide.functions.times import duration_seconds
from sparktide.plans.guard import MAX_BROADCAST_ROWS, broadcast_if
from sparktide.plans.slices import SLICE_SECONDS, slice_window, with_slice, with_time_before
from sparktide.schema import NOTIFIERS, RULES

# Severities, condition kinds, notifier kinds.
SEVERITIES = ("info", "warning", "critical")
CONDITIONS = ("threshold", "rate_of_change", "anomaly")
NOTIFIER_TYPES = ("webhook", "slack")
DEFAULT_SEVERITY = "warning"


@dataclass(frozen=True)
class RuleSet:
    """Validated rules as a table, with what the planner may know about them."""

    table: DataFrame
    count: int
    metrics: tuple[str, ...]
    windows_s: tuple[float, ...]
    kinds: tuple[str, ...]
    silences_s: tuple[float, ...] = ()

    def hinted(self) -> DataFrame:
        return broadcast_if(self.table, self.count)


@dataclass(frozen=True)
class NotifierSet:
    """Validated notifiers as a table, with their names."""

    table: DataFrame
    names: tuple[str, ...]


def _seconds(value) -> float:
    return duration_seconds(value) if isinstance(value, str) else float(value or 0)


def check_notifiers(notifiers: Iterable[Mapping]) -> list[str]:
    """Problems with notifier settings, as messages."""
    errors, seen = [], set()
    for i, n in enumerate(notifiers):
        name = n.get("notifier") or ""
        if not name:
            errors.append(f"notifiers[{i}]: name is required")
        elif name in seen:
            errors.append(f"notifiers[{i}]: duplicate name {name!r}")
        seen.add(name)
        if n.get("type") not in NOTIFIER_TYPES:
            errors.append(f"notifiers[{i}] ({name}): type must be one of {NOTIFIER_TYPES}")
    return errors


def check_rule(rule: Mapping, notifier_names: set[str] | None, scoring: bool) -> list[str]:
    """Problems with one rule, as messages."""
    name, kind = rule.get("rule") or "", rule.get("cond_type")
    errors = []
    if not name:
        errors.append("rule name is required")
    if not rule.get("metric"):
        errors.append(f"{name}: metric is required")
    if _seconds(rule.get("for_s")) < 0:
        errors.append(f"{name}: for must not be negative")
    if _seconds(rule.get("silent_s")) < 0:
        errors.append(f"{name}: silent must not be negative")
    if (rule.get("severity") or DEFAULT_SEVERITY) not in SEVERITIES:
        errors.append(f"{name}: severity must be one of {SEVERITIES}")
    if kind not in CONDITIONS and kind not in CONDITION_COLUMNS:
        errors.append(f"{name}: unknown condition type {kind!r}")
    if kind in ("threshold", "rate_of_change") and rule.get("operator") not in OPERATORS:
        errors.append(f"{name}: operator must be one of {OPERATORS}")
    if kind == "rate_of_change" and _seconds(rule.get("window_s")) <= 0:
        errors.append(f"{name}: window must be positive for rate_of_change")
    if kind == "anomaly" and not scoring:
        errors.append(f"{name}: an anomaly rule needs scored samples")
    if notifier_names is not None:
        errors += [f"{name}: unknown notifier {n!r}" for n in rule.get("notify") or [] if n not in notifier_names]
    return errors


def load_notifiers(spark: SparkSession, notifiers: Iterable[Mapping]) -> NotifierSet:
    """Check notifier settings and turn them into a :class:`NotifierSet`."""
    notifiers = list(notifiers)
    errors = check_notifiers(notifiers)
    if errors:
        raise ValueError("; ".join(errors))
    table = spark.createDataFrame([(n["notifier"], n["type"]) for n in notifiers], NOTIFIERS)
    return NotifierSet(table, tuple(n["notifier"] for n in notifiers))


def load_rules(
    spark: SparkSession,
    rules: Iterable[Mapping],
    *,
    notifiers: Iterable[str] | None = None,
    scoring: bool = True,
) -> RuleSet:
    """Check rule settings and turn them into a :class:`RuleSet`.

    ``silent_s`` of a rule, if any, is how long a series may send nothing before
    its alert resolves; without it an alert of a silent series stays.  All
    problems are reported together in one ValueError.
    """
    rules = list(rules)
    names = set(notifiers) if notifiers is not None else None
    errors = [e for r in rules for e in check_rule(r, names, scoring)]
    if errors:
        raise ValueError("; ".join(errors))
    rows = [
        (
            r["rule"], r["metric"], dict(r.get("labels") or {}), r["cond_type"], r.get("operator"),
            None if r.get("threshold") is None else float(r["threshold"]), _seconds(r.get("window_s")),
            _seconds(r.get("for_s")), r.get("severity") or DEFAULT_SEVERITY, list(r.get("notify") or []), _seconds(r.get("silent_s")),
        )
        for r in rules
    ]
    return RuleSet(
        table=spark.createDataFrame(rows, RULES),
        count=len(rows),
        metrics=tuple(sorted({r[1] for r in rows})),
        windows_s=tuple(sorted({r[6] for r in rows if r[3] == "rate_of_change"})),
        kinds=tuple(sorted({r[3] for r in rows})),
        silences_s=tuple(sorted({r[10] for r in rows if r[10] > 0})),
    )


#: Most rules that one table may hold; rules are settings that people write.
MAX_RULES = 100_000


def rules_from(table: DataFrame, **options) -> RuleSet:
    """Rules kept in a table with the columns of a rule; missing columns have their defaults, durations may be text.

    Rules are settings: more than ``MAX_RULES`` rows are refused, not read.
    """
    rows = table.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return load_rules(table.sparkSession, [r.asDict(recursive=True) for r in rows], **options)


def match_rules(samples: DataFrame, rules: RuleSet, *, early: bool = True) -> DataFrame:
    """Every (sample, rule) pair where the metric is equal and the rule's labels are on the sample.

    A few rules are broadcast, and their metric names filter the scan.  Many
    meet the samples in a shuffle join, whose hot names adaptive execution splits.
    Without ``early`` all names are read, as a stream needs whose watermark is to
    follow the samples of all series.
    """
    if early and rules.count <= MAX_BROADCAST_ROWS:
        samples = samples.where(F.col("name").isin(*rules.metrics))
    carries = F.forall(
        F.map_keys("rule_labels"),
        lambda k: F.coalesce(F.try_element_at("labels", k), F.lit("")) == F.try_element_at("rule_labels", k),
    )
    return samples.join(rules.hinted(), (F.col("name") == F.col("metric")) & carries).drop("metric")


def rate_of_change(
    samples: DataFrame,
    window_s: float | Column,
    keys: Sequence[str] = ("series_id",),
    *,
    longest_s: float | None = None,
    slice_s: int | None = None,
) -> DataFrame:
    """Add ``rate``: (value - oldest value in the window) / elapsed seconds.

    The window ends at the sample and includes its lower end; without elapsed
    time the rate is null.  ``window_s`` may be a column (then give
    ``longest_s``), so rules with different windows share one pass.

    A sliding frame would be walked again for every row.  Instead each sample is
    sent twice: as a candidate at its own time and as a probe at the lower end
    of its window.  Read from late to early, the last candidate seen at a probe
    is the oldest sample in its window.
    """
    if longest_s is None:
        longest_s = float(window_s)
    width = slice_s or max(SLICE_SECONDS, 4 * (int(longest_s) + 1))
    window = F.lit(float(window_s)) if not isinstance(window_s, Column) else window_s
    columns = samples.columns
    rows = with_time_before(samples, F.ceil(window) + 1, width).withColumn("_us", F.unix_micros("ts"))
    candidate = F.struct(F.lit(0).alias("kind"), F.col("_us").alias("at"))
    probe = F.struct(F.lit(1).alias("kind"), (F.col("_us") - F.round(window * 1e6).cast("long")).alias("at"))
    both = F.when(F.col("is_context"), F.array(candidate)).otherwise(F.array(candidate, probe))
    sent = rows.withColumn("_e", F.explode(both)).select(
        *keys, "slice", F.col("_e.kind").alias("_kind"), F.col("_e.at").alias("_at"), F.col("seq").alias("_seq"),
        F.when(F.col("_e.kind") == 0, F.struct("_us", "value")).alias("_old"),
        F.when(F.col("_e.kind") == 1, F.struct(*columns, "_us")).alias("_row"),
    )
    late_first = (
        Window.partitionBy(*keys, "slice").orderBy(F.col("_at").desc(), "_kind", F.col("_seq").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = sent.withColumn("_oldest", F.last("_old", ignorenulls=True).over(late_first)).where(F.col("_kind") == 1)
    gone = (F.col("_row._us") - F.col("_oldest._us")) / 1e6
    rate = F.when(gone > 0, (F.col("_row.value") - F.col("_oldest.value")) / gone)
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in columns], rate.alias("rate"))


# Condition kinds a caller adds: name -> function giving a boolean column over
# the matched row (sample columns plus rule columns).
CONDITION_COLUMNS: dict[str, Callable[[], Column]] = {}


def register_condition(cond_type: str, holds: Callable[[], Column]) -> None:
    """Make a further condition kind usable in rules."""
    if cond_type in CONDITIONS:
        raise ValueError(f"{cond_type} is built in")
    CONDITION_COLUMNS[cond_type] = holds


def alert_holds(rate: Column | None = None) -> Column:
    """Whether the row's rule condition holds for the row's sample."""
    rate = F.lit(None).cast("double") if rate is None else rate
    test = (
        F.when(F.col("cond_type") == "threshold", compare_op(F.col("operator"), F.col("value"), F.col("threshold")))
        .when(
            F.col("cond_type") == "rate_of_change",
            rate.isNotNull() & compare_op(F.col("operator"), rate, F.col("threshold")),
        )
        .when(F.col("cond_type") == "anomaly", F.col("anomalous"))
    )
    for kind, holds in CONDITION_COLUMNS.items():
        test = test.when(F.col("cond_type") == kind, holds())
    return F.coalesce(test, F.lit(False))


def evaluate_rules(samples: DataFrame, rules: RuleSet) -> DataFrame:
    """Matched samples with ``holds``, the outcome of their rule's condition."""
    matched = match_rules(samples, rules)
    by_rate = F.col("cond_type") == "rate_of_change"
    parts = []
    if set(rules.kinds) - {"rate_of_change"}:
        parts.append(matched.where(~by_rate).withColumn("rate", F.lit(None).cast("double")))
    if rules.windows_s:
        rated = rate_of_change(
            matched.where(by_rate), F.col("window_s"), ["rule", "series_id"], longest_s=rules.windows_s[-1]
        )
        parts.append(rated)
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("holds", alert_holds(F.col("rate")))


def with_silences(evaluated: DataFrame, until: datetime | Column | None = None, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """Evaluated samples and, where a series then sends nothing for its rule's ``silent_s``, a row that ends the run.

    That row stands ``silent_s`` after the last sample, with its value, and does
    not hold.  After the last sample of all it is added if ``until``, the time
    up to which the samples are complete, has come that far.  The next sample of
    a slice's last one is known from a table with one row per slice.
    """
    keys = ["rule", "series_id"]
    rows = with_slice(evaluated.where(F.col("silent_s") > 0), slice_s).where(F.col("slice").isNotNull())
    w = slice_window(keys, ["ts", "seq"])
    firsts = rows.groupBy(*keys, "slice").agg(F.min("ts").alias("_first"))
    later = firsts.select(*keys, "slice", F.lead("_first").over(Window.partitionBy(*keys).orderBy("slice")).alias("_later"))
    ends = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("silent_s") * 1e6).cast("long"))
    known = F.lit(None).cast("timestamp") if until is None else until if isinstance(until, Column) else F.lit(until).cast("timestamp")
    silent = (
        rows.withColumn("_after", F.lead("ts").over(w)).join(later, [*keys, "slice"])
        .withColumn("_after", F.coalesce("_after", "_later"))
        .withColumn("ts", ends)
        .where(F.coalesce(F.col("_after") > F.col("ts"), F.col("ts") <= known, F.lit(False)))
        .withColumn("holds", F.lit(False))
    )
    return evaluated.unionByName(silent.select(*evaluated.columns))


def alert_states(evaluated: DataFrame, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """Per evaluated sample: pending-since, firing now, firing before.

    A run is a stretch of holding samples; it is pending since its first sample
    and fires once it has lasted ``for_s``.  Samples are taken in (ts, seq)
    order.  Each slice is worked on alone; a small table with one row per slice
    then says how the slice before it ended and when a run still open at that
    point began.  Both readings use the same shuffled rows.
    """
    keys = ["rule", "series_id"]
    # both readings need the same columns and filters, or Spark would shuffle twice
    needed = evaluated.select(*keys, "ts", "seq", "holds", "value", "for_s")
    rows = with_slice(needed, slice_s).where(F.col("slice").isNotNull()).withColumn("_us", F.unix_micros("ts"))
    w = slice_window(keys, ["ts", "seq"])
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # "open": the slice begins with it, so it may continue an earlier run
    begins = F.when(
        F.col("holds") & ~F.coalesce("_was", F.lit(False)), F.struct(F.col("_us").alias("us"), F.col("_was").isNull().alias("open"))
    )
    stepped = (
        rows.withColumn("_was", F.lag("holds").over(w)).withColumn("_was_us", F.lag("_us").over(w))
        .withColumn("_begins", begins)
        .withColumn("_run", F.last("_begins", ignorenulls=True).over(so_far))
        .withColumn("_was_run", F.lag("_run").over(w))
    )

    ends = stepped.groupBy(*keys, "slice").agg(
        F.max(F.struct("ts", "seq", "holds", "_us", "value", "for_s")).alias("_end"),
        F.max(F.when(~F.col("_begins.open"), F.col("_begins.us"))).alias("_inner"),
        F.max(F.when(F.col("_begins.open"), F.col("_begins.us"))).alias("_outer"),
    )
    in_turn = Window.partitionBy(*keys).orderBy("slice")
    before = F.lag("_end").over(in_turn)
    began = F.coalesce("_inner", F.when(~F.coalesce("_was_end", F.lit(False)), F.col("_outer")))
    openings = (
        ends.withColumn("_was_end", before["holds"]).withColumn("_was_end_us", before["_us"])
        .withColumn("_began", began)
        .select(
            *keys, "slice", "_was_end", "_was_end_us",
            F.max("_began").over(in_turn.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        )
    )

    def since(run: str):
        continued = F.col(f"{run}.open") & F.coalesce("_was_end", F.lit(False))
        return F.when(continued, F.col("_carry")).otherwise(F.col(f"{run}.us"))

    wait = F.round(F.col("for_s") * 1e6).cast("long")
    first = F.col("_was").isNull()
    was = F.when(first, F.col("_was_end")).otherwise(F.col("_was"))
    was_us = F.when(first, F.col("_was_end_us")).otherwise(F.col("_was_us"))
    was_since = F.when(first, F.col("_carry")).otherwise(since("_was_run"))
    return stepped.join(openings, [*keys, "slice"]).select(
        *keys, "ts", "seq", "value", "holds",
        F.when(F.col("holds"), F.timestamp_micros(since("_run"))).alias("pending"),
        F.coalesce(F.col("holds") & (F.col("_us") - since("_run") >= wait), F.lit(False)).alias("firing"),
        F.coalesce(was & (was_us - was_since >= wait), F.lit(False)).alias("was_firing"),
    )


def _described(rows: DataFrame, rules: RuleSet) -> DataFrame:
    """Metric, severity and notifiers of the row's rule, and the series' labels."""
    about = broadcast_if(rules.table.select("rule", "metric", "severity", "notify"), rules.count)
    return rows.join(about, "rule").withColumn("labels", labels_of(F.col("series_id")))


def alert_events(evaluated: DataFrame, rules: RuleSet, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """One row when an alert starts firing and one when it resolves.

    ``since`` is the start of the run for a firing event and the sample's own
    time for a resolved one.
    """
    turned = alert_states(evaluated, slice_s).where(F.col("firing") != F.col("was_firing"))
    return _described(turned, rules).select(
        "rule", "metric", "labels", "series_id", "severity", "value",
        F.when(F.col("firing"), F.col("pending")).otherwise(F.col("ts")).alias("since"),
        F.col("ts").alias("at"), "firing", "notify",
    )


def firing_alerts(evaluated: DataFrame, rules: RuleSet, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """Alerts firing after the last sample, longest-firing first."""
    now = alert_states(evaluated, slice_s).groupBy("rule", "series_id").agg(
        F.max(F.struct("ts", "seq", "firing", "pending", "value")).alias("s")
    )
    firing = now.where(F.col("s.firing")).select(
        "rule", "series_id", F.col("s.value").alias("value"), F.col("s.pending").alias("since"), F.lit(True).alias("firing")
    )
    return _described(firing, rules).select(
        "rule", "metric", "labels", "series_id", "severity", "value", "since", "firing"
    ).orderBy("since", "rule", "series_id")


def route_alerts(events: DataFrame, notifiers: NotifierSet) -> DataFrame:
    """One row per (event, notifier): the named ones, or all when none is named.

    Unknown names are skipped.
    """
    everyone = F.array(*[F.lit(n) for n in notifiers.names]).cast("array<string>")
    chosen = F.when(F.size("notify") > 0, F.array_distinct("notify")).otherwise(everyone)
    sent = events.withColumn("notifier", F.explode(chosen))
    return sent.join(broadcast_if(notifiers.table, len(notifiers.names)), "notifier")
