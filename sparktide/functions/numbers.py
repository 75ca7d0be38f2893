"""Number helpers: comparison, clipping, text forms and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktide.functions.binding import let

# The comparison operators rules may use.
OPERATORS = (">", "<", ">=", "<=", "==", "!=")


def compare_op(op: Column, left: Column, right: Column) -> Column:
    """``left op right`` with IEEE rules: NaN satisfies only ``!=``.

    An unknown operator, or a null operand, is false.
    """
    nan = F.isnan(left) | F.isnan(right)
    test = (
        F.when(op == ">", ~nan & (left > right))
        .when(op == "<", ~nan & (left < right))
        .when(op == ">=", ~nan & (left >= right))
        .when(op == "<=", ~nan & (left <= right))
        .when(op == "==", ~nan & (left == right))
        .when(op == "!=", nan | (left != right))
    )
    return F.coalesce(test, F.lit(False))


def clip_pct(x: Column) -> Column:
    """Clamp to the range of a percentage."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def format_float(value: Column) -> Column:
    """Shortest text of a double: plain below 1e6, else ``d.ddde+XX``.

    Plain notation is used while the decimal exponent lies in [-4, 6); the
    exponent has two digits at least.
    """
    def shortest(v: Column) -> Column:
        # the JVM may print more digits than are needed to read the number back
        java = v.cast("string")
        best = F.lower(java)
        for digits in (17, 16):
            text = F.format_string(f"%.{digits - 1}e", v)
            best = F.when((F.length(java) >= 18) & (text.try_cast("double") == v), text).otherwise(best)
        return best

    def split(text: Column) -> Column:
        mantissa = F.split_part(text, F.lit("e"), F.lit(1))
        shift = F.coalesce(F.regexp_extract(text, r"e([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
        point = F.locate(".", mantissa) - 1
        padded = F.replace(mantissa, F.lit("."), F.lit(""))
        lead = F.length(F.regexp_extract(padded, "^0*", 0))
        digits = F.regexp_replace(padded, "^0+|0+$", "")
        return F.struct(digits.alias("digits"), (shift + point - 1 - lead).alias("exponent"))

    def written(p: Column) -> Column:
        digits, exponent, size = p["digits"], p["exponent"], F.length(p["digits"])
        plain = (
            F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
            .when(size <= exponent + 1, F.rpad(digits, exponent + 1, "0"))
            .otherwise(F.concat(
                F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, size)
            ))
        )
        science = F.concat(
            F.substring(digits, 1, 1), F.when(size > 1, F.lit(".")).otherwise(F.lit("")),
            F.substring(digits, F.lit(2), size), F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
            F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"),
        )
        return F.when((exponent < -4) | (exponent >= 6), science).otherwise(plain)

    java = value.cast("string")
    sign = F.when(java.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    # most values are printed right already, but for a trailing ".0"
    easy = (F.abs(value) >= 1e-3) & (F.abs(value) < 1e6) & (F.length(java) < 17)
    # whole numbers below 2^53 have their own digits as the shortest text
    count = F.abs(value).cast("long")
    whole = (F.abs(value) >= 1e6) & (F.abs(value) < 1e15) & (F.abs(value) == count)
    figures = F.rtrim(count.cast("string"), F.lit("0"))
    large = F.concat(
        sign, F.left(figures, F.lit(1)), F.when(F.length(figures) > 1, F.lit(".")).otherwise(F.lit("")), F.substring(figures, F.lit(2), F.length(figures)),
        F.lit("e+"), F.lpad((F.length(count.cast("string")) - 1).cast("string"), 2, "0"),
    )
    return (
        F.when(easy, F.when(java.endswith(".0"), F.substring_index(java, ".", 1)).otherwise(java))
        .when(whole, large)
        .when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("+Inf"))
        .when(value == float("-inf"), F.lit("-Inf"))
        .when(value == 0, F.concat(sign, F.lit("0")))
        .when(value.isNotNull(), F.concat(sign, let(let(shortest(F.abs(value)), split), written)))
    )


def format_bound(text: Column) -> Column:
    """Normal text of a bucket bound or quantile, e.g. ``1000000`` -> ``1e+06``."""
    return format_float(text.try_cast("double"))


# 1024-based unit letters, in order.
SIZE_UNITS = "KMGTPE"


def human_bytes(n: Column, *, decimals: int = 2, largest: str | None = None) -> Column:
    """Bytes as text.

    Two decimals: ``512B``, ``1.50KiB`` up to EiB.  One decimal (the dashboard
    form): ``512.0B``, ``1.5KiB`` up to GiB.  ``largest`` names the letter of
    another last unit.
    """
    compact = decimals == 1
    names = [""] + list(SIZE_UNITS[: SIZE_UNITS.index(largest or ("G" if compact else "E")) + 1])
    out = None
    for power, letter in enumerate(names):
        scaled = n / F.lit(float(1024 ** power))
        if power == 0:
            text = F.format_string("%.1fB" if compact else "%.0fB", scaled)
        else:
            # the long form rounds exact halves to even, the dashboard form up
            shown = scaled if compact else F.bround(scaled, decimals)
            text = F.format_string(f"%.{decimals}f{letter}iB", shown)
        last = power == len(names) - 1
        test = F.lit(True) if last else n < F.lit(float(1024 ** (power + 1)))
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def parse_human_bytes(text: Column) -> Column:
    """``1898G`` -> bytes (1024-based); null for anything else."""
    clean = F.trim(text)
    power = F.position(F.right(clean, F.lit(1)), F.lit(SIZE_UNITS))
    number = F.when(power > 0, F.left(clean, F.length(clean) - 1)).otherwise(clean)
    plain = (number != "") & (F.translate(number, "0123456789.", "") == "")
    return F.when(plain, number.try_cast("double") * F.pow(F.lit(1024.0), power))


def euclidean(a: Column, b: Column, dims: int | None = None) -> Column:
    """Euclidean distance of two arrays; ``dims`` unrolls the sum."""
    if dims is None:
        squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    total = F.lit(0.0)
    for i in range(dims):
        total = total + (a[i] - b[i]) * (a[i] - b[i])
    return F.sqrt(total)


def mean_distance(x: Column, c0: Column, c1: Column, dims: int | None = None) -> Column:
    """Mean of the distances to both centroids."""
    return (euclidean(x, c0, dims) + euclidean(x, c1, dims)) / 2


def anomaly_score(distance: Column, min_dist: Column, max_dist: Column) -> Column:
    """Min-max scaled distance in [0, 100]; 0 when the training range is a point.

    The absolute value makes a vector nearer than the training minimum score too.
    """
    span = max_dist - min_dist
    scaled = F.abs((distance - min_dist) / F.when(span != 0, span)) * 100
    return F.when(max_dist == min_dist, F.lit(0.0)).otherwise(F.least(F.lit(100.0), scaled))
