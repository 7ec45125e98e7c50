"""Column expressions that turn raw text into typed, honest values.

Nothing here drops a row: unparseable input becomes null, and the row stays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that mean "no value" in published text files.
MISSING_TOKENS = ("", "na", "n/a", "null", "none", "nan")
# Survey sentinel codes for "not available".
JAM_VALUES = ("-666666666", "-999999999", "-888888888", "-222222222", "-333333333",
              "-555555555", "*", "**", "-")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- casts ----------------------------------------------------------------------------

def stage_typed(df: DataFrame, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{new_name: (source, type)}``: rename and try-cast, never filter."""
    return df.select(*[F.col(src).try_cast(kind).alias(new)
                       for new, (src, kind) in spec.items()])


def parse_grouped_number(c: str | Column) -> Column:
    """``'13,047'`` -> 13047; blank or garbage -> null."""
    return F.replace(col(c), F.lit(","), F.lit("")).try_cast("bigint")


def parse_us_date(c: str | Column) -> Column:
    return F.try_to_date(col(c), "M/d/yyyy")


def extract_label_date(c: str | Column) -> Column:
    """The date in ``X (1/1/2026)``; null when absent or impossible."""
    return F.try_to_date(
        F.regexp_extract(col(c), r"\((\d{1,2}/\d{1,2}/\d{4})\)", 1), "M/d/yyyy")


def null_if_jam(c: str | Column, jam: Sequence[str] = JAM_VALUES) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when((text == "") | text.isin(*jam), None).otherwise(text.try_cast("double"))


def is_missing(c: str | Column) -> Column:
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin(*MISSING_TOKENS), F.lit(True))


def coalesce_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0))


def normalise_digits(c: str | Column, length: int) -> Column:
    """The first ``length`` digits, leading zeros kept; null when there are fewer."""
    digits = F.regexp_replace(col(c).cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) >= length, F.substring(digits, 1, length))


def normalise_zip(c: str | Column) -> Column:
    return normalise_digits(c, 5)


# --- flags and codes --------------------------------------------------------------------

def status_flags(df: DataFrame, status: str, access: str, operational: Sequence[str] = ("E",),
                 public: Sequence[str] = ("public",)) -> DataFrame:
    """Flags next to the rows; rows are kept whatever their status."""
    is_op, is_pub = F.col(status).isin(*operational), F.col(access).isin(*public)
    return df.withColumns({"is_operational": is_op, "is_public": is_pub,
                           "is_public_operational": is_op & is_pub})


def decode_list_field(c: str | Column) -> Column:
    """A list written either as a JSON array or space-delimited, as array<string>."""
    text = F.trim(col(c))
    return (F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
            .when(text.startswith("["), F.from_json(text, "array<string>"))
            .otherwise(F.split(text, " ")))


def map_enum(c: str | Column, mapping: Mapping[str, str], default: str) -> Column:
    keys = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*keys), col(c)), F.lit(default))


def valid_positive(c: str | Column) -> Column:
    """The number when it is a usable measurement: parseable and above zero."""
    number = col(c).try_cast("double")
    return F.when(number > 0, number)


def is_zero_anomaly(c: str | Column) -> Column:
    return F.coalesce(col(c).try_cast("double") == 0, F.lit(False))


def stamp_provenance(df: DataFrame, computed_at: str, vintages: Mapping[str, str]) -> DataFrame:
    pairs = [F.lit(x) for kv in sorted(vintages.items()) for x in kv]
    return df.withColumns({
        "computed_at": F.lit(computed_at),
        "source_vintages": F.to_json(F.create_map(*pairs)) if pairs else F.lit("{}")})


def normalise_taxonomy(df: DataFrame, raw: str, table: DataFrame) -> DataFrame:
    """``table(raw, normalised, display, family)``; unknown codes pass through.

    The taxonomy is a declared reference table; AQE broadcasts it when it is small.
    """
    ref = table.select(F.col("raw").alias(raw), "normalised", "display", "family")
    joined = df.join(ref, raw, "left")
    return joined.withColumns({
        "normalised": F.coalesce("normalised", raw),
        "display": F.coalesce("display", raw),
        "family": F.coalesce("family", F.lit("unknown"))})


# --- wide measures ------------------------------------------------------------------------

def unpivot_measures(df: DataFrame, ids: Sequence[str],
                     measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Wide (count, power) column pairs to one row per name; zero counts are kept."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("measure"),
                 F.coalesce(F.col(n).cast("int"), F.lit(0)).alias("n"),
                 F.col(p).cast("double").alias("power"))
        for name, (n, p) in measures.items()])
    return df.select(*ids, F.inline(rows)).withColumns({
        "has_reported": F.coalesce(F.col("power") > 0, F.lit(False)),
        "is_zero_anomaly": F.coalesce(F.col("power") == 0, F.lit(False))})


def connector_sum(counts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in counts])


def is_multi_interface(counts: Sequence[str], ports: str) -> Column:
    """More interfaces than ports: one port offers several alternatives."""
    return connector_sum(counts) > F.coalesce(F.col(ports), F.lit(0))


# --- shares, bins, scores -------------------------------------------------------------------

def share(parts: Sequence[str | Column], denominator: str | Column) -> Column:
    """Sum of parts over the denominator; null when any part is null or it is <= 0."""
    den = col(denominator).cast("double")
    total = reduce(lambda a, b: a + b, [col(p).cast("double") for p in parts])
    return F.when(den > 0, total / den)


def binned_mean(counts: Sequence[str | Column], midpoints: Sequence[float],
                total: str | Column) -> Column:
    weighted = [col(c).cast("double") * F.lit(float(m))
                for c, m in zip(counts, midpoints, strict=True)]
    return share(weighted, total)


def log_density(population: str | Column, area_km2: str | Column) -> Column:
    area = col(area_km2)
    # greatest() skips nulls, so a missing population is guarded explicitly
    return F.when((area > 0) & col(population).isNotNull(), F.log(F.greatest(col(population), F.lit(0.0)) / area + 1.0))


def share_of_population(rate: str | Column, population: str | Column) -> Column:
    return F.coalesce(col(rate), F.lit(0.0)) * col(population)


def population_share(part: str | Column, population: str | Column) -> Column:
    return F.when(col(population) > 0, col(part) / col(population)).otherwise(0.0)


def movement(value: str | Column, raw: str | Column) -> Column:
    v, r = col(value), col(raw)
    return F.abs(v - r) / (v + r + 1.0)


def relative_interval_width(half: str | Column, estimate: str | Column) -> Column:
    h, e = col(half), col(estimate)
    width = h / (h + F.greatest(e, F.lit(1.0)))
    return F.when(h.isNotNull() & e.isNotNull(),
                  F.greatest(F.lit(0.0), F.least(F.lit(1.0), width)))


def ports_per_1k(ports: str | Column, demand: str | Column) -> Column:
    """Null at zero demand, so a saturation test never fires there."""
    return F.when(col(demand) > 0, col(ports) * 1000.0 / col(demand))


def is_saturated(ports: str | Column, demand: str | Column, threshold: float) -> Column:
    return F.coalesce(ports_per_1k(ports, demand) >= threshold, F.lit(False))


def degradation_share(status: str | Column, confirmed: str = "confirmed") -> Column:
    """Aggregate: share of contributing sources whose status is not confirmed."""
    return F.coalesce(F.avg(F.when(col(status) != confirmed, 1.0).otherwise(0.0)), F.lit(0.0))


def tolerance_band(low: str | Column, high: str | Column, tolerance: float) -> Column:
    return F.struct((col(low) * (1.0 - tolerance)).cast("bigint").alias("low"),
                    (col(high) * (1.0 + tolerance)).cast("bigint").alias("high"))


def blend(demand: str | Column, equity: str | Column, weight: float) -> Column:
    return col(demand) * weight + col(equity) * (1.0 - weight)


def sorted_map_json(c: str | Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(c)))))


def round_to_hundreds(c: str | Column) -> Column:
    """Half-up to hundreds, used to recognise which rounded edition a count is from."""
    return (F.floor((col(c) + 50) / 100) * 100).cast("bigint")


def match_vintage_by_rounding(exact: DataFrame, published: DataFrame, key: str,
                              count: str = "n", vintage: str = "vintage") -> DataFrame:
    """How many keys of each published (rounded) edition equal our rounded count."""
    ours = exact.select(key, round_to_hundreds(count).alias("_ours"))
    return (published.join(ours, key)
            .groupBy(vintage)
            .agg(F.sum(F.when(F.col(count) == F.col("_ours"), 1).otherwise(0))
                  .alias("matching_keys"),
                 F.count(F.lit(1)).alias("compared_keys")))


# --- labels -----------------------------------------------------------------------------------

def publish_round(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def place_label(county: str | Column, state: str | Column,
                counties: str | Column | None = None) -> Column:
    """``'County, ST'`` (+ nearby count); null rather than a guess."""
    c, s = col(county), col(state)
    base = F.when((c != "") & (s != ""), F.concat_ws(", ", c, s))
    if counties is None:
        return base
    n = col(counties)
    return (F.when(n <= 1, base)
            .when(n == 2, F.concat(base, F.lit(" and 1 nearby county")))
            .otherwise(F.concat(base, F.lit(" and "), (n - 1).cast("string"),
                                F.lit(" nearby counties"))))


def area_label(place: str | Column, rank: str | Column) -> Column:
    """The place label, or a stable ``Area NN`` when no place is known."""
    r = col(rank).cast("string")
    padded = F.when(F.length(r) < 2, F.lpad(r, 2, "0")).otherwise(r)
    return F.coalesce(col(place), F.concat(F.lit("Area "), padded))


def scoped_label(name: str | Column, scope: str | Column, everywhere: str) -> Column:
    return F.when(col(scope).isNull(), F.concat_ws(" ", col(name), F.lit(everywhere))) \
        .otherwise(F.concat(col(name), F.lit(" in "), col(scope)))
