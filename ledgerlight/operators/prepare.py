"""Preparation of the feature table for models: labels, split, scaling, balancing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.neighbours import nearest
from ledgerlight.functions.ordered import running
from ledgerlight.names import BRACKETS
from ledgerlight.operators.features import bracket_code
from ledgerlight.session import settle

LABEL = "label"


def encode_label(df: DataFrame, column: str = "dtp_bracket", out: str = LABEL) -> DataFrame:
    """Bracket to its code 0..3; anything else is -1."""
    return df.withColumn(out, F.coalesce(bracket_code(F.col(column)), F.lit(-1)))


def decode_label(df: DataFrame, column: str = "prediction", out: str = "bracket") -> DataFrame:
    names = F.array(*[F.lit(b) for b in BRACKETS])
    return df.withColumn(
        out, F.when(F.col(column).between(0, 3), F.get(names, F.col(column).cast("int")))
    )


def _text_piece(column: str) -> Column:
    """Order-preserving piece of a text: its first two characters; a missing text comes last."""
    first, second = F.ascii(F.substring(column, 1, 1)), F.ascii(F.substring(column, 2, 1))
    return F.coalesce((first.cast("long") * 1_114_112 + second).cast("long"), F.lit(1 << 42))


def time_split(
    df: DataFrame, order: Sequence[str], date: str = "due_date", test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Earliest rows for training, the rest for testing, cut at an exact row count.

    Rows are counted per date; only the date holding the cut is ranked, by
    ``order`` (a text column first). Rows without a date come last.
    """
    day = F.coalesce(F.col(date), F.lit("9999-12-31").cast("date"))
    dated = df.withColumn("__day", day)
    counts = dated.groupBy("__day").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.withColumns(
        {"hi": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))}
    )
    size = F.floor(F.col("all") * F.lit(1 - test_size)).cast("long")
    cut = (
        totals.filter(F.col("hi") > size)
        .orderBy("__day")
        .select("__day", (size - (F.col("hi") - F.col("n"))).alias("take"))
        .head()
    )
    if cut is None:
        return df, df.limit(0)
    on_day = running(
        dated.filter(F.col("__day") == F.lit(cut["__day"])),
        ["__day"],
        [F.col(c).asc_nulls_last() for c in order],
        _text_piece(order[0]),
        {"__rank": ("sum", F.lit(1))},
    )
    split = on_day.withColumn("__train", F.col("__rank") <= cut["take"]).select(*df.columns, "__train")
    early = dated.filter(F.col("__day") < F.lit(cut["__day"]))
    late = dated.filter(F.col("__day") > F.lit(cut["__day"]))
    train = early.select(*df.columns).unionByName(split.filter("__train").drop("__train"))
    test = split.filter("not __train").drop("__train").unionByName(late.select(*df.columns))
    return train, test


def date_split(df: DataFrame, cutoff, date: str = "due_date") -> tuple[DataFrame, DataFrame]:
    """Split at a date, so that no date is on both sides."""
    return df.filter(F.col(date) < F.lit(cutoff)), df.filter(F.col(date) >= F.lit(cutoff))


def full_dataset(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as doubles, other columns left out unless kept by name."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.select(
        *keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric if c not in keep]
    )


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of the training rows."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.mean, self.scale)
            }
        )


def standardize_fit(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One pass over the training rows; a column without spread keeps scale 1."""
    row = df.agg(
        *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).head()
    mean = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    scale = [row[f"s{i}"] or 1.0 for i in range(len(columns))]
    return Scaler(list(columns), mean, scale)


# ---- balancing ------------------------------------------------------------------------------


def threshold_grid(low: float = 0.1, high: float = 0.9, step: float = 0.1) -> list[float]:
    count = int(round((high - low) / step)) + 1
    return [round(low + i * (high - low) / max(count - 1, 1), 2) for i in range(count)]


def class_counts(df: DataFrame, label: str = LABEL) -> dict[int, int]:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}


def _shuffled(df: DataFrame, seed: int, label: str, key: str) -> DataFrame:
    """Position of each row in a seeded random order of its class."""
    drawn = df.withColumn("__draw", F.xxhash64(F.lit(seed), F.col(key)))
    return running(
        drawn,
        [label],
        [F.col("__draw"), F.col(key)],
        F.shiftright("__draw", 52),
        {"__place": ("sum", F.lit(1))},
    ).drop("__draw")


def _quota(counts: dict[int, int], wanted: dict[int, int], label: str) -> Column:
    """How many of the wanted rows each row stands for, by its place in its class."""
    result = F.lit(0)
    for c, n in counts.items():
        each, rest = divmod(wanted[c], n)
        share = F.lit(each) + (F.col("__place") <= rest).cast("int")
        result = F.when(F.col(label) == c, share).otherwise(result)
    return result


def hybrid_balance(
    df: DataFrame, threshold: float, key: str, label: str = LABEL, seed: int = 42
) -> DataFrame:
    """Every class to int(smallest class / threshold) rows, by dropping or repeating rows."""
    counts = class_counts(df, label)
    target = int(min(counts.values()) / threshold)
    placed = _shuffled(df, seed, label, key)
    copies = _quota(counts, {c: target for c in counts}, label)
    return (
        placed.withColumn("__copies", copies)
        .filter("__copies > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .drop("__copies", "__copy", "__place")
    )


def _fraction(*parts: Column) -> Column:
    """Number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _synthetic(
    df: DataFrame, seeds: DataFrame, label: str, k: int, seed: int
) -> DataFrame:
    """Rows between a seed row and one of its nearest rows of the same class.

    ``df`` and ``seeds`` have id, vec and label. Each minority class is filled up to
    the largest class; the seeds share the work evenly.
    """
    counts = class_counts(df, label)
    most = max(counts.values())
    starts = class_counts(seeds, label)
    made = None
    for c, n in sorted(counts.items()):
        if n == most or not starts.get(c):
            continue
        own = df.filter(F.col(label) == c)
        base = _shuffled(seeds.filter(F.col(label) == c), seed, label, "id")
        share = _quota({c: starts[c]}, {c: most - n}, label)
        near = (
            nearest(base.select("id", "vec"), own.select("id", "vec"), k)
            .join(own.select(F.col("id"), F.col("vec").alias("near_vec")), "id")
            .groupBy("query")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "near_vec"))).alias("near"))
        )  # k entries per row
        grown = (
            base.withColumn("__share", share)
            .filter("__share > 0")
            .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__share"))))
            .join(near, F.col("id") == F.col("query"))
        )
        pick = F.floor(_fraction(F.lit(seed), F.col("id"), F.col("__i")) * F.size("near")).cast("int")
        u = _fraction(F.lit(seed + 1), F.col("id"), F.col("__i"))
        new = grown.select(
            F.xxhash64(F.lit("synthetic"), F.col("id"), F.col("__i")).alias("id"),
            F.zip_with(
                "vec", F.get("near", pick)["near_vec"], lambda a, b: a + u * (b - a)
            ).alias("vec"),
            F.lit(c).cast(df.schema[label].dataType).alias(label),
        )
        made = new if made is None else made.unionByName(new)
    whole = df.select("id", "vec", label)
    return whole if made is None else whole.unionByName(made)


def smote(df: DataFrame, label: str = LABEL, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows for every smaller class until all classes are equal."""
    return _synthetic(df, df, label, k, seed)


def borderline_smote(
    df: DataFrame, label: str = LABEL, k: int = 5, m: int = 10, seed: int = 42
) -> DataFrame:
    """As ``smote``, from rows where half or more, but not all, near rows are of other classes."""
    labels = df.select("id", F.col(label).alias("__near"))
    own = df.select(F.col("id").alias("query"), F.col(label).alias("__own"))
    foreign = (
        nearest(df.select("id", "vec"), df.select("id", "vec"), m)
        .join(labels, "id")
        .join(own, "query")
        .groupBy("query")
        .agg(F.count_if(F.col("__near") != F.col("__own")).alias("n"), F.count("*").alias("of"))
        .filter((F.col("n") * 2 >= F.col("of")) & (F.col("n") < F.col("of")))
    )
    seeds = df.join(foreign, df["id"] == foreign["query"], "left_semi")
    return _synthetic(df, settle(seeds), label, k, seed)


def tomek_clean(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Drop rows that are each other's nearest row but of different classes."""
    near = nearest(df.select("id", "vec"), df.select("id", "vec"), 1).select("query", "id")
    near = settle(near)
    back = near.select(F.col("query").alias("b"), F.col("id").alias("a"))
    mutual = near.select(F.col("query").alias("a"), F.col("id").alias("b")).join(back, ["a", "b"])
    sides = df.select(F.col("id").alias("a"), F.col(label).alias("__a"))
    others = df.select(F.col("id").alias("b"), F.col(label).alias("__b"))
    links = mutual.join(sides, "a").join(others, "b").filter("__a <> __b")
    return df.join(links.select(F.col("a").alias("id")), "id", "left_anti")


def smote_tomek(df: DataFrame, label: str = LABEL, seed: int = 42) -> DataFrame:
    return tomek_clean(settle(smote(df, label, seed=seed)), label)


def neighbour_clean(df: DataFrame, label: str = LABEL, k: int = 3) -> DataFrame:
    """Keep rows whose near rows are all of their own class."""
    labels = df.select("id", F.col(label).alias("__near"))
    own = df.select(F.col("id").alias("query"), F.col(label).alias("__own"))
    torn = (
        nearest(df.select("id", "vec"), df.select("id", "vec"), k)
        .join(labels, "id")
        .join(own, "query")
        .filter("__near <> __own")
        .select(F.col("query").alias("id"))
        .distinct()
    )
    return df.join(torn, "id", "left_anti")


def smote_enn(df: DataFrame, label: str = LABEL, seed: int = 42) -> DataFrame:
    return neighbour_clean(settle(smote(df, label, seed=seed)), label)


def resample(
    df: DataFrame, strategy: str, threshold: float = 0.5, label: str = LABEL, seed: int = 42
) -> DataFrame:
    """Balance training rows (id, vec, label) by strategy name."""
    if strategy == "none":
        return df
    if strategy == "hybrid":
        return hybrid_balance(df, threshold, "id", label, seed)
    kinds = {
        "smote": smote,
        "borderline_smote": borderline_smote,
        "smote_tomek": smote_tomek,
        "smote_enn": smote_enn,
    }
    if strategy not in kinds:
        raise ValueError(f"unknown balance strategy: {strategy}")
    return kinds[strategy](df, label, seed=seed)
