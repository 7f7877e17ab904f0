"""Calibration of predicates over labelled probabilities, annotation diffs and provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The floors of calibration, in hundredths where they are probabilities.
MIN_ITEMS, MIN_EACH, MIN_SEPARATION, MIN_PRECISION, GAP, CLEAR = 60, 15, 0.2, 0.9, 20, 2
JITTER = 0.01


class Refused(ValueError):
    """A calibration that must not be used; the message says why."""


@dataclass
class Bands:
    assert_at: float
    refute_at: float
    assert_precision: float
    refute_precision: float | None
    withheld: float
    separation: float
    rejected: list[float] = field(default_factory=list)


def bins(rows: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """(bin, n_true, n_false) by hundredths: 101 rows at most, however many items."""
    return rows.where(F.col(label).isNotNull()).groupBy(F.round(F.col(p) * 100).cast("int").alias("bin")).agg(F.sum(F.col(label).cast("int")).alias("n_true"), F.sum((~F.col(label)).cast("int")).alias("n_false"))


def label_separation(rows: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """Mean of true less mean of false; 0 if either is empty."""
    t, f = F.avg(F.when(F.col(label), F.col(p))), F.avg(F.when(~F.col(label), F.col(p)))
    return rows.agg(F.coalesce(t - f, F.lit(0.0)).alias("separation"))


def modes(rows: DataFrame, p: str = "p") -> DataFrame:
    """Bins with at least a twentieth of the items, and at least two."""
    per = rows.where(F.col(p).isNotNull()).groupBy(F.round(F.col(p) * 100).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("total") / 20))).select("bin", "n")


def derive_bands(rows: DataFrame, *, unsure: int = 0, assert_only: bool = False, p: str = "p", label: str = "label") -> Bands:
    """Assert and refute thresholds, or Refused; the checks come in a fixed order. The histogram is distributed, its 101 bins are decided here."""
    got = {r["bin"]: (r["n_true"], r["n_false"]) for r in bins(rows, p, label).collect()}
    true, false = sum(t for t, _ in got.values()), sum(f for _, f in got.values())
    if true + false + unsure < MIN_ITEMS:
        raise Refused(f"{true + false + unsure} items; at least {MIN_ITEMS} are needed")
    if min(true, false) < MIN_EACH:
        raise Refused(f"{true} true and {false} false; at least {MIN_EACH} of each are needed")
    separation = sum(b * t for b, (t, _) in got.items()) / (100 * true) - sum(b * f for b, (_, f) in got.items()) / (100 * false)
    if separation < MIN_SEPARATION:
        raise Refused(f"label separation {separation:.3f}; at least {MIN_SEPARATION} is needed")
    n = true + false
    peaks = [b for b in sorted(got) if sum(got[b]) >= max(2, -(-n // 20))]
    clear = lambda step: all(abs(step - b) > CLEAR for b in peaks)

    def above(step: int) -> tuple[int, int]:
        t, f = sum(t for b, (t, _) in got.items() if b >= step), sum(f for b, (_, f) in got.items() if b >= step)
        return t, t + f

    def below(step: int) -> tuple[int, int]:
        t, f = sum(t for b, (t, _) in got.items() if b <= step), sum(f for b, (_, f) in got.items() if b <= step)
        return f, t + f

    rejected, top = [], None
    for step in range(100, 0, -1):
        holds, of = above(step)
        if of and holds / of >= MIN_PRECISION:
            if clear(step):
                top = step
                break
            rejected.append(step / 100)
    if top is None:
        raise Refused("no threshold asserts with the precision needed")
    low, refute_precision = -1, None
    if not assert_only:
        for step in range(1, top - GAP + 1):
            holds, of = below(step)
            if of and holds / of >= MIN_PRECISION:
                if clear(step):
                    low, refute_precision = step, holds / of
                    break
                rejected.append(step / 100)
        else:
            raise Refused("no threshold refutes with the precision needed; declare the predicate assert-only")
    withheld = sum(t + f for b, (t, f) in got.items() if low < b < top) / n
    holds, of = above(top)
    return Bands(top / 100, low / 100 if low >= 0 else -1.0, holds / of, refute_precision, withheld, separation, rejected)


SITE = ["i", "e", "seq", "pred"]


def diff_annotations(before: DataFrame, after: DataFrame, jitter: float = JITTER) -> DataFrame:
    """Per predicate: shared sites, changed values, moved probabilities, sites of one side only."""
    b = before.select(*SITE, F.col("value").alias("v0"), F.col("p").alias("p0"), F.lit(True).alias("in0"))
    a = after.select(*SITE, F.col("value").alias("v1"), F.col("p").alias("p1"), F.lit(True).alias("in1"))
    both = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    same = F.col("v0").eqNullSafe(F.col("v1"))
    count = lambda c, name: F.sum(c.cast("int")).cast("long").alias(name)
    return b.join(a, SITE, "full_outer").groupBy("pred").agg(
        count(both, "shared"), count(both & ~same, "changed"), count(both & same & F.coalesce(F.abs(F.col("p0") - F.col("p1")) > jitter + 1e-9, F.lit(False)), "moved"),
        count(F.col("in1").isNull(), "only_before"), count(F.col("in0").isNull(), "only_after"),
    )


def provenance(ratios: DataFrame, own: float = 0.6, borrowed: int = 3) -> DataFrame:
    """Per clause and scope (holds, of): own, borrowed (kept in enough other scopes) or neither."""
    from pyspark.sql import Window

    out = ratios.withColumn("support", F.when(F.col("of") == 0, 0.0).otherwise(F.col("holds") / F.col("of")))
    out = out.withColumn("_q", ((F.col("of") > 0) & (F.col("support") >= own)).cast("int"))
    elsewhere = F.sum("_q").over(Window.partitionBy("clause")) - F.col("_q")
    return out.withColumn("class", F.when(F.col("support") >= own, "own").when(elsewhere >= borrowed, "borrowed").otherwise("neither")).drop("_q")
