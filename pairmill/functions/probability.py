"""Column functions on four-class probabilities, held as an array of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = 4
MASKED_TASKS = ("ixi", "cxc")


def masked_softmax(logits: list[Column], masked: Column) -> Column:
    """Softmax; where `masked`, class 0 gets exactly 0 and the rest sum to 1."""
    top = F.when(masked, F.greatest(*logits[1:])).otherwise(F.greatest(*logits))
    e = [F.when(masked, F.lit(0.0)).otherwise(F.exp(logits[0] - top)), *(F.exp(x - top) for x in logits[1:])]
    return F.array(*[x / sum(e[1:], e[0]) for x in e])


def argmax_class(p: Column) -> Column:
    """Index of the largest; of equal ones the first."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def one_hot(index: Column) -> list[Column]:
    return [(index == i).cast("int") for i in range(CLASSES)]


def valid(p: Column, masked: Column, tolerance: float = 1e-5) -> Column:
    """Four finite numbers in [0, 1] that sum to 1, the first 0 where class 0 is masked."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    fine = (F.size(p) == CLASSES) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)) & (F.abs(total - 1) <= tolerance)
    return F.coalesce(fine & (~masked | (p[0] == 0)), F.lit(False))


def mean(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda a, b: (a + b) / 2)


def learning_rate(step: Column, total: int | Column, peak: float, floor: float = 0.05) -> Column:
    """Linear warm-up over 3 % of the steps (1 to 50 of them) times cosine decay over all
    steps, from 1 to `floor`."""
    n = F.lit(total)
    warmup = F.greatest(F.lit(1), F.least(F.lit(50), F.floor(3 * n / 100)))
    rise = F.least(F.lit(1.0), (step + 1) / warmup.cast("double"))
    share = F.least(F.lit(1.0), step / F.greatest(F.lit(1), n).cast("double"))
    return F.lit(peak) * rise * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)))


def validation_steps(horizon: int) -> list[int]:
    """The steps at which a run is validated: thirds of the horizon, or its end alone."""
    return [horizon // 3, 2 * horizon // 3, horizon] if horizon % 3 == 0 else [horizon]


def horizon(rows: Column, batch: int, accumulation: int, epochs: int, cap: int | None = None) -> Column:
    steps = F.ceil(rows / F.lit(float(batch * accumulation))) * epochs
    return F.least(steps, F.lit(cap)) if cap else steps
