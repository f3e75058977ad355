"""Driver-controlled iteration over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, drop


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, changed: Callable[[DataFrame, DataFrame], bool] | None = None, every: int = 4, progress: Callable[[int, int], None] | None = None, settle: bool = False) -> DataFrame:
    """step applied up to `rounds` times.

    Lineage is cut every `every` steps, so plans stay short and few jobs run; then
    changed(before, after) may end the loop.  With settle, a loop that it never ended raises RuntimeError.
    """
    state = cut(state)
    done = 0
    while done < rounds:
        new = state
        n = min(every, rounds - done)
        for _ in range(n):
            new = step(new)
        new = cut(new)
        done += n
        if progress is not None:
            progress(done, rounds)
        same = changed is not None and not changed(state, new)
        drop(state)
        state = new
        if same:
            return state
    if settle:
        raise RuntimeError(f"not settled after {rounds} rounds")
    return state


def differs(key: str, value: str, tolerance: float = 0.0) -> Callable[[DataFrame, DataFrame], bool]:
    """Whether any row's value moved by more than the tolerance; a key that only one side has counts as moved."""

    def changed(a: DataFrame, b: DataFrame) -> bool:
        j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
        moved = F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a").cast("double") - F.col("b").cast("double")) > tolerance)
        return not j.where(moved).isEmpty()

    return changed
