"""Semi-naive evaluation: rules see only what the last round added, and what is known already is removed by an anti join.

``fixpoint`` closes one stratum. ``stratified`` runs strata in order and returns to the first whenever a later one adds a row, which is how a
non-monotone decision ("no row has come") may only be taken after quiescence, and may still create new needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.plans.storage import counted, cut

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def fixpoint(seed: DataFrame, rules: Sequence[Rule], key: Sequence[str], limit: int = 10_000, first: Sequence[str] = ()) -> DataFrame:
    """All rows derivable from ``seed``. A rule takes (delta, done). Of rows with one key that come in one round the least by ``first``
    stays (any, if there is none to order by); a key that is known never comes again."""
    key = list(key)

    def once(df: DataFrame) -> DataFrame:
        if not first:
            return df.dropDuplicates(key)
        rest = [c for c in df.columns if c not in key]
        best = F.min(F.struct(*first, *[c for c in rest if c not in first])).alias("best")
        return df.groupBy(*key).agg(best).select(*[F.col(f"best.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])

    delta = cut(once(seed), "delta")
    parts = [delta]
    for _ in range(limit):
        done = parts[0]
        for part in parts[1:]:
            done = done.unionByName(part)
        found = None
        for rule in rules:
            own = rule(delta, done).select(seed.columns)
            found = own if found is None else found.unionByName(own)
        delta, n = counted(once(found).join(done.select(key), key, "left_anti").select(seed.columns), "delta")
        if not n:
            return done
        parts.append(delta)
        if len(parts) > 16:
            parts = [cut(done.unionByName(delta), "done")]
    raise RuntimeError(f"no fixpoint in {limit} rounds")


def stratified(seed: DataFrame, strata: Sequence[Callable[[DataFrame], DataFrame]], key: Sequence[str], limit: int = 100) -> DataFrame:
    """``strata[0]`` closes a set of rows; each later one may add rows to a closed set. Ends when none does."""
    done = cut(strata[0](seed), "stratum")
    for _ in range(limit):
        for later in strata[1:]:
            more, n = counted(later(done).dropDuplicates(list(key)).join(done.select(list(key)), list(key), "left_anti").select(done.columns), "more")
            if n:
                done = cut(strata[0](done.unionByName(more)), "stratum")
                break
        else:
            return done
    raise RuntimeError(f"the strata did not settle in {limit} rounds")
