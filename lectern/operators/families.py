"""Feature families of one unit brought together: a union folded by one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import ratio
from lectern.operators.scalars import with_totals

BASE = "base"


def _whole_key(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def _sides(base: DataFrame, families: Mapping[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    if BASE in families:
        raise ValueError(f"a family cannot be called {BASE!r}")
    sides, seen = {BASE: base, **families}, set()
    for name, df in sides.items():
        rest = {c for c in df.columns if c not in keys}
        if clash := rest & seen:
            raise ValueError(f"family {name!r}: columns {sorted(clash)} are taken")
        seen |= rest
    return sides


def fold_families(
    base: DataFrame, families: Mapping[str, DataFrame], keys: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """The rows of ``base`` with the columns of every family and ``missing_<family>`` flags.

    Left joins of any number of families at the price of one shuffle: the rows of all sides
    are tagged, put under each other and folded by one aggregate on the key. A key has at most
    one row a side, so no group is larger than the number of families.

    ``partition_by`` names a part of the key that also places the rows. Later joins and
    aggregates on that part, or on any key that holds it, then need no further shuffle. Its
    groups have to fit a task's share of the rows, as the words of one text cell do.

    A repeated key fails at run time and names the family, and so does a null key in ``base``;
    family rows with a null key, or with a key that ``base`` lacks, match nothing and go. An
    empty family flags every row. Clashing column names are an error here, before any job.
    """
    sides = _sides(base, families, keys)
    packed = {n: F.struct(F.lit(True).alias("__there"), *[c for c in df.columns if c not in keys]) for n, df in sides.items()}
    kinds = {n: df.select(packed[n].alias("x")).schema["x"].dataType for n, df in sides.items()}
    tagged = None
    for name, df in sides.items():
        if name == BASE:
            df = df.where(F.assert_true(_whole_key(keys), f"{BASE}: null in key ({', '.join(keys)})").isNull())
        else:
            df = df.where(_whole_key(keys))
        own = [packed[n].alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n) for n in sides]
        rows = df.select(*keys, *own)
        tagged = rows if tagged is None else tagged.unionByName(rows)
    if partition_by:
        tagged = tagged.repartition(*partition_by)
    counted = {n: F.count(n).alias(f"__n_{n}") for n in sides}
    folded = tagged.groupBy(*keys).agg(*[F.first(n, ignorenulls=True).alias(n) for n in sides], *counted.values())
    checked = folded.where(f"__n_{BASE} > 0")
    for name in sides:
        message = f"{name}: key ({', '.join(keys)}) is not unique"
        checked = checked.where(F.assert_true(F.col(f"__n_{name}") <= 1, message).isNull())
    columns = [F.col(f"`{n}`.`{c}`").alias(c) for n, df in sides.items() for c in df.columns if c not in keys]
    flags = [(F.col(f"__n_{n}") == 0).alias(f"missing_{n}") for n in families]
    return checked.select(*keys, *columns, *flags)


def attach_unit(rows: DataFrame, units: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Columns of a coarser unit on its rows, and ``missing_<name>``; a unit that repeats is an error.

    Where the rows are already placed by ``keys`` only the units move.
    """
    rest = [c for c in units.columns if c not in keys]
    packed = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(True).alias("__there"), *rest)).alias("__unit"))
    once = packed.where(F.assert_true(F.col("__n") == 1, f"{name}: key ({', '.join(keys)}) is not unique").isNull())
    joined = rows.join(once.drop("__n"), list(keys), "left")
    return joined.select(*rows.columns, *[F.col(f"__unit.`{c}`").alias(c) for c in rest], F.col("__unit").isNull().alias(f"missing_{name}"))


def missing_rates(folded: DataFrame, base: DataFrame) -> DataFrame:
    """A row per family: rows of the base, rows after folding, rows without the family and their share."""
    flags = [c for c in folded.columns if c.startswith("missing_")]
    before = base.agg(F.count(F.lit(1)).alias("base_rows"))
    after = folded.agg(F.count(F.lit(1)).alias("joined_rows"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    pairs = [F.struct(F.lit(f.removeprefix("missing_")).alias("family"), F.col(f).alias("missing_rows")) for f in flags]
    rows = with_totals(after, before).select("base_rows", "joined_rows", F.inline(F.array(*pairs)))
    return rows.withColumn("missing_rate", ratio(F.col("missing_rows"), F.col("joined_rows")))
