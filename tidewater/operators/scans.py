"""Recurrences over time as associative scans, so one long series is many tasks.

A recurrence whose steps are maps that compose (affine, Moebius, or linear in the
moments of the state) is split into blocks of time:

1. rows are grouped by key and block of time, about BLOCK of them each;
2. a block's steps are composed into one map, in parallel;
3. maps are applied one after another by key, which gives the state before each
   block; where a key has more than BLOCK blocks, blocks of maps are composed
   first, and so on, so no row ever holds more than BLOCK maps of a key;
4. each block is replayed from its state by the recurrence's own step, in parallel.

Both uses of the grouped rows share one exchange.  What a key has in excess of a
block costs tasks, not memory; only a burst of rows within one width of time makes
a block larger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
LEAST = 8  # maps composed at once, however small the blocks of rows
CHUNK = 256
ONE = 3  # `most` of blocks where no key has more rows than one takes


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def states_of(rows: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each of an array's rows.

    An accumulator is copied at every step, so states gather in chunks of CHUNK
    rows and the whole is linear in the rows.
    """
    none = F.slice(F.array(start), 1, 0)

    def each(acc: Column, x: Column) -> Column:
        # the new state is named once, as an array of one, for it is used twice
        return once(step(acc["state"], x), lambda new: F.struct(new.alias("state"), F.concat(acc["out"], F.array(new)).alias("out")))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), each)
        return once(done, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["parts"], F.array(x["out"])).alias("parts")))

    numbers = F.sequence(F.lit(0), F.ceil(F.size(rows) / CHUNK).cast("int") - 1)
    parts = F.transform(numbers, lambda k: F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)))
    nothing = F.struct(start.alias("state"), F.slice(F.array(none), 1, 0).alias("parts"))
    return F.flatten(F.aggregate(parts, nothing, chunk, lambda a: a["parts"]))


@dataclass(frozen=True)
class Maps:
    """Steps as maps of the state: of a block's rows, one after another, and on a state.

    A map also tells the state that it leads to from no state at all (`start`).
    """

    of_rows: Callable[[Column], Column]
    compose: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]
    start: Column

    @staticmethod
    def from_row(of_row: Callable[[Column], Column], compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column], start: Column) -> Maps:
        """With the map of a block composed of those of its rows."""
        return Maps(lambda rows: F.aggregate(F.slice(rows, 2, F.size(rows)), of_row(F.get(rows, F.lit(0))), lambda acc, x: compose(acc, of_row(x))), compose, apply, start)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, by keys, of which null ones match."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*(f"__right_{k}" for k in keys))


@dataclass(frozen=True)
class Blocks:
    """Rows (`__rows`, in order) by keys and `__block`; at most `most` blocks a key, `rows` rows or maps taken at once."""

    df: DataFrame
    keys: list[str]
    most: int
    rows: int

    @staticmethod
    def of(df: DataFrame, keys: list[str], order: list[str], columns: list[str], rows: int | None = None) -> Blocks:
        """order: the first one is a time, a number, by whose width blocks are cut; null times make a block before all."""
        rows, time = rows or BLOCK, order[0]
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("low"), F.max(time).alias("high"))
        n, low, high = sizes.agg(F.max("n"), F.min("low"), F.max("high")).first()  # one row
        most = max(1, -(-(n or 0) // rows))
        if n and low is not None and high > low and most > 1:
            width = (high - low) // most + 1 if isinstance(low, int) else (high - low) / most
            block = F.coalesce(F.floor((F.col(time) - F.lit(low)) / F.lit(width)).cast("long") if not isinstance(low, int) else F.expr(f"(`{time}` - {low}L) div {width}L"), F.lit(-1).cast("long"))
        else:
            block = F.lit(0).cast("long")
        listed = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *columns]))))
        return Blocks(df.groupBy(*keys, block.alias("__block")).agg(listed.alias("__rows")), keys, most + 2, rows)

    def plus(self, more: DataFrame) -> Blocks:
        """With the columns that more has by keys and block."""
        return Blocks(same_keys(self.df, more, [*self.keys, "__block"]), self.keys, self.most, self.rows)

    def told(self, maps: Maps, name: str) -> Blocks:
        """With the state before each block as `name`; where every key is one block, that is the first state and nothing is composed or joined."""
        if self.most == ONE:
            return Blocks(self.df.withColumn(name, maps.start), self.keys, self.most, self.rows)
        return self.plus(self.starts(maps, name))

    def starts(self, maps: Maps, name: str) -> DataFrame:
        """keys, __block and, as `name`, the state before each block."""
        told = self.df.select(*self.keys, "__block", maps.of_rows(F.col("__rows")).alias("__map"))
        return _starts(told, self.keys, maps, name, self.most, self.rows)

    def replay(self, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        """keys, the rows' columns and `state` after each row."""
        told = self.df.withColumn("__states", states_of(F.col("__rows"), start, step))
        return told.select(*self.keys, F.explode(F.arrays_zip("__rows", "__states")).alias("z")).select(*self.keys, "z.__rows.*", F.col("z.__states").alias("state"))


def _starts(told: DataFrame, keys: list[str], maps: Maps, name: str, most: int, rows: int) -> DataFrame:
    """keys, __block, the state before each: told has keys, __block, __map, with at most `most` blocks a key."""
    item, rows = F.array_sort(F.collect_list(F.struct("__block", "__map"))), max(rows, LEAST)
    if most <= rows:
        groups = told.groupBy(*keys).agg(item.alias("__items")).withColumn("__first", maps.start)
    else:
        above = told.groupBy(*keys, F.floor(F.col("__block") / rows).alias("__above")).agg(item.alias("__items"))
        composed = F.aggregate(F.slice("__items", 2, F.size("__items")), F.get("__items", F.lit(0))["__map"], lambda acc, x: maps.compose(acc, x["__map"]))
        coarse = above.select(*keys, F.col("__above").alias("__block"), composed.alias("__map"))
        first = _starts(coarse, keys, maps, "__first", most // rows + 2, rows).withColumnRenamed("__block", "__above")
        groups = same_keys(above, first, [*keys, "__above"])
    after = states_of(F.col("__items"), F.col("__first"), lambda s, x: maps.apply(x["__map"], s))
    groups = groups.withColumn("__before", F.concat(F.array("__first"), F.slice(after, 1, F.size("__items") - 1)))
    return groups.select(*keys, F.explode(F.arrays_zip("__items", "__before")).alias("z")).select(*keys, F.col("z.__items.__block").alias("__block"), F.col("z.__before").alias(name))
