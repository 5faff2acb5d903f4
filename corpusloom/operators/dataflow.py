"""Statements of a pipeline over records (id, value, further fields), each a function from DataFrame to DataFrame."""

from __future__ import annotations

import logging
import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace as _replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Params:
    """Settings of a run: what requests, headers and constants give; never changed, only copied."""

    values: tuple[tuple[str, object], ...] = ()

    def get(self, name: str, default=None):
        return dict(self.values).get(name, default)

    def with_(self, **more) -> Params:
        return _replace(self, values=tuple({**dict(self.values), **more}.items()))


def pipeline(*steps: Step) -> Step:
    """One step made of many: composition stands for calling another pipeline."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


def assign(df: DataFrame, **fields: Column) -> DataFrame:
    """Sets fields and keeps the others."""
    return df.withColumns(fields)


def replace(df: DataFrame, **fields: Column) -> DataFrame:
    """The record rebuilt from the given fields only."""
    return df.select(*[c.alias(n) for n, c in fields.items()])


def exchange(df: DataFrame, value: Column, spread: bool = False) -> DataFrame:
    """The whole record replaced by an expression; a struct can be spread into fields."""
    out = df.select(value.alias("value"))
    return out.select("value.*") if spread else out


def keep(df: DataFrame, *paths: str) -> DataFrame:
    return df.select(*[F.col(p).alias(p.replace(".", "_")) for p in paths])


def pluck(df: DataFrame, path: str = "value") -> DataFrame:
    return df.select(F.col(path).alias("value"))


def remove(df: DataFrame, test: Column, reverse: bool = False) -> DataFrame:
    """Drops records of which the test holds; a test that is null holds of none."""
    holds = F.coalesce(test, F.lit(False))
    return df.filter(holds if reverse else ~holds)


def swing(df: DataFrame, test: Column, column: str, then: Callable[[Column], Column], reverse: bool = False) -> DataFrame:
    """Changes a column of the records of which the test holds and leaves the others as they are."""
    holds = F.coalesce(test, F.lit(False))
    return df.withColumn(column, F.when(~holds if reverse else holds, then(F.col(column))).otherwise(F.col(column)))


def swing_branch(df: DataFrame, test: Column, step: Step) -> DataFrame:
    """Sends the records of which the test holds through a step; both branches come together again."""
    holds = F.coalesce(test, F.lit(False))
    return df.filter(holds).transform(step).unionByName(df.filter(~holds), allowMissingColumns=True)


def validate(df: DataFrame, rules: dict[str, str], quarantine: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Checks fields against rules such as ``required|string|min:2``; the first breach is named in ``error``.

    With ``quarantine`` the good and the bad records come apart; without, a breach ends the job when it is read.
    """
    error = F.lit(None).cast("string")
    for field, text in rules.items():
        for rule in reversed(text.split("|")):
            name, _, arg = rule.partition(":")
            kind = dict(df.dtypes).get(field, "")
            bad = {
                "required": F.col(field).isNull() if kind != "string" else F.col(field).isNull() | (F.trim(field) == ""),
                "string": F.lit(kind != "string") & F.col(field).isNotNull(),
                "array": F.lit(not kind.startswith("array")) & F.col(field).isNotNull(),
                "number": F.col(field).isNotNull() & F.expr(f"try_cast(`{field}` as double)").isNull() if not kind.startswith(("array", "struct", "map")) else F.lit(True),
                "min": F.length(F.col(field).cast("string")) < int(arg or 0) if not kind.startswith(("array", "struct", "map")) else F.size(field) < int(arg or 0),
            }[name]
            error = F.when(F.coalesce(bad, F.lit(False)), f"{field}: {rule}").otherwise(error)
    if quarantine:
        marked = df.withColumn("error", error)
        return marked.filter("error is null").drop("error"), marked.filter("error is not null")
    return df.filter(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True))


def singleton(df: DataFrame, check: Callable[[DataFrame], None], order: str | None = None) -> DataFrame:
    """Runs a check on the first record only and passes all on."""
    check((df.orderBy(order) if order else df).limit(1))
    return df


def truncate(df: DataFrame, length: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(length)


def shift(df: DataFrame, order: str) -> DataFrame:
    return truncate(df, 1, order)


def with_position(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """Positions from 0 in a total order, counted per range partition, so that no task sees all rows."""
    parts = df.sparkSession.sparkContext.defaultParallelism * 2
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_in")).cast("bigint")).drop("_part", "_in", "_start")


def group(df: DataFrame, size: int, position: str = "_pos") -> DataFrame:
    """Packets of ``size`` records in order: (packet, records)."""
    rest = [c for c in df.columns if c != position]
    rows = df.withColumn("packet", F.floor(F.col(position) / size)).groupBy("packet").agg(F.array_sort(F.collect_list(F.struct(position, *rest))).alias("records"))
    return rows


def ungroup(df: DataFrame, column: str = "records") -> DataFrame:
    return df.select(F.inline(column))


def exploding(df: DataFrame, column: str = "value") -> DataFrame:
    """A record for each element of an array, its other fields repeated."""
    return df.withColumn(column, F.explode(column))


def aggregate(df: DataFrame, key: str = "id", value: str = "value", position: str = "_pos") -> DataFrame:
    """Records of one key with their values in order; ``first`` keeps the place of the key's first record."""
    out = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("_v"), F.min(position).alias("first"))
    return out.select(key, F.transform("_v", lambda s: s[value]).alias(value), "first")


def summing(df: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(value))


def greater(df: DataFrame, than: float, column: str = "value", strict: bool = True) -> DataFrame:
    return df.filter(F.col(column) > than if strict else F.col(column) >= than)


def pair(df: DataFrame, left: str, right: str) -> DataFrame:
    """All pairs of the elements of two arrays of a record."""
    return df.withColumn("source", F.explode(left)).withColumn("target", F.explode(right))


def map_elements(df: DataFrame, column: str, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, F.transform(column, f))


def expand(df: DataFrame, column: str, op: Callable[[DataFrame], DataFrame], default: str | None = "n/a") -> DataFrame:
    """Enriches a column by an operator that is run once for each distinct key: (key) to (key, result)."""
    found = op(df.select(F.col(column).alias("key")).filter("key is not null").distinct())
    out = df.join(found.select(F.col("key").alias(column), "result"), column, "left")
    return out.withColumn("result", F.coalesce("result", F.lit(default))) if default is not None else out


def combine(df: DataFrame, table: DataFrame, column: str, key: str = "id", value: str = "value", default: str | None = None, order: str | None = None) -> DataFrame:
    """The column's value replaced by that of a table, the first match winning; a miss keeps the value or gets the default."""
    first = table.groupBy(key).agg(F.min_by(value, order or value).alias("_hit"))
    out = df.join(first.withColumnRenamed(key, column), column, "left")
    miss = F.lit(default) if default is not None else F.col(column)
    return out.withColumn(column, F.coalesce(F.col("_hit"), miss)).drop("_hit")


def execute(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A Python program over batches of records."""
    return df.mapInPandas(f, schema)


def identify(df: DataFrame, column: str = "uri", scheme: str = "uid:/") -> DataFrame:
    """Stamps each record with an id that is the same whenever the same record is read."""
    rest = [F.col(c).cast("string") for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    return df.withColumn(column, F.concat(F.lit(scheme), F.sha2(F.concat_ws("\x1f", *rest), 256).substr(1, 24)))


def metrics(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Counters that are filled while the records flow."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def throttle(items: Iterable, per_second: float) -> Iterator:
    """Passes items on at no more than a rate; for connectors inside one task."""
    gap, due = 1.0 / per_second, time.monotonic()
    for x in items:
        if (wait := due - time.monotonic()) > 0:
            time.sleep(wait)
        due = max(due, time.monotonic() - gap) + gap
        yield x


def pack(df: DataFrame) -> DataFrame:
    """Records as lines of JSON."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def unpack(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("value", schema).alias("r")).select("r.*")


#: Fixed value: the 29 signs of archival resource keys, which have no vowels.
ARK_SIGNS = "0123456789bcdfghjkmnpqrstvwxz"


def generate_ark(df: DataFrame, naan: str, sub: str, key: str, registry: DataFrame | None = None, length: int = 8) -> DataFrame:
    """Mints a key for each distinct value that the registry lacks: ark:/naan/sub-code-check. Keys are never given twice.

    The code is the value's hash in ARK_SIGNS; a collision within the run or with the registry is salted until it is gone.
    """
    base = F.array(*[F.lit(x) for x in ARK_SIGNS])
    place = F.create_map(*[F.lit(y) for k, x in enumerate(ARK_SIGNS) for y in (x, k)])
    todo = df.select(key).filter(f"{key} is not null").distinct()
    if registry is not None:
        todo = todo.join(registry.select(key), key, "left_anti")
    taken = registry.select("ark") if registry is not None else None

    def code(salt: int) -> Column:
        digits = [F.element_at(base, (F.pmod(F.xxhash64(F.col(key), F.lit(salt), F.lit(i)), F.lit(29)) + 1).cast("int")) for i in range(length)]
        body = F.concat(F.lit(f"{sub}-"), *digits)
        signs = F.split(F.concat(F.lit(f"{naan}/"), body), "")
        total = F.aggregate(F.transform(signs, lambda s, i: F.coalesce(F.try_element_at(place, s), F.lit(0)) * (i + 1)), F.lit(0), lambda a, x: a + x)
        return F.concat(F.lit(f"ark:/{naan}/"), body, F.lit("-"), F.element_at(base, total % 29 + 1))

    done, salt, todo = None, 0, cut(todo)
    while True:
        new = todo.withColumn("ark", code(salt)).withColumn("_n", F.row_number().over(Window.partitionBy("ark").orderBy(key))).filter("_n = 1").drop("_n")
        if taken is not None:
            new = new.join(taken, "ark", "left_anti")
        new = cut(new.select(key, "ark"))
        done = new if done is None else done.unionByName(new)
        taken = new.select("ark") if taken is None else taken.unionByName(new.select("ark"))
        todo = cut(todo.join(new.select(key), key, "left_anti"))
        if todo.limit(1).count() == 0:
            return done
        salt += 1


def fork(df: DataFrame, *sinks: Callable[[DataFrame], None], detached: bool = False) -> DataFrame | tuple[DataFrame, Future]:
    """Feeds the records to each sink and passes them on; they are computed once, into a written table, which the sinks
    and all that follows read. Detached sinks run beside the caller, who gets a future that raises their first error."""
    held = cut(df)

    def feed() -> None:
        for sink in sinks:
            sink(held)

    if not detached:
        feed()
        return held
    return held, spawn(feed)


def spawn(work: Callable[[], object]) -> Future:
    """Runs a piece of work in a thread of its own."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(work)
    finally:
        pool.shutdown(wait=False)


def debug(df: DataFrame, text: str = "", rows: int = 5, level: int = logging.DEBUG) -> DataFrame:
    """Logs the schema and, if the level is heard, the first records; passes all records on."""
    log = logging.getLogger("corpusloom")
    if log.isEnabledFor(level):
        log.log(level, "%s %s %s", text, df.schema.simpleString(), [r.asDict(True) for r in df.limit(rows).collect()])
    return df


def transit(df: DataFrame) -> DataFrame:
    return df


def always(df: DataFrame, value: object = True, keep_id: str | None = "id") -> DataFrame:
    """Every record with the same value."""
    return df.select(*([keep_id] if keep_id else []), F.lit(value).alias("value"))


def cached(keys: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """The answers to keys, each key being asked once over all calls: answers are kept in a folder that calls add to.

    ``ask`` gives a row for each new key; what it leaves out is asked again the next time.
    """
    spark = keys.sparkSession
    wanted = cut(keys.select(key).filter(F.col(key).isNotNull()).distinct())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    known = spark.read.parquet(store) if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None
    new = wanted if known is None else wanted.join(known.select(key), key, "left_anti")
    ask(new).write.mode("append").parquet(store)
    return spark.read.parquet(store).join(wanted, key, "left_semi")


def ticket(generator: str) -> dict[str, str]:
    """The receipt of a background job."""
    return {"id": generator, "value": uuid.UUID(int=random.getrandbits(128), version=4).hex}


def field_names(df: DataFrame, json_column: str | None = None) -> list[str]:
    """The fields of a source: its columns, or the keys of the first record of a JSON column."""
    if json_column is None:
        return list(df.columns)
    first = df.select(F.expr(f"json_object_keys({json_column})").alias("k")).limit(1).collect()
    return list(first[0]["k"] or []) if first else []
