"""The factor store: one Parquet table of (date, code, factors), a folder a date, and what reads, checks and exports it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

KEYS = ["date", "code"]
#: Values of a row group and of a file of an exported table, about.
CELLS = 8_000_000


def write(df: DataFrame, path: str, mode: str = "append", compression: str = "snappy") -> None:
    """Append to a store (created by the first write): files by date, sorted by code, so date prunes folders and code row groups."""
    df.repartition("date").sortWithinPartitions("date", "code").write.mode(mode).option("compression", compression).partitionBy("date").parquet(path)


def factors(df: DataFrame) -> list[str]:
    """The factor names of a store, in order."""
    return [c for c in df.columns if c not in KEYS]


def read(spark: SparkSession, path: str, columns: list | range | None = None, dates: list | None = None, codes: list | None = None, keys: bool = True) -> DataFrame:
    """A store, or some of its factors (by name or index), dates (folders pruned) and codes (pushed down); without keys, the values alone."""
    df = spark.read.parquet(path)
    df = df if dates is None else df.where(F.col("date").isin(list(dates)))
    df = df if codes is None else df.where(F.col("code").isin(list(codes)))
    names = factors(df)
    wanted = names if columns is None else [names[c] if isinstance(c, int) else c for c in columns]
    return df.select(*(KEYS if keys else []), *wanted)


def info(spark: SparkSession, path: str) -> DataFrame:
    """(factor, place, records) of each factor of a store."""
    df = spark.read.parquet(path)
    return df.agg(F.count(F.lit(1)).alias("records")).select(F.posexplode(F.array(*map(F.lit, factors(df)))).alias("place", "factor"), "records").select("factor", "place", "records")


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value): the distinct dates and codes, from the keys alone."""
    df = spark.read.parquet(path)
    return df.select(F.lit("date").alias("kind"), F.col("date").cast("string").alias("value")).distinct().unionByName(df.select(F.lit("code").alias("kind"), F.col("code").cast("string").alias("value")).distinct())


def stock(code: str) -> Column:
    """A code with its exchange's suffix: .SH for 6 and 9, .BJ for 8 and 4, else .SZ."""
    c = F.col(code).cast("string")
    return F.concat(c, F.when(F.substring(c, 1, 1).isin("6", "9"), ".SH").when(F.substring(c, 1, 1).isin("8", "4"), ".BJ").otherwise(".SZ"))


def template(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value): the distinct dates, and codes with their suffix."""
    book = codebook(spark, path)
    return book.select("kind", F.when(F.col("kind") == "code", stock("value")).otherwise(F.col("value")).alias("value"))


def _new_folder(spark: SparkSession, path: str) -> str:
    """The path in full, as executors name it; what lay there is gone."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hpath, True)
    fs.mkdirs(hpath)
    uri = fs.makeQualified(hpath).toString()
    return f"file://{uri.removeprefix('file:')}" if re.match("file:/[^/]", uri) else uri


def _write_wide(batches: Iterator[pa.RecordBatch], out: str, codes: pa.Array, schema: pa.Schema, cells: int) -> tuple[str, int] | None:
    """(date, code, value) rows sorted by date as a Parquet file under `out`, a column a code: its path and rows. Only task 0 writes a file without rows."""
    fs, top = pafs.FileSystem.from_uri(out)
    task, most = TaskContext.get().partitionId(), max(1, cells // max(1, len(codes)))
    path, temp = f"{top}/part-{task:05d}.parquet", f"{top}/_{uuid.uuid4().hex}"
    held: list[pa.RecordBatch] = []
    writer, n, days = None, 0, 0

    def flush() -> int:
        t = pa.Table.from_batches(held).combine_chunks()
        starts = np.array([0, *_starts(t, ["date"])][: t.num_rows])
        day = np.repeat(np.arange(len(starts)), np.diff([*starts, t.num_rows]))
        for a in range(0, len(starts), most):
            here = np.flatnonzero((day >= a) & (day < a + most))
            rows = min(most, len(starts) - a)
            at = np.full((len(codes), rows), -1)
            at[pc.index_in(t.column("code").take(pa.array(here)), codes).to_numpy(), day[here] - a] = here
            values = pa.array(at.ravel(), mask=at.ravel() < 0)
            values = t.column("value").take(values).combine_chunks()
            dates = t.column("date").take(pa.array(starts[a : a + rows])).cast(schema.field(0).type)
            writer.write_table(pa.Table.from_arrays([dates, *(values.slice(k * rows, rows) for k in range(len(codes)))], schema=schema))
        return len(starts)

    for whole in _whole(batches, ["date"]):
        if writer is None:
            writer = pq.ParquetWriter(temp, schema, filesystem=fs, use_dictionary=False, write_statistics=False, store_schema=False)
        held += whole
        days += 1 + sum(len(_starts(b, ["date"])) for b in whole)  # at least as many as there are
        if days >= most:
            n, held, days = n + flush(), [], 0
    if held:
        n += flush()
    if writer is None:
        if task:
            return None
        writer = pq.ParquetWriter(temp, schema, filesystem=fs, store_schema=False)
    writer.close()
    fs.move(temp, path)
    return path, n


def export(spark: SparkSession, path: str, out: str, names: list[str] | None = None, cells: int = CELLS) -> int:
    """A wide Parquet table for each factor, under `out`: a row a date, a column a code; their number.

    Codes become columns, so the driver lists them. Tasks write the files by pyarrow, as Spark's plans and
    writer need minutes and a heap for tens of thousands of columns; `out` must be a place that pyarrow
    reaches from executors (a shared folder, HDFS, an object store). A key stored twice gives one of its values.
    """
    df = spark.read.parquet(path)
    codes = sorted((r.code for r in df.select("code").distinct().collect()), key=lambda c: (c is None, c))
    parts = max(1, -(-df.select("date").distinct().count() * len(codes) // cells))
    kinds = to_arrow_schema(df.schema)
    columns = pa.array(codes, kinds.field("code").type)
    for n in names or factors(df):
        folder = _new_folder(spark, f"{out}/{n}")
        schema = pa.schema([pa.field("date", kinds.field("date").type), *(pa.field("null" if c is None else str(c), kinds.field(n).type) for c in codes)])

        def run(batches: Iterator[pa.RecordBatch], at: tuple = (folder, columns, schema, cells)) -> Iterator[pa.RecordBatch]:
            if done := _write_wide(batches, *at):
                yield pa.RecordBatch.from_pydict({"path": [done[0]], "n": [done[1]]})

        df.select("date", "code", F.col(n).alias("value")).repartition(parts, "date").sortWithinPartitions("date").mapInArrow(run, "path string, n long").collect()
    return len(names or factors(df))


def rewrite(spark: SparkSession, path: str, out: str, kind: str | None = None, compression: str = "zstd") -> None:
    """A store written anew: compacted to sorted files, factors cast to `kind` if given, in another compression ('uncompressed' for none)."""
    df = spark.read.parquet(path)
    write(df.select(*KEYS, *[F.col(c).cast(kind) if kind else F.col(c) for c in factors(df)]), out, "overwrite", compression)


def difference(a: DataFrame, b: DataFrame, factor: str) -> DataFrame:
    """(records, unmatched, largest): how far two stores' values of a factor are apart."""
    both = a.select(*KEYS, F.col(factor).alias("x"), F.lit(1).alias("in_a")).join(b.select(*KEYS, F.col(factor).alias("y"), F.lit(1).alias("in_b")), KEYS, "full")
    return both.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), 1)).alias("unmatched"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"))


def run_tasks(tasks: DataFrame, function: Callable, names: list[str], path: str | None = None, resume: bool = True, parts: int | None = None) -> DataFrame:
    """function(*keys) -> a float for each of `names`, for every task row; appended to the store `path` if given.

    Tasks whose keys the store has are not run again if `resume`. A task whose function raises
    gives nulls, so one bad task stops none. Keys are the tasks' columns; failed executors' tasks
    are run again by Spark.
    """
    spark, keys = tasks.sparkSession, tasks.columns
    if path and resume:
        try:
            done = spark.read.parquet(path).select(*keys).distinct()
            tasks = tasks.join(done, keys, "left_anti")
        except Exception as e:  # a store not yet written
            if "PATH_NOT_FOUND" not in str(e):
                raise

    def run(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts_:
            rows = []
            for key in p.itertuples(index=False):
                try:
                    values = [float(v) for v in function(*key)]
                except Exception:  # noqa: BLE001  the function is the user's
                    values = [None] * len(names)
                rows.append((*key, *values))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    schema = ", ".join([f"`{c}` {t}" for c, t in tasks.dtypes] + [f"`{n}` double" for n in names])
    out = (tasks.repartition(parts, *keys) if parts else tasks).mapInPandas(run, schema)
    if path is None:
        return out
    write(out, path)
    return spark.read.parquet(path)


class Group:
    """The rows of a key: a column is a numpy array, by attribute or [name], its nulls NaN (NaT for times, None for objects)."""

    __slots__ = ("_columns", "_here", "_valid")

    def __init__(self, columns: dict, valid: dict, start: int, end: int):
        self._columns, self._valid, self._here = columns, valid, slice(start, end)

    def __getitem__(self, name: str) -> np.ndarray:
        return self._columns[name][self._here]

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self._columns[name][self._here]
        except KeyError:
            raise AttributeError(name) from None

    def __len__(self) -> int:
        return self._here.stop - self._here.start

    def known(self, name: str) -> np.ndarray:
        """A column without its nulls; its own NaN stay."""
        return self[name][self._valid[name][self._here]] if name in self._valid else self[name]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({c: v[self._here] for c, v in self._columns.items()})


def _starts(t: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose key differs from the row before; nulls are equal, and so are NaN."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        c = t.column(k)
        a, b = c[:-1], c[1:]
        differ = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(c.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        for x in (differ, pc.not_equal(pc.is_null(a), pc.is_null(b))):
            new |= x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()
    return np.flatnonzero(new) + 1


class Groups:
    """Many groups at once, for functions by column: `columns` are numpy arrays, and group i begins at starts[i]."""

    __slots__ = ("_valid", "columns", "starts")

    def __init__(self, columns: dict, valid: dict, starts: np.ndarray):
        self.columns, self._valid, self.starts = columns, valid, starts

    def __len__(self) -> int:
        return len(self.starts)

    def reduce(self, ufunc: np.ufunc, name: str) -> np.ma.MaskedArray:
        """ufunc (np.add, np.maximum) over the known values of a column, for each group; masked where there is none."""
        v = self.columns[name]
        if name not in self._valid:
            return np.ma.array(ufunc.reduceat(v, self.starts))
        known = self._valid[name]
        n = np.add.reduceat(known, self.starts, dtype=np.int64)
        some = n > 0
        out = np.ma.masked_all(len(n), v.dtype)
        if some.any():
            out[some] = ufunc.reduceat(v[known], (np.cumsum(n) - n)[some])
        return out


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of rows sorted by key, cut so that each list holds whole groups."""
    held: list[pa.RecordBatch] = []  # of a group whose end is not read yet
    for b in batches:
        if not b.num_rows:
            continue
        if held and len(_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)]), keys)):
            yield held
            held = []
        last = int(_starts(b, keys)[-1:].sum())
        if last:
            yield [*held, b.slice(0, last)]
            held = []
        held.append(b.slice(last))
    if held:
        yield held


def run_groups(df: DataFrame, keys: list[str], function: Callable[[Group], list] | Callable[[Groups], list], names: list[str], together: bool = False) -> DataFrame:
    """function(rows of a key) -> a float or None for each of `names`: a factor pipeline by (date, code), by date, or by code.

    Rows are dealt by key and sorted by its hash, a number, which Spark does without comparing rows;
    Python cuts the groups out of the batches: small groups cost a call of `function`, not a pass of
    Spark. If `together`, it gets `Groups` and returns an array for each of `names`, masked where null:
    small groups cost no call either. A group is one task's, and lies whole in its memory.
    """
    kinds = dict(df.dtypes)
    mark = next(c for c in (f"_hash{i}" for i in range(len(df.columns) + 1)) if c not in {x.lower() for x in df.columns})

    def results(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        starts = _starts(t, keys)
        if len(starts) != len(_starts(t, [mark])):  # keys of one hash, whose rows may alternate
            t = t.sort_by([(k, "ascending") for k in keys]).combine_chunks()
            starts = _starts(t, keys)
        t, starts = t.drop_columns([mark]), np.concatenate([[0], starts])
        columns = {c: t.column(c).to_numpy() for c in t.column_names}
        valid = {c: t.column(c).is_valid().to_numpy() for c in t.column_names if t.column(c).null_count}
        if together:
            found = function(Groups(columns, valid, starts))
            values = [pa.array(np.asarray(np.ma.getdata(v), float), mask=np.ma.getmaskarray(v)) for v in found]
        else:
            ends = [*starts[1:].tolist(), t.num_rows]
            found = [function(Group(columns, valid, a, b)) for a, b in zip(starts.tolist(), ends)]
            values = [pa.array([None if v is None else float(v) for v in x], pa.float64()) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([*(t.column(k).take(pa.array(starts)).combine_chunks() for k in keys), *values], [*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(results, _whole(batches, [mark]))

    exact = [(F.col(k) + F.lit(0).cast(kinds[k])).alias(k) if k in keys and kinds[k] in ("float", "double") else F.col(k) for k in df.columns]  # -0.0 is 0.0
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{n}` double" for n in names])
    return df.select(*exact).repartition(*keys).withColumn(mark, F.xxhash64(*keys)).sortWithinPartitions(mark).mapInArrow(run, schema)
