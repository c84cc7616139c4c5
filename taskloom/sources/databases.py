"""Embedded databases as sources: SQLite and DuckDB files, read-only, in parts; their schemas; and a SQLite sink.

The file must lie where the driver and all executors see it, as a mounted folder. It is
opened read-only by every reader, so nothing that is read can change it.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of one Arrow batch.
BATCH = 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str | None, kind: str) -> str:
    """The Spark type of a declared one: for SQLite what its rules of affinity say, as columns there hold any value; for DuckDB numbers, booleans, bytes, and text for all else."""
    t = (declared or "").upper()
    if kind == "duckdb":
        if re.match(r"U?(TINY|SMALL|BIG)?INT(EGER)?$", t):
            return "bigint"
        return {"BOOLEAN": "boolean", "BLOB": "binary", "DOUBLE": "double", "FLOAT": "double"}.get(t, "string")
    if "INT" in t:
        return "bigint"
    if any(x in t for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if not t or "BLOB" in t:
        return "binary" if t else "string"
    return "double" if any(x in t for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"


def opened(kind: str, path: str):
    if kind == "sqlite":
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    import duckdb

    return duckdb.connect(path, read_only=True)


def files_of(path: str, table: str | None = None) -> list[str]:
    """The file itself, or of a folder all its SQLite files; of these, if a table is named, those that have it."""
    if not os.path.isdir(path):
        return [path]
    found = sorted(glob.glob(f"{glob.escape(path)}/*.sqlite"))
    if table is None:
        return found
    out = []
    for f in found:
        con = opened("sqlite", f)
        try:
            out += [f] * bool(con.execute("SELECT 1 FROM sqlite_master WHERE lower(name) = lower(?)", (table,)).fetchone())
        finally:
            con.close()
    return out


def columns(kind: str, path: str, table: str) -> list[tuple[str, str]]:
    """(name, declared type) of a table's columns, in their order."""
    con = opened(kind, next(iter(files_of(path, table)), path))
    try:
        found = con.execute(f"PRAGMA table_info({quoted(table)})" if kind == "sqlite" else f"PRAGMA table_info('{table.replace(chr(39), chr(39) * 2)}')").fetchall()
    finally:
        con.close()
    if not found:
        raise ValueError(f"no table {table} in {path}")
    return [(r[1], r[2]) for r in found]


def cell(value, kind: str):
    """A value as its column's type; what a SQLite column holds against its type becomes null, and anything as text in a text column."""
    if value is None or kind == "string":
        return value if value is None or isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if kind == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    if kind == "boolean":
        return bool(value)
    if isinstance(value, (int, float)):
        return float(value) if kind == "double" else int(value) if value == value and abs(value) < 2**63 else None
    return None


class Range(InputPartition):
    """Rows of a file from low to high, both included; of a table without row ids all."""

    def __init__(self, path: str, low: int | None, high: int | None) -> None:
        self.path, self.low, self.high = path, low, high


class EmbeddedReader(DataSourceReader):
    def __init__(self, kind: str, options: dict, schema) -> None:
        self.kind, self.path, self.table, self.parts = kind, options["path"], options["table"], int(options.get("parts", "8"))
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema]

    def partitions(self) -> Sequence[InputPartition]:
        found = files_of(self.path, self.table)
        return [r for f in found for r in self.ranges(f, -(-self.parts // len(found)))]

    def ranges(self, path: str, parts: int) -> list[Range]:
        con = opened(self.kind, path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # WITHOUT ROWID, or a view
            return [Range(path, None, None)]
        finally:
            con.close()
        if low is None:  # no rows, or a view of no row ids
            return [Range(path, None, None)]
        step = max(1, -(-(high - low + 1) // parts))
        return [Range(path, x, min(high, x + step - 1)) for x in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(n, arrow[t]) for n, t in self.fields])
        con = opened(self.kind, partition.path)
        try:
            if self.kind == "sqlite":
                con.text_factory = lambda b: b.decode("utf-8", "replace")
            where = "" if partition.low is None else f" WHERE rowid BETWEEN {int(partition.low)} AND {int(partition.high)}"
            names = ", ".join(quoted(n) if t != "string" or self.kind == "sqlite" else f"CAST({quoted(n)} AS VARCHAR)" for n, t in self.fields)
            rows = con.execute(f"SELECT {names} FROM {quoted(self.table)}{where}")
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([cell(r[i], t) for r in some], arrow[t]) for i, (_, t) in enumerate(self.fields)], schema=schema)
        finally:
            con.close()


class SqliteSource(DataSource):
    """format("sqlite") with options path, table and parts."""

    kind = "sqlite"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {spark_type(t, self.kind)}" for n, t in columns(self.kind, self.options["path"], self.options["table"]))

    def reader(self, schema) -> DataSourceReader:
        return EmbeddedReader(self.kind, dict(self.options), schema)


class DuckSource(SqliteSource):
    """format("duckdb_file") with options path, table and parts."""

    kind = "duckdb"

    @classmethod
    def name(cls) -> str:
        return "duckdb_file"


def read_database(spark: SparkSession, kind: str, path: str, table: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite (`sqlite`) or DuckDB (`duckdb`) file, in about `parts` ranges of its row ids, or of all SQLite files of a folder, each with rows of it."""
    source = {"sqlite": SqliteSource, "duckdb": DuckSource}[kind]
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("path", path).option("table", table).option("parts", parts).load()


DESCRIBED = "table string, position int, column string, declared string, not_null boolean, key int, unique boolean, references string"


def introspected(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(table, position, column, declared, not_null, key, unique, references): one row a column of each table of a file.

    key: the column's place in the primary key, 0 outside of it; unique: it has a unique index
    of its own or is the whole primary key; references: table.column of a declared foreign key.
    """
    if os.path.isdir(path):
        seen = dict.fromkeys(r for f in files_of(path) for r in _described(kind, f))  # parts of one table say the same
        return spark.createDataFrame(sorted(seen, key=lambda r: r[:2]), DESCRIBED)
    return spark.createDataFrame(_described(kind, path), DESCRIBED)


def _described(kind: str, path: str) -> list[tuple]:
    con, rows = opened(kind, path), []
    try:
        if kind == "sqlite":
            for (t,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                info = con.execute(f"PRAGMA table_info({quoted(t)})").fetchall()
                keys = [r[1] for r in sorted(info, key=lambda r: r[5]) if r[5]]
                alone = {keys[0]} if len(keys) == 1 else set()
                for index in con.execute(f"PRAGMA index_list({quoted(t)})").fetchall():
                    of = [r[2] for r in con.execute(f"PRAGMA index_info({quoted(index[1])})").fetchall()]
                    alone |= {of[0]} if index[2] and len(of) == 1 else set()
                far: dict[str, str] = {}
                for f in con.execute(f"PRAGMA foreign_key_list({quoted(t)})").fetchall():
                    target = f[4] or next((r[1] for r in con.execute(f"PRAGMA table_info({quoted(f[2])})").fetchall() if r[5] == 1), "")
                    far[f[3]] = f"{f[2]}.{target}"
                rows += [(t, r[0], r[1], r[2], bool(r[3]), r[5], r[1] in alone, far.get(r[1])) for r in info]
        else:
            single: dict[tuple[str, str], set[str]] = {}
            far = {}
            place: dict[tuple[str, str], int] = {}
            for t, what, names, other, there in con.execute("SELECT table_name, constraint_type, constraint_column_names, referenced_table, referenced_column_names FROM duckdb_constraints()").fetchall():
                if what in ("PRIMARY KEY", "UNIQUE") and len(names) == 1:
                    single.setdefault((t, names[0]), set()).add(what)
                if what == "PRIMARY KEY":
                    place |= {(t, n): i + 1 for i, n in enumerate(names)}
                if what == "FOREIGN KEY":
                    far |= {(t, n): f"{other}.{m}" for n, m in zip(names, there, strict=True)}
            for t, i, c, declared, null in con.execute("SELECT table_name, column_index - 1, column_name, data_type, is_nullable FROM duckdb_columns() WHERE NOT internal ORDER BY 1, 2").fetchall():
                rows.append((t, i, c, declared, not null, place.get((t, c), 0), (t, c) in single, far.get((t, c))))
    finally:
        con.close()
    return rows


def _definition(df: DataFrame, table: str, keys: tuple[str, ...], references: dict[str, str] | None) -> tuple[str, DataFrame]:
    """CREATE TABLE for df, and df in types that SQLite has."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    parts = [f"{quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" + (f" REFERENCES {quoted(references[f.name])}" if references and f.name in references else "") for f in df.schema]
    if keys:
        parts.append(f"PRIMARY KEY ({', '.join(map(quoted, keys))})")
    return f"CREATE TABLE {quoted(table)} ({', '.join(parts)})", df.select(*[df[f"`{f.name}`"] if f.dataType.simpleString() in kinds else df[f"`{f.name}`"].cast("string") for f in df.schema])


def write_sqlite(df: DataFrame, path: str, table: str, keys: tuple[str, ...] = (), references: dict[str, str] | None = None) -> int:
    """A table of a SQLite file, replaced as a whole in one transaction; returns the number of rows.

    Rows pass through the driver a partition at a time, as a file has one writer: for small tables, write_sqlite_parts() is for
    others. keys: the primary key; references: column to other table.
    """
    create, plain = _definition(df, table, keys, references)
    con = sqlite3.connect(path)
    try:
        with con:
            con.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
            con.execute(create)
            con.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(df.columns))})", (tuple(r) for r in plain.toLocalIterator()))
        return con.execute(f"SELECT count(*) FROM {quoted(table)}").fetchone()[0]
    finally:
        con.close()


def write_sqlite_parts(df: DataFrame, folder: str, table: str, keys: tuple[str, ...] = ()) -> int:
    """A table as SQLite files of a folder, one a task, written where the rows are; returns the number of rows. read_database() reads them as one.

    Rows of one key are in one file, which so holds its primary key for the whole table. A file is made in the task's own temporary folder and
    gets its name in `folder`, which all executors see, when it is whole: a task that runs again replaces it.
    """
    create, plain = _definition(df, table, keys, None)
    if keys:
        plain = plain.repartition(*[plain[f"`{k}`"] for k in keys])
    insert = f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(df.columns))})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = tempfile.mkdtemp(), 0
        try:
            con = sqlite3.connect(f"{own}/part")
            try:
                with con:
                    con.execute(create)
                    for b in batches:
                        con.executemany(insert, zip(*(c.to_pylist() for c in b.columns), strict=True))
                        n += b.num_rows
            finally:
                con.close()
            copy = f"{folder}/.{uuid.uuid4().hex}"
            shutil.copyfile(f"{own}/part", copy)
            os.replace(copy, f"{folder}/{table}-{TaskContext.get().partitionId():05d}.sqlite")
        finally:
            shutil.rmtree(own)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return plain.mapInArrow(write, "n long").agg(F.sum("n")).first()[0]
