"""Files as tables: listings, lines of large files, SQLite databases and JDBC tables."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def list_files(spark: SparkSession, root: str, under: str = "") -> DataFrame:
    """(path, size, modified) of the files below ``root``; ``under`` is a folder or a file there. No file is read,
    and empty ones aren't listed, as Spark makes no task of them."""
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.substring(F.col("path"), F.instr("path", base) + len(base), F.length("path"))
    found = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    inside = under.rstrip("/")
    return found.filter((F.col("path") == inside) | F.col("path").startswith(inside + "/")) if under else found


def scan_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line) of text files of any size: splits end at line ends, so a large file is many tasks."""
    found = spark.read.option("recursiveFileLookup", "true").text(root)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def _type(declared: str) -> str:
    return next((t for mark, t in _AFFINITY if mark in declared.upper()), "double" if declared else "binary")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


#: Whole numbers up to this are the same as doubles.
_EXACT = 1 << 53


def _settled(declared: str, seen: set[str]) -> str:
    """The type of a column. Of numeric affinity (NUMERIC, DATE, BOOLEAN ..) it is what holds all values that are there."""
    if not declared or any(mark in declared.upper() for mark, _ in _AFFINITY) or not seen:
        return _type(declared)
    if "blob" in seen:
        return "binary"
    if "text" in seen or {"large", "real"} <= seen:
        return "string"
    return "double" if "real" in seen else "long"


def sqlite_table(spark: SparkSession, path: str, table: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can read, cut into ranges of row ids.

    Columns of numeric affinity, such as dates, may hold anything; their type is what holds all their values: whole
    numbers, doubles, text (numbers among it as SQLite writes them), or bytes, which takes a pass over the ranges.
    In columns declared as whole numbers, reals, text or bytes, values of another type are null. Tables without row
    ids are one range.
    """
    uri = f"file:{path}?mode=ro"
    with sqlite3.connect(uri, uri=True) as con:
        declared = [(name, kind or "") for _, name, kind, *_ in con.execute(f"PRAGMA table_info({_quoted(table)})")]
        if not declared:
            raise ValueError(f"no table {table}")
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        except sqlite3.OperationalError:
            low = high = None
    names = [_quoted(n) for n, _ in declared]
    step = 1 if low is None else max(1, -(-(high - low + 1) // parts))
    ranges = [(None, None)] if low is None else [(k, min(high, k + step - 1)) for k in range(low, high + 1, step)]
    dealt = spark.createDataFrame(ranges, "low long, high long").repartition(len(ranges))

    def asked(sql):
        """Rows of ``sql`` over each range of a task."""
        def run(batches):
            with sqlite3.connect(uri, uri=True) as con:
                for batch in batches:
                    for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        yield con.execute(sql) if a is None else con.execute(sql + " WHERE rowid BETWEEN ? AND ?", (a, b))
        return run

    kinds = ", ".join(f"group_concat(DISTINCT CASE WHEN typeof({n}) = 'integer' AND abs({n} + 0.0) > {_EXACT} THEN 'large' ELSE typeof({n}) END)" for n in names)
    counted = asked(f"SELECT {kinds} FROM {_quoted(table)}")

    def look(batches):
        for rows in counted(batches):
            yield pa.record_batch([pa.array([list(rows.fetchone())], pa.list_(pa.string()))], names=["kinds"])

    seen: list[set[str]] = [set() for _ in names]
    for row in dealt.mapInArrow(look, "kinds array<string>").collect():  # one row a range
        for k, found in enumerate(row["kinds"]):
            seen[k] |= set((found or "null").split(",")) - {"null"}
    columns = [(n, _settled(kind, seen[k])) for k, (n, kind) in enumerate(declared)]
    free = [not any(mark in kind.upper() for mark, _ in _AFFINITY) and bool(kind) for _, kind in declared]
    wanted = ", ".join(f"CAST({q} AS {'TEXT' if t == 'string' else 'BLOB'})" if any_ and t in ("string", "binary") else q for q, any_, (_, t) in zip(names, free, columns))
    chosen = asked(f"SELECT {wanted} FROM {_quoted(table)}")

    kind = {"long": int, "string": str, "binary": bytes, "double": (int, float)}

    def read(batches):
        for rows in chosen(batches):
            while some := rows.fetchmany(10_000):
                kept = [[(float(v) if t == "double" else v) if isinstance(v, kind[t]) else None for v in x] for x, (_, t) in zip(zip(*some), columns)]
                yield pa.record_batch([pa.array(x, _ARROW[t]) for x, (_, t) in zip(kept, columns)], names=[n for n, _ in columns])

    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in columns)
    return dealt.mapInArrow(read, schema)


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table behind JDBC, such as PostgreSQL's, whose driver is on the class path; by ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()
