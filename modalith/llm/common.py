"""What the operators share: lineage cuts, joins against a side of checked size, fresh names."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes that a side may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only where the session names none and runs on this machine alone,
    as in tests, one is made here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="modalith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, from which a lost executor's part is read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def value_bytes(c: Column, t: T.DataType) -> Column:
    """About the bytes that a value takes (bigint): the length of strings and binaries, 8 for a number, and for arrays, maps and structs
    the sum over what they hold, nulls counting 1."""
    if isinstance(t, T.StringType | T.BinaryType | T.CharType | T.VarcharType):
        n = F.octet_length(c).cast("long") + 8
    elif isinstance(t, T.ArrayType):
        fixed = _fixed_bytes(t.elementType)
        n = F.size(c).cast("long") * fixed if fixed else F.aggregate(F.transform(c, lambda x: value_bytes(x, t.elementType)), F.lit(0).cast("long"), lambda a, x: a + x)
    elif isinstance(t, T.MapType):
        n = value_bytes(F.map_keys(c), T.ArrayType(t.keyType)) + value_bytes(F.map_values(c), T.ArrayType(t.valueType))
    elif isinstance(t, T.StructType):
        n = F.lit(0).cast("long")
        for f in t.fields:
            n = n + value_bytes(c.getField(f.name), f.dataType)
    elif isinstance(t, T.UserDefinedType) or _fixed_bytes(t) is None:
        n = F.octet_length(F.to_json(F.struct(c.alias("x")))).cast("long")
    else:
        return F.lit(_fixed_bytes(t)).cast("long")
    return F.when(c.isNull(), F.lit(1).cast("long")).otherwise(n)


def _fixed_bytes(t: T.DataType) -> int | None:
    """Bytes of a type whose values all take as many, else None."""
    if isinstance(t, T.ByteType | T.BooleanType | T.NullType):
        return 1
    if isinstance(t, T.ShortType):
        return 2
    if isinstance(t, T.IntegerType | T.FloatType | T.DateType):
        return 4
    if isinstance(t, T.LongType | T.DoubleType | T.TimestampType | T.TimestampNTZType | T.DayTimeIntervalType | T.YearMonthIntervalType):
        return 8
    return 16 if isinstance(t, T.DecimalType) else None


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row of df."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        total = total + value_bytes(col(f.name), f.dataType)
    return total


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows and bytes, else as it is: then the join shuffles. df should be
    checkpointed."""
    facts = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if facts["n"] <= rows and (facts["b"] or 0) <= size else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name, one like it that is not yet a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of a batch that are worked on at once: a worker holds the Python objects of few texts, whatever the session's batch size.
SLICE = 128


def with_texts(docs: DataFrame, make: Callable[[], Callable[[list[str | None]], Sequence]], ddl: str, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs, by default all, and those of ddl, made from the column text. make is called once in each task; what
    it gives makes of a list of texts a sequence of values for each column of ddl. Any names will do, dots and all."""
    names = docs.columns if carry is None else carry
    fields = T.StructType.fromDDL(ddl).fields
    types = [to_arrow_type(f.dataType) for f in fields]
    plain = docs.select(col("text").cast("string").alias("text"), *(col(c).alias(f"c{i}") for i, c in enumerate(names) if c != "text"))
    kept = [f for f in plain.schema if f.name != "text" or "text" in names]
    out = T.StructType([*kept, *(T.StructField(f"made{i}", f.dataType) for i, f in enumerate(fields))])
    keys = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                some = whole.slice(at, SLICE)
                made = work(some["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([*(some[k] for k in keys), *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names=out.names)

    done = plain.mapInArrow(run, out)
    return done.select(*(F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)), *(F.col(f"made{i}").alias(f.name) for i, f in enumerate(fields)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
