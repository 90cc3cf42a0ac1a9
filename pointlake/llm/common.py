"""Shared plumbing: tables, scratch space for cutting lineage, Arrow row streams."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space as the contracts define it.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Unset: a temporary folder in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pointlake-")
        sc.setCheckpointDir(root)
    return root


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, read back with the same schema.

    Tables lie in pointlake-<application id>; release() deletes one that nothing reads any more, clean() all of them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pointlake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scope():
    """Within it, tables of written() are deleted at the end, but for those given to the function that it yields."""
    made, kept = [], []
    _scopes.append(made)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _scopes.pop()
        stay = {t._scratch for t in kept}
        release(*[t for t in made if t._scratch not in stay])
        if _scopes:
            _scopes[-1].extend(t for t in made if t._scratch in stay)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables of written(); a lazy DataFrame that still has to read one of them would fail."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of written() of this application, once its results are stored."""
    _delete(spark, f"{scratch_root(spark)}/pointlake-{spark.sparkContext.applicationId}")


#: A key held by at least this share of all rows is hot; by counting there are at most so many of them.
HOT_KEYS = 100_000


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner equi-join of rows with keyed, which has a row for each key with the number n of the key's rows (of total).

    Keys with at least total / HOT_KEYS rows are HOT_KEYS at most and are broadcast, so their rows stay where they are; the
    others, none of which is large, are joined by a shuffle.
    """
    least = max(2, -(-total // HOT_KEYS))
    hot = F.broadcast(keyed.where(F.col(n) >= least).withColumn("_hot", F.lit(True)))
    tagged = rows.join(hot, on, "left")
    cold = tagged.where("_hot IS NULL").select(*rows.columns).join(keyed.where(F.col(n) < least), on)
    return tagged.where("_hot").drop("_hot").unionByName(cold)


def free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def added(docs: DataFrame, fields: str) -> tuple[DataFrame, StructType]:
    """(docs without columns that are named like the new fields, its schema with those fields at the end)."""
    new = StructType.fromDDL(fields)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {f.name.lower() for f in new.fields}])
    return docs, StructType([*docs.schema.fields, *new.fields])


#: Most bytes of an Arrow batch between JVM and Python; both sides hold it once or twice for each running task.
ARROW_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lowers the session's bound on Arrow batches to ARROW_BYTES; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def arrow(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of places (names differ) from one non-empty record batch to rows (a dict of columns) or None."""
    bounded(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for part in sliced(batch):
                    cols = fn(part)
                    if cols is not None:
                        yield record(cols, out)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)  # it takes no odd names


def record(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c.cast(f.type) if isinstance(c := cols[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema],
        schema=schema,
    )


#: Bytes of text handled at once by the numpy kernels; a longer text is handled alone.
SLICE_BYTES = 1 << 19


def sliced(batch: pa.RecordBatch, limit: int = SLICE_BYTES):
    """Cuts a batch so that each part holds about `limit` bytes, rows kept whole."""
    if batch.nbytes <= limit:
        return [batch]
    step = max(1, int(batch.num_rows * limit / batch.nbytes))
    parts = []
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > 4 * limit:
            half = part.num_rows // 2
            parts += sliced(part.slice(0, half), limit) + sliced(part.slice(half), limit)
        else:
            parts.append(part)
    return parts


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
