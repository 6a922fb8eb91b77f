"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that all executors share.

    The folder is ``spark.checkpoint.dir``. Where none is configured, a temporary one serves in local mode (tests);
    on a cluster that is an error, as a folder of one machine would lose what lies in it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """A table that ``cut`` has returned, without the size that the optimizer worked out for it.

    A checkpoint keeps that estimate, and a join's is the product of both sides'. In a loop that joins a table with
    itself its digits double with every join; after ten rounds the driver spends its time and memory on them.
    """
    made = df._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(made.queryExecution().logical().rdd(), made.schema(), False), df.sparkSession)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The table with a number of its own for each row, fixed by the checkpoint that it is read from."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """The table with a key that Spark takes for new, so that a join by it shuffles the table.

    An aggregate is joined where its groups already are; then the other side's rows of a frequent key stay in one
    task, because Spark splits large partitions only where both sides of a join are plain shuffles. Shuffling the
    pre-aggregated side once more costs little and lets the other side be split.
    """
    there, back = {"string": (F.reverse, F.reverse), "binary": (F.hex, F.unhex)}.get(df.schema[key].dataType.simpleString(), (F.bitwise_not, F.bitwise_not))
    return df.withColumn(key, back(there(F.col(key))))  # the optimizer sees through key + 0


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A table of narrow rows (tens of bytes), broadcast if it is counted to be short; count it cheaply first."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def n_words(text: Column) -> Column:
    """Number of words as a long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _marked(df: DataFrame, at: int) -> Column:
    """A column as text that tells null from everything else and where the value ends."""
    field = df.schema.fields[at]
    c, kind = df[f"`{field.name}`"], field.dataType.typeName()
    if kind == "binary":
        value = F.hex(c)
    elif kind in ("array", "map", "struct", "variant"):
        exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        value = F.when(c.isNotNull(), F.to_json(F.struct((F.map_entries(c) if kind == "map" else c).alias("v")), exact))
    else:
        value = c.cast("string")
    return F.coalesce(F.concat(F.lit("="), F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*columns: Column) -> Column:
    """The first 16 bytes of the SHA-256 of texts that are not null."""
    return F.unhex(F.substring(F.sha2(F.concat(*columns).cast("binary"), 256), 1, 32))


def row_key(df: DataFrame) -> Column:
    """16-byte key of a whole row: rows that repeat exactly share it, others don't.

    It is a SHA-256 of all columns, each with its length and nulls marked, so rows that hold the same values in other
    columns differ, and no two rows are ever seen to collide. Columns of any type may occur, maps and nested ones too.
    """
    return digest(*[_marked(df, k) for k in range(len(df.columns))])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Texts are worked on in slices of about this many characters, so memory doesn't follow a batch's row count.
SLICE_CHARS = 1_000_000


def slices(batch, at: int):
    """An Arrow batch in slices whose column ``at`` holds about ``SLICE_CHARS`` bytes, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    low = size = 0
    for k, n in enumerate(sizes):
        if k > low and size + n > SLICE_CHARS:
            yield batch.slice(low, k - low)
            low, size = k, 0
        size += int(n)
    if low < batch.num_rows:
        yield batch.slice(low)


def map_texts(df: DataFrame, text: str, work, fields: str) -> DataFrame:
    """Adds columns that ``work(list of texts) -> {name: list}`` makes, all other columns passing through as they are.

    ``fields`` is the DDL of the new columns; input columns of the same names are replaced. Null texts arrive as
    None. ``work`` gets whole texts, in slices of rows of bounded length.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = df.drop(*new.names)
    carried = kept if text in kept.columns else kept.withColumn(text, df[text])
    schema = StructType(list(kept.schema.fields) + list(new.fields))
    names, n_kept = list(new.names), len(kept.columns)
    at = [c.lower() for c in carried.columns].index(text.lower())

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(new)
        for whole in batches:
            for batch in slices(whole, at):
                out = work(batch.column(at).to_pylist())
                columns = [batch.column(k) for k in range(n_kept)]
                columns += [pa.array(out[c], type=types.field(c).type) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.field(k).name for k in range(n_kept)] + names)

    return carried.mapInArrow(run, schema)
