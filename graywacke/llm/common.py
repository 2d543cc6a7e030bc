"""What the operators of this subpackage share: shared-folder tables, bounded broadcasts, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table may be broadcast, and what a row and a value of fixed size count for.
BROADCAST_BYTES, ROW_BYTES, VALUE_BYTES = 16 << 20, 16, 8

#: Rows in an Arrow batch of whole texts: the default of 10,000 can hold gigabytes of long texts.
BATCH_ROWS = 256
#: Characters of all texts of a sample that the driver holds, at most.
SAMPLE_CHARACTERS = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and the master is local (tests, a laptop), a temporary one of our own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='graywacke-')}")
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and read from the shared folder from now on: a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder for intermediate rows that are large; each is dropped when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/graywacke/{name}-{uuid.uuid4().hex}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Drops the named tables, or all."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches of whole texts small. A session setting, as Spark has no other place for it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has been measured to be small; else as it is, for a shuffled join.

    df should be a narrow table that has been cut or written: its bytes are summed here, strings and arrays by their length.
    """
    size = F.lit(ROW_BYTES + VALUE_BYTES * len(df.columns)).cast("long")
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size += F.octet_length(F.to_json(F.struct(f.name)))
    total = df.agg(F.sum(size)).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


#: A key is hot if it has more than one in so many of the rows to be met; there can't be more hot keys than that.
HOT_SHARE = 100_000


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, most: int = BROADCAST_BYTES, share: int = HOT_SHARE) -> DataFrame:
    """rows joined with keys, which have one row a key and in weight how many rows have it; keys should have been cut or written.

    Where the keys are too many to broadcast, the hot ones still are, as share bounds them; a key that is shuffled then has at most one in share of the rows.
    """
    n_keys, total = keys.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if (n_keys or 0) * (ROW_BYTES + VALUE_BYTES * len(keys.columns)) <= most:
        return rows.join(F.broadcast(keys.drop(weight)), on)
    hot = F.broadcast(keys.filter(F.col(weight) * share > total).drop(weight))
    cold = keys.filter(F.col(weight) * share <= total).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on))


def distinct_names(df: DataFrame, *added: str) -> None:
    """ValueError if df has a column that an operator is about to add: none is overwritten. Names count without regard to case."""
    if taken := sorted({c for c in df.columns if c.lower() in {a.lower() for a in added}}):
        raise ValueError(f"columns of these names are already there: {', '.join(taken)}")


def remainder(id_column: Column | str, by: int) -> Column:
    """crc32 of the id's text, modulo by: the fold of a row; a null id counts as an empty text."""
    named = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(named.cast("string"), F.lit("")).cast("binary")) % by


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): conflicting labels of one id count as the larger; null labels don't count."""
    return labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, balanced: bool = False, characters: int = SAMPLE_CHARACTERS) -> list[tuple[str, int]]:
    """Texts and labels of at most `most` documents (of each class, if balanced), by the hash of their ids: a bounded set for fitting.

    Rows and characters are both bounded: equal rows count once, and texts that would take the sample beyond `characters` are
    passed over, in the order of the hash. Conflicting labels of one id count as the larger; null labels and texts don't count.
    """
    known = cut(known_labels(labels, label))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size")).filter(F.col("text").isNotNull())
    # Only ids, hashes and sizes are dealt and ordered; the texts of the picked rows are read again.
    light = texts.select("doc_id", "text_hash", "size").join(bounded(known), "doc_id").select("doc_id", "text_hash", "size", "label").distinct()
    light = cut(light.filter(F.col("size") <= characters))
    first = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(most)
    parts = [light.filter("label = 0"), light.filter("label = 1")] if balanced else [light]
    picked, total = [], 0
    for rows in zip_longest(*(first(p).collect() for p in parts)):
        for r in filter(None, rows):
            if total + r["size"] <= characters:
                picked.append((r.doc_id, r.text_hash, r.label))
                total += r["size"]
    if not picked:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, f"doc_id {kind}, text_hash long, label int"))
    rows = texts.join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"), F.first("label").alias("label")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.text_hash))]
