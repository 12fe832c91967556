"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_folder, settle  # noqa: F401


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where a local session names none (single-machine tests) a temporary one is set.
    """
    ensure_checkpoint_folder(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Rows of texts that a session hands Python at once: whole texts of any length are in them, and executors hold them several times over.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands Python at most BATCH_ROWS rows at once from now on.

    The setting is read when a plan runs, and frames are lazy, so it cannot be set back here. It changes no result.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def grouped_tables(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Key values and rows of each group of rows that lie together by keys."""
    now, waiting = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        own = list(zip(*columns, strict=True))
        starts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if own[lo] != now and waiting:
                yield now, pa.Table.from_batches(waiting)
                waiting = []
            now = own[lo]
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield now, pa.Table.from_batches(waiting)


#: Parts that the rows of one key are dealt to where a key may hold any share of them.
SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row a key; rows of one key are dealt to SALTS tasks by the column spread."""
    salt = free_name("_salt", [*rows.columns, *few.columns])
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{spread}`"), F.lit(13)), F.lit(SALTS)).cast("int"))
    copies = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


#: Bytes up to which a counted table goes to every task; a larger one is met by a shuffle.
BROADCAST_BYTES = 32_000_000


def is_few(df: DataFrame) -> bool:
    """Are df's values counted to be BROADCAST_BYTES or less? It is read for that, so it should be settled."""

    def size(name: str, kind: str):
        column = F.col(f"`{name}`")
        if kind.startswith("array"):
            return F.coalesce(F.size(column), F.lit(0)) * 32 + 16
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16)

    total = sum((size(*t) for t in df.dtypes), F.lit(16))
    return (df.agg(F.sum(total)).first()[0] or 0) <= BROADCAST_BYTES


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is few."""
    return F.broadcast(df) if is_few(df) else df


def rows_of(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """rows whose id is in ids (distinct, settled); their texts are not shuffled if the ids are few."""
    return rows.join(few(ids), id_col, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column) -> "F.Column":
    """Unsigned CRC-32 of the UTF-8 bytes of a column's text; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def free_name(wanted: str, taken: list[str]) -> str:
    """wanted, or wanted with underscores before it, as no column of taken is called."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted
