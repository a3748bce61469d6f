"""File inventory, compaction, proofs and the history of a published table.

A published table lives below one root folder. Every write goes to a new
directory ``run=<id>`` there and then adds one row to the log next to it
(``<root>_log``). Files are never changed, so every earlier state stays readable.

The log holds no list of files or directories. A state is read by conditions on
what Spark knows of a file before it opens it: the run it belongs to, its
partition and its size. A compaction notes the size below which it took files
(``small_bytes``); it took them from all earlier runs, in the partitions that it
wrote itself. One writer.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, MapType, StructField, StructType

from tablewright.sources.session import own_session


TARGET_BYTES = 128 * 1024 * 1024
SMALL_SHARE = 0.75
MIN_INPUT_FILES = 5
PARTITIONS_A_JOB = 100

LOG = (
    "run_id bigint, committed_at timestamp, operation string, summary map<string,string>, "
    "row_schema string, partition_by array<string>, small_bytes bigint"
)
# The columns of Spark's binary file source, which lists files.
LISTED = "path string, modificationTime timestamp, length bigint, content binary"
FILE = ["file_path", "file_size_in_bytes"]
SCANNED = "_metadata.file_size"


# -- files --------------------------------------------------------------------


def file_listing(
    spark: SparkSession, *paths: str, partitions: Sequence[StructField] = (), pattern: str = "*.parquet"
) -> DataFrame:
    """Path and size of each file below ``paths``, rows or none; no file is opened.

    Spark lists the directories, in parallel where there are many, and drops hidden
    files. ``partitions`` are columns that the directories' names hold.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if partitions:
        reader = reader.schema(StructType([*StructType.fromDDL(LISTED).fields, *partitions]))
    else:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(list(paths)).select(
        *[F.col(f.name) for f in partitions],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size_in_bytes"),
    )


def file_inventory(df: DataFrame, *by: str, listing: DataFrame | None = None) -> DataFrame:
    """Path, size and rows of each data file of a scan; no column is read.

    ``by`` adds columns that are the same for all rows of a file. Files without rows
    show only with a ``listing`` of ``by`` columns, ``file_path`` and
    ``file_size_in_bytes``: rows are counted per file within each task, and the counts
    joined to the listing.
    """
    path, size = F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size_in_bytes")
    counted = F.count(F.lit(1)).alias("record_count")
    if listing is None:
        return df.groupBy(*by, path, size).agg(counted)
    counts = df.groupBy(path).agg(counted)
    columns = [*by, *FILE, F.coalesce("record_count", F.lit(0)).alias("record_count")]
    return listing.join(counts, "file_path", "left").select(*columns)


# -- proofs -------------------------------------------------------------------


def _hashable(df: DataFrame) -> list[Column]:
    """The columns, maps as sorted entries, and which of them are NULL, over which a hash passes."""
    columns = [
        F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema
    ]
    return [*columns, *[c.isNull() for c in columns]]


def _hash_sum(value: Column) -> Column:
    """The exact sum of 64-bit hashes, in parts that no number of rows up to 2^41 overflows."""
    low, middle, high = (1 << 22) - 1, (1 << 21) - 1, 43
    parts = [value.bitwiseAND(F.lit(low)), F.shiftrightunsigned(value, 22).bitwiseAND(F.lit(middle)), F.shiftrightunsigned(value, high)]
    wide = [F.sum(part).cast("decimal(38,0)") for part in parts]
    weights = [F.lit(w).cast("decimal(38,0)") for w in (1, 1 << 22, 1 << 43)]
    terms = [(total * weight).cast("decimal(38,0)") for total, weight in zip(wide, weights)]
    return F.coalesce((terms[0] + terms[1] + terms[2]).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """``by``, ``rows``, ``sum_a``, ``sum_b``: what the rows of each part add up to, in any order.

    Two independent hashes of every row are summed, so the same rows as often give the
    same numbers, however they are ordered, cut into files or compressed. A NULL is
    told from another, and so are copies. One row per task and part is shuffled.
    """
    columns = _hashable(df)
    one, other = F.xxhash64(*columns), F.xxhash64(F.lit("other"), *reversed(columns))
    rows = df.select(*[F.col(f"`{c}`") for c in by], one.alias("_one"), other.alias("_other"))
    sums = [_hash_sum(F.col("_one")).alias("sum_a"), _hash_sum(F.col("_other")).alias("sum_b")]
    return rows.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count(F.lit(1)).alias("rows"), *sums)


def one_text(fields: Sequence[StructField]) -> Column:
    """The columns of a row as one text, the same for the same values only; NULL is a value.

    An equality of one expression over partition columns is what Spark prunes by.
    """
    values = [F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, (FloatType, DoubleType)) else F.col(f"`{f.name}`") for f in fields]
    parts = [F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("")) for value in values]
    return F.concat_ws("/", *[F.length(part).cast("string") for part in parts], *parts)


def differing_parts(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """The parts, by the columns ``by``, whose fingerprints differ: ``by, rows_before, rows_after``.

    A part that one side lacks has 0 rows there; NULL is a part of its own.
    """
    sides = [fingerprint(side, *by).withColumn("_after", F.lit(after_it)) for side, after_it in ((before, False), (after, True))]
    rows = lambda wanted: F.coalesce(F.sum(F.when(F.col("_after") == wanted, F.col("rows"))), F.lit(0))
    facts = F.count_distinct("rows", "sum_a", "sum_b").alias("_facts")
    both = sides[0].unionByName(sides[1]).groupBy(*[F.col(f"`{c}`") for c in by])
    compared = both.agg(rows(False).alias("rows_before"), rows(True).alias("rows_after"), facts, F.count(F.lit(1)).alias("_sides"))
    unlike = (F.col("_facts") > 1) | ((F.col("_sides") < 2) & (F.col("rows_before") + F.col("rows_after") > 0))
    return compared.filter(unlike).drop("_facts", "_sides")


def row_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one side holds more often, with the surplus of ``after``.

    Empty when both hold the same rows. Copies are counted before the shuffle,
    and one shuffle answers both directions. :func:`table_differences` gives the
    same rows and shuffles only what differs.
    """
    columns = before.columns
    both = before.withColumn("_sign", F.lit(-1)).unionByName(after.withColumn("_sign", F.lit(1)))
    return (
        both.groupBy(*columns)
        .agg(F.sum("_sign").alias("surplus"))
        .filter(F.col("surplus") != 0)
    )


def table_differences(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """The rows of :func:`row_differences`, compared only in the parts whose fingerprints differ.

    Equal tables are proven equal by their fingerprints, one row per task and part.
    Otherwise the parts that differ are joined to both sides, which for the partition
    columns of a scan leaves out all other partitions before they are opened.
    """
    parts = differing_parts(before, after, *by)
    if parts.isEmpty():
        return row_differences(before.limit(0), after.limit(0))
    if not by:
        return row_differences(before, after)
    key = one_text([before.schema[c] for c in by])
    parts = parts.select(key.alias("_part"))
    return row_differences(*[side.join(parts, key == parts["_part"], "left_semi") for side in (before, after)])


# -- states -------------------------------------------------------------------


def _log_path(root: str) -> str:
    return f"{root.rstrip('/')}_log"


def _log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(_log_path(root))


def _head(spark: SparkSession, root: str, run_id: int | None = None) -> Row | None:
    """The log row of a run; the latest when no run is named."""
    try:
        log = _log(spark, root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if run_id is not None:
        log = log.filter(F.col("run_id") == run_id)
    return log.agg(F.max_by(F.struct("*"), "run_id").alias("head")).first()["head"]


def _need_head(spark: SparkSession, root: str, run_id: int | None = None) -> tuple[Row, StructType]:
    head = _head(spark, root, run_id)
    if head is None:
        raise ValueError(f"{root} has no run {run_id}" if run_id else f"nothing was published at {root}")
    return head, StructType.fromJson(json.loads(head["row_schema"]))


class _State:
    """What of a published table is alive at a run, as conditions on runs, partitions and sizes."""

    def __init__(self, spark: SparkSession, root: str, head: Row, schema: StructType) -> None:
        self.run_id, self.keys = head["run_id"], list(head["partition_by"])
        run = StructField("run", LongType())
        self.fields = [run, *[schema[k] for k in self.keys]]
        self.scan = spark.read.schema(StructType([*schema.fields, run])).parquet(root)
        self.listing = file_listing(spark, root, partitions=self.fields).filter(F.col("run") <= self.run_id)
        # per size, the last compaction that took files below it: as many rows as sizes were used
        replaced = _log(spark, root).filter((F.col("run_id") <= self.run_id) & F.col("small_bytes").isNotNull())
        self.replaced = replaced.select(F.col("run_id").alias("by_run"), "small_bytes")
        self.taken = [tuple(r) for r in self.replaced.groupBy("small_bytes").agg(F.max("by_run")).orderBy("small_bytes").collect()]

    def bands(self) -> list[tuple[int, int | None, int]]:
        """Ranges of file sizes, each with the last compaction that took files of it (0: none did)."""
        floors = [0, *[size for size, _ in self.taken]]
        ends = [*floors[1:], None]
        return [(low, high, max((run for size, run in self.taken if size > low), default=0)) for low, high in zip(floors, ends)]

    def sized(self, df: DataFrame, size: Column, low: int, high: int | None) -> DataFrame:
        """The rows of files of a band; without a band, no condition, as that would ask for file metadata."""
        if low:
            df = df.filter(size >= low)
        return df if high is None else df.filter(size < high)

    def alive(self, df: DataFrame, size: Column, *columns: str | Column) -> DataFrame:
        """Of the scan or the listing, what the state holds."""
        df = df.filter(F.col("run") <= self.run_id)
        frames = []
        for low, high, since in self.bands():
            band = self.sized(df, size, low, high)
            # a run's own files, and all later ones, were there after it
            frames.append(band.filter(F.col("run") >= since).select(*columns) if since else band.select(*columns))
            if since and self.keys:
                frames.append(self._spared(band.filter(F.col("run") < since), low).select(*columns))
        return reduce(DataFrame.unionAll, frames)

    def _spared(self, band: DataFrame, low: int) -> DataFrame:
        """Of files that some compaction took by their size, those in partitions that it left alone.

        The join is on what the directories' names hold, so Spark prunes them before it
        opens any. :attr:`place` makes one value of them, which prunes exactly.
        """
        directories = self.listing.select("run", *self.keys).distinct()
        wrote = self.replaced.filter(F.col("small_bytes") > low).select("by_run")
        taken = self.listing.join(wrote, F.col("run") == F.col("by_run"), "left_semi").select(F.col("run").alias("by_run"), *self.keys).distinct()
        same = reduce(Column.__and__, [directories[k].eqNullSafe(taken[k]) for k in self.keys])
        left = directories.join(taken, same & (taken["by_run"] > directories["run"]), "left_anti")
        left = left.select(self.place().alias("_place"))
        return band.join(left, self.place() == left["_place"], "left_semi")

    def place(self) -> Column:
        return one_text([self.scan.schema[name] for name in ("run", *self.keys)])


def read_state(spark: SparkSession, root: str, run_id: int | None = None) -> DataFrame:
    """The rows of a published table, as of a run or as of now."""
    head, schema = _need_head(spark, root, run_id)
    state = _State(spark, root, head, schema)
    return state.alive(state.scan, F.col(SCANNED), *schema.fieldNames())


def state_files(spark: SparkSession, root: str, run_id: int | None = None) -> DataFrame:
    """The file inventory of a state with its partition columns, files without rows included."""
    head, schema = _need_head(spark, root, run_id)
    state = _State(spark, root, head, schema)
    files = state.alive(state.listing, F.col("file_size_in_bytes"), *state.keys, *FILE)
    return file_inventory(state.scan.filter(F.col("run") <= state.run_id), *state.keys, listing=files)


def history(spark: SparkSession, root: str) -> DataFrame:
    """Every commit, oldest first."""
    return _log(spark, root).select("run_id", "committed_at", "operation", "summary").orderBy("committed_at", "run_id")


def _add_run(
    spark: SparkSession,
    root: str,
    head: Row | None,
    operation: str,
    schema: StructType,
    partition_by: Sequence[str],
    deleted: tuple[int, int] = (0, 0),
    small_bytes: int | None = None,
) -> None:
    """One row in the log: its counts are an aggregate over the files of the run's directory."""
    run_id = head["run_id"] + 1 if head else 1
    path = _run_path(root, run_id)
    written = file_inventory(spark.read.schema(schema).parquet(path), listing=file_listing(spark, path))
    counted = written.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))
    earlier = head["summary"] if head else {"total-data-files": 0, "total-records": 0}
    numbers = {
        "total-data-files": F.col("files") + (int(earlier["total-data-files"]) - deleted[0]),
        "total-records": F.col("records") + (int(earlier["total-records"]) - deleted[1]),
        "added-data-files": F.col("files"),
        "deleted-data-files": F.lit(deleted[0]),
    }
    entries = [part for name, number in numbers.items() for part in (F.lit(name), number.cast("string"))]
    row = counted.select(
        F.lit(run_id).cast("long").alias("run_id"),
        F.current_timestamp().alias("committed_at"),
        F.lit(operation).alias("operation"),
        F.create_map(*entries).alias("summary"),
        F.lit(schema.json()).alias("row_schema"),
        F.array(*map(F.lit, partition_by)).cast("array<string>").alias("partition_by"),
        F.lit(small_bytes).cast("long").alias("small_bytes"),
    )
    row.coalesce(1).write.mode("append").parquet(_log_path(root))


def _run_path(root: str, run_id: int) -> str:
    return f"{root}/run={run_id}"


def _write(df: DataFrame, path: str, partition_by: Sequence[str], mode: str = "overwrite") -> None:
    """A directory of this name can only be left from a write that never finished, so all of it goes."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "static")
    writer.partitionBy(*partition_by).parquet(path)


def publish(df: DataFrame, root: str, partition_by: Sequence[str] = ()) -> int:
    """Append ``df`` as a new state and return its run id.

    Rows of a partitioned table are gathered by partition first; the rebalance
    splits a partition that is large and joins small ones into one task.
    """
    spark = df.sparkSession
    head = _head(spark, root)
    if head is not None:
        schema, partition_by = StructType.fromJson(json.loads(head["row_schema"])), head["partition_by"]
        df = df.select(*schema.fieldNames())
        if [f.dataType for f in df.schema] != [f.dataType for f in schema]:
            raise ValueError(f"{root} holds {schema.simpleString()}, not {df.schema.simpleString()}")
    elif "run" in df.columns:
        raise ValueError("a published table cannot have a column named run")
    elif taken := {*partition_by} & {*StructType.fromDDL(LISTED).fieldNames(), *FILE}:
        raise ValueError(f"a published table cannot be partitioned by {sorted(taken)}")
    else:
        schema = df.schema
    run_id = head["run_id"] + 1 if head else 1
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    _write(rows, _run_path(root, run_id), partition_by)
    _add_run(spark, root, head, "append", schema, partition_by)
    return run_id


# -- compaction ---------------------------------------------------------------


def compact(
    spark: SparkSession,
    root: str,
    target_bytes: int = TARGET_BYTES,
    min_input_files: int = MIN_INPUT_FILES,
    small_share: float = SMALL_SHARE,
) -> DataFrame:
    """Rewrite small files into fewer files of about ``target_bytes``.

    Takes the files below ``small_share`` of the target, in each partition that has at least
    ``min_input_files`` of them and would end with fewer. Planned from the file
    listing alone: no file is opened and no row counted for it. Returns one row of
    counts, both 0 when there was nothing to do.
    """
    head, schema = _need_head(spark, root)
    state = _State(spark, root, head, schema)
    limit = int(target_bytes * small_share)
    chosen = _chosen(state, limit, target_bytes, min_input_files)
    if not chosen:
        return _result(spark, 0, F.lit(0))
    run_id = head["run_id"] + 1
    path, read, mode = _run_path(root, run_id), 0, "overwrite"
    for first in range(0, len(chosen), PARTITIONS_A_JOB):
        seen = Observation()
        rows = packed(spark, root, chosen[first : first + PARTITIONS_A_JOB], limit, target_bytes)
        _write(rows.observe(seen, F.count(F.lit(1)).alias("rows")), path, state.keys, mode)
        read, mode = read + seen.get["rows"], "append"
    fresh = spark.read.schema(schema).parquet(path)
    written = fresh.count()
    if read != written:
        raise RuntimeError(f"compaction read {read} rows and wrote {written}; nothing was published")
    files = sum(c["files"] for c in chosen)
    _add_run(spark, root, head, "replace", schema, state.keys, (files, read), limit)
    return _result(spark, files, F.col("summary")["added-data-files"], _log(spark, root).filter(F.col("run_id") == run_id))


def _chosen(state: _State, limit: int, target_bytes: int, min_input_files: int) -> list[Row]:
    """One row per partition that is worth it: keys, files, outputs, and per band of sizes its first run.

    Small files of one band of sizes that are alive are all those of a run and later ones.
    """
    size = F.col("file_size_in_bytes")
    band = F.lit(0)
    for low, _, _ in state.bands():
        if 0 < low < limit:
            band = F.when(size >= low, low).otherwise(band)
    small = state.alive(state.listing, size, "run", *state.keys, *FILE).filter(size < limit)
    banded = small.groupBy(*state.keys, band.alias("low")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.min("run").alias("since")
    )
    outputs = F.greatest(F.lit(1), F.ceil(F.sum("bytes") / target_bytes)).cast("int")
    bands = F.sort_array(F.collect_list(F.struct("low", "since"))).alias("bands")
    planned = banded.groupBy(*state.keys).agg(F.sum("files").alias("files"), outputs.alias("outputs"), bands)
    return planned.filter((F.col("files") >= min_input_files) & (F.col("outputs") < F.col("files"))).collect()


def packed(spark: SparkSession, root: str, chosen: Sequence[Row], limit: int, target_bytes: int) -> DataFrame:
    """The rows of the chosen partitions' small files; each task reads whole files of one partition.

    The scan itself packs files into tasks of up to ``target_bytes``, and tasks beyond the
    planned number of outputs are joined: nothing is shuffled, a row stays with its file.
    Partitions stay in tasks of their own, also where each is one task, and as every
    task holds one partition its rows go to one open file each, not through a sort.
    The settings hold in a session of its own, which leaves the caller's as it is.
    """
    own = own_session(
        spark,
        spark__sql__files__maxPartitionBytes=target_bytes,
        spark__sql__files__openCostInBytes=0,
        spark__sql__files__minPartitionNum=1,
        spark__sql__unionOutputPartitioning=False,
        spark__sql__optimizer__plannedWrite__enabled=False,
        spark__sql__maxConcurrentOutputFileWriters=1,
    )
    head, schema = _need_head(own, root)
    state = _State(own, root, head, schema)
    frames = []
    for row in chosen:
        rows = state.scan.filter(F.col("run") <= state.run_id)
        for key in state.keys:
            value = F.lit(row[key]).cast(schema[key].dataType)
            rows = rows.filter(F.col(f"`{key}`").isNull() if row[key] is None else F.col(f"`{key}`") == value)
        ends = [*[b["low"] for b in row["bands"]][1:], limit]
        parts = [
            state.sized(rows.filter(F.col("run") >= b["since"]), F.col(SCANNED), b["low"], high).select(*schema.fieldNames())
            for b, high in zip(row["bands"], ends)
        ]
        frames.append(reduce(DataFrame.unionAll, parts).coalesce(row["outputs"]))
    return reduce(DataFrame.unionAll, frames)


def _result(spark: SparkSession, rewritten: int, added: Column, of: DataFrame | None = None) -> DataFrame:
    return (spark.range(0, 1, 1, 1) if of is None else of).select(
        F.lit(rewritten).cast("long").alias("rewritten_data_files_count"),
        added.cast("long").alias("added_data_files_count"),
    )
