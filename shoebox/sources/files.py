"""Media folders and exchange files as DataFrames."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a file that are read at once, and bytes of files that a task hashes, about.
CHUNK, TASK_BYTES = 4 << 20, 8 << 30
_FILES = "project_id bigint, file_path string, file_size bigint, mtime timestamp"


def listing(roots: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, file_path, file_size, mtime) of all files below each project's roots (project_id, path), except below ``excluded`` folders.

    Folders are listed level by level, each by one task, so a root of any size is listed in parallel. Roots inside other roots of a
    project are listed once; a root that isn't there has no files. Paths are as Arrow's file systems take them (URIs or local paths).
    """
    from shoebox.operators.ingest import outer_roots

    schema = pa.schema([("project_id", pa.int64()), ("file_path", pa.string()), ("file_size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for project, folder in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                system, path = fs.FileSystem.from_uri(folder)
                head = folder.removesuffix(path)
                found = system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
                kept = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory)]
                columns = [[project] * len(kept), [head + f.path for f in kept], [f.size if f.type == fs.FileType.File else None for f in kept], [f.mtime for f in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    left, files = outer_roots(roots).select(F.col("project_id").cast("bigint"), "path"), None
    allowed = reduce(and_, (~F.concat("path", F.lit("/")).startswith(f"{x.rstrip('/')}/") for x in excluded), F.lit(True))
    while True:
        left = written(left.where(allowed))
        if left.isEmpty() and files is not None:
            return files
        found = written(left.repartition("path").mapInArrow(look, _FILES))
        own = found.where("file_size IS NOT NULL")
        files = own if files is None else files.union(own)
        left = found.where("file_size IS NULL").select("project_id", F.col("file_path").alias("path"))


def inventory(roots: DataFrame, excluded: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """(project_id, file_path, file_size, mtime, file_hash) of the media files below the roots of ``listing``.

    The hash is the SHA-256 of the content, read in chunks, so a file may have any size. Files of ``known`` (the columns of the last
    inventory) whose size and time are the same keep their hash and aren't read; the others are dealt to tasks by size. A file that is
    gone meanwhile has a null hash.
    """
    from shoebox.operators.ingest import media_files

    found = media_files(listing(roots, excluded))
    names = [x.split()[0] for x in _FILES.split(", ")]
    if known is None:
        same = None
    else:
        same = written(found.join(known.where("file_hash IS NOT NULL").select(*names, "file_hash"), names))
        found = found.join(same.select("project_id", "file_path"), ["project_id", "file_path"], "left_anti")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array([_sha256(path) for path in whole.column(1).to_pylist()], pa.string())], [*whole.schema.names, "file_hash"])

    found = written(found)
    bins = max(1, -(-(found.agg(F.sum("file_size")).first()[0] or 0) // TASK_BYTES), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The largest first, round and round.
    from shoebox.operators.order import running_counts

    dealt = running_counts(found, [], [F.desc("file_size"), F.col("project_id"), F.col("file_path")], F.lit(True)).repartition(bins, F.col("before") % bins).select(*names)
    hashed = dealt.mapInArrow(digest, f"{_FILES}, file_hash string")
    return hashed if same is None else hashed.union(same.select(*hashed.columns))


def write_files(rows: DataFrame) -> int:
    """Write rows (file_path, content binary) as files, folders included; their number. A null content is an empty file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for path, content in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                system, local = fs.FileSystem.from_uri(path)
                system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(local) as stream:
                    stream.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(whole)], pa.int64())], ["n"])

    return rows.select("file_path", "content").mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def _sha256(path: str) -> str | None:
    system, local = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    try:
        with system.open_input_stream(local) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
    except FileNotFoundError:
        return None
    return digest.hexdigest()


def manifest_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, value): the lines of text files with their numbers from 1, blank ones and a cut last one counted.

    Lines end with LF, CR LF or CR. Parts of a file are read by several tasks: each part's lines are numbered by themselves and the
    numbers of lines before it added.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    read = written(read)
    sizes = read.groupBy("file", "part").agg(F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select("file", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    return read.withColumn("own", own).join(parts, ["file", "part"]).select("file", (F.col("before") + F.col("own")).alias("n"), "value")


def write_manifest(lines: DataFrame, path: str) -> None:
    """Append entries to a JSON-lines manifest, keys sorted; ``append_manifest`` also holds when a batch is repeated."""
    lines.select(*sorted(lines.columns)).write.mode("append").json(path)


def append_manifest(lines: DataFrame, path: str, batch: str) -> bool:
    """Add the entries of a batch to the manifest at ``path``; false if the batch is there already.

    Entries (keys sorted, one JSON object a line) are written to a folder of their own. It counts once the batch's marker, which names it,
    has been renamed into place, in one step. A run that fails before leaves nothing that counts; of two writers of a batch one marker
    stays, so each line counts once.
    """
    spark = lines.sparkSession
    base = path.rstrip("/")
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda name: hadoop.Path(f"{base}/{name}")
    store = at("").getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at(f"_commits/{batch}")):
        return False
    part = f"part-{uuid.uuid4().hex}"
    lines.select(*sorted(lines.columns)).write.json(f"{base}/_data/{part}")
    out = store.create(at(f"_staged/{part}"))
    out.write(bytearray(part.encode()))
    out.close()
    store.mkdirs(at("_commits"))
    return store.rename(at(f"_staged/{part}"), at(f"_commits/{batch}"))


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, value) of the lines of all batches that ``append_manifest`` has finished."""
    base = path.rstrip("/")
    parts = [r["value"] for r in spark.read.text(f"{base}/_commits").collect()]
    return manifest_lines(spark, [f"{base}/_data/{part}" for part in parts])


#: Columns of the export, and those of the items they come from.
EXPORT = {"item_id": "id", "photo_id": "photo_id", "classification": "classification", "model_decision": "decision", "confidence": "confidence", "human_label": "human_label", "human_label_note": "human_label_note", "human_labeled_by": "human_labeled_by", "human_labeled_at": "human_labeled_at", "model_name": "model_name", "prompt_version": "prompt_version"}


def calibration_rows(items: DataFrame) -> DataFrame:
    """The eleven columns of the export, and project_id, of items that a human has labelled; those that items lack are null."""
    columns = [F.col(old).alias(new) if old in items.columns else F.lit(None).cast("string").alias(new) for new, old in EXPORT.items()]
    return items.where("human_label IS NOT NULL").select("project_id", *columns)


def export_calibration(items: DataFrame, path: str) -> None:
    """Labelled items as CSV with a header, newest label first, then the highest id."""
    calibration_rows(items).orderBy(F.desc_nulls_last("human_labeled_at"), F.desc("item_id")).drop("project_id").write.option("header", True).csv(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A library table, one folder for each project."""
    rows.write.partitionBy("project_id").parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A library table as ``write_table`` left it; Spark reads only the folders of the projects that are asked for."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_database(spark: SparkSession, url: str, table: str, lowest: int, highest: int, partitions: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ``partitions`` ranges of its id; ``options`` as of Spark's jdbc source (driver, user, …)."""
    bounds = {"partitionColumn": "id", "lowerBound": lowest, "upperBound": highest, "numPartitions": partitions}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; with a local master that names none, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shoebox-")
    return f"{base.rstrip('/')}/shoebox-{uuid.uuid4().hex}"


def written(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` as a new Parquet table in the shared scratch folder, which cuts their lineage; with ``by`` in a folder for each value."""
    path = f"{scratch(rows.sparkSession)}/table"
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
