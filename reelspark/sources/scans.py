"""File scans, dictionaries and sinks."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of each kind of scan.
VIDEO = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "wmv")
IMAGE = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")
# Suffixes that a folder is searched for when none are named, in this order.
DEFAULT_INPUT = (".mp4", ".mov", ".mkv", ".avi", ".m4v", ".webm")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def of_kind(paths: DataFrame, suffixes: Sequence[str], path: str = "path") -> DataFrame:
    """Rows whose path has one of the suffixes, in any case."""
    return paths.where(suffix(F.col(path)).isin(*suffixes))


def scan(spark: SparkSession, root: str, suffixes: Sequence[str], content: bool = False) -> DataFrame:
    """Files under a folder, at any depth, with one of the suffixes: path, length, modificationTime, perhaps content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return of_kind(files if content else files.drop("content"), suffixes)


def flat_scan(paths: DataFrame, suffixes: Sequence[str] = IMAGE) -> DataFrame:
    """The same in order of path; an empty scan is an error."""
    found = of_kind(paths, suffixes).orderBy("path")
    if found.isEmpty():
        raise ValueError("no image files found")
    return found


def listed(lines: DataFrame) -> DataFrame:
    """Paths of a list file (row_ord, line): blank lines and comments go."""
    line = F.trim("line")
    return lines.where((line != "") & ~line.startswith("#")).select(line.alias("path"), "row_ord")


def absolute(path: Column, base: str) -> Column:
    """The path from the root, without empty, ``.`` and ``..`` parts; a relative one starts at ``base``."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def inputs(files: DataFrame, base: str, folder: bool = True, patterns: Sequence[str] = (), suffixes: Sequence[str] = (), lists: DataFrame | None = None) -> DataFrame:
    """(path, src_ord, row_ord): the files that are named, each once, by the first source that names it.

    ``files`` (path) are the regular files there are. Sources in order: each glob pattern under
    ``base``, then for a folder each suffix (as it is written; by default the usual ones), each sorted
    by path, then the lines of list files (row_ord, line) in order.
    """
    known = files.select(absolute(F.col("path"), base).alias("path")).distinct()
    found = []
    for k, glob in enumerate(patterns):
        regex = "".join(".*" if x == "**/" else "[^/]*" if x == "*" else "[^/]" if x == "?" else re.escape(x) for x in re.findall(r"\*\*/|.", glob))
        found.append(known.where(F.col("path").rlike("^" + re.escape(base.rstrip("/") + "/") + regex + "$")).withColumns({"src_ord": F.lit(k), "row_ord": F.lit(None).cast("long")}))
    for k, end in enumerate((suffixes or DEFAULT_INPUT) if folder else ()):
        found.append(known.where(F.col("path").startswith(base.rstrip("/") + "/") & F.col("path").endswith(end)).withColumns({"src_ord": F.lit(len(patterns) + k), "row_ord": F.lit(None).cast("long")}))
    if lists is not None:
        named = listed(lists).select(absolute(F.col("path"), base).alias("path"), F.lit(1_000_000).alias("src_ord"), F.col("row_ord").cast("long").alias("row_ord"))
        found.append(named.join(known, "path", "left_semi").select("path", "src_ord", "row_ord"))
    rows = functools.reduce(DataFrame.unionByName, found)
    return rows.groupBy("path").agg(F.min(F.struct("src_ord", "row_ord")).alias("_o")).select("path", "_o.src_ord", "_o.row_ord")


def tag_dictionary(texts: DataFrame, column: str = "value") -> DataFrame:
    """(other columns, idx, name, category) of the lines of CSV texts, each a whole file in one row: header first.

    A missing category is 0; the index is the line's place, taken from the text itself.
    """
    lines = F.filter(F.split(column, r"\r?\n"), lambda x: F.trim(x) != "")
    rest = [c for c in texts.columns if c != column]
    # Split before the rows are made: beside posexplode, Spark would work the head out from the whole text again for each line.
    parts = texts.select(*rest, lines.alias("lines")).select(*rest, F.split(F.get("lines", F.lit(0)), ",").alias("head"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("lines"))
    rows = parts.select(*rest, "head", F.posexplode("lines").alias("idx", "line"))
    rows = rows.withColumn("cells", F.expr("from_csv(line, 'a string, b string, c string, d string', map('mode', 'PERMISSIVE'))"))
    cell = lambda name: F.get(F.array("cells.a", "cells.b", "cells.c", "cells.d"), (F.array_position("head", name) - 1).cast("int"))
    value = lambda name: F.when(F.array_position("head", name) > 0, cell(name))
    return rows.select(*rest, F.col("idx").cast("long").alias("idx"), value("name").alias("name"), F.coalesce(value("category").cast("int"), F.lit(0)).alias("category"))


def read_tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return tag_dictionary(spark.read.text(path, wholetext=True))


CONFIG = "struct<label:string,source_label:string,find:string,replace:string,reference_paths:array<string>,portrait_paths:array<string>,similarity_threshold:double>"


def characters(configs: DataFrame, column: str = "json") -> DataFrame:
    """One row for each character of JSON configurations, with defaults and older names resolved."""
    parsed = configs.withColumn("_c", F.from_json(column, f"struct<characters:array<{CONFIG}>>"))
    rows = parsed.select(*[c for c in configs.columns if c != column], F.posexplode("_c.characters").alias("ord", "c"))
    folder = (F.col("c.find").isNotNull()) & (F.col("c.replace").isNotNull())
    name = F.regexp_extract(F.regexp_replace(F.col("c.find"), "/+$", ""), "([^/]*)$", 1)
    label = F.when(folder, F.coalesce("c.label", name)).otherwise(F.coalesce("c.source_label", "c.label"))
    return rows.select(*[c for c in rows.columns if c != "c"], label.alias("source_label"), folder.alias("from_folders"), "c.find", "c.replace", "c.reference_paths", "c.portrait_paths", F.coalesce("c.similarity_threshold", F.lit(0.5)).alias("similarity_threshold"))


def config_errors(runs: DataFrame, characters_: DataFrame, files: DataFrame) -> DataFrame:
    """(run, errors): what is wrong with each run's configuration, in order of the checks; no row list is empty.

    ``runs``: run, input_video, output_video. ``characters_``: run, ord, source_label,
    reference_paths, portrait_paths. ``files``: the paths that exist. Paths are looked up by a join.
    """
    label = F.col("source_label")
    # The messages.
    no_references = F.concat(F.lit("Character '"), label, F.lit("' has no reference images (needed to identify the face in the video)"))
    no_portraits = F.concat(F.lit("Character '"), label, F.lit("' has no portrait images (the replacement face)"))
    kinds = (("reference_paths", no_references, "Reference image not found for '"), ("portrait_paths", no_portraits, "Portrait not found for '"))
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    found = []
    for k, (column, none, missing) in enumerate(kinds):
        size = F.coalesce(F.size(column), F.lit(0))
        found.append(characters_.where(size <= 0).select("run", F.lit(5).alias("check"), "ord", F.lit(2 * k).alias("part"), F.lit(0).alias("at"), none.alias("error")))
        each = characters_.select("run", "ord", "source_label", F.posexplode(column).alias("at", "path")).join(there, "path", "left").where("there is null")
        found.append(each.select("run", F.lit(5).alias("check"), "ord", F.lit(2 * k + 1).alias("part"), "at", F.concat(F.lit(missing), label, F.lit("': "), "path").alias("error")))
    counts = characters_.groupBy("run").agg(F.count("*").alias("n"))
    whole = runs.select("run", "input_video", "output_video").join(counts, "run", "left").join(there.withColumnRenamed("path", "input_video"), "input_video", "left")
    n, video = F.coalesce("n", F.lit(0)), F.coalesce("input_video", F.lit(""))
    checks = F.array(
        F.when(video == "", "input_video is required").when(F.col("there").isNull(), F.concat(F.lit("input_video not found: "), video)),
        F.when(F.coalesce("output_video", F.lit("")) == "", "output_video is required"),
        F.when(n == 0, "At least one character mapping is required"),
        F.when(n > 3, "Maximum of 3 character replacements supported"),
    )
    none = F.lit(0)
    found.append(whole.select("run", F.posexplode(checks).alias("check", "error")).where("error is not null").select("run", "check", none.alias("ord"), none.alias("part"), none.alias("at"), "error"))
    errors = functools.reduce(DataFrame.unionByName, found).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("check", "ord", "part", "at", "error"))).alias("e"))
    return runs.select("run").join(errors, "run", "left").select("run", F.coalesce(F.transform("e", lambda x: x["error"]), F.array().cast("array<string>")).alias("errors"))


def command_line(options: Column) -> Column:
    """A map of options (name to list of values) as arguments: null drops, [true] is a bare flag, [false] and [] drop."""
    def one(e: Column) -> Column:
        flag = F.concat(F.lit("--"), F.replace(e["key"], F.lit("_"), F.lit("-")))
        v = e["value"]
        bare = (F.size(v) == 1) & (v[0] == "true")
        gone = v.isNull() | (F.size(v) == 0) | ((F.size(v) == 1) & (v[0] == "false"))
        return F.when(gone, F.array().cast("array<string>")).when(bare, F.array(flag)).otherwise(F.concat(F.array(flag), v))

    return F.flatten(F.transform(F.array_sort(F.map_entries(options)), one))


def sidecar_path(path: Column, suffix_: str = ".txt") -> Column:
    """The path of the text beside a file: its last suffix is replaced."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(suffix_))


def _located(path: str):
    """The file system of a path, and the path in it. Local names are taken as they are, other schemes as URIs by Arrow's file systems."""
    from pyarrow import fs

    if path.startswith("file:") or ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def write_sidecars(texts: DataFrame, overwrite: bool = True) -> DataFrame:
    """Write each (path, text) row's text to the file at its path, through the file system of the path; returns (path, status).

    Tasks write their own rows, so nothing is gathered; a file that is there stays unless ``overwrite``.
    A text is written to a name of its attempt first and then renamed, so a task that is run again
    leaves whole files. That name begins with a dot, so no reader takes what a killed attempt has left for a text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            status = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = _located(path)
                if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
                    status.append("skipped_existing")
                    continue
                folder, _, name = at.rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write((text or "").encode())
                store.move(part, at)
                status.append("created")
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "status": pa.array(status, pa.string())})

    return texts.select("path", "text").mapInArrow(run, "path string, status string")


def read_sidecars(paths: DataFrame, most: int = 8 << 20) -> DataFrame:
    """Adds the text of the file at each row's path, in batches of about ``most`` bytes.

    Only the named files are read, so folders need not be listed; empty ones count, and any name is taken as it is.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*paths.schema.fields]).add("text", StringType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, size, found = 0, 0, []
            for k, path in enumerate(batch.column("path").to_pylist()):
                store, at = _located(path)
                with store.open_input_stream(at) as file:
                    found.append(file.read().decode())
                size += len(found[-1])
                if size >= most or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begun, len(found)).columns, pa.array(found, pa.string())], schema=arrow)
                    begun, size, found = k + 1, 0, []

    return paths.mapInArrow(run, schema)
