"""Log files: scanning, numbering, tails, pages and inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from logquarry.functions import fixed
from logquarry.functions.text import any_of, basename
from logquarry.operators.joins import fits_broadcast
from logquarry.operators.running import computed_once, running_sum, settled

SAMPLE_BYTES = 8192


def _listable(path: Column, read_compressed: bool, skip_names: list[str]) -> Column:
    """Neither a skipped name nor a compressed file (gzip only on request)."""
    name = basename(path)
    packed = [F.lower(name).endswith(s) for s in fixed.COMPRESSED_SUFFIXES if not (read_compressed and s == ".gz")]
    return ~name.isin(skip_names) & ~any_of(packed)


def plain_path(uri: Column) -> Column:
    """A listed path as people write it: local files without a scheme."""
    return F.regexp_replace(uri, "^file:/+", "/")


def scanned_path() -> Column:
    """The path of the file a line came from (file metadata hold it percent-encoded)."""
    return plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def _reader(spark: SparkSession, glob: str, recursive: bool):
    reader = spark.read.option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", "true") if recursive else reader


def file_inventory(
    spark: SparkSession,
    roots: list[str],
    *,
    glob: str = "*",
    recursive: bool = True,
    read_compressed: bool = True,
    skip_names: list[str] | None = None,
) -> DataFrame:
    """path, name, size, mtime and compressed of every listable file. Contents are not read."""
    files = _reader(spark, glob, recursive).format("binaryFile").load(roots)
    names = fixed.SKIPPED_LOG_NAMES if skip_names is None else skip_names
    return files.filter(_listable(F.col("path"), read_compressed, names)).select(
        plain_path(F.col("path")).alias("path"),
        basename(F.col("path")).alias("name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("mtime"),
        F.lower("path").endswith(".gz").alias("compressed"),
    )


def describe_files(files: DataFrame, root: str) -> DataFrame:
    """Inventory columns derived from a path list (path, size_bytes)."""
    from logquarry.operators.search import source_group

    return files.select(
        "path",
        basename(F.col("path")).alias("name"),
        source_group(F.col("path"), root).alias("group_label"),
        "size_bytes",
        F.lower("path").endswith(".gz").alias("compressed"),
    )


_PRINTABLE = b"\t\n\r" + bytes(range(32, 127))
_CONTROL = bytes(b for b in [*range(32), 127] if b not in b"\t\n\r")


def looks_binary(head: bytes) -> bool:
    """A NUL byte, or less than 85 % printable ASCII."""
    rest = head.translate(None, _PRINTABLE)
    return b"\0" in rest or len(rest) * 100 > 15 * len(head)


def looks_binary_lenient(head: bytes) -> bool:
    """A NUL byte, or more than 10 % control bytes; texts that start with a byte-order mark pass."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff", b"\xef\xbb\xbf")):
        return False
    control = len(head) - len(head.translate(None, _CONTROL))
    return b"\0" in head or control * 10 > len(head)


def mark_binary_files(inventory: DataFrame, *, lenient: bool = False) -> DataFrame:
    """Add ``binary``: only the first 8 KB of each file is read, by the task that holds its inventory row.

    Gzip files are judged text, as their content is only seen unpacked.
    """
    test = looks_binary_lenient if lenient else looks_binary

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for frame in frames:
            verdicts = []
            for path in frame["path"]:
                if path.lower().endswith(".gz"):
                    verdicts.append(False)
                    continue
                store, inner = FileSystem.from_uri(path)
                with store.open_input_stream(inner) as stream:
                    verdicts.append(test(stream.read(SAMPLE_BYTES)))
            yield frame.assign(binary=verdicts)

    schema = StructType([*inventory.schema.fields, StructField("binary", BooleanType())])
    return inventory.mapInPandas(judge, schema)


def drop_binary_files(lines: DataFrame, inventory: DataFrame, *, lenient: bool = False) -> DataFrame:
    """Lines whose file is not binary. Files are judged first; the binary ones go to every executor if they were counted
    and found few, so that lines are dropped where they are read and never shuffled by their file."""
    binary = mark_binary_files(inventory, lenient=lenient).filter("binary").select(F.col("path").alias("source"))
    binary = settled(binary, "binary-files")
    return lines.join(F.broadcast(binary) if fits_broadcast(binary) else binary, "source", "left_anti")


def scan_log_lines(
    spark: SparkSession,
    roots: list[str],
    *,
    glob: str = "*",
    recursive: bool = True,
    read_compressed: bool = False,
    skip_names: list[str] | None = None,
) -> DataFrame:
    """Every line of every text log below the roots, with where it stands in its file.

    ``block_start`` is the offset of the file split a line came from and ``block_order`` rises within it, which
    is what numbering needs without ever holding a file in one task.
    """
    names = fixed.SKIPPED_LOG_NAMES if skip_names is None else skip_names
    lines = _reader(spark, glob, recursive).text(roots)
    lines = lines.select(scanned_path().alias("_path"), F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block_start"))
    # the path is the same for all lines of a file, but is decoded for each: once, not for every test of it
    found = computed_once(lines, "source", F.col("_path"))
    found = found.filter(_listable(F.col("source"), read_compressed, names))
    return found.select("source", "line", "block_start", F.monotonically_increasing_id().alias("block_order"))


def number_lines(lines: DataFrame, *, file: Column | None = None) -> DataFrame:
    """0-based line index per source for scanned lines; blank lines are counted (drop them afterwards).

    Rows of one file split are numbered together, and the splits of a source by the sums before them. ``file``
    orders several files of one source (default: the source is the file).
    """
    df = lines.withColumn("_file", F.col("source") if file is None else file)
    split = ["source", "_file", "block_start"]
    counts = df.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("source").orderBy("_file", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    local = F.row_number().over(Window.partitionBy(*split).orderBy("block_order")) - 1
    numbered = df.join(counts, split).withColumn("line_index", F.col("_before") + local)
    return numbered.drop("_file", "_before", "block_start", "block_order")


# --- tails and pages over numbered lines -------------------------------------------------------------------


def _tail(lines: DataFrame, max_bytes: int, compressed: bool) -> DataFrame:
    if compressed:
        lines = lines.filter(F.length("line") > 0)
    cost = F.octet_length("line") + 1
    tail = running_sum(
        lines, ["source"], "line_index", cost, out="_bytes", total="_size", reverse=True, below=max(max_bytes, 1)
    )
    fits = F.col("_bytes") <= max_bytes
    if not compressed:
        fits = (F.col("_bytes") < max_bytes) | (F.col("_size") <= max_bytes)
    return tail.filter(fits).drop("_bytes", "_size")


def tail_bytes(lines: DataFrame, max_bytes: int) -> DataFrame:
    """Whole lines in the last bytes of each source.

    A plain file loses the line the cut falls into, also when it falls exactly on a line start; a gzip file keeps
    non-blank lines while they fit.
    """
    gz = F.lower("source").endswith(".gz")
    plain = _tail(lines.filter(~gz), max_bytes, compressed=False)
    return plain.unionByName(_tail(lines.filter(gz), max_bytes, compressed=True))


def tail_since(lines: DataFrame, since: Column, max_bytes: int | None = None) -> DataFrame:
    """All non-blank lines from a time on; lines without a timestamp stay.

    With ``max_bytes`` only the last bytes of these are kept, and ``window_cut`` tells the sources that had more.
    """
    recent = F.col("ts").isNull() | (F.col("ts") >= since)
    found = lines.filter(recent & (F.length("line") > 0))
    if max_bytes is None:
        return found
    sizes = found.groupBy("source").agg((F.sum(F.octet_length("line") + 1) > max_bytes).alias("window_cut"))
    return tail_bytes(found, max_bytes).join(sizes, "source")


def tail_since_or_recent(lines: DataFrame, since: Column, max_bytes: int) -> DataFrame:
    """All non-blank lines from a time on; a source without any shows its last bytes, flagged ``window_fallback``."""
    windowed = tail_since(lines, since)
    active = windowed.select("source").distinct()
    narrow = tail_bytes(lines, max_bytes).filter(F.length("line") > 0)
    idle = narrow.join(active, "source", "left_anti")
    return windowed.withColumn("window_fallback", F.lit(False)).unionByName(idle.withColumn("window_fallback", F.lit(True)))


def page_lines(
    lines: DataFrame, source: str, *, direction: str, line: int | None = None, limit: int = 500
) -> DataFrame:
    """One page of a source by key set, in file order, with has_older and has_newer.

    ``older`` ends before a line, ``newer`` and ``forward`` start after or at one, ``tail`` is the end.
    """
    mine = lines.filter((F.col("source") == source) & (F.length("line") > 0))
    if direction == "older" and line is not None:
        part, order = mine.filter(F.col("line_index") < line), F.desc
    elif direction in ("newer", "forward"):
        after = -1 if line is None else (line if direction == "newer" else line - 1)
        part, order = mine.filter(F.col("line_index") > after), F.asc
    elif direction in ("tail", "older"):
        part, order = mine, F.desc
    else:
        raise ValueError("direction must be tail, older, newer or forward")
    page = part.orderBy(order("line_index")).limit(limit)
    first, last = mine.agg(F.min("line_index"), F.max("line_index")).first()
    edges = Window.partitionBy()  # a page: at most ``limit`` rows
    return (
        page.withColumn("has_older", F.min("line_index").over(edges) > F.lit(first))
        .withColumn("has_newer", F.max("line_index").over(edges) < F.lit(last))
        .orderBy("line_index")
    )


def full_source_lines(lines: DataFrame, source: str, max_bytes: int) -> DataFrame:
    """All non-blank lines of one source in file order, up to the last ``max_bytes``."""
    mine = tail_bytes(lines.filter(F.col("source") == source), max_bytes)
    return mine.filter(F.length("line") > 0).orderBy("line_index")
