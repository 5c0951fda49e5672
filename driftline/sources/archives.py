"""Lines of plain, compressed, archived and journal files, as one DataFrame.

The listing is filtered before anything is opened, and so are the entries of archives; what cannot be read
becomes a row in ``error``, not a failed run.  Files are read by Spark's own reader, from any store, and
their lines leave in bounded batches.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import paths
from ..functions.config import TargetConfig
from ..operators import splitting
from . import journal

ROWS_OUT = 20_000
UNREADABLE = (OSError, EOFError, tarfile.TarError, lzma.LZMAError, zlib.error, UnicodeDecodeError, journal.JournalError)
_TAR = (".tar", ".tar.gz", ".tar.xz", ".tgz")


def _plain(name: str, data: bytes) -> bytes:
    if name.endswith(".gz"):
        return gzip.decompress(data)
    if name.endswith(".xz"):
        return lzma.decompress(data)
    return bz2.decompress(data) if name.endswith(".bz2") else data


def entries(name: str, data: bytes, wanted: Callable[[str], bool] = lambda _: True) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the regular files that a file holds; archives in archives too (``outer?entry=a&sub=b``)."""
    if not name.endswith(_TAR):
        yield name, _plain(name, data)
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        for member in tar:
            if member.isfile() and (member.name.endswith(_TAR) or wanted(member.name)):
                sign = "&sub=" if "?entry=" in name else "?entry="
                yield from entries(f"{name}{sign}{member.name}", tar.extractfile(member).read(), wanted)


def file_format(name: str) -> str:
    if name.endswith((".journal", ".journal~")):
        return "journal"
    bare = name.removesuffix(".gz")
    return "json" if bare.endswith(".json") else "xml" if bare.endswith(".xml") else "text"


def lines_of(name: str, raw: bytes) -> Iterator[tuple[int, str]]:
    form = file_format(name)
    return journal.lines(io.BytesIO(raw)) if form == "journal" else splitting.pieces(raw.decode(), form)


def listing(spark: SparkSession, root: str, config: TargetConfig | None = None) -> DataFrame:
    """(path, relative, modificationTime, length) of the regular files under root that the configuration takes.

    Hidden files are left out, hidden folders are not; relative begins with a slash.
    """
    config = config or TargetConfig()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z]+:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(base), "")
    files = files.withColumn("relative", relative)
    return files.where(config.included(F.col("relative")) & ~F.regexp_extract("path", "[^/]*$", 0).startswith("."))


def read_lines(spark: SparkSession, root: str, config: TargetConfig | None = None) -> DataFrame:
    """(path, index_name, seq, pos, line, error) of all included files under root; seq counts the lines of a path."""
    config = config or TargetConfig()
    excludes = re.compile("|".join([*config.excludes, *(P.EXCLUDED_PATHS if config.default_excludes else ())]) or r"(?!)")
    includes = re.compile("|".join(config.includes))

    def wanted(entry: str) -> bool:
        bare = re.sub(r"(\.gz)+\Z", "", entry)
        return bool(includes.search(bare)) and not excludes.search(bare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "seq", "pos", "line", "error"])

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    for name, raw in entries(path, data.as_py(), wanted):
                        for seq, (pos, line) in enumerate(lines_of(name, raw), 1):
                            rows.append((name, seq, pos, line, None))
                            if len(rows) == ROWS_OUT:
                                yield out(rows)
                                rows = []
                except UNREADABLE as problem:  # one bad file is reported, the others are read
                    rows.append((path, None, None, None, f"{type(problem).__name__}: {problem}"))
                if rows:
                    yield out(rows)

    files = listing(spark, root, config).select("path", "content")
    lines = files.mapInArrow(run, "path string, seq long, pos long, line string, error string")
    local = F.regexp_replace("path", "^[a-z]+:/*", "/")
    outer, inner = F.substring_index(local, "?entry=", 1), F.regexp_extract(local, "\\?entry=(.*)$", 1)
    name = F.when(inner != "", F.concat(paths.index_name(outer), F.lit("__"), paths.index_name(inner))).otherwise(paths.index_name(local))
    return lines.withColumn("index_name", name)


def read_errors(lines: DataFrame) -> DataFrame:
    return lines.where("error is not null").select("path", "error")


def log_lines(lines: DataFrame) -> DataFrame:
    """The same as (index_name, source, seq, pos, line), for training and reports."""
    return lines.where("error is null").select("index_name", F.col("path").alias("source"), "seq", "pos", "line")


def groups(lines: DataFrame) -> DataFrame:
    """(index_name, sources, n_sources): which sources make up an index; archives apart by their entry."""
    return lines.groupBy("index_name").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("source").alias("n_sources"))
