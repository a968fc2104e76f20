"""Code files from directory trees, archives and tables."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import CODE_SUFFIXES, REPOSITORY, language_of, line_count, suffix

#: Default caps: files of a remote tree, after filtering; entries of an archive, before it.
TREE_FILES, ARCHIVE_ENTRIES = 50, 100
NO_REPOSITORY = "Could not access repository. Make sure it's public."
ENTRIES = "archive string, seq long, path string, content string"


def is_code(path: Column, fold_case: bool) -> Column:
    return (F.lower(suffix(path)) if fold_case else suffix(path)).isin(*CODE_SUFFIXES)


def _as_files(entries: DataFrame, analysis_id: str) -> DataFrame:
    return entries.select(
        F.lit(analysis_id).alias("analysis_id"), "seq", "path", "content",
        language_of(F.col("path")).alias("language"), line_count(F.col("content")).alias("lines"),
    )


def read_tree(spark: SparkSession, root: str, analysis_id: str, limit: int | None = TREE_FILES) -> DataFrame:
    """Code files below ``root``, in path order; case-sensitive suffixes, capped after the filter.

    ``limit=None`` reads all. Bytes that are not UTF-8 are replaced by Spark's cast.
    """
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index(F.col("path"), base, -1)
    picked = found.select(name.alias("path"), "content").where(is_code(F.col("path"), fold_case=False))
    picked = picked.orderBy("path").limit(limit) if limit is not None else picked
    order = F.row_number().over(_by_path()) if limit is not None else F.xxhash64("path")
    return _as_files(picked.select(order.cast("long").alias("seq"), "path", F.col("content").cast("string").alias("content")), analysis_id)


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")  # at most ``limit`` rows


def _entries(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Entries of the archives of each batch; what cannot be read is skipped."""
    for batch in batches:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for seq, info in enumerate(z.infolist()[:limit]):
                        if info.is_dir() or info.filename.startswith("__MACOSX/"):
                            continue
                        try:
                            rows.append((name, seq, info.filename, z.read(info).decode("utf-8", "ignore")))
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
                            continue
            except zipfile.BadZipFile:
                continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["archive", "seq", "path", "content"])


def archive_entries(archives: DataFrame, path: str = "path", content: str = "content", limit: int | None = ARCHIVE_ENTRIES) -> DataFrame:
    """``archive, seq, path, content`` of the entries; the cap comes before any filter."""
    return archives.select(F.col(path), F.col(content)).mapInArrow(lambda b: _entries(b, limit), ENTRIES)


def archive_files(archives: DataFrame, path: str = "path", content: str = "content", limit: int | None = ARCHIVE_ENTRIES) -> DataFrame:
    """``archive, seq, path, content, language, lines``: the code files among the entries, suffixes in any case."""
    entries = archive_entries(archives, path, content, limit).where(is_code(F.col("path"), fold_case=True))
    return entries.select("*", language_of(F.col("path")).alias("language"), line_count(F.col("content")).alias("lines"))


def read_archive(spark: SparkSession, file: str, analysis_id: str, limit: int | None = ARCHIVE_ENTRIES) -> DataFrame:
    """Code files of one ZIP archive."""
    if not file.endswith(".zip"):
        raise ValueError("Only ZIP files are supported")
    found = archive_files(spark.read.format("binaryFile").load(file), limit=limit)
    return found.select(F.lit(analysis_id).alias("analysis_id"), *(c for c in found.columns if c != "archive"))


def is_manifest(path: Column) -> Column:
    """Paths that end with ``package.json``, whatever comes before."""
    return path.endswith("package.json")


def manifests(files: DataFrame) -> DataFrame:
    return files.where(is_manifest(F.col("path")))


class Fetcher(Protocol):
    """Access to a host of repositories; None stands for what is missing."""

    def tree(self, owner: str, name: str, branch: str) -> list[dict] | None: ...

    def raw(self, owner: str, name: str, branch: str, path: str) -> str | None: ...


def remote_source(fetcher: Fetcher | None, source: str = "remote_tree") -> type[DataSource]:
    """A data source of repository trees behind ``fetcher``, one partition per file.

    Options: ``owner``, ``name``, ``limit`` (files after the filter). The branch main
    is tried before master, for the tree and for each file; files that are missing
    are skipped. The fetcher travels to the executors with the source. Register the
    result with ``spark.dataSource.register``.
    """

    class RemoteTree(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return "seq long, path string, content string"

        def reader(self, schema) -> DataSourceReader:
            return RemoteReader(self.options, fetcher)

    return RemoteTree


class RemoteReader(DataSourceReader):
    def __init__(self, options, fetcher: Fetcher | None) -> None:
        self.owner, self.repo = options.get("owner"), options.get("name")
        self.limit, self.fetcher = int(options.get("limit", TREE_FILES)), fetcher

    def _first(self, call, *rest):
        for branch in ("main", "master"):
            if (found := call(self.owner, self.repo, branch, *rest)) is not None:
                return found
        return None

    def partitions(self) -> list[InputPartition]:
        if self.fetcher is None:
            raise RuntimeError("a remote tree needs a fetcher")
        tree = self._first(self.fetcher.tree)
        if tree is None:
            raise RuntimeError(NO_REPOSITORY)
        paths = [e["path"] for e in tree if e["type"] == "blob" and PurePosixPath(e["path"]).suffix in CODE_SUFFIXES]
        return [InputPartition((k, p)) for k, p in enumerate(paths[: self.limit])]

    def read(self, partition):
        seq, path = partition.value
        content = self._first(self.fetcher.raw, path)
        if content is not None:
            yield seq, path, content


def parse_repository(url: str) -> tuple[str, str]:
    """Owner and name of a repository address; ``.git`` goes wherever it stands in the name."""
    if not url:
        raise ValueError("A repository address is required")
    found = re.match(REPOSITORY, url)
    if not found:
        raise ValueError("Invalid repository address")
    return found[1], found[2].replace(".git", "")


def read_repository(spark: SparkSession, url: str, analysis_id: str, fetcher: Fetcher, limit: int = TREE_FILES) -> DataFrame:
    """Code files of a repository, from its address."""
    owner, name = parse_repository(url)
    source = f"remote_tree_{uuid.uuid4().hex}"
    spark.dataSource.register(remote_source(fetcher, source))
    found = spark.read.format(source).option("owner", owner).option("name", name).option("limit", str(limit)).load()
    return _as_files(found, analysis_id)
