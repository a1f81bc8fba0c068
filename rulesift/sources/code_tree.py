"""Python Data Source ``code_tree``: Python files of directory trees and zip archives.

    spark.dataSource.register(CodeTreeDataSource)
    files = (spark.read.format("code_tree")
             .option("path", "/shared/checkouts")      # one folder per repository
             .option("repo_depth", "1").option("branch", "main").load())
    archives = spark.read.format("code_tree").option("archives", "/shared/uploads/*.zip").load()

Rows: ``(repo, branch, path, content BINARY, length BIGINT, read_error STRING)``.

* Every ``*.py`` file below the root is listed, hidden ones, names starting
  with ``_`` and empty files included (the built-in ``binaryFile`` source
  drops those).  Directories named like a skipped directory are not entered.
* The driver lists repositories and their top folders only; tasks walk and read
  them.  A partition is a batch of at most ``max_partition_folders`` top folders
  (a repository's own files count as one), so a large repository is spread over
  its top folders; ``split`` deals each folder's files over that many parts, each
  of which lists the folder and reads its share.
* The options ``repos`` (a JSON list) and ``path_prefix`` leave out other repositories and paths: what they
  exclude is not listed.  With the option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled`` in
  the session) filters on ``repo`` and ``path`` (equality, IN, prefix) do the same, and Spark applies them again.
  It is off unless asked for: Spark 4.1 plans all uses of one loaded DataFrame in a query with
  the filters of one of them, so load a DataFrame for each use there.
* A file that cannot be read gives a row with ``read_error`` set and no
  content; it still counts as scanned.  A folder that cannot be listed gives a
  row with ``read_error`` and a null ``path``.  A repository without a Python file
  of its own gives a row with a null ``path``, so that it stays in the dimension.
* Archives up to ``split_archive_bytes`` are packed into partitions of at most ``max_partition_bytes`` and
  ``max_partition_archives``; a larger one is dealt over several, each of which reads the entries of its range of
  the archive (by the places in its central directory).  Archives above the intake limit are refused
  (one row with ``read_error``), and so are entries that unpack beyond it.  Of
  entries of one name the last counts.  Entries below a name that the intake skips
  are left out (``skip_dirs`` replaces that list).  The project name is the
  ``project`` option or the archive name without its extension.
* ``content=false`` lists without reading (file names and counts only).

Paths are of a file system that driver and executors mount alike, or URIs that
``pyarrow.fs`` reads (``rulesift.sources.storage``).
"""

from __future__ import annotations

import fnmatch
import json
import os
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith

from rulesift import fixed
from rulesift.sources import storage

SCHEMA = "repo string, branch string, path string, content binary, length bigint, read_error string"


@dataclass
class FolderBatch(InputPartition):
    # (repo, repository folder, top folder below it or None for the repository's own files, share)
    folders: list


@dataclass
class ArchiveBatch(InputPartition):
    # (archive, project, share, shares)
    archives: list


@dataclass
class Wanted:
    """What filters leave of one column: values (None: any) and prefixes, all of which must hold."""
    values: set | None = None
    prefixes: list = field(default_factory=list)

    def add(self, f: Filter) -> None:
        if isinstance(f, StringStartsWith):
            self.prefixes.append(f.value)
        else:
            own = set(f.value) if isinstance(f, In) else {f.value}
            self.values = own if self.values is None else self.values & own

    def __contains__(self, value: str) -> bool:
        return (self.values is None or value in self.values) and all(value.startswith(p) for p in self.prefixes)

    def below(self, folder: str) -> bool:
        """Whether a value may begin with ``folder`` and a slash."""
        folder += "/"
        return (self.values is None or any(v is not None and v.startswith(folder) for v in self.values)) and \
            all(folder.startswith(p) or p.startswith(folder) for p in self.prefixes)


def _opt_list(value, default):
    if value is None:
        return tuple(default)
    return tuple(x for x in value.split(",") if x)


class CodeTreeDataSource(DataSource):
    @classmethod
    def name(cls):
        return "code_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else CodeTreeReader)(self.options)


class CodeTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        self.archives = options.get("archives")
        self.branch = options.get("branch", "")
        self.repo = options.get("repo")
        self.repo_depth = int(options.get("repo_depth", "0"))
        self.skip = set(_opt_list(options.get("skip_dirs"), fixed.SKIP_DIRS))
        self.archive_skip = set(_opt_list(options.get("skip_dirs"), fixed.BUNDLE_SKIP_NAMES))
        self.read_content = options.get("content", "true").lower() != "false"
        self.split = int(options.get("split", "1"))
        self.max_folders = int(options.get("max_partition_folders", "16"))
        self.max_archive = int(options.get("max_archive_bytes", str(fixed.MAX_ARCHIVE_BYTES)))
        self.project = options.get("project")
        self.split_archive = int(options.get("split_archive_bytes", str(8 << 20)))
        self.max_bytes = int(options.get("max_partition_bytes", str(64 << 20)))
        self.max_archives = int(options.get("max_partition_archives", "256"))
        self.wanted = {"repo": Wanted(), "path": Wanted()}
        if options.get("repos") is not None:
            self.wanted["repo"].values = set(json.loads(options["repos"]))
        if options.get("path_prefix"):
            self.wanted["path"].prefixes.append(options["path_prefix"])

    # -- driver: repositories and their top folders --------------------------------
    def _folders(self, files, path: str) -> list[str]:
        """Names of the folders in ``path`` that are not skipped; none if it cannot be listed."""
        try:
            return [e.name for e in files.list(path) if e.is_folder and not e.is_link and e.name not in self.skip]
        except OSError:
            return []  # the task that lists it again reports the error

    def _repos(self, files) -> Iterator[tuple[str, str]]:
        root = self.root if "://" in self.root else os.path.abspath(self.root)
        root = root.rstrip("/") or "/"
        if self.repo_depth <= 0:
            name = self.repo or os.path.basename(root)
            if name in self.wanted["repo"]:
                yield name, root
            return
        if self.wanted["repo"].values is not None:  # named ones are looked up, not searched for
            for name in sorted(x for x in self.wanted["repo"].values if x is not None and x in self.wanted["repo"]):
                parts = name.split("/")
                if len(parts) == self.repo_depth and not {*parts} & {*self.skip, "", ".", ".."} and files.is_folder(f"{root}/{name}"):
                    yield name, f"{root}/{name}"
            return
        level = [("", root)]
        for depth in range(self.repo_depth):
            level = [(f"{rel}/{name}" if rel else name, f"{d.rstrip('/')}/{name}") for rel, d in level for name in self._folders(files, d)]
            whole = depth + 1 == self.repo_depth
            level = [(rel, d) for rel, d in level if (rel in self.wanted["repo"] if whole else self.wanted["repo"].below(rel))]
        yield from level

    def _archive_parts(self) -> list[ArchiveBatch]:
        files, parts, batch, size = storage.of(self.archives), [], [], 0
        for archive in files.matching(self.archives):
            project = self.project or os.path.splitext(os.path.basename(archive))[0]
            if project not in self.wanted["repo"]:
                continue
            try:
                own = files.size(archive)
            except OSError:
                own = 0  # the task that opens it reports the error
            if self.split_archive < own <= self.max_archive:
                shares = -(-own // self.split_archive)
                parts += [ArchiveBatch([(archive, project, k, shares)]) for k in range(shares)]
                continue
            if batch and (size + own > self.max_bytes or len(batch) >= self.max_archives):
                parts.append(ArchiveBatch(batch))
                batch, size = [], 0
            batch.append((archive, project, 0, 1))
            size += own if own <= self.max_archive else 0  # refused ones are not read
        return [*parts, ArchiveBatch(batch)] if batch else parts

    def partitions(self):
        parts = self._archive_parts() if self.archives else []
        if self.root:
            files = storage.of(self.root)
            folders = [(repo, top, name, share) for repo, top in self._repos(files) for name in (None, *(x for x in self._folders(files, top) if self.wanted["path"].below(x))) for share in range(self.split)]
            parts += [FolderBatch(folders[k:k + self.max_folders]) for k in range(0, len(folders), self.max_folders)]
        return parts or [FolderBatch([])]

    # -- executors: walking and reading ----------------------------------------------
    def read(self, partition):
        if isinstance(partition, ArchiveBatch):
            for archive in partition.archives:
                yield from self._read_archive(*archive)
            return
        for repo, top, name, share in partition.folders:
            files, errors, found = storage.of(top), [], False
            for rel in self._walk(files, top, name, errors):
                found = True
                if rel in self.wanted["path"] and zlib.crc32(rel.encode("utf-8", "surrogateescape")) % self.split == share:
                    yield self._read_file(files, repo, top, rel)
            for exc in errors if share == 0 else ():
                yield (repo, self.branch, None, None, None, f"{type(exc).__name__}: {exc}")
            if name is None and share == 0 and not found and not errors:
                yield (repo, self.branch, None, None, None, None)

    def _walk(self, files, top: str, name: str | None, errors: list) -> Iterator[str]:
        """Relative paths of the Python files below the folder ``name`` of ``top``, or of those in ``top`` itself."""
        waiting = [name or ""]
        while waiting:
            folder = waiting.pop()
            try:
                entries = files.list(f"{top}/{folder}" if folder else top)
            except OSError as exc:
                errors.append(exc)
                continue
            inner = f"{folder}/" if folder else ""
            yield from (inner + e.name for e in entries if not e.is_folder and fnmatch.fnmatchcase(e.name, "*.py"))
            if name is not None:
                waiting += [inner + e.name for e in reversed(entries) if e.is_folder and not e.is_link and e.name not in self.skip and self.wanted["path"].below(inner + e.name)]

    def _read_file(self, files, repo: str, top: str, rel: str):
        if not self.read_content:
            return (repo, self.branch, rel, None, None, None)
        try:
            with files.open(f"{top}/{rel}") as fh:
                data = fh.read()
            return (repo, self.branch, rel, data, len(data), None)
        except OSError as exc:
            return (repo, self.branch, rel, None, None, f"{type(exc).__name__}: {exc}")

    def _read_archive(self, archive: str, project: str, share: int, shares: int):
        """The entries of a share of an archive; what concerns the archive as a whole is told by share 0."""
        files = storage.of(archive)
        own = (project, self.branch)
        try:
            size = files.size(archive)
            if size > self.max_archive:
                yield (*own, None, None, size, "archive larger than the intake limit")
                return
            with files.open(archive) as fh, zipfile.ZipFile(fh) as z:
                entries = {info.filename.replace("\\", "/"): info for info in z.infolist()}
                entries = {name: info for name, info in entries.items() if not info.is_dir() and fnmatch.fnmatchcase(name.rsplit("/", 1)[-1], "*.py")
                           and not any(p in self.archive_skip for p in name.split("/")[:-1])}
                for name, info in entries.items():
                    if min(info.header_offset * shares // max(size, 1), shares - 1) == share and name in self.wanted["path"]:
                        yield self._read_entry(z, info, name, own)
        except (OSError, zipfile.BadZipFile) as exc:
            if share == 0:
                yield (*own, None, None, None, f"{type(exc).__name__}: {exc}")
            return
        if share == 0 and not entries:
            yield (*own, None, None, None, None)

    def _read_entry(self, z: zipfile.ZipFile, info: zipfile.ZipInfo, name: str, own: tuple):
        if not self.read_content:
            return (*own, name, None, None, None)
        try:
            with z.open(info) as entry:
                data = entry.read(self.max_archive + 1)
            if len(data) > self.max_archive:
                raise ValueError("entry unpacks beyond the intake limit")
            return (*own, name, data, len(data), None)
        except Exception as exc:  # noqa: BLE001 - bad entry: report, go on
            return (*own, name, None, None, f"{type(exc).__name__}: {exc}")


class PushingReader(CodeTreeReader):
    """The reader of sessions that push filters into Python data sources (Spark refuses it elsewhere)."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in self.wanted:
                self.wanted[f.attribute[0]].add(f)
            yield f  # Spark applies each of them again


def register(spark):
    spark.dataSource.register(CodeTreeDataSource)


def read_code_tree(spark, path: str | None = None, archives: str | None = None, repos: list[str] | None = None, **options):
    """``spark.read.format("code_tree")`` with the source registered."""
    register(spark)
    reader = spark.read.format("code_tree")
    if repos is not None:
        reader = reader.option("repos", json.dumps(repos))
    if path:
        reader = reader.option("path", path)
    if archives:
        reader = reader.option("archives", archives)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
