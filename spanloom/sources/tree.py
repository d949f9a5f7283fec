"""A file tree as a data source: ``spark.read.format("tree").load(root)``.

The driver lists only as many directories as make ``partitions`` of them (breadth first); executors walk what is below. Excluded and ignored directories are
not entered. Options: ``exclude`` (directory names), ``extensions``, ``rules`` (lines of an ignore file at the root), ``globs`` (more globs, in which ``*`` crosses slashes),
``partitions`` and ``content`` (``true`` adds the text). Lists are one entry per line. With ``spark.sql.python.filterPushdown.enabled``, filters on ``path`` and ``extension`` prune
directories and files before they are read. The root is any URI that the workers can read: a shared folder, HDFS or an object store.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from spanloom.functions.ignore import Rule, rules, verdict

# Directories that are never entered.
EXCLUDED = [".git", ".rag", "node_modules", "dist", "build", "__pycache__", ".venv", "venv", ".next", ".cache", ".pytest_cache", "coverage", ".DS_Store", "Thumbs.db"]
# Extensions of the files that the schema graph is made of.
GRAPH_SOURCES = [".py", ".ts", ".tsx", ".js", ".jsx"]

COLUMNS = "path string, name string, extension string, size long, mtime timestamp"


@dataclass
class Part(InputPartition):
    """A directory; ``deep`` takes what is below it as well as its own files."""

    directory: str
    deep: bool


def _extension(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], content: bool) -> None:
        lines = lambda name: [x for x in options.get(name, "").split("\n") if x.strip()]
        self.root = options["path"].rstrip("/")
        self.excluded = frozenset(lines("exclude") if "exclude" in options else EXCLUDED)
        self.extensions = frozenset(x.lower() for x in lines("extensions"))
        self.rules: list[Rule] = rules(lines("rules"))
        self.globs = lines("globs")
        self.wanted = int(options.get("partitions", "64"))
        self.content = content
        self.prefix, self.paths = "", None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes prefixes and lists of paths and lists of extensions; leaves other filters to Spark."""
        for f in filters:
            match f:
                case StringStartsWith(("path",), value):
                    if value.startswith(self.prefix):
                        self.prefix = value
                    elif not self.prefix.startswith(value):
                        self.extensions = frozenset([None])  # no path has both prefixes
                case EqualTo(("path",), value):
                    self.paths = frozenset([value]) & (self.paths if self.paths is not None else {value})
                case In(("path",), values):
                    self.paths = frozenset(values) & (self.paths if self.paths is not None else frozenset(values))
                case EqualTo(("extension",), value):
                    self.extensions = (self.extensions & {value} or frozenset([None])) if self.extensions else frozenset([value])
                case In(("extension",), values):
                    self.extensions = (self.extensions & set(values) or frozenset([None])) if self.extensions else frozenset(values)
                case _:
                    yield f

    def _skipped(self, path: str, is_directory: bool) -> bool:
        if verdict(path, is_directory, self.rules):
            return True
        return any(g.endswith("/") and (path + "/").startswith(g) or fnmatchcase(path, g) for g in self.globs)

    def _led_to(self, directory: str) -> bool:
        """Whether a wanted path may lie below a directory."""
        at = directory + "/"
        if not (at.startswith(self.prefix) or self.prefix.startswith(at)):
            return False
        return self.paths is None or any(p.startswith(at) for p in self.paths)

    def _list(self, directory: str) -> tuple[list, list[str]]:
        """Files and directories of a directory that are wanted, paths relative to the root."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        files, below = [], []
        for i in sorted(store.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/"), allow_not_found=True)), key=lambda i: i.base_name):
            path = f"{directory}/{i.base_name}" if directory else i.base_name
            if i.type == fs.FileType.Directory:
                if i.base_name not in self.excluded and self._led_to(path) and not self._skipped(path, True):
                    below.append(path)
            elif path.startswith(self.prefix) and (self.paths is None or path in self.paths) and (not self.extensions or _extension(path) in self.extensions) and not self._skipped(path, False):
                files.append((path, i))
        return files, below

    def partitions(self) -> list[Part]:
        done: list[Part] = []
        front = [""]
        while front and len(done) + len(front) < self.wanted:
            nearer: list[str] = []
            for n, d in enumerate(front):
                if len(done) + len(nearer) + len(front) - n >= self.wanted:
                    nearer += front[n:]
                    return done + [Part(x, True) for x in nearer]
                done.append(Part(d, False))
                nearer += self._list(d)[1]
            front = nearer
        return done + [Part(d, True) for d in front]

    def read(self, part: Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        stack = [part.directory]
        while stack:
            files, below = self._list(stack.pop())
            stack += below[::-1] if part.deep else []
            for path, i in files:
                row = (path, i.base_name, _extension(path), i.size, i.mtime)
                if self.content:
                    with store.open_input_stream(f"{base}/{path}") as f:
                        row += (f.read().decode("utf-8", "replace"),)
                yield row


class TreeWriter(DataSourceWriter):
    """Writes (path, text) rows as files; a task that runs again writes the same files again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        made = set()
        for path, text in rows:
            at = f"{base}/{path}"
            folder = at.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(at) as f:
                f.write((text or "").encode())
        return WriterCommitMessage()


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def _content(self) -> bool:
        return self.options.get("content", "false").lower() == "true"

    def schema(self) -> str:
        return COLUMNS + (", text string" if self._content() else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()}, self._content())

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter({k.lower(): v for k, v in self.options.items()})


def tree(spark: SparkSession, root: str, **options: str | int | list[str]):
    """Rows (path, name, extension, size, mtime[, text]) of the files under a root; lists become lines."""
    spark.dataSource.register(Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("tree")
    for k, v in options.items():
        r = r.option(k, "\n".join(v) if isinstance(v, list) else str(v))
    return r.load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """A file for every row (path, text); a null text is an empty file, the last of equal paths stays."""
    files.sparkSession.dataSource.register(Tree)
    files.select("path", "text").write.format("tree").mode("append").save(root)
