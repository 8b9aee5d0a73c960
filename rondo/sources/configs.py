"""Settings files as tables: a data source that gives a row (file, path, value) for every scalar, and statistics of data sets from it."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KEY = re.compile(r"""(?P<key>"[^"]*"|'[^']*'|[^\s'"#\[{-][^:#]*?)\s*:(?:\s+(?P<value>.*))?$""")


def _scalar(text: str) -> str | None:
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    return None if text in ("", "~", "null") else text


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _items(text: str) -> list[str]:
    """The parts of ``a, [b, c], d``."""
    parts, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[({":
            depth += 1
        elif c in "])}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[begin:i])
            begin = i + 1
    return [*parts, text[begin:]] if text[begin:].strip() else parts


def _values(path: str, text: str) -> Iterator[tuple[str, str | None]]:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        for k, part in enumerate(_items(text[1:-1])):
            yield from _values(f"{path}.{k}", part)
    elif text.startswith("{") and text.endswith("}"):
        for part in _items(text[1:-1]):
            key, _, value = part.partition(":")
            yield from _values(f"{path}.{_scalar(key)}", value)
    else:
        yield path, _scalar(text)


def scalars(text: str) -> list[tuple[str, str | None]]:
    """(path, value) of the scalars of a YAML text of nested mappings and lists, keys and places joined by dots.

    Block and flow forms, quotes and comments are read; anchors, tags and multi-line scalars are not. An error names the line it can't read.
    """
    out: list[tuple[str, str | None]] = []
    above: list[tuple[int, str, int]] = []  # indent, path and number of list items of the open blocks
    waiting: tuple[int, str] | None = None  # a key without a value yet
    for number, raw in enumerate(text.splitlines(), 1):
        line = _without_comment(raw).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while True:  # a list item may hold a list item or a key
            item = body == "-" or body.startswith("- ")
            if waiting is not None:
                if indent > waiting[0] or (item and indent == waiting[0]):
                    above.append((indent, waiting[1], 0))
                else:
                    out.append((waiting[1], None))
                waiting = None
            while above and (above[-1][0] > indent or (above[-1][0] == indent and above[-1][2] and not item)):
                above.pop()
            level, path, count = above[-1] if above else (0, "", 0)
            join = lambda key, path=path: f"{path}.{key}" if path else key
            if item:
                if above:
                    above[-1] = (level, path, count + 1)
                else:
                    above.append((indent, "", 1))
                inner = body[1:].lstrip()
                shift = len(body) - len(inner)
                if inner and (_KEY.match(inner) or inner == "-" or inner.startswith("- ")):
                    above.append((indent + shift, join(str(count)), 0))
                    indent, body = indent + shift, inner
                    continue
                if inner:
                    out += _values(join(str(count)), inner)
                else:
                    waiting = (indent, join(str(count)))
                break
            found = _KEY.match(body)
            if not found:
                raise ValueError(f"line {number} can't be read: {raw}")
            key = join(_scalar(found["key"]) or "")
            if found["value"]:
                out += _values(key, found["value"])
            else:
                waiting = (indent, key)
            break
    return out + ([(waiting[1], None)] if waiting else [])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and its path there; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        """A task a file."""
        system, path = _place(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        files = [x for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", "."))]
        return [_File(self.path.rstrip("/") + "/" + x.base_name) for x in sorted(files, key=lambda x: x.base_name)]

    def read(self, partition: _File) -> Iterator[tuple[str, str, str | None]]:
        system, path = _place(partition.path)
        with system.open_input_file(path) as f:
            text = f.read().decode()
        for key, value in scalars(text):
            yield partition.path.rsplit("/", 1)[-1], key, value


class SettingsSource(DataSource):
    """``spark.read.format("settings").load(path)``: a file, or the files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "settings"

    def schema(self) -> str:
        return "file string, path string, value string"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"])


def settings_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, value) of every scalar."""
    spark.dataSource.register(SettingsSource)
    return spark.read.format("settings").load(path)


def statistics(config: DataFrame) -> DataFrame:
    """(dataset, mean, sd) from rows ``dataset.mean`` and ``dataset.std``: numbers, in brackets or lists, one a channel."""
    numbers = F.transform(F.regexp_extract_all("value", F.lit(r"-?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    parts = F.regexp_extract("path", r"^(.+)\.(mean|std)(?:\.([0-9]+))?$", 1), F.regexp_extract("path", r"^(.+)\.(mean|std)(?:\.([0-9]+))?$", 2)
    place = F.coalesce(F.regexp_extract("path", r"\.([0-9]+)$", 1).try_cast("int"), F.lit(0))
    rows = config.select(parts[0].alias("dataset"), parts[1].alias("name"), place.alias("place"), numbers.alias("numbers")).where("dataset <> ''")
    own = rows.groupBy("dataset", "name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "numbers"))), lambda x: x["numbers"])).alias("numbers"))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("numbers")))
    return own.groupBy("dataset").agg(pick("mean").alias("mean"), pick("std").alias("sd"))
