"""A Python data source of directory trees: every file with its size and text, hidden files too.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("roots", "a=/src/a,b=/src/b").load()

Ignored directories are not entered, and each directory below a root is a partition of its own. The roots must be on a file system that
all executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treegauge.functions import rules as R

MOST = 400_000


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "repo_id string, path string, size long, raw string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


class _Part(InputPartition):
    def __init__(self, repo: str, root: str, folder: str, deep: bool) -> None:
        self.repo, self.root, self.folder, self.deep = repo, root, folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots = [x.split("=", 1) for x in options["roots"].split(",")]
        self.most = int(options.get("maxBytes", MOST))

    def partitions(self) -> list[_Part]:
        out = []
        for repo, root in self.roots:
            out.append(_Part(repo, root, root, False))
            out += [_Part(repo, root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name.lower() not in R.IGNORED_DIRS]
        return out

    def read(self, part: _Part) -> Iterator[tuple]:
        for folder, dirs, files in os.walk(part.folder):
            dirs[:] = [d for d in sorted(dirs) if d.lower() not in R.IGNORED_DIRS] if part.deep else []
            for name in sorted(files):
                full = os.path.join(folder, name)
                size = os.path.getsize(full)
                text = None
                if size <= self.most:
                    with open(full, encoding="utf-8", errors="replace") as f:
                        text = f.read()
                yield part.repo, os.path.relpath(full, part.root).replace(os.sep, "/"), size, text
