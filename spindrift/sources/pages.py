"""Result pages of comments as a Spark data source: ``spark.read.format("comment_pages")``.

Each thread of pages is a partition, as a page's successor is known from the
page alone; threads are read side by side.  Pages of a thread are taken whole,
one after the other, while fewer than ``at_most`` comments came before and a
page names a next one.

Options: ``path``, a folder with a folder for each thread; ``at_most`` (500);
``first``, the token of a thread's first page (0).  The page of a token is in
the files of the folder ``token=<token>``.  A live service is a subclass with
another :meth:`PageReader.fetch` and :meth:`PageReader.threads`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "thread string, token string, position int, text string, timestamp timestamp, authorId string"


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.at_most, self.first = options["path"].rstrip("/"), int(options.get("at_most", "500")), options.get("first", "0")

    def _folder(self, *names: str) -> tuple:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), self.path)
        return fs, "/".join([at, *names])

    def _names(self, *names: str) -> tuple:
        fs, at = self._folder(*names)
        return fs, [f for f in fs.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True)) if f.base_name[0] not in "._"]

    def threads(self) -> list[str]:
        return sorted(f.base_name for f in self._names()[1] if f.type == pyarrow.fs.FileType.Directory)

    def fetch(self, thread: str, token: str) -> dict | None:
        """The page of a token; None if there is none."""
        fs, files = self._names(thread, f"token={quote(token, safe='')}")
        text = ""
        for f in sorted(files, key=lambda f: f.base_name):
            with fs.open_input_stream(f.path) as held:
                text += held.read().decode()
        return json.loads(text) if text.strip() else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(t) for t in self.threads()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        token, n = self.first, 0
        while token is not None and n < self.at_most and (page := self.fetch(partition.value, token)) is not None:
            items = page.get("items") or []
            for k, item in enumerate(items):
                s = item["snippet"]["topLevelComment"]["snippet"]
                at = s.get("publishedAt")
                yield partition.value, token, k, s.get("textOriginal"), at and datetime.fromisoformat(at.replace("Z", "+00:00")), (s.get("authorChannelId") or {}).get("value") or "Unknown"
            n += len(items)
            token = page.get("nextPageToken")


class CommentPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "comment_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(CommentPages)
