"""New files of a watched folder as a stream: a Python data source whose offset is what was seen of the folder.

    spark.dataSource.register(NewFiles)
    spark.readStream.format("new_files").option("path", folder).option("accept", "mp3,wav").load()

Each trigger looks at the folder once. What is there at the start does not count until it is written again. A file is complete
when two looks in a row see the same size over zero; it is then given once, with whether its kind is wanted. Names of unfinished
downloads, hidden names and folders never are. The looks should be as far apart as a file must be quiet: that is the
stream's trigger interval. The whole state is in the offset, so a stream that starts again from its checkpoint goes on where it was:
files given are not given again, and those from before the first start still don't count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from stat import S_ISREG

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from crateflow.sources.files import AUDIO, PARTIAL

#: States of a name: there at the start (with its time of change), seen growing (with its size), given.
OLD, SEEN, GIVEN = "old", "seen", "given"


def unfinished(name: str) -> bool:
    """Whether a name is that of a hidden file or of a download that is being written."""
    return name.startswith((".", "~$")) or ("." in name and name.rsplit(".", 1)[1].lower() in (*PARTIAL, "temp"))


class NewFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "new_files"

    def schema(self) -> str:
        return "name string, path string, size long, wanted boolean"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        accept = self.options.get("accept")
        kinds = tuple(x.strip().lower().lstrip(".") for x in accept.split(",")) if accept else AUDIO
        return _Looks(self.options["path"].removeprefix("file:"), kinds)


class _Looks(SimpleDataSourceStreamReader):
    def __init__(self, folder: str, kinds: tuple[str, ...]):
        self.folder, self.kinds = folder, kinds

    def _there(self) -> dict[str, tuple[int, int]]:
        """Size and time of change of each file that may count; a file that goes meanwhile is left out."""
        out = {}
        for name in os.listdir(self.folder):
            try:
                s = os.stat(os.path.join(self.folder, name))
            except OSError:
                continue
            if S_ISREG(s.st_mode) and not unfinished(name):
                out[name] = (s.st_size, s.st_mtime_ns)
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {name: {"state": OLD, "at": changed} for name, (_, changed) in self._there().items()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        there, end = self._there(), {}
        for name, was in start.items():
            if was["state"] == GIVEN or name in there:
                end[name] = was
        for name, (size, changed) in there.items():
            was = end.get(name)
            if was and (was["state"] == GIVEN or was["state"] == OLD and was["at"] == changed):
                continue
            complete = size > 0 and was is not None and was["state"] == SEEN and was["at"] == size
            end[name] = {"state": GIVEN if complete else SEEN, "at": size}
        return iter(list(self.readBetweenOffsets(start, end))), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The files that are given in one offset and not in the one before."""
        for name in sorted(end):
            if end[name]["state"] == GIVEN and start.get(name, {}).get("state") != GIVEN:
                wanted = "." in name and name.rsplit(".", 1)[1].lower() in self.kinds
                yield name, os.path.join(self.folder, name), end[name]["at"], wanted
