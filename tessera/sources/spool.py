"""What a source has fetched for an offset, kept until the micro-batch is done, so that a restart gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyarrow import fs


class Spool:
    """Rows of tuples by the number of the offset they begin at, as files in a folder of shared storage."""

    def __init__(self, path: str | None):
        self.files, self.base = (None, None)
        if path:
            self.files, self.base = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
            self.files.create_dir(self.base, recursive=True)

    def __bool__(self) -> bool:
        return self.files is not None

    def _at(self, n: int) -> str:
        return f"{self.base.rstrip('/')}/{n:012d}.json"

    def put(self, n: int, rows: Iterable[tuple], end: dict) -> None:
        """Rows and the offset after them; written under another name first, so half a file is never read."""
        if self:
            with self.files.open_output_stream(self._at(n) + ".part") as f:
                f.write(json.dumps({"rows": list(rows), "end": end}).encode())
            self.files.move(self._at(n) + ".part", self._at(n))

    def get(self, n: int) -> tuple[list[tuple], dict] | None:
        """What was read at ``n``, if it is still there."""
        if not self or self.files.get_file_info(self._at(n)).type is fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(self._at(n)) as f:
            kept = json.loads(f.read())
        return [tuple(r) for r in kept["rows"]], kept["end"]

    def between(self, start: int, end: int) -> list[tuple]:
        """All rows of the reads from ``start`` to before ``end``; raises if one is lost."""
        rows: list[tuple] = []
        while start < end:
            if (found := self.get(start)) is None:
                raise OSError(f"what was read from offset {start} to {end} isn't kept; name a folder of shared storage as the option spool")
            rows += found[0]
            start = found[1]["n"]
        return rows

    def drop_before(self, n: int) -> None:
        if not self:
            return
        for x in self.files.get_file_info(fs.FileSelector(self.base)):
            if x.base_name.endswith(".json") and int(x.base_name[:-5]) < n:
                self.files.delete_file(x.path)
