"""A table as a list of segments, which one file names: new versions appear at once, older ones stay readable.

A folder has segments (folders of Parquet files or what else the owner writes) and manifests, numbered
from 1, each the whole list of segments of a version. The manifest with the greatest number is the current
one. It is written beside its place and moved there, so that whoever dies at any step leaves the version
before or the one after; segments that no manifest names yet, or no longer, are taken away by ``vacuum``.
One writer at a time; readers at any time.
"""

from __future__ import annotations

import json
import uuid

from .writer import file_system


class Versions:
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.where, self.top = file_system(self.root)

    def _manifests(self) -> dict[int, str]:
        from pyarrow import fs

        found = self.where.get_file_info(fs.FileSelector(f"{self.top}/manifests", allow_not_found=True))
        return {int(f.base_name): f.path for f in found if f.base_name.isdigit()}

    def current(self) -> tuple[int, dict]:
        """The number and the content of the current version; 0 and an empty one before the first."""
        found = self._manifests()
        if not found:
            return 0, {"segments": []}
        number = max(found)
        with self.where.open_input_stream(found[number]) as f:
            return number, json.loads(f.read())

    def segments(self) -> list[str]:
        return self.current()[1]["segments"]

    def path(self, segment: str) -> str:
        return f"{self.root}/segments/{segment}"

    def new_segment(self) -> str:
        """A name for a segment; what is written to its path counts from the commit on."""
        return uuid.uuid4().hex

    def commit(self, before: int, segments: list[str], **more) -> int:
        """Makes ``segments`` the version after ``before``, unless another writer was first."""
        found = self._manifests()
        if max(found, default=0) != before:
            raise RuntimeError(f"version {before} is no longer the current one of {self.root}")
        self.where.create_dir(f"{self.top}/manifests", recursive=True)
        place = f"{self.top}/manifests/{before + 1}"
        written = f"{place}.{uuid.uuid4().hex}"
        with self.where.open_output_stream(written) as f:
            f.write(json.dumps({"segments": segments} | more).encode())
        self.where.move(written, place)
        return before + 1

    def vacuum(self) -> None:
        """Takes away what the current version doesn't name; for when nobody reads an older one."""
        from pyarrow import fs

        number, now = self.current()
        kept = set(now["segments"])
        for info in self.where.get_file_info(fs.FileSelector(f"{self.top}/segments", allow_not_found=True)):
            if info.base_name not in kept:
                self.where.delete_dir(info.path)
        for info in self.where.get_file_info(fs.FileSelector(f"{self.top}/manifests", allow_not_found=True)):
            if info.base_name != str(number):
                self.where.delete_file(info.path)
