"""Files in a folder that the driver and all executors reach, through its URI."""

from __future__ import annotations

import uuid

import pyarrow.fs


class Folder:
    """A folder in any store that a URI or a plain path names."""

    def __init__(self, path: str):
        scheme, _, rest = path.partition(":")
        uri = f"file://{rest}" if scheme == "file" and not rest.startswith("//") else path
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(uri)

    def put(self, name: str, body: bytes) -> None:
        """A file that appears whole or not at all."""
        place = f"{self.root}/{name}"
        self.fs.create_dir(place.rpartition("/")[0])
        aside = f"{place}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(aside) as out:
            out.write(body)
        self.fs.move(aside, place)

    def get(self, name: str) -> bytes | None:
        if self.fs.get_file_info(f"{self.root}/{name}").type == pyarrow.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{name}").type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(f"{self.root}/{name}")

    def names(self, folder: str, end: str) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(i.base_name for i in found if i.base_name.endswith(end))
