"""Opening files from Python tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


def file_opener() -> Callable[..., Any]:
    """A function opening a file by the address Spark lists it under.

    Made here rather than defined at the top, so that it travels to executors
    by value and they need no copy of the package.
    """

    def open_file(address: str, seekable: bool = False) -> Any:
        import re
        from urllib.parse import unquote

        from pyarrow import fs

        if address.startswith("file:"):
            system, place = fs.LocalFileSystem(), "/" + unquote(address[len("file:") :]).lstrip("/")
        else:
            # Hadoop's names for one and the same object store.
            system, place = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", address))
        return system.open_input_file(place) if seekable else system.open_input_stream(place)

    return open_file
