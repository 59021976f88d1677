"""Small files that the driver keeps beside a table: manifests, listings, removal.

Tables are read and written by Spark; only names of folders and a few bytes of
JSON pass through here, over ``pyarrow.fs`` (local folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, value: dict) -> None:
    """Write JSON as a whole or not at all: under another name first, then moved."""
    store, path = _at(uri)
    folder, name = path.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(value).encode())
    store.move(part, path)


def get(uri: str) -> dict:
    store, path = _at(uri)
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def names(uri: str) -> list[str]:
    """Names in a folder, sorted, without hidden ones; none where the folder is absent."""
    store, path = _at(uri)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if not f.base_name.startswith("."))


def remove(uri: str) -> None:
    """Remove a file or a folder with all it holds; absent ones are no error."""
    store, path = _at(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        store.delete_file(path)
