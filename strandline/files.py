"""Files that executors' Python opens itself, by the URIs that Spark lists."""

from __future__ import annotations

from pyarrow import fs


def resolved(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path): no scheme is local, s3a and s3n are s3."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri[len(scheme) :]
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """A seekable file."""
    system, path = resolved(uri)
    return system.open_input_file(path)


def read_bytes(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Through a temporary name, so that readers see all of it or none."""
    system, path = resolved(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path + ".tmp", compression=None) as out:
        out.write(data)
    system.move(path + ".tmp", path)
