"""Files in the shared folder, opened by executors' Python through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI that Spark would take; s3a and s3n are s3 here, no scheme is local."""
    for scheme in ("s3a://", "s3n://"):
        if uri.startswith(scheme):
            uri = "s3://" + uri[len(scheme) :]
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def size_of(uri: str) -> int:
    """Bytes of a file, -1 if there is none."""
    f, path = open_fs(uri)
    info = f.get_file_info(path)
    return info.size if info.type == fs.FileType.File else -1


def move(source: str, target: str) -> None:
    f, a = open_fs(source)
    f.move(a, open_fs(target)[1])


def make_folder(uri: str) -> None:
    f, path = open_fs(uri)
    f.create_dir(path, recursive=True)


def write_whole(uri: str, data: bytes) -> None:
    """Write through a temporary name, so that readers see the whole file or none."""
    f, path = open_fs(uri)
    with f.open_output_stream(path + ".tmp", compression=None) as out:
        out.write(data)
    f.move(path + ".tmp", path)


def read_whole(uri: str) -> bytes | None:
    if size_of(uri) < 0:
        return None
    f, path = open_fs(uri)
    with f.open_input_stream(path, compression=None) as stream:
        return stream.read()
