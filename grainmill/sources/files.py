"""Opening paths on whatever filesystem they name."""

from __future__ import annotations

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("s3a://"):  # Spark's name for what Arrow calls s3
        path = "s3" + path[3:]
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_text(path: str) -> str:
    f, p = filesystem(path)
    with f.open_input_stream(p) as src:
        return src.read().decode()


def write_text(path: str, text: str) -> None:
    f, p = filesystem(path)
    f.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with f.open_output_stream(p) as out:
        out.write(text.encode())
