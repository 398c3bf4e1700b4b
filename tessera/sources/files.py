"""Files of data sources, through Arrow's file systems (local, s3, gs, abfs, hdfs)."""

from __future__ import annotations

from fnmatch import fnmatch

from pyarrow import NativeFile, fs


def find_files(path: str, suffix: str) -> list[str]:
    """The file at path, the files of a folder that end in suffix, or those that a pattern in the last part matches; sorted."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(inner)
        found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and f.base_name.endswith(suffix)]
    return sorted(prefix + f.path for f in found)


def open_file(path: str) -> NativeFile:
    """A file that can be read from any place."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)
