"""Files in the shared folder, written and read by the workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI (file, hdfs, s3, gs) or of an absolute path."""
    return fs.FileSystem.from_uri(path)


@contextmanager
def whole_file(path: str) -> Iterator:
    """Stream whose file appears under its name when it is complete. A task that is run again, or
    twice at once, puts the same file in the same place."""
    system, plain = filesystem(path)
    part = f"{plain}.{uuid.uuid4().hex}.part"
    system.create_dir(plain.rpartition("/")[0], recursive=True)
    with system.open_output_stream(part, compression=None) as out:
        yield out
    try:
        system.move(part, plain)
    except OSError:
        if system.get_file_info(plain).type == fs.FileType.NotFound:
            raise
        system.delete_file(part)  # another attempt was first; its file is the same
