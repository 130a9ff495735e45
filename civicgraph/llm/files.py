"""Files that tasks write themselves, in the shared folder only.

A task attempt writes under a name of its own and returns a manifest row. Only
the rows of attempts that Spark kept reach the manifest, so files of lost,
repeated or speculative attempts are never read.
"""

import posixpath
import uuid


def open_fs(path):
    """(file system, path inside it) of a local path or a URI that pyarrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def create(folder, suffix):
    """(path, binary stream) of a new file that no other attempt can name."""
    system, inside = open_fs(folder)
    system.create_dir(inside, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return posixpath.join(folder, name), system.open_output_stream(posixpath.join(inside, name), compression=None)


def read(path):
    """A binary stream over a file, from its beginning, as stored."""
    system, inside = open_fs(path)
    return system.open_input_stream(inside, compression=None)


def read_at(path):
    """A binary file that can seek."""
    system, inside = open_fs(path)
    return system.open_input_file(inside)
