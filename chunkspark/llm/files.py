"""Binary files in the shared folder, written and read by executors through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A stream to a new file. Folders are made where the store has any."""
    system, path = open_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def open_random(uri: str):
    system, path = open_system(uri)
    return system.open_input_file(path)


def size_of(uri: str) -> int:
    system, path = open_system(uri)
    return system.get_file_info(path).size


def task_file(folder: str, name: str) -> str:
    """A path of this attempt of this task; files of lost attempts are named in no manifest."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{folder}/{name}-{task.partitionId():06d}-{task.taskAttemptId()}"
