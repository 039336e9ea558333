"""Byte files of token ids in the shared folder, written by tasks and read in ranges by tasks.

A task writes its own file under a name of its own and reports it in the row it returns; a file of a failed or repeated
attempt is never listed. The table of reports is written before anything is read, so the files that count are fixed.
"""

from __future__ import annotations

import uuid

import numpy as np

from tracelight.llm.common import file_system


class TaskFile:
    """One output file of this task."""

    def __init__(self, folder: str):
        self.fs, path = file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}.bin"
        self.out, self.size = None, 0

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.out = self.fs.open_output_stream(self.path)
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def read_range(folder: str, path: str, start: int, length: int) -> bytes:
    fs, _ = file_system(folder)
    with fs.open_input_file(path) as f:
        return f.read_at(length, start)


def narrow(ids: np.ndarray) -> np.ndarray:
    """Token ids as 16 bits; a vocabulary that needs more is refused."""
    if len(ids) and (ids.max() >= 1 << 16 or ids.min() < 0):
        raise ValueError("ids are 16-bit")
    return ids.astype("<u2")
