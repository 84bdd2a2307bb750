"""A write-ahead file for each task attempt: an answer is on shared storage before the task goes on.

Spark writes a task's output when the task ends, so what a killed task had asked would be lost. A journal's lines are
flushed one by one; the next attempt of the same partition takes over what earlier ones wrote, and a later run merges what
is left. A last line that was cut off is passed over.
"""

from __future__ import annotations

import json
import threading
from pathlib import PurePosixPath

from pyarrow import ArrowInvalid, fs


class Journal:
    """The journal of one partition in a folder of any store that Arrow reaches (local, HDFS, S3, GCS)."""

    def __init__(self, folder: str, partition: int, attempt: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.part, self.lock, self.out = f"p{partition}-", threading.Lock(), None
        self.path = f"{self.folder}/{self.part}{attempt}.jsonl"

    @staticmethod
    def reaches(folder: str) -> bool:
        try:
            fs.FileSystem.from_uri(folder)
            return True
        except (ArrowInvalid, OSError):
            return False

    def earlier(self) -> list[dict]:
        """What other attempts of this partition have written."""
        found = []
        for f in self.fs.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if f.is_file and PurePosixPath(f.path).name.startswith(self.part) and f.path != self.path:
                with self.fs.open_input_stream(f.path) as s:
                    for line in s.read().decode("utf-8", "replace").splitlines():
                        try:
                            found.append(json.loads(line))
                        except ValueError:  # cut off
                            continue
        return [x for x in found if isinstance(x, dict)]

    def add(self, row: dict) -> None:
        with self.lock:
            if self.out is None:
                self.fs.create_dir(self.folder, recursive=True)
                self.out = self.fs.open_output_stream(self.path, buffer_size=0)
            self.out.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
            self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
