"""Writers whose tasks write into folders of their own, moved into place by the driver when all have ended."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from lakeloom.sources.files import children, merged, opened

HIDDEN = "_attempts-"  # folders of jobs that have not ended
MOVERS = 16  # threads that move folders


@dataclass
class Attempt(WriterCommitMessage):
    """What a task that ended tells: its folder, and how much it wrote; no paths."""

    name: str
    files: int
    size: int


class AttemptWriter(DataSourceArrowWriter):
    """Base of such writers. A task that fails, is retried or runs twice leaves nothing but its own folder, which goes with the job's."""

    def __init__(self, uri: str):
        self.uri = uri
        self.job = f"{HIDDEN}{uuid.uuid4().hex}"

    def put(self, system, folder: str, batches: Iterator[pa.RecordBatch]) -> tuple[int, int]:
        """Writes rows below ``folder``; (files, bytes)."""
        raise NotImplementedError

    def place(self, system, root: str, stage: str) -> None:
        """Moves the staged tree into ``root``."""
        merged(system, stage, root, replace=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, root = opened(self.uri)
        name = uuid.uuid4().hex
        folder = f"{root}/{self.job}/{name}"
        system.create_dir(folder)
        return Attempt(name, *self.put(system, folder, iterator))

    def commit(self, messages: list[Attempt | None]) -> None:
        """First joins the attempts that count to one tree, where a path written twice is an error; then moves that into place."""
        system, root = opened(self.uri)
        job, stage = f"{root}/{self.job}", f"{root}/{self.job}/staged"
        system.create_dir(stage)
        try:
            by_name: dict[str, list[str]] = {}
            for k, message in enumerate(m for m in messages if m):
                for info in children(system, f"{job}/{message.name}"):
                    by_name.setdefault(self.staged_name(k, info.base_name), []).append(info.path)

            def join(item: tuple[str, list[str]]) -> None:
                name, parts = item
                for part in parts:
                    if system.get_file_info(part).is_file:
                        if len(parts) > 1:
                            raise ValueError(f"{name!r} is written twice")
                        system.move(part, f"{stage}/{name}")
                    else:
                        merged(system, part, f"{stage}/{name}", replace=False)

            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(join, by_name.items()))
            self.place(system, root, stage)
        finally:
            system.delete_dir(job)

    def staged_name(self, attempt: int, name: str) -> str:
        return name

    def abort(self, messages: list[Attempt | None]) -> None:
        system, root = opened(self.uri)
        if system.get_file_info(f"{root}/{self.job}").type == FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")
