"""NPZ archives as a Python data source sink: each task writes its own, a manifest commits them."""

from __future__ import annotations

import io
import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def file_system(path: str):
    """Arrow's file system and the path in it, of a plain path or URI."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def column(values: pa.ChunkedArray) -> np.ndarray:
    """A column as an array: numbers as they are (nulls NaN), texts as fixed-width texts, equal lists as further axes, others as JSON texts."""
    kind = values.type
    if pa.types.is_list(kind):
        rows = values.to_pylist()
        lengths = {None if r is None else len(r) for r in rows}
        if len(lengths) == 1 and None not in lengths and (pa.types.is_integer(kind.value_type) or pa.types.is_floating(kind.value_type)):
            return np.array(rows, float if any(v is None for r in rows for v in r) else None)
        return np.array([json.dumps(r) for r in rows], "U")
    if pa.types.is_boolean(kind) or pa.types.is_integer(kind) or pa.types.is_floating(kind):
        return values.to_numpy()
    return np.array(["" if v is None else str(v) for v in values.to_pylist()], "U")


@dataclass
class Archives(WriterCommitMessage):
    """Names and rows of a task's archives."""

    files: list[tuple[str, int]] = field(default_factory=list)


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def write(self, batches) -> Archives:
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        out, held, n = Archives(), [], 0

        def flush() -> None:
            nonlocal held, n
            table = pa.Table.from_batches(held)
            body, name = io.BytesIO(), f"part-{uuid.uuid4().hex}.npz"
            np.savez_compressed(body, **{c: column(table.column(c)) for c in table.column_names})
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(body.getvalue())
            out.files.append((name, n))
            held, n = [], 0

        for b in batches:
            for at in range(0, b.num_rows, self.rows):
                part = b.slice(at, self.rows)
                if n and n + part.num_rows > self.rows:
                    flush()
                held.append(part)
                n += part.num_rows
        if held:
            flush()
        return out

    def commit(self, messages) -> None:
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        with system.open_output_stream(f"{base}/manifest.json") as f:
            f.write(json.dumps([{"file": n, "rows": r} for n, r in files]).encode())

    def abort(self, messages) -> None:
        system, base = file_system(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            system.delete_file(f"{base}/{name}")


class NpzSink(DataSource):
    """``df.write.format("npz")``: options path and rows (of an archive)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        if overwrite:
            raise ValueError("an NPZ folder is written once: give a new path")
        return NpzWriter(self.options["path"], int(self.options.get("rows", 500_000)))


def manifest(path: str) -> list[tuple[str, int]]:
    """(file, rows) of a written folder."""
    system, base = file_system(path)
    with system.open_input_stream(f"{base}/manifest.json") as f:
        return [(e["file"], e["rows"]) for e in json.loads(f.read())]
