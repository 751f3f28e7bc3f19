"""Reading a table of the shared folder from inside a task.

A task that holds a batch of one table can stream another, stored one past it, block by
block: nothing is replicated by a shuffle, and no more than one block is held. The table is
a folder of Parquet files that Spark wrote; the folder must be one ``pyarrow.fs`` opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def opened(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), folder


def stored_blocks(folder: str, columns: list[str], rows: int) -> Iterator[pa.Table]:
    """The named columns of a stored table, in blocks of at most ``rows`` rows, always in the same order; none where the folder is missing."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = opened(folder)
    listed = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = sorted(f.path for f in listed if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
    waiting, held = [], 0
    for name in names:
        with store.open_input_file(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=rows, columns=columns):
                while batch.num_rows:
                    part = batch.slice(0, rows - held)
                    waiting.append(part)
                    held += part.num_rows
                    batch = batch.slice(part.num_rows)
                    if held == rows:
                        yield pa.Table.from_batches(waiting)
                        waiting, held = [], 0
    if held:
        yield pa.Table.from_batches(waiting)
