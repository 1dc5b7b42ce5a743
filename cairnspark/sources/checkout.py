"""Files of a working tree, written by tasks into a store that driver and executors share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cairnspark.operators import trees


FOLDERS = 10_000  # that a task remembers as made


def write_files(files: DataFrame, root: str) -> DataFrame:
    """files (path, mode, data) written below root, a URI or an absolute path: path, size, error (null if all went well).

    A file gets its content under a name of its own and is then moved into place, so a repeated or parallel attempt of a task
    never leaves half a file. Null data and paths that lead out of root are errors. The files are written when the result
    is read, and written again when it is read again.
    """

    def write(store: fs.FileSystem, base: str, made: set[str], path: str, mode: int, data: bytes | None) -> str | None:
        if data is None:
            return "not found"
        if path.startswith("/") or not {"", ".", ".."}.isdisjoint(path.split("/")):
            return "invalid path"
        folder, _, name = f"{base}/{path}".rpartition("/")
        own = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        try:
            if folder not in made:
                store.create_dir(folder, recursive=True)
                if len(made) < FOLDERS:
                    made.add(folder)
            with store.open_output_stream(own) as out:
                out.write(bytes(data))
            if isinstance(store, fs.LocalFileSystem):
                os.chmod(own, mode & 0o777)
            store.move(own, f"{folder}/{name}")
        except OSError as e:
            return str(e)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            error = [write(store, base.rstrip("/"), made, *row) for row in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame({"path": batch["path"], "size": batch["data"].map(len, na_action="ignore").astype("Int64"), "error": pd.Series(error, batch.index, object)})

    return files.select("path", "mode", "data").mapInPandas(run, "path string, size bigint, error string")


def checkout_index(index: DataFrame, objects: DataFrame, root: str, force: bool = False) -> Row:
    """Writes the entries of stage 0 and returns n_files, n_bytes, n_failed and one error.

    Without force any failure raises, once all other files are written; with force it is only counted. Files that are not in the
    index stay. A content that many paths share is a hot key of this join, which AQE splits.
    """
    files = index.where("stage = 0").join(objects.select("oid", "data"), "oid", "left")
    ok = F.col("error").isNull()
    done = write_files(files, root).agg(F.count_if(ok).alias("n_files"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("n_bytes"), F.count_if(~ok).alias("n_failed"), F.min(F.concat("path", F.lit(": "), "error")).alias("error")).first()
    if done["n_failed"] and not force:
        raise OSError(f"{done['n_failed']} files were not written, such as {done['error']}")
    return done


def checkout_tree(roots: DataFrame, tree_entries: DataFrame, objects: DataFrame, root: str, levels: int, force: bool = False) -> Row:
    """As checkout_index, for the files below trees, roots (root, tree_oid), down to a number of levels."""
    files = trees.expand(roots, tree_entries, levels).select("path", "mode", "oid", F.lit(0).alias("stage"))
    return checkout_index(files, objects, root, force)
