"""What a stream has already written or sent, so that a batch run again does neither twice.

A ledger is a folder that outlives its query (shared storage), with one entry a
query and batch.  Rows are staged beside their final place and put there by one
rename, which is the commit: a batch that failed before it leaves only staged
files, which readers do not see, and one that failed after it is found there.
Things that cannot be taken back, such as messages, are entered before they are
sent, so a crash between the two loses at most the one message in between.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Entries of one query in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, query: str):
        self.spark, self.root = spark, f"{folder.rstrip('/')}/{query}"
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def enter(self, name: str) -> bool:
        """Make the entry; False if it is there already."""
        path = self._path(f"{self.root}/_entries/{name}")
        self._fs.mkdirs(path.getParent())
        return not self._fs.exists(path) and self._fs.createNewFile(path)

    def has(self, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.root}/batch={batch}"))

    def write(self, batch: int, save: Callable[[str], None], before_commit: Callable[[], None] = lambda: None) -> bool:
        """save rows to a staged folder and commit it as the batch's; False if the batch is there already.

        before_commit runs between the two (tests fail there).
        """
        if self.has(batch):
            return False
        staged = f"{self.root}/_staged/{batch}-{uuid.uuid4().hex}"
        save(staged)
        before_commit()
        if self.has(batch) or not self._fs.rename(self._path(staged), self._path(f"{self.root}/batch={batch}")):
            raise RuntimeError(f"batch {batch} could not be committed in {self.root}")
        self._fs.delete(self._path(f"{self.root}/_staged"), True)
        return True


def once(ledger: Ledger, save: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that saves each batch once, however often it runs."""
    return lambda batch, number: ledger.write(number, lambda path: save(batch, path)) and None


def message_key(batch: int, channel: int, row: dict[str, Any], seen: dict[str, int]) -> str:
    """A name for one message of a batch; equal rows count up."""
    text = json.dumps(row, sort_keys=True, default=str)
    place = seen[text] = seen.get(text, -1) + 1
    return f"{batch}-{channel}-{hashlib.sha256(text.encode()).hexdigest()[:32]}-{place}"
