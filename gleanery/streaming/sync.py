"""Files kept in step by keyed state: each file remembers its last time and hash, its failures, and when it was last seen.

The stream of whole listings is shuffled by file, slim rows without contents. A file whose
time differs is read by the task that holds its state; a failure is tried again after a
pause that doubles, also where nothing has changed; a file not seen for a while is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "mtime long, hash string, failures int, again long, seen long"
ACTIONS = "collection string, path string, action string, mtime long, hash string, old_hash string, body string, failures int, error string"
#: The longest pause between tries, in multiples of the first.
MOST_PAUSES = 64
#: Takes a collection and a path and gives the body and the hash of its bytes; may raise.
Work = Callable[[str, str], tuple[str, str]]


class FileSync(StatefulProcessor):
    def __init__(self, work: Work, pause: float, patience: float) -> None:
        self.work, self.pause, self.patience = work, int(pause * 1000), int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", STATE)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N803
        now = timerValues.getCurrentProcessingTimeInMs()
        self.file.update((initialState["mtime"], initialState["hash"], 0, 0, now))
        self.handle.registerTimer(now + self.patience)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N803
        now = timerValues.getCurrentProcessingTimeInMs()
        mtime = max(((r["tick"], r["mtime"]) for r in rows))[1]
        known = self.file.exists()
        old_mtime, old_hash, failures, again, _ = self.file.get() if known else (None, None, 0, 0, 0)
        if not known:
            self.handle.registerTimer(now + self.patience)
        if (mtime == old_mtime and not failures) or now < again:
            self.file.update((old_mtime, old_hash, failures, again, now))
            return
        try:
            body, digest = self.work(key[0], key[1])
        except Exception as e:  # whatever keeps a file from being read is that file's failure
            pause = self.pause * min(2**failures, MOST_PAUSES)
            self.file.update((old_mtime, old_hash, failures + 1, now + pause, now))
            yield Row(collection=key[0], path=key[1], action="failed", mtime=mtime, hash=None, old_hash=old_hash, body=None, failures=failures + 1, error=f"{type(e).__name__}: {e}")
            return
        self.file.update((mtime, digest, 0, 0, now))
        action = "new" if old_hash is None else "touched" if digest == old_hash else "changed"
        yield Row(collection=key[0], path=key[1], action=action, mtime=mtime, hash=digest, old_hash=old_hash, body=None if action == "touched" else body, failures=0, error=None)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N803
        now = timerValues.getCurrentProcessingTimeInMs()
        if not self.file.exists():
            return
        _, old_hash, _, _, seen = self.file.get()
        if seen + self.patience > now:
            self.handle.registerTimer(seen + self.patience)
            return
        self.file.clear()
        if old_hash is not None:
            yield Row(collection=key[0], path=key[1], action="deleted", mtime=None, hash=None, old_hash=old_hash, body=None, failures=0, error=None)


def sync_files(listings: DataFrame, work: Work, pause: float = 60, patience: float = 180, catalog: DataFrame | None = None) -> DataFrame:
    """A stream of actions (new, changed, touched, deleted, failed) on the files of a stream of listings.

    listings: collection, path, mtime, tick, error; see sources.folder. pause: seconds
    before a failure's first retry. patience: seconds without a sight after which a file is
    deleted, some looks long, so that a look that failed deletes nothing. catalog
    (collection, path, mtime, hash): what is stored already when the stream first starts.
    """
    listings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    files = listings.where("error IS NULL").select("collection", "path", "mtime", "tick").groupBy("collection", "path")
    known = None if catalog is None else catalog.select("collection", "path", "mtime", "hash").groupBy("collection", "path")
    return files.transformWithState(FileSync(work, pause, patience), ACTIONS, "Append", "ProcessingTime", known)
