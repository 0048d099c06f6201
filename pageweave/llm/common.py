"""Small pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE + "+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of our own that none of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of two numbers (16 MB) up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (of a few numbers or short words), marked for broadcast if they are few enough."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local master may do without that setting: a temporary folder stands in. Elsewhere it is an error. Folders stay, since lost
    executors may need them, until a ``temporary`` block ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")


#: Folders made in the innermost ``temporary`` block of this thread or task of its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end or when it fails, the folders made within by the same thread: what is kept of them must be written elsewhere by then."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield
    finally:
        _made.reset(outer)
        for name in reversed(made):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Characters of the texts of a slice, and its rows.
SLICE_CHARS, SLICE_ROWS = 1 << 20, 500


def slices(batch: pa.RecordBatch, column: int, chars: int = SLICE_CHARS, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions, few enough in number and in characters of a text column."""
    until = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(), dtype="i8")])
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(until, until[at] + chars, "right")) - 1 - at
        n = min(max(1, n), rows)
        yield batch.slice(at, n)
        at += n


class Kept:
    """Bytes of words, kept by a worker in two generations of bounded size: when the newer is full, what it hasn't used goes."""

    def __init__(self, learn: Callable[[list[str]], dict[str, bytes]], most: int = 24 << 20, chars: int = 60):
        self.learn, self.most, self.chars = learn, most, chars
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The bytes of each text's words. ``learn`` finds all unknown words at once; those of over ``chars`` aren't kept."""
        self._turn()
        found = self._find(set().union(*texts).difference(self.new))
        get = self.new.__getitem__
        out = [b"".join(map(get, ws)) for ws in texts]
        self._keep(found)
        return out

    def each(self, words: list[str]) -> list[bytes]:
        """The bytes of each word, as in ``joined``."""
        self._turn()
        out = list(map(self.new.get, words))
        unknown = [i for i, b in enumerate(out) if b is None]
        if unknown:
            some = [words[i] for i in unknown]
            older = list(map(self.old.get, some))
            found = {w: b for w, b in zip(some, older, strict=True) if b is not None}
            if len(found) < len(some):
                found |= self.learn([w for w, b in zip(some, older, strict=True) if b is None])
            for i, w in zip(unknown, some, strict=True):
                out[i] = found[w]
            self.new |= found
            self._keep(found)
        return out

    def _turn(self) -> None:
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0

    def _find(self, words: set[str]) -> dict[str, bytes]:
        """The bytes of words that the newer generation doesn't have, put into it."""
        found = {w: self.old[w] for w in words.intersection(self.old)}
        if len(found) < len(words):
            found |= self.learn(list(words.difference(found)))
        self.new |= found
        return found

    def _keep(self, found: dict[str, bytes]) -> None:
        if max(map(len, found), default=0) > self.chars:
            for w in [w for w in found if len(w) > self.chars]:
                del self.new[w], found[w]
        self.size += 180 * len(found) + 2 * sum(map(len, found)) + sum(map(len, found.values()))  # about what Python takes

    def known(self, word: str) -> bytes | None:
        return self.new.get(word) or self.old.get(word)
