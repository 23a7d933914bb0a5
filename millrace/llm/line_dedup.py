"""Line deduplication over a whole corpus (operator 10).

Line keys are hashed to 128 bits and range-partitioned by (key, document), the
largest document first, so that even one key held by a third of all documents
is spread over many tasks.  Each task streams its sorted rows: the first
document of a run keeps the line, later ones lose it once enough documents
hold it.  Runs that may cross a task's edge are finished from a summary of at
most two rows per task.  The outcome is a compressed bitmap of kept lines per
document; texts are not moved to find it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import map_arrow, quoted, settle

_BLANK = b" \t\n\x0b\x0c\r"
_DROP, _EDGE, _SUMMARY = 0, 1, 2
_ROW = "h1 long, h2 long, doc_id long, th long, pos int, n_lines int"


def line_key(line: bytes) -> bytes:
    """The line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    return line.strip(_BLANK).lower()


def _texts(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            ids, ths, pos, total, digests = [], [], [], [], []
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))):
                lines = text.split(b"\n")
                for at, line in enumerate(lines):
                    if len(line) < min_chars:
                        continue
                    key = line_key(line)
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
                        continue
                    digests.append(blake2b(key, digest_size=16).digest())
                    ids.append(doc)
                    ths.append(th)
                    pos.append(at)
                    total.append(len(lines))
            h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield {"h1": h[:, 0], "h2": h[:, 1], "doc_id": ids, "th": ths, "pos": pos, "n_lines": total}

        return step

    return map_arrow(docs.where("doc_id is not null").select("doc_id", "th", "text"), make, _ROW)


def _rows(kind: int, key: tuple, columns: list[np.ndarray], n_docs: int = 0) -> list[np.ndarray]:
    """Output rows of one key: ``columns`` are doc_id, th, pos and n_lines."""
    n = len(columns[0])
    return [np.full(n, kind), np.full(n, key[0]), np.full(n, key[1]), *columns, np.full(n, n_docs)]


class _Stream:
    """Follows the runs of equal keys through a task's sorted rows, holding at most ``need`` documents' rows of an open run."""

    def __init__(self, need: int) -> None:
        self.need = need
        self.key: tuple | None = None
        self.first_run = True
        self.open()

    def open(self) -> None:
        self.docs, self.keeper, self.last, self.held = 0, None, None, []

    def close(self) -> list[list[np.ndarray]]:
        """Rows due when a run ends inside the task: a first run may have begun before it."""
        out = [self.summary()] if self.key is not None and self.first_run else []
        self.first_run = self.first_run and self.key is None
        self.open()
        return out

    def summary(self) -> list[np.ndarray]:
        zero = np.zeros(1, dtype=np.int64)
        return _rows(_SUMMARY, self.key, [zero + self.keeper, zero, zero, zero], self.docs)

    def feed(self, rows: list[np.ndarray], lo: int, hi: int) -> list[list[np.ndarray]]:
        """One batch's share of the open run."""
        own = [r[lo:hi] for r in rows[2:6]]
        doc = own[0]
        self.docs += int((doc[1:] != doc[:-1]).sum()) + int(self.last is None or doc[0] != self.last)
        self.last = int(doc[-1])
        if self.keeper is None:
            self.keeper = int(doc[0])
        if self.first_run:
            return [_rows(_EDGE, self.key, own)]
        lose = doc != self.keeper
        if lose.any():
            self.held.append(_rows(_DROP, self.key, [c[lose] for c in own]))
        out: list[list[np.ndarray]] = []
        if self.docs >= self.need:
            out, self.held = self.held, []
        return out

    def finish(self) -> list[list[np.ndarray]]:
        if self.key is None:
            return []
        return [[np.full(len(h[0]), _EDGE), *h[1:]] for h in self.held] + [self.summary()]


def _streamed(ranged: DataFrame, min_docs: int) -> DataFrame:
    schema = "kind int, " + _ROW + ", n_docs long"
    names = ["kind", "h1", "h2", "doc_id", "th", "pos", "n_lines", "n_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        stream = _Stream(min_docs)

        def pack(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(6)]
            n = batch.num_rows
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            cuts = np.concatenate([[0], change, [n]])
            head, tail = int(cuts[1]), int(cuts[-2])
            out: list[list[np.ndarray]] = []
            key = (int(rows[0][0]), int(rows[1][0]))
            if key != stream.key:
                out += stream.close()
                stream.key = key
            out += stream.feed(rows, 0, head)
            if tail >= head and len(cuts) > 2:
                out += stream.close()
                if tail > head:
                    yield from _inner(rows, cuts[1:-1], min_docs, names, types)
                stream.key = (int(rows[0][tail]), int(rows[1][tail]))
                out += stream.feed(rows, tail, n)
            yield pack(out)
        yield pack(stream.finish())

    return ranged.mapInArrow(run, schema)


def _inner(rows: list[np.ndarray], cuts: np.ndarray, min_docs: int, names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    """Runs that begin and end inside a batch, all at once."""
    lo, hi = int(cuts[0]), int(cuts[-1])
    starts = cuts[:-1] - lo
    doc = rows[2][lo:hi]
    fresh = np.ones(hi - lo, dtype=np.int64)
    fresh[1:] = doc[1:] != doc[:-1]
    fresh[starts] = 1
    docs = np.add.reduceat(fresh, starts)
    length = np.diff(cuts)
    drop = np.repeat(docs >= min_docs, length) & (doc != np.repeat(doc[starts], length))
    if drop.any():
        at = np.flatnonzero(drop) + lo
        zero = np.zeros(len(at), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([zero, *(r[at] for r in rows), zero], types)], names=names)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Which lines the documents keep, for every document that loses one.

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents stays only in the largest doc_id holding it.
    Returns (doc_id, th, n_lines, bitmap): ``th`` is the text's xxhash64, so
    that rows repeating a doc_id with other text keep apart, and ``bitmap`` the
    zlib-compressed bits of kept lines in order.

    Rows that share a doc_id count as one document; rows with a null doc_id
    are no documents: they count nowhere and lose nothing.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    rows = settle(_line_rows(own, min_chars))
    keys = ["h1", "h2", F.col("doc_id").desc()]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "th", "pos")
    done = settle(_streamed(ranged, min_docs))

    # At most two summaries a task: bounded by the number of partitions, not by the data.
    spread = done.where(F.col("kind") == _SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs).select("h1", "h2", "keeper")
    edges = done.where(F.col("kind") == _EDGE).join(F.broadcast(spread), ["h1", "h2"]).where("doc_id <> keeper")
    what = ["doc_id", "th", "n_lines", "pos"]
    dropped = done.where(F.col("kind") == _DROP).select(*what).unionByName(edges.select(*what))
    grouped = dropped.groupBy("doc_id", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            maps = []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                keep = np.ones(n, dtype=bool)
                keep[gone] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            yield {"doc_id": batch.column(0), "th": batch.column(1), "n_lines": batch.column(2), "bitmap": maps}

        return step

    return map_arrow(grouped, make, "doc_id long, th long, n_lines int, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, names: tuple[str, str] = ("line_count", "line_drops")) -> DataFrame:
    """``docs`` with dropped lines removed from ``text``, and line_count and line_drops added, called ``names``.

    Null texts stay null and count one line.  Any other columns pass through;
    one called like an added column (in any case) is replaced.
    """
    added = {n.lower() for n in names}
    passed = [f for f in docs.schema if f.name.lower() not in added]
    own = F.struct(*[(F.col(quoted(f.name)).cast("string") if f.name == "text" else F.col(quoted(f.name))).alias(f.name) for f in passed])
    wide = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), own.alias("row"))
    joined = wide.join(bitmaps.select(F.col("doc_id").alias("id"), "th", "bitmap"), ["id", "th"], "left").select("row.*", F.col("bitmap").alias("".join(f.name for f in passed) + "_bitmap"))
    others = [(i, f.name) for i, f in enumerate(passed) if f.name != "text"]
    place = [f.name for f in passed].index("text")
    types = ["string" if f.name == "text" else f.dataType.simpleString() for f in passed]
    schema = ", ".join(f"{quoted(f.name)} {t}" for f, t in zip(passed, types)) + f", {quoted(names[0])} long, {quoted(names[1])} long"

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            texts, counts, drops = [], [], []
            for text, bitmap in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(len(passed)).to_pylist()):
                n = 1 if text is None else text.count(b"\n") + 1
                lost = 0
                if bitmap is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n).tolist()
                    lines = [line for line, k in zip(text.split(b"\n"), keep) if k]
                    lost = n - len(lines)
                    text = b"\n".join(lines)
                texts.append(text)
                counts.append(n)
                drops.append(lost)
            yield {c: batch.column(i) for i, c in others} | {"text": pa.array(texts, pa.binary()).cast(pa.string())} | dict(zip(names, (counts, drops)))

        return step

    return map_arrow(joined, make, schema)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, names: tuple[str, str] = ("line_count", "line_drops")) -> DataFrame:
    """Finds the bitmaps and applies them; see ``keep_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, settle(keep_bitmaps(docs, min_chars, min_docs)), names)
