"""BPE encoding and decoding through a table of distinct words (operator 3).

The tokenizer drops white space and never merges across it, so a text's ids are
its words' ids in order.  Four steps:

1. texts are split into words, in blocks of about ``BLOCK_BYTES``; a block keeps
   each of its distinct words once, numbered by frequency, and of each text the
   numbers of its words, its positions;
2. the blocks' words are dealt and sorted by word, so that equal words of all
   blocks are one run: the table of distinct words, each encoded once;
3. ids go back to their blocks and are joined to the positions by number;
4. decoding joins ids to their pieces.

Texts are read once and never shuffled: the blocks are written in buckets, to
which only the encoded words travel.  Two identities keep the table small: A-Z
encode as a-z, and closing punctuation is a word part of its own, so "Word," is
the parts "word" and ",".
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._stage import _give_back, shared_dir, ship

#: Text bytes of a block (or one longer text), and of a text's parts that are split at once.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 4 << 20
#: Spark's own limit of buckets (``spark.sql.sources.bucketing.maxBuckets``).
MOST_BUCKETS = 100_000
#: Words that the tokenizer is given at once.
ENCODE_WORDS = 20_000

_BLANKS = b" \t\n\x0b\x0c\r"
_CLOSING = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
_loaded: dict[str, object] = {}
_ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def word_parts(word: bytes) -> tuple[bytes, bytes]:
    """A word as its core, A-Z lower-cased, and its closing ASCII punctuation.

    The tokenizer always divides between a letter or digit and punctuation
    other than an apostrophe; words that it may not divide so (another last
    character, or a special token's marks inside) stay whole.
    """
    core = word.rstrip(_CLOSING)
    if len(core) == len(word):
        return (word.lower() if b"<|" not in word else word), b""
    if not core or b"<|" in word:
        return word, b""
    latin = len(core) > 1 and core[-2] == 0xC3 and core[-1] not in (0x97, 0xB7)
    if core[-1] in _ALNUM or latin:
        return core.lower(), word[len(core) :]
    return word, b""


def load(path: str):
    """The tokenizer of a file, kept by the worker.

    Raises ``ValueError`` for a kind that splitting at white space, lower-casing
    and joining pieces by spaces would get wrong.
    """
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        kinds = [n["type"] for n in (plan["normalizer"] or {}).get("normalizers", ())]
        first = next(iter((plan["pre_tokenizer"] or {}).get("pretokenizers", ())), {})
        if kinds != ["NFC", "Replace", "Lowercase"] or (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True) or plan["decoder"] or plan["post_processor"]:
            raise ValueError(f"{path}: only tokenizers that lower-case, drop white space and have no decoder can be encoded word by word")
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


def pieces(path: str) -> list[str]:
    """The piece of every id: as many as the vocabulary has."""
    tokenizer = load(path)
    return [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]


def id_type(path: str) -> str:
    """The smallest little-endian type that holds every id."""
    return "<u2" if load(path).get_vocab_size() <= 1 << 16 else "<u4"


def encode_words(path: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word, packed as ``id_type``."""
    tokenizer, kind, out = load(path), id_type(path), []
    for at in range(0, len(words), ENCODE_WORDS):
        for e in tokenizer.encode_batch_fast([w.decode() for w in words[at : at + ENCODE_WORDS]], add_special_tokens=False):
            out.append(np.array(e.ids, dtype=kind).tobytes())
    return out


class _Codes(dict):
    """Numbers keys by their first occurrence."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


class Block:
    """Some whole texts as positions in a table of their distinct word parts."""

    def __init__(self) -> None:
        self.size = 0
        self.doc_ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.words = _Codes()

    def add(self, doc_id: int | None, text: bytes) -> None:
        codes, at = [np.zeros(0, dtype=np.int32)], 0
        while at < len(text):
            stop = at + PIECE_BYTES
            while stop < len(text) and text[stop] not in _BLANKS:
                stop += 1
            own = text[at:stop].split()
            codes.append(np.fromiter(map(self.words.__getitem__, own), dtype=np.int32, count=len(own)))
            at = stop
        self.doc_ids.append(doc_id)
        self.texts.append(np.concatenate(codes))
        self.size += len(text)

    def parts(self) -> tuple[list[bytes], list[np.ndarray]]:
        """The distinct parts, the most frequent first, and each text's positions in that list."""
        number = _Codes({b"": 0})
        both = np.array([[number[core], number[tail]] for core, tail in map(word_parts, self.words)], dtype=np.int32).reshape(-1, 2)
        flat = [both[t].ravel() for t in self.texts]
        flat = [f[f > 0] - 1 for f in flat]
        names = list(number)[1:]
        seen = sum((np.bincount(f, minlength=len(names)) for f in flat), np.zeros(len(names), dtype=np.int64))
        order = np.argsort(-seen, kind="stable")
        place = np.empty(len(names), dtype="<u4")
        place[order] = np.arange(len(names))
        return [names[i] for i in order], [place[f] for f in flat]


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, all lowest bytes first: the others are nearly all zero and compress away."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


_SPLIT = "block long, idx int, word binary, doc_id long, pos binary"
_SPLIT_ARROW = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("word", pa.binary()), ("doc_id", pa.int64()), ("pos", pa.binary())])


def _split(docs: DataFrame) -> DataFrame:
    """Rows of distinct word parts (block, idx, word) and of texts (block, doc_id, pos)."""

    def rows(block: Block, number: int) -> Iterator[pa.RecordBatch]:
        names, positions = block.parts()
        for at in range(0, len(names), 50_000):
            own = names[at : at + 50_000]
            n = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), pa.array(range(at, at + n), pa.int32()), pa.array(own, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_SPLIT_ARROW)
        at = 0
        while at < len(positions):
            stop, size = at, 0
            while stop < len(positions) and (stop == at or size < PIECE_BYTES):
                size, stop = size + positions[stop].nbytes, stop + 1
            n = stop - at
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(block.doc_ids[at:stop], pa.int64()), pa.array([planes(p) for p in positions[at:stop]], pa.binary())], schema=_SPLIT_ARROW
            )
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).fill_null("").cast(pa.binary()).to_pylist()):
                    block.add(doc_id, text)
                    if block.size >= BLOCK_BYTES:
                        yield from rows(block, task | made)
                        made, block = made + 1, Block()
        if block.doc_ids:
            yield from rows(block, task | made)
        del block
        _give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SPLIT)


def _bucketed(df: DataFrame, column: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by a column, so that a join on it moves the other side only."""
    spark = df.sparkSession
    name = f"millrace_{uuid.uuid4().hex}"
    # Files know their size; what doesn't (a local table) says an absurd one.
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-known // BLOCK_BYTES)))
    df.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved: what follows needs the files only
    spark.sql(f"DROP TABLE {name}")
    return table


def _encoded(words: DataFrame, path: str) -> DataFrame:
    """(block, idx, ids) of (block, idx, word): equal words are one run, encoded at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_ids = None, b""
        for batch in batches:
            own = batch.column(2).dictionary_encode()
            distinct = own.dictionary.to_pylist()
            known = distinct[0] == last if distinct else False
            ids = ([last_ids] if known else []) + encode_words(path, distinct[known:])
            if distinct:
                last, last_ids = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()).take(own.indices)], names=["block", "idx", "ids"])
        _give_back()

    return words.select("block", "idx", "word").repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, idx int, ids binary")


def encode(docs: DataFrame, tokenizer_path: str, digests: bool = False) -> DataFrame:
    """Token ids of every document.

    Returns doc_id, n_tokens, and either ids (array<int>) and decoded (string)
    or, with ``digests``, ids_sha256 and decoded_sha256.  Null texts count as
    empty: no tokens, and an empty decoded text.  Words are split at
    ``[\\x20\\x09-\\x0D]``; other white space is left to the tokenizer.
    Rows come out one for one, whatever their doc_id.
    """
    spark = docs.sparkSession
    load(tokenizer_path)
    ship(spark)
    kind = np.dtype(id_type(tokenizer_path))
    held = spark.sparkContext.broadcast([p.encode() for p in pieces(tokenizer_path)])  # bounded by the vocabulary
    table = _bucketed(_split(docs), "block")
    words = _encoded(table.where("word IS NOT NULL"), tokenizer_path)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def join(texts: pa.Table, coded: pa.Table) -> pa.Table:
        """The texts of one block, from the ids of its words."""
        order = np.argsort(coded.column("idx").to_numpy())
        packed = coded.column("ids").take(pa.array(order)).to_pylist()
        size = np.array([len(p) // kind.itemsize for p in packed], dtype=np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(packed), dtype=kind)
        piece = held.value
        text_of = [b" ".join([piece[i] for i in own]) for own in (flat[a : a + n].tolist() for a, n in zip(start.tolist(), size.tolist()))]
        out: dict[str, list] = defaultdict(list)
        for data in texts.column("pos").to_pylist():
            pos = from_planes(data)
            pos = pos[size[pos] > 0]
            n = size[pos]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids = flat[np.repeat(start[pos], n) + step]
            decoded = b" ".join([text_of[i] for i in pos.tolist()])
            out["n"].append(len(ids))
            out["ids"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() if digests else ids.astype(np.int32))
            out["decoded"].append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode("utf-8"))
        names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
        kinds = [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(out["n"], pa.int64())} | {name: pa.array(out[key], kind) for name, key, kind in zip(names, ("ids", "decoded"), kinds)})

    texts = table.where("pos IS NOT NULL").select("block", "doc_id", "pos")
    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join, schema)


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """``doc_id`` and the decoded text of an array column of ids, by a join of ids to pieces.

    Null and empty arrays give an empty text; ids that the vocabulary lacks
    give nothing.  Rows come out one for one, whatever their doc_id.
    """
    spark = rows.sparkSession
    vocabulary = spark.createDataFrame(list(enumerate(pieces(tokenizer_path))), "id int, piece string")
    own = rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    tokens = own.select("row", "doc_id", F.posexplode_outer("ids").alias("at", "id")).join(F.broadcast(vocabulary), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))))
    return tokens.groupBy("row", "doc_id").agg(F.concat_ws(" ", F.transform(parts, lambda p: p["piece"])).alias("decoded")).select("doc_id", "decoded")
