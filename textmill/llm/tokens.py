"""Token ids: a caching front of the public tokenizers library, flat id files, and the query that reads them back.

File format, one pair for each partition, partitions in ascending order of document id:

- ``part-NNNNN.bin``: ids of all its documents, end ids included, one after the other, as little-endian unsigned integers,
  16 bits wide if the vocabulary allows it, else 32;
- ``part-NNNNN.idx``: little-endian 64-bit values: the number n of documents, n + 1 offsets in ids, n document ids.

A document's place in the whole is its partition's base, the prefix sum of the partitions before it, plus its offset.
Files are written under another name and renamed when complete, so a task that runs again leaves the same files.

Edge cases: a null text is empty and has the end id only; an empty table writes no files and gives an empty table;
repeated ids keep all their rows, next to each other in an order that their texts decide; a null id comes first and is read back as null.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import col, shared_path

#: Pieces that an encoder remembers: fewer take less memory and more time.
MAX_PIECES = 600_000
_MARKS = frozenset(".,!?;:")
_NO_ID = np.iinfo(np.int64).min


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece once.

    Its splitting pattern starts a new token at a space or line feed that stands between other characters than white
    space, so a text can be cut there and the pieces' ids joined; a mark after letters is cut off too. The library encodes
    the pieces that are not known yet, many in a row, and the ids' byte lengths tell where each piece ends. Texts with
    white space in other places, or with the string of an added token, are encoded whole. Beyond ``max_pieces`` pieces those not met just now are forgotten.
    """

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.width = np.zeros(self.size, dtype=np.int64)
        for piece, i in vocab.items():
            self.width[i] = len(piece)
        self.max_pieces = max_pieces
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.n = self.used = 0
        self.start, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.open = np.zeros(1 << 16, dtype=bool)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.marks = {m: self._add(np.array(self.tok.encode(m, add_special_tokens=False).ids, dtype=np.uint32), np.array([1]))[0] for m in _MARKS}

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> range:
        """Room for pieces whose ids follow each other in ``ids``; gives their numbers."""
        k = len(counts)
        while self.n + k > len(self.start):
            for name in ("start", "count", "open"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + k] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + k] = counts
        self.open[self.n : self.n + k] = False
        self.n += k
        self.used += len(ids)
        return range(self.n - k, self.n)

    def _keep(self, pieces: set[str]) -> None:
        """Forget all but these pieces."""
        kept = [(p, k) for p, k in self.known.items() if p in pieces]
        numbers = np.array([k for _, k in kept], dtype=np.int64)
        ids, counts, open_ = self._gather(numbers), self.count[numbers], self.open[numbers]
        self._clear()
        new = self._add(ids, counts)
        self.open[new.start : new.stop] = open_
        self.known.update(zip((p for p, _ in kept), new, strict=True))

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        n = self.count[numbers]
        return self.ids[np.repeat(self.start[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of new pieces; a word with a mark is put together. An open piece ends in white space."""
        plain, marked = [], []
        for p in pieces:
            if not p or p[-1].isspace():
                self.known[p] = self._add(self.ids[:0], np.zeros(1, dtype=np.int64))[0]
                self.open[self.known[p]] = True
            elif p[-1] in _MARKS and p[p[0] == "\n" : -1].isalpha():
                marked.append(p)
            else:
                plain.append(p)
        plain += {p[:-1] for p in marked}.difference(self.known, plain)
        for i in range(0, len(plain), 1024):  # one at a time, since the library's results are large
            group = plain[i : i + 1024]
            texts = [p if p[0] == "\n" else " " + p for p in group]
            e = self.tok.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0]
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in texts])
            reached = np.cumsum(self.width[ids])
            stop = np.searchsorted(reached, ends) + 1
            assert (reached[stop - 1] == ends).all(), "a piece does not end with a token"
            self.known.update(zip(group, self._add(ids, np.diff(stop, prepend=0)), strict=True))
        if marked:
            pair = np.array([(self.known[p[:-1]], self.marks[p[-1]]) for p in marked])
            counts = self.count[pair].sum(1)
            self.known.update(zip(marked, self._add(self._gather(pair.ravel()), counts), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as uint32, in order."""
        group, chars = [], 0
        for t in texts:
            group.append(t or "")
            chars += len(group[-1])
            if chars > 400_000 + 6 * self.max_pieces:
                yield from self._encode(group)
                group, chars = [], 0
        if group:
            yield from self._encode(group)

    def _encode(self, given: list[str]) -> Iterator[np.ndarray]:
        texts = ["" if any(a in t for a in self.added) else t for t in given]
        pieces = ("\n" + "\n".join(texts)).replace("\n", " \n").split(" ")
        del pieces[0]
        if self.n > self.max_pieces:
            self._keep(set(pieces))
        if new := set(pieces).difference(self.known):
            self._learn(new)
        ends = np.cumsum([1 + t.count(" ") + t.count("\n") for t in texts])
        heads = np.concatenate([[0], ends[:-1]])
        piece = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        whole = np.add.reduceat(self.open[piece].astype(np.int64), heads) > 0
        for k, t in enumerate(given):
            if whole[k] or t and not texts[k]:
                yield np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                yield self._gather(piece[heads[k] : ends[k]])[1:]  # without the line feed before the text


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, max_pieces: int = MAX_PIECES) -> Encoder:
    """This process's encoder for a vocabulary file; it outlives tasks. It takes about 600 MB, with 100,000 pieces half of that."""
    key = (path, max_pieces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, max_pieces)
    return _encoders[key]


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _local(path: str) -> str | None:
    """A local path for ``file:`` addresses and plain paths, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Out:
    """A file in the shared folder that gets its name only when it is complete."""

    def __init__(self, path: str, attempt: int):
        self.local, self.temp = _local(path), f".{attempt}.tmp"
        if self.local:
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.file = open(self.local + self.temp, "wb")  # noqa: SIM115
        else:
            self.fs, self.path = _filesystem(path)
            self.file = self.fs.open_output_stream(self.path + self.temp)
        self.write = self.file.write

    def done(self) -> None:
        self.file.close()
        if self.local:
            os.replace(self.local + self.temp, self.local)
        else:
            self.fs.move(self.path + self.temp, self.path)


def _mapped(path: str, kind: str) -> np.ndarray:
    """An id file as an array: memory-mapped if the folder is mounted, else read from the store."""
    local = _local(path)
    if local:
        return np.memmap(local, dtype=kind, mode="r") if os.path.getsize(local) else np.zeros(0, dtype=kind)
    fs, name = _filesystem(path)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype=kind)


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, int]], str]:
    """Encode every text, write the id files to ``folder`` in ascending id order; gives ``(part, base)`` of each part and the kind of integer."""
    path = tokenizer or default_tokenizer()
    kind = "<u2" if encoder(path).size <= 1 << 16 else "<u4"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        out, offsets, ids, at = None, [0], [], 0
        for batch in batches:
            if out is None and len(batch):
                out = _Out(f"{folder}/part-{part:05d}.bin", attempt)
            ids += [_NO_ID if pd.isna(x) else int(x) for x in batch["i"]]
            for e in encoder(path).encode([t if isinstance(t, str) else None for t in batch["t"]]):
                out.write(e.astype(kind).tobytes() + np.array([end_id], dtype=kind).tobytes())
                at += len(e) + 1
                offsets.append(at)
        if out is not None:
            out.done()
            index = _Out(f"{folder}/part-{part:05d}.idx", attempt)
            index.write(np.array([len(ids), *offsets, *ids], dtype="<i8").tobytes())
            index.done()
            yield pd.DataFrame({"part": [part], "n_tokens": [at]})

    # many rows with one id are dealt by their texts
    rows = docs.select(col(id_col).alias("i"), col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("i", "h").sortWithinPartitions("i", "h", "t").select("i", "t")
    parts = sorted(tuple(r) for r in rows.mapInPandas(write, "part int, n_tokens long").collect())  # a row for each partition
    bases = np.cumsum([0] + [n for _, n in parts])
    return [(p, int(b)) for (p, _), b in zip(parts, bases, strict=False)], kind


def read_ids(spark, folder: str, parts: list[tuple[int, int]], kind: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, base in zip(batch["part"], batch["base"], strict=True):
                index = _mapped(f"{folder}/part-{part:05d}.idx", "<i8")
                ids = _mapped(f"{folder}/part-{part:05d}.bin", kind)
                n = int(index[0])
                offsets, names = np.asarray(index[1 : n + 2]), np.asarray(index[n + 2 : 2 * n + 2])
                for lo in range(0, n, 10_000):
                    o, who = offsets[lo : min(n, lo + 10_000) + 1], names[lo : lo + 10_000]
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if x == _NO_ID else int(x) for x in who], dtype="Int64"), "start": base + o[:-1], "n_tokens": np.diff(o),
                        "ids_crc32": [crc32_of(ids[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)],
                    })

    table = spark.createDataFrame(parts, "part int, base long")
    return table.repartition(max(1, len(parts)), "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "token-ids")
    return read_ids(spark, folder, *write_ids(docs, folder))
