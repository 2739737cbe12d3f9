"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs of the training rows are quantised to ``q = 1 + floor(log2 c)``; a pair of n-gram and level
is put into a Bloom filter for each level from 1 to ``q``. A worker finds an n-gram's level by asking for level 1, 2, ...
until the filter says no: it never says too little, and too much by ``r`` levels with a chance that falls as the filter's
error rate to the power ``r``. The model is a bigram model with Dirichlet smoothing,
``p(w|v) = (c(vw) + mu p(w)) / (c(v) + mu)``, all counts from such probes.

One pass over the texts sends each chunk's distinct words and pairs, with counts, to buckets by hash (packed, not a row for
each word; a frequent word costs one entry a chunk, in every bucket and at every size). There is a bucket for every
``BUCKET_BYTES`` of text. A bucket adds up, and keeps the exact counts of its words and its part of the filter. The filter,
``BITS`` bits an entry, grows with the corpus and holds every n-gram. Up to ``max_bits`` filter and counts are broadcast; beyond
that they stay in their parts, each chunk's distinct words and pairs are sent to the buckets that hold them, and the levels
and counts found there meet by chunk. Both ways give the same scores.

Edge cases: a null or empty text is the end token alone; without training rows all counts are zero; an empty table gives
an empty table; rows with equal ids are scored each by itself; a null id hashes as the empty string; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import col, materialize

BITS, PROBES, MAX_BITS, MU = 6, 4, 1 << 30, 200.0
_CHUNK_WORDS, BUCKET_BYTES = 1_000_000, 16 << 20
_BLOCK = 1 << 27
_M, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END = xxhash.xxh3_64_intdigest(b"\n")  # a line feed is in no word


def remainder(doc_id, by: int = 5) -> int:
    """crc32 of the id as text, modulo ``by``."""
    return zlib.crc32(b"" if doc_id is None or pd.isna(doc_id) else str(int(doc_id)).encode()) % by


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _S
    return x ^ (x >> np.uint64(29))


def pairs(w: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the end token stands before a document."""
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[firsts] = END
    return _mix(before * _M + _mix(w))


def _docs(batches: Iterator[pd.DataFrame], words: int = _CHUNK_WORDS) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Chunks of documents: ids, tokens of all (ends included), number of tokens of each."""
    ids, parts, size = [], [], 0
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for i, t in zip(batch["i"], batch["t"], strict=True):
            w = t.encode("utf-8", "surrogatepass").lower().split() if isinstance(t, str) else []
            ids.append(i)
            parts.append(np.fromiter(map(digest, w), dtype=np.uint64, count=len(w)))
            size += len(w)
            if size > words:
                yield ids, *_join(parts)
                ids, parts, size = [], [], 0
    if ids:
        yield ids, *_join(parts)


def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    end = np.array([END], dtype=np.uint64)
    return np.concatenate([x for p in parts for x in (p, end)]), np.array([len(p) + 1 for p in parts], dtype=np.int64)


def _z(a: np.ndarray, kind: str) -> bytes:
    return zlib.compress(a.astype(kind).tobytes(), 1)


def _unz(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=kind)


def _sorted_bytes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, six bytes each where that is enough."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    wide = 6 if not len(d) or int(d[1:].max(initial=0)) < 1 << 48 else 8
    head = h[:1].astype("<u8").tobytes()
    return bytes([wide]) + head + d[1:].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _sorted_from(b: bytes) -> np.ndarray:
    if len(b) == 1:
        return np.zeros(0, dtype=np.uint64)
    wide = b[0]
    raw = np.frombuffer(b, dtype=np.uint8, offset=9).reshape(-1, wide)
    d = np.zeros((len(raw) + 1, 8), dtype=np.uint8)
    d[1:, :wide] = raw
    d[0] = np.frombuffer(b, dtype=np.uint8, offset=1, count=8)
    return np.cumsum(d.reshape(-1).view("<u8"), dtype=np.uint64)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def _value(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range on a log scale."""
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 2.0 ** (level - 0.5)))


def _positions(h: np.ndarray, level: int, size) -> Iterator[np.ndarray]:
    a = _mix(h + np.uint64(level * int(_M) & 0xFFFFFFFFFFFFFFFF))
    b = (a >> np.uint64(17)) | np.uint64(1)
    for j in range(PROBES):
        yield (a + np.uint64(j) * b) % size


def segment(h: np.ndarray, counts: np.ndarray, block: int = _BLOCK) -> bytes:
    """A bucket's part of the filter, of all its n-grams: at least 64 bits, set ``block`` (a multiple of 8) at a time."""
    q = levels(counts)
    size = max(64, -(-int(q.sum()) * BITS // 8) * 8)
    out = []
    for lo in range(0, size, block):
        bits = np.zeros(min(block, size - lo), dtype=np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            for p in _positions(h[q >= level], level, np.uint64(size)):
                bits[p if size <= block else p[(p >= lo) & (p < lo + len(bits))] - np.uint64(lo)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)


class Filter:
    """The filter's parts, one after the other, each for an even share of the hashes."""

    def __init__(self, parts: list[bytes] | tuple[np.ndarray, bytes]):
        """``parts``, or their sizes and the whole, which is then not copied."""
        sizes, whole = parts if isinstance(parts, tuple) else (np.array([len(p) for p in parts], dtype=np.int64), b"".join(parts))
        self.n = len(sizes)
        self.base = (np.cumsum(sizes) - sizes).astype(np.uint64) * np.uint64(8)
        self.size = (sizes * 8).astype(np.uint64)
        self.bits = np.frombuffer(whole, dtype=np.uint8)

    def level(self, h: np.ndarray, dealt_by: np.ndarray | None = None) -> np.ndarray:
        """The highest level up to which the filter holds each n-gram; each probe is made for those only that still pass."""
        out = np.zeros(len(h), dtype=np.int64)
        part = bucket_of(h if dealt_by is None else dealt_by, self.n)
        live, base, size = np.arange(len(h)), self.base[part], self.size[part]
        for level in range(1, 64):
            a = _mix(h + np.uint64(level * int(_M) & 0xFFFFFFFFFFFFFFFF))
            step = (a >> np.uint64(17)) | np.uint64(1)
            for j in range(PROBES):
                p = (a + np.uint64(j) * step) % size + base
                ok = (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
                if not ok.all():
                    live, h, base, size, a, step = (x[ok] for x in (live, h, base, size, a, step))
            if not len(live):
                break
            out[live] = level
        return out


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even shares of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


_ROW = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary"
_COLUMNS = ["bucket", "kind", "chunk", "a", "b", "c", "d"]
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_WORDS, _PAIRS, _META, _PART = 0, 1, 2, 3


def _ids_bytes(ids: list) -> bytes:
    known = np.array([0 if pd.isna(i) else int(i) for i in ids], dtype="<i8")
    return known.tobytes() + np.array([pd.isna(i) for i in ids]).tobytes()


def _ids_from(b: bytes, k: int) -> pd.Series:
    ids, null = np.frombuffer(b, dtype="<i8", count=k), np.frombuffer(b, dtype=bool, offset=8 * k)
    return pd.Series(ids, dtype="Int64").mask(pd.Series(null))


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _dealt(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets that have some of the sorted hashes, and where."""
    edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, slice(edge[b], edge[b + 1])


def _send(buckets: int, hold_out: int, folds: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, w, sizes in _docs(batches):
            train = np.repeat(np.array([remainder(i, folds) != hold_out for i in ids]), sizes)
            out = []
            for kind, x in ((_WORDS, w), (_PAIRS, pairs(w, _firsts(sizes)))):
                h, n = np.unique(x[train], return_counts=True)
                out += [(b, kind, 0, _sorted_bytes(h[at]), _z(n[at], "<u4"), None, None) for b, at in _dealt(h, buckets)]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return send


def _added(part: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a kind, sorted, and their counts."""
    mine = part[part["kind"] == kind]
    h = np.concatenate([*(_sorted_from(x) for x in mine["a"]), np.zeros(0, dtype=np.uint64)])
    n = np.concatenate([*(_unz(x, "<u4") for x in mine["b"]), np.zeros(0, dtype="<u4")])
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order].astype(np.int64)
    if not len(h):
        return h, n
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


def _settle(part: pd.DataFrame) -> pd.DataFrame:
    """Adds up a bucket: statistics and part of the filter, words and their counts."""
    (u, n), (two, n_two) = _added(part, _WORDS), _added(part, _PAIRS)
    stats = np.array([n.sum(), len(u)], dtype="<i8")
    filtered = segment(np.concatenate([_mix(u), two]), np.concatenate([n, n_two]))
    return pd.DataFrame([(int(part["bucket"].iloc[0]), _PART, 0, stats.tobytes(), filtered, _sorted_bytes(u), _z(n, "<u8"))], columns=_COLUMNS)


def _counted(h: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact counts of ``h``, 0 for those not among the sorted ``known``."""
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    return np.where(known[at] == h, n[at], 0).astype(np.int64) if len(known) else np.zeros(len(h), dtype=np.int64)


def _sums(one: np.ndarray, inv: np.ndarray, two: np.ndarray, sizes: np.ndarray, n: int, v: int, mu: float) -> np.ndarray:
    """Each document's score: ``one`` has the levels of the distinct words, ``inv`` each token's place there, ``two`` the levels of all pairs."""
    c1 = _value(one)
    p1 = ((c1 + 0.5) / (n + 0.5 * (v + 1)))[inv]
    c1 = c1[inv]
    firsts = _firsts(sizes)
    before = np.empty_like(c1)
    before[1:] = c1[:-1]
    before[firsts] = c1[sizes[0] - 1]  # a document's last token is the end token
    c2 = np.minimum(_value(two), before)
    return np.add.reduceat(np.log10((c2 + mu * np.minimum(p1, 1.0)) / (before + mu)), firsts)


def _of_kind(part: pd.DataFrame, kind: int, column: str, of: str) -> np.ndarray:
    """A chunk's answers of a kind: hashes are sorted, so buckets in order give them in order."""
    return np.concatenate([_unz(x, of) for x in part[part["kind"] == kind].sort_values("bucket")[column]])


def _scores(ids: pd.Series, counts: np.ndarray, score: np.ndarray, inv: np.ndarray, sizes: np.ndarray, n: int, v: int) -> pd.DataFrame:
    each, firsts = counts[inv], _firsts(sizes)
    base = np.add.reduceat(np.log10(counts + 0.5)[inv], firsts) - sizes * np.log10(n + 0.5 * (v + 1))
    return pd.DataFrame({"doc_id": ids, "n_tokens": sizes, "n_known": np.add.reduceat((each > 0).astype(np.int64), firsts), "base_score": base, "score": score})


def _by_broadcast(rows: DataFrame, parts: DataFrame, buckets: int, n: int, v: int, mu: float) -> DataFrame:
    # at most max_bits / 8 bytes; hashes are dealt in order, so buckets in order give them sorted
    known = {r["bucket"]: (bytes(r["b"]), bytes(r["c"]), bytes(r["d"])) for r in parts.select("bucket", "b", "c", "d").collect()}
    none = (bytes(8), _sorted_bytes(np.zeros(0, dtype=np.uint64)), _z(np.zeros(0), "<u8"))
    held = [known.pop(b, none) for b in range(buckets)]
    sizes = np.array([len(p[0]) for p in held], dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((sizes, b"".join(p[0] for p in held), [p[1:] for p in held]))
    del held

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = None
        for ids, w, sizes in _docs(batches, _CHUNK_WORDS // 2):
            if f is None:
                f = Filter(shared.value[:2])
                words = np.concatenate([_sorted_from(p[0]) for p in shared.value[2]])
                counts = np.concatenate([_unz(p[1], "<u8") for p in shared.value[2]])
            u, inv = np.unique(w, return_inverse=True)
            score = _sums(f.level(_mix(u), u), inv, f.level(pairs(w, _firsts(sizes))), sizes, n, v, mu)
            yield _scores(pd.Series(ids).astype("Int64"), _counted(u, words, counts), score, inv, sizes, n, v)

    return rows.mapInPandas(model, _SCORED)


def _ask(buckets: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for ids, w, sizes in _docs(batches, _CHUNK_WORDS // 2):
            u, inv = np.unique(w, return_inverse=True)
            two, at = np.unique(pairs(w, _firsts(sizes)), return_inverse=True)
            out = [(b, kind, chunk, _sorted_bytes(h[s]), None, None, None) for kind, h in ((_WORDS, u), (_PAIRS, two)) for b, s in _dealt(h, buckets)]
            out.append((int(chunk % buckets), _META, chunk, _ids_bytes(ids), sizes.astype("<i8").tobytes(), _z(inv, "<u4"), _z(at, "<u4")))
            yield pd.DataFrame(out, columns=_COLUMNS)
            chunk += 1

    return ask


def _answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Levels and counts in place of hashes; a bucket's part comes before its questions, and one is held at a time."""
    at, f, words, counts = -1, None, np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u8")
    for batch in batches:
        out = []
        for m in batch.itertuples(index=False):
            if m.kind == _PART:
                at, f, words, counts = m.bucket, Filter([m.b]), _sorted_from(m.c), _unz(m.d, "<u8")
            elif m.kind == _META:
                out.append(tuple(m))
            else:
                h = _sorted_from(m.a)
                mine = m.bucket == at  # a bucket without a part has no trained n-gram
                level = f.level(_mix(h) if m.kind == _WORDS else h) if mine else np.zeros(len(h))
                exact = _z(_counted(h, words, counts) if mine else np.zeros(len(h)), "<u8") if m.kind == _WORDS else None
                out.append((m.bucket, m.kind, m.chunk, _z(level, "u1"), exact, None, None))
        yield pd.DataFrame(out, columns=_COLUMNS)


def _by_parts(rows: DataFrame, parts: DataFrame, buckets: int, n: int, v: int, mu: float) -> DataFrame:
    asked = rows.mapInPandas(_ask(buckets), _ROW).unionByName(parts)
    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("kind"))  # _PART is the highest kind

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        meta = part[part["kind"] == _META].iloc[0]
        sizes, inv = np.frombuffer(meta["b"], dtype="<i8"), _unz(meta["c"], "<u4")
        one, two = (_of_kind(part, kind, "a", "u1").astype(np.int64) for kind in (_WORDS, _PAIRS))
        score = _sums(one, inv, two[_unz(meta["d"], "<u4")], sizes, n, v, mu)
        return _scores(_ids_from(meta["a"], len(sizes)), _of_kind(part, _WORDS, "b", "<u8").astype(np.int64), score, inv, sizes, n, v)

    return dealt.mapInPandas(_answer, _ROW).groupBy("chunk").applyInPandas(meet, _SCORED)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hold_out: int = 1, folds: int = 5, max_bits: int = MAX_BITS, mu: float = MU) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("i"), col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    got = rows.mapInPandas(_send(buckets, hold_out, folds), _ROW).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_settle, _ROW)
    parts = materialize(got, "lm")
    # two numbers and a size a bucket
    stats = [(np.frombuffer(r["a"], dtype="<i8"), r["size"]) for r in parts.select("a", (F.length("b") + F.length("c") + F.length("d")).cast("long").alias("size")).collect()]
    n, v = (int(sum(p[0][j] for p in stats)) for j in (0, 1))
    mine = (_by_broadcast if sum(p[1] for p in stats) * 8 <= max_bits else _by_parts)(rows, parts, buckets, n, v, mu)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == hold_out
    return mine.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
