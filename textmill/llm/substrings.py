"""Substring deduplication: words inside windows of ``window`` words that also start earlier in the corpus go.

A count-min prefilter keeps most windows out of the exact grouping. A window is looked up by its minimiser, the grams of
``gram`` words in it with the smallest hash: equal windows have equal minimisers at equal places, so the number of places
where a gram is a minimiser bounds from above how often any window with that minimiser occurs, while there are several
times fewer such places than windows. Each partition makes a sparse count-min sketch of these places; the sketches are
added (counts stop at two), and what remains is a bit for each cell: counted twice or more. As count-min never
underestimates, a window with a clear bit in any row occurs once, and no repeated window is lost.

The second pass groups exactly the windows estimated repeated, by a 96-bit hash of their word sequence, in buckets by
minimiser. Of the occurrences that a task sees of a window only the earliest goes there; the others are repeats already, and
leave as runs of starts in buckets by document. So a passage found everywhere costs a bucket one row a task, not one a
document. Buckets find the earliest of all; runs of starts that are not the earliest go back, packed by groups of documents.

The sketch has about four cells for each expected place, at most ``2**MAX_CELLS_LOG2`` a row; beyond that more windows
reach the exact pass, and the result stays the same. It is the only thing that is broadcast, at most 64 MB.

Edge cases: null and empty texts have no words; texts shorter than a window are untouched; an empty table gives an empty
table; rows with equal ids are told apart by their text, and of two with the same id and start neither is earlier; a null
id comes before all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import col, words_of

WINDOW, GRAM = 20, 10
ROWS, CHUNKS, MAX_CELLS_LOG2 = 2, 64, 28
_CHUNK_WORDS, _FLUSH = 600_000, 1_500_000
_M = 0x9E3779B97F4A7C15
_SECOND = 0xD6E8FEB86659FD93
_NONE = np.iinfo(np.int64).min


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _rolling(w: np.ndarray, size: int, by: int) -> np.ndarray:
    """Polynomial hash of every ``size`` values in a row, put together from hashes of powers of two."""
    out, done, block, length = None, 0, w, 1
    while length <= size:
        if size & length:
            if out is None:
                out = block
            else:
                n = len(w) - done - length + 1
                out = out[:n] * np.uint64(pow(by, length, 1 << 64)) + block[done : done + n]
            done += length
        if 2 * length <= size:
            n = len(block) - length
            block = block[:n] * np.uint64(pow(by, length, 1 << 64)) + block[length:]
        length *= 2
    return out


def _smallest(g: np.ndarray, span: int) -> np.ndarray:
    block, length = g, 1
    while 2 * length <= span:
        block = np.minimum(block[:-length], block[length:])
        length *= 2
    n = len(g) - span + 1
    return np.minimum(block[:n], block[span - length : span - length + n])


class Windows:
    """Windows of some documents laid end to end: ``grams``, ``least`` (minimiser of each window), ``valid`` windows."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        parts = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        n = int(self.sizes.sum())
        self.n = max(0, n - window + 1)
        if not self.n:
            return
        digest = xxhash.xxh3_64_intdigest
        w = np.concatenate([np.fromiter(map(digest, p), dtype=np.uint64, count=len(p)) for p in parts])
        self.words = w
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.sizes)
        self.valid = self.doc[: self.n] == self.doc[window - 1 :]
        self.plain = _rolling(w, gram, _M)
        self.grams = _mix(self.plain, _SECOND)
        self.least = _smallest(self.grams, window - gram + 1)
        self.window, self.gram = window, gram

    def places(self) -> np.ndarray:
        """Grams of all places that are a minimiser of some window."""
        hit = np.zeros(len(self.grams), dtype=bool)
        for o in range(self.window - self.gram + 1):
            hit[o : o + self.n] |= self.valid & (self.grams[o : o + self.n] == self.least)
        return self.grams[hit]


def _grouped(rows: Iterator[tuple[int, bytes]], words: int = _CHUNK_WORDS) -> Iterator[tuple[list[int], list[bytes]]]:
    """Documents by the handful, of about ``words`` words (at six bytes each)."""
    at, texts, size = [], [], 0
    for i, t in rows:
        at.append(i)
        texts.append(t)
        size += len(t)
        if size > words * 6:
            yield at, texts
            at, texts, size = [], [], 0
    if at:
        yield at, texts


def _cells(grams: np.ndarray, row: int, log2: int) -> np.ndarray:
    return _mix(grams, (_M, 0xC2B2AE3D27D4EB4F)[row] | 1) >> np.uint64(64 - log2)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.diff(a, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), dtype="<u4"), dtype=np.uint32)


def sketch(docs: DataFrame, text_col: str, window: int, gram: int) -> tuple[int, list[np.ndarray]]:
    """``log2`` of the cells a row, and for each row a bitmap of the cells counted twice or more over all documents."""
    size = docs.agg(F.sum(F.octet_length(col(text_col)).cast("long"))).first()[0] or 0
    expected = size // 6 * 2 // (window - gram + 2)
    log2 = min(MAX_CELLS_LOG2, max(12, int(4 * expected).bit_length()))
    within = log2 - (CHUNKS - 1).bit_length()

    def emit(found: list[np.ndarray]) -> pd.DataFrame:
        grams, times = np.unique(np.concatenate(found), return_counts=True)
        out = []
        for row in range(ROWS):
            cell = _cells(grams, row, log2)
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total = np.add.reduceat(n, first)
            cell = cell[first]
            chunk = (cell >> np.uint64(within)).astype(np.int64)
            edges = np.searchsorted(chunk, np.arange(CHUNKS + 1))
            low = (cell & np.uint64((1 << within) - 1)).astype(np.uint32)
            for c in range(CHUNKS):
                a, b = edges[c], edges[c + 1]
                if a < b:
                    twice = total[a:b] > 1
                    out.append((row * CHUNKS + c, _pack(low[a:b][~twice]), _pack(low[a:b][twice])))
        return pd.DataFrame(out, columns=["chunk", "once", "twice"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = [], 0
        for batch in batches:
            for _, texts in _grouped((0, t.encode("utf-8", "surrogatepass")) for t in batch["t"] if isinstance(t, str)):
                v = Windows(texts, window, gram)
                if v.n:
                    found.append(v.places())
                    n += len(found[-1])
                    if n > _FLUSH:
                        yield emit(found)
                        found, n = [], 0
        if n:
            yield emit(found)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(1 << within, dtype=np.uint8)
        for once, twice in zip(part["once"], part["twice"], strict=True):
            i = _unpack(once)  # no cell twice in one of these
            cells[i] = np.minimum(cells[i] + 1, 2)
            cells[_unpack(twice)] = 2
        return pd.DataFrame({"chunk": [int(part["chunk"].iloc[0])], "bits": [np.packbits(cells > 1, bitorder="little").tobytes()]})

    parts = docs.select(col(text_col).alias("t")).mapInPandas(count, "chunk int, once binary, twice binary")
    merged = parts.groupBy("chunk").applyInPandas(add, "chunk int, bits binary").collect()  # bounded: two bitmaps of at most 2**28 bits
    bitmaps = [np.zeros(max(1, (1 << log2) // 8), dtype=np.uint8) for _ in range(ROWS)]
    step = (1 << within) // 8
    for chunk, bits in merged:
        row, c = divmod(chunk, CHUNKS)
        bitmaps[row][c * step : (c + 1) * step] = np.frombuffer(bits, dtype=np.uint8)
    return log2, bitmaps


def _often(grams: np.ndarray, log2: int, bitmaps: list[np.ndarray]) -> np.ndarray:
    """Whether the sketch says twice or more."""
    out = np.ones(len(grams), dtype=bool)
    for row in range(ROWS):
        cell = _cells(grams, row, log2)
        out &= (bitmaps[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


_BUCKET = "bucket int, h64 binary, h32 binary, doc binary, pos binary, ids binary, keys binary, runs binary, n_runs binary"


_FOUND = "bucket int, ids binary, keys binary, runs binary, n_runs binary"


def _by_document(ids: np.ndarray, keys: np.ndarray, runs: bytes, n: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Documents and their runs, packed by a bucket of the document."""
    bucket = (_mix(keys.view(np.uint64) ^ ids.view(np.uint64), _M) % np.uint64(buckets)).astype(np.int32)
    each = np.frombuffer(runs, dtype="<u8")
    start = np.cumsum(n) - n
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        rows = order[edges[b] : edges[b + 1]]
        m = n[rows]
        mine = each[np.repeat(start[rows] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        yield b, ids[rows].tobytes(), keys[rows].tobytes(), mine.tobytes(), m.astype("<u4").tobytes()


def _merged(part: pd.DataFrame) -> pd.DataFrame:
    """``doc_id, key, runs`` of each document of a bucket."""
    raw = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in part[name]])
    n = raw("n_runs", "<u4").astype(np.int64)
    ids, keys, runs = np.repeat(raw("ids", np.int64), n), np.repeat(raw("keys", np.int64), n), raw("runs", "<u8")
    order = np.lexsort((keys, ids))
    ids, keys, runs = ids[order], keys[order], runs[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
    out = [runs[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(runs)], strict=True)]
    return pd.DataFrame({"doc_id": pd.Series(ids[first], dtype="Int64").mask(pd.Series(ids[first] == _NONE)), "key": keys[first], "runs": pd.Series(out, dtype=object)})


def _packed_runs(d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Distinct documents, the runs of their starts one after the other, and how many runs each has."""
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (np.diff(p) > 1)])
    same = np.concatenate([[False], (d[1:] == d[:-1]) & (p[1:] == p[:-1])])
    first = np.flatnonzero(new & ~same)
    length = np.add.reduceat((~same).astype(np.int64), first)
    who, n = np.unique(d[first], return_counts=True)
    return who, np.stack([p[first], length], axis=1).astype("<u4").tobytes(), n


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """``doc_id, key, runs``: for rows (told apart by the hash of their text) the runs of windows that start earlier elsewhere."""
    spark = docs.sparkSession
    log2, bitmaps = sketch(docs, text_col, window, gram)
    shared = spark.sparkContext.broadcast(bitmaps)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << log2) >> 21)

    def emit(h: list, g: list, s: list, d: list, p: list, ids: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        h, g, s, d, p = (np.concatenate(x) for x in (h, g, s, d, p))
        order = np.lexsort((p, ids[d], s, h))
        h, g, s, d, p = h[order], g[order], s[order], d[order], p[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        later = (ids[d] != ids[d[head]]) | (p != p[head])  # of equal ids and starts none is later
        out = []
        x = np.flatnonzero(~later)
        bucket = (_mix(g[x], _SECOND) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            rows = x[order[edges[b] : edges[b + 1]]]
            who, local = np.unique(d[rows], return_inverse=True)
            out.append((
                int(b), h[rows].tobytes(), s[rows].tobytes(), zlib.compress(local.astype("<u4").tobytes(), 1), zlib.compress(p[rows].astype("<u4").tobytes(), 1), ids[who].tobytes(), keys[who].tobytes(), b"", b"",
            ))
        if later.any():
            who, runs, n = _packed_runs(d[later], p[later])
            out += [(b, b"", b"", b"", b"", i, k, r, m) for b, i, k, r, m in _by_document(ids[who], keys[who], runs, n, buckets)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in _BUCKET.split(", ")])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, g, s, d, p, ids, keys, n, n_docs = [], [], [], [], [], [], [], 0, 0
        for batch in batches:
            who = np.array([_NONE if pd.isna(x) else int(x) for x in batch["i"]], dtype=np.int64)
            key = batch["k"].to_numpy(dtype=np.int64)
            rows = ((i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(batch["t"]) if isinstance(t, str))
            for at, texts in _grouped(rows):
                v = Windows(texts, window, gram)
                if not v.n:
                    continue
                # one look-up for each run of equal minimisers
                i = np.flatnonzero(v.valid)
                if not len(i):
                    continue
                m = v.least[i]
                new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                i = i[np.repeat(_often(m[new], log2, shared.value), np.diff(new, append=len(m)))]
                if not len(i):
                    continue
                second = _rolling(_mix(v.words, 0xA0761D6478BD642F), window, _SECOND)
                start = np.cumsum(v.sizes) - v.sizes
                h.append((v.plain[i] * np.uint64(pow(_M, gram, 1 << 64)) + v.plain[i + gram]) if window == 2 * gram else _rolling(v.words, window, _M)[i])
                s.append((_mix(second[i], _M) >> np.uint64(32)).astype(np.uint32))
                g.append(v.least[i])
                local = v.doc[i]
                p.append((i - start[local]).astype(np.int64))
                d.append(n_docs + local.astype(np.int64))
                ids.append(who[at])
                keys.append(key[at])
                n_docs += len(at)
                n += len(i)
                if n > _FLUSH:
                    yield emit(h, g, s, d, p, np.concatenate(ids), np.concatenate(keys))
                    h, g, s, d, p, ids, keys, n, n_docs = [], [], [], [], [], [], [], 0, 0
        if n:
            yield emit(h, g, s, d, p, np.concatenate(ids), np.concatenate(keys))

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        told = part[part["n_runs"].str.len() > 0]
        out = list(told[["bucket", "ids", "keys", "runs", "n_runs"]].itertuples(index=False, name=None))
        part = part[part["n_runs"].str.len() == 0]
        if len(part):
            raw = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in part[name]]
            small = lambda name: [np.frombuffer(zlib.decompress(x), dtype="<u4").astype(np.int64) for x in part[name]]
            ids, keys = raw("ids", np.int64), raw("keys", np.int64)
            base = np.cumsum([0] + [len(x) for x in ids])
            ids, keys = np.concatenate(ids), np.concatenate(keys)
            h, s, p = np.concatenate(raw("h64", np.uint64)), np.concatenate(raw("h32", np.uint32)), np.concatenate(small("pos"))
            d = np.concatenate([x + b for x, b in zip(small("doc"), base, strict=False)])
            order = np.lexsort((p, ids[d], s, h))
            h, s, d, p = h[order], s[order], d[order], p[order]
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (s[1:] == s[:-1])])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            later = (ids[d] != ids[d[head]]) | (p != p[head])
            if later.any():
                who, runs, n = _packed_runs(d[later], p[later])
                out += _by_document(ids[who], keys[who], runs, n, buckets)
        return pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")])

    rows = docs.select(col(id_col).cast("long").alias("i"), F.xxhash64(col(text_col)).alias("k"), col(text_col).alias("t"))
    return rows.mapInPandas(find, _BUCKET).groupBy("bucket").applyInPandas(settle, _FOUND).groupBy("bucket").applyInPandas(_merged, "doc_id long, key long, runs binary")


def removed(n_words: int, runs: bytes | None, window: int) -> np.ndarray:
    """Which words lie in windows that go."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    if runs is not None:
        pairs = np.frombuffer(runs, dtype="<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 0] + pairs[:, 1] - 1 + window, -1)
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row; ``kept`` is the words that stay, joined by one space."""
    found = repeats(docs, id_col, text_col, window, gram)
    rows = docs.select(col(id_col).cast("long").alias("i"), F.xxhash64(col(text_col)).alias("k"), col(text_col).alias("t"))
    joined = rows.join(found, rows["i"].eqNullSafe(found["doc_id"]) & (rows["k"] == found["key"]), "left")

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, runs in batches:
            out = []
            for t, r in zip(texts, runs, strict=True):
                words = words_of(t)
                gone = removed(len(words), r, window)
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    return joined.select(F.col("i").alias("doc_id"), apply.asNondeterministic()("t", "runs").alias("f")).select("doc_id", "f.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM split),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS k, ws FROM split WHERE len(ws) >= 20),
ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(ws[k:k + 19], ' ') ORDER BY doc_id, k) AS r FROM starts),
marked AS (SELECT w.doc_id, w.k, w.word, max(CASE WHEN r.r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words w LEFT JOIN ranked r ON w.doc_id = r.doc_id AND w.k = r.k),
per AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_words, 0)::BIGINT AS n_words, coalesce(p.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(p.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id"""


def plain(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by brute force, for tests: ids are distinct."""
    seen: set[tuple[bytes, ...]] = set()
    out = {}
    for i, t in sorted(rows):
        words = words_of(t)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
