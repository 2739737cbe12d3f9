"""Language identification with unigram piece models whose segmentations are summed, not chosen.

Each language has a probability for every piece of a fixed public byte-level vocabulary (all single bytes are pieces, so every
text has a segmentation). A word's probability is the sum over all its segmentations of the product of its pieces'
probabilities, by the forward algorithm over the whole word, however long; a text's is the product over its words, each led by
a space, in lower case. With the languages' shares as prior this gives the posterior of each language.

Probabilities are estimated by expectation-maximisation on word counts of a sample of training rows that has at most
``SAMPLE_BYTES`` bytes of text a language in expectation (rows chosen by a hash of text and id; whole texts), and at least the
row of each language that the hash puts first; that bound also holds for what reaches the driver, but for that one row. Words
are scored once for each worker's memory of up to ``REMEMBER`` words.

Edge cases: a null text or one without a letter (``str.isalpha``) is ``und`` with score 0; without training rows every text is; an
empty table gives an empty table; repeated rows get the same answer; ties go to the language that sorts first; a null id hashes
as the empty string; sums are scaled, so that no word is too long for them; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import col

REMEMBER, SAMPLE_BYTES = 350_000, 2_000_000
_K1, _K2, _SLOTS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 18
_BASE = np.uint64(0x100000001B3)
_CELLS = 1_500_000
_TINY, _LIFT = 1e-100, 1e100


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Lattice:
    """The vocabulary as a hash table of pieces, and forward and backward sums over words of one length."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        pieces = sorted(pieces | {bytes([b]) for b in range(256)})
        self.n = len(pieces)
        # a word has white space at its start only, so wider pieces than these are never looked for
        self.widest = max(len(p) for p in pieces if not any(c in b" \t\n\x0b\x0c\r" for c in p[1:]))
        self.key = np.zeros(1 << _SLOTS, dtype=np.uint64)
        self.number = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.longest = 1
        codes = []
        for p in pieces:
            code = 0
            for byte in p:
                code = (code * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
            codes.append(code)
        keys = self._keys(np.array(codes, dtype=np.uint64), np.array([len(p) for p in pieces], dtype=np.uint64))
        assert len(np.unique(keys)) == self.n, "two pieces have one key"
        for i, (key, slot) in enumerate(zip(keys, ((keys * _K2) >> np.uint64(64 - _SLOTS)).tolist(), strict=True)):
            probes = 1
            while self.number[slot] >= 0:
                slot, probes = (slot + 1) % (1 << _SLOTS), probes + 1
            self.key[slot], self.number[slot] = key, i
            self.longest = max(self.longest, probes)

    @staticmethod
    def _keys(code: np.ndarray, size) -> np.ndarray:
        x = (code ^ (code >> np.uint64(29))) * _K1
        return (x ^ (x >> np.uint64(32))) + np.asarray(size, dtype=np.uint64)

    def find(self, code: np.ndarray, size: int) -> np.ndarray:
        """Numbers of pieces by the hash of their bytes, the table's size for those that are none."""
        key = self._keys(code, size)
        slot = ((key * _K2) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        got = self.number[slot]
        out = np.where((self.key[slot] == key) & (got >= 0), got, self.n)
        open_ = np.flatnonzero((out == self.n) & (got >= 0))
        for _ in range(self.longest - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % (1 << _SLOTS)
            s = slot[open_]
            got = self.number[s]
            hit = (self.key[s] == key[open_]) & (got >= 0)
            out[open_[hit]] = got[hit]
            open_ = open_[~hit & (got >= 0)]
        return out

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """``(from, to, piece numbers)`` of all spans, by start, for words as rows of bytes."""
        grid = self.grid(words)
        for i in range(len(grid)):
            yield from ((i, i + s + 1, grid[i, s]) for s in range(min(grid.shape[1], len(grid) - i)))

    def grid(self, words: np.ndarray) -> np.ndarray:
        """``[start, size - 1, word]``: the number of the piece there, the table's size for none, for words as rows of bytes."""
        k, n = words.shape
        sizes = min(n, self.widest)
        out = np.full((n, sizes, k), self.n, dtype=np.int32)
        wide = words.T.astype(np.uint64) + np.uint64(1)
        code = np.zeros((n, k), dtype=np.uint64)
        for size in range(1, sizes + 1):
            code = code[: n - size + 1] * _BASE + wide[size - 1 :]
            out[: n - size + 1, size - 1] = self.find(code.ravel(), size).reshape(n - size + 1, k)
        return out

    def _sums(self, arcs: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``alpha[place, word, model]``, lifted where it gets tiny, and the logarithm of each place's lift."""
        n, sizes, k = arcs.shape
        alpha, lift = np.zeros((n + 1, k, p.shape[1])), np.zeros((n + 1, k, p.shape[1]))
        alpha[0] = 1
        for i in range(n):
            m = min(sizes, n - i)
            if i % 8 == 7:
                low = alpha[i] < _TINY
                if low.any():
                    alpha[i : i + m + 1, low] *= _LIFT
                    lift[i:, low] += np.log(_LIFT)
            alpha[i + 1 : i + m + 1] += alpha[i] * p[arcs[i, :m]]
        return alpha, lift

    def forward(self, words: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log probability of each word (row) under each model (column of ``p``, a last row of zeros included)."""
        alpha, lift = self._sums(self.grid(words), p)
        return np.log(alpha[-1]) - lift[-1]

    def expected(self, words: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in segmentations of ``words`` under one model."""
        arcs = self.grid(words)
        n, sizes, k = arcs.shape
        alpha, up = (x[:, :, 0] for x in self._sums(arcs, p[:, None]))
        beta, down = np.zeros((n + 1, k)), np.zeros((n + 1, k))
        beta[n] = 1
        out = np.zeros(self.n + 1)
        for i in range(n - 1, -1, -1):
            m = min(sizes, n - i)
            near = down[i + 1 : i + m + 1]
            # all of one row brought to the lift of the place after it, which has the most
            ways = p[arcs[i, :m]] * beta[i + 1 : i + m + 1] * np.exp(near[0] - near)
            share = alpha[i] * np.exp(up[n] - up[i] - near[0]) * weight / alpha[n]
            out += np.bincount(arcs[i, :m].ravel(), (ways * share).ravel(), self.n + 1)
            beta[i], down[i] = ways.sum(0), near[0]
            low = beta[i] < _TINY
            if low.any():
                beta[i, low] *= _LIFT
                down[i, low] += np.log(_LIFT)
        return out


def by_length(words: list[bytes], widest: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, rows of bytes)`` of words of each length, in blocks of bounded size (but for a single long word)."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w) + 1, []).append(k)
    for n, at in groups.items():
        block = max(1, _CELLS // (n * min(n, widest)))
        for lo in range(0, len(at), block):
            some = at[lo : lo + block]
            yield np.array(some), np.frombuffer(b"".join(b" " + words[k] for k in some), dtype=np.uint8).reshape(-1, n)


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def words_in(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def learn(counts: list[tuple[str, bytes, int]], path: str, rounds: int = 2, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities: a column for each, a last row of zeros for spans that are no piece."""
    lat = lattice(path)
    langs = sorted({c[0] for c in counts})
    p = np.zeros((lat.n + 1, len(langs)))
    for k, lang in enumerate(langs):
        mine = [(w, n) for x, w, n in counts if x == lang]
        weight = np.array([n for _, n in mine], dtype=float)
        q = np.full(lat.n + 1, 1 / lat.n)
        q[-1] = 0
        groups = list(by_length([w for w, _ in mine], lat.widest))
        for _ in range(rounds):
            total = np.full(lat.n + 1, smooth)
            for at, rows in groups:
                total += lat.expected(rows, weight[at], q)
            total[-1] = 0
            q = total / total.sum()
        p[:, k] = q
    return langs, p


def _remainder(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, path: str, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, piece probabilities and log shares, from rows whose id's remainder is not 0 and that have a language."""
    rows = docs.select(col(id_col).cast("long").alias("i"), col(text_col).alias("t"), col(lang_col).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    rows = rows.where(_remainder(F.col("i")) != 0)
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("l").agg(F.sum(F.octet_length("t").cast("long")), F.count("*")).collect()}
    if not sizes:
        return [], np.zeros((1, 0)), np.zeros(0)
    share = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, sample_bytes / max(1, n)))) for k, (n, _) in sizes.items()])
    draw = F.pmod(F.xxhash64("i", F.octet_length("t")), F.lit(1_000_000)) / F.lit(1e6)
    first = {r[0]: r[1] for r in rows.groupBy("l").agg(F.min(draw)).collect()}
    share = F.greatest(share, *[F.when(F.col("l") == k, F.lit(np.nextafter(x, 2).item())) for k, x in first.items()])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, bytes], int] = {}
            for t, lang in zip(batch["t"], batch["l"], strict=True):
                for w in words_in(t):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pd.DataFrame([(x, w, n) for (x, w), n in found.items()], columns=["l", "w", "n"])

    counts = rows.where(draw < share).select("t", "l").mapInPandas(count, "l string, w binary, n long").groupBy("l", "w").agg(F.sum("n")).collect()
    langs, p = learn([(r[0], bytes(r[1]), r[2]) for r in sorted(counts)], path)
    return langs, p, np.log(np.array([sizes[x][1] for x in langs], dtype=float) / sum(n for _, n in sizes.values()))


class Scorer:
    """Scores texts; words once seen are remembered."""

    def __init__(self, langs: list[str], p: np.ndarray, prior: np.ndarray, path: str):
        self.langs, self.p, self.prior, self.lat = langs, p, prior, lattice(path)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.logs = np.zeros((1 << 14, len(self.langs)))

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        while n + len(words) > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        for at, rows in by_length(words, self.lat.widest):
            self.logs[n + at] = self.lat.forward(rows, self.p)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        group: list[str | None] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size > 3_000_000:
                out += self._some(group)
                group, size = [], 0
        return out + self._some(group)

    def _some(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_in(t) if t and self.langs and any(map(str.isalpha, t)) else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if not flat:
            return [("und", 0.0)] * len(texts)
        if len(self.known) > REMEMBER:
            self._clear()
        if new := set(flat).difference(self.known):
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.logs[at], axis=0)])
        ends = np.cumsum([len(ws) for ws in words])
        post = total[ends] - total[np.concatenate([[0], ends[:-1]])] + self.prior
        best = post.argmax(1)
        with np.errstate(under="ignore"):
            sure = 1 / np.exp(post - post.max(1, keepdims=True)).sum(1)
        return [(self.langs[b], float(s)) if ws else ("und", 0.0) for ws, b, s in zip(words, best, sure, strict=True)]


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; ``lang_col`` serves for learning only."""
    path = vocabulary or default_vocabulary()
    langs, p, prior = train(docs, id_col, text_col, lang_col, path, sample_bytes)
    shared = docs.sparkSession.sparkContext.broadcast((langs, p, prior))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value, path)
        for texts in batches:
            yield pd.DataFrame(scorer([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score"])

    rows = docs.select(col(id_col).alias("doc_id"), run.asNondeterministic()(col(text_col)).alias("f"))
    return rows.select("doc_id", (_remainder(F.col("doc_id")) == 0).alias("held_out"), "f.lang_pred", "f.score")


def query(spark, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
