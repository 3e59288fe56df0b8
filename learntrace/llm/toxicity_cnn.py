"""Toxicity: a convolutional text classifier, trained in numpy.

Words (lower-cased runs of letters and digits) are hashed to embeddings: a word's vector is the sum of those of
its number and of its prefixes of ``PREFIXES`` letters, so that an inflected word that training never saw is
known by its stem. Numbers seen in fewer than ``LEAST_DOCS`` training texts have no vector. Filters of widths 1, 2
and 3 run over the whole text; each filter's rectified maximum over the text feeds a logistic layer. Everything
starts at random and is trained by AdaGrad; a step sees a random half of a text's words (``KEEP``), for else the
maxima of the random start settle on words that say nothing. Because an embedding times a filter column depends
on the word alone, scoring keeps those products by word.

Thresholds are calibrated by language: the language is told from the text's own function words, and a language's
logits are shifted so that its best threshold on rows that the calibrating network did not see lies at 0.5.

The model is fitted on all labelled rows outside the held-out fold, each in every pass: they are dealt into shards by a hash
of the key, a task takes the steps of its shard from the common network, and after each pass the shards' networks are averaged, a
word's vector over the shards that moved it. Counts of words and thresholds come from all of these rows too; the driver holds
only the network (``BUCKETS`` vectors at most). Every document is then scored where it lies, whole.

Defined results: a null text counts as empty and gets the score of the bias; without labels of both classes every
score is their share (0.5 without any); repeated rows get repeated scores; texts that tie in a maximum take its
first place; an empty table gives an empty table; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learntrace.llm.common import small_side
from learntrace.llm.learning import fold, known_labels
from learntrace.session import cut, stored

FOLDS, HELD_OUT = 5, 0
SHARD_ROWS = 10_000  # the shards are as many as the root of the rows over this, so a shard has at least as many rows
BUFFER_ROWS, BUFFER_BYTES = 4096, 64 << 20  # encoded rows that a task holds at once, whichever is less
BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 7)
LEAST_DOCS = 3
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
EPOCHS, LEAST_EPOCHS, RATE, KEEP = 12, 2, 0.05, 0.5
EPOCH_ROWS = 120_000  # rows of all passes from which on fewer than EPOCHS passes are made, never below LEAST_EPOCHS
BATCH = 32
CUT = 0.5
KNOWN_WORDS = 200_000  # of a scoring task's cache, which is emptied when full
TEXTS, WORDS = 128, 1 << 17  # texts whose words are hashed together, and words from which on no text is added to them
LONG = 64  # bytes of a word from which on it is hashed alone
PIECE = 1 << 15  # words that are held at once in scoring
#: Function words that tell a language, each in one list only.
LANGUAGES = {
    "en": "the of and to in is that for it with was on are by this be".split(), "de": "der die und den von zu das mit sich ist nicht ein eine dem für".split(),
    "fr": "le les et des est une dans qui que pour sur pas du au".split(), "es": "el los y las por con para del se su al lo como".split(),
}
OTHER = len(LANGUAGES)
_CODES = {w: code for code, ws in enumerate(LANGUAGES.values()) for w in ws}
_WORD = re.compile(r"[^\W_]+")
_PREFIX = zlib.crc32(b"^")  # sets prefixes apart from words
_CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], dtype=np.uint32)  # what a byte adds to a sum


def words_of(text: str | None) -> tuple[list[str], Counter[str], int]:
    """The words of a whole text, how often each occurs and the code of its language (``OTHER``: none told)."""
    words = _split(text)
    return words, Counter(words), language_of(words)


def _split(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def language_of(words: list[str]) -> int:
    """The code of the language with the most function words among some words, of equals the first."""
    found = Counter(map(_CODES.get, filter(_CODES.__contains__, words)))
    hits = [found[code] for code in range(OTHER)]
    return hits.index(max(hits)) if any(hits) else OTHER


def parts_of(word: str) -> list[int]:
    """The hashed numbers of a word and its prefixes; -1 where it is no longer than a prefix."""
    out, at, crc = [zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)], 0, _PREFIX
    for k in PREFIXES:
        if len(word) <= k:
            return out + [-1] * (1 + len(PREFIXES) - len(out))
        crc, at = zlib.crc32(word[at:k].encode("utf-8", "replace"), crc), k
        out.append(crc & (BUCKETS - 1))
    return out


def parts_of_all(words: list[str]) -> np.ndarray:
    """``parts_of`` each of many words, a row a word: the same sums, of all words at once and byte after byte."""
    if not words:
        return np.empty((0, 1 + len(PREFIXES)), dtype=np.int32)
    raw = [w.encode("utf-8", "replace") for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes, letters = (np.fromiter(map(len, of), dtype=np.int64, count=len(words)) for of in (raw, words))
    starts, first = np.cumsum(sizes) - sizes, np.cumsum(letters) - letters
    leads = np.flatnonzero((data & 0xC0) != 0x80)  # where a letter begins

    def summed(sums: np.ndarray, rows: np.ndarray, at: np.ndarray, ends: np.ndarray) -> None:
        """The sums of some rows, taken on over the bytes from ``at`` to ``ends``."""
        while len(rows):
            old = sums[rows]
            sums[rows] = _CRC[(old ^ data[at]) & 0xFF] ^ (old >> 8)
            more = np.flatnonzero(at + 1 < ends)
            rows, at, ends = rows[more], at[more] + 1, ends[more]

    out = np.full((len(words), 1 + len(PREFIXES)), -1, dtype=np.int32)
    sums, rows = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32), np.flatnonzero(sizes < LONG)
    summed(sums, rows, starts[rows], (starts + sizes)[rows])
    out[:, 0] = (sums ^ 0xFFFFFFFF) & (BUCKETS - 1)
    for i in np.flatnonzero(sizes >= LONG):
        out[i, 0] = zlib.crc32(raw[i]) & (BUCKETS - 1)
    sums[:], at = _PREFIX ^ 0xFFFFFFFF, starts
    for column, k in enumerate(PREFIXES, 1):
        rows = np.flatnonzero(letters > k)
        ends = leads[first[rows] + k]
        summed(sums, rows, at[rows], ends)
        out[rows, column] = (sums[rows] ^ 0xFFFFFFFF) & (BUCKETS - 1)
        at = at.copy()
        at[rows] = ends
    return out


@dataclass
class Text:
    """A training text: its words as places in its own list of distinct words, and their parts."""

    ids: np.ndarray
    parts: np.ndarray  # distinct words x (1 + prefixes)


def encode(text: str | None) -> tuple[Text, int]:
    return next(encoded([text]))


def encoded(texts: list[str | None]) -> Iterator[tuple[Text, int]]:
    """The texts and their languages; a word that several of them share is hashed once."""
    split = [_split(t) for t in texts]
    found = [list(dict.fromkeys(words)) for words in split]
    place = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
    parts = parts_of_all(list(place))
    for words, own in zip(split, found, strict=True):
        at = dict(zip(own, range(len(own)), strict=True))
        ids = np.fromiter(map(at.__getitem__, words), dtype=np.int32, count=len(words))
        yield Text(ids, parts[np.fromiter(map(place.__getitem__, own), dtype=np.int64, count=len(own))]), language_of(words)


@dataclass
class Cnn:
    known: np.ndarray  # sorted numbers that have a vector; the row of the first is 1
    embedding: np.ndarray  # rows x DIM; row 0 stands for all other numbers and is zero
    filters: list[np.ndarray]  # of width w: w x DIM x FILTERS
    shifts: np.ndarray  # one a filter
    out: np.ndarray  # one weight a filter
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(OTHER + 1))
    places: np.ndarray | None = None  # of each number, made where it is needed

    def rows(self, parts: np.ndarray) -> np.ndarray:
        """The embedding rows of hashed numbers."""
        if self.places is None:
            self.places = np.zeros(BUCKETS + 1, dtype=np.int32)  # the last stands for -1
            self.places[self.known] = np.arange(1, len(self.known) + 1)
        return self.places[parts]

    def products(self, parts: np.ndarray) -> np.ndarray:
        """Words' vectors times the columns of all filters: a row a word, FILTERS for each place of each width."""
        columns = np.concatenate([f[k] for f in self.filters for k in range(len(f))], axis=1)
        return self.embedding[self.rows(parts)].sum(axis=1) @ columns

    def maps(self, own: np.ndarray, ids: np.ndarray, follows: list[np.ndarray]) -> list[np.ndarray]:
        """The filters' values at each place of texts, one after another, of words whose products are given;
        ``follows[k - 1]`` tells whether the word k places on is of the same text. Beyond a text's end stand zeros."""
        found, column, words = [], 0, np.take(own, ids, axis=0)
        for f in self.filters:
            z = words[:, column : column + FILTERS].copy() if len(f) > 1 else words[:, column : column + FILTERS]
            for k in range(1, len(f)):
                column += FILTERS
                if len(ids) > k:
                    z[:-k] += words[k:, column : column + FILTERS] * follows[k - 1]
            column += FILTERS
            found.append(z)
        return found

    def pooled(self, own: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over each text (none of them empty), before rectification, and its first place."""
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        of, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(ids))[:, None]
        values, places = [], []
        follows = [(of[k:] == of[:-k])[:, None] for k in range(1, max(WIDTHS))]
        for z in self.maps(own, ids, follows):
            top = np.maximum.reduceat(z, starts, axis=0)
            places.append(np.minimum.reduceat(np.where(z == top[of], place, len(ids)), starts, axis=0))
            values.append(top)
        return np.concatenate(values, axis=1) + self.shifts, np.concatenate(places, axis=1)

    def lines(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """``maps`` of one text, a row a filter, of its words' products in columns."""
        column = 0
        for f in self.filters:
            z = words[column : column + FILTERS].copy() if len(f) > 1 else words[column : column + FILTERS]
            for k in range(1, len(f)):
                column += FILTERS
                z[:, :-k] += words[column : column + FILTERS, k:]
            column += FILTERS
            yield z

    def logit(self, own: np.ndarray, ids: np.ndarray) -> float:
        """Of one text; a long one is read in pieces, each with the words that its last places reach."""
        if not len(ids):
            return float(self.bias)
        tops = []
        for at in range(0, len(ids), PIECE):
            words = np.ascontiguousarray(np.take(own, ids[at : at + PIECE + max(WIDTHS) - 1], axis=0).T)  # maxima run along rows
            tops.append(np.concatenate([z[:, :PIECE].max(axis=1) for z in self.lines(words)]))
        top = np.max(tops, axis=0)
        return float(np.maximum(top + self.shifts, 0) @ self.out + self.bias)

    def score(self, logit: float, language: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit - float(self.thresholds[language])))))


class _Optimizer:
    """AdaGrad: steps divided by the root of the squares so far."""

    def __init__(self, rate: float) -> None:
        self.rate, self.squares = rate, {}

    def step(self, name: str, values: np.ndarray, gradient: np.ndarray) -> None:
        seen = self.squares.setdefault(name, np.full(values.shape, 0.01, dtype=np.float32))
        seen += gradient * gradient
        values -= (self.rate * gradient / np.sqrt(seen)).astype(values.dtype)

    def step_rows(self, name: str, values: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        seen = self.squares.setdefault(name, np.full(len(values), 0.01, dtype=np.float32))
        seen[rows] += (gradient * gradient).sum(axis=1)
        values[rows] -= 4 * self.rate * gradient / np.sqrt(seen[rows])[:, None]


def _started(known: np.ndarray, share: float, seed: int) -> Cnn:
    """A network at its random start, or one that gives everything the share of the label where that is all there is to learn."""
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = Cnn(known, normal(0.1, len(known) + 1, DIM), [normal(0.3, w, DIM, FILTERS) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), normal(0.3, FILTERS * len(WIDTHS)), math.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    net.embedding[0] = 0
    if not 0 < share < 1:
        net.out[:] = 0
    return net


def _numbers(parts: np.ndarray) -> np.ndarray:
    """The distinct numbers of a text's words."""
    found = np.unique(parts)
    return found[found >= 0]


def _fit(texts: list[Text], labels: np.ndarray, epochs: int, seed: int) -> Cnn:
    """The network of a list of texts, in one place."""
    share, seen = float(labels.mean()) if len(labels) else 0.5, np.zeros(BUCKETS, dtype=np.int32)
    for t in texts:
        seen[_numbers(t.parts)] += 1
    net, optimizer, rng = _started(np.flatnonzero(seen >= LEAST_DOCS).astype(np.int32), share, seed), _Optimizer(RATE), np.random.default_rng([seed, 2])
    for _ in range(epochs if 0 < share < 1 else 0):
        _pass(net, optimizer, texts, labels, rng)
    return net


def _pass(net: Cnn, optimizer: _Optimizer, texts: list[Text], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Steps over all of some texts, in a random order."""
    order = rng.permutation(np.flatnonzero([len(t.ids) for t in texts]))
    for b in range(0, len(order), BATCH):
        own = order[b : b + BATCH]
        kept = [texts[i].ids[rng.random(len(texts[i].ids)) < KEEP] for i in own]
        kept = [k if len(k) else texts[i].ids for k, i in zip(kept, own, strict=True)]
        _step(net, optimizer, [net.rows(texts[i].parts) for i in own], kept, labels[own])


def _step(net: Cnn, optimizer: _Optimizer, rows: list[np.ndarray], texts: list[np.ndarray], labels: np.ndarray) -> None:
    """One step on the logistic loss. Only the words under a filter's maximum have a gradient."""
    sizes = np.array([len(t) for t in texts])
    firsts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
    used, ids = np.unique(np.concatenate([t + f for t, f in zip(texts, firsts, strict=True)]), return_inverse=True)
    own = np.concatenate(rows)[used]  # embedding rows of the batch's words
    vectors = net.embedding[own].sum(axis=1)
    columns = np.concatenate([f[k] for f in net.filters for k in range(len(f))], axis=1)
    raw, places = net.pooled(vectors @ columns, ids, sizes)
    h = np.maximum(raw, 0)
    g = ((1 / (1 + np.exp(-np.clip(h @ net.out + net.bias, -30, 30))) - labels) / len(texts)).astype(np.float32)
    slope = g[:, None] * net.out[None, :] * (raw > 0)  # of each text's maxima
    ends = np.cumsum(sizes)[:, None]
    dv = np.zeros_like(vectors)
    for w, f in enumerate(net.filters):
        s, at = slope[:, w * FILTERS : (w + 1) * FILTERS], places[:, w * FILTERS : (w + 1) * FILTERS]
        df = np.zeros_like(f)
        for k in range(len(f)):
            inside = (at + k < ends).astype(np.float32) * s
            word = ids[np.minimum(at + k, len(ids) - 1)]
            df[k] = np.einsum("nc,ncd->dc", inside, vectors[word])
            np.add.at(dv, word.ravel(), (inside[:, :, None] * f[k].T[None]).reshape(-1, DIM))
        optimizer.step(f"filters{w}", f, df)
    optimizer.step("shifts", net.shifts, slope.sum(axis=0))
    optimizer.step("out", net.out, h.T @ g)
    net.bias -= optimizer.rate * float(g.sum())
    live = np.flatnonzero(np.abs(dv).sum(axis=1))
    at, to = own[live].ravel(), np.repeat(dv[live], own.shape[1], axis=0)
    rows_, back = np.unique(at[at > 0], return_inverse=True)
    total = np.zeros((len(rows_), DIM), dtype=np.float32)
    np.add.at(total, back, to[at > 0])
    optimizer.step_rows("embedding", net.embedding, rows_, total)


def calibrated(z: np.ndarray, languages: np.ndarray, rows: np.ndarray, hits: np.ndarray, least: int = 15, beta: float = 1.0) -> np.ndarray:
    """A threshold of the logit for each language: that of the best F-beta among the language's rows, or all
    rows' where a language has few of a class. ``rows`` and ``hits`` count a logit's rows, and those of label 1."""
    def best(own: np.ndarray) -> float:
        zs, back = np.unique(-z[own], return_inverse=True)
        zs, found = -zs, np.cumsum(np.bincount(back, hits[own]))
        score = (1 + beta * beta) * found / (np.cumsum(np.bincount(back, rows[own])) + beta * beta * hits[own].sum())
        k = int(np.flatnonzero(score >= score.max())[-1])
        return float(zs[k] + zs[min(k + 1, len(zs) - 1)]) / 2

    out = np.full(OTHER + 1, best(np.arange(len(z))))
    for code in range(OTHER + 1):
        own = np.flatnonzero(languages == code)
        if min(hits[own].sum(), rows[own].sum() - hits[own].sum()) >= least:
            out[code] = best(own)
    return out


def _kind(words: int) -> str:
    """Of the places of a text's words."""
    return "<u2" if words <= 1 << 16 else "<i4"


ENCODED = "shard int, apart boolean, label int, language int, words int, bytes int, packed binary"


def _unpacked(packed: pa.Buffer, size: int, words: int) -> Text:
    raw, kind = pa.decompress(packed, size, "zstd"), np.dtype(_kind(words))
    parts = np.frombuffer(raw, "<i4", offset=words * kind.itemsize) if words else np.empty(0, dtype=np.int32)
    return Text(np.frombuffer(raw, kind, words).astype(np.int32), parts.reshape(-1, 1 + len(PREFIXES)))


def _rows(batch: pa.RecordBatch, keep: Callable[[bool], bool] = lambda apart: True) -> Iterator[tuple[Text, bool, int, int]]:
    """Text, whether it is kept for the thresholds, label and language of the rows that ``keep`` wants, unpacked one by one."""
    columns = [batch.column(c).to_pylist() for c in ("bytes", "words", "apart", "label", "language")]
    for packed, size, words, apart, label, language in zip(batch.column("packed"), *columns, strict=True):
        if keep(apart):
            yield _unpacked(packed.as_buffer(), size, words), apart, label, language


def _together(texts: Iterator[str | None]) -> Iterator[list[str | None]]:
    """Texts whose words are hashed together."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if len(held) == TEXTS or size >= 8 * WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with their texts encoded, packed a few at a time."""
    at = 0
    for some in _together(t.as_py() for t in batch.column("_text")):
        own, rows = [], batch.slice(at, len(some))
        at += len(some)
        for t, language in encoded(some):
            raw = t.ids.astype(_kind(len(t.ids))).tobytes() + t.parts.astype("<i4").tobytes()
            own.append((language, len(t.ids), len(raw), pa.compress(raw, "zstd", asbytes=True)))
        made = [pa.array([o[i] for o in own], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("shard", "apart", "label")], *made], names=[c.split()[0] for c in ENCODED.split(", ")])


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> tuple[DataFrame, int]:
    """All labelled rows that training may see, encoded, a shard a partition, and how many labels there are.

    A label counts once, with the text of the smallest hash among the rows that share its id: equal keys lie side by side in
    a shard, and the first stays. A quarter of the keys is kept apart for the thresholds."""
    known = stored(known_labels(labels, label, FOLDS, HELD_OUT, key))
    n = known.count()
    shards = max(1, math.ceil(math.sqrt(n / SHARD_ROWS)))
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(small_side(known), F.col("_k") == F.col("_key"))
    drawn = F.xxhash64("_key")
    placed = rows.select(F.pmod(drawn, F.lit(shards)).cast("int").alias("shard"), (F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(4)) == 0).alias("apart"), drawn.alias("at"), F.col("_key").cast("string").alias("key"), F.xxhash64("_text").alias("h"), "label", "_text")
    dealt = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("at", "key", "h")  # texts, for they are shorter than what is made of them

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            kept = [k != b for k, b in zip(keys, [before, *keys[:-1]], strict=True)]
            before = keys[-1] if keys else before
            yield from _packed(batch.filter(pa.array(kept, pa.bool_())))

    return cut(dealt.mapInArrow(first, ENCODED)), n


def _vocabularies(rows: DataFrame) -> list[np.ndarray]:
    """The numbers that enough texts hold: of all rows, and of those that are not kept apart."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            for t, apart, _, _ in _rows(batch):
                own = _numbers(t.parts)
                for seen in n[: 1 if apart else 2]:
                    seen[own] += 1
        own = np.flatnonzero(n[0])
        for at in range(0, len(own), 1 << 16):
            some = own[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0][some].astype(np.int64)), pa.array(n[1][some].astype(np.int64))], names=["number", "n0", "n1"])

    found = rows.mapInArrow(counted, "number int, n0 long, n1 long").groupBy("number").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") >= LEAST_DOCS)
    table = found.toArrow()  # BUCKETS rows at most
    number = table.column("number").to_numpy()
    return [np.sort(number[table.column(c).to_numpy() >= LEAST_DOCS]).astype(np.int32) for c in ("n0", "n1")]


DENSE = [f"filters{i}" for i in range(len(WIDTHS))] + ["shifts", "out"]
MOVED = [f"v{i}" for i in range(DIM)]
MOVES = f"net int, row int, {', '.join(f'{c} float' for c in MOVED)}, square float"


def _dense(net: Cnn, optimizer: _Optimizer) -> np.ndarray:
    """All values but the embedding and their squares, DIM a row."""
    values = [*net.filters, net.shifts, net.out]
    flat = np.concatenate([*[v.ravel() for v in values], [net.bias], *[optimizer.squares.get(n, np.full(v.shape, 0.01)).ravel() for n, v in zip(DENSE, values, strict=True)]])
    return np.pad(flat, (0, -len(flat) % DIM)).astype(np.float32).reshape(-1, DIM)


def _set_dense(net: Cnn, optimizer: _Optimizer, rows: np.ndarray) -> None:
    flat, at = rows.ravel().astype(np.float32), 0
    values = [*net.filters, net.shifts, net.out]
    for v in values:
        v[...] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    net.bias, at = float(flat[at]), at + 1
    for n, v in zip(DENSE, values, strict=True):
        optimizer.squares[n] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size


def _copied(net: Cnn, optimizer: _Optimizer) -> tuple[Cnn, _Optimizer]:
    """A network of one's own: broadcast values are shared by the tasks of a worker."""
    own, mine = Cnn(net.known, net.embedding.copy(), [f.copy() for f in net.filters], net.shifts.copy(), net.out.copy(), net.bias), _Optimizer(optimizer.rate)
    mine.squares = {n: s.copy() for n, s in optimizer.squares.items()}
    return own, mine


def _moves(rows: DataFrame, shared: Broadcast, number: int, epoch: int, seed: int) -> DataFrame:
    """What a pass of each shard makes of network ``number``: the dense values as negative rows, and the vectors that it moved."""
    def sent(at: np.ndarray, values: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(at), number, dtype=np.int32), at.astype(np.int32), *np.ascontiguousarray(values.T), squares]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["net", "row", *MOVED, "square"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, optimizer = _copied(*shared.value)
        before = shared.value[1].squares["embedding"]
        held: list[tuple[Text, int]] = []
        size, steps, rng = 0, 0, None
        for batch in batches:
            rng = np.random.default_rng([seed, number, epoch, batch.column("shard")[0].as_py()]) if rng is None and batch.num_rows else rng
            for t, _, label, _ in _rows(batch, lambda apart: not (number and apart)):
                held.append((t, label))
                size += t.ids.nbytes + t.parts.nbytes
                if len(held) == BUFFER_ROWS or size >= BUFFER_BYTES:
                    _pass(net, optimizer, [h[0] for h in held], np.array([h[1] for h in held], dtype=float), rng)
                    held, size, steps = [], 0, steps + 1
        if held:
            _pass(net, optimizer, [h[0] for h in held], np.array([h[1] for h in held], dtype=float), rng)
        if not held and not steps:
            return
        held = []
        dense, squares = _dense(net, optimizer), optimizer.squares["embedding"]
        yield sent(-1 - np.arange(len(dense)), dense, np.zeros(len(dense), dtype=np.float32))
        own = np.flatnonzero(squares != before)
        for a in range(0, len(own), 1 << 16):
            some = own[a : a + (1 << 16)]
            yield sent(some, net.embedding[some], squares[some])

    return rows.mapInArrow(run, MOVES)


def fitted(rows: DataFrame, n: int, seed: int = 42) -> Cnn:
    """The network of all encoded rows, with thresholds from the rows kept apart by a network that did not see them:
    logits of rows that a network was fitted on are too sure."""
    told = {r["apart"]: (r["n"], r["hits"]) for r in rows.groupBy("apart").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()}
    counts = [tuple(map(sum, zip((0, 0), *told.values(), strict=True))), told.get(False, (0, 0))]
    both = lambda c: 0 < c[1] < c[0]
    nets = [_started(known, c[1] / c[0] if c[0] else 0.5, seed) for known, c in zip(_vocabularies(rows), counts, strict=True)]
    if not both(counts[0]):
        return nets[0]
    used = [0, 1] if both(counts[1]) and both(told.get(True, (0, 0))) else [0]
    states = [(net, _Optimizer(RATE)) for net in nets]
    for net, optimizer in states:
        optimizer.squares["embedding"] = np.full(len(net.embedding), 0.01, dtype=np.float32)
    context = rows.sparkSession.sparkContext
    for epoch in range(max(LEAST_EPOCHS, min(EPOCHS, -(-EPOCH_ROWS // max(1, n))))):
        shared = [context.broadcast(states[i]) for i in used]  # one each, for a task needs one
        moves = reduce(DataFrame.union, [_moves(rows, b, i, epoch, seed) for i, b in zip(used, shared, strict=True)])
        table = moves.groupBy("net", "row").agg(*[F.avg(c).cast("float").alias(c) for c in [*MOVED, "square"]]).toArrow()  # the networks
        of, at = table.column("net").to_numpy(), table.column("row").to_numpy()
        for i in used:
            net, optimizer = states[i]
            own, dense = np.flatnonzero((of == i) & (at >= 0)), np.flatnonzero((of == i) & (at < 0))
            dense = dense[np.argsort(-at[dense])]
            _set_dense(net, optimizer, np.column_stack([table.column(c).to_numpy()[dense] for c in MOVED]))
            for k, c in enumerate(MOVED):
                net.embedding[at[own], k] = table.column(c).to_numpy()[own]
            optimizer.squares["embedding"][at[own]] = table.column("square").to_numpy()[own]
        for b in shared:
            b.destroy()
    if len(used) > 1:
        nets[0].thresholds = _thresholds(rows, nets[1])
    return nets[0]


def _thresholds(rows: DataFrame, net: Cnn) -> np.ndarray:
    """Of the rows kept apart; logits are counted to three digits, so that the driver gets a bounded table of all of them."""
    shared = rows.sparkSession.sparkContext.broadcast((net.known, net.embedding, net.filters, net.shifts, net.out, net.bias))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cnn(*shared.value)
        for batch in batches:
            found = [(language, label, round(1000 * max(-30.0, min(30.0, own.logit(own.products(t.parts), t.ids))))) for t, _, label, language in _rows(batch, bool)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in range(3)], names=["language", "label", "z"])

    table = rows.mapInArrow(told, "language int, label int, z int").groupBy("language", "z").agg(F.count("*").alias("n"), F.sum("label").alias("hits")).toArrow()
    return calibrated(table.column("z").to_numpy() / 1000, *[table.column(c).to_numpy() for c in ("language", "n", "hits")])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Cnn:
    return fitted(*training_rows(docs, labels, text, label, key))


class _Scorer(dict):
    """Scores texts with a cache of the words' products; the words are numbered here as they come."""

    def __init__(self, net: Cnn) -> None:
        super().__init__()
        self.net, self.new, self.table = net, [], np.empty((KNOWN_WORDS, FILTERS * sum(WIDTHS)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def scores(self, texts: Iterator[str | None]) -> Iterator[float]:
        for some in _together(texts):
            if len(self) >= KNOWN_WORDS:
                self.clear()
            held = []
            for t in some:
                words = _split(t)
                held.append((np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words)), language_of(words)))
            self._fill()
            for ids, language in held:
                yield self.net.score(self.net.logit(self.table, ids), language)

    def _fill(self) -> None:
        at, need = len(self) - len(self.new), len(self)
        if need > len(self.table):
            self.table = np.concatenate([self.table[:at], np.empty((need - at + KNOWN_WORDS // 8, self.table.shape[1]), dtype=np.float32)])
        for a in range(at, need, PIECE):
            self.table[a : min(need, a + PIECE)] = self.net.products(parts_of_all(self.new[a - at : a - at + PIECE]))
        self.new.clear()


def scored(docs: DataFrame, net: Cnn, text: str = "text", out: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((net.known, net.embedding, net.filters, net.shifts, net.out, net.bias, net.thresholds))
    made: list[_Scorer] = []

    def score(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(_Scorer(Cnn(*shared.value)))
        return pd.Series(list(made[0].scores(iter(texts))), dtype=float)

    return docs.withColumn(out, F.pandas_udf(score, T.DoubleType())(F.col(text)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    held: Column = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    df = scored(docs.select("doc_id", "text"), train(docs, labels))
    return df.select("doc_id", held, "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
