"""Problem 7: evaluation texts inside a training corpus.

Method: latent semantic retrieval. Passages of both sides become TF-IDF vectors over hashed words; a randomised SVD,
whose sketch is summed over all passages of the corpus, gives a small basis; passages near to a passage of an item by
cosine are candidates; the longest common subsequence of words, by alignment in one or two parts, and a check that the
item's own rare words are among those repeated, decide.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import cut

#: Hashed vocabulary, columns of the sketch, dimensions kept. All fixed, so what reaches the driver doesn't grow.
BUCKETS, SKETCH, DIMENSIONS = 8192, 128, 96
#: A passage has two blocks of this many words and starts at every block.
BLOCK = 12
#: Cosine from which a pair of passages is a candidate; share of an item's words that must be repeated.
NEAR, SHARE = 0.62, 0.5
#: Share of an item's rarer half of words that must stand in the parts: templates filled with other words are no case.
ANSWERED = 0.3
#: Cells of an alignment held at once, and words of an item at most, so that an alignment fits a task and its bits.
CELLS, MOST_WORDS = 1_000_000, 4_000
#: Buckets whose sums travel together; each block is summed in a task of its own.
TOGETHER = 256
#: Items are searched in blocks of so many; more items than this are refused, as they are held on the driver.
ITEM_BLOCK, MOST_ITEMS = 4000, 200_000
WORD = re.compile(r"[^\W_]+")
#: Marks that are no part of a word's form: joiners, soft hyphens, direction marks, and apostrophes.
HIDDEN = re.compile("['’ʼ`\xad​-‏⁠‪-‮﻿̀-ͯ]")


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = i = zlib.crc32(word.encode("utf-8", "replace"))
        return i


IDS = _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """32-bit ids of the words of a text, whatever their case, marks, layout and character form."""
    if not text:
        return np.empty(0, np.uint32)
    text = text.replace("'", "") if text.isascii() else HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    return np.array([IDS[w] for w in WORD.findall(text.lower())], np.uint32)


def _read(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint32) if x.is_valid else np.empty(0, np.uint32) for x in batch.column(1)]


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts, each filled up to whole blocks by an empty bucket; number of blocks of each."""
    n = np.array([-(-len(t) // BLOCK) for t in texts], np.int64)
    flat = np.full(int(n.sum()) * BLOCK, BUCKETS, np.int32)
    at = 0
    for t, k in zip(texts, n):
        flat[at : at + len(t)] = t & (BUCKETS - 1)
        at += int(k) * BLOCK
    return flat.reshape(-1, BLOCK), n


def _slices(texts: list[np.ndarray], words: int = 60_000) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > words:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _doubles(blocks: np.ndarray) -> np.ndarray:
    """Blocks joined by twos, for statistics over passages that don't overlap."""
    if len(blocks) % 2:
        blocks = np.concatenate([blocks, np.full((1, BLOCK), BUCKETS, np.int32)])
    return blocks.reshape(-1, 2 * BLOCK)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        texts = _read(batch)
        for a, b in _slices(texts):
            rows = np.sort(_doubles(_padded(texts[a:b])[0]), axis=1)
            first = np.ones(rows.shape, bool)
            first[:, 1:] = rows[:, 1:] != rows[:, :-1]
            counts += np.bincount(rows[first], minlength=BUCKETS + 1)
            n += len(rows)
    counts[BUCKETS] = n
    there = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there], pa.int64())], names=["bucket", "n"])


def _sum_into(target: np.ndarray, index: np.ndarray, values: np.ndarray, owner: np.ndarray) -> None:
    """target[index] += values[owner], by one reduction over the sorted index."""
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    target[index[starts]] += np.add.reduceat(values[owner], starts, axis=0)


def _sketch_of(batches: Iterator[pa.RecordBatch], idf: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    weighted = np.zeros((BUCKETS + 1, SKETCH), np.float32)
    weighted[:BUCKETS] = _random(seed) * idf[:, None]
    total, idf0 = np.zeros((BUCKETS + 1, SKETCH), np.float32), np.append(idf, 0).astype(np.float32)
    for batch in batches:
        texts = _read(batch)
        for a, b in _slices(texts, 30_000):
            rows = _doubles(_padded(texts[a:b])[0])
            norm = 1 / np.maximum((idf0[rows] ** 2).sum(axis=1), 1e-9)
            projected = weighted[rows].sum(axis=1) * norm[:, None]
            _sum_into(total, rows.ravel(), projected, np.repeat(np.arange(len(rows)), rows.shape[1]))
    total = (total[:BUCKETS] * idf[:, None]).astype(np.float32).reshape(-1, TOGETHER * SKETCH)
    there = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([total[k].tobytes() for k in there], pa.binary())], names=["part", "total"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(x.as_buffer(), np.float32)
            sums[part] = sums[part] + one if part in sums else one.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "total"])


def _random(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, SKETCH)).astype(np.float32)


def _basis(sketch: np.ndarray, seed: int) -> np.ndarray:
    """Right singular vectors, each divided by its singular value, from the sketch of the Gram matrix (Nyström)."""
    test = _random(seed).astype(np.float64)
    shift = 1e-6 * np.linalg.norm(sketch) + 1e-12
    moved = sketch.astype(np.float64) + shift * test
    core = test.T @ moved
    core = (core + core.T) / 2 + 1e-9 * np.trace(core) / len(core) * np.eye(len(core))
    root = np.linalg.cholesky(core)
    u, s, _ = np.linalg.svd(np.linalg.solve(root, moved.T).T, full_matrices=False)
    s = s[:DIMENSIONS]
    return (u[:, :DIMENSIONS] / np.maximum(s, 1e-3 * s[0])).astype(np.float32)


@dataclass
class Space:
    """The latent space of a corpus: weighted basis, with a row of zeros for the empty bucket, and inverse frequencies."""

    weights: np.ndarray
    idf: np.ndarray

    def passages(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the passages of texts, and each passage's text."""
        blocks, n = _padded(texts)
        if not len(blocks):
            return np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.int64)
        sums = np.empty((len(blocks), DIMENSIONS), np.float32)
        for a in range(0, len(blocks), 2000):
            sums[a : a + 2000] = self.weights[blocks[a : a + 2000]].sum(axis=1)
        owner = np.repeat(np.arange(len(texts)), n)
        last = np.r_[owner[1:] != owner[:-1], True]
        vectors = sums.copy()
        vectors[:-1][~last[:-1]] += sums[1:][~last[:-1]]
        keep = ~last | np.r_[True, last[:-1]]  # a text of one block is one passage
        vectors, owner = vectors[keep], owner[keep]
        return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9), owner


class Item:
    """An item's words, where each of them stands, and which of them are its rarer half."""

    def __init__(self, key, ids: np.ndarray, idf: np.ndarray | None = None) -> None:
        self.key, self.ids, self.words = key, ids, ids.tolist()
        self.bits: dict[int, int] = {}
        for k, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << k
        worth = np.ones(len(ids)) if idf is None else idf[ids & (BUCKETS - 1)]
        self.rare = (worth > np.median(worth)) | (worth == worth.max()) if len(ids) else np.zeros(0, bool)


def lcs(item: Item, j0: int, j1: int, text: list[int]) -> int:
    """Length of the longest common subsequence of the item's words j0 to j1 and text (bit-parallel)."""
    full = (1 << (j1 - j0)) - 1
    row, bits = full, item.bits
    for w in filter(bits.__contains__, text):
        hit = row & (bits[w] >> j0)
        row = (row + hit | row - hit) & full
    return (j1 - j0) - row.bit_count()


#: Bits of a cell of an alignment: its gain, the part's equal words, its first place in the piece of text and in the item.
GAIN, WORDS, FIRST = 48, 35, 13
LOW, PLACE = (1 << 13) - 1, (1 << 22) - 1


def _ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word of the item and of a piece of text: the best part that ends there, as one number (see GAIN).

    A part is a local alignment: an equal word gains one, a word changed, left out or put in costs one, and a part
    starts anew where its gain would fall below none. Of parts of equal gain that of more words counts.
    """
    n, w = len(item), len(text)
    one, place = 1 << GAIN, np.arange(w, dtype=np.int64)
    slope, fresh = place << GAIN, (place + 1) << FIRST
    out, across = np.empty((n, w), np.int64), np.empty(w, np.int64)
    step: dict[int, np.ndarray] = {}
    above = place + 1 << FIRST
    for j, word in enumerate(item.tolist()):
        if word not in step:
            step[word] = np.where(text == word, one + (1 << WORDS), -one)
        row = out[j]
        across[0] = j  # a part that starts at the text's first word
        across[1:] = above[:-1]
        across += step[word]
        np.subtract(above, one, out=row)
        np.maximum(row, across, out=row)
        fresh += 1
        np.maximum(row, fresh, out=row)
        row += slope
        np.maximum.accumulate(row, out=row)  # words put in: a part goes on along the text
        row -= slope
        above = row
    return out


def repeated_share(item: Item, ids: np.ndarray, whole: list[int] | None = None, there: frozenset[int] | None = None) -> tuple[float, int]:
    """Share of an item's words that a text repeats in order, in its best one or two parts; and the number of parts.

    Parts are those of _ends; two parts follow each other in the item and in the text, however far apart. The share is 0
    where the words the text has at all, or the common subsequence of the whole text, bound it below SHARE, and
    if the parts hold less than ANSWERED of the item's rarer words. No part is left out: long texts are aligned in pieces
    that overlap by the longest part, and the best part so far is kept for every place of the item.
    """
    n, span = len(item.words), 2 * len(item.words)
    whole = ids.tolist() if whole is None else whole
    if sum(map((frozenset(whole) if there is None else there).__contains__, item.words)) < SHARE * n or lcs(item, 0, n, whole) < SHARE * n:
        return 0.0, 0
    step = max(span, min(CELLS // max(n, 1), 8000))
    best, found = 0, []
    before = np.zeros((n, 0), np.int64)  # best part up to each place of item and text: words, first and last place in the text
    for a in range(0, len(ids), step):
        low = max(0, a - span)
        cells = _ends(item.ids, ids[low : a + step])[:, a - low :]
        words, first, start = cells >> WORDS & LOW, (cells >> FIRST & PLACE) + low, cells & LOW
        last = np.arange(a + 1, a + 1 + cells.shape[1], dtype=np.int64)
        so_far = np.maximum.accumulate(np.maximum.accumulate(words << 50 | first << 25 | last, axis=0), axis=1)
        if before.shape[1]:
            so_far = np.maximum(so_far, before[:, -1:])
        before = np.concatenate([before, so_far], axis=1)
        left = a + cells.shape[1] - before.shape[1]  # place of the first column kept
        both = (start > 0) & (first > left) & (words > 0)
        total = words.copy()
        total[both] += before[start[both] - 1, first[both] - 1 - left] >> 50
        j, i = divmod(int(total.argmax()), cells.shape[1])
        if total[j, i] > best:
            best, found = int(total[j, i]), [(int(first[j, i]), a + i + 1)]
            if best > words[j, i]:
                part = int(before[start[j, i] - 1, first[j, i] - 1 - left])
                found.append((part >> 25 & (1 << 25) - 1, part & (1 << 25) - 1))
        before = before[:, -span:]
    held = Counter(w for i0, i1 in found for w in whole[i0:i1])
    answered = sum(min(k, held[w]) for w, k in Counter(item.ids[item.rare].tolist()).items())
    if not best or answered < ANSWERED * item.rare.sum():
        return 0.0, 0
    return best / n, len(found)


def _search(batches: Iterator[pa.RecordBatch], space: Space, items: list[Item]) -> Iterator[pa.RecordBatch]:
    wanted, owner = space.passages([x.ids for x in items])
    wanted = np.ascontiguousarray(wanted.T)
    for batch in batches:
        texts, at, found, shares, parts = _read(batch), [], [], [], []
        for a, b in _slices(texts, 30_000):
            vectors, text_of = space.passages(texts[a:b])
            near = vectors @ wanted >= NEAR
            rows, cols = np.divmod(np.flatnonzero(near), near.shape[1])
            pairs = np.unique(text_of[rows] * len(items) + owner[cols])
            last, there, whole = -1, frozenset(), []
            for t, k in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist()):
                if t != last:
                    last, whole = t, texts[a + t].tolist()
                    there = frozenset(whole)
                share, n = repeated_share(items[k], texts[a + t], whole, there)
                if share >= SHARE:
                    at.append(a + t)
                    found.append(items[k].key)
                    shares.append(share)
                    parts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64()), pa.array(shares, pa.float64()), pa.array(parts, pa.int32())], names=["_key", "item_id", "share", "n_parts"])


def corpus_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key and ids (the 32-bit word ids) of every row that has words, materialised once for the passes that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_ids(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["_key", "ids"])

    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where(F.col("_key").isNotNull() & (F.length("_text") > 0))
    kind = rows.schema["_key"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"_key {kind}, ids binary").where(F.length("ids") > 0))


def latent_space(words: DataFrame, seed: int = 7) -> Space:
    """The latent space of all passages of a corpus: two passes; what reaches the driver has a fixed size."""
    counts = words.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for r in counts:
        df[r["bucket"]] = r["n"]
    n, df = df[BUCKETS], df[:BUCKETS]
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1e-3, 0).astype(np.float32)
    blocks = BUCKETS // TOGETHER
    sums = words.mapInArrow(lambda it: _sketch_of(it, idf, seed), "part int, total binary").repartition(blocks, "part").mapInArrow(_add, "part int, total binary")
    total = np.zeros((blocks, TOGETHER * SKETCH), np.float32)
    for r in sums.collect():  # a fixed size: BUCKETS x SKETCH numbers
        total[r["part"]] = np.frombuffer(r["total"], np.float32)
    weights = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32)
    if n and total.any():
        weights[:BUCKETS] = _basis(total.reshape(BUCKETS, SKETCH), seed) * idf[:, None]
    return Space(weights, idf)


def leaked_items(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """key, item_id, share and n_parts of every corpus row that repeats at least SHARE of an item's words.

    All rows of the corpus are searched, in whole texts; the items are the stated query set, at most MOST_ITEMS, in
    blocks of ITEM_BLOCK, each of at most MOST_WORDS words. Null and empty texts on either side, and items of fewer than three words, match nothing.
    Several rows of the same key, and repeats of items, give a pair once, with its greatest share.
    """
    queries = {r[0]: r[1] for r in items.select(F.col(item_key).cast("long"), F.col(item_text).cast("string")).where(F.col(item_key).isNotNull()).limit(MOST_ITEMS + 1).collect()}
    if len(queries) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items")
    asked = [(k, x) for k, t in sorted(queries.items()) if len(x := word_ids(t)) > 2]
    if any(len(x) > MOST_WORDS for _, x in asked):
        raise ValueError(f"an item of more than {MOST_WORDS} words")
    words = corpus_words(corpus, key, text)
    space = latent_space(words)
    wanted = [Item(k, x, space.idf) for k, x in asked]
    kind = words.schema["_key"].dataType.simpleString()
    found = None
    for a in range(0, max(1, len(wanted)), ITEM_BLOCK):
        block = wanted[a : a + ITEM_BLOCK]
        part = words.mapInArrow(lambda it, block=block: _search(it, space, block) if block else iter(()), f"_key {kind}, item_id long, share double, n_parts int")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("_key", "item_id").agg(F.max(F.struct("share", "n_parts")).alias("best"))
    return best.select(F.col("_key").alias(key), "item_id", "best.share", "best.n_parts")
