"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (A-Z lower-cased, ASCII punctuation removed); a character of a script without blanks
(UNSPACED) is a word of its own. A CGK walk reads a sequence from a start:
step j writes the word under the pointer and moves on by a random bit that depends on j and that word. Two
sequences that are a few edits apart fall back into step, so small edit distance becomes small Hamming distance of
what was written. One hash of the LSH takes the written words at SAMPLES sampled steps; it is repeated with fresh walks
and samples until the target recall is reached.

Walks start at every word of every document and, for the items, at the item's begin and at one and two thirds of it.
Steps are sampled in the length of the item (its length class). Walks are evaluated lazily: only starts whose first
sampled words occur for some item walk on, which gives the same matches as full embeddings. Matches are then verified
with exact edit distance between the item and the best-fitting stretch of the document near the match.

Items under MIN_WORDS words are too short for the walks: they are cut into one stretch more than edits are allowed, so
one of these occurs unchanged wherever the item does, and is met by its hash. This path misses nothing.

Items travel to the tasks in blocks of bounded size; every block is matched against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm import textkernel

#: Edits allowed, as a share of an item's words, and the fewest words of an item that is met by walks.
EDIT_SHARE, MIN_WORDS = 0.2, 8
#: With this many repetitions nearly all stretches within EDIT_SHARE are met (measured in the tests).
REPEATS = 10
#: Words that one hash samples from a walk: two near its begin, the others from its whole reach.
SAMPLES = 5
#: Lower ends of the length classes grow by half from MIN_WORDS.
CLASS_GROWTH = 1.5
#: Items, and bytes of their texts, in a block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
#: Share of a window's words up to which steps are sampled: a walk moves every second step on average.
REACH = 1.6
_FILTER_BITS = 20

_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False


#: First and last code points of scripts that part no words: Thai to Tibetan, Burmese, Khmer, kana and Han, Han
#: for compatibility, kana of half width, rare Han (fixed values).
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def _spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with a blank on each side of every character of UNSPACED."""
    lead = np.flatnonzero(raw >= 0xE0)
    if not len(lead):
        return raw, offsets
    low = lambda k: raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) & 0x3F
    long = raw[lead] >= 0xF0
    point = np.where(long, ((raw[lead].astype(np.int64) & 7) << 18) | (low(1) << 12) | (low(2) << 6) | low(3), ((raw[lead].astype(np.int64) & 15) << 12) | (low(1) << 6) | low(2))
    alone = np.zeros(len(lead), bool)
    for first, last in UNSPACED:
        alone |= (point >= first) & (point <= last)
    blanks = np.zeros(len(raw) + 1, np.int64)
    np.add.at(blanks, lead[alone], 1)
    np.add.at(blanks, np.minimum(lead[alone] + 3 + long[alone], len(raw)), 1)
    shift = np.cumsum(blanks)
    out = np.full(len(raw) + int(shift[-1]), 32, np.uint8)
    out[np.arange(len(raw)) + shift[:-1]] = raw
    return out, offsets + np.concatenate([[0], shift])[offsets]


def word_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words of each row) for pieces of a column, punctuation removed."""
    for at, _, raw, offsets in textkernel.pieces(column):
        raw, offsets = _spaced(raw, offsets)
        keep = _PUNCTUATION[raw]
        places = np.concatenate([[0], np.cumsum(keep)])[offsets]
        hashes, _, _, counts = textkernel.words(raw[keep], places)
        yield at, hashes, counts


def _walk(words: np.ndarray, bits: np.ndarray, pointer: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Pointers after steps begin..end-1; bits: one 64-bit word of random bits for each word of the text."""
    for j in range(begin, end):
        mine = bits[pointer]
        if j >= 64:
            mine = textkernel.mix64(mine + np.uint64(j >> 6))
        pointer = pointer + ((mine >> np.uint64(j & 63)) & np.uint64(1)).astype(pointer.dtype)
    return pointer


def _classes(longest: int) -> list[int]:
    out = [MIN_WORDS]
    while out[-1] * CLASS_GROWTH <= longest:
        out.append(int(out[-1] * CLASS_GROWTH))
    return out


@dataclass
class _Repeat:
    seed: np.uint64
    first: int
    second: int
    later: list[tuple[int, int]]  # (step, length class) of the other samples, ascending
    one: np.ndarray  # filters of the first word and of the first two
    two: np.ndarray
    keys: np.ndarray  # ascending, with the anchor of each
    anchors: np.ndarray


def _slot(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textkernel.mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every stretch of n words."""
    count = max(len(words) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = _join(out, words[k : k + count])
    return out


class ItemIndex:
    """LSH tables of one block of items, and the stretches of the short ones."""

    def __init__(self, ids: list, texts: list[str], repeats: int = REPEATS, seed: int = 1, share: float = EDIT_SHARE):
        column = pa.array(texts, pa.large_string())
        self.ids: list = []
        self.items: list[np.ndarray] = []
        for at, hashes, counts in word_rows(column):
            for i, words in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
                if len(words):
                    self.ids.append(ids[at + i])
                    self.items.append(words)
        longest = max(map(len, self.items), default=0)
        self.longest = longest
        self.n_classes = len(_classes(longest))
        lows = _classes(longest)
        pad = np.zeros(2 * longest + 2, np.uint64)
        flat, anchors = [], []
        place = 0
        stretches: dict[int, list[tuple[int, int, int]]] = {}  # by length: hash, item, offset
        for i, words in enumerate(self.items):
            if len(words) < MIN_WORDS:
                parts = min(int(share * len(words)) + 1, len(words))
                cuts = [len(words) * k // parts for k in range(parts + 1)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    stretches.setdefault(high - low, []).append((int(_grams(words[low:high], high - low)[0]), i, low))
                continue
            for offset in sorted({0, len(words) // 3, 2 * len(words) // 3}):
                if offset == 0 or len(words) - offset >= MIN_WORDS:
                    size = len(words) - offset
                    anchors.append((i, offset, place + offset, max(c for c, low in enumerate(lows) if low <= size)))
            flat += [words, pad]
            place += len(words) + len(pad)
        self.stretches = {n: (np.array([h for h, _, _ in v], np.uint64), np.array([x[1:] for x in v], np.int64)) for n, v in ((n, sorted(v)) for n, v in stretches.items())}
        self.anchors = np.array(anchors, np.int64).reshape(-1, 4)
        text = np.concatenate(flat) if flat else np.zeros(1, np.uint64)
        rng = np.random.RandomState(seed)
        self.repeats = [self._repeat(text, lows, rng) for _ in range(repeats)] if len(self.anchors) else []

    def _repeat(self, text: np.ndarray, lows: list[int], rng: np.random.RandomState) -> _Repeat:
        seed = np.uint64(rng.randint(1, 1 << 62))
        reach = [max(3, int(low * REACH)) for low in lows]
        first = int(rng.randint(0, reach[0] // 2))
        second = int(rng.randint(first + 1, reach[0] - 1))
        later = sorted((int(step), c) for c, r in enumerate(reach) for step in rng.choice(np.arange(second + 1, max(r, second + SAMPLES)), SAMPLES - 2, replace=False))
        bits = textkernel.mix64(text ^ seed)
        pointer = _walk(text, bits, self.anchors[:, 2], 0, first)
        one = text[pointer]
        pointer = _walk(text, bits, pointer, first, second)
        two = _join(one, text[pointer])
        keys, at = two + self.anchors[:, 3].astype(np.uint64), second
        for step, c in later:
            pointer, at = _walk(text, bits, pointer, at, step), step
            mine = self.anchors[:, 3] == c
            keys[mine] = _join(keys[mine], text[pointer[mine]])
        filters = np.zeros((2, 1 << _FILTER_BITS), bool)
        filters[0, _slot(one)] = True
        filters[1, _slot(two)] = True
        order = np.argsort(keys, kind="stable")
        return _Repeat(seed, first, second, later, *filters, keys[order], order)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched word, start word of the whole item as seen from there, item) of all matches in a text of many rows.

        The start may lie before the row of the matched word: a row may open with an item whose first words are missing.
        """
        text = np.concatenate([words, np.zeros(2 * self.longest + 2, np.uint64)])
        met, begins, items = [], [], []
        for n, (hashes, owners) in self.stretches.items():
            key = _grams(words, n)
            low, high = np.searchsorted(hashes, key, "left"), np.searchsorted(hashes, key, "right")
            hit = np.flatnonzero(high > low)
            many = (high - low)[hit]
            which = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            met.append(np.repeat(hit, many))
            begins.append(met[-1] - owners[which, 1])
            items.append(owners[which, 0])
        for r in self.repeats:
            bits = textkernel.mix64(text ^ r.seed)
            start = np.arange(len(words), dtype=np.int64)
            pointer = _walk(text, bits, start, 0, r.first)
            one = text[pointer]
            live = np.flatnonzero(r.one[_slot(one)])
            start, one, pointer = start[live], one[live], pointer[live]
            pointer = _walk(text, bits, pointer, r.first, r.second)
            two = _join(one, text[pointer])
            live = np.flatnonzero(r.two[_slot(two)])
            start, two, pointer = start[live], two[live], pointer[live]
            keys, at = [two + np.uint64(c) for c in range(self.n_classes)], r.second
            for step, c in r.later:
                pointer, at = _walk(text, bits, pointer, at, step), step
                keys[c] = _join(keys[c], text[pointer])
            for key in keys:
                low, high = np.searchsorted(r.keys, key, "left"), np.searchsorted(r.keys, key, "right")
                hit = np.flatnonzero(high > low)
                n = (high - low)[hit]
                which = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor = self.anchors[r.anchors[which]]
                met.append(np.repeat(start[hit], n))
                begins.append(met[-1] - anchor[:, 1])
                items.append(anchor[:, 0])
        if not begins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(met), np.concatenate(begins), np.concatenate(items)


def fit_distance(item: np.ndarray, stretch: np.ndarray, most: int) -> tuple[int, int]:
    """Least edit distance between the item and any part of the stretch, and where the part ends; most + 1 if larger."""
    near = set(stretch.tolist())
    if sum(word not in near for word in item.tolist()) > most:  # words that are nowhere near must be edited
        return most + 1, -1
    steps = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (stretch != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1, -1
    return int(row.min()), int(row.argmin())


def _found(index: ItemIndex, share: float, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, int, int, int]]]]:
    """(first row, last row + 1, hits) for pieces of a column; a hit: row, item, distance, words of the item, end word."""
    size = np.array([len(x) for x in index.items], np.int64)
    for at, words, counts in word_rows(column):
        ends = np.cumsum(counts)
        met, begin, item = index.candidates(words)
        row = np.searchsorted(ends, met, side="right")
        begin = np.maximum(begin, (ends - counts)[row])
        # One look for each row, item and half an item of text covers all matches there.
        tries = np.unique(np.stack([row, item, begin // np.maximum(size[item] // 2, 1)], axis=1), axis=0)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, i, half in tries.tolist():
            words_i = index.items[i]
            most = int(share * len(words_i))
            low = max(int(ends[r] - counts[r]), half * max(len(words_i) // 2, 1) - most)
            high = min(int(ends[r]), (half + 1) * max(len(words_i) // 2, 1) + len(words_i) + most)
            d, end = fit_distance(words_i, words[low:high], most)
            if d <= most and (d, low + end) < best.get((r, i), (most + 1, 0)):
                best[r, i] = d, low + end
        yield at, at + len(counts), [(at + r, i, d, len(index.items[i]), end - int(ends[r] - counts[r])) for (r, i), (d, end) in sorted(best.items())]


def _match(index: ItemIndex, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [hit for _, _, some in _found(index, share, batch.column(1)) for hit in some]
            rows, items, distances, lengths, places = (pa.array([hit[k] for hit in hits], pa.int64()) for k in range(5))
            ids = pa.array([index.ids[i] for i in items.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), ids, distances, lengths, places], names=["doc_id", "item_id", "distance", "item_words", "end_word"])

    return run


def _clean(index: ItemIndex, share: float):
    """Rows (row, has id) that hold no item; rows without an id stay. They leave in pieces, so no batch is there twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = ~batch.column(1).to_numpy(zero_copy_only=False)
            for at, to, hits in _found(index, share, batch.column(0).field("text")):
                clean = np.ones(to - at, bool)
                clean[[hit[0] - at for hit in hits]] = False
                yield batch.slice(at, to - at).filter(pa.array(clean | keep[at:to]))

    return run


def _blocks(benchmark: DataFrame, share: float, repeats: int) -> Iterator[ItemIndex]:
    """The items, a stated query set, in blocks of bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        yield ItemIndex([r.item_id for r in rows], [r.text for r in rows], repeats, share=share)


def leaks(docs: DataFrame, benchmark: DataFrame, *, share: float = EDIT_SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, item_id, distance, item_words, end_word: the documents that hold a stretch of text within
    share * words edits (of words) of an item, with the best stretch's distance and the word where it ends.

    Items of any length count, so an item of one word is held by every document with that word; items without
    words (null and empty ones too) match nothing; null and empty documents hold nothing; items without an id are left out. Rows that repeat a doc_id or an item_id match each on
    their own. A row of the result stands for one document row and item; an empty table gives an empty result.
    """
    schema = "doc_id long, item_id long, distance long, item_words long, end_word long"
    out = None
    for index in _blocks(benchmark, share, repeats):
        found = docs.select("doc_id", "text").mapInArrow(_match(index, share), schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; rows without an id stay.

    Each row is judged by its own text, also where rows share a doc_id. Documents are read once: they pass the blocks of
    items one after another, and what a block finds goes at once.
    """
    share, repeats = options.get("share", EDIT_SHARE), options.get("repeats", REPEATS)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").isNotNull().alias("has_id"))
    for index in _blocks(benchmark, share, repeats):
        rows = rows.mapInArrow(_clean(index, share), rows.schema)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
