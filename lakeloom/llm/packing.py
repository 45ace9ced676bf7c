"""Filling containers of a fixed capacity with whole texts that have words in common.

Texts above a capacity are divided: all pieces but the last fill a container each, the last is an item like any whole text. The largest
items, as many as containers are needed for all tokens, are seeds and open a container each. Then, in rounds, every open container asks
a sharded BM25 index of the unused items for the neighbours of its seed that fit its room; an item goes to the container with room where it
scores best, and each container takes what it won, best first, wherever it fits. What is left after the rounds, and the containers still
open, are parted by a hash and packed by one task a part: neighbours of each seed first, again by BM25, then whatever fits, and last
the remaining items open containers of their own. A container is closed only when no unused item of its part fits. Every document is in the result.

**The index.** Items are placed in clusters by their most frequent words and, within a cluster, in bands of size; such a shard has an inverted
index of its own. A seed is sent to the shards that promise the best scores (the seed's affinity to the cluster, times the mean weight of
the shard's items), until these hold REACH times the square root of the number of unused items, and more for a seed of few words, which
says little of clusters. So time grows with n ** 1.5, not with the square of the corpus, and a seed's results are all of the best neighbours
but some. Clusters are fitted on a bounded sample of
SAMPLE texts; every item is indexed. Shards are searched in groups of about GROUP items: larger ones are cut by a hash, and a group
that many seeds ask is searched by several tasks, each for about BLOCK of them.

**Terms** are words under 32-bit hashes: of V different words about V ** 2 / 2 ** 33 pairs match each other, one pair of 90,000 words, a
thousandth of 10 million. Document frequencies, counted over all items, are in a vector of SKETCH entries, which keeps what tasks get
at 4 MB whatever the size of the corpus; words that share an entry share their frequency.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.sizes import char_start
from lakeloom.session import materialize, release

SKETCH = 1 << 20
SAMPLE, MOST_CLUSTERS, MOST_HEAVY = 8192, 512, 1024
BANDS, REACH, LEAST_REACH = 8, 16, 1024
FEW_WORDS, MOST_MORE = 128, 16  # a seed of fewer words reaches so many times as far as it has fewer, up to MOST_MORE times
GROUP, BLOCK, PART = 32_768, 16_384, 16_384
PAIRS, NEAR, RANGE, HITS = 1 << 22, 1 << 17, 512, 1 << 15  # scores that a search holds at a time, and finishes at a time; items whose postings lie together; words looked up at a time
FIRST, GIVEN, AHEAD = 256, 1 << 14, 32  # neighbours that are put in order at once; pairs between two looks at what is used; containers scored at once
NEIGHBOURS, ROUNDS = 64, 3
K1, B = 1.2, 0.75
MOST_TIMES = 32_767  # a word counts no oftener in a text; its weight changes by less than a ten thousandth beyond
#: Scripts written without blanks, in which each character is a word.
_ALONE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
#: The same for ASCII: its words in lower case, blanks between them.
_ASCII = bytes(ord(chr(c).lower()) if c < 128 and (chr(c).isalnum() or c == ord("_")) else ord(" ") for c in range(256))
_UTF8 = _ASCII[:128] + bytes(range(128, 256))  # other characters stay
PACKED = "limit_id int, container_id string, position int, doc_id long, piece_no int, pieces int, start_token long, n_tokens long, container_tokens long, unused long"
ITEMS = "limit_id int, doc_id long, piece_no int, pieces int, start_token long, n_tokens long, cluster int, fit float, length long, terms array<int>, tfs array<short>"
#: Words as bytes, which are sent and written faster than lists: places of frequent words in Space.heavy, other words' terms, and how often each stands in the text.
WORDS = {"heavy": np.uint16, "heavy_tfs": np.uint16, "rest": np.int32, "rest_tfs": np.uint16}
_KINDS = WORDS | {"units": np.int32}
COMPACT = ITEMS.replace("terms array<int>, tfs array<short>", ", ".join(f"{c} binary" for c in WORDS))
TAKEN = "limit_id int, doc_id long, container long, round int, rank int, n_tokens long"
_ITEMS = pa.schema([
    ("limit_id", pa.int32()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()),
    ("cluster", pa.int32()), ("fit", pa.float32()), ("length", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int16())),
])
_COMPACT = pa.schema([*list(_ITEMS)[:-2], *((c, pa.binary()) for c in WORDS)])
_TAKEN = pa.schema([("limit_id", pa.int32()), ("doc_id", pa.int64()), ("container", pa.int64()), ("round", pa.int32()), ("rank", pa.int32()), ("n_tokens", pa.int64())])
FOUND = "limit_id int, doc_id long, n_tokens long, seed long, score float"
_FOUND = pa.schema([("limit_id", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("seed", pa.int64()), ("score", pa.float32())])


def divide(data: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a text: each as large as the capacity allows without breaking a character."""
    out, at = [], 0
    while at < len(data):
        end = char_start(data, min(at + capacity, len(data)))
        if end <= at:  # one character is larger than the capacity
            end = min(at + capacity, len(data))
        out.append((at, end - at))
        at = end
    return out


def term_of(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little", signed=True)


def words_of(text: str) -> list[str]:
    return text.encode().translate(_ASCII).decode().split() if text.isascii() else WORD.findall(text.lower())


def _counted(text: str) -> Counter[str]:
    """How often each of words_of(text) stands there. Only what isn't ASCII between signs of ASCII needs the slower WORD."""
    if text.isascii():
        return Counter(words_of(text))
    found = Counter(text.lower().encode().translate(_UTF8).decode().split())
    found.update(WORD.findall(" ".join([x for x in found.copy() if not x.isascii() for _ in range(found.pop(x))])))
    return found


class _Terms(dict):
    """The terms of words that were asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = term = term_of(word)
        return term


# items


def _lists(t: pa.Table | pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    c = t[column]
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
        c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return np.concatenate([[0], np.cumsum(np.diff(c.offsets.to_numpy()))]), c.flatten().to_numpy(zero_copy_only=False)


def _bytes(t: pa.Table | pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The same of a column of bytes."""
    c = t[column]
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    wide = pa.types.is_large_binary(c.type)
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return (at - at[0]) // np.dtype(_KINDS[column]).itemsize, values.copy().view(_KINDS[column])


def _as_bytes(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Values, in the order of their rows, as a row of bytes each."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _words(t: pa.Table, space: Space, with_tfs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Offsets, terms and how often they stand there, by row of a table of WORDS."""
    (h_offsets, heavy), (r_offsets, rest) = _bytes(t, "heavy"), _bytes(t, "rest")
    row = np.concatenate([np.repeat(np.arange(t.num_rows), np.diff(o)) for o in (h_offsets, r_offsets)])
    order = np.argsort(row, kind="stable")
    tfs = np.concatenate([_bytes(t, "heavy_tfs")[1], _bytes(t, "rest_tfs")[1]])[order] if with_tfs else None
    return h_offsets + r_offsets, np.concatenate([space.heavy[heavy], rest])[order], tfs


def _matched(known: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms stand in a sorted array, and which of them do."""
    if not len(known):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    if len(terms) > len(known):
        at = pa.compute.index_in(pa.array(terms), pa.array(known)).fill_null(-1).to_numpy()
        return at, at >= 0
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return at, known[at] == terms


@dataclass
class Space:
    """Clusters of items by their frequent words: at most MOST_HEAVY words and MOST_CLUSTERS centres, fitted on a sample."""

    heavy: np.ndarray  # sorted
    idf: np.ndarray
    mean_length: float
    centres: np.ndarray

    @classmethod
    def fit(cls, sample: pa.Table, clusters: int) -> Space:
        offsets, terms = _lists(sample, "terms")
        n, rng = max(1, len(offsets) - 1), np.random.default_rng(0)
        known, count = np.unique(terms, return_counts=True)
        frequent = np.argsort(-count, kind="stable")[:MOST_HEAVY]
        frequent = np.sort(frequent[count[frequent] >= max(2, n / 100)])
        heavy, df = known[frequent], count[frequent]
        space = cls(heavy, np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(1.0, float(_lists(sample, "tfs")[1].sum()) / n), np.zeros((1, len(heavy)), np.float32))
        x = space._vectors(sample)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        x = x[size > 0] / size[size > 0, None]
        if not len(x):
            return space
        centres = x[rng.choice(len(x), min(clusters, max(1, len(x) // 8)), replace=False)]
        for _ in range(8):
            nearest = (x @ centres.T).argmax(1)
            order = np.argsort(nearest, kind="stable")
            cuts = np.searchsorted(nearest[order], np.arange(len(centres) + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                mean = x[order[cuts[k] : cuts[k + 1]]].sum(0)
                centres[k] = mean / np.sqrt(mean @ mean)
        # near centres get near numbers, so that the shards a seed asks lie in few groups
        alike, chain, left = centres @ centres.T, [0], set(range(1, len(centres)))
        while left:
            chain.append(max(left, key=lambda k: (alike[chain[-1], k], -k)))
            left.remove(chain[-1])
        space.centres = np.ascontiguousarray(centres[chain])
        return space

    def _vectors(self, t: pa.Table | pa.RecordBatch) -> np.ndarray:
        """A row of BM25 weights of the frequent words for each item."""
        (offsets, terms), (_, tfs) = _lists(t, "terms"), _lists(t, "tfs")
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        length = np.bincount(row, tfs, len(offsets) - 1)
        at, known = _matched(self.heavy, terms)
        row, at, tf = row[known], at[known], tfs[known]
        x = np.zeros((len(offsets) - 1, len(self.heavy)), np.float32)
        x[row, at] = self.idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / self.mean_length))
        return x

    def place(self, t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each item, and how much of the item lies along its centre."""
        along = self._vectors(t) @ self.centres.T
        cluster = along.argmax(1)
        return cluster.astype(np.int32), along[np.arange(len(along)), cluster].astype(np.float32)

    def asked(self, offsets: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """A row of 0 and 1 for the frequent words of each seed."""
        x = np.zeros((len(offsets) - 1, len(self.heavy)), np.float32)
        x[np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), heavy] = 1
        return x


def items_of(documents: DataFrame, capacities: Mapping[int, int], space: Space | None = None, compact: bool = False) -> DataFrame:
    """Rows of ITEMS, or of COMPACT, with the words as bytes; terms and what is made of them are null for all pieces but the last, which fill their container. A text's words are counted once for all capacities that hold it whole."""
    sent = documents.sparkSession.sparkContext.broadcast(space and vars(space))
    limits = sorted(capacities.items())
    least = min(capacities.values())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Terms()
        space = Space(**sent.value) if sent.value else None

        for batch in batches:
            rows: list[tuple] = []  # as _ITEMS up to n_tokens
            which: list[int | None] = []  # the words of each
            offsets, flat, tfs = [0], array("i"), array("i")

            def counted(text: str) -> int:
                found = _counted(text)
                if len(ids) > 200_000:
                    ids.clear()
                flat.extend(map(ids.__getitem__, found))
                tfs.extend(found.values())
                offsets.append(len(flat))
                return len(offsets) - 2

            def add(row: tuple, words: int | None) -> None:
                rows.append(row)
                which.append(words)

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                data = text.encode() if len(text) * 4 > least else None
                size = len(data) if data is not None else len(text.encode())
                whole = None
                for limit_id, capacity in limits:
                    if size <= capacity:
                        whole = counted(text) if whole is None else whole
                        add((limit_id, doc_id, 0, 1, 0, size), whole)
                        continue
                    pieces = divide(data, capacity)
                    for i, (s, n) in enumerate(pieces):
                        add((limit_id, doc_id, i, len(pieces), s, n), counted(data[s : s + n].decode("utf-8", "replace")) if i == len(pieces) - 1 else None)
                if len(flat) > 4_000_000 or len(rows) > 50_000:
                    yield _item_batch(rows, which, offsets, flat, tfs, space, compact)
                    rows, which, offsets, flat, tfs = [], [], [0], array("i"), array("i")
            if rows:
                yield _item_batch(rows, which, offsets, flat, tfs, space, compact)

    return documents.select("doc_id", "text").mapInArrow(cut, COMPACT if compact else ITEMS)


def _item_batch(rows: list[tuple], which: list[int | None], offsets: list[int], flat: array, tfs: array, space: Space | None, compact: bool) -> pa.RecordBatch:
    flat, tfs, n = np.array(flat, np.int32), np.minimum(np.array(tfs, np.int32), MOST_TIMES).astype(np.int16), len(offsets) - 1
    lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t)) for v, t in ((flat, pa.int32()), (tfs, pa.int16()))]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ITEMS)]
    cluster, fit = np.zeros(n, np.int32), np.zeros(n, np.float32)
    if space is not None:
        for a in range(0, n, 4096):
            cluster[a : a + 4096], fit[a : a + 4096] = space.place(pa.RecordBatch.from_arrays([c.slice(a, 4096) for c in lists], ["terms", "tfs"]))
    row = np.repeat(np.arange(n), np.diff(offsets))
    length = np.bincount(row, tfs, n).astype(np.int64)
    words, at = _compacted(row, flat, tfs, n, space) if compact else lists, pa.array(which, pa.int32())
    return pa.RecordBatch.from_arrays([*columns, *(x.take(at) for x in (pa.array(cluster), pa.array(fit), pa.array(length), *words))], schema=_COMPACT if compact else _ITEMS)


def _compacted(row: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n: int, space: Space) -> list[pa.Array]:
    """The columns of WORDS."""
    at, heavy = _matched(space.heavy, terms)
    return [_as_bytes(x[which].astype(kind), row[which], n) for (x, which), kind in zip(((at, heavy), (tfs, heavy), (terms, ~heavy), (tfs, ~heavy)), WORDS.values())]


def compacted(table: DataFrame, space) -> DataFrame:
    """terms, and tfs if there are any, of a table as the columns of WORDS."""
    kept, has_tfs = [c for c in table.columns if c not in ("terms", "tfs")], "tfs" in table.columns

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = _lists(batch, "terms")
            tfs = _lists(batch, "tfs")[1] if has_tfs else np.ones(len(terms), np.int16)
            words = _compacted(np.repeat(np.arange(batch.num_rows), np.diff(offsets)), terms, tfs, batch.num_rows, Space(**space.value))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *words], [*kept, *WORDS])

    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*kept).schema), *(f"{c} binary" for c in WORDS)])
    return table.select(*table.columns).mapInArrow(compact, types)


@dataclass
class Bm25:
    idf: np.ndarray  # by entry of the sketch
    mean_length: float

    @classmethod
    def of(cls, loose: DataFrame, n: int, length: int, space=None) -> Bm25:
        """Frequencies over all items, with the space those of COMPACT; at most SKETCH rows reach the driver."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, often = np.zeros(SKETCH, np.int64), np.zeros(len(space.value["heavy"]), np.int64)
            for batch in batches:
                count += np.bincount(_bytes(batch, "rest")[1] & (SKETCH - 1), minlength=SKETCH)
                often += np.bincount(_bytes(batch, "heavy")[1], minlength=len(often))
            np.add.at(count, space.value["heavy"] & (SKETCH - 1), often)
            entry = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(count[entry], pa.int64())], ["entry", "n"])

        if space is None:
            rows = loose.select(F.explode("terms").alias("term")).groupBy(F.col("term").bitwiseAND(F.lit(SKETCH - 1)).alias("entry")).agg(F.count("*").alias("n")).toArrow()
        else:
            rows = loose.select("heavy", "rest").mapInArrow(counted, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(SKETCH, np.float32)
        df[rows["entry"].to_numpy()] = rows["n"].to_numpy()
        return cls(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), max(1.0, length / max(1, n)))

    def weights(self, terms: np.ndarray, tfs: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weights of terms in items that have so many words."""
        return self.idf[terms & (SKETCH - 1)] * (tfs * np.float64(K1 + 1) / (tfs + K1 * (1 - B + B * length / self.mean_length))).astype(np.float32)


# the index


class Postings:
    """An inverted index: for each term the items that have it and their weights."""

    def __init__(self, item: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int):
        order = np.argsort(terms, kind="stable")
        self.item, self.weight, self.n = item[order], weights[order], n
        self.known, self.start = np.unique(terms[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(terms)))

    def matches(self, query: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, weight) of every posting of the queries' terms."""
        at, known = _matched(self.known, terms)
        return self.postings(query[known], at[known])

    def postings(self, query: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for terms given as places in ``known``."""
        count = self.count[at]
        before = np.cumsum(count) - count
        posting = np.arange(count.sum()) + np.repeat(self.start[at] - before, count)
        return np.repeat(query, count), self.item[posting], self.weight[posting]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every item for a seed's distinct terms."""
        _, item, weight = self.matches(np.zeros(len(terms), np.int64), terms)
        return np.bincount(item, weight, self.n)

    def parted(self) -> tuple[Postings, np.ndarray, np.ndarray]:
        """The index without its frequent terms; the columns of these in the matrix of their weights, -1 for the others; and the matrix."""
        frequent = np.sort(np.argsort(-self.count, kind="stable")[:MOST_HEAVY])
        frequent = frequent[self.count[frequent] >= max(2, self.n / 100)]
        column = np.full(len(self.known), -1)
        column[frequent] = np.arange(len(frequent))
        of = np.repeat(column, self.count)
        matrix = np.zeros((self.n, len(frequent)), np.float32)
        matrix[self.item[of >= 0], of[of >= 0]] = self.weight[of >= 0]
        out = Postings.__new__(Postings)
        out.item, out.weight, out.n, out.known, out.count = self.item[of < 0], self.weight[of < 0], self.n, self.known, np.where(column < 0, self.count, 0)
        out.start = np.cumsum(out.count) - out.count
        return out, column, matrix

    def only(self, chosen: np.ndarray) -> Postings:
        """The index of some of its items, numbered in the order given."""
        out, number = Postings.__new__(Postings), np.full(self.n, -1)
        number[chosen] = np.arange(len(chosen))
        item = number[self.item]
        upto = np.concatenate([[0], np.cumsum(item >= 0)])
        out.item, out.weight, out.n, out.known = item[item >= 0], self.weight[item >= 0], len(chosen), self.known
        out.start, out.count = upto[self.start], upto[self.start + self.count] - upto[self.start]
        return out


def search_group(queries: pa.Table, items: pa.Table, space: Space, bm25: Bm25, k: int, give_out: bool = False) -> pa.Table:
    """The k best items of a group for each query: of its shards (``units``) those the query asks, items that fit its room, not the query itself.

    Frequent words are a dense matrix, multiplied with many queries at a time; the others go through the inverted index.
    give_out: each item to one query only, best scores first, as long as there's room.
    """
    if not queries.num_rows or not items.num_rows:
        return _FOUND.empty_table()
    items = items.sort_by([("unit", "ascending"), ("n_tokens", "ascending"), ("doc_id", "ascending")])
    n, unit, size, doc_id = items.num_rows, items["unit"].to_numpy(), items["n_tokens"].to_numpy(), items["doc_id"].to_numpy()
    units, first = np.unique(unit, return_index=True)
    last = np.append(first[1:], n)
    (h_offsets, heavy), (r_offsets, terms), (_, h_tfs), (_, tfs) = (_bytes(items, c) for c in ("heavy", "rest", "heavy_tfs", "rest_tfs"))
    h_item, item = (np.repeat(np.arange(n), np.diff(o)) for o in (h_offsets, r_offsets))
    length = np.bincount(h_item, h_tfs, n) + np.bincount(item, tfs, n)
    dense = np.zeros((n, len(space.heavy)), np.float32)
    dense[h_item, heavy] = bm25.weights(space.heavy[heavy], h_tfs, length[h_item])
    unit_of = np.repeat(np.arange(len(units)), last - first)
    # the other words' postings lie by ranges of shards, so that a query passes over those of ranges it doesn't ask
    known, at = np.unique(terms, return_inverse=True)
    stretch = first // RANGE
    ranges = int(stretch[-1]) + 1
    rest = Postings(item, stretch[unit_of[item]] * len(known) + at, bm25.weights(terms, tfs, length[item]), n)
    place = np.full(ranges * len(known), -1, np.int32)
    place[rest.known] = np.arange(len(rest.known))
    by_id = np.argsort(doc_id, kind="stable")
    # queries that ask the same shards are looked at together
    u_offsets, asked = _bytes(queries, "units")
    queries = queries.take(np.lexsort((queries["doc_id"].to_numpy(), asked[(u_offsets[:-1] + u_offsets[1:]) // 2])))
    (q_offsets, q_terms), (u_offsets, asked) = _bytes(queries, "rest"), _bytes(queries, "units")
    bits = np.frombuffer(b"".join(queries["bits"].to_pylist()), np.uint8).reshape(queries.num_rows, -1)
    seeds, rooms = queries["doc_id"].to_numpy(), queries["room"].to_numpy()
    (in_rest, is_rest), (self_at, is_in) = _matched(known, q_terms), _matched(doc_id[by_id], seeds)
    # of each shard asked the items that fit, which come first in it
    pair_unit, there = _matched(units, asked)
    large = max(int(size.max()), int(rooms.max())) + 1
    fit = np.searchsorted(unit_of * large + size, pair_unit * large + np.repeat(rooms, np.diff(u_offsets)), "right") - first[pair_unit]
    there = np.flatnonzero(there & (fit > 0))
    row, pair_unit, fit = np.repeat(np.arange(len(seeds)), np.diff(u_offsets))[there], pair_unit[there], fit[there]
    pair_ends, looks = np.searchsorted(row, np.arange(len(seeds) + 1)), np.concatenate([[0], np.cumsum(fit)])  # items that the pairs before look at
    upto = looks[pair_ends]  # that the queries before look at
    r_ends, in_rest = np.concatenate([[0], np.cumsum(is_rest)])[q_offsets], in_rest[is_rest]
    out, a, line, counted = [], 0, np.zeros((0, len(space.heavy)), np.float32), np.zeros(0, np.int64)

    def until(a: int, most: int) -> int:
        """The query up to which those from a on look at so many items."""
        return max(a + 1, min(a + max(1, most // len(units)), int(np.searchsorted(upto, upto[a] + most, "right")) - 1))

    while a < len(seeds):
        b = until(a, PAIRS)
        of = slice(pair_ends[a], pair_ends[b])
        u, span = pair_unit[of], fit[of]
        # the scores of a shard's items for those that ask about as many of them are one block
        cell = u * 64 + np.frexp(span)[1]
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order], prepend=-1, append=-1)) if len(u) else np.zeros(1, np.int64)
        wide = np.maximum.reduceat(span[order], cuts[:-1]) if len(u) else np.zeros(0, np.int64)
        width = np.repeat(wide, np.diff(cuts))
        blocks, starts = np.empty(int(width.sum()), np.float32), np.zeros(len(u), np.int64)
        starts[order] = np.cumsum(width) - width
        x, askers = np.unpackbits(bits[a:b], axis=1, count=len(space.heavy)).astype(np.float32), row[of][order] - a
        if len(line) < b - a:
            line = np.empty_like(x)
        lows, ats = first[u[order[cuts[:-1]]]].tolist(), starts[order[cuts[:-1]]].tolist()
        for begin, end, n_first, low, at in zip(cuts.tolist(), cuts[1:].tolist(), wide.tolist(), lows, ats):
            own = np.take(x, askers[begin:end], 0, line[: end - begin], "clip")
            np.matmul(own, dense[low : low + n_first].T, out=blocks[at : at + (end - begin) * n_first].reshape(end - begin, n_first))
        # the rest for so few queries at a time that their scores stay near
        while a < b:
            c = min(b, until(a, NEAR))
            mine = slice(pair_ends[a] - of.start, pair_ends[c] - of.start)
            u, span, asker, begins = pair_unit[of][mine], fit[of][mine], row[of][mine] - a, looks[of][mine] - upto[a]
            # the scores of a query lie together, a shard's after the other's
            at = np.repeat(starts[mine] - begins, span)
            if len(counted) < len(at):
                counted = np.arange(len(at))
            at += counted[: len(at)]
            scores = blocks[at]
            # where the scores of a query for a shard's items begin, less the number of the first of them; and the number of the last
            base, stop = np.zeros((2, (c - a) * len(units)), np.int64)
            base[asker * len(units) + u], stop[asker * len(units) + u] = begins - first[u], first[u] + span
            # every other word of a query in every range it asks
            asks = np.unique(asker * ranges + stretch[u])
            word, word_ends = in_rest[r_ends[a] : r_ends[c]], r_ends[a : c + 1] - r_ends[a]
            words = np.diff(word_ends)[asks // ranges]
            which = np.repeat(word_ends[asks // ranges] - np.cumsum(words) + words, words)
            if len(counted) < len(which):
                counted = np.arange(len(which))
            which += counted[: len(which)]
            key = np.repeat(asks % ranges * len(known), words)
            key += word[which]
            key = place[key]
            found = np.flatnonzero(key >= 0)
            key, query = key[found], np.repeat(asks // ranges * len(units), words)[found]
            for h in range(0, len(key), HITS):
                at, hit, w = rest.postings(query[h : h + HITS], key[h : h + HITS])
                at += unit_of[hit]
                kept = np.flatnonzero(hit < stop[at])
                np.add.at(scores, base[at[kept]] + hit[kept], w[kept])
            own, query = by_id[self_at[a:c][is_in[a:c]]], np.flatnonzero(is_in[a:c])
            at = query * len(units) + unit_of[own]
            kept = own < stop[at]
            scores[base[at[kept]] + own[kept]] = -np.inf
            ends = (upto[a : c + 1] - upto[a]).tolist()
            best = [np.argpartition(scores[s:e], e - s - k)[e - s - k :] + s if e - s > k else np.arange(s, e) for s, e in zip(ends, ends[1:])]
            at, query = np.concatenate(best), np.repeat(np.arange(a, c), [len(x) for x in best])
            kept = scores[at] > 0
            at, query = at[kept], query[kept]
            pair = np.searchsorted(begins, at, "right") - 1
            out.append(((first[u] - begins)[pair] + at, query, scores[at]))
            a = c
    if not out:
        return _FOUND.empty_table()
    i, r, score = (np.concatenate(c) for c in zip(*out))
    if give_out:
        order = np.sort((-score.view(np.int32).astype(np.int64) << 32) + np.arange(len(score))) & 0xFFFFFFFF  # from the best score, all above 0, down
        kept = order[_given_out(i[order], r[order], size, rooms)]
        i, r, score = i[kept], r[kept], score[kept]
    columns = [np.full(len(r), queries["limit_id"][0].as_py()), doc_id[i], size[i], seeds[r], score]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def _given_out(item: np.ndarray, query: np.ndarray, size: np.ndarray, room: np.ndarray) -> list[int]:
    """Of pairs in the order of their worth those that hold if each item goes to one query with room for it."""
    sizes, rooms, unused, kept = size.tolist(), room.tolist(), np.ones(len(size), bool), []
    left = np.arange(len(item))
    while len(left):
        some, left = left[:GIVEN], left[GIVEN:]
        some = some[unused[item[some]]]
        used = set()
        for at, i, q in zip(some.tolist(), item[some].tolist(), query[some].tolist()):
            if i not in used and sizes[i] <= rooms[q]:
                used.add(i)
                rooms[q] -= sizes[i]
                kept.append(at)
        unused[list(used)] = False
    return kept


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns, F.lit("packing"))


class Index:
    """The index of unused items: (limit_id, doc_id, n_tokens, cluster, fit, WORDS). Its plan has one row for each shard: at most limits x MOST_CLUSTERS x BANDS."""

    def __init__(self, items: DataFrame, edges: Mapping[int, list[int]], space, bm25, group: int = GROUP, reach: int = REACH):
        self.spark, self.space, self.bm25 = items.sparkSession, space, bm25
        self.items = items.withColumn("band", _band(edges))
        counted = self.items.groupBy("limit_id", "cluster", "band").agg(F.count("*").alias("n"), F.avg("fit").alias("fit")).toArrow()
        counted = counted.sort_by([("limit_id", "ascending"), ("cluster", "ascending"), ("band", "ascending")])
        self.limit, self.cluster, self.band, self.n, self.fit = (counted[c].to_numpy() for c in ("limit_id", "cluster", "band", "n", "fit"))
        self.low = np.array([[0, *edges[v]][b] for v, b in zip(self.limit.tolist(), self.band.tolist())], np.int64)
        self.pieces = -(-self.n // group)
        self.group0, at, held, before = np.zeros(len(self.n), np.int64), -1, 0, None
        for i, (v, n, p) in enumerate(zip(self.limit.tolist(), self.n.tolist(), self.pieces.tolist())):
            if v != before or p > 1 or held + n > group:
                at, held, before = at + 1, 0, v
            self.group0[i] = at
            if p > 1:
                at, held = at + p - 1, group
            held += n
        self.reach = {int(v): max(LEAST_REACH, math.ceil(reach * math.sqrt(self.n[self.limit == v].sum()))) for v in np.unique(self.limit)}

    def _routes(self):
        """What a task needs to send seeds to shards."""
        keep = ("limit", "cluster", "n", "fit", "low", "pieces", "group0", "reach")
        return {c: getattr(self, c) for c in keep}

    def search(self, queries: DataFrame, k: int, block: int = BLOCK, give_out: bool = False) -> DataFrame:
        """Rows of FOUND: for each of the queries (limit_id, doc_id, room, heavy, rest) its k best items of every group it asks, which hold the k best of all it asks.

        give_out: every task gives its items out, each to one query.
        """
        sent, space, bm25 = self.spark.sparkContext.broadcast(self._routes()), self.space, self.bm25

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    yield from _route(batch.slice(a, 1024), sent.value, Space(**space.value))

        self.routed = routed = materialize(queries.select("limit_id", "doc_id", "room", "heavy", "rest").mapInArrow(route, "group long, limit_id int, doc_id long, room long, bits binary, rest binary, units binary"), "routed")
        # a row for each group that is asked; the size is known, so Spark broadcasts it while it's small
        counted = routed.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).toArrow()
        blocks = self.spark.createDataFrame(counted) if counted.num_rows else self.spark.createDataFrame([], "group long, _blocks int")
        plan = self.spark.createDataFrame(pa.table({"limit_id": pa.array(self.limit, pa.int32()), "cluster": pa.array(self.cluster, pa.int32()), "band": pa.array(self.band, pa.int32()), "unit": pa.array(np.arange(len(self.n)), pa.int32()), "_group0": pa.array(self.group0), "_pieces": pa.array(self.pieces)}))
        held = self.items.join(F.broadcast(plan), ["limit_id", "cluster", "band"]).withColumn("group", F.col("_group0") + F.pmod(_hash("doc_id"), F.col("_pieces")))
        held = held.select("group", "doc_id", "n_tokens", "unit", *WORDS).join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        asking = routed.join(blocks, "group").withColumn("block", F.pmod(_hash("doc_id"), F.col("_blocks")).cast("int")).drop("_blocks")
        by, tasks = ["group", "block"], 2 * max(1, int(counted["_blocks"].to_numpy().sum()))
        asking, held = asking.repartition(tasks, *by), held.repartition(tasks, *by)
        return asking.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(lambda q, t: search_group(q, t, Space(**space.value), Bm25(**bm25.value), k, give_out), FOUND)


def _band(edges: Mapping[int, list[int]]) -> Column:
    """The band of an item by its size, from the lower bounds of all bands but the first."""
    out = F.lit(0)
    for limit_id, bounds in edges.items():
        above = sum(((F.col("n_tokens") >= e).cast("int") for e in bounds), F.lit(0))
        out = F.when(F.col("limit_id") == limit_id, above).otherwise(out)
    return out.cast("int")


def _route(batch: pa.RecordBatch, r: dict, space: Space) -> Iterator[pa.RecordBatch]:
    """Each seed once for every group it asks, with the shards it asks there."""
    (offsets, heavy), (r_offsets, _) = _bytes(batch, "heavy"), _bytes(batch, "rest")
    asked = space.asked(offsets, heavy)
    affinity, words = asked @ space.centres.T, np.diff(offsets + r_offsets)
    bits = pa.array([x.tobytes() for x in np.packbits(asked > 0, axis=1)], pa.binary())
    limits, ids, rooms = (batch[c].to_numpy() for c in ("limit_id", "doc_id", "room"))
    for v in np.unique(limits).tolist():
        rows, units = np.flatnonzero(limits == v), np.flatnonzero(r["limit"] == v)
        if not len(units):
            continue
        promise = affinity[rows][:, r["cluster"][units]] * r["fit"][units].astype(np.float32) + np.float32(1e-9)  # a seed without frequent words may ask any
        promise[r["low"][units][None, :] > rooms[rows][:, None]] = 0
        reach = (r["reach"][v] * np.clip(FEW_WORDS / np.maximum(1, words[rows]), 1, MOST_MORE)).astype(np.int64)
        # promises, which aren't negative, above the numbers of the shards, from the last down: sorted as whole numbers, alike promises in the order of the shards
        ranked = (promise.view(np.int32).astype(np.int64) << 32) + np.arange(len(units))[::-1]
        parts, still, few = [], np.arange(len(rows)), 32
        while len(still):
            few = min(few * 4, len(units))
            best = np.sort(np.partition(ranked[still], len(units) - few, axis=1)[:, len(units) - few :] if few < len(units) else ranked[still], axis=1)[:, ::-1]
            best, some = len(units) - 1 - (best & 0xFFFFFFFF), best >> 32
            n = r["n"][units][best]
            before = np.cumsum(n, axis=1) - n
            done = (before[:, -1] + n[:, -1] >= reach[still]) | (some[:, -1] == 0) | (few == len(units))
            row, at = np.nonzero(done[:, None] & (before < reach[still][:, None]) & (some > 0))
            parts.append((still[row], units[best[row, at]], reach[still[row]] - before[row, at]))
            still = still[~done]
        row, unit, wanted = (np.concatenate(c) for c in zip(*parts))
        # of a shard cut into several groups so many as the seed still wants, beginning anywhere
        pieces = r["pieces"][unit]
        some = np.minimum(pieces, -(-wanted * pieces // r["n"][unit]))
        step = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        row, unit, pieces = np.repeat(row, some), np.repeat(unit, some), np.repeat(pieces, some)
        group = r["group0"][unit] + (ids[rows[row]] + step) % pieces
        order = np.argsort((row * (int(group.max(initial=0)) + 1) + group) * (int(unit.max(initial=0)) + 1) + unit)
        row, group, unit = row[order], group[order], unit[order]
        starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(group) != 0)]) if len(row) else np.zeros(0, np.int64)
        seed = pa.array(rows[row[starts]])
        lists = _as_bytes(unit.astype(np.int32), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row)))), len(starts))
        yield pa.RecordBatch.from_arrays([pa.array(group[starts], pa.int64()), *(batch[c].take(seed) for c in ("limit_id", "doc_id", "room")), bits.take(seed), batch["rest"].take(seed), lists], ["group", "limit_id", "doc_id", "room", "bits", "rest", "units"])


def nearest(items: DataFrame, queries: DataFrame, edges, space, bm25, k: int, **settings) -> DataFrame:
    """(limit_id, seed, doc_id, n_tokens, score): the k best items of each query, as the index finds them."""
    best = Window.partitionBy("limit_id", "seed").orderBy(F.desc("score"), "doc_id")
    found = Index(compacted(items, space), edges, space, bm25, **settings).search(compacted(queries, space), k)
    return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


# filling


def fill(index: Postings, sizes: np.ndarray, terms: list[np.ndarray], capacity: int, opened: list[tuple[np.ndarray, int]] = ()) -> tuple[list[list[int]], list[list[int]]]:
    """What each container already open, given by its seed's terms and its room, takes, and the containers of the items left, whose seed is the largest.

    A container takes the unused items that fit in the order of their scores, then the largest that fit. Scores of frequent terms are a
    matrix product for AHEAD containers at a time, those of the others come from the postings.
    """
    order = np.argsort(-sizes, kind="stable")
    unused = np.ones(len(sizes), bool)

    def take(near: np.ndarray, room: int, inside: list[int]) -> int:
        while near.size:
            upto = np.cumsum(sizes[near])
            got = near[: int(np.searchsorted(upto, room, "right"))]
            unused[got] = False
            inside += got.tolist()
            room -= int(sizes[got].sum())
            near = near[len(got) :]
            near = near[sizes[near] <= room]
        return room

    others, column, matrix = index.parted()
    live, near_index, near = order, others.only(order), matrix[order]  # the unused items and few others, the largest first
    low, ahead = 0, {}  # scores for containers that come next of the items live from low on

    def look_ahead(coming: list[tuple[int, np.ndarray, int]]) -> None:
        nonlocal low, ahead
        low = int(np.searchsorted(-sizes[live], -max(room for _, _, room in coming)))
        x, places = np.zeros((len(coming), matrix.shape[1]), np.float32), []
        for line, (_, asked, _) in zip(x, coming):
            at, known = _matched(index.known, asked)
            at = at[known]
            line[column[at[column[at] >= 0]]] = 1
            places.append(at[column[at] < 0])
        ahead = {who: both for (who, _, _), *both in zip(coming, x @ near[low:].T, places)}

    def close(who: int, room: int, inside: list[int], coming, most: int = capacity) -> list[int]:
        """coming: this and the next containers, as (who, terms, room). most: the largest room of any container that is still to be closed."""
        nonlocal live, near_index, near, ahead
        chosen = np.flatnonzero(unused[live])
        chosen = chosen[np.searchsorted(-sizes[live[chosen]], -most) :]
        if len(chosen) < len(live) // 2:
            live, near_index, near, ahead = live[chosen], near_index.only(chosen), near[chosen], {}
            chosen = np.arange(len(live))
        fits = chosen[np.searchsorted(-sizes[live[chosen]], -room) :]
        if fits.size:
            if who not in ahead:
                look_ahead(coming())
            frequent, places = ahead.pop(who)
            _, item, weight = near_index.postings(places, places)
            scores = frequent[fits - low]
            if len(item):
                scores += np.bincount(item, weight, near_index.n)[fits].astype(np.float32)
            fits = live[fits]
            some, scores = fits[scores > 0], scores[scores > 0]
            while some.size:
                best = scores >= (np.partition(scores, len(scores) - FIRST)[len(scores) - FIRST] if len(scores) > 2 * FIRST else 0)
                room = take(some[best][np.lexsort((some[best], -scores[best]))], room, inside)
                still = ~best & (sizes[some] <= room)
                some, scores = some[still], scores[still]
            take(fits[unused[fits] & (sizes[fits] <= room)], room, inside)
        return inside

    most = np.maximum.accumulate([room for _, room in opened][::-1])[::-1].tolist()
    before = [close(k, opened[k][1], [], lambda k=k: [(i, *opened[i]) for i in range(k, min(k + AHEAD, len(opened)))], later) for k, later in enumerate(most)]
    live, near_index, near, ahead = order, others.only(order), matrix[order], {}
    new = []

    def next_seeds(k: int) -> list[tuple[int, np.ndarray, int]]:
        later = order[k + 1 : k + AHEAD]
        return [(i, terms[i], capacity - int(sizes[i])) for i in [int(order[k]), *later[unused[later]].tolist()]]

    for k, seed in enumerate(order.tolist()):
        if unused[seed]:
            unused[seed] = False
            new.append(close(seed, capacity - int(sizes[seed]), [seed], lambda k=k: next_seeds(k)))
    return before, new


def _fill_part(t: pa.Table, capacities: Mapping[int, int], space: Space, bm25: Bm25, last_round: int) -> pa.Table:
    """Rows of _TAKEN for the items of a part; rows with a room are containers already open."""
    limit_id = t["limit_id"][0].as_py()
    t = t.sort_by([("n_tokens", "descending"), ("doc_id", "ascending")])
    is_open = np.array(t["room"].is_valid())
    opened, items = t.filter(pa.array(is_open)).sort_by([("room", "descending"), ("doc_id", "ascending")]), t.filter(pa.array(~is_open))
    (offsets, terms, tfs), (o_offsets, o_terms, _) = _words(items, space), _words(opened, space, False)
    item = np.repeat(np.arange(items.num_rows), np.diff(offsets))
    index = Postings(item, terms, bm25.weights(terms, tfs, np.bincount(item, tfs, items.num_rows)[item]), items.num_rows)
    sizes, ids = items["n_tokens"].to_numpy(), items["doc_id"].to_numpy()
    before, new = fill(index, sizes, np.split(terms, offsets[1:-1]), capacities[limit_id], list(zip(np.split(o_terms, o_offsets[1:-1]), opened["room"].to_pylist())))
    both = [*zip(opened["doc_id"].to_pylist(), before), *((int(ids[c[0]]), c) for c in new)]
    item = np.array([i for _, c in both for i in c], np.int64)
    lengths = [len(c) for _, c in both]
    columns = [np.full(len(item), limit_id), ids[item], np.repeat(np.array([s for s, _ in both], np.int64), lengths), np.full(len(item), last_round), [p for n in lengths for p in range(n)], sizes[item]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TAKEN)], schema=_TAKEN)


def bounds_of(counts: Counter) -> list[int]:
    """Sizes at which bands of about equally many items begin, but for the first band."""
    sizes = [s for s in sorted(counts) if s and counts[s] > 0]
    if not sizes:
        return []
    upto = np.cumsum([counts[s] for s in sizes])
    return sorted({sizes[int(np.searchsorted(upto, upto[-1] * b / BANDS))] for b in range(1, BANDS)})


@dataclass
class Start:
    """The seeds of a limit, as the least size of one and the share of the items of that size, and the bounds of the bands of the others."""

    size: int
    share: float
    edges: list[int]

    @classmethod
    def of(cls, counts: dict[int, int], capacity: int) -> Start:
        left = -(-sum(s * n for s, n in counts.items()) // capacity)  # containers needed for all tokens
        at, others = 0, Counter(counts)
        share = 0.0
        for s in sorted(counts, reverse=True):
            if left <= 0 or not s:
                break
            at, share = s, min(1.0, left / counts[s])
            others[s] -= round(share * counts[s])
            left -= counts[s]
        return cls(at, share, bounds_of(others))

    def is_seed(self) -> Column:
        some = F.pmod(_hash("doc_id"), F.lit(1 << 20)) < F.lit(int(self.share * (1 << 20)))
        return (F.col("n_tokens") > self.size) | ((F.col("n_tokens") == self.size) & some) if self.size else F.lit(False)


def _greedy(best_first: Column, room: Column) -> Column:
    """The elements (doc_id, n_tokens) of an array that fit a room one after the other, those that don't being passed over."""
    none = F.array().cast("array<struct<doc_id:bigint,n_tokens:bigint>>")
    one = lambda x: F.array(F.struct(x["doc_id"].alias("doc_id"), x["n_tokens"].alias("n_tokens")))
    step = lambda a, x: F.when(x["n_tokens"] <= a["room"], F.struct((a["room"] - x["n_tokens"]).alias("room"), F.concat(a["got"], one(x)).alias("got"))).otherwise(a)
    return F.aggregate(best_first, F.struct(room.cast("bigint").alias("room"), none.alias("got")), step)["got"]


def pack(documents: DataFrame, capacities: Mapping[int, int], *, rounds: int = ROUNDS, neighbours: int = NEIGHBOURS, group: int = GROUP, block: int = BLOCK, part: int = PART) -> DataFrame:
    """Rows of PACKED: for each limit (limit_id: capacity) every piece of every document with its container, its place there and the room the container leaves unused.

    documents: (doc_id, text), doc_id unique and not null; other columns don't matter. A null or empty text takes no room and lies in
    some container. Only texts above the capacity have more than one piece, in ascending start_token; a piece never breaks a
    character. start_token and n_tokens place a piece in its text. No documents or capacities, no containers. The driver holds a histogram
    of sizes (at most one entry for each size up to the capacities), the plan of the shards and the sample.
    """
    spark = documents.sparkSession
    if not capacities:
        return spark.createDataFrame([], PACKED)
    documents = documents.select("doc_id", "text")
    n_documents = documents.count()
    asked = max(1, SAMPLE // len(capacities))
    some = documents if n_documents <= asked else documents.filter(F.pmod(_hash("doc_id"), F.lit(1 << 30)) < F.lit(int(asked / n_documents * (1 << 30)))).limit(2 * asked)
    sample = items_of(some, capacities).filter("terms is not null").select("terms", "tfs").toArrow()
    fitted = Space.fit(sample, min(MOST_CLUSTERS, max(1, math.isqrt(n_documents) // 2)))
    items = materialize(items_of(documents, capacities, fitted, compact=True), "items")
    loose = items.filter("rest is not null")
    counts: dict[int, dict[int, int]] = {v: {} for v in capacities}
    n, length = 0, 0
    for r in loose.groupBy("limit_id", "n_tokens").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect():
        counts[r.limit_id][r.n_tokens], n, length = r.n, n + r.n, length + r.length
    # as plain values: executors don't have this package
    space = spark.sparkContext.broadcast(vars(fitted))
    bm25 = spark.sparkContext.broadcast(vars(Bm25.of(loose, n, length, space)))
    starts = {v: Start.of(c, capacities[v]) for v, c in counts.items()}
    edges = {v: s.edges for v, s in starts.items()}
    per_limit = lambda f: F.coalesce(*[F.when(F.col("limit_id") == v, f(v)) for v in capacities])
    loose = loose.withColumn("seed", per_limit(lambda v: starts[v].is_seed()))
    seeds = loose.filter("seed").select("limit_id", "doc_id", "n_tokens", per_limit(lambda v: F.lit(capacities[v])).cast("long").alias("_capacity"), "heavy", "rest")
    others = loose.filter("not seed").select("limit_id", "doc_id", "n_tokens", "cluster", "fit", "length", *WORDS)
    taken: DataFrame | None = None
    for r in range(1, rounds + 1):
        open_now, free = _open(seeds, taken), _free(others, taken)
        index = Index(free, edges, space, bm25, group)
        if not len(index.n):
            break
        found = index.search(open_now, neighbours, block, give_out=True)
        won = found.groupBy("limit_id", "doc_id").agg(F.max_by(F.struct("seed", "score", "n_tokens"), F.struct("score", -F.col("seed"))).alias("w")).select("limit_id", F.col("w.seed").alias("doc_id"), F.struct((-F.col("w.score")).alias("s"), "doc_id", F.col("w.n_tokens").alias("n_tokens")).alias("x"))
        lists = won.groupBy("limit_id", "doc_id").agg(F.array_sort(F.collect_list("x")).alias("won"))
        got = lists.join(open_now.select("limit_id", "doc_id", "room"), ["limit_id", "doc_id"]).select("limit_id", F.col("doc_id").alias("container"), F.posexplode(_greedy(F.col("won"), F.col("room"))).alias("rank", "x"))
        got = materialize(got.select("limit_id", "x.doc_id", "container", F.lit(r).alias("round"), "rank", "x.n_tokens"), "taken")
        release(index.routed)
        if got.isEmpty():
            break
        taken = got if taken is None else taken.unionByName(got)
    # what is left, with the containers still open
    cols = ["limit_id", "doc_id", "n_tokens", "room", *WORDS]
    left = _open(seeds, taken).withColumns({c: F.lit(None).cast("binary") for c in ("heavy_tfs", "rest_tfs")}).select(*cols).unionByName(_free(others, taken, False).withColumn("room", F.lit(None).cast("long")).select(*cols))
    parts = dict.fromkeys(capacities, 1) | {r[0]: -(-r[1] // part) for r in left.groupBy("limit_id").count().collect()}
    left = left.withColumn("part", F.pmod(_hash("doc_id"), per_limit(lambda v: F.lit(parts[v]))))
    last = left.groupBy("limit_id", "part").applyInArrow(lambda t: _fill_part(t, capacities, Space(**space.value), Bm25(**bm25.value), rounds + 1), TAKEN)
    own = seeds.select("limit_id", "doc_id", F.col("doc_id").alias("container"), F.lit(0).alias("round"), F.lit(0).alias("rank"), "n_tokens")
    whole = own.unionByName(materialize(last, "last"))
    return _containers(items, whole if taken is None else whole.unionByName(taken), per_limit(lambda v: F.lit(capacities[v])).cast("long"))


def _open(seeds: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Seeds whose containers have room, with it."""
    room = F.col("_capacity") - F.col("n_tokens")
    if taken is not None:
        used = taken.groupBy("limit_id", F.col("container").alias("doc_id")).agg(F.sum("n_tokens").alias("_used"))
        seeds, room = seeds.join(used, ["limit_id", "doc_id"], "left"), room - F.coalesce("_used", F.lit(0))
    return seeds.withColumn("room", room).filter("room > 0")


def _free(others: DataFrame, taken: DataFrame | None, with_words: bool = True) -> DataFrame:
    """Unused items; for the index, those that have words."""
    free = others.filter("length > 0") if with_words else others
    return free if taken is None else free.join(taken.select("limit_id", "doc_id"), ["limit_id", "doc_id"], "left_anti")


def _containers(items: DataFrame, taken: DataFrame, capacity: Column) -> DataFrame:
    by = Window.partitionBy("limit_id", "container")
    placed = taken.select(
        "limit_id", "doc_id", F.concat(F.lit("c"), "container").alias("container_id"), (F.row_number().over(by.orderBy("round", "rank", "doc_id")) - 1).alias("position"), F.sum("n_tokens").over(by).alias("container_tokens")
    )
    loose = items.filter("rest is not null").select("limit_id", "doc_id", "piece_no", "pieces", "start_token", "n_tokens").join(placed, ["limit_id", "doc_id"])
    full = items.filter("rest is null").withColumns({"container_id": F.concat(F.lit("f"), "doc_id", F.lit("-"), "piece_no"), "position": F.lit(0), "container_tokens": F.col("n_tokens")})
    columns = ["limit_id", "container_id", "position", "doc_id", "piece_no", "pieces", "start_token", "n_tokens", "container_tokens", (capacity - F.col("container_tokens")).alias("unused")]
    return loose.select(*columns).unionByName(full.select(*columns))


def with_texts(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds the text of each piece; a null text stays null."""
    texts = documents.select(F.col("doc_id").alias("_doc_id"), "text")
    part = F.decode(F.substring(F.encode("text", "UTF-8"), (F.col("start_token") + 1).cast("int"), F.col("n_tokens").cast("int")), "UTF-8")
    joined = packed.join(texts, packed["doc_id"] == texts["_doc_id"])
    return joined.withColumn("text", F.when(F.col("pieces") == 1, F.col("text")).otherwise(part)).drop("_doc_id")
