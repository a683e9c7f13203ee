"""Byte-level BPE encoding by merge replay, and decoding.

Each task gathers the distinct words of a block of its texts and encodes them together, in
arrays without an object for each word: an inverted index leads from a merge to the positions where it applies, the merges of each
word are applied in rank order, those of many words and ranks at once, and only the pairs next to a
merge are looked at again. Words seen before come from a memo of bounded size. Texts never leave their partition.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from sitefold.llm.common import parts, texts
from sitefold.session import materialize

NONE = 2**30
#: Bytes of text gathered before their new words are encoded, and words remembered
#: beside those of the block.
BLOCK_CHARS = 2_000_000
MEMO_WORDS = 150_000
#: Positions whose pairs are looked up at a time.
_LOOK = 1 << 16
#: Places merged at a time, at least, and bits of the ranks that share one list of the index.
_WAVE = 1 << 12
_GROUP = 5
#: White space of Unicode; Python's own class also has four control characters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes that may end a visible character: no blank of ASCII, no last byte of another white space.
_VISIBLE = np.array([0x20 < b < 0x7F or b >= 0x80 for b in range(256)])
_VISIBLE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (one base64 token and its rank per line)."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}


def joined(column: pa.Array) -> np.ndarray:
    """The bytes of all values, one after the other (null: none)."""
    one = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.binary()).fill_null(b""))
    return np.frombuffer(pc.binary_join(one, b"")[0].as_buffer(), np.uint8)


def sizes_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(data: np.ndarray, sizes: np.ndarray, kind=pa.binary()) -> pa.Array:
    """Consecutive pieces of ``data`` of these numbers of elements."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    offsets = (offsets * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts texts before each space that follows a visible character; and the units of each text.

    No match of the splitting pattern crosses such a cut, so units are encoded one by one.
    """
    data, sizes = joined(texts), sizes_of(texts)
    cut = np.zeros(len(data) + 1, bool)
    np.logical_and(data[1:] == 0x20, _VISIBLE[data[:-1]], out=cut[1:-1])
    ends = np.cumsum(sizes)
    cut[(ends - sizes)[sizes > 0]] = True
    cut[-1] = True
    places = np.flatnonzero(cut)
    found = slices(data, np.diff(places), pa.string())
    return found, np.diff(np.searchsorted(places[:-1], ends), prepend=0)


class Sequences:
    """Ids of words, as places in one array."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, words: np.ndarray) -> "Sequences":
        """Those of some words, which may repeat, one after the other."""
        sizes = self.sizes[words]
        shifts = self.starts[words] - (np.cumsum(sizes) - sizes)
        return Sequences(self.ids[np.repeat(shifts, sizes) + np.arange(int(sizes.sum()))], sizes)

    def together(self, groups: np.ndarray) -> "Sequences":
        """Joins consecutive words, so many for each group."""
        ends = np.append(0, np.cumsum(self.sizes))[np.append(0, np.cumsum(groups))]
        return Sequences(self.ids, np.diff(ends))

    def __add__(self, other: "Sequences") -> "Sequences":
        return Sequences(np.concatenate((self.ids, other.ids)), np.concatenate((self.sizes, other.sizes)))


class MergeReplay:
    """Encoder of lists of words by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[t[:k]] << 32 | ranks[t[k:]], r)
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([p[1] for p in pairs] or [NONE], np.int64)
        # two bytes are sorted by counting
        self.groups = np.uint16 if max(ranks.values()) >> _GROUP < 1 << 16 else np.int32
        self.tokens = pa.array(list(ranks), pa.binary())
        self.token_ranks = np.array(list(ranks.values()), np.int32)
        self.pattern = regex.compile(
            pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        )
        self.memo = pa.array([], pa.string()), Sequences(np.empty(0, np.int32), np.empty(0, np.int64))

    def product(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair merges to, NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, its merges applied in rank order."""
        found = self.replayed(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        return slices(found.ids.astype("<u4"), found.sizes).to_pylist()

    def replayed(self, data: np.ndarray, lengths: np.ndarray) -> Sequences:
        """The same of words that are the bytes of one array."""
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        # one more position stands for "no neighbour"
        symbol = np.append(self.single[data], -1).astype(np.int32)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[ends - lengths] = n
        after[n] = before[n] = n
        waiting = np.full(n + 1, NONE, np.int32)
        for start in range(0, n, _LOOK):
            some = slice(start, min(n, start + _LOOK))
            waiting[some] = self.product(symbol[some], symbol[after[some]])
        word_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        index: dict[int, list[np.ndarray]] = defaultdict(list)  # by groups of neighbouring ranks
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def note(positions, products):
            real = np.flatnonzero(products < NONE)
            if not len(real):
                return
            positions, products = positions[real], products[real]
            groups = (products >> _GROUP).astype(self.groups)
            order = np.argsort(groups, kind="stable")
            positions, groups = positions[order], groups[order]
            cuts = (np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(groups)]):
                rank = int(groups[start])
                if rank not in index:
                    heapq.heappush(heap, rank)
                index[rank].append(positions[start:end])

        note(np.arange(n, dtype=np.int32), waiting[:n])
        while heap:
            # words are independent: the places of the next ranks are taken together, and each
            # word merges those of its own lowest rank; the others wait
            found, size = [], 0
            while heap and size < _WAVE:
                rank = heapq.heappop(heap)
                for places in index.pop(rank):
                    found.append(places)
                    size += len(places)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            due = waiting[at]
            valid = due <= (rank + 1 << _GROUP) - 1
            valid[1:] &= at[1:] != at[:-1]
            at, due = at[valid], due[valid]
            if not len(at):
                continue
            word = word_of[at]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.repeat(np.minimum.reduceat(due, first), np.diff(np.append(first, len(at))))
            now = due == lowest
            later_at, later_due = at[~now], due[~now]
            at, due = at[now], due[now]
            # of overlapping pairs ("aaa") the left one merges
            runs = np.concatenate(([True], at[1:] != after[at[:-1]]))
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
            even = place % 2 == 0
            at, due = at[even], due[even]
            gone = after[at]
            right = after[gone]
            early = self.product(due, symbol[right])
            symbol[at], symbol[gone], waiting[gone] = due, -1, NONE
            after[at], before[right] = right, at
            before[n] = n
            left = before[at]
            m = len(at)
            both = self.product(symbol[np.concatenate((at, left))], symbol[np.concatenate((right, at))])
            by_right, by_left = both[:m], both[m:]
            waiting[at], waiting[left] = by_right, by_left
            waiting[n] = NONE
            # a new pair of an earlier rank would have gone before the rest of its word
            mixed = np.minimum(np.minimum(early, by_right), by_left) <= due
            if mixed.any():
                odd.append(word_of[at[mixed]])
            note(np.concatenate((at, left, later_at)), np.concatenate((by_right, by_left, later_due)))
        alive = symbol[:n] >= 0
        out = Sequences(symbol[:n][alive], np.add.reduceat(alive, ends - lengths, dtype=np.int64))
        if odd:
            again = np.unique(np.concatenate(odd))
            ids = [self.alone(data[ends[k] - lengths[k] : ends[k]].tobytes()) for k in again.tolist()]
            order = np.arange(len(lengths))
            order[again] = len(lengths) + np.arange(len(again))
            sizes = np.array([len(i) // 4 for i in ids])
            out = (out + Sequences(np.frombuffer(b"".join(ids), "<u4").astype(np.int32), sizes)).take(order)
        return out

    def alone(self, word: bytes) -> bytes:
        """Ids of one word, one merge at a time: the earliest rank first, the leftmost of a rank."""
        rank = self.ranks
        part = [bytes([b]) for b in word]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = []

        def push(i):
            if i >= 0 and after[i] < len(part):
                r = rank.get(part[i] + part[after[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        for i in range(len(part)):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, None, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            push(before[i])
            push(i)
        return np.array([rank[p] for p in part if p is not None], "<u4").tobytes()

    def pieces(self, new: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Matches of the pattern in units, and their number in each."""
        sizes = sizes_of(new)
        data = joined(new)
        ends = np.cumsum(sizes)
        # units that may stand one after the other in a text are matched together
        if len(new) and (data[(ends - sizes)[1:]] == 0x20).all() and _VISIBLE[data[ends[:-1] - 1]].all():
            found = pa.array(self.pattern.findall(data.tobytes().decode()), pa.string())
            stops = np.cumsum(sizes_of(found))
            at = np.searchsorted(stops, ends)
            if len(stops) and stops[-1] == ends[-1] and (stops[at] == ends).all():
                return found, np.diff(at, prepend=-1)
        each = [self.pattern.findall(u) for u in new.to_pylist()]
        return pa.array([p for some in each for p in some], pa.string()), np.array([len(p) for p in each], np.int64)

    def learnt(self, new: pa.Array) -> tuple[pa.Array, Sequences]:
        """Units in another order, and their ids."""
        first = pc.starts_with(new, " ").to_numpy(zero_copy_only=False)
        last = joined(new)[np.cumsum(sizes_of(new)) - 1]
        usual = first & _VISIBLE[last]
        ordered, found, counts = [], [], []
        for some in (usual, ~usual):
            ordered.append(new.filter(pa.array(some)))
            pieces, count = self.pieces(ordered[-1])
            found.append(pieces)
            counts.append(count)
        coded = pa.concat_arrays(found).dictionary_encode()
        distinct = coded.dictionary
        whole = pc.index_in(distinct.cast(pa.binary()), value_set=self.tokens)
        known = whole.is_valid().to_numpy(zero_copy_only=False)
        ranks = self.token_ranks[whole.drop_null().to_numpy()]
        ids = Sequences(ranks, np.ones(len(ranks), np.int64))
        place = np.empty(len(distinct), np.int64)
        place[known] = np.arange(len(ranks))
        if not known.all():
            wanted = distinct.filter(pa.array(~known))
            ids += self.replayed(joined(wanted), sizes_of(wanted))
            place[~known] = len(ranks) + np.arange(len(wanted))
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        return pa.concat_arrays(ordered), ids.take(place[numbers]).together(np.concatenate(counts))

    def encoded(self, texts: pa.Array) -> Sequences:
        """Ids of each text."""
        cut, count = units(texts)
        coded = cut.dictionary_encode()
        del cut
        seen, (known, ids) = coded.dictionary, self.memo
        new = seen.filter(pc.invert(pc.is_in(seen, value_set=known)))
        if len(new):
            new, new_ids = self.learnt(new)
            known, ids = pa.concat_arrays([known, new]), ids + new_ids
        place = pc.index_in(seen, value_set=known).to_numpy(zero_copy_only=False)
        if len(known) > MEMO_WORDS:
            known, ids = seen, ids.take(place)
            place = np.arange(len(seen))
        self.memo = known, ids
        return ids.take(place[coded.indices.to_numpy(zero_copy_only=False)]).together(count)

    def encode(self, block: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        found = self.encoded(pa.array(block, pa.string()))
        return slices(found.ids.astype("<u4"), found.sizes).to_pylist()


def _blocks(batches) -> Iterator[pa.Table]:
    """Rows with texts of about ``BLOCK_CHARS`` bytes; a longer text ends its block."""
    block, size = [], 0
    for part in parts(batches):
        ends = np.cumsum(sizes_of(part.column(1)))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + BLOCK_CHARS - size, side="right")) + 1
            block.append(part.slice(start, stop - start))
            size += int(ends[min(stop, len(ends)) - 1] - before)
            start = stop
            if size > BLOCK_CHARS:
                yield pa.Table.from_batches(block).combine_chunks()
                block, size = [], 0
    if block:
        yield pa.Table.from_batches(block).combine_chunks()


def _encoded(ranks_file, pattern: str):
    def run(batches):
        # a coder for each task: its memo goes with it, as the worker process serves other steps
        coder = MergeReplay(read_ranks(ranks_file.value), pattern)
        for block in _blocks(batches):
            found = coder.encoded(block.column(1).chunk(0))
            doc_ids = block.column(0).chunk(0).cast(pa.int64())
            del block
            yield pa.RecordBatch.from_arrays(
                [doc_ids, slices(found.ids.astype("<u4"), found.sizes)], names=["doc_id", "ids"]
            )

    return run


def _decoded(ranks_file):
    def run(batches):
        ranks = read_ranks(ranks_file.value)
        tokens = pa.array(list(ranks), pa.binary())
        place = np.full(max(ranks.values()) + 1, -1)
        place[list(ranks.values())] = np.arange(len(ranks))
        for part in parts(batches, 1 << 20):
            ids = part.column(1)
            at = place[joined(ids).view("<u4")]
            if (at < 0).any():
                raise ValueError("an id is not in the vocabulary")
            found = tokens.take(pa.array(at))
            stops = np.append(0, np.cumsum(sizes_of(found)))[np.cumsum(sizes_of(ids)) // 4]
            out = slices(joined(found), np.diff(stops, prepend=0))
            if ids.null_count:
                out = pc.if_else(ids.is_valid(), out, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, out], names=["doc_id", "ids", "decoded"])

    return run


def _both(ranks_file, pattern: str):
    """Decodes what was encoded in the same worker: two maps in a row keep two workers for each task."""
    encoded, decoded = _encoded(ranks_file, pattern), _decoded(ranks_file)
    return lambda batches: decoded(encoded(batches))


def _ranks(docs: DataFrame, vocabulary: str):
    # one vocabulary file, under 1 MB whatever the data
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian 32 bits each) of every row of ``docs``.

    Each match of ``pattern`` is encoded by itself; no special tokens. Null and empty
    texts have no ids; ids may be null or repeat, each row is encoded for itself; other
    columns are not read.
    """
    return texts(docs).mapInArrow(_encoded(_ranks(docs, vocabulary), pattern), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` bytes; null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(
        _decoded(_ranks(encoded, vocabulary)), "doc_id long, ids binary, decoded binary"
    )


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Number of tokens, digest of the ids, and digest of what they decode to, by row.

    The narrow result is written while this is called, which gives the workers small batches of
    texts: at the default size JVM and worker each hold up to 10,000 whole texts for every task.
    """
    run = _both(_ranks(docs, vocabulary), pattern)
    digests = texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary").select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return materialize(digests, "token-digests")
