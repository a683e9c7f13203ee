"""Token ids as Simple-8b blocks.

Format: a Parquet dataset, one row per block of whole documents in ascending id order.
``words`` holds 64-bit little-endian words: the top four bits select how many ids of
which width the other 60 bits hold, the first id lowest. Selector 15 is an escape: the
next word is one id of more than 60 bits. ``doc_ids`` and ``lengths`` list the block's
documents, ``first`` is the block's offset: the ids before it in its partition. Blocks
decode by themselves, all words of a selector at once. Parquet is the container because
Spark's writers commit it safely to any store.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from sitefold.llm.common import arrow_batch, id_texts, texts
from sitefold.session import scratch_path

#: Ids per word by selector; the width is 60 // count.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
END_ID = 1
BLOCK_IDS = 1 << 16
MEMO_WORDS = 600_000
#: Characters of text whose distinct words are looked up together.
BLOCK_CHARS = 4_000_000

BLOCK_SCHEMA = (
    "part int, block long, first long, doc_ids array<long>, lengths array<long>, words binary"
)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit ids; each word takes as many ids as fit."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    choice = np.full(n, ESCAPE)
    over = np.zeros(n + 61, np.int32)  # ids before a place that do not fit; the end fits anything
    for selector in range(len(COUNTS) - 1, -1, -1):
        np.cumsum(ids >= np.uint64(1 << int(WIDTHS[selector])), out=over[1 : n + 1])
        over[n + 1 :] = over[n]
        fits = over[COUNTS[selector] :][:n] == over[:n]
        if not fits.any():
            break  # narrower ones cannot fit either
        choice[fits] = selector
    taken = np.append(COUNTS, [1, 1])[choice]
    step = (np.arange(n) + taken).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = step[at]
    starts = np.array(starts, np.int64)
    selectors = choice[starts]
    padded = np.append(ids, np.zeros(60, np.uint64))
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors[selectors != ESCAPE]).tolist():
        mine = np.flatnonzero(selectors == selector)
        width = int(WIDTHS[selector])
        for k in range(COUNTS[selector]):
            words[mine] |= padded[starts[mine] + k] << np.uint64(k * width)
    escaped = selectors == ESCAPE
    if escaped.any():
        words = np.insert(words, np.flatnonzero(escaped) + 1, ids[starts[escaped]])
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of ``words``, all words of a selector at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selectors == ESCAPE).any():
        after = False
        for k, s in enumerate(selectors.tolist()):
            raw[k] = after
            after = s == ESCAPE and not after
    counts = np.append(COUNTS, [0, 0])[selectors]
    counts[raw] = 1
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in range(len(COUNTS)):
        mine = np.flatnonzero((selectors == selector) & ~raw)
        width = int(WIDTHS[selector])
        mask = np.uint64((1 << width) - 1)
        for k in range(COUNTS[selector]) if len(mine) else ():
            out[starts[mine] + k] = words[mine] >> np.uint64(k * width) & mask
    out[starts[raw]] = words[raw]
    return out[:n]


#: Letters of the Latin blocks; a word of these alone is one unit of the tokenizer.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_TAIL = ".,;:!?"


class WordEncoder:
    """Encodes texts word by word through the tokenizer, remembering words.

    The tokenizer splits at white space and normalises no character across it, so the
    ids of a text are those of its words. It also cuts letters from punctuation and lowers
    them, so a word with a tail such as a comma is its small letters and its tail. New words go to the tokenizer
    in long strings. Words of letters end with the one id that carries the word's end;
    other words are divided by a mark, a character that is one token and that none of
    them contains.
    """

    def __init__(self, tokenizer_json: str):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        # words of letters need no normal form and no pattern: the same model, cut at white space
        setup = json.loads(tokenizer_json)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        setup["normalizer"] = None
        setup["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}
        self.plain = Tokenizer.from_str(json.dumps(setup))
        self.plain.encode_special_tokens = True
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        marks = ((c, self._ids(self.tokenizer, [c])[0]) for c in "§¶¬¤†‡•")
        self.mark, self.mark_id = next((c, i[0]) for c, i in marks if len(i) == 1)

    def _ids(self, tokenizer: Tokenizer, strings: list[str]) -> list[np.ndarray]:
        found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _letters(self, words: list[str]) -> None:
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        for group, ids in zip(groups, self._ids(self.plain, [" ".join(g) for g in groups])):
            data, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            for word, a, b in zip(group, [0, *cuts], cuts, strict=False):
                self.memo[word] = data[a:b]
            assert len(cuts) == len(group)

    def _others(self, words: list[str]) -> None:
        marked = [w for w in words if self.mark in w]
        words = [w for w in words if self.mark not in w]
        for word, ids in zip(marked, self._ids(self.tokenizer, marked)):
            self.memo[word] = ids.tobytes()
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        joined = [f" {self.mark} ".join(g) for g in groups]
        for group, ids in zip(groups, self._ids(self.tokenizer, joined)):
            data, cuts = ids.tobytes(), (np.flatnonzero(ids == self.mark_id) * 4).tolist()
            starts = [0, *[c + 4 for c in cuts]]
            for word, a, b in zip(group, starts, [*cuts, len(data)], strict=True):
                self.memo[word] = data[a:b]

    def learn(self, new: list[str]) -> None:
        memo, letters, others = self.memo, set(), set()
        whole, heads, tails = [], [], []
        for word in new:
            head = word.rstrip(_TAIL)
            if head.isalpha() and (head.isascii() or _PLAIN.fullmatch(head)):
                small = head.lower()  # as the tokenizer does; of these blocks one letter stays one
                if small not in memo:
                    letters.add(small)
                if small != word:
                    whole.append(word)
                    heads.append(small)
                    tails.append(word[len(head) :])
            else:
                others.add(word)
        others.update(t for t in set(tails) if t not in memo)
        self._letters(list(letters))
        self._others(list(others))
        for word, head, tail in zip(whole, heads, tails):
            memo[word] = memo[head] + memo[tail]

    def encode(self, block: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = pc.split_pattern(pc.replace_substring(pa.array(block, pa.string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo, words = self.memo, coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in words if w not in memo]
        if new:
            self.learn(new)
        known = list(map(memo.__getitem__, words))
        # ids of the distinct words side by side, then those of each word taken by its place
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        sizes = size[at]
        ends = np.cumsum(sizes)
        take = np.repeat(first[at] - ends + sizes, sizes)
        take += np.arange(len(take))
        ids = np.frombuffer(b"".join(known), "<u4")[take].tobytes()
        stops = np.append(0, ends * 4)[cut.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(stops, stops[1:])]


_encoders: dict[int, WordEncoder] = {}


def _encoder(tokenizer_json: bytes) -> WordEncoder:
    """The encoder of this worker process; its memo serves later tasks too."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    key = zlib.crc32(tokenizer_json)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(tokenizer_json.decode())
    return _encoders[key]


def _gathered(batches):
    """Lists of rows with about ``BLOCK_CHARS`` characters, or one longer row at their end."""
    held, size = [], 0
    for rows in id_texts(batches):
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= BLOCK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _blocks(tokenizer_json, end_id: int):
    def run(batches):
        coder = _encoder(tokenizer_json.value)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, data, held = [], [], [], 0
        ends = np.array([end_id], "<u4").tobytes()
        schema = pa.schema(
            [("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()),
             ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
             ("words", pa.binary())]
        )

        def block():
            words = pack(np.frombuffer(b"".join(data), "<u4")).astype("<u8").tobytes()
            return arrow_batch(schema, [[part], [number], [before], [docs], [lengths], [words]])

        for rows in _gathered(batches):
            for (doc_id, _), ids in zip(rows, coder.encode([t for _, t in rows])):
                docs.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                data += [ids, ends]
                held += lengths[-1]
                if held >= BLOCK_IDS:
                    yield block()
                    before, number = before + held, number + 1
                    docs, lengths, data, held = [], [], [], 0
        if docs:
            yield block()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encodes every text of ``docs``, appends ``end_id`` to each and writes blocks to ``path``.

    Rows are dealt by ranges of ``doc_id`` and sorted inside them, null ids first, so the
    blocks of ascending ``part`` and ``block`` hold ascending ids. Null texts are empty and
    consist of the end id; rows that repeat an id are each written, next to each other.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:  # one vocabulary file of a fixed size
        vocabulary = spark.sparkContext.broadcast(f.read())
    (
        texts(docs)
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(_blocks(vocabulary, end_id), BLOCK_SCHEMA)
        .write.parquet(path)
    )


def _read_documents(batches):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )
    for batch in batches:
        for k in range(batch.num_rows):
            (r,) = batch.slice(k, 1).to_pylist()
            ends = np.cumsum([0, *r["lengths"]])
            data = unpack(np.frombuffer(r["words"], "<u8"), int(ends[-1])).astype("<u4").tobytes()
            ids = [data[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            starts = (ends[:-1] + r["first"] + r["before"]).tolist()
            yield arrow_batch(schema, [r["doc_ids"], starts, r["lengths"], ids])


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian 32-bit) of every document in ``path``.

    ``start`` counts the ids of all documents before it. Only the totals of the partitions,
    one number each, are summed in order.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    totals = blocks.groupBy("part").agg(F.sum(size).alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    # one row for each task of the write
    totals = F.broadcast(totals.select("part", before.alias("before")))
    return (
        blocks.join(totals, "part")
        .select("first", "before", "doc_ids", "lengths", "words")
        .mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids binary")
    )


def write_and_read(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` as token blocks and returns what the files hold.

    ``doc_id, start, n_tokens`` and ``ids_crc32``. An empty table gives no rows.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path)
    found = read(docs.sparkSession, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
