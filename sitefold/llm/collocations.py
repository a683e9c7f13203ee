"""Phrase collocations by sampling with a negative border, exact over all texts.

A sample of the documents proposes phrases: those that are frequent in it at a lowered
threshold. A pass over all documents counts them together with their negative border: the
phrases that were not proposed themselves but consist of proposed ones, that is all words,
and every longer phrase whose two parts without its last and its first word were proposed.
A frequent phrase of the border is a failure of the sample. If a failure can grow, one
further pass counts what the border gains: there the failures are proposals too, and so is every
phrase that the first pass did not count, so no border is left. Every frequent phrase
has then been counted, as all its parts are frequent.

How it scales:

* The proposal is a bit filter of hashes, sized by their number up to 2**27 bits (16 MB),
  whatever the corpus. A phrase that passes by chance is counted needlessly, no more.
* A task hashes the phrases of a few megabytes of text at a time in numpy, place by place, and counts
  them by sorting. Counts leave it by ranges of hashes, a row for each range, which Spark
  shuffles; a range of all tasks is summed together. The ranges grow in number with the
  shuffle's partitions. These counts are by hash: two phrases of one hash can only be
  taken for frequent together.
* The last pass counts the phrases whose hash is frequent once more, by their words, with the
  same ranges; all results come from these exact counts.
* Scores join a phrase to the counts of its parts; common words are hot there, hence the salted
  join. The first phrases of a language are limited before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitefold.llm.common import release_memory
from sitefold.session import left_join_salted, materialize

# --- fixed values -----------------------------------------------------------
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
NO_LANG = "und"
# ----------------------------------------------------------------------------

MOST_WORDS, LEAST_COUNT, TOP = 3, 10, 2000
#: A candidate goes if a longer one that holds it has this percentage of its count.
COVERED = 50
#: The sample holds one in so many documents.
SAMPLE = 8
LEAST_BITS, MOST_BITS = 20, 27
#: Bytes of text that are counted at a time.
CHUNK_BYTES = 3_000_000
#: Hashes of places of one length that a task holds before it counts them, and phrases that it
#: holds before it adds up those of its chunks.
PENDING = 2_500_000
PENDING_PHRASES = 1_000_000
LEAST_PARTS = 128
_BITMAP_BITS = 32768  # bits of one bitmap of bitmap_construct_agg
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Kind of every byte: 0 of a word, 1 a blank, 2 a break.
_KIND = bytes(2 if b in BREAKS else 1 if b in BLANKS else 0 for b in range(256))
_LOWER = bytes(range(256)).lower()


class HashFilter:
    """Hashes as bits of an array that does not grow with the corpus."""

    def __init__(self, bits: int, flags: np.ndarray | None = None):
        self.bits = bits
        self.flags = np.zeros(1 << (bits - 3), np.uint8) if flags is None else flags

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1

    def joined(self, other: "HashFilter") -> "HashFilter":
        return HashFilter(self.bits, self.flags | other.flags)

    def broadcast(self, spark: SparkSession):
        return spark.sparkContext.broadcast((self.bits, self.flags))


def make_filter(hashes: DataFrame, bits: int) -> HashFilter:
    """The filter of the column ``hash``: at most 2**27 bits reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    parts = (
        hashes.select(place.alias("at"))
        .groupBy(F.shiftright("at", 15).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("at") % _BITMAP_BITS).cast("int")).alias("bits"))
    )
    made = HashFilter(bits)
    for row in parts.collect():
        piece = np.frombuffer(row["bits"], np.uint8)
        start = row["part"] * (_BITMAP_BITS // 8)
        made.flags[start : start + len(piece)] = piece
    return made


def filter_bits(entries: int) -> int:
    """Sixteen bits for each entry, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, ceil(log2(16 * max(1, entries)))))


class Places:
    """The words of some texts, and the hash of the phrase of ``n`` words that begins at each.

    ``alive`` tells whether there is one that stays within its piece and is looked at.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array):
        one = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
        raw = pc.binary_join(one, "\n")[0].as_buffer().to_pybytes()
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        within = np.zeros(len(kind) + 2, bool)
        np.equal(kind, 0, out=within[1:-1])
        edges = np.flatnonzero(within[1:] != within[:-1])
        starts, ends = edges[::2], edges[1::2]
        # words of one piece have the same number of breaks before them
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        # words of each text, told by the place where the text ends
        stops = np.searchsorted(starts, np.cumsum(lengths + 1))
        lang_codes = langs.dictionary_encode()
        self.langs = lang_codes.dictionary.to_pylist()
        codes = lang_codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang_of = np.repeat(codes, np.diff(stops, prepend=0))
        # the words without what lies between them, as a string array over one buffer
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(offsets), pa.py_buffer(raw.translate(_LOWER, BREAKS + BLANKS))
        ).dictionary_encode()
        self.words = words.dictionary
        self.word_of = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang_hash = np.array([xxhash.xxh3_64_intdigest(v, seed=1) for v in self.langs], np.uint64)
        self.token_hash = _mixed(lang_hash[self.lang_of], _text_hashes(self.words)[self.word_of])
        self.hashes = self.token_hash
        self.alive = np.ones(len(starts), bool)
        self.n = 1

    def grow(self, good: np.ndarray) -> None:
        """To phrases of one word more, both of whose parts are ``good`` (by place)."""
        self.alive = good[:-1] & good[1:] & (self.piece[: -self.n] == self.piece[self.n :])
        self.hashes = _mixed(self.hashes[:-1], self.token_hash[self.n :])
        self.n += 1


class Grams(Places):
    """Phrases by length, as numbers without repeats; only ``wanted`` ones if that is given.

    ``ids[k]`` is the number of the phrase that begins at word k, -1 where none is looked at.
    ``first`` has a place of each number.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array, wanted: HashFilter | None = None):
        super().__init__(langs, texts)
        self.wanted = wanted
        size = max(1, len(self.words))
        _, _, self.token_ids = _numbered(self.lang_of * size + self.word_of)
        self.tokens = int(self.token_ids.max(initial=0)) + 1
        self._number(self.token_ids)

    def _number(self, phrases: np.ndarray) -> None:
        at = np.flatnonzero(self.alive)
        if self.wanted:
            at = at[self.wanted.holds(self.hashes[at])]
        _, first, number = _numbered(phrases[at])
        self.ids = np.full(len(self.hashes), -1, np.int64)
        self.ids[at] = number
        self.first = at[first]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes[self.first]

    def counts(self) -> np.ndarray:
        return np.bincount(self.ids[self.ids >= 0], minlength=len(self.first))

    def grow(self, passes: np.ndarray) -> None:
        """To phrases of one word more, both of whose parts pass (``passes``: by number)."""
        good = np.zeros(len(self.ids), bool)
        known = self.ids >= 0
        good[known] = passes[self.ids[known]]
        phrases = self.ids[:-1] * self.tokens + self.token_ids[self.n :]
        super().grow(good)
        self._number(phrases)

    def phrases(self, numbers: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and texts of phrases."""
        at = self.first[numbers]
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang_of[at]))
        parts = [self.words.take(pa.array(self.word_of[at + k])) for k in range(self.n)]
        return langs, parts[0] if self.n == 1 else pc.binary_join_element_wise(*parts, " ")


def _text_hashes(words: pa.Array) -> np.ndarray:
    """64-bit polynomials of the bytes of words that are not empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.concatenate(([0], ends[:-1]))
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    data = np.frombuffer(pc.binary_join(one, "")[0].as_buffer(), np.uint8).astype(np.uint64)
    sizes = ends - starts
    powers = np.cumprod(np.full(sizes.max(), _MIX, np.uint64))
    places = np.arange(len(data)) - np.repeat(starts, sizes)
    return np.add.reduceat((data + np.uint64(1)) * powers[places], starts)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, and the number of each value among them."""
    if len(values) and values.max() < 8 * len(values):  # few enough to be marked
        marked = np.zeros(int(values.max()) + 1, bool)
        marked[values] = True
        distinct, numbers = np.flatnonzero(marked), (np.cumsum(marked) - 1)[values]
    else:
        distinct, numbers = np.unique(values, return_inverse=True)
    place = np.empty(len(distinct), np.int64)
    place[numbers] = np.arange(len(values))
    return distinct, place, numbers


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two arrays of hashes."""
    out = (a * _MIX) ^ (a >> np.uint64(29))
    out = (out + b) * _MIX
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _chunks(batches: Iterator[pa.RecordBatch], kind=Places) -> Iterator[Places]:
    """Texts of about ``CHUNK_BYTES`` together; a longer text is one chunk."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            part = batch.slice(start, stop - start)
            yield kind(part.column(0), part.column(1))
            start = stop


def _part_bits(spark: SparkSession) -> int:
    """Leading bits of a hash that tell its range: as many ranges as partitions of a shuffle, or more.

    A task makes a row for each, so many more would cost rows where there are many small tasks.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ceil(log2(max(LEAST_PARTS, parts)))


def _cut(sorted_hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that occur, and where each of them ends."""
    ranges = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int32)
    ends = np.append(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, len(ranges))
    return ranges[ends - 1], ends


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array, one after the other, as binary values."""
    offsets = np.append(0, ends * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _low(least: int) -> np.uint64:
    """The low bits of a hash that give way to a count of up to ``least``."""
    return np.uint64((1 << int(least).bit_length()) - 1)


def _totals(counts: np.ndarray, low: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and their totals, from hashes with counts in their low bits."""
    counts.sort()
    hashes = counts & ~low
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[starts], np.add.reduceat(counts & low, starts)


def _count_hashes(most_words: int, least: int, bits: int, now=None, before=None):
    """Counts by hash up to ``least``, in its low bits, a row for each range of hashes.

    ``now`` (a broadcast filter) tells which phrases may grow. What already grew with
    ``before`` is not counted again, nor are words then; what did not may grow.
    """
    low = _low(least)

    def rows(words: int, pending: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, pending)):
            hashes, n = _totals(np.concatenate(pending), low)
            ranges, ends = _cut(hashes, bits)
            counts = _binaries(hashes | np.minimum(n, np.uint64(least)), ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges), pa.array(np.full(len(ranges), words, np.int32)), counts],
                names=["part", "words", "counts"],
            )
        pending.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = now and HashFilter(*now.value)
        earlier = before and HashFilter(*before.value)
        pending: list[list[np.ndarray]] = [[] for _ in range(most_words + 1)]
        for places in _chunks(batches):
            counted = places.alive if earlier else None  # by place, in an earlier pass
            for n in range(1, most_words + 1):
                if n > 1:
                    good = places.alive
                    if border:
                        good = good & border.holds(places.hashes)
                    if earlier:
                        good |= places.alive & ~counted
                        counted = counted & earlier.holds(places.hashes)
                        counted = counted[:-1] & counted[1:]
                    places.grow(good)
                    if earlier:
                        counted &= places.alive
                fresh = places.alive & ~counted if earlier else places.alive
                pending[n].append(places.hashes[fresh] & ~low | np.uint64(1))
                if sum(map(len, pending[n])) > PENDING:
                    yield from rows(n, pending[n])
        for n, hashes in enumerate(pending):
            yield from rows(n, hashes)
        release_memory()

    return run


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _frequent(least: int):
    """Hashes of one range that occur ``least`` times or more."""
    low = _low(least)

    def run(group: pa.Table) -> pa.Table:
        hashes, n = _totals(np.frombuffer(bytearray(_joined(group["counts"])), np.uint64), low)
        found = hashes[n >= least].view(np.int64)
        words = pa.array(np.full(len(found), group["words"][0].as_py(), np.int32))
        return pa.table([words, pa.array(found)], names=["words", "hash"])

    return run


def _count_phrases(most_words: int, frequent, bits: int):
    """Exact counts, by language and words, of the phrases whose hash may be frequent, and of
    all words of a language (no phrase): a row for each range of hashes, with the keys
    (:func:`_key`) as one text, their lengths and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = HashFilter(*frequent.value)

        pending: list[pa.Table] = []

        def note(langs, phrases, counts, hashes):
            keys = pc.binary_join_element_wise(langs, phrases, "\n")
            pending.append(pa.table([keys, pa.array(hashes), pa.array(counts)], names=["key", "hash", "n"]))

        def rows() -> Iterator[pa.RecordBatch]:
            if sum(map(len, pending)):
                summed = pa.concat_tables(pending).group_by("key").aggregate([("hash", "min"), ("n", "sum")])
                hashes = summed["hash_min"].to_numpy()
                order = np.argsort(hashes)
                summed = summed.take(pa.array(order)).combine_chunks()
                keys = summed["key"].chunk(0)
                sizes = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype("<i4")
                text = np.frombuffer(keys.buffers()[2], np.uint8)
                ranges, ends = _cut(hashes[order], bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ranges),
                        _binaries(text, np.cumsum(sizes, dtype=np.int64)[ends - 1]),
                        _binaries(sizes, ends),
                        _binaries(summed["n_sum"].to_numpy().astype("<i8"), ends),
                    ],
                    names=["part", "keys", "sizes", "counts"],
                )
            pending.clear()

        for grams in _chunks(batches, lambda langs, texts: Grams(langs, texts, wanted)):
            langs = pa.array(grams.langs, pa.string())
            lang_hash = np.array([xxhash.xxh3_64_intdigest(v) for v in grams.langs], np.uint64)
            totals = np.bincount(grams.lang_of, minlength=len(langs))
            note(langs, pa.array([""] * len(langs)), totals, lang_hash)
            for n in range(1, most_words + 1):
                if n > 1:
                    grams.grow(np.ones(len(grams.first), bool))
                note(*grams.phrases(np.arange(len(grams.first))), grams.counts(), grams.hash)
            if sum(map(len, pending)) > PENDING_PHRASES:
                yield from rows()
        yield from rows()
        release_memory()

    return run


def _sum_phrases(least: int):
    """Exact counts of one range; those of a phrase below ``least`` are left out."""

    def run(group: pa.Table) -> pa.Table:
        sizes = np.frombuffer(_joined(group["sizes"]), "<i4")
        offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
        keys = pa.LargeStringArray.from_buffers(
            len(sizes), pa.py_buffer(offsets), pa.py_buffer(_joined(group["keys"]))
        )
        counts = pa.array(np.frombuffer(_joined(group["counts"]), "<i8"))
        summed = pa.table([keys, counts], names=["key", "n"]).group_by("key").aggregate([("n", "sum")])
        key, n = summed["key"], summed["n_sum"]
        kept = pc.or_(pc.greater_equal(n, least), pc.ends_with(key, "\n"))
        return pa.table([key.filter(kept).cast(pa.string()), n.filter(kept)], names=["key", "n"])

    return run


def frequent_hashes(
    spark: SparkSession, texts: DataFrame, sample: DataFrame, most_words: int, least_count: int, share: int
) -> DataFrame:
    """``hash`` of every phrase of ``texts`` with ``least_count`` occurrences or more, and its ``words``.

    A few others may share one of these hashes, whose low bits are 0. ``sample`` holds one in
    ``share`` of the texts.
    """
    bits = _part_bits(spark)

    def frequent(docs, least, name, now=None, before=None):
        counted = docs.mapInArrow(
            _count_hashes(most_words, least, bits, now, before), "part int, words int, counts binary"
        )
        found = counted.groupBy("part", "words").applyInArrow(_frequent(least), "words int, hash long")
        return materialize(found, name)

    proposed = frequent(sample, max(2, int(0.8 * least_count / share)), "proposed")
    # the filter has room for the proposal and what the whole corpus adds to it
    size = filter_bits(4 * proposed.count())
    border = make_filter(proposed, size)
    before = border.broadcast(spark)
    found = frequent(texts, least_count, "frequent", before)
    # what is frequent and was not proposed; a bit that is set by chance has been treated
    # as a proposal throughout, and the longest phrases do not grow
    after = border.joined(make_filter(found.filter(F.col("words") < most_words), size))
    if np.array_equal(after.flags, border.flags):
        return found
    return found.union(frequent(texts, least_count, "frequent", after.broadcast(spark), before))


def count_table(
    docs: DataFrame, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, share: int = SAMPLE
) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``n`` of all phrases of up to ``most_words`` words
    that occur ``least_count`` times or more in their language, and one row with 0
    ``words`` and no phrase for each language with the number of all its words."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    texts = docs.select(lang, text)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).select(lang, text)
    hashes = frequent_hashes(spark, texts, sample, most_words, least_count, share)
    frequent = make_filter(hashes, filter_bits(hashes.count())).broadcast(spark)
    bits = _part_bits(spark)
    counted = texts.mapInArrow(
        _count_phrases(most_words, frequent, bits), "part int, keys binary, sizes binary, counts binary"
    )
    # a phrase holds no line end, a language may
    phrase = F.substring_index("key", "\n", -1)
    counted = (
        counted.groupBy("part")
        .applyInArrow(_sum_phrases(least_count), "key string, n long")
        .select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "n")
        .select(
            "lang",
            F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"),
            F.nullif("phrase", F.lit("")).alias("phrase"),
            "n",
        )
    )
    return materialize(counted, "phrase-counts")


def _key(lang, phrase):
    """One text for a phrase of a language; phrases hold no line end."""
    return F.concat(lang, F.lit("\n"), phrase)


def scored(counts: DataFrame) -> DataFrame:
    """Candidates of two words or more with ``l``, ``r`` and ``score`` of their weakest cut.

    The score is floor(1000000 * a * a / (l * r)) in decimals, which hold 38 digits.
    """
    by_key = counts.filter("words > 0").select(_key(F.col("lang"), F.col("phrase")).alias("key"), "n")
    words = F.split("phrase", " ")
    cuts = (
        counts.filter("words > 1")
        .select(
            "lang", "words", "phrase", F.col("n").alias("a"), words.alias("w"),
            F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"),
        )
        .select(
            "lang", "words", "phrase", "a", "cut",
            _key(F.col("lang"), F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ")).alias("left_key"),
            _key(F.col("lang"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words") - F.col("cut")), " ")).alias("right_key"),
        )
    )
    left = by_key.select(F.col("key").alias("left_key"), F.col("n").alias("l"))
    right = by_key.select(F.col("key").alias("right_key"), F.col("n").alias("r"))
    with_left = materialize(left_join_salted(materialize(cuts, "cuts"), left, "left_key", "phrase"), "left-counts")
    with_both = left_join_salted(with_left, right, "right_key", "phrase")
    score = F.expr(
        "cast((cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0)) * 1000000)"
        " div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0))) AS long)"
    )
    return (
        with_both.withColumn("score", score)
        .groupBy("lang", "words", "phrase", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
        .select("lang", "words", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
    )


def covering(counts: DataFrame, most_words: int) -> DataFrame:
    """For each phrase inside a longer candidate the largest count of such a candidate."""
    def inner(size: int):
        starts = F.sequence(F.lit(1), F.col("words") - size + 1)
        found = F.transform(starts, lambda at: F.array_join(F.slice("w", at, F.lit(size)), " "))
        return F.when(F.col("words") > size, found).otherwise(F.array().cast("array<string>"))

    return (
        counts.filter("words > 2")
        .select("lang", "words", "n", F.split("phrase", " ").alias("w"))
        .select("lang", "n", F.explode(F.flatten(F.array(*map(inner, range(2, most_words))))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("n").alias("longer"))
    )


def collocations(
    docs: DataFrame,
    most_words: int = MOST_WORDS,
    least_count: int = LEAST_COUNT,
    top: int = TOP,
    covered: int = COVERED,
    sample: int = SAMPLE,
) -> DataFrame:
    """The first ``top`` phrases of every language of ``docs`` (``doc_id``, ``text``, ``lang``).

    Texts (null: empty) in lower case (A to Z only) are cut into pieces at ``BREAKS`` and these
    into words at blanks and tabs; a null language is ``und``, like one of that name. ``a``:
    occurrences of the phrase within pieces, overlapping ones included; ``l``, ``r``: those of
    its parts at the cut with the lowest score, the first of such cuts; ``n``: all words of the
    language. Phrases inside a longer candidate with ``covered`` percent of their count are left
    out. Order: score, ``a`` (both descending), phrase in bytes. Repeated rows count each;
    rows without an id count too. Texts of any length are read whole. Other columns are not
    read. Without a phrase that occurs ``least_count`` times there are no rows.
    """
    if most_words < 2:
        raise ValueError("a phrase has two words or more")
    counts = count_table(docs, most_words, least_count, sample)
    found = scored(counts)
    if most_words > 2:
        kept = found.join(covering(counts, most_words), ["lang", "phrase"], "left").filter(
            F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered)
        )
    else:
        kept = found
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
