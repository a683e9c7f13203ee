"""Token counts of a unigram vocabulary, without building tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a word; dynamic programming
over their ends carries the best score and the number of pieces. Ties go as in the
tokenizer: of equal scores the longest last piece wins. Words are counted once per task
and remembered; a text's count is the sum over its words.
"""

from __future__ import annotations

import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from sitefold.llm.common import arrow_batch, id_texts, texts

#: Score of an unknown character below the worst piece: fixed value of the unigram model.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
MEMO_WORDS = 300_000


class ViterbiCounter:
    """Counts pieces of the best segmentation under ``(piece, score)`` pairs.

    A character that no piece matches by itself may be skipped at the penalty; it then
    counts as its UTF-8 bytes (byte fallback), or a run of them as one unknown piece.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.memo: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """``(pieces, unknown characters)`` of one word."""
        n = len(word)
        best = [0.0] + [None] * n
        # pieces, unknown characters, and whether the last piece is unknown
        state = [(0, 0, False)] + [None] * n
        unknown = {k for k, c in enumerate(word) if c not in self.single}

        def skip(end: int) -> None:
            """The character before ``end`` as an unknown one; weaker than equal matches."""
            start = end - 1
            if start in unknown and best[start] is not None:
                score = best[start] + self.unknown
                if best[end] is None or score > best[end]:
                    count, skipped, last = state[start]
                    more = len(word[start].encode()) if self.byte_fallback else int(not last)
                    best[end], state[end] = score, (count + more, skipped + 1, True)

        done = 0
        for at, (size, gain) in self.automaton.iter(word):
            while done < at:  # ends without any further match
                done += 1
                skip(done)
            start = at + 1 - size
            if best[start] is None:
                continue
            score = best[start] + gain
            if best[at + 1] is None or score > best[at + 1]:
                count, skipped, _ = state[start]
                best[at + 1], state[at + 1] = score, (count + 1, skipped, False)
        while done < n:
            done += 1
            skip(done)
        return state[n][:2]

    def text(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        pieces = skipped = 0
        memo = self.memo
        # a word begins at each mark; the first gets one unless the text begins with it
        words = text.replace(" ", MARK).split(MARK)
        for word in words if words[0] else words[1:]:
            found = memo.get(word)
            if found is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                found = memo[word] = self.word(MARK + word)
            pieces += found[0]
            skipped += found[1]
        return pieces, skipped


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file that text can match.

    Control, unknown and byte pieces are not among them.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    return [
        (model.id_to_piece(k), model.get_score(k))
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    ]


_counters: dict[int, ViterbiCounter] = {}


def _counter(key: int, pieces, byte_fallback: bool) -> ViterbiCounter:
    """The counter of this worker process; its memo serves later tasks too."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = ViterbiCounter(pieces, byte_fallback)
    return _counters[key]


def token_counts(
    docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True
) -> DataFrame:
    """``doc_id, n_tokens, n_unknown`` of every row of ``docs`` under a unigram vocabulary.

    The text is marked as unigram tokenizers do: a mark before the text and for each space;
    no piece crosses into the next mark. ``n_unknown``: characters without a piece. Null
    and empty texts have no tokens; ids may be null or repeat; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast((list(pieces), byte_fallback))
    key = zlib.crc32(repr(known.value).encode())

    def run(batches):
        counter = _counter(key, *known.value)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])
        for rows in id_texts(batches):
            counts = [counter.text(t) for _, t in rows]
            yield arrow_batch(
                schema, [[d for d, _ in rows], [c for c, _ in counts], [u for _, u in counts]]
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_unknown long")
