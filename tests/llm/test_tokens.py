"""BPE replay, token blocks and token counts against the public libraries."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from sitefold.llm import bpe, token_counts as tc, token_output as to

PARTS = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'", "²", "中", "\x1c", "　", "\xa0", "!!", "12", "ing", "the",
         "aaaa", "́", "😀", "\x85", "AAA", " a", "İ", "Σ", "\u2003", "\u1680", "\u2028", "\u200b", "<|endoftext|>", "§", "word.", "x,y", "▁"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return texts + ["a" * 3000, " " * 2000, "x\n " * 50, "the quick brown fox " * 400]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.read_ranks(f.read())


def test_bpe_query_columns(make_docs, ranks):
    texts = random_texts(400)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.round_trip(make_docs(list(enumerate(texts))), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for r in found.collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha256(texts[r["doc_id"]].encode()).hexdigest()


def plain_bpe(word, ranks):
    """The rule itself: the earliest rank, the leftmost place, one merge at a time."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 10**9), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 10**9:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def test_replay_with_ranks_in_any_order():
    """Vocabularies whose longer tokens may come first, so that words have to be replayed alone."""
    rng = random.Random(8)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        tokens += list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
        numbers = list(range(len(tokens)))
        rng.shuffle(numbers)
        ranks = dict(zip(tokens, numbers))
        coder = bpe.MergeReplay(ranks, P.PATTERN)
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14))) for _ in range(60)]
        for word, found in zip(words, coder.replay(words)):
            assert np.frombuffer(found, "<u4").tolist() == plain_bpe(word, ranks)


def test_memo_is_emptied(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    coder = bpe.MergeReplay(ranks, P.PATTERN)
    first = [coder.encode([t]) for t in random_texts(50)]
    assert first == [coder.encode([t]) for t in random_texts(50)]


def test_units_are_matched_together(ranks):
    """The pattern runs over the new words of a block at once, not over each of them."""
    coder = bpe.MergeReplay(ranks, P.PATTERN)
    real, calls = coder.pattern, []
    coder.pattern = type("Counted", (), {"findall": lambda self, text: calls.append(text) or real.findall(text)})()
    texts = [" ".join(f"w{k}x{j}'s" for j in range(50)) + "\n\u3000 end " for k in range(20)]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert coder.encode(texts) == wanted
    assert len(calls) < 50
    assert coder.encode(texts) == wanted  # from the memo


def test_blocks_of_any_size(ranks, monkeypatch):
    texts = ["", *random_texts(60), ""]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        value = type("Value", (), {"value": f.read()})()
    batch = pa.record_batch([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for size in (1, 100, 10**6):
        monkeypatch.setattr(bpe, "BLOCK_CHARS", size)
        out = pa.Table.from_batches(bpe._both(value, P.PATTERN)(iter([batch.slice(0, 30), batch.slice(30)])))
        assert out["doc_id"].to_pylist() == batch.column(0).to_pylist()
        assert out["ids"].to_pylist() == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
        assert out["decoded"].to_pylist() == [t.encode() for t in texts]


def test_decoding_keeps_nulls(spark, ranks):
    rows = [(1, None), (2, b""), (3, np.array([ranks[b"a"], ranks[b"the"]], "<u4").tobytes())]
    found = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), P.path("byte_bpe_50k.tiktoken"))
    assert {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in found.collect()} == {1: None, 2: b"", 3: b"athe"}


def test_token_blocks_hold_what_the_library_says(spark, make_docs, monkeypatch, tmp_path):
    texts = random_texts(300, seed=4)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = make_docs([(7 * k, texts[k]) for k in order])
    found = to.write_and_read(docs, P.path("word_bpe_49k.json"), str(tmp_path / "tokens"))
    start = 0
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    for k, r in enumerate(rows):
        ids = np.array([*library.encode(texts[k], add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (7 * k, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)
    blocks = spark.read.parquet(str(tmp_path / "tokens")).orderBy("part", "block").collect()
    assert [d for b in blocks for d in b["doc_ids"]] == [r["doc_id"] for r in rows]


def test_simple8b_round_trip():
    rng = random.Random(9)
    for _ in range(400):
        ids = [rng.randrange(1 << rng.choice([1, 1, 2, 3, 5, 8, 16, 30, 59, 60, 61, 64])) for _ in range(rng.randint(0, 200))]
        ids = np.array(ids, np.uint64)
        assert (to.unpack(to.pack(ids), len(ids)) == ids).all()
    assert len(to.pack(np.zeros(120, np.uint64))) == 2
    assert len(to.pack(np.full(9, 2**20 - 1, np.uint64))) == 3
    assert len(to.pack(np.array([2**63], np.uint64))) == 2  # an escape and the id


def library_counter(pieces, byte_fallback):
    pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + pieces
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_match_the_library(make_docs, byte_fallback):
    pieces = tc.pieces_of(P.path("piece_bpe_32k.model"))
    texts = random_texts(400, seed=5)
    count = library_counter(pieces, byte_fallback)
    found = tc.token_counts(make_docs(list(enumerate(texts))), pieces, byte_fallback)
    assert all(r["n_tokens"] == count(texts[r["doc_id"]]) for r in found.collect())


def test_ties_go_as_in_the_library():
    rng = random.Random(4)
    pieces = [(x, -1.0 * len(x)) for x in ("a", "b", "ab", "aa", "aab", "ba", "▁", "▁a", "bb", "▁ab")]
    count, counter = library_counter(pieces, False), tc.ViterbiCounter([("<unk>", 0.0), *pieces], False)
    for _ in range(2000):
        text = "".join(rng.choice("aabb zé") for _ in range(rng.randint(0, 14)))
        assert counter.text(text)[0] == count(text), text


def test_round_trip_is_written_with_small_batches(make_docs):
    """What is left is a scan: a caller's later write cannot hand whole partitions to the workers."""
    found = bpe.round_trip(make_docs([(1, "some text"), (None, None)]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert found.inputFiles()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found.collect()) == [(0, 0), (1, 2)]


def test_the_memo_keeps_to_its_size(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    coder = bpe.MergeReplay(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k in range(5):
        text = " ".join(f"w{k}x{i} common{i % 2}" for i in range(4))
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
        assert len(coder.memo) <= 10


def test_merges_of_many_words_go_together(monkeypatch):
    """In far fewer steps than there are ranks, with the merges of each word in rank order."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.MergeReplay(bpe.read_ranks(f.read()), P.PATTERN)
    rng = random.Random(11)
    words = ["".join(rng.choice("aaabeinrstéß.-") for _ in range(rng.randint(1, 30))).encode() for _ in range(4000)]
    words += [b"a" * k for k in range(1, 60)]
    steps, product = [], coder.product
    monkeypatch.setattr(coder, "product", lambda a, b: steps.append(1) or product(a, b))
    assert coder.replay(words) == [coder.alone(w) for w in words]
    assert len(steps) < 400
