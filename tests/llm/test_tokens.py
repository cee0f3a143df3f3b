"""Packing and token files: exact round trips."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from varisel.llm import packing, token_output
from varisel.llm.queries import word_bpe
from varisel.llm.tokens import ChunkEncoder, gathered


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_bpe())
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids + [2], "<u4")


def test_encoder_equals_the_library(ids_of, texts):
    odd = ["don't 'T !'s “x”— 'S é́ İ ẞ ǅ", "A.b,C.'d x''' .'s !!!a 12ab3", "a <|endoftext|> B<|STARTOFTEXT|>", "x y\u0085z\x1c", "word" * 5000, None, "", "  "]
    given = [t for _, t in texts] + odd
    want = [ids_of(t) for t in given]
    for cache in (24 << 20, 2000):
        first, got, n = zip(*ChunkEncoder(word_bpe(), 2, cache_bytes=cache, part=500).parts(pa.array(given)), strict=True)
        assert list(first) == [0, *np.cumsum([len(x) for x in n])[:-1]]
        assert np.concatenate(n).tolist() == [len(w) for w in want] and np.array_equal(np.concatenate(got), np.concatenate(want))


def test_encoder_equals_the_library_on_marks(ids_of):
    """Capitals with combining marks that have no composed capital, contractions, special tokens, odd cases."""
    rng = random.Random(8)
    pieces = [*"aJHTWYjhtwyΣσςİIıßẞǅÅ", *"\u030c\u0331\u0308\u030a\u0301\u0323\u0327\u0338\u0345", *" \t\n.,;:!?|*$%&#'-<=>@", "'s", "'T", "'ll", "<|endoftext|>", "<|EndOfText|>", "\u00a0", "\u2028", "\u1100\u1161", "12", "日本", "\U0001f600"]
    given = ["J\u030c H\u0331 T\u0308ext W\u030a Y\u030a", "a J\u030cosef"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    found = ChunkEncoder(word_bpe(), 2).parts(pa.array(given))
    assert np.array_equal(np.concatenate([ids for _, ids, _ in found]), np.concatenate([ids_of(t) for t in given]))


def test_packing(docs, no_docs, texts, ids_of):
    got = packing.pack_documents(docs, word_bpe(), block_ids=3000).toPandas()
    pieces = sorted((str(r.doc_id), r.doc_tokens, r.start, r.ids) for r in got.itertuples())
    want = sorted(ids_of(t).tobytes() for _, t in texts)
    # pieces of rows with unlike ids follow one another; rows that share an id are told apart by their content
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(ids_of(t))
    for i, own in by_id.items():
        mine = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        if len(own) == 1:
            assert b"".join(r.ids for r in mine.sort_values("start").itertuples()) == own[0].tobytes()
            assert (mine.doc_tokens == len(own[0])).all()
    assert sum(len(p[3]) for p in pieces) == sum(map(len, want))
    assert (got.length == got.ids.map(len) // 4).all()
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == (np.cumsum(seq.length) - seq.length).tolist()
        assert seq.tier.nunique() == 1 and seq.step_group.nunique() == 1 and seq.length.sum() <= seq.tier.iloc[0]
    assert all(s.length.sum() == s.tier.iloc[0] for _, s in got.groupby("sequence_id"))  # nothing is padded
    assert all(t & (t - 1) == 0 for t in got.tier)
    assert packing.pack_documents(no_docs, word_bpe()).count() == 0


def test_step_groups_are_balanced():
    rng = random.Random(0)
    packer = packing.BlockPacker((64, 128, 256), 8, 0)
    full = packer.pack([packer.piece(i, 0, n, np.zeros(n, "<u4")) for i, n in enumerate(rng.randint(1, 400) for _ in range(800))], last=True)
    rows = list(packer.rows(full))
    assert sum(r[2] for r in rows) == sum(s for s in (sum(p[0] for p in q) for _, q in full))
    cost = {}
    for r in rows:
        if r[7] == 256:
            cost[r[8]] = cost.get(r[8], 0) + r[2] ** 2
    assert max(cost.values()) < 1.3 * min(cost.values())


@pytest.mark.parametrize("bits", [3, 8, 16])
def test_codes(bits):
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 2 ** rng.integers(1, 32), 50) for _ in range(30)]).astype("<u4")
    codes = token_output.dac_encode(ids, bits)
    assert [token_output.dac_access(codes, i, bits) for i in range(0, len(ids), 7)] == ids[::7].tolist()
    for a, b in [(0, len(ids)), (5, 5), (511, 513), (3, 700), (1499, 1500)]:
        assert np.array_equal(token_output.dac_slice(codes, a, b, bits), ids[a:b])


def test_token_files(spark, docs, no_docs, texts, ids_of, tmp_path):
    token_output.write_token_files(docs, f"{tmp_path}/a", word_bpe(), segment_ids=2000)
    segments = token_output.read_token_files(spark, f"{tmp_path}/a")
    got = token_output.document_digests(segments).toPandas().sort_values("start")
    assert len(got) == len(texts)
    assert got.start.tolist() == (np.cumsum(got.n_tokens) - got.n_tokens).tolist()
    known = [r for r in got.itertuples() if r.doc_id == r.doc_id]
    assert [r.doc_id for r in known] == sorted(r.doc_id for r in known) and got.doc_id.isna().iloc[-2:].all()
    want = sorted((i if i is not None else -1, len(x), zlib.crc32(x.tobytes())) for i, x in ((i, ids_of(t)) for i, t in texts))
    assert sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.n_tokens, r.ids_crc32) for r in got.itertuples()) == want
    # random access to single ids, by place in the whole
    at = {}
    for s in segments.collect():
        for i in range(0, s.n_ids, 997):
            at[s.first + i] = token_output.dac_access(list(map(bytes, s.codes)), i)
    assert {k: token_output.token_at(spark, f"{tmp_path}/a", k) for k in list(at)[:5]} == dict(list(at.items())[:5])
    with pytest.raises(IndexError):
        token_output.token_at(spark, f"{tmp_path}/a", sum(len(ids_of(t)) for _, t in texts))
    in_order = np.concatenate([token_output.dac_slice(list(map(bytes, s.codes)), 0, s.n_ids) for s in sorted(segments.collect(), key=lambda s: s.first)])
    assert all(in_order[k] == v for k, v in at.items())
    token_output.write_token_files(no_docs, f"{tmp_path}/b", word_bpe())
    assert token_output.document_digests(token_output.read_token_files(spark, f"{tmp_path}/b")).count() == 0


def test_words_of_most_parts_stay_in_the_store():
    """Words that come again and again go to the library once, in any case, though the store is full every few parts."""

    class Counting(ChunkEncoder):
        asked: list[str] = []

        def stems(self, ask):
            self.asked.extend(ask)
            return super().stems(ask)

    rng = random.Random(4)
    fresh = lambda: "".join(rng.choice("abcdefgh") for _ in range(12))
    common = [fresh() for _ in range(20)]
    texts = [" ".join([w.title() if i % 2 else w for w in common] + [fresh() for _ in range(20)]) for i in range(60)]
    encoder = Counting(word_bpe(), 2, cache_bytes=40_000, part=1)
    for _ in encoder.parts(pa.array(texts)):
        assert 200 * len(encoder.size) + 4 * len(encoder.values) <= 40_000
    assert sum(w.lower() in common for w in encoder.asked) == len(common)


def test_the_library_gets_few_texts_at_once():
    """What it returns for a text is many times its ids."""

    class Counting:
        largest = 0

        def __init__(self, library):
            self.library = library

        def encode(self, *a, **k):
            return self.library.encode(*a, **k)

        def encode_batch(self, texts, **k):
            return self.encode_batch_fast(texts, **k)

        def encode_batch_fast(self, texts, **k):
            self.largest = max(self.largest, len(texts))
            return self.library.encode_batch(texts, **k)

    encoder = ChunkEncoder(word_bpe(), 2)
    encoder.library = Counting(encoder.library)
    for _ in encoder.parts(pa.array([" ".join(f"a{i}" for i in range(9000))])):
        pass
    assert 0 < encoder.library.largest <= 2048


def test_gathered_takes_two_indexes_of_four_bytes():
    n = 1_000_000
    values, starts, tens = np.arange(n, dtype="<u4"), np.arange(0, n, 10)[::-1].copy(), np.full(n // 10, 10)
    tracemalloc.start()
    got = gathered(starts, tens, values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, values.reshape(-1, 10)[::-1].ravel()) and peak < 13 * n


def test_digests_decode_a_segment_once(monkeypatch):
    """Not once for each of its documents."""
    calls, tasks = [], []

    class Segments:
        def select(self, *names):
            return self

        def mapInArrow(self, task, schema):
            tasks.append(task)

    monkeypatch.setattr(token_output, "dac_slice", lambda codes, a, b, bits, f=token_output.dac_slice: calls.append((a, b)) or f(codes, a, b, bits))
    ids = np.array([5, 70_000, 300, 2, 2, 49_000, 2], "<u4")
    row = {"first": 10, "doc_ids": [4, 7, None], "doc_counts": [4, 1, 2], "codes": token_output.dac_encode(ids)}
    token_output.document_digests(Segments())
    got = [r for b in tasks[0](iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
    want = [(4, 10, 4, ids[:4]), (7, 14, 1, ids[4:5]), (None, 15, 2, ids[5:])]
    assert [tuple(r.values()) for r in got] == [(i, s, n, zlib.crc32(x.tobytes())) for i, s, n, x in want]
    assert calls == [(0, 7)]
