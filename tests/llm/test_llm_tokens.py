"""Packing and token files against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from parcelscope.llm import bitplanes, packing
from parcelscope.llm.tokens import PieceCache
from tokenizers import Tokenizer

BYTE, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TOKENIZERS = {p: Tokenizer.from_file(p) for p in (BYTE, WORDS)}
CACHES = {p: PieceCache(p, 50) for p in (BYTE, WORDS)}


def ids(path, text):
    return TOKENIZERS[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORDS])
@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab E1.,!'sé\n\t\r \x00\x1c ́İΣ <|>")), max_size=30), max_size=6))
def test_cached_pieces_equal_whole_texts(path, texts):
    texts = [*texts, "İ. क़, é.", "it's <|endoftext|> done <|startoftext|>", "a  b\n\n c"]
    assert [np.frombuffer(b, "<u4").tolist() for b in CACHES[path].encode(texts)] == [ids(path, t) for t in texts]


def test_plain_words_are_encoded_without_bars(monkeypatch):
    """Words of letters end at the ids that end words; a bar for each would double what is encoded."""
    cache, asked = PieceCache(WORDS, 10_000), []

    class Watched:
        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return TOKENIZERS[WORDS].encode_batch_fast(texts, **how)

    monkeypatch.setattr(cache, "tokenizer", Watched())
    words = ["Zyxwvut", "the", "I", "aninghation", "École", "ÀÖŸſ", "ǅıŉß", *map(chr, range(0xD8, 0xF7)), *(f"{a}{b}q{a}Lm" for a in "abcdXYZ" for b in "efghijklmnopqrstuvwxyzABC")]
    texts = [" ".join(words), "it's 12 the e\u0301t\u00e9 \u0130 x|y | z </w> a</w> <|endoftext|>", "one, two. three"]
    assert [np.frombuffer(b, "<u4").tolist() for b in cache.encode(texts)] == [ids(WORDS, t) for t in texts]
    assert any(t.startswith("Zyxwvut the I") for t in asked)
    assert all("|" not in t for t in asked if "the" in t)


@pytest.mark.parametrize("capacity,classes", [(2048, 33), (64, 9), (10, 4), (7, 7)])
def test_cut_covers_a_document(capacity, classes):
    for total in [*range(0, 3 * capacity), 20 * capacity + 1]:
        at = 0
        for k, start, length in packing.cut(total, capacity, classes):
            assert start == at and 1 <= length and k * length <= capacity
            at += length
        assert at == total


def check_packing(rows, docs, capacity, eos=1):
    want = sorted((d.doc_id is None, d.doc_id or 0, np.array([*ids(BYTE, d.text), eos], "<u4").tobytes()) for d in docs.collect())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seats in by_seq.values():
        at = 0
        for offset, length in sorted(seats):
            assert offset == at
            at += length
        assert at <= capacity
    times = {}
    for missing, doc_id, raw in want:
        times.setdefault((None if missing else doc_id, raw), 0)
        times[None if missing else doc_id, raw] += 1
    for (doc_id, raw), n in times.items():
        own = [r for r in by_doc[doc_id] if r.doc_tokens * 4 == len(raw) and zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        covered = np.zeros(len(raw) // 4, int)
        for r in own:
            covered[r.start : r.start + r.length] += 1
        assert (covered >= n).all()
    assert sum(r.length for r in rows) == sum(len(w[2]) // 4 for w in want)
    return len(by_seq) * capacity / max(1, sum(r.length for r in rows))


def test_pack_real_and_odd(docs, odd, none):
    over = check_packing(packing.pack(docs, BYTE).collect(), docs, 2048)
    assert over < 1.05
    check_packing(packing.pack(odd, BYTE, capacity=64, classes=9).collect(), odd, 64)
    assert packing.pack(none, BYTE).count() == 0


def test_short_texts_have_their_own_harmonic_class(spark):
    for rest in range(1, 64):
        assert list(packing.cut(rest, 2048, 33)) == [(2048 // rest, 0, rest)]
    short = spark.createDataFrame([(i, "the " * (32 + i % 31)) for i in range(3000)], "doc_id long, text string").repartition(2)
    assert check_packing(packing.pack(short, BYTE).collect(), short, 2048) < 1.05


def test_pack_keeps_ids(odd):
    for r in packing.pack(odd, BYTE, keep_ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32


@pytest.mark.parametrize("unit", [1, 8])
@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50000), max_size=40), max_size=8), st.integers(1, 50))
def test_chunk_round_trip(unit, docs, block):
    raw = [np.array(d, "<u4").tobytes() for d in docs]
    names = [None if i == 1 else i - 3 for i in range(len(docs))]
    back, lengths, flat = bitplanes.decode_chunk(bitplanes.encode_chunk(names, raw, block, unit, 1))
    assert back == names and lengths.tolist() == [len(d) for d in docs] and flat.tolist() == [i for d in docs for i in d]


def test_broken_chunk_is_refused():
    good = bitplanes.encode_chunk([1], [np.arange(9, dtype="<u4").tobytes()], 4, 1, 1)
    with pytest.raises(ValueError, match="not a chunk"):
        bitplanes.decode_chunk(b"????" + good[4:])


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_ids_written_and_read(spark, request, name):
    table = request.getfixturevalue(name)
    got = bitplanes.read_ids(spark, bitplanes.write_ids(table, WORDS, chunk_ids=500, block=64), keep_ids=True).collect()
    want = sorted(((d.doc_id is not None, d.doc_id or 0, np.array([*ids(WORDS, d.text), 2], "<u4").tobytes()) for d in table.collect()), key=lambda w: w[:2])
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got) == sorted((w[1] or -1, w[2]) for w in want)


def test_no_documents(spark, none):
    assert bitplanes.read_ids(spark, bitplanes.write_ids(none, WORDS)).count() == 0
