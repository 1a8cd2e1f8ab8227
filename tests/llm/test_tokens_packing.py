import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartflow.llm import packing, tokens

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORDS)
COUNTER, WORD_IDS = tokens.PrefixCounter(BYTE, max_units=50), packing.WordIds(WORDS, max_words=50)
TEXT = st.text(alphabet=st.sampled_from("abreTS '.,1é日\n\t\x1c\u00a0\u0301İΣ<|>!"), max_size=40)
SPECIAL = ["<|endoftext|>a<|endoftext|> b <|endof", "a  <|endoftext|>", "don't we'll they're 're 'r ''re", "a  b   c\n\n d\n e \n", "aaaa" * 30, "\t\tif x:\n\t\t\ty"]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def hold(text):
    want = [count(text[:i]) for i in range(len(text) + 1)]
    assert list(COUNTER.prefix_counts(text)) == want
    for limit in (0, 1, 3, 9):
        assert COUNTER.question(text, limit) == (want[-1], max(i for i, n in enumerate(want) if n <= limit))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_every_prefix_has_the_library_count(text):
    hold(text)


def test_special_strings_contractions_and_runs_of_white_space():
    for text in SPECIAL:
        hold(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_word_ids_are_the_library_ids(texts):
    for text, ids in zip(texts, WORD_IDS.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_counts_of_odd_rows(odd_docs, no_docs):
    rows = tokens.token_counts(odd_docs, BYTE, 512).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted(
        (t.doc_id or -1, len((t.text or "").encode()), count(t.text or ""), count(t.text or "") > 512) for t in texts)
    assert tokens.token_counts(no_docs, BYTE, 512).count() == 0
    tables = {r.doc_id: r.counts for r in tokens.prefix_tables(odd_docs.where("doc_id in (1, 2)"), BYTE).collect()}
    assert tables[2] == [0] and len(tables[1]) == len("plain words of a text that goes on") + 1


def one_by_one(lengths, window):
    """Best-fit decreasing, piece by piece: the remaining capacities."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(left) if c >= length]
        if fits:
            left[min(fits)[1]] -= length
        else:
            left.append(window - length)
    return sorted(left)


def test_plan_is_that_of_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([8, 16, 31])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        used, ranks = {}, {}
        for length, rank, n, seq, each, offset in packing.best_fit_decreasing(histogram, window):
            for k in range(n):
                used.setdefault(seq + k // each, []).append((offset + k % each * length, length))
                ranks.setdefault(length, []).append(rank + k)
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
        assert sorted(used) == list(range(len(used)))
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
        assert sorted(window - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, window)


def test_pieces_hold_every_id_once(spark, odd_docs, no_docs):
    docs = odd_docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr(
        "doc_id + 1000", "text", "lang", "source", "n_chars", "0"))
    rows = packing.pack_documents(docs, WORDS, window=256, keep_ids=True).collect()
    want = sorted(tuple(WORD_LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in docs.collect())
    by_doc = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 256
        by_doc.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    single = {d: sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start) for d in {r.doc_id for r in rows} if d != 5}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for d, rs in single.items():
        assert [i for r in rs for i in r.ids] == WORD_LIBRARY.encode(texts[d], add_special_tokens=False).ids + [1]
    for d, rs in single.items():
        assert sum(r.length for r in rs) == rs[0].doc_tokens and [r.start for r in rs] == list(range(0, rs[0].doc_tokens, 256))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(256 - sum(n for _, n in p) for p in seqs.values()) == one_by_one([r.length for r in rows], 256)
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_word_ids_equal_the_librarys_for_odd_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordIds(path, max_words=500)  # the kept words are cleared on the way
    rnd = random.Random(3)
    odd = ["", "'tis", "('tis)", "don't", "x''s", "<|endoftext|>", "x<|endoftext|>.", "endoftext|>", "É'É", "ªº.µ",
           "İstanbul", "straße!!", "A\x1cB c", "(é)", "≠", "$$$a%%%", "-'s", "a\xa0b", "a​b", "a</w>", "\x00a", "漢."]
    odd += ["".join(rnd.choice("ab Zé'.,<|>$%\x1ć̸İß1²ſ-\"()") for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    for at in range(0, len(odd), 100):
        some = odd[at:at + 100]
        assert words.encode(some) == [packing.pack_ids(words.library.encode(t, add_special_tokens=False).ids) for t in some]
