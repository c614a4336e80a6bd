import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import DOCS, odd_documents
from webstrata.llm import tokens as T
from webstrata.llm.lexicon import Lexicon, compile_lexicon

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
RANKS = T.load_ranks(f"{T.TOKENIZERS}/{T.BYTE_BPE}")
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})

words = st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
runs = st.lists(st.one_of(words, st.sampled_from([" ", "  ", "\n", " \n ", "\t", "'s", " don't", "  x", "123", "x" * 60, " "])), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(runs, max_size=4))
def test_encode_equals_the_tokenizer(texts):
    ids, ends = T.Encoder(RANKS).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ORACLE.encode_ordinary(t) for t in texts]


def test_long_words_merge_exactly():
    rng = random.Random(1)
    for n in (47, 48, 49, 500, 4000):
        word = bytes(rng.choice(b"abcde ") for _ in range(n))
        assert T.merge(word, RANKS) == ORACLE._core_bpe.encode_single_piece(word)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 50_000), max_size=4), max_size=40), st.lists(st.binary(max_size=7), max_size=10))
def test_lexicon_round_trip(tmp_path_factory, table, others):
    path = tmp_path_factory.mktemp("lex") / "x.bin"
    path.write_bytes(compile_lexicon(table.items()))
    lexicon = Lexicon(str(path))
    assert all(lexicon.get(w) == ids for w, ids in table.items())
    assert all(lexicon.get(w) == table.get(w) for w in others)


def test_suffixes_are_shared():
    stems = [bytes([a, b]) for a in range(97, 117) for b in range(97, 117)]
    assert len(compile_lexicon((s + b"ization", [1]) for s in stems)) < 12 * len(stems) + 4000


def test_corpus(spark):
    docs = odd_documents(spark)
    want = {(r.doc_id, r.text): ORACLE.encode_ordinary(r.text or "") for r in docs.collect()}
    got = T.encode_corpus(docs, lexicon_words=5).collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(map(str, [*want.values(), want[6, "a\r\nb c   d"]]))
    assert {r.doc_id: r.n_tokens for r in T.count_tokens(docs).collect()} == {i: len(v) for (i, _), v in want.items()}
    assert T.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0


def test_word_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, " b"), (3, None)], "doc_id LONG, text STRING")
    assert {r.word: r.n for r in T.word_counts(docs).collect()} == {"a": 1, " b": 2, " a": 1}
