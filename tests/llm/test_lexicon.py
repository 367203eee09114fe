"""The automaton against plain dictionaries, ids and texts against the public library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shotweave.llm import lexicon, queries
from shotweave.llm.arrays import blocks, from_columns, text_buffer
from tests.llm.conftest import table

PATH = public_tokenizers.path("word_bpe_49k.json")
PUBLIC = Tokenizer.from_file(PATH)
MODEL = lexicon.Model(from_columns(lexicon._model_file(PATH)))
KNOWN = sorted({w.encode() for w in "the a an er st ing word words wording rewording 'll ! é über 5 中 anerst".split()})
ENCODER = lexicon.Encoder(MODEL, lexicon.Lexicon(from_columns(lexicon.Lexicon.file(KNOWN, MODEL))))


def spans(words):
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends


def encoded(texts):
    out = []
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    for a, b in blocks(offsets):
        ids, at = ENCODER(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out += [ids[x:y].tolist() for x, y in zip(at, at[1:])]
    return out


def public(texts):
    return [e.ids for e in PUBLIC.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(min_size=1, max_size=7), max_size=20))
def test_the_automaton_numbers_its_words(known, others):
    words = sorted(known)
    keys, targets, skips, ends = lexicon.compile_words(words)
    arcs = lexicon.Table.of(keys, np.arange(len(keys), dtype=np.int32))
    automaton = lexicon.Lexicon([arcs.slots, arcs.values, targets, skips, ends, np.zeros(0), np.zeros(1)])
    asked = words + others
    assert automaton.number(*spans(asked)).tolist() == [words.index(w) if w in known else -1 for w in asked]


def test_the_automaton_is_minimal():
    words = sorted(a + b for a in (b"re", b"un", b"", b"over") for b in (b"ing", b"ed", b"s", b""))[1:]
    keys, targets, skips, ends = lexicon.compile_words(words)
    rights = {}  # what can follow each prefix: as many states as there are different answers
    for w in words:
        for i in range(len(w) + 1):
            rights.setdefault(w[:i], frozenset(x[i:] for x in words if x.startswith(w[:i])))
    assert len(set(targets.tolist())) + 1 == len(set(rights.values()))
    assert len(keys) < sum(map(len, words))


TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n'strevlmdSaİΣé5中́ͅ!\u0085\x1c"), st.characters(codec="utf-8")))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("<|endoftext|>"), st.just("the <|startoftext|><|endoftext|x"))))
def test_ids_are_those_of_the_public_library(texts):
    assert encoded(texts) == public(texts)


def test_every_character():
    texts = ["a" + chr(c) + "̣" + chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(texts[i : i + 32]) for i in range(0, len(texts), 32)]
    assert encoded(texts) == public(texts)


def test_long_words():
    rng = random.Random(0)
    texts = ["a" * 30000, "ab" * 3000, "".join(rng.choice("aeinorst") for _ in range(20000)), "é" * 33, "q" * 64, "q" * 65, None, ""]
    assert encoded(texts) == public(texts)


@pytest.mark.parametrize("words", [0, 5, 1 << 17])
def test_encode_and_decode(spark, rows, words):
    rows = [*rows, (900, "the <|endoftext|>THE end"), (901, "A<|startoftext|>")]
    docs = table(spark, rows)
    tokenizer = lexicon.word_tokenizer(docs, "text", words=words)
    back = lexicon.decode(lexicon.encode(docs, "text", tokenizer), "ids", tokenizer)
    assert set(docs.columns) < set(back.columns)
    got = sorted((r["doc_id"], r["ids"], r["decoded"]) for r in back.collect())
    want = [(i, ids, PUBLIC.decode(ids, skip_special_tokens=False)) for (i, _), ids in zip(rows, public([t for _, t in rows]))]
    assert got == sorted(want)


def test_frequent_words_are_counted_over_all_documents(spark, rows):
    docs = table(spark, rows * 2)
    model = lexicon._model(spark, PATH)
    found = {bytes(r["word"]): r["n"] for r in lexicon.count_words(docs, "text", model).collect()}
    want = {}
    for _, text in rows * 2:
        normal = PUBLIC.normalizer.normalize_str(text or "")
        for _, (a, b) in PUBLIC.pre_tokenizer.pre_tokenize_str(normal):
            word = normal[a:b].encode()
            if len(word) <= lexicon.WORD_BYTES:
                want[word] = want.get(word, 0) + 1
    assert found == want


def test_no_rows(spark, empty):
    tokenizer = lexicon.word_tokenizer(empty, "text")
    assert lexicon.round_trip(empty, "doc_id", "text", tokenizer).collect() == []
    assert lexicon.encode(empty, "text", tokenizer).collect() == []


def test_query_against_the_public_library(spark):
    source = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{source}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for (doc_id, _), ids in zip(rows, public([r["text"] for r in rows])):
        shown = PUBLIC.decode(ids, skip_special_tokens=False).encode()
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown).hexdigest()))
    df = queries.op11_word_lexicon(spark, source)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(want)
