import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog import tokenizer
from shotweave.functions.bytelevel import BYTE_CHARS, from_byte_level, split_lines, split_units, split_words, to_byte_level
from shotweave.operators import bpe, bpe_rounds
from shotweave.operators.bpe import (
    SPECIAL_TOKENS, Tokenizer, bpe_decode, bpe_encode, bpe_train, word_counts,
)
from shotweave.operators.bpe_local import learn_merges
from shotweave.operators.masking import masked
from shotweave.plans.records import Masking
from shotweave.sources.tokenizers import load_tokenizer, save_tokenizer, save_tokenizer_files

BASE = len(SPECIAL_TOKENS) + 256

LINES = [
    "aaa aaaa aa ababab", "the theme then  there", "naïve café\tΣίσυφος", "x" * 9, "don't we'll I've",
    "12 123 1234 — !!! ??", "two\nlines\n\nhere", "", "CC(=O)Oc1ccccc1C(=O)O", "日本語 テキスト",
]


def corpus(spark, extra=60):
    rng = random.Random(5)
    made = [
        " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(12))
        for _ in range(extra)
    ]
    return spark.createDataFrame(list(enumerate(LINES + made)), "row_id long, text string")


def plain_trainer(counts, merges, least=2):
    """One merge at a time over word lists."""
    alphabet = sorted(BYTE_CHARS)
    ids = {c: len(SPECIAL_TOKENS) + i for i, c in enumerate(alphabet)}
    words = [("".join(BYTE_CHARS[b] for b in w.encode()), n) for w, n in counts.items()]
    words = [(list(w), n) for w, n in words]
    learnt = []
    while len(learnt) < merges:
        pairs = {}
        for symbols, n in words:
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] = pairs.get(pair, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], ids[p[0]], ids[p[1]]), default=None)
        if best is None or pairs[best] < least:
            break
        learnt.append(best)
        ids.setdefault("".join(best), len(ids) + len(SPECIAL_TOKENS))
        for symbols, _ in words:
            i = 0
            while i < len(symbols) - 1:
                if (symbols[i], symbols[i + 1]) == best:
                    symbols[i : i + 2] = ["".join(best)]
                i += 1
    return learnt


def test_training_equals_one_merge_at_a_time(spark):
    counts = word_counts(corpus(spark), "text")
    trained = bpe_train(counts, BASE + 60)
    expected = plain_trainer({r["word"]: r["n"] for r in counts.collect()}, 60)
    assert list(trained.merges) == expected
    assert list(trained.tokens[:5]) == SPECIAL_TOKENS and trained.has("[MASK]")


@pytest.mark.parametrize("pairs, size", [(1, 1 << 20), (7, 200), (1 << 14, 1 << 20)])
def test_rounds_equal_one_merge_at_a_time_to_the_end(spark, monkeypatch, pairs, size):
    monkeypatch.setattr(bpe_rounds, "FIRST_PAIRS", pairs)
    monkeypatch.setattr(bpe_rounds, "MOST_PAIRS", max(pairs, 16))
    monkeypatch.setattr(bpe_rounds, "FRAGMENT_BYTES", size)
    monkeypatch.setattr(bpe_rounds, "BLOB_SYMBOLS", 500)
    counts = word_counts(corpus(spark, 8), "text")
    expected = plain_trainer({r["word"]: r["n"] for r in counts.collect()}, bpe.VOCAB_SIZE)
    assert len(expected) > 40 and list(bpe_train(counts).merges) == expected


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 4)), min_size=1, max_size=15),
    st.integers(1, 4), st.integers(1, 3),
)
def test_fragments_give_the_merges_of_the_words(words, pairs, least):
    """The rounds without Spark, against one merge at a time over lists."""
    counts = {}
    for word, n in words:
        counts[word] = counts.get(word, 0) + n
    alphabet = sorted(BYTE_CHARS)
    tokens = [*SPECIAL_TOKENS, *alphabet]
    id_of = {c: len(SPECIAL_TOKENS) + i for i, c in enumerate(alphabet)}
    long = {w: n for w, n in counts.items() if len(w) > 1}
    state = bpe_rounds.Words(
        np.array([id_of[c] for w in long for c in w], np.int32), np.array([len(w) for w in long], np.int64),
        np.array(list(long.values()), np.int64),
    )
    merges = []
    while len(state.counts):
        row = state.row()
        top = sorted(zip((-row["sums"]).tolist(), row["pairs"].tolist()))
        top = [(n, p) for n, p in top if -n >= least]
        if not top:
            break
        frequent = np.array(sorted(p for _, p in top[:pairs]), np.int64)
        beyond = (-top[pairs][0], top[pairs][1]) if pairs < len(top) else None
        table = {}
        starts, lengths = state.segments(frequent)
        weight = state.counts[np.searchsorted(np.cumsum(state.lengths), starts, "right")]
        for some, rows, number in state.fragments(starts, lengths):
            for segment, k in zip(some, number):
                table[rows[k].tobytes()] = table.get(rows[k].tobytes(), 0) + int(weight[segment])
        sizes = np.array([len(f) // 4 for f in table])
        learnt, left, after = learn_merges(
            np.frombuffer(b"".join(table), np.int32), np.cumsum(sizes) - sizes, np.array(list(table.values())), tokens, 5000,
            least, beyond,
        )
        assert learnt
        merges += learnt
        cut = np.split(left.astype(np.int32), np.cumsum(after)[:-1])
        state = state.replaced(frequent, {f: x.tobytes() for f, x in zip(table, cut)})
    assert merges == plain_trainer(counts, 5000, least)


def test_registered_queries_learn_the_default_vocabulary(spark):
    merges = tokenizer.learnt(spark, "/root/testdata/sf0.001").orderBy("rank").collect()
    assert tokenizer.full_sizes(spark, "/root/testdata/sf0.001").first()["vocab_size"] == bpe.VOCAB_SIZE
    assert len(merges) >= bpe.VOCAB_SIZE - BASE
    counts = {r["word"]: r["n"] for r in tokenizer.counted(spark, "/root/testdata/sf0.001").collect()}
    assert [(r["left"], r["right"]) for r in merges[:40]] == plain_trainer(counts, 40)


def test_training_and_encoding_equal_the_common_library(spark, tmp_path):
    library = pytest.importorskip("tokenizers")
    df = corpus(spark)
    path = tmp_path / "corpus.txt"
    path.write_text("".join(r["text"] + "\n" for r in df.orderBy("row_id").collect()), encoding="utf-8")
    other = library.ByteLevelBPETokenizer()
    other.train([str(path)], vocab_size=BASE + 50, show_progress=False, special_tokens=SPECIAL_TOKENS)
    trained = bpe_train(word_counts(df, "text"), BASE + 50)
    assert trained.ids == other.get_vocab()
    for row in bpe_encode(df, "text", trained).collect():
        assert row["ids"] == other.encode(row["text"]).ids
        assert row["tokens"] == other.encode(row["text"]).tokens


def slow_merge(symbols, pairs):
    symbols = list(symbols)
    while True:
        ranked = [(pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        if not ranked:
            return symbols
        _, i = min(ranked)
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), unique=True, max_size=20))
def test_merging_with_a_heap(symbols, ranked):
    pairs = {pair: (rank, 7 + rank % 6) for rank, pair in enumerate(ranked)}
    assert bpe.merge_symbols(symbols, pairs) == slow_merge(symbols, pairs)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=14), max_size=8),
    st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), unique=True, max_size=20),
)
def test_words_merged_side_by_side(words, ranked):
    pairs = {pair: (rank, 7 + rank % 6) for rank, pair in enumerate(ranked)}
    order = sorted((left << 32 | right, rank) for (left, right), (rank, _) in pairs.items())
    keys, ranks = (np.array([x[i] for x in order], np.int64) for i in (0, 1))
    if words:
        found, sizes = bpe.merge_words(
            np.array([x for w in words for x in w], np.int32), np.array([len(w) for w in words]), keys, ranks,
            np.array([7 + rank % 6 for rank in range(len(ranked))], np.int32),
        )
        assert [x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] == [slow_merge(w, pairs) for w in words]


def test_a_batch_is_laid_out_in_parts(monkeypatch):
    """Memory beside a batch is that of some words, not of all."""
    model = Tokenizer((*SPECIAL_TOKENS, *sorted(BYTE_CHARS), "ab"), (("a", "b"),))
    encoder, laid_out = bpe._WordEncoder(model.tokens, model.merges), []
    inner = encoder.ids
    encoder.ids = lambda words: laid_out.append(len(words.flatten())) or inner(words)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 5)
    monkeypatch.setattr(bpe, "LONG", 6)
    rows = [["ab"] * 3, ["é"], [], ["cab", "b" * 9], ["ab"] * 8, [], ["abababab", "ab"]]
    expected = [[encoder.shown(encoder.ids(pa.array([r], pa.list_(pa.string())))).to_pylist()[0] for r in rows]]
    laid_out.clear()
    batch = pa.array(rows, pa.list_(pa.string()))
    assert encoder(batch, "tokens").to_pylist() == expected[0]
    assert expected[0][4] == ["ab"] * 8 and expected[0][6] == ["ab"] * 5
    assert max(laid_out) == 8 and len(laid_out) > 2
    assert encoder(batch.slice(0, 0), "ids").to_pylist() == []
    assert encoder(batch.slice(3), "both").to_pylist()[0]["tokens"] == expected[0][3]


def test_ids_without_a_token_are_an_error(spark):
    model = Tokenizer((*SPECIAL_TOKENS, *sorted(BYTE_CHARS)), ())
    df = spark.createDataFrame([([70, 71],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe_decode(df, "ids", model).collect()] == [model.tokens[70] + model.tokens[71], None]
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe_decode(spark.createDataFrame([([999],)], "ids array<int>"), "ids", model).collect()


def test_blobs_of_a_batch_are_read_one_by_one():
    words = bpe_rounds.Words(np.arange(6, dtype=np.int32), np.array([2, 4]), np.array([1, 1]))
    batch, read = bpe_rounds._batch([words.row(), words.row()]), []

    class Column:
        def __init__(self, name):
            self.column = batch.column(name)

        def __getitem__(self, i):
            read.append(i)
            return self.column[i]

    class Batch:
        num_rows, column = batch.num_rows, staticmethod(Column)

    found = []
    for blob in bpe_rounds._blobs(Batch()):
        found.append(blob)
        assert read == [i for i in range(len(found)) for _ in range(3)]
    assert len(found) == 2 and all(np.array_equal(x.symbols, words.symbols) and np.array_equal(x.lengths, words.lengths) for x in found)


def test_all_documents_encode_as_in_the_common_library(spark):
    """The whole default vocabulary, whole texts, and a word of 20,000 letters."""
    library = pytest.importorskip("tokenizers")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    long = "".join(rng.choice("aeinorst") for _ in range(20000))
    docs = docs.unionByName(spark.createDataFrame([(-1, long), (-2, None), (-3, "")], "doc_id bigint, text string"))
    trained = bpe_train(word_counts(docs, "text"))
    other = library.ByteLevelBPETokenizer(vocab=trained.ids, merges=list(trained.merges))
    rows = bpe_encode(docs, "text", trained).collect()
    assert len(trained.tokens) == bpe.VOCAB_SIZE
    for row in rows:
        if row["text"] is None:
            assert row["ids"] is None and row["tokens"] is None
            continue
        expected = other.encode(row["text"])
        assert row["ids"] == expected.ids and row["tokens"] == expected.tokens
    encoder = bpe._encoder(trained.tokens, trained.merges)
    encoder.known.clear()
    start = time.perf_counter()
    encoder.word(long)
    assert time.perf_counter() - start < 0.2


def test_rare_pairs_are_not_merged(spark):
    df = spark.createDataFrame([("abc",)], "text string")
    assert bpe_train(word_counts(df, "text"), BASE + 10).merges == ()


def test_round_trip(spark):
    df = corpus(spark)
    tokenizer = bpe_train(word_counts(df, "text"), BASE + 20)
    rows = bpe_decode(bpe_encode(df, "text", tokenizer), "ids", tokenizer).collect()
    assert all(r["decoded"] == r["text"] for r in rows)


def test_byte_level_and_word_split_lose_nothing(spark):
    df = corpus(spark)
    rows = df.select(
        "text", from_byte_level(to_byte_level(F.col("text"))).alias("same"),
        F.array_join(split_words(F.col("text")), "").alias("joined"),
    ).collect()
    assert all(r["text"] == r["same"] == r["joined"] for r in rows)


@pytest.mark.parametrize("save", [save_tokenizer, save_tokenizer_files])
def test_saved_models_load_again(spark, tmp_path, save):
    tokens = (*SPECIAL_TOKENS, *sorted(BYTE_CHARS), "ab", "abc")
    model = Tokenizer(tokens, (("a", "b"), ("ab", "c")))
    save(model, spark, str(tmp_path / "model"))
    assert load_tokenizer(spark, str(tmp_path / "model")) == model


def test_files_of_the_common_library_load(spark, tmp_path):
    library = pytest.importorskip("tokenizers")
    other = library.ByteLevelBPETokenizer()
    other.train_from_iterator(["hello hello world"], vocab_size=270, show_progress=False)
    other.save_model(str(tmp_path))
    loaded = load_tokenizer(spark, str(tmp_path))
    assert loaded.tokens[-1] == "[MASK]" and loaded.has("[MASK]")
    text = spark.createDataFrame([("hello world",)], "text string")
    assert bpe_encode(text, "text", loaded).first()["ids"] == other.encode("hello world").ids


def test_both_parts_of_a_model_must_exist(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_tokenizer(spark, str(tmp_path / "nothing"))


def test_one_token_is_masked(spark):
    df = corpus(spark)
    tokenizer = bpe_train(word_counts(df, "text"), BASE + 20)
    masking = Masking.with_tokenizer(tokenizer)
    rows = df.withColumn("tokens", masking.tokenise(F.col("text")))
    drawn = masked(F.col("text"), F.col("tokens"), F.col("row_id"), detokenise=masking.detokenise)
    for row in rows.select("text", "tokens", drawn.alias("m")).collect():
        tokens, shown, tag = row["tokens"], row["m"]["masked"], row["m"]["tag"]
        if len(tokens) <= 2:
            assert shown == row["text"] and tag == "Too_Short_To_Mask"
            continue
        assert shown.count("[MASK]") == 1
        hidden = tag.removeprefix("BPE_Token:_")
        assert hidden in tokens
        if row["text"].isascii():
            restored = bytes(BYTE_CHARS.index(c) for c in hidden).decode()
            assert shown.replace("[MASK]", restored) == row["text"]


def test_without_mask_token_the_text_stays(spark):
    df = spark.createDataFrame([("a b c d", ["a", "b", "c", "d"])], "text string, tokens array<string>")
    row = df.select(masked(F.col("text"), F.col("tokens"), 1, has_mask=False).alias("m")).first()["m"]
    assert tuple(row) == ("a b c d", "Mask_Token_Not_Found")


def test_units_are_counted_before_words_are_cut(spark):
    """The regular expression sees distinct units, and the words are those of whole lines."""
    rng = random.Random(3)
    signs = [" ", " ", " ", "  ", "\n", "\t", "\x01", "\u00a0", "\u3000", "\r", "\x1c", "'", "'s", "'ll", "a", "Ü", "7", "?", "é", "中"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)]
    texts += [*LINES, None, "", " ", "\n", " a b ", "a 's b'll  c", "x " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    one = df.select(F.explode(split_lines(F.col("text"))).alias("line")).select(F.explode(split_words(F.col("line"))).alias("word"))
    expected = {r["word"]: r["count"] for r in one.groupBy("word").count().collect()}
    assert {r["word"]: r["n"] for r in word_counts(df, "text").collect()} == expected
    plain = spark.createDataFrame([("it's so, so 12 x\nso it",)], "text string").select(split_units(F.col("text")).alias("u")).first()["u"]
    assert [u for u in plain if u] == ["it's", " so,", " so", " 12", " x\n", "so", " it\n"]
