"""Transducer, token files and token counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from trellis.llm import token_counts, token_files, transducer  # noqa: E402
from trellis.llm.library import encoder  # noqa: E402
from trellis.llm.pieces import Pieces, windows  # noqa: E402

BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
PARTS = ["a", "B", "word", "Été", " ", " ", " ", "  ", "\n", "é", "́", "'s", "12", "²", "!", ".", ",", "<|endoftext|>", " ", " ", "字", "\t", "'", "ɐ", "Σ", "İ"]


def texts(n, seed=1):
    random.seed(seed)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    rows = [(1, "The cat.\nThe <|endoftext|> dog, et l’été"), (2, ""), (3, None), (3, "a  b"), (3, "a  b"), (None, "no id"), (4, "word " * 3000 + "ab" * 3000), (5, "字" * 50)]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens long, ids string")


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids, lambda i: tokenizer.decode(i, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_and_transducer_give_the_library_ids(path):
    want, back = library(path)
    encode = encoder(path)
    pieces, vocab = Pieces(lambda t: [tuple(i) for i in encode(t)], 60), transducer.Vocabulary(path, block=300)
    for text in [*texts(800), "ab" * 3000, "x" * 2000]:
        ids = want(text)
        assert [i for w in pieces.values(text, window=random.choice([3, 8, 1000])) for v in w for i in v] == ids
        got = np.concatenate([np.zeros(0, np.int32), *vocab.encode(text)])
        assert got.tolist() == ids
        assert "".join(vocab.decode(got)) == back(ids)


def test_windows_join_to_the_text():
    for text in texts(200, 5):
        assert "".join(windows(text, 4)) == text


def test_stream_equals_whole_merge_for_any_merge_list():
    random.seed(3)
    for trial in range(400):
        letters = "ab" if trial % 2 else "abc"
        tokens, merges = list(letters), []
        for _ in range(random.randint(1, 12)):
            pair = (random.choice(tokens), random.choice(tokens))
            if pair[0] + pair[1] not in tokens:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        e = transducer.Encoder(merges, block=max(map(len, tokens)))
        word = [random.choice(letters) for _ in range(4 * e.lookahead + 30)]
        assert list(e.stream(word)) == e.merge(word)


def test_decoder_keeps_unfinished_bytes():
    vocab = transducer.Vocabulary(BYTES)
    ids = np.concatenate(list(vocab.encode("naïve 字 🙂")))
    one_by_one = "".join(vocab.decoder.feed(ids[k : k + 1]) for k in range(len(ids))) + vocab.decoder.finish()
    assert one_by_one == "naïve 字 🙂"
    assert vocab.decoder.feed(ids[:0]) == "" and vocab.decoder.feed(np.array([10**6, -5])) == ""


def test_encode_and_decode(docs):
    want, back = library(WORDS)
    rows = docs.select("doc_id", "text").collect()
    encoded = transducer.encode(docs, WORDS)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == sorted(((r.doc_id, want(r.text)) for r in rows), key=repr)
    decoded = transducer.decode(encoded, WORDS)
    assert sorted((tuple(r) for r in decoded.collect()), key=repr) == sorted(((r.doc_id, back(want(r.text))) for r in rows), key=repr)
    assert transducer.encode(docs.limit(0), WORDS).collect() == []


def test_round_trip_in_one_worker(docs):
    encoded = transducer.encode(docs, WORDS, keep=("doc_id", "text"))
    both = transducer.round_trip(docs, WORDS)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    decoded = transducer.decode(encoded.select("doc_id", "ids", F.col("ids").alias("kept")), WORDS, keep=("doc_id", "kept"))
    want = sorted((r.doc_id, r.kept, r.text) for r in decoded.where("doc_id IS NOT NULL").collect())
    assert sorted(tuple(r) for r in both.where("doc_id IS NOT NULL").collect()) == want and both.count() == docs.count()
    assert transducer.round_trip(docs.limit(0), WORDS).collect() == []


def test_token_counts(docs):
    want, _ = library(BYTES)
    rows = docs.select("doc_id", "text").collect()
    expected = [(r.doc_id, len((r.text or "").encode()), len(want(r.text)), len(want(r.text)) > 512) for r in rows]
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTES).collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts.count_tokens(docs.limit(0), BYTES).collect() == []


def test_token_counts_of_a_sentencepiece_model(docs):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    some = docs.where("doc_id < 4")
    expected = sorted((r.doc_id, len(model.encode(r.text or ""))) for r in some.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(some, path).collect()) == expected


def test_token_files(docs):
    want, _ = library(BYTES)
    files = token_files.write_token_files(docs, BYTES)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    expected, start = [], 0
    for r in rows:
        ids = np.array([*want(r.text), 0], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.read_token_files(files).collect()), key=lambda r: r[1]) == expected
    name = files.manifest.orderBy("part", "seq").first().file
    reader = token_files.FileReader(files.folder, name, files.dictionary)
    assert reader.ids(reader.index.num_rows - 1)[-1] == 0
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.FileReader(files.folder, name, b"other" * 10)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), BYTES)).collect() == []
    small = token_files.write_token_files(docs, BYTES, file_bytes=1)  # a file per document
    assert small.manifest.agg(F.max("n_docs")).first()[0] == 1 and small.manifest.count() == docs.count()
    read = token_files.read_token_files(small)
    assert sorted(map(tuple, read.collect()), key=lambda r: r[1]) == expected
    assert read.rdd.getNumPartitions() > 1 or docs.count() == 1


def test_words_are_merged_like_the_library():
    """The one-call merger stands in for the model only where every token is what its letters give."""
    from trellis.llm.library import tokenizer, word_merger

    merge, own = word_merger(BYTES), tokenizer(BYTES)
    rng = random.Random(6)
    for _ in range(3000):
        word = " " + "".join(rng.choice("etaoinshrdlTHEZzq\u00e9\u00df\u0101") for _ in range(rng.choice([1, 3, 8, 30])))
        assert merge(word.encode()) == own.encode(word, add_special_tokens=False).ids
    assert word_merger(WORDS) is None


def test_texts_together_and_alone(docs):
    from trellis.llm.library import encoder

    encode = encoder(BYTES)
    texts = [r.text or "" for r in docs.collect()] * 2
    for together, window in ((1, 5), (40, 7), (1 << 14, 1 << 18)):
        pieces = Pieces(lambda t: [tuple(i) for i in encode(t)], 60)
        assert [[i for v in values for i in v] for values in pieces.each(texts, together, window)] == [encode([t])[0] if t else [] for t in texts]


def test_encoder_asks_for_ids_alone(monkeypatch):
    import public_tokenizers

    from trellis.llm import library

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        real = library.tokenizer(path)

        class IdsOnly:
            def __getattr__(self, name):
                assert name != "encode_batch"
                return getattr(real, name)

        monkeypatch.setattr(library, "tokenizer", lambda _: IdsOnly())
        texts = ["", " a1-b2", "x\n\ny  <|endoftext|> e\u0301 \u65e5\u672c", " plain", "\nword", " \U0001f600!"]
        assert library.encoder(path)(texts) == [real.encode(t, add_special_tokens=False).ids for t in texts]
        monkeypatch.undo()
