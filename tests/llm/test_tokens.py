"""Token files and pieces: against the libraries, byte for byte."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from periscan.llm import idfiles, pieces, separators
from periscan.llm.tokenize import encoder, vocabulary

TEXTS = ["Plain words here.", "", None, " lead  two\n\nlines\t tab ", "<|endoftext|> kept as text", "é 日本 語\nテスト", "x" * 5000, "a b " * 3000, "a b " * 3000]


def docs(spark, texts=TEXTS):
    rows = [(k * 3 - 4, t, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def expected(texts, end, plain=False):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    if plain:
        tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def test_cutting_does_not_change_ids():
    enc = encoder(vocabulary("byte_bpe_50k.json"))
    for t in filter(None, TEXTS):
        assert enc.encode([t])[0] == enc.library([t])[0]


def test_added_tokens_are_the_librarys(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c", "a", " b", "<|endof text|>"]
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for plain in (False, True):
        tokenizer.encode_special_tokens = plain
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        for _ in range(2):  # as new and as kept
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder(vocabulary("byte_bpe_50k.json"), plain).encode(texts)] == want


def test_files_roll_within_a_range_of_ids(spark, monkeypatch):
    monkeypatch.setattr(idfiles, "ROLL_BYTES", 100)
    index = idfiles.write_records(docs(spark, ["some words of a text"] * 40), vocabulary("byte_bpe_50k.json"), n_files=2)
    got = idfiles.record_digests(index).orderBy("start").collect()
    assert [r.doc_id for r in got] == [k * 3 - 4 for k in range(40)]
    assert [r.start for r in got] == [k * 6 for k in range(40)]


def test_records_round_trip_in_order(spark):
    index = idfiles.write_records(docs(spark), vocabulary("byte_bpe_50k.json"), end_id=2)
    got = {r.doc_id: r for r in idfiles.record_digests(index).collect()}
    start = 0
    for k, ids in enumerate(expected(TEXTS, 2)):
        r = got[k * 3 - 4]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = index.where("doc_id in (-4, 11)").orderBy(F.desc("doc_id"))
    assert {r.doc_id: r.ids for r in idfiles.read_at(some).collect()} == {-4: expected(TEXTS, 2)[0], 11: expected(TEXTS, 2)[5]}


def test_damaged_records_are_noticed():
    good = idfiles.frame(b"hello")
    assert idfiles.unframe(good, 0, "f") == (b"hello", len(good)) and idfiles.unframe(good[:-1], 0, "f") is None
    for k in (0, 14):
        with pytest.raises(ValueError):
            idfiles.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :], 0, "f")


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (5, "c"), (5, "c")], "doc_id long, text string")
    got = idfiles.record_digests(idfiles.write_records(df, vocabulary("byte_bpe_50k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 5, 5]


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_separators_across_blocks(spark, block):
    got = {r.doc_id: r.n_tokens for r in separators.document_token_counts(docs(spark), vocabulary("byte_bpe_50k.json"), 50256, block).collect()} if block > 1 else None
    if got:
        assert got == {k * 3 - 4: len(ids) for k, ids in enumerate(expected(TEXTS, 0, plain=True))}


def test_separators_of_a_raw_file(spark, tmp_path):
    ids = [1, 2, 0, 0, 5, 5, 5, 0, 7]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = separators.flat_files(spark, f"file://{tmp_path}", 2)
    for block in (1, 2, 100):
        got = separators.scan(files, 0, block).orderBy("ordinal").collect()
        assert [(r.start, r.n_tokens, r.closed) for r in got] == [(0, 3, True), (3, 1, True), (4, 4, True), (8, 1, False)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = vocabulary("byte_bpe_50k.json")
    assert separators.document_token_counts(none, path, 50256).count() == 0
    assert idfiles.record_digests(idfiles.write_records(none, path)).count() == 0


def test_merges_equal_the_library():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCoder(path)
    for t in [*filter(None, TEXTS), "the thedealy  theant", "nul\0 byte"]:
        assert np.frombuffer(c.encode([t])[0], "<u4").tolist() == sp.encode(t), t


def test_viterbi_is_the_best_cut():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCoder(path)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(259, 32000)}
    for word in ["▁theant", "▁rechaux", "▁international", "▁a"]:
        best = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max(best[k] + score.get(word[k:end], float("-inf")) for k in range(max(0, end - 16), end))
        ids = np.frombuffer(c.viterbi([word])[0], "<u4").tolist()
        assert sum(sp.get_score(i) for i in ids) == best[-1] and "".join(map(sp.id_to_piece, ids)) == word


def test_pieces_round_trip(spark):
    path = vocabulary("piece_bpe_32k.model")
    got = pieces.encode_checked(docs(spark), path).collect()
    assert all(r.same for r in got) and all(len(r.ids) == r.n_pieces for r in got)
    back = pieces.decode(pieces.encode(docs(spark), path, into="p"), path, "p").collect()
    assert all((r.text or "") == r.decoded for r in back)


def test_parts_of_a_text_do_not_change_its_ids(monkeypatch):
    rng = random.Random(3)
    coder = pieces.PieceCoder(vocabulary("piece_bpe_32k.model"))
    texts = ["", " ", "  a  b ", *("".join(rng.choice([" ", "  ", "\n", "▁", "ab", "the", "é", "漢"]) for _ in range(300)) for _ in range(20))]
    whole = coder.encode(texts)
    for chars, words in ((1, 1), (40, 25)):
        monkeypatch.setattr(pieces, "PART_CHARS", chars)
        monkeypatch.setattr(pieces, "PART_WORDS", words)
        assert coder.encode(texts) == whole


def test_words_without_blanks_of_any_length_equal_the_library():
    import base64
    import random
    import time

    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCoder(path)
    rng = random.Random(5)
    blob = base64.b64encode(rng.randbytes(30_000)).decode()
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    han = "".join(chr(rng.randrange(0x4E00, 0x5200)) for _ in range(5_000))
    words = [blob, letters, han, "a" * 5_000, "\u2603" * 700, "ab" * 256, "ab" * 257, letters[:511], letters[:512], f"one {letters[:2_000]} two\n{blob[:600]}"]
    began = time.time()
    for text, ids in zip(words, coder.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert [b"".join(coder.merges([w])) for w in (letters[:700], blob[:700])] == [coder.merge_long(w) for w in (letters[:700], blob[:700])]
    assert time.time() - began < 60


def test_new_pieces_are_encoded_together():
    """The library gets a few long texts for many new pieces, and each piece has the ids that it has by itself."""
    import random

    from periscan.llm.tokenize import PieceEncoder, vocabulary

    path = vocabulary("byte_bpe_50k.json")
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeXYZ019.,'!-(<|>é世\U0001f600́ß") for _ in range(r.randint(1, 12)))
    texts = ["".join(word() + r.choice(" \n") for _ in range(r.randint(0, 60))) + r.choice(["", " ", "\n", "x"]) for _ in range(200)]
    texts += [" a", "\nb c", " ", "\n", "a", "a  b c", " c  d e", "a\tb c", "x <|endoftext|> y", "a b c", "", None, "I'll we've 's 't\n's x", "z" * 500 + " " + "y" * 300 + " w"]
    for plain in (False, True):
        coder = PieceEncoder(path, plain)
        calls = []
        library = coder.library
        coder.library = lambda x, calls=calls, library=library: calls.append(len(x)) or library(x)
        got = coder.encode(texts)
        assert [g for g, t in zip(got, texts, strict=True) if t] == library([t for t in texts if t]) and got[texts.index("")] == got[texts.index(None)] == b""
        assert sum(calls) < 2.5 * len(texts) < len(coder.kept) and coder.joins
        assert coder.encode(texts) == got
        assert all(len(x) <= 64 for x in coder.kept)
