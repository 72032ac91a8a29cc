"""Operators 3, 6 and 7 against the libraries that own the vocabularies."""
import random
import zlib

import numpy as np
import pytest

from armada.llm import merges, pieces, storage, token_counts, token_files
from armada.llm.queries import PIECE_BPE, WORD_BPE, vocabulary, vocabulary_text

ODD = [None, "", " ", "\n", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't I'LL we'Re 'S x's", "é é 가",
       "a\xa0b　c", "12345 67.8!!?", "​ ﻿ x", "x" * 5000, "日本語 テスト", "aͅb", " q\x0b\x0c\x1c z", "<|endof",
       "'" * 9 + "s", "İstanbul ẞ ﬁ ǅ", "😀😀👨‍👩", "  two  spaces ", "tab\there", "ab " * 3000]


def texts(seed, n):
    r = random.Random(seed)
    letters = "aeiounrstlhdcABTé'.,! 0129\n"
    return ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, 0, "x") for i, t in enumerate(ODD + texts(1, 150))] + [(None, "null id", 0, "x"), (3, "same id", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(4)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(WORD_BPE))


def test_token_files(spark, table, word_bpe):
    manifest = token_files.write_token_files(table, vocabulary_text(WORD_BPE), 1, partitions=5)
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    rows = table.collect()
    assert len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()

    def digest(t):
        x = np.array(word_bpe.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        return len(x), zlib.crc32(x.tobytes())
    assert sorted(((r.doc_id or -1), r.n_tokens, r.ids_crc32) for r in got) == sorted(((r.doc_id or -1), *digest(r.text)) for r in rows)
    # the flat files, mapped: offsets start at zero and end at the number of ids
    for part in manifest["parts"]:
        off = storage.map_array(f"{manifest['folder']}/{part['stem']}.off", "<u8")
        flat = storage.map_array(f"{manifest['folder']}/{part['stem']}.ids", manifest["dtype"])
        assert off[0] == 0 and off[-1] == len(flat) and isinstance(flat, np.memmap)
    empty = token_files.write_token_files(table.limit(0), vocabulary_text(WORD_BPE), 1)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_words_go_to_the_library_many_at_a_time(word_bpe, monkeypatch):
    import pyarrow as pa
    vocab, given = vocabulary_text(WORD_BPE), []

    class Counting:
        def encode_batch_fast(self, parts, add_special_tokens):
            given.extend(parts)
            return word_bpe.encode_batch_fast(parts, add_special_tokens=add_special_tokens)

    monkeypatch.setattr(token_files, "tokenizer_of", lambda _: Counting())
    monkeypatch.setattr(token_files, "_CACHES", {})
    out, lengths = token_files.encode_column(pa.array([" Word word. word,, été... Été", None, "word."]), vocab, "<u2", 1)
    want = [word_bpe.encode(t, add_special_tokens=False).ids + [1] for t in (" Word word. word,, été... Été", "", "word.")]
    assert out.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
    assert len(given) == 1 and sorted(given[0].split()) == sorted([",,", ".", "...", "word", "été", "Été"])  # lower case is ASCII's here
    every = ODD + texts(4, 300) + ["J\u030cx ﬀ Ǆ ª… x<|endoftext|>! end</w> </w> ½ x² naïve!? _a_ a_ ΟΔΟΣ. İ! ʼn"]
    for monkey in (None, 3):  # a small cache is turned often
        if monkey:
            monkeypatch.setattr(token_files.ChunkCache.__init__, "__defaults__", (monkey,))
            monkeypatch.setattr(token_files, "_CACHES", {})
        for i in range(0, len(every), 50):
            out, lengths = token_files.encode_column(pa.array(every[i:i + 50]), vocab, "<u2", 1)
            want = [word_bpe.encode(t or "", add_special_tokens=False).ids + [1] for t in every[i:i + 50]]
            assert out.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
    other = vocab.replace("NFC", "NFKC", 1)
    assert token_files.by_word(vocab) is not None and token_files.by_word(other) is None
    out, lengths = token_files.encode_column(pa.array(["a b"]), vocab, "<u4", 1, by_chunk=False)
    assert out.tolist() == word_bpe.encode("a b", add_special_tokens=False).ids + [1] and lengths.tolist() == [3]
    assert token_files.encode_column(pa.array([], pa.string()), vocab, "<u2", 1)[1].tolist() == []


def test_token_files_of_very_long_texts(spark, word_bpe):
    r = random.Random(9)
    rows = [(2, " ".join(texts(9, 4000))), (1, "".join(r.choice("abcé漢") for _ in range(200_000))), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.read_token_files(spark, token_files.write_token_files(df, vocabulary_text(WORD_BPE), 1, partitions=2))
    want = {d: np.array(word_bpe.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in rows}
    assert {x.doc_id: (x.n_tokens, x.ids_crc32) for x in got.collect()} == {
        d: (len(v), zlib.crc32(v.tobytes())) for d, v in want.items()}


def test_token_counts(table, word_bpe, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 64)
    counter = token_counts.Counter(vocabulary_text(WORD_BPE))
    every = ODD + texts(2, 300)
    expected = [len(word_bpe.encode(t or "", add_special_tokens=False).ids) for t in every]
    assert counter.count(every).tolist() == expected
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)  # the table is emptied now and then
    for t, n in zip(every[:80], expected):
        assert counter.count([t]).tolist() == [n]
    got = token_counts.count_tokens(table, vocabulary_text(WORD_BPE), 2048)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == sorted(
        (r.doc_id or -1, len((r.text or "").encode()), n := len(word_bpe.encode(r.text or "", add_special_tokens=False).ids), n > 2048)
        for r in table.collect())
    assert token_counts.count_tokens(table.limit(0), vocabulary_text(WORD_BPE), 1).count() == 0


def test_pieces(spark, table):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    got = pieces.encode_pieces(table, vocabulary(PIECE_BPE))
    assert sorted((r.doc_id or -1, r.ids) for r in got.collect()) == sorted(
        (r.doc_id or -1, library.encode(r.text or "")) for r in table.collect())
    assert got.where("not round_trip or n_tokens != size(ids)").isEmpty()
    back = pieces.decode_pieces(got, vocabulary(PIECE_BPE))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r.doc_id or -1, r.text or "") for r in table.collect())
    assert pieces.encode_pieces(table.limit(0), vocabulary(PIECE_BPE)).count() == 0


def test_open_window_stays_bounded():
    model = pieces.PieceModel.load(vocabulary(PIECE_BPE))
    enc = pieces.StreamEncoder(model)
    text = "".join(random.Random(3).choice("aeinrst") for _ in range(20_000))
    ids = enc.push(text) + enc.finish()
    assert enc.most_open <= 3 * model.reach
    assert [model.text[i] for i in ids] and "".join(model.text[i] for i in ids) == text


def test_window_and_stream_agree():
    model = pieces.PieceModel.load(vocabulary(PIECE_BPE))
    r = random.Random(6)
    for _ in range(1500):
        text = "▁" + "".join(r.choice("aeinrstößédl-.,'▁") for _ in range(r.randrange(1, 2 * model.reach)))
        enc = pieces.StreamEncoder(model)
        assert pieces.encode_window(model, text) == enc.push(text) + enc.finish()
    assert pieces.encode_window(model, "▁a\ue123b") is None


def test_new_chunks_run_through_the_lattice_many_at_a_time(monkeypatch):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    model, r, alone, pushed = pieces.PieceModel.load(vocabulary(PIECE_BPE)), random.Random(8), [], []
    window, push = pieces.encode_window, pieces.StreamEncoder.push
    monkeypatch.setattr(pieces, "encode_window", lambda m, part: alone.append(part) or window(m, part))
    monkeypatch.setattr(pieces.StreamEncoder, "push", lambda enc, part: pushed.append(part) or push(enc, part))
    syllables = ["the", "er", "tion", "ö", "zz", "qu", "a", "B", "'", "-", "é", "7", "in", "st"]
    words = ["".join(r.choices(syllables, k=r.randrange(1, 9))) for _ in range(3000)]
    every = [" ".join(words[:1500]), "\n".join(words[1500:]), "one\ue123two " + ", ".join(words[::7]), *ODD, *texts(8, 100)]
    for pairs, lanes in ((21, 8192), (4, 60)):  # neighbours are forgotten; chunks run in many groups
        monkeypatch.setattr(pieces, "PAIRS", pairs)
        monkeypatch.setattr(pieces, "LANES", lanes)
        monkeypatch.setattr(pieces, "_CACHES", {})
        alone.clear()
        got = [np.frombuffer(b, "<i4").tolist() for b in pieces.encode_texts(model, every)]
        assert got == [library.encode(t or "") for t in every]
        assert len(alone) <= pieces.FEW and all(len(p) > 2 * model.reach or "\ue123" in p or not p.isalnum() for p in pushed)


def test_lockstep_is_the_window():
    model, r = pieces.PieceModel.load(vocabulary(PIECE_BPE)), random.Random(10)
    step = pieces.Lockstep(model)
    some = ["▁" + "".join(r.choices("aeinrstößédl-.,'▁\ue123\n", k=r.randrange(2 * model.reach))) for _ in range(3000)] * 2
    want = [pieces.encode_window(model, t) for t in some]
    assert step.encode(some) == [None if x is None else np.array(x, "<i4").tobytes() for x in want] and None in want
    assert step.encode(["\ue123"]) == [None] and step.encode([]) == []


def test_lockstep_of_small_merge_models():
    r = random.Random(11)
    for k in range(200):
        grown = ["a", "b", "c"]
        for _ in range(r.randrange(1, 9)):
            grown.append(r.choice(grown) + r.choice(grown))
        model = pieces.PieceModel([(p, -float(r.randrange(1, 6) if k % 2 else i)) for i, p in enumerate(dict.fromkeys(grown))],
                                  {}, -1, "bpe", dummy_prefix=False)
        some = ["".join(r.choices("abcx", (9, 9, 9, 1), k=r.randrange(1, 12))) for _ in range(60)]
        want = [pieces.encode_window(model, t) for t in some]
        assert pieces.Lockstep(model).encode(some) == [None if x is None else np.array(x, "<i4").tobytes() for x in want]
        known = np.array(list(model.model.left))
        a, b = known[[r.randrange(len(known)) for _ in some]], known[[r.randrange(len(known)) for _ in some]]
        assert model.model.fits_many(a, b).tolist() == [model.model.fits(*pair) for pair in zip(a.tolist(), b.tolist())]


def test_unigram_takes_the_best_path():
    scores = {"a": -2.0, "b": -2.0, "c": -2.5, "ab": -3.5, "bc": -2.8, "abc": -5.0, "ca": -3.0}
    model = pieces.PieceModel(list(scores.items()), {}, -1, "unigram", dummy_prefix=False)
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice("abc") for _ in range(r.randrange(1, 25)))
        best = [0.0] + [None] * len(text)
        for i in range(1, len(text) + 1):
            best[i] = max(best[j] + scores[text[j:i]] for j in range(max(0, i - 3), i) if text[j:i] in scores)
        for ids in (pieces.encode_text(model, text), pieces.encode_window(model, text)):
            assert "".join(model.text[i] for i in ids) == text
            assert abs(sum(model.score[i] for i in ids) - best[-1]) < 1e-9


def test_neighbours_that_fit_are_the_encoding():
    model, _ = merges.from_word_bpe(vocabulary_text(WORD_BPE))
    r = random.Random(5)
    known = [t for t in model.left][:4000]
    for _ in range(300):
        a, b = r.choice(known), r.choice(known)
        if model.in_order:
            assert isinstance(model.fits(a, b), bool)
