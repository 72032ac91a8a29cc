"""Operators 6, 8, 9 and 10 on small texts."""
import gc
import random
import weakref

import numpy as np

from armada.llm import licenses, line_quality, personal_data, pieces, workers
from armada.llm.queries import PIECE_BPE, vocabulary


def test_literal_markers_are_encoded_as_in_the_library():
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    model, r = pieces.PieceModel.load(vocabulary(PIECE_BPE)), random.Random(1)
    texts = ["x▁ 7", "▁ a", "a ▁", "▂▁ ▁▃ bars", "▁", *("".join(r.choice("ab7 ▁▁\n") for _ in range(12)) for _ in range(200))]
    got = [np.frombuffer(b, "<i4").tolist() for b in pieces.encode_texts(model, texts)]
    assert got == [library.encode(t) for t in texts]


def test_short_notices_survive_every_allowed_change():
    index = licenses.Index(licenses.TEMPLATES)
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = licenses.tokens(text)
        if len(words) >= licenses.SHORT or len(words) < 5:
            continue
        alone = licenses.Index([licenses.TEMPLATES[k]])
        for i in range(len(words)):
            changed = " ".join(["before", *words[:i], "zzz", *words[i + 1:], "after"])
            assert licenses.find(alone, changed), changed
            assert licenses.find(index, changed), changed
    for text, name in (("Released under an MIT License", "MIT"), ("Licensed under the MIT Licence", "MIT"),
                       ("Licensed with CC BY-NC 4.0", "CC-BY-NC-4.0")):
        assert [index.names[f[2]] for f in licenses.find(index, text)] == [name]


def test_numbers_in_other_groupings_share_a_hub():
    def tied(text, mention):
        f = personal_data.Field(text, personal_data.base_spans(text))
        at = text.rindex(mention)
        own = [i for i, (a, b) in enumerate(f.span) if a >= at and b <= at + len(mention)]
        seen = {h for i, h in zip(f.member.tolist(), f.hub.tolist()) if f.known[i]}
        return [any(h in seen for j, h in zip(f.member.tolist(), f.hub.tolist()) if j == i) for i in own]

    for first, again in (("+33 1 42 68 53 00", "1 42 68 53 00"), ("+33 1 42 68 53 00", "01 42 68 53 00"),
                         ("+1 (826) 555-4081", "826 555 4081"), ("+1 (826) 555-4081", "1 (826) 555-4081"),
                         ("4111 1111 1111 1111", "4111111111111111")):
        for text in (f"Call {first} now or some other day {again} please", f"Call {first} now, or {again} 24 7 please"):
            got = tied(text, again)
            assert got and all(got), (text, got)
    f = personal_data.Field("the years 1999 2000 2001 were good", [])
    assert len(f.hub) == len(set(f.hub.tolist())) == 3


def test_distant_repeats_in_short_groups_are_added():
    r, texts = random.Random(2), []
    group = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    for _ in range(200):
        number = " ".join(["1", *(f"{r.randrange(10, 99)}" for _ in range(4))])
        texts.append(f"Call +33 {number} today, lot {group(3)} of {group(2)} sold {group(2)} {group(2)} times")
    fields = [personal_data.Field(t, personal_data.base_spans(t)) for t in texts]
    pairs = np.zeros((personal_data.LABELS,) * 2)
    for f in fields:
        np.add.at(pairs, (f.known[f.chain], f.known[f.chain + 1]), 1)
    model = personal_data.fit(np.concatenate([f.features for f in fields]), np.concatenate([f.known for f in fields]),
                              pairs, np.eye(personal_data.LABELS))
    text = "Call +33 1 42 68 53 00 today. There is much to say of it, and the desk takes calls at 1 42 68 53 00 all day."
    at = text.rindex("1 42")
    assert (at, 3, at + 13) in model.added(text, personal_data.base_spans(text))


def test_a_phrase_does_not_fail_a_long_line(spark):
    r = random.Random(3)
    sentence = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n)) + "."
    clean = " ".join(sentence(12) for _ in range(20))
    one_line = clean + " We wrote it in JavaScript. " + sentence(12)
    rows = [(0, one_line), (1, clean + "\nClick here"), (2, clean), (3, " ".join(f"w{i}" for i in range(80)) + " lorem ipsum and more")]
    got = {x.doc_id: x.text for x in line_quality.keep_clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: one_line.replace("We wrote it in JavaScript. ", ""), 1: clean, 2: clean, 3: rows[3][1]}


def test_a_second_model_does_not_see_the_first_ones_ids():
    chars = [(c, -10.0) for c in "\u2581abc"]
    one = pieces.PieceModel([*chars, ("ab", -1.0)], {}, 0, "unigram")
    two = pieces.PieceModel([*chars, ("bc", -1.0)], {}, 0, "unigram")
    first, second = (np.frombuffer(pieces.encode_texts(m, ["abc abc"])[0], "<i4").tolist() for m in (one, two))
    assert first == pieces.encode_text(one, "abc abc") != second == pieces.encode_text(two, "abc abc")
    assert pieces.PieceModel([*chars, ("ab", -1.0)], {}, 0, "unigram").key == one.key and list(pieces._CACHES) == [two.key]
    a = pieces.unpacked(*pieces.packed(one))
    assert pieces.unpacked(*pieces.packed(one)) is a and not pieces._CACHES  # a second job of the model brings no copy
    assert pieces.unpacked(*pieces.packed(two)) is not a and list(pieces._MODELS) == [two.key]


def test_a_dropped_generation_of_chunks_is_freed_at_once(monkeypatch):
    class Chunks(dict):
        """A dict that can be watched."""

    model = pieces.PieceModel([(c, -1.0) for c in "\u2581abc"], {}, 0, "unigram")
    monkeypatch.setattr(pieces, "_CACHES", {})
    first = pieces.encode_texts(model, ["ab c"])
    cache, _ = pieces._CACHES[model.key]
    cache.old, cache.limit = Chunks(), 0
    dropped = weakref.ref(cache.old)
    gc.disable()
    try:
        assert pieces.encode_texts(model, ["ab c"]) == first
        assert dropped() is None
    finally:
        gc.enable()


def test_a_worker_gives_up_the_pieces_for_another_operator():
    model = pieces.PieceModel([(c, -1.0) for c in "\u2581abc"], {}, 0, "unigram")
    first = pieces.encode_texts(pieces.unpacked(*pieces.packed(model)), ["ab c"])
    workers.release()
    assert not pieces._MODELS and not pieces._CACHES
    assert pieces.encode_texts(pieces.unpacked(*pieces.packed(model)), ["ab c"]) == first


def test_a_packed_model_is_smaller_than_its_parts():
    import pickle
    import tracemalloc
    raw = pickle.dumps(pieces.PieceModel.load(vocabulary(PIECE_BPE)))
    tracemalloc.start()
    try:
        model = pickle.loads(raw)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert model.model.merges and held < 45e6  # with tuples it was about 70 MB


def test_marks_behind_a_word_are_cut_off_where_no_piece_joins_them(monkeypatch):
    every = [("the", -1.0), ("a.", -2.0), (".", -3.0), ("..", -3.5), *((c, -5.0) for c in "the a!\u2581")]
    seen, window = [], pieces.encode_window
    monkeypatch.setattr(pieces, "encode_window", lambda m, part: seen.append(part) or window(m, part))
    for kind in ("unigram", "bpe"):
        model = pieces.PieceModel(list(dict.fromkeys(every)), {}, 0, kind)
        monkeypatch.setattr(pieces, "_CACHES", {})
        seen.clear()
        texts = ["the.. the... the! a. a.. tha..", "the the.", ".. !.", "the.x."]
        got = [np.frombuffer(b, "<i4").tolist() for b in pieces.encode_texts(model, texts)]
        assert got == [pieces.encode_text(model, t) for t in texts]
        assert seen.count("\u2581the") == 1 and "\u2581the.." not in seen and "\u2581a.." in seen
