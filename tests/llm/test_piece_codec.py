import random

import numpy as np
import pytest
import sentencepiece

from msgsearch.llm import piece_codec as pc
from msgsearch.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The library's own unigram pass over the same vocabulary and scores."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    scores = pc.codec(PATH).vocabulary.scores
    for i, piece in enumerate(model.pieces):
        if i in scores:
            piece.score = scores[i]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def cases():
    random.seed(3)
    letters = "abcdefg  \n\té①日本語▁한xyzthe,."
    made = ["".join(random.choice(letters) for _ in range(random.randrange(1, 90))) for _ in range(400)]
    return made + ["", " ", "a" * 3000, " " * 100 + "x", "日本" * 200, "the" * 500 + " " * 40]


def test_ids_equal_the_library(library):
    made = pc.Codec(PATH)
    for text in cases():
        ids = np.frombuffer(made.encode(text), "<u4").tolist()
        assert ids == (library.encode(text) if text else []), text
        assert made.decode(made.encode(text)) == text.replace("▁", " ")


def test_stream_equals_whole_and_keeps_a_small_window(library):
    words = pc.codec(PATH).vocabulary
    for text in cases()[:150]:
        stream, at = pc.Stream(words), 0
        whole = pc.BLANK + text.replace(" ", pc.BLANK)
        while at < len(whole):
            step = random.randrange(1, 9)
            stream.feed(whole[at : at + step])
            at += step
        assert stream.finish() == library.encode(text)
    stream = pc.Stream(words)
    for k in range(3000):
        stream.feed(f"w{k % 97}q")
    assert len(stream.finish()) > 3000 and stream.widest <= 4 * words.longest


def test_all_texts_take_the_pass(library, monkeypatch):
    """Short ones too; what recurs takes it once."""
    passed = []
    finish = pc.Stream.finish
    monkeypatch.setattr(pc.Stream, "finish", lambda s: passed.append(1) or finish(s))
    made = pc.Codec(PATH)
    text = "unbelievable things, unbelievable things " + "internationalisation" * 50
    assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode(text)
    once = len(passed)
    assert once
    made.encode("unbelievable things, unbelievable things")
    assert len(passed) == once


def test_text_that_is_final_is_dropped(library, monkeypatch):
    monkeypatch.setattr(pc, "CHUNK", 50)
    words, held = pc.codec(PATH).vocabulary, []
    for text in ("internationalisation" * 300, "the" * 900, "a" * 700, "日本語" * 300):
        stream, whole = pc.Stream(words), pc.BLANK + text
        for begin in range(0, len(whole), 50):
            stream.feed(whole[begin : begin + 50])
            held.append(len(stream.text))
        assert stream.finish() == library.encode(text)
    assert max(held) < 800  # the run of one letter stays open, the others do not
    assert max(held[: len("internationalisation" * 300) // 50]) <= 100 + 4 * words.longest


def test_documents(texts):
    frame = texts((1, None), (1, ""), (2, "a ▁ b"), (2, "a ▁ b"), (3, "long " * 20000 + "x" * 5000), (None, "é日①"), extra="1 AS ids")
    rows = pc.coded_documents(frame, PATH).collect()
    assert len(rows) == 6 and all(r.round_trip for r in rows)
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0]
    assert pc.coded_documents(frame.where("false"), PATH).count() == 0
    encoded = pc.encode(frame, PATH)
    assert encoded.columns == [*[c for c in frame.columns if c != "ids"], "ids"]
