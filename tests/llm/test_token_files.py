import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from msgsearch.llm import histogram_packing as hp
from msgsearch.llm import token_bytes, token_files as tf
from msgsearch.llm.queries import vocabulary
from msgsearch.llm.token_bytes import piece_ids
from msgsearch.session import scratch_dir

WORDS = vocabulary("word_bpe_49k.json")
BYTES = vocabulary("byte_bpe_50k.json")
ODD = ["", "  ", "a  b", "a\n\nb c \n", " x", "x<|endoftext|>y <|endoftext|> z", "\xa0 \n\nword  q", "don't I'LL ΑΣ İ", "!\x1c \x85 x", "a　 b", "日本語 テスト", "x" * 3000, "\r\n\r\n x\r\n", "é \x00", "voilà là à l’été ÀÃ\xa0!"]


def whole(path, text):
    plain = piece_ids(path).plain
    return plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, way", [(WORDS, "words"), (BYTES, "blanks")])
def test_pieces_equal_whole_texts(path, way):
    import pyarrow as pa

    found = getattr(piece_ids(path), way)(pa.array([*ODD, None]))
    for text, ids in zip([*ODD, ""], found):
        assert np.frombuffer(ids, "<u4").tolist() == whole(path, text), text


def test_files_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 16)
    rows = [(i, " ".join(["some words"] * (i % 7))) for i in range(40)] + [(None, None), (3, "again"), (99, "long text " * 300)]
    path = scratch_dir(spark, "tokens")
    files = tf.write_files(texts(*rows).coalesce(2), path, tf.word_encoder(WORDS))
    back = sorted(tf.read_files(spark, path, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in back:
        assert r.start == at
        at += r.n_tokens
    expected = sorted(str(whole(WORDS, t or "") + [1]) for _, t in rows)
    assert sorted(str(np.frombuffer(r.ids, "<u4").tolist()) for r in back) == expected
    wanted = spark.createDataFrame([(5,), (99,), (3,), (12345,)], "doc_id bigint")
    found = tf.fetch(path, files, wanted).collect()
    assert sorted(r.doc_id for r in found) == [3, 3, 5, 99]


def test_reader_unpacks_only_what_it_needs_and_sees_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 10)
    path = str(tmp_path / "f.zst")
    out = tf.TokenFileWriter(path)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 25, 7, 100)]
    for i, ids in enumerate(docs):
        out.add(i, ids)
    out.close()
    opened = tf.TokenFile(path)
    assert opened.ids(0) == docs[0] and opened.frame_read == 1
    assert [opened.ids(k) for k in range(5)] == docs
    raw = (tmp_path / "f.zst").read_bytes()
    assert struct.unpack("<I", raw[-4:])[0] == tf.FOOTER_MAGIC
    unpacked = b"".join(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).readall() for _ in range(1))
    assert unpacked.startswith(docs[0])
    bad = bytearray(raw)
    bad[6] ^= 0xFF
    (tmp_path / "bad.zst").write_bytes(bad)
    with pytest.raises(Exception):
        tf.TokenFile(str(tmp_path / "bad.zst")).ids(0)


def test_equal_ids_are_spread(spark, tmp_path):
    """A third of all rows has one id, a third none; their order does not depend on that of the input."""
    kinds = "CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN id END AS doc_id"
    rows = spark.range(0, 9000, 1, 6).selectExpr(kinds, "concat('text ', id) AS text", "'x' AS ids", "1 AS start")

    def written(frame, name):
        path = str(tmp_path / name)
        (tmp_path / name).mkdir()
        files = tf.write_files(frame, path, tf.word_encoder(WORDS))
        back = tf.read_files(spark, path, files).orderBy("start").collect()
        return files, [(r.doc_id, bytes(r.ids)) for r in back], path

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would get one file
    try:
        files, found, path = written(rows, "a")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [d for d, _ in found] == [None] * 3000 + sorted([7] * 3000 + [i for i in range(9000) if i % 3 == 1])
    assert found == written(rows.repartition(3, "text"), "b")[1]
    assert files.count() > 2 and files.where("first_id = 7 OR last_id = 7").count() > 1
    asked = spark.createDataFrame([(7,), (10,), (11,)], "doc_id bigint")
    got = tf.fetch(path, files, asked).collect()
    assert sorted(bytes(r.ids) for r in got) == sorted(x for d, x in found if d in (7, 10))


def test_empty_table_gives_nothing(texts):
    assert tf.token_digests(texts((1, "a")).where("false"), WORDS).count() == 0
    assert hp.packed_documents(texts((1, "a")).where("false"), BYTES).count() == 0


def test_packing_places_every_token_once(spark, texts):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(120)] + [(None, None), (5, "word"), (5, "word"), (7, "long " * 5000)]
    placed = hp.packed_documents(texts(*rows), BYTES).collect()
    sequences = {}
    for p in placed:
        sequences.setdefault(p.sequence_id, []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= hp.SIZE
    total = sum(len(whole(BYTES, t or "")) + 1 for _, t in rows)
    assert sum(p.length for p in placed) == total
    assert total / (len(sequences) * hp.SIZE) > 0.95
    long = sorted((p for p in placed if p.doc_id == 7 and p.doc_tokens > 1024), key=lambda p: p.start)
    ids = whole(BYTES, "long " * 5000) + [0]
    for p in long:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_packed_sequences_hold_the_ids(texts):
    pieces = hp.cut(texts((1, "a b c"), (2, "d")), BYTES, with_ids=True)
    (row,) = hp.sequences(hp.pack(pieces)).collect()
    ids = np.frombuffer(row.input_ids, "<u4").tolist()
    assert ids in ([*whole(BYTES, "a b c"), 0, *whole(BYTES, "d"), 0], [*whole(BYTES, "d"), 0, *whole(BYTES, "a b c"), 0])


@pytest.mark.parametrize("counts", [{}, {1024: 5}, {1: 3000}, {600: 10, 424: 10, 1: 1}, {i: i % 7 + 1 for i in range(1, 1024)}])
def test_patterns_use_every_piece(counts):
    used = {}
    for pattern, count in hp.pack_histogram(counts):
        assert sum(n * k for n, k in pattern) <= hp.SIZE
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * count
    assert used == {n: c for n, c in counts.items() if c}


def test_what_a_worker_keeps_is_bounded_and_what_recurs_stays(monkeypatch):
    monkeypatch.setattr(token_bytes, "KEPT", 10)
    coder = token_bytes.PieceIds(BYTES)
    learned = []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda pieces, known: (learned.extend(pieces), learn(pieces, known)))
    for n in range(0, 60, 3):
        texts = [f"always word{n + k}" for k in range(3)]
        expected = [coder.plain.encode(x, add_special_tokens=False).ids for x in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.blanks(pa.array(texts))] == expected
        assert len(coder.known) + len(coder.before) <= 2 * (10 + 4)
    assert learned.count("always") == 1


def learned_by(path, way, texts, monkeypatch):
    coder = token_bytes.PieceIds(path)
    learned = []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda pieces, known: (learned.extend(pieces), learn(pieces, known)))
    expected = [coder.plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in getattr(coder, way)(pa.array(texts))] == expected
    return sorted(learned)


def test_blanks_learns_a_word_once_whatever_signs_and_lines_touch_it(monkeypatch):
    texts = ["a Größe, (Größe).\nGröße!\nGröße 12Größe? Größe. Größe, Größe"]
    assert learned_by(BYTES, "blanks", texts, monkeypatch) == sorted(["a", " Größe", "Größe", ",", " (", ").", "\n", "!", " 12", "?", "."])


LATIN = [chr(x) for x in range(0xC0, 0x180)]
MARKS = "\u0301\u0307\u0338"
TOUCHING = [f"{c}, {c}'s.{c}1{c}\n{c}\n\n{c} \n {c}\t{c}\xa0 {c}\u2009 ({c}{m}={m}{c}" for c in [*LATIN, "Σ", "日"] for m in MARKS]


def test_blanks_of_every_letter_signs_and_spaces_equal_whole_texts():
    coder = token_bytes.PieceIds(BYTES)
    expected = [coder.plain.encode(x, add_special_tokens=False).ids for x in TOUCHING]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.blanks(pa.array(TOUCHING))] == expected


def test_words_learns_a_word_once_whatever_case_and_signs_it_has(monkeypatch):
    texts = ["Große (große), GROßE. große!\nGroße 12große 'große don't Große"]
    assert learned_by(WORDS, "words", texts, monkeypatch) == sorted(["große", "(", "),", ".", "!", "12", "'große", "don", "'t"])


def test_words_of_every_letter_signs_and_spaces_equal_whole_texts():
    coder = token_bytes.PieceIds(WORDS)
    expected = [coder.plain.encode(x, add_special_tokens=False).ids for x in TOUCHING]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.words(pa.array(TOUCHING))] == expected
