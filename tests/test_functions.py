import pytest
from pyspark.sql import functions as F

from msgsearch.functions import flags, names, render, sql, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit(value, kind="string"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(
    "raw, query, full, before, after",
    [
        ("foo context:3", "foo", False, 3, 3),
        ("foo context:2,5", "foo", False, 2, 5),
        ("foo context:,4", "foo", False, 0, 4),
        ("foo context:4,", "foo", False, 4, 0),
        ("foo context:,", "foo", False, 0, 0),
        ("context:99", "", False, 10, 10),
        ("context:-3", "", False, 0, 0),
        ("context:+3", "", False, 3, 3),
        ("context:99999999999", "", False, 10, 10),
        ("context:" + "9" * 60, "", False, 10, 10),
        ("context:0007", "", False, 7, 7),
        ("foo context:abc", "foo context:abc", False, 1, 2),
        ("foo context:", "foo context:", False, 1, 2),
        ("foo context:3.0", "foo context:3.0", False, 1, 2),
        ("foo context:3,x bar", "foo context:3,x bar", False, 3, 2),
        ("foo context:3,4,5", "foo context:3,4,5", False, 3, 2),
        ("foo context:x,3", "foo context:x,3", False, 1, 2),
        ("a context:1 context:4 toggle_on:full toggle_off:full b", "a b", False, 4, 4),
        ("toggle_off:full a  b　c\ntoggle_on:full", "a b c", True, 1, 2),
        ("TOGGLE_ON:full", "TOGGLE_ON:full", False, 1, 2),
    ],
)
def test_parse_flags(spark, raw, query, full, before, after):
    parsed = flags.parse_flags(F.lit(raw), F.lit(False), F.lit(1), F.lit(2))
    row = one(spark, *[c.alias(n) for n, c in parsed.items()])
    assert (row.query, row.full_text, row.before, row.after) == (query, full, before, after)


@pytest.mark.parametrize(
    "before, after, expected",
    [
        (15, 15, (10, 10)),
        (4, 30, (4, 16)),
        (30, 4, (16, 4)),
        (10, 10, (10, 10)),
        (-1, 3, (0, 3)),
        (0, 0, (0, 0)),
        (20, 0, (20, 0)),
        (25, 0, (20, 0)),
    ],
)
def test_context_budget(spark, before, after, expected):
    assert tuple(one(spark, *flags.context_budget(F.lit(before), F.lit(after)))) == expected


@pytest.mark.parametrize(
    "preceding, subsequent, shared, expected",
    [
        (None, None, None, (0, 0)),
        (None, None, 5, (5, 5)),
        (2, None, 5, (2, 5)),
        (None, 0, 5, (5, 0)),
        (-4, 30, -2, (0, 30)),
    ],
)
def test_context_defaults(spark, preceding, subsequent, shared, expected):
    columns = flags.context_defaults(*[lit(x, "int") for x in (preceding, subsequent, shared)])
    assert tuple(one(spark, *columns)) == expected


@pytest.mark.parametrize(
    "raw, route, query",
    [
        ("/start", "help", None),
        ("/startle", "help", None),
        ("/search foo bar", "search", "foo bar"),
        ("/search foo\nbar", "search", "foo"),
        ("/search ", "ignored", None),
        ("/other foo", "ignored", None),
        ("", "ignored", None),
        (None, "ignored", None),
        ("foo /search", "search", "foo /search"),
        ("foo\nbar", "search", "foo\nbar"),
    ],
)
def test_route(spark, raw, route, query):
    raw = lit(raw)
    assert tuple(one(spark, flags.route(raw), flags.routed_query(raw))) == (route, query)


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("Hello, World-wide 42", ["hello", "world", "wide", "42"]),
        ("天", ["天"]),
        ("今天天气", ["今", "天", "天", "气", "今天", "天天", "天气"]),
        ("iPhone手机", ["iphone", "手", "机", "手机"]),
        ("a天b", ["a", "b", "天"]),
        ("!!! ...", []),
        ("ÄÖ ß", ["äö", "ß"]),
        (None, []),
    ],
)
def test_index_tokens(spark, value, tokens):
    assert one(spark, text.index_tokens(lit(value)))[0] == tokens


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("foo-bar-foo", {"foo", "bar"}),
        ("天", {"天"}),
        ("天气", {"天气"}),
        ("今天天气", {"今天", "天天", "天气"}),
        ("a天b手机", {"a", "b", "天", "手机"}),
        ("***", set()),
    ],
)
def test_query_tokens(spark, value, tokens):
    found = one(spark, text.query_tokens(F.lit(value)))[0]
    assert set(found) == tokens and len(found) == len(tokens)


def test_split_on_any_blank(spark):
    row = one(spark, text.split_blanks(F.lit(" a\tb c　d e\x85f\n\x1fg ")))
    assert row[0] == list("abcdefg")


def test_missing_is_empty_or_zero(spark):
    def sender(*ids):
        return one(spark, names.sender_id(*[lit(i, "bigint") for i in ids]))[0]

    def name(*parts):
        return one(spark, names.display_name(*[lit(p) for p in parts]))[0]

    assert sender(0, 7, 8) == 7
    assert sender(None, None, 8) == 8
    assert sender(0, None, 0) is None
    assert name(None, "T", "L") == "T L"
    assert name("", "T", "") == "T"
    assert name("F", "T", "L") == "F L"
    assert name("", None, "L") is None


@pytest.mark.parametrize(
    "private, sender, expected",
    [(True, 1, "chat"), (True, 2, "me"), (True, None, "me"), (False, 2, "chat"), (False, None, "chat")],
)
def test_receiver(spark, private, sender, expected):
    column = names.receiver_name(
        F.lit(private), lit(sender, "bigint"), lit(1, "bigint"), F.lit("chat"), F.lit("me")
    )
    assert one(spark, column)[0] == expected


def test_chat_references(spark):
    def bare(ref):
        return tuple(one(spark, names.numeric_chat_id(F.lit(ref)), names.username(F.lit(ref))))

    assert bare("-1001234567890") == (1234567890, None)
    assert bare("98765") == (98765, None)
    assert bare("-1005") == (1005, None)
    assert bare("@TestUser") == (None, "testuser")
    assert bare("testuser") == (None, "testuser")


def test_date_missing_is_zero(spark):
    assert one(spark, names.unix_date(F.lit(None)))[0] == 0
    assert one(spark, names.unix_date(F.lit("2024-01-01 00:00:00")))[0] == 1704067200


@pytest.mark.parametrize("length, full, expected", [(200, False, 200), (201, False, 200), (201, True, 201)])
def test_preview(spark, length, full, expected):
    shown = one(spark, render.preview(F.lit("x" * length), F.lit(full)))[0]
    assert len(shown) == expected
    assert shown.endswith("...") == (length > 200 and not full)


def test_labels_and_dates(spark):
    def who(sender, receiver, title):
        return one(spark, render.who_label(lit(sender), lit(receiver), lit(title)))[0]

    assert who("A", "B", "T") == "A → B"
    assert who("A", "A", "T") == "A"
    assert who(None, "", "T") == "Unknown → T"
    assert who("", None, None) == "Unknown"
    assert one(spark, render.format_date(F.lit(0)))[0] == "1970-01-01 00:00"


def pack(body, size):
    """Greedy packing of lines, written out step by step."""
    if len(body) <= size:
        return [body]
    done, current = [], ""
    for line in body.split("\n"):
        joined = f"{current}\n{line}" if current else line
        if len(joined) <= size:
            current = joined
            continue
        if current:
            done.append(current)
        while len(line) > size:
            done.append(line[:size])
            line = line[size:]
        current = line
    return done + [current] if current else done


@pytest.mark.parametrize(
    "body",
    [
        "short",
        "",
        "aaaa\nbbbb\ncccc\ndddd",
        "a" * 35,
        "a" * 30,
        "aa\n" + "b" * 25 + "\ncc",
        "\n\n\naaaaaaaaa\n\nbbb\n\n",
        "🔍" * 23 + "\n" + "⬆️" * 3,
        "a" * 10 + "\n" + "b" * 10 + "\n",
        "a" * 11 + "\n",
    ],
)
def test_chunks(spark, body):
    assert one(spark, render.chunks(F.lit(body), 10))[0] == pack(body, 10)


def test_functions_in_sql_agree(spark):
    sql.register(spark)
    texts = ["Hello, World 42", "今天天气 nice 真 day", "真", "", None, "one\n\n" + "x" * 25 + "\ntail", "a\nb\nc" * 9, "\u2003a\x85b c "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    frame.createOrReplaceTempView("sql_texts")
    pairs = [
        ("index_tokens(t)", text.index_tokens(F.col("t"))),
        ("query_tokens(t)", text.query_tokens(F.col("t"))),
        ("query_parts(t)", text.split_blanks(F.col("t"))),
        ("message_chunks(t, 10)", render.chunks(F.col("t"), 10)),
    ]
    for call, column in pairs:
        got = [r[0] for r in spark.sql(f"SELECT {call} FROM sql_texts").collect()]
        assert got == [r[0] for r in frame.select(column).collect()], call
    lines = spark.sql("SELECT t, c.chunk_no, c.chunk FROM sql_texts, LATERAL chunk_lines(t, 10) AS c").collect()
    want = [(t, i + 1, c) for t, (cs,) in zip(texts, frame.select(render.chunks(F.col("t"), 10)).collect()) for i, c in enumerate(cs or [])]
    assert sorted(map(tuple, lines), key=str) == sorted(want, key=str)
    assert spark.sql("SELECT term_rarity(1L, 10L) > term_rarity(5L, 10L) AND term_saturation(2L, 5L, 9D) > term_saturation(1L, 5L, 9D)").first()[0]


def test_words_between_ideographs_take_one_pass(spark):
    rows = spark.createDataFrame([("Ab1天气c-É今x_9",), ("天",), ("İ x²",), (None,), ("",)], "t string")
    one = F.coalesce(text.tokens(F.col("t")), F.array().cast("array<string>"))
    words = F.regexp_extract_all(F.regexp_replace(F.lower("t"), f"{text.CJK}+", " "), F.lit(text.WORD), F.lit(0))
    assert "regexp_replace" not in str(text.tokens(F.col("t")))
    assert [r[0] for r in rows.select(one).collect()] == [r[0] or [] for r in rows.select(words).collect()]
