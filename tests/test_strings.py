import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import strings as s


@pytest.mark.parametrize("text", ["plain", "back\\slash", "(nested (twice))", "line\none", "tab\there", "naïve café", "dash – and € sign", "Żółw", "数字", "🙂", ""])
def test_text_round_trip(text):
    assert s.string_text(s.encode_text(text)) == text


@pytest.mark.parametrize(
    ("text", "lexeme"),
    [("Total: 5 €", "(Total: 5 \xa0)"), ("a)b", "(a\\)b)"), ("))", "<2929>"), ("Ł", "(\x95)"), ("ł1", "(\x9b1)"), ("ę", "<FEFF0119>"), ("🙂", "<FEFFD83DDE42>"), ("", "<>")],
)
def test_text_forms(text, lexeme):
    assert s.encode_text(text) == lexeme


def test_text_that_looks_like_a_mark():
    mark = s.doc_decode(b"\xfe\xff")
    assert s.encode_text(mark + "1") == "<FEFF" + (mark + "1").encode("utf-16-be").hex().upper() + ">"
    assert s.encode_text(mark[::-1]) == "(" + mark[::-1] + ")"
    with pytest.raises(ValueError):
        s.encode_text(mark, "pdfdocencoding")


def test_forced_encodings():
    with pytest.raises(ValueError):
        s.encode_text("ę", "pdfdocencoding")
    with pytest.raises(ValueError):
        s.encode_text("a", "latin")
    with pytest.raises(ValueError):
        s.encode_bytes(b"a", "octal")
    assert s.encode_text("ok", "utf16") == "<FEFF006F006B>" and s.encode_text("ok", "utf16", "literal") == "(\xfe\xff\0o\0k)"
    assert s.encode_bytes(b"xyz") == "(xyz)" and s.encode_bytes(b"xyz", "hex") == "<78797A>" and s.encode_bytes(b"\\") == "<5C>"


@pytest.mark.parametrize("end", ["\n", "\r", "\r\n"])
def test_continued_lines(end):
    assert s.string_text(f"(one \\{end}line \\{end}of three)") == "one line of three"


# Examples of the specification of the format, and escapes of our own
@pytest.mark.parametrize(
    ("lexeme", "raw"),
    [("<4E6F762073686D6F7A206B6120706F702E>", b"Nov shmoz ka pop."), ("<901FA3>", b"\x90\x1f\xa3"), ("<901FA>", b"\x90\x1f\xa0"), (r"(\0053)", b"\x053"), (r"(\053)", b"+"), (r"(\53)", b"+"),
     ("<6a 6B\t6c\n>", b"jkl"), (r"(\101\102\7\r\t\z\400)", b"AB\x07\r\tz\x00"), (r"(a\(b\)c\\)", b"a(b)c\\"), ("()", b""), ("<>", b"")],
)
def test_bytes_of(lexeme, raw):
    assert s.string_bytes(lexeme) == raw


def test_what_is_no_string():
    assert s.string_text("(\xfe\xff\0w\0o\0w)") == "wow"
    for bad in ("plain", "(open", "<41", ""):
        with pytest.raises(ValueError):
            s.string_bytes(bad)
    for raw in (b"\x7f", b"\x9f", b"\xad"):
        with pytest.raises(ValueError):
            s.doc_decode(raw)


@given(st.binary(max_size=60), st.sampled_from(["auto", "literal", "hex"]))
def test_any_bytes_round_trip(raw, mode):
    back = s.string_bytes(s.encode_bytes(raw, mode))
    assert back == raw


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_round_trip(text):
    assert s.string_text(s.encode_text(text)) == text


def test_names():
    assert s.name_encode("/A b(c)") == "/A#20b#28c#29" and s.name_decode("/A#20b#28c#29") == "/A b(c)" and s.name_encode("/A#") == "/A#"


def test_places_and_numbers():
    assert s.line_and_column("one\r\ntwo\rthree\nfour", 16) == (4, 2)
    assert s.line_and_column("start", 0) == (1, 1)
    assert [s.number_text(x) for x in (2.0, 0.25, 1e-12, -0.0, 98765432.125)] == ["2", "0.25", "0", "0", "98765432.125"]
    assert s.quoted("x" * 26) == repr("x" * 26) and s.quoted("x" * 27) == repr("x" * 26) + " ..."


def test_text_columns_choose_as_the_functions(spark):
    texts = ["plain", "))", "a)b(", "5 €", "Ł", "ę", "🙂 x", "", "\u00fe\u00ff1", "\x7f", "\u00ad", "tab\tx", "\x01", "naïve", "•" * 3, None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", s.text_column(F.col("t")).alias("lexeme")).collect()
    assert all(r.lexeme == (None if r.t is None else s.encode_text(r.t)) for r in rows), rows
    raws = [b"abc", b"\x80\x18\xa0", b"\x7f", b"a\xad", b"\x9f", b"\xfe\xff\0a", b"\xfe\xff\0", b"\xfe\xff", b"", b"\x07"]
    found = spark.createDataFrame([(x,) for x in raws], "b binary").select("b", s.doc_text_column(F.col("b")).alias("t"), s.doc_text_problem(F.col("b")).alias("p")).collect()
    for r in found:
        raw = bytes(r.b)
        try:
            want = raw[2:].decode("utf-16-be") if raw[:2] == b"\xfe\xff" else s.doc_decode(raw)
        except ValueError:
            want = None
        assert (r.t, r.p is None) == (want, want is not None), r


def test_place_columns(spark):
    text = "one\r\ntwo\rthree\n\nfour"
    rows = spark.createDataFrame([(text, k) for k in range(len(text) + 1)], "t string, k int").select("k", s.line_column(F.col("t"), F.col("k")).alias("line"), s.column_column(F.col("t"), F.col("k")).alias("column")).collect()
    assert all((r.line, r.column) == s.line_and_column(text, r.k) for r in rows)


def test_columns_agree(spark):
    texts = ["(a)\\b", "é € x", "", "þÿ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", s.literal_column(F.col("t")).alias("lit"), s.utf16_hex_column(F.col("t")).alias("wide"), s.doc_text_column(s.hex_column(s.utf16_hex_column(F.col("t")))).alias("back")).collect()
    assert all(r.back == r.t and r.wide == s.encode_text(r.t, "utf16") for r in rows)
    assert {r.t: r.lit for r in rows}["(a)\\b"] == r"(\(a\)\\b)"
    odd = spark.createDataFrame([("<ABC>",), ("<41 42>",), ("<>",)], "h string").select(s.hex_column(F.col("h")).alias("b")).collect()
    assert [bytes(r.b) for r in odd] == [b"\xab\xc0", b"AB", b""]
    mixed = spark.createDataFrame([(b"\x80\xa0A",), (b"\xfe\xff\x00A",), (None,)], "b binary").select(s.doc_text_column(F.col("b")).alias("t")).collect()
    assert [r.t for r in mixed] == ["•€A", "A", None]
    named = spark.createDataFrame([("/a b%",), (None,)], "n string").select(s.name_column(F.col("n")).alias("n"), s.name_decode_udf(s.name_column(F.col("n"))).alias("m")).collect()
    assert [tuple(r) for r in named] == [("/a#20b#25", "/a b%"), (None, None)]
