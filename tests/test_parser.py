import random
import struct
import zlib

import pyarrow as pa
import pytest

from quire.sources import objects as o
from quire.sources import pdf
from quire.sources.lexer import Lexer, PdfSyntaxError, tokens
from quire.sources.parser import decoded, parse
from quire.sources.writer import from_pages, serialize, wrapped


def build(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R", head: bytes = b"%PDF-1.4\n", shift: dict[int, int] | None = None) -> bytes:
    """A document written by hand, without the writer."""
    out, at = head, {}
    for n, body in objects.items():
        at[n] = len(out) + (shift or {}).get(n, 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f\r\n" + b"".join(b"%d 1\n%010d 00000 n\r\n" % (n, at[n]) for n in objects)
    return out + b"trailer\n<<%s /Size %d>>\nstartxref\n%d\n%%%%EOF\n" % (trailer, len(objects) + 1, start)


BASE = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 100 200] /Rotate 90>>", 3: b"<</Type /Page /Parent 2 0 R /Contents 4 0 R>>", 4: b"<</Length 5>>\nstream\nhello\nendstream"}


def text_of(data: bytes) -> list[bytes]:
    doc = parse(data)
    assert doc.status == "ok", doc.problems
    return [pdf.contents(p, doc) for _, p in doc.pages]


def test_tokens():
    found = [(t.text, t.kind) for t in tokens("<</A#20b(x(y)\\)z)<41 42>%no\n[1 -2.5 R]/>>true{")]
    assert found == [("<<", "mark"), ("/A#20b", "name"), ("(x(y)\\)z)", "string"), ("<41 42>", "hex"), ("[", "other"), ("1", "word"), ("-2.5", "word"), ("R", "word"), ("]", "other"), ("/", "name"), (">>", "mark"), ("true", "word"), ("{", "other")]
    assert [t.kind for t in tokens("a%c\nb", comments=True)] == ["word", "comment", "word"]


def test_unbalanced_string():
    lexer = Lexer("((a) b")
    assert lexer.next().text == "((a)" and lexer.problems[0].level == "error"
    with pytest.raises(PdfSyntaxError):
        Lexer("(abc").next()


def test_minimal_document():
    doc = parse(build(BASE))
    assert (doc.status, doc.version, len(doc.pages), doc.problems) == ("ok", "1.4", 1, [])
    ref, page = doc.pages[0]
    assert ref == (3, 0) and page["/Rotate"].text == "90" and pdf.box(page["/MediaBox"], doc) == [0, 0, 100, 200]
    assert text_of(build(BASE)) == [b"hello"]


def test_nested_tree_and_cycle():
    tree = BASE | {2: b"<</Type /Pages /Kids [5 0 R 3 0 R 2 0 R 9 0 R] /MediaBox [0 0 1 1]>>", 5: b"<</Type /Pages /Kids [6 0 R 3 0 R] /Rotate 180>>", 6: b"<</Type /Page>>"}
    doc = parse(build(tree))
    assert [r for r, _ in doc.pages] == [(6, 0), (3, 0), (3, 0)]
    assert [p.get("/Rotate") for _, p in doc.pages] == [o.number(180), o.number(180), None]
    assert len(doc.problems) >= 2


def test_revisions():
    first = build(BASE)
    at = len(first)
    prev = int(first.rsplit(b"startxref\n", 1)[1].split()[0])
    changed = b"4 0 obj\n<</Length 3>>\nstream\nnew\nendstream\nendobj\n"
    second = first + changed + b"xref\n4 1\n%010d 00000 n\r\n3 1\n0000000000 00000 f\r\ntrailer\n<</Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (at, prev, at + len(changed))
    doc = parse(second)
    assert len(doc.sections) == 2 and text_of(second) == [b"new"]


def xref_stream_document(predictor: bool) -> bytes:
    inner = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Count 1>>", b"<</Type /Page /Contents 5 0 R>>"]
    heads, body = b"", b""
    for n, x in enumerate(inner, 1):
        heads += b"%d %d " % (n, len(body))
        body += x + b" "
    packed = zlib.compress(heads + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<</Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(heads), len(packed), packed)
    at5 = len(out)
    out += b"5 0 obj\n<</Length 2>>\nstream\nhi\nendstream\nendobj\n"
    at6 = len(out)
    rows = [(0, 0, 255), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    table = b"".join(struct.pack(">BHB", *r) for r in rows)
    extra = b""
    if predictor:
        up, lines = bytes(4), b""
        for i in range(0, len(table), 4):
            row = table[i : i + 4]
            lines += b"\2" + bytes((x - y) & 255 for x, y in zip(row, up, strict=True))
            up = row
        table, extra = lines, b" /DecodeParms <</Predictor 12 /Columns 4>>"
    packed = zlib.compress(table)
    return out + b"6 0 obj\n<</Type /XRef /Size 7 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode%s /Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (extra, len(packed), packed, at6)


@pytest.mark.parametrize("predictor", [False, True])
def test_xref_and_object_streams(predictor):
    doc = parse(xref_stream_document(predictor))
    assert doc.status == "ok" and doc.sections[0].is_stream and len(doc.pages) == 1, doc.problems
    assert text_of(xref_stream_document(predictor)) == [b"hi"]


@pytest.mark.parametrize(
    ("body", "expected", "noted"),
    [
        (b"<</Length 99>>\nstream\nhello\nendstream", b"hello\n", True),
        (b"<</Length 2>>\nstream\nhello\nendstream", b"hello\n", True),
        (b"<</Length 5>>\nstream\r\nhello\nendstream", b"hello", False),
        (b"<</Length 5 0 R>>\nstream\nhello\nendstream", b"hello", False),
        (b"<<>>\nstream\nhello\nendstream", b"hello\n", True),
    ],
)
def test_stream_lengths(body, expected, noted):
    data = build(BASE | {4: body, 5: b"5"})
    doc = parse(data)
    assert text_of(data) == [expected] and bool(doc.problems) == noted


def test_wrong_offsets_and_missing_objects():
    assert text_of(build(BASE, shift={4: 3})) == [b"hello"]
    doc = parse(build({k: v for k, v in BASE.items() if k != 4}))
    assert doc.status == "ok" and doc.resolve(doc.pages[0][1]["/Contents"]) is None
    glued = build(BASE | {5: b"12endobj"}).replace(b"12endobj\nendobj\n", b"12endobj" + b" " * 8)
    assert parse(glued).objects[5, 0] == o.number(12)
    assert parse(build(BASE | {5: b""})).objects[5, 0] == o.NULL


def test_frames():
    assert parse(build(BASE) + b"junk").status == "ok" and any("end mark" in p.message for p in parse(build(BASE) + b"junk").problems)
    for bad in (b"", None, b"no header", b"%PDF-1.4\n", build(BASE).replace(b"startxref", b"startxxxx"), build(BASE)[:-8]):
        doc = parse(bad)
        assert doc.status == "failed" and doc.problems[-1].level == "fatal" and not doc.pages


def test_table_by_lines():
    data = build(BASE)
    broken = data.replace(b"0 1\n0000000000 65535 f\r\n", b"0 2\n0000000000 65535 f\r\n", 1)
    doc = parse(broken)
    assert doc.status == "ok" and any("Badly formatted" in p.message for p in doc.problems) and len(doc.pages) == 1


def test_odd_dictionaries():
    doc = parse(build(BASE | {5: b"<</A 1 2 /B 3 4 X /C (x) junk /D [1 2 R 0 3 0 R null] /E null>>"}))
    held = doc.objects[5, 0]
    assert held["/C"].text == "(x)" and "/E" not in held and "/B" not in held
    assert held["/D"][0] == o.Ref(1, 2) and o.Ref(3, 0) in held["/D"]


def test_writer_round_trip_and_sharing():
    doc = parse(build(BASE | {5: b"<</Title (x) /Long [" + b"123456789 " * 20 + b"]>>"}, trailer=b"/Root 1 0 R /Info 5 0 R"))
    out = serialize(doc.trailer, doc.objects)
    again = parse(out)
    assert again.problems == [] and serialize(again.trailer, again.objects) == out
    assert text_of(out) == [b"hello"] and max(map(len, out.split(b"\n"))) < 120
    one = doc.pages[0][1]
    both = from_pages([one, one], doc.objects, info={"/Title": "Ünï", "/Pi": 3.25}, compress=True)
    back = parse(both)
    assert text_of(both) == [b"hello", b"hello"] and back.resolve(back.trailer["/Info"])["/Pi"].text == "3.25"
    assert sum(isinstance(v, o.Stream) for v in back.objects.values()) == 1


def test_canonical_form():
    direct = parse(build(BASE))
    apart = parse(build(BASE | {2: BASE[2].replace(b"[0 0 100 200]", b"5 0 R").replace(b"90", b"6 0 R"), 5: b"[0 0 100 200]", 6: b"90"}))
    one, other = (serialize(d.trailer, d.objects, canonical=True) for d in (direct, apart))
    assert one == other and text_of(one) == [b"hello"] and serialize(direct.trailer, direct.objects) != one


def test_wrapping_and_filters():
    assert wrapped(["a", "b"], "[", "]") == "[a b]"
    assert all(len(x.strip()) <= 71 for x in wrapped(["x" * 30] * 9, "[", "]").split("\n"))
    bad = o.Stream({"/Filter": o.name("LZWDecode")}, b"x")
    assert decoded(bad, parse(build(BASE))) == (b"x", False)
    assert decoded(o.Stream({"/Filter": [o.name("FlateDecode")]}, b"junk"), parse(build(BASE))) == (b"junk", False)


def test_tables(spark):
    from pyspark.sql import functions as F

    rows = [("a", build(BASE)), ("b", xref_stream_document(True)), ("bad", b"nothing"), ("none", None)]
    files = spark.createDataFrame(rows, "doc_id string, content binary")
    docs = {r.doc_id: r for r in pdf.documents(files).collect()}
    assert [docs[k].status for k in ("a", "b", "bad", "none")] == ["ok", "ok", "failed", "failed"] and docs["b"].is_xref_stream
    assert pdf.documents(files, "DROPMALFORMED").count() == 2
    with pytest.raises(Exception, match="bad: |none: "):
        pdf.documents(files, "FAILFAST").collect()
    assert {(r.doc_id, r.page_no, bytes(r.content)) for r in pdf.pages(files).collect()} == {("a", 1, b"hello"), ("b", 1, b"hi")}
    assert pdf.xref(files).where("kind = 'compressed'").count() == 3
    links = pdf.edges(pdf.nodes(files)).where("doc_id = 'a'")
    assert {(r.src_objnum, r.key_path, r.dst_objnum) for r in links.collect()} == {(0, "/Root", 1), (1, "/Pages", 2), (2, None, 3), (3, "/Parent", 2), (3, "/Contents", 4)}
    streams = pdf.objects(files, decompress=True).where(F.col("stream").isNotNull())
    assert streams.where("objnum = 4 AND doc_id = 'b'").first().length > 80
    made = pdf.assemble(spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (2, 1, None)], "k int, n int, t string"), "k", "n", "t", compress=True)
    assert {(r.doc_id, r.page_no, bytes(r.content)) for r in pdf.pages(made).collect()} == {("1", 1, b"one"), ("1", 2, b"two"), ("2", 1, b"")}


def damaged(data: bytes, rnd: random.Random) -> bytes:
    """A few random changes: bytes replaced, cut out, doubled, numbers made large or negative, superscript digits."""
    out = bytearray(data)
    for _ in range(rnd.randint(1, 4)):
        a = rnd.randrange(len(out))
        b = min(len(out), a + rnd.choice((1, 2, 9, 40)))
        kind = rnd.randrange(6)
        if kind == 0:
            out[a] = rnd.randrange(256)
        elif kind == 1:
            del out[a:b]
        elif kind == 2:
            out[a:a] = out[a:b]
        elif kind == 3:
            out[a:b] = rnd.choice((b"99999999999999999999", b"-1", b"\xb2\xb3", b"4294967296", b"[", b"<<", b"(", b" 0 R", b"endobj", b"1e9", b"null"))
        elif kind == 4:
            out[a:b] = bytes(rnd.randrange(256) for _ in range(b - a))
        else:
            digits = [i for i, c in enumerate(out) if 48 <= c < 58]
            if digits:
                out[rnd.choice(digits)] = rnd.choice(b"0123456789")
    return bytes(out)


def with_object_stream() -> bytes:
    inner = b"<</Type /Catalog /Pages 2 0 R>> <</Type /Pages /Kids [3 0 R] /Count 1>> <</Type /Page /Parent 2 0 R>>"
    places = [0, inner.index(b"<</Type /Pages "), inner.index(b"<</Type /Page ")]
    head = b" ".join(b"%d %d" % (n, p) for n, p in zip((1, 2, 3), places, strict=True)) + b" "
    body = zlib.compress(head + inner)
    out = b"%PDF-1.5\n"
    at = len(out)
    out += b"5 0 obj\n<</Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(body), body)
    start = len(out)
    rows = b"".join(struct.pack(">BHB", *r) for r in ((0, 0, 255), (2, 5, 0), (2, 5, 1), (2, 5, 2), (1, start, 0), (1, at, 0)))
    return out + b"4 0 obj\n<</Type /XRef /W [1 2 1] /Size 6 /Root 1 0 R /Length %d>>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (len(rows), rows, start)


@pytest.mark.parametrize("kind", ["table", "stream", "written"])
def test_damage_never_ends_a_job(kind):
    whole = {"table": build(BASE), "stream": with_object_stream(), "written": from_pages([{"/Contents": o.Stream({}, b"q Q"), "/Note": o.Atom("string", "(a(b)c)")}] * 3, compress=True)}[kind]
    assert parse(whole).status == "ok" and len(parse(whole).pages) == (3 if kind == "written" else 1)
    rnd = random.Random(kind)
    for _ in range(3500):
        data = damaged(whole, rnd)
        for password in (None, b""):
            doc = parse(data, password)
            assert doc.status in ("ok", "failed", "encrypted", "decrypted")
            assert doc.status != "failed" or doc.problems


def test_damaged_counts_cost_nothing():
    many = with_object_stream().replace(b"/Size 6", b"/Size 999999999999")
    assert parse(many).status == "ok" and len(parse(many).objects) == 5
    table = build(BASE).replace(b"xref\n0 1\n", b"xref\n0 99999999999999\n", 1)
    assert parse(table).status in ("ok", "failed")


def test_wrapping_by_definition():
    rnd = random.Random(3)
    for _ in range(300):
        parts = ["x" * rnd.randint(1, 90) for _ in range(rnd.randint(0, 30))]
        out = wrapped(parts, "<<", ">>")
        assert out.replace("\n  ", " ") == "<<" + " ".join(parts) + ">>"
        lines = out[2:-2].split("\n  ")
        if sum(map(len, parts)) <= 70:
            assert len(lines) == 1
            continue
        for line, after in zip(lines, lines[1:], strict=False):  # no line could have taken the next part
            assert len(line) + 1 + len(after.split(" ")[0]) + 1 > 71
        assert all(len(line) + 1 <= 71 or " " not in line for line in lines)


def test_numbers_are_ascii():
    assert [v.kind for v in map(lambda x: parse(build(BASE | {5: x})).objects.get((5, 0)), (b"12", b"-1.5", b".5", b"\xb2", b"1e5"))] == ["number", "number", "number", "keyword", "keyword"]


class Mapped:
    """A frame that gives the function it is mapped by, so that its batches can be looked at."""

    groupBy = agg = select = lambda self, *columns: self

    def mapInArrow(self, run, ddl):
        return run


def test_batches_out_are_bounded_by_bytes(spark):
    """60 MB of rows, or of files, from one batch leave in batches of about 2 MB; what comes out is all of it."""
    source = pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(60)], "content": [b"x"] * 60})
    made = list(pdf.rows_of(Mapped(), "doc_id string, n int, content binary", lambda key, data: ((key, n, data * (1 << 18)) for n in range(4)))(iter([source])))
    assert [(r["doc_id"], r["n"]) for b in made for r in b.to_pylist()] == [(str(k), n) for k in range(60) for n in range(4)]
    assert max(b.nbytes for b in made) < 3 << 20
    turns = pa.RecordBatch.from_pydict({"doc_id": [str(k) for k in range(60)], "rows": [[{"at": 0, "text": "y" * (1 << 20)}]] * 60})
    files = list(pdf.assemble(Mapped(), "k", "at", "text")(iter([turns])))
    assert [r["doc_id"] for b in files for r in b.to_pylist()] == [str(k) for k in range(60)] and max(b.nbytes for b in files) < 4 << 20


def test_files_are_finished_where_they_are_made(spark):
    df = spark.createDataFrame([("a", 0, "one"), ("b", 0, None)], "k string, n int, t string")
    plain, turned = ({r.doc_id: bytes(r.content) for r in pdf.assemble(df, "k", "n", "t", finish=f).collect()} for f in (None, lambda b: b[::-1]))
    assert turned == {k: b[::-1] for k, b in plain.items()} and set(plain) == {"a", "b"}
