import pytest
from pyspark.sql import functions as F

from quire.functions import crypt
from quire.operators import content, pages
from quire.sources import compose, pdf, secure
from quire.sources import objects as o
from quire.sources.parser import parse
from quire.sources.writer import from_pages
from tests.test_parser import BASE, build


def document(texts, turn=0, size=(100, 200)):
    box = [o.number(v) for v in (0, 0, *size)]
    return from_pages([{"/MediaBox": box, "/Rotate": o.number(turn), "/Resources": {"/Font": {}}, "/Contents": o.Stream({}, t.encode())} for t in texts])


def files(spark, **given):
    return spark.createDataFrame(list(given.items()), "doc_id string, content binary")


def page_texts(row):
    doc = parse(bytes(row.content))
    assert doc.status == "ok" and not doc.problems, doc.problems
    return [pdf.contents(p, doc).decode() for _, p in doc.pages]


def test_copied_pages(spark):
    src = files(spark, a=document(["(a1) Tj", "(a2) Tj"]), b=document(["(b1) Tj"], turn=90))
    plan = spark.createDataFrame([("x", 1, "b", 1, 1), ("x", 2, "a", 2, 0), ("x", 3, "a", 2, 0), ("x", 4, "a", 9, 0), ("y", 1, "a", 1, 0)], "out_doc string, out_page int, doc_id string, page_no int, turn int").withColumn("whole", F.lit(True))
    out = {r.doc_id: r for r in compose.compose(src, plan, compress=True).collect()}
    assert page_texts(out["x"]) == ["(b1) Tj", "(a2) Tj", "(a2) Tj"] and page_texts(out["y"]) == ["(a1) Tj"]
    doc = parse(bytes(out["x"].content))
    assert [p["/Rotate"].text for _, p in doc.pages] == ["180", "0", "0"]


def test_four_up(spark):
    src = files(spark, a=document([f"({k}) Tj" for k in range(6)]))
    plan = pages.grid(pdf.pages(src)).select(F.lit("up").alias("out_doc"), F.col("sheet").alias("out_page"), "doc_id", "page_no", "scale", (F.col("x") * 50).alias("x"), (F.col("y") * 100).alias("y"))
    row = compose.compose(src, plan).first()
    doc = parse(bytes(row.content))
    assert len(doc.pages) == 2 and pdf.box(doc.pages[0][1]["/MediaBox"], doc) == [0, 0, 100, 200]
    forms = o.entries(doc.resolve(o.entries(doc.resolve(doc.pages[0][1]["/Resources"]))["/XObject"]))
    assert len(forms) == 4 and sorted(doc.resolve(f).data for f in forms.values()) == [b"(0) Tj", b"(1) Tj", b"(2) Tj", b"(3) Tj"]
    ops = content.operators(spark.createDataFrame([("p", pdf.contents(doc.pages[0][1], doc))], "doc_id string, content binary"))
    assert ops.where("op = 'Do'").count() == 4 and ops.where("op = 'cm'").select("operands").collect()[1][0] == ["0.5", "0", "0", "0.5", "50", "100"]


def test_stamps_views_and_turns(spark):
    src = files(spark, a=document(["(page) Tj"]), m=document(["(mark) Tj"], turn=90))
    rows = [("o", 1, "a", 1, None, None, True), ("o", 1, "m", 1, 1, [0.0, 0.0, 0.5, 1.0], False), ("o", 1, "m", 1, -1, None, False)]
    plan = spark.createDataFrame(rows, "out_doc string, out_page int, doc_id string, page_no int, z int, view array<double>, whole boolean")
    row = compose.compose(src, plan).first()
    (text,) = page_texts(row)
    assert text.startswith("q 1 0 0 1 ") and "\nq\n(page) Tj\nQ\nq 1 0 0 1 " in text
    doc = parse(bytes(row.content))
    forms = [doc.resolve(f) for f in o.entries(doc.resolve(o.entries(doc.resolve(doc.pages[0][1]["/Resources"]))["/XObject"])).values()]
    assert sorted([pdf.box(f.entries["/BBox"], doc) for f in forms]) == [[0, 0, 100, 100], [0, 0, 100, 200]]
    assert all(pdf.box(f.entries["/Matrix"][:4], doc) == [0, -1, 1, 0] for f in forms)


def test_fragments(spark):
    image = o.Stream({"/Type": o.name("XObject"), "/Subtype": o.name("Image"), "/Width": o.number(50), "/Height": o.number(100)}, b"\0" * 9)
    form = o.Stream({"/Type": o.name("XObject"), "/Subtype": o.name("Form"), "/BBox": [o.number(v) for v in (0, 0, 7, 8)]}, b"BT (shown) Tj ET")
    small = o.Stream({"/Subtype": o.name("Form"), "/BBox": [o.number(v) for v in (0, 0, 7, 8)]}, b"q 1 0 0 1 0 0 cm /X Do Q")
    page = {"/Resources": {"/XObject": {"/I": image, "/F": form, "/S": small}}}
    src = files(spark, a=from_pages([page, page]), none=document(["x"]))
    (row,) = compose.fragments(src).collect()
    doc = parse(bytes(row.content))
    assert row.doc_id == "a" and sorted(pdf.box(p["/MediaBox"], doc) for _, p in doc.pages) == [[0, 0, 7, 8], [0, 0, 612, 1152]]


def test_rewrite_and_save(spark, tmp_path):
    src = files(spark, a=build(BASE), bad=b"x")
    out = compose.rewrite(src, compress=True, info={"/Title": "new"})
    rows = {r.doc_id: r.content for r in out.collect()}
    doc = parse(bytes(rows["a"]))
    assert rows["bad"] is None and doc.version == "1.4" and doc.resolve(doc.trailer["/Info"])["/Title"].text == "(new)"
    plain = compose.rewrite(out, decompress=True).where("doc_id = 'a'").first()
    assert page_texts(plain) == ["hello"] and b"FlateDecode" not in bytes(plain.content)
    saved = compose.save(out.where("content IS NOT NULL"), f"file://{tmp_path}/out").collect()
    assert [r.n_bytes for r in saved] == [len(rows["a"])]
    read = pdf.documents(pdf.files(spark, f"file://{tmp_path}/out")).first()
    assert (read.status, read.num_pages) == ("ok", 1)


def sealed(version, revision, method, password=b"pw"):
    owner, first = b"o" * 32, b"0123456789abcdef"
    bits = {1: 40, 2: 128, 4: 128}[version]
    key = crypt.document_key(password, owner, -44, first, revision, bits)
    user = crypt.user_hash(key, first, revision).ljust(32, b"\0")
    one = crypt.object_key(key, 4, 0, method == "aes")
    body = crypt.rc4(one, b"hello") if method == "rc4" else b"hello"
    if method == "aes":
        from pyspark.sql import SparkSession

        s = SparkSession.active()
        body = bytes(s.createDataFrame([(b"hello", one)], "d binary, k binary").select(F.aes_encrypt("d", "k", F.lit("CBC"), F.lit("PKCS"))).first()[0])
    extra = b"/CF <</StdCF <</CFM /AESV2>>>> /StmF /StdCF" if version == 4 else b""
    objects = BASE | {4: b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body), 9: b"<</Filter /Standard /V %d /R %d /Length %d /P -44 /O <%s> /U <%s> %s>>" % (version, revision, bits, owner.hex().encode(), user.hex().encode(), extra)}
    return build(objects, trailer=b"/Root 1 0 R /Encrypt 9 0 R /ID [<%s> <%s>]" % (first.hex().encode(), first.hex().encode()))


def test_encrypted_documents(spark):
    src = files(spark, v1=sealed(1, 2, "rc4"), v2=sealed(2, 3, "rc4"), v4=sealed(4, 4, "aes"), open=build(BASE))
    found = secure.keys(src, b"pw")
    assert {(r.doc_id, r.method, r.password_fits) for r in found.collect()} == {("v1", "rc4", True), ("v2", "rc4", True), ("v4", "aes", True)}
    assert not any(r.password_fits for r in secure.keys(src, b"other").collect())
    clear = secure.unsealed(pdf.objects(src), found).where("objnum = 4").collect()
    assert {(r.doc_id, bytes(r.stream)) for r in clear} == {(k, b"hello") for k in ("v1", "v2", "v4", "open")}
    assert {r.doc_id: r.status for r in pdf.documents(src).collect()}["v1"] == "encrypted"


def test_password_opens_all_tables(spark):
    src = files(spark, v1=sealed(1, 2, "rc4"), v2=sealed(2, 3, "rc4"), v4=sealed(4, 4, "aes"), open=build(BASE))
    read = {r.doc_id: bytes(r.content) for r in pdf.pages(src, password=b"pw").collect()}
    assert read == dict.fromkeys(("v1", "v2", "v4", "open"), b"hello")
    status = {r.doc_id: (r.status, len(r.problems)) for r in pdf.documents(src, password=b"pw").collect()}
    assert status == dict.fromkeys(("v1", "v2", "v4"), ("decrypted", 0)) | {"open": ("ok", 0)}
    wrong = pdf.documents(src.where("doc_id = 'v2'"), password=b"no").first()
    assert wrong.status == "decrypted" and "password" in wrong.problems[0]
    clear = compose.rewrite(src, password=b"pw")
    assert {page_texts(r)[0] for r in clear.collect()} == {"hello"} and pdf.documents(clear).where("status != 'ok'").count() == 0
    plan = spark.createDataFrame([("x", 1, "v4", 1, True), ("x", 2, "v1", 1, True)], "out_doc string, out_page int, doc_id string, page_no int, whole boolean")
    assert page_texts(compose.compose(src, plan, password=b"pw").first()) == ["hello", "hello"]


def test_aes_is_sparks(spark):
    datas = [b"", b"x", b"y" * 15, b"z" * 16, bytes(range(256)) * 5]
    key = bytes(range(16))
    rows = spark.createDataFrame([(x,) for x in datas], "d binary").select("d", F.aes_encrypt("d", F.lit(key), F.lit("CBC"), F.lit("PKCS")).alias("e")).collect()
    assert all(crypt.aes(key, bytes(r.e)) == bytes(r.d) for r in rows)
    for bad in (b"", b"a" * 16, b"a" * 33, bytes(32)):
        with pytest.raises(ValueError):
            crypt.aes(key, bad)


def test_own_crypt_filters():
    first, owner = b"0123456789abcdef", b"o" * 32
    key = crypt.document_key(b"", owner, -4, first, 4, 128)
    user = crypt.user_hash(key, first, 4).ljust(32, b"\0")
    body = crypt.rc4(crypt.object_key(key, 4, 0, False), b"hello")

    def made(entries: bytes, data: bytes) -> bytes:
        held = b"<</Filter /Standard /V 4 /R 4 /Length 128 /P -4 /O <%s> /U <%s> /StmF /Identity /CF <</Own <</CFM /V2>>>>>>" % (owner.hex().encode(), user.hex().encode())
        return build(BASE | {4: b"<<%s /Length %d>>\nstream\n%s\nendstream" % (entries, len(data), data), 9: held}, trailer=b"/Root 1 0 R /Encrypt 9 0 R /ID [<%s> <%s>]" % (first.hex().encode(), first.hex().encode()))

    text = lambda data: pdf.contents(parse(data, b"").pages[0][1], parse(data, b""))
    assert text(made(b"", b"hello")) == b"hello"  # the default is the identity
    assert text(made(b"/Filter /Crypt /DecodeParms <</Name /Own>>", body)) == b"hello"
    assert text(made(b"/Filter [/Crypt] /DecodeParms [<</Name /Own>>]", body)) == b"hello"
    assert text(made(b"/Filter [/Crypt]", b"hello")) == b"hello"
    unknown = parse(made(b"/Filter [/Crypt] /DecodeParms [<</Name /Other>>]", body), b"")
    assert unknown.status == "decrypted" and any("Other" in p.message for p in unknown.problems)


def test_search_and_hooks(spark):
    image = o.Stream({"/Type": o.name("XObject"), "/Subtype": o.name("Image"), "/Width": o.number(50), "/Height": o.number(100)}, b"\0" * 9)
    form = o.Stream({"/Type": o.name("XObject"), "/Subtype": o.name("Form"), "/BBox": [o.number(v) for v in (0, 0, 7, 8)]}, b"BT (shown) Tj ET")
    page = {"/Resources": {"/XObject": {"/I": image, "/F": form}}, "/Hidden": {"/Deep": {"/Type": o.name("Thing")}}}
    src = files(spark, a=from_pages([page, page]), bad=b"x")
    found = pdf.found(src).orderBy("ord").collect()
    assert [(r.type, r.subtype, r.length) for r in found] == [("/XObject", "/Form", 16), ("/XObject", "/Image", 9)] and all(r.objnum for r in found)
    assert [(r.type, r.objnum) for r in pdf.found(src, ("/Thing",), (None,)).collect()] == [("/Thing", None)] * 2
    assert pdf.found(src, ("/Thing",), (None,), ("/Parent", "/Hidden")).count() == 0
    count = lambda **more: [r.num_pages for r in pdf.documents(compose.fragments(src, **more)).collect()]
    assert count() == [2] and count(image_only=True) == [1] and count(ignore=lambda s: True) == [] and count(no_follow=("/Parent", "/Resources")) == []
    wrapped = compose.fragments(src, wrap=lambda s, doc: {"/Contents": o.Stream({}, b"own %d" % len(s.data))})
    assert sorted(page_texts(wrapped.first())) == ["own 16", "own 9"]


def test_addresses(spark):
    src = files(spark, **{"a.pdf": document(["(one) Tj", "(two) Tj"]), "b.pdf": document(["(b) Tj"])})
    uris = spark.createDataFrame([(1, "a.pdf#page=2"), (2, "a.pdf"), (3, "a.pdf#page=9"), (4, "c.pdf"), (5, None), (6, "b.pdf#page=1&viewrect=0,0,.5,1"), (6, "b.pdf#page=1&viewrect=0,0,.5,1"), (7, "page=1")], "n int, uri string")
    rows = sorted((r.n, bytes(r.content) if r.content else None, r.viewrect) for r in pdf.addressed(uris, src).collect())
    assert rows == [(1, b"(two) Tj", None), (2, b"(one) Tj", None), (3, None, None), (4, None, None), (5, None, None), (6, b"(b) Tj", [0, 0, 0.5, 1]), (6, b"(b) Tj", [0, 0, 0.5, 1]), (7, None, None)]
    assert pdf.addressed(uris.limit(0), src).count() == 0 and pdf.addressed(uris, src.limit(0)).where("content IS NOT NULL").count() == 0


def test_writer_options(spark):
    src = files(spark, a=document(["(long) Tj " * 40, "x"]))
    some = pdf.objects(compose.rewrite(src, compress=lambda s: len(s.data) > 50)).where("kind = 'stream'").collect()
    assert sorted((len(r.filter), r.length > 300) for r in some) == [(0, False), (1, False)]
    shouted = compose.rewrite(src, user_format=lambda v: o.Atom("string", "(!)") if isinstance(v, o.Atom) and v.kind == "string" else v, info={"/Title": o.Atom("string", "(t)")})
    assert '"(!)"' in pdf.documents(shouted).first().info
    assert pdf.documents(compose.rewrite(src, canonical=True)).first().num_objects > pdf.documents(src).first().num_objects


def test_folders(spark, tmp_path):
    from quire.sources.shared import file_system

    with pytest.raises(ValueError):
        compose.save(files(spark, a=b"x"), "nowhere://bucket/x")
    assert file_system(f"file://{tmp_path}")[1] == str(tmp_path)


def test_one_reading_for_all_tables(spark):
    src = files(spark, a=document(["(one) Tj", "(two) Tj"]), v2=sealed(2, 3, "rc4"), bad=b"x")
    made = pdf.parsed(src, password=b"pw")
    for name in pdf.TABLES:
        one, all_ = getattr(pdf, name)(src, password=b"pw"), pdf.table(made, name)
        assert one.columns == all_.columns and sorted(map(str, one.collect())) == sorted(map(str, all_.collect())), name
    assert pdf.parsed(src, ("pages",)).columns == ["doc_id", "pages"] and pdf.parsed(src.limit(0)).count() == 0
    assert pdf.parsed(src, mode="DROPMALFORMED").count() == 2
