import os

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.operators import content, golden, graph, layout, pages


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def numbered(spark, n, doc="d"):
    return spark.range(1, n + 1).select(F.lit(doc).alias("doc_id"), F.col("id").cast("int").alias("page_no"))


def test_subset_keeps_order_and_repeats(spark):
    out = pages.subset(numbered(spark, 9), [(5, 6), (1, 2), (5, 5), (20, 30)])
    assert [r.page_no for r in out.orderBy("out_page").collect()] == [5, 6, 1, 2, 5]


def test_rotation(spark):
    out = pages.rotate(numbered(spark, 3).withColumn("rotate", F.lit(None).cast("int")), 270, [(1, 2), (2, 3)])
    assert rows(out, "page_no", "rotate") == [(1, 270), (2, 180), (3, 270)]
    assert rows(pages.rotate(out, -270), "page_no", "rotate") == [(1, 0), (2, 270), (3, 0)]


def test_booklets(spark):
    out = pages.booklet(numbered(spark, 8))
    assert rows(out, "sheet", "left_page", "right_page") == [(1, 8, 1), (2, 2, 7), (3, 6, 3), (4, 4, 5)]
    one = [tuple(r) for r in pages.booklet(numbered(spark, 1)).orderBy("sheet").select("left_page", "right_page").collect()]
    assert one == [(None, 1), (None, None)]
    cut = pages.signatures(numbered(spark, 6), 4, multiple=2)
    assert rows(cut, "signature", "sheet", "left_page", "right_page") == [(1, 1, 4, 1), (1, 2, 2, 3), (2, 1, 6, 5)]


def test_grid_and_halves(spark):
    assert rows(pages.grid(numbered(spark, 5)), "page_no", "sheet", "x", "y") == [(1, 1, 0.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 0.0, 0.0), (4, 1, 1.0, 0.0), (5, 2, 0.0, 1.0)]
    assert rows(pages.halves(numbered(spark, 2)), "out_page", "view_x") == [(1, 0.0), (2, 0.5), (3, 0.0), (4, 0.5)]
    assert rows(pages.twice(numbered(spark, 2)), "page_no", "copy", "turn") == [(1, 0, 0), (1, 1, 180), (2, 0, 180), (2, 1, 0)]


def test_concatenation(spark, monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 3)
    parts = [numbered(spark, 8, "a"), numbered(spark, 0), numbered(spark, 4, "b")]
    out = pages.concatenate(parts)
    assert [(r.out_page, r.doc_id, r.page_no) for r in out.orderBy("out_page").collect()] == [(k + 1, "a" if k < 8 else "b", k + 1 if k < 8 else k - 7) for k in range(12)]
    assert set(out.columns) == {"doc_id", "page_no", "part", "out_page"}
    assert rows(pages.concatenate(parts, by="doc_id"), "doc_id", "out_page") == [("a", k) for k in range(1, 9)] + [("b", k) for k in range(1, 5)]


def test_empty_tables(spark):
    none = numbered(spark, 0)
    assert pages.subset(none, [(1, 2)]).count() == pages.booklet(none).count() == pages.grid(none).count() == 0


def test_reachable_with_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "n string"))) == [("a",), ("b",), ("c",)]


def test_tree_with_loop(spark):
    nodes = spark.createDataFrame([("a", None, 0, 5), ("c", "a", 1, None), ("b", "a", 0, 7), ("d", "b", 0, None), ("e", "e", 0, 1)], "node string, parent string, ord int, box int")
    tree = graph.ordered_tree(nodes, "parent IS NULL")
    assert [r.node for r in tree.orderBy("path").collect()] == ["a", "b", "d", "c"]
    assert rows(graph.inherited(tree, nodes, "box")) == [("a", 5), ("b", 7), ("c", 5), ("d", 7)]


def test_layout(spark):
    e = spark.createDataFrame([(1, 0, "x"), (1, 2, "z"), (1, 1, "y"), (2, 0, None)], "k int, r int, v string")
    assert rows(layout.latest(e, ["k"], "r", ["v"])) == [(1, "z"), (2, None)]
    assert rows(layout.joined_parts(e, ["k"], "r", "v"), "k", "content", "parts") == [(1, "x\ny\nz", 3), (2, "", 1)]
    t = spark.createDataFrame([("q 1 0 0 1 5 5 cm /Fm0 Do Q",), ("BT (x) Tj ET",), ("1 " * 200,)], "s string")
    assert [r[0] for r in t.select(layout.trivial(F.col("s"))).collect()] == [True, False, False]


def test_geometry(spark):
    one = spark.range(1)
    box = g.Box(*map(F.lit, (0.0, 0.0, 100.0, 200.0)))
    turned = one.select(*g.turn_box(box, F.lit(1))).first()
    assert tuple(turned) == (0.0, -100.0, 200.0, 0.0)
    shares = tuple(map(F.lit, (0.0, 0.0, 0.5, 1.0)))
    assert tuple(one.select(*g.view_box(box, None, shares, F.lit(0))).first()) == (0.0, 0.0, 50.0, 200.0)
    assert tuple(one.select(*g.view_box(box, None, shares, F.lit(1))).first()) == (0.0, 0.0, 100.0, 100.0)
    p = g.with_height(g.move_to(g.place(*map(F.lit, (0.0, 0.0, 10.0, 20.0))), F.lit(5.0), F.lit(6.0)), F.lit(40.0))
    assert tuple(one.select(p.x, p.y, p.w, p.h, *p.matrix).first()) == (5.0, 6.0, 20.0, 40.0, 2.0, 0.0, 0.0, 2.0, 5.0, 6.0)
    a = spark.createDataFrame([("f.pdf#page=3&viewrect=0,0,.5,1",), ("page=2",), ("plain.pdf",)], "u string").select(g.address(F.col("u")).alias("a")).select("a.*").collect()
    assert [(r.docname, r.page, r.viewrect) for r in a] == [("f.pdf", 3, [0.0, 0.0, 0.5, 1.0]), (None, 2, None), ("plain.pdf", None, None)]
    assert [r[0] for r in spark.createDataFrame([(90,), (45,), (-90,), (720,)], "d int").select(g.quarter_turns(F.col("d"))).collect()] == [1, 0, -1, 8]


def test_deep_trees_and_documents(spark):
    chain = [("a", f"n{k}", f"n{k - 1}" if k else None, 0) for k in range(130)] + [("b", "n0", None, 0), ("b", "n1", "n0", 1), ("b", "n2", "n0", 0), (None, "n0", None, 0)]
    nodes = spark.createDataFrame(chain, "doc string, node string, parent string, ord int")
    tree = graph.ordered_tree(nodes, F.col("parent").isNull(), by=["doc"])
    assert tree.where("doc = 'a'").agg(F.max("level")).first()[0] == 129
    assert [r.node for r in tree.where("doc = 'b'").orderBy("path").collect()] == ["n0", "n2", "n1"]
    assert [r.node for r in graph.ordered_tree(nodes, F.col("node") == "n128", by=["doc"]).orderBy("path").collect()] == ["n128", "n129"]  # a Column as root
    assert graph.ordered_tree(nodes.limit(0), "parent IS NULL").count() == 0


def test_ties(spark):
    rows_ = [(1, 5, "a", 2), (1, 5, "b", 1), (1, 4, "z", 9), (1, None, "y", 0), (None, 1, "n", 0)]
    e = spark.createDataFrame(rows_, "k int, r int, v string, w int")
    for df in (e, spark.createDataFrame(rows_[::-1], e.schema)):
        assert sorted(map(tuple, layout.latest(df, ["k"], "r", ["v", "w"]).collect()), key=str) == [(1, "b", 1), (None, "n", 0)]
        assert rows(layout.first_entries(df.where("k = 1 AND r > 0"), ["k"], "r", ["v"])) == [(1, "z")]
        named = layout.overlay_names(df.where("k = 1 AND r = 5").withColumn("had", F.lit(None).cast("int")), ["k"], "r", "had", "/F")
        assert rows(named, "v", "name") == [("a", "/F0"), ("b", "/F1")]


def test_rewrite_of_references(spark):
    refs = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1), ("d", None)], "doc string, target int")
    remap = spark.createDataFrame([("d", 1, 9), ("d", 2, None)], "doc string, old int, new int")
    out = graph.rewrite(refs, remap, "target", on=["doc"])
    assert out.columns == ["doc", "target"] and sorted(map(tuple, out.collect()), key=str) == [("d", 2), ("d", 9), ("d", None), ("e", 1)]


def test_golden(spark):
    got = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("f", None), ("g", "6")], "name string, digest string")
    known = spark.createDataFrame([("a", "0"), ("a", "1"), ("b", "!2"), ("c", "skip"), ("d", "xfail"), ("e", "9"), ("f", "1")], "name string, digest string")
    assert [r.status for r in golden.compared(got, known, ["name"]).orderBy("name").collect()] == ["ok", "known bad", "skipped", "expected failure", "changed", "changed", "missing"]
    pairs = spark.createDataFrame([(["a", "skip"], ["skip"]), (["a"], ["a"])], "x array<string>, y array<string>").select(golden.intersects(F.col("x"), F.col("y"), "skip").alias("hit"), golden.intersects(F.col("x"), F.col("y")).alias("any"))
    assert rows(pairs) == [(False, True), (True, True)]


def test_content_operators(spark):
    every = b" ".join(b" ".join([b"1"] * n + [op.encode()]) for op, n in content.COUNTS.items())
    df = spark.createDataFrame([("d", every), ("bad", b"(open"), ("none", None)], "doc_id string, content binary")
    found = content.operators(df).orderBy("ord").collect()
    assert [r.op for r in found] == list(content.COUNTS) and len(found) == 52 and all(r.fits for r in found)
    text = content.operators(spark.createDataFrame([("d", b"(a) Tj [(b) 3 (c)] TJ (d) ' 1 2 (e) \" [1 [2] TJ 5 sh 3 w")], "doc_id string, content binary")).orderBy("ord").collect()
    assert [(r.op, r.shown, r.fits) for r in text] == [("Tj", "a", True), ("TJ", "bc", True), ("'", "d", True), ('"', "e", True), ("TJ", "", True), ("w", None, False)]
    state = content.states(spark.createDataFrame([("d", b"1 w q 2 w 2 0 0 2 0 0 cm q 1 0 0 1 3 4 cm Q Q Q S")], "doc_id string, content binary")).orderBy("ord").collect()
    assert [(r.depth, r.line_width) for r in state][:4] == [(0, "1"), (1, "1"), (1, "2"), (1, "2")] and state[-1].line_width == "1"
    assert state[5].ctm == [2.0, 0.0, 0.0, 2.0, 6.0, 8.0] and state[-1].ctm == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    text = content.page_text(content.operators(spark.createDataFrame([("d", b"BT (a) Tj 0 -9 Td (b) Tj T* (c) Tj ET")], "doc_id string, content binary")))
    assert rows(text) == [("d", "a\nb\nc")]


def test_content_state_survives_damage(spark):
    odd = spark.createDataFrame([("a", b"x y m 1 cm Tm Td 3 c h \" q"), ("b", None), ("c", b""), ("d", b"Q Q 1 2 m n 5 5 l ET T*")], "doc_id string, content binary")
    found = {(r.doc_id, r.ord): r for r in content.states(odd).collect()}
    assert found["a", 0].point is None and found["a", 1].ctm == list(content.SAME) and not any(k[0] in "bc" for k in found)
    assert found["d", 2].point == [1.0, 2.0] and found["d", 4].path == 1 and found["d", 4].point == [5.0, 5.0]


def test_font_maps(spark):
    stream = b"2 beginbfchar\n<0003> <0020>\n<24> <00410042>\nendbfchar 1 beginbfrange <1> <2> <3> endbfrange 1 beginbfchar <25><D83DDE42> endbfchar"
    out = content.font_maps(spark.createDataFrame([("f", stream), ("none", None), ("empty", b"")], "doc_id string, content binary"))
    assert rows(out, "code", "text") == [(3, " "), (36, "AB"), (37, "🙂")]


def test_streams(spark, tmp_path):
    from quire.sources import pdf
    from quire.sources.writer import from_pages
    from quire.streaming import ingest

    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.pdf").write_bytes(from_pages([{}] * n))
    found = pdf.documents(ingest.file_stream(spark, f"file://{tmp_path}/in"))
    for seen in (2, 3):
        ingest.drain(found, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        assert spark.read.parquet(f"file://{tmp_path}/out").count() == seen
        (tmp_path / "in" / "3.pdf").write_bytes(from_pages([{}] * 3))
    batch = pdf.documents(pdf.files(spark, f"file://{tmp_path}/in"))
    assert rows(batch, "num_pages") == rows(spark.read.parquet(f"file://{tmp_path}/out"), "num_pages") == [(1,), (2,), (3,)]


def test_newest_rows_of_a_stream(spark, tmp_path):
    from quire.streaming import ingest

    schema = "k int, ts timestamp, v string"
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    row = lambda k, hour, v: f"({k}, TIMESTAMP '2024-01-01 {hour:02d}:00:00', '{v}')"
    seen = []
    for batch in ([row(1, 1, "a"), row(2, 2, "b"), row(2, 2, "c")], [row(1, 3, "d"), row(3, 1, "e")], []):
        if batch:
            spark.sql(f"SELECT * FROM VALUES {', '.join(batch)} AS t(k, ts, v)").write.mode("append").parquet(path)
        stream = ingest.newest(ingest.table_stream(spark, path, spark.createDataFrame([], schema).schema), ["k"], "ts", ["v"])
        ingest.drain_newest(stream, out, state)
        seen.append(rows(ingest.newest_rows(spark, out, ["k"], "ts", ["v"]), "k", "v"))
    assert seen == [[(1, "a"), (2, "c")], [(1, "d"), (2, "c"), (3, "e")], [(1, "d"), (2, "c"), (3, "e")]]
    ingest.merge(spark, out, f"{out}-merged", ["k"], "ts", ["v"])
    assert rows(spark.read.parquet(f"{out}-merged"), "k", "v") == seen[-1]


def test_once(spark, tmp_path):
    from quire.streaming import ingest

    path = f"file://{tmp_path}/in"
    spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 01:00:00'), (1, TIMESTAMP '2024-01-01 01:00:00'), (2, TIMESTAMP '2024-01-01 02:00:00') AS t(k, ts)").write.parquet(path)
    stream = ingest.once(ingest.table_stream(spark, path, spark.read.parquet(path).schema), ["k"], "ts")
    ingest.drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert rows(spark.read.parquet(f"file://{tmp_path}/out"), "k") == [(1,), (2,)]


def test_whole_tables_are_read(spark):
    from quire.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't here")
    nodes = {r.node for r in registry.QUERIES["reachable_objects"](spark, folder).collect()}
    assert {f"c{r.c_custkey}" for r in registry.table(spark, folder, "customer").collect()} <= nodes
    given = {(r.doc_id, r.text) for r in registry.table(spark, folder, "documents").collect() if len(r.text or "") >= 300}
    assert given <= {(r.doc_id, r.s) for r in registry.QUERIES["trivial_filter"](spark, folder).where("part = 'text'").collect()}
