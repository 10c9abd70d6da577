"""Queries over the benchmark tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import crypt, filters, geometry, sql, strings, values
from quire.operators import content, golden, graph, layout, pages
from quire.sources import compose, objects, pdf, secure
from quire.sources.shared import shared_dir, tuned, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLES[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as pages from 1."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "role", "text")


TURNS = "(SELECT conv_id AS doc_id, (turn + 1)::INT AS page_no, role, text FROM conversations)"
RANGES = [(1, 3), (5, 5), (2, 2)]


# --- documents: written, read back, and compared ---


def conversation_files(spark: SparkSession, sf_dir: str, compress: bool = False, finish: Callable[[bytes], bytes] | None = None) -> DataFrame:
    return pdf.assemble(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", compress=compress, finish=finish)


@query("SELECT conv_id::VARCHAR AS doc_id, count(*)::INT AS num_pages, 'ok' AS status, '1.3' AS version, (2 * count(*) + 2)::INT AS num_objects FROM conversations GROUP BY conv_id")
def pdf_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.documents(conversation_files(spark, sf_dir)).select("doc_id", "num_pages", "status", "version", "num_objects")


@query("SELECT conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS page_no, coalesce(text, '') AS text, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotate FROM conversations")
def pdf_roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pdf.pages(conversation_files(spark, sf_dir, compress=True))
    return read.select("doc_id", "page_no", F.decode("content", "UTF-8").alias("text"), F.col("media_box")[2].alias("width"), F.col("crop_box")[3].alias("height"), "rotate")


@query("SELECT conv_id::VARCHAR AS doc_id, (2 * count(*) + 2)::INT AS entries, count(*)::BIGINT AS page_objects, (3 * count(*) + 2)::BIGINT AS references_ FROM conversations GROUP BY conv_id")
def pdf_object_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, and references among them; each page refers to its parent and content, the tree to each page, and the trailer and catalog to one object each."""
    made = written(pdf.parsed(conversation_files(spark, sf_dir), ("objects", "nodes", "xref")), "parsed")
    entries = pdf.table(made, "xref").groupBy("doc_id").agg(F.count("*").cast("int").alias("entries"))
    kinds = pdf.table(made, "objects").groupBy("doc_id").agg(F.count(F.when(F.col("type") == "/Page", 1)).alias("page_objects"))
    links = pdf.edges(pdf.table(made, "nodes")).groupBy("doc_id").agg(F.count("*").alias("references_"))
    return entries.join(kinds, "doc_id").join(links, "doc_id")


@query("""WITH n AS (SELECT conv_id::VARCHAR AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT doc_id, src, key_path, dst, CASE WHEN many THEN n ELSE 1 END::BIGINT AS links FROM n, (VALUES ('trailer', '/Root', '/Catalog', false), ('/Catalog', '/Pages', '/Pages', false),
  ('/Pages', 'kids', '/Page', true), ('/Page', '/Parent', '/Pages', true), ('/Page', '/Contents', 'stream', true)) k(src, key_path, dst, many)""")
def pdf_reference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of written files, resolved: what kind of object refers by which key to what kind."""
    made = written(conversation_files(spark, sf_dir), "files")
    kinds = pdf.objects(made).select("doc_id", "objnum", F.coalesce("type", "kind").alias("is_"))
    links = pdf.edges(pdf.nodes(made))
    sources = graph.resolve(links, kinds.withColumnsRenamed({"objnum": "src_objnum", "is_": "src"}), ["doc_id", "src_objnum"])
    both = graph.resolve(sources, kinds.withColumnsRenamed({"objnum": "dst_objnum", "is_": "dst"}), ["doc_id", "dst_objnum"])
    return both.groupBy("doc_id", F.coalesce("src", F.lit("trailer")).alias("src"), F.coalesce("key_path", F.lit("kids")).alias("key_path"), "dst").agg(F.count("*").alias("links"))


@query("SELECT conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS page_no, 2 AS level FROM conversations")
def pdf_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of written files, found by walking each one's tree of references from its catalog."""
    made = written(conversation_files(spark, sf_dir), "files")
    kinds = pdf.objects(made).select("doc_id", F.col("objnum").alias("node"), "type")
    down = pdf.edges(pdf.nodes(made)).where("key_path IS NULL OR key_path = '/Pages'").select("doc_id", F.col("src_objnum").alias("parent"), F.col("dst_objnum").alias("node"), "ord")
    nodes = kinds.join(down, ["doc_id", "node"], "left").withColumn("ord", F.coalesce("ord", F.lit(0)))
    walk = graph.ordered_tree(nodes, "type = '/Catalog'", by=["doc_id"]).join(kinds, ["doc_id", "node"]).where("type = '/Page'")
    return walk.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("page_no"), "level")


@query("SELECT conv_id::VARCHAR AS doc_id, (2 * count(*) + 2)::BIGINT AS objects, (2 * count(*) + 2)::BIGINT AS newest, min(15)::BIGINT AS first_offset FROM conversations GROUP BY conv_id")
def pdf_xref_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-reference entries of written files: of each object the newest."""
    entries = pdf.xref(conversation_files(spark, sf_dir))
    held = layout.latest(entries, ["doc_id", "objnum"], "revision", ["offset"])
    return held.groupBy("doc_id").agg(F.count("*").alias("objects"), F.max("objnum").cast("long").alias("newest"), F.min("offset").alias("first_offset"))


def sealed(data: bytes, password: bytes) -> bytes:
    """A written file with its streams sealed by RC4 of 128 bits, as input for the reader."""
    from quire.sources.parser import parse
    from quire.sources.writer import serialize

    doc, owner, first = parse(data), b"owner key of thirty-two bytes...", b"0123456789abcdef"
    key = crypt.document_key(password, owner, -4, first, 3, 128)
    for number, value in doc.objects.items():
        if isinstance(value, objects.Stream):
            value.data = crypt.rc4(crypt.object_key(key, *number, False), value.data)
    text = lambda raw: objects.Atom("hex", f"<{raw.hex()}>")
    user = crypt.user_hash(key, first, 3).ljust(32, b"\0")
    held = {"/Filter": objects.name("Standard"), "/V": objects.number(2), "/R": objects.number(3), "/Length": objects.number(128), "/P": objects.number(-4), "/O": text(owner), "/U": text(user)}
    return serialize(doc.trailer | {"/Encrypt": held, "/ID": [text(first), text(first)]}, doc.objects)


@query("SELECT conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS page_no, coalesce(text, '') AS text FROM conversations")
def pdf_sealed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of encrypted files, read with their password."""

    made = conversation_files(spark, sf_dir, finish=lambda b: sealed(b, b"pass word"))
    return pdf.pages(made, password=b"pass word").select("doc_id", "page_no", F.decode("content", "UTF-8").alias("text"))


@query("SELECT conv_id::VARCHAR AS doc_id, 'rc4' AS method, conv_id >= 0 AS password_fits FROM conversations GROUP BY conv_id")
def pdf_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of encrypted files; the password is held against what each file stores."""

    return secure.keys(conversation_files(spark, sf_dir, finish=lambda b: sealed(b, b"pass word")), b"pass word").select("doc_id", "method", "password_fits")


@query("SELECT conv_id::VARCHAR AS doc_id, (turn + 1)::INT AS page_no, text FROM conversations WHERE regexp_matches(text, '[A-Za-z]')")
def pdf_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of four-up files, extracted to a page each: the turns whose texts aren't trivial forms, such as numbers."""
    made = four_up(spark, sf_dir)
    out = compose.fragments(made)
    forms = pdf.objects(out).where("subtype = '/Form'").select("doc_id", F.decode("stream", "UTF-8").alias("text"))
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")
    return forms.join(texts, ["doc_id", "text"]).select("doc_id", "page_no", "text").distinct()


@query("SELECT conv_id::VARCHAR AS doc_id, '{\"/Title\": \"(altered)\"}' AS info, count(*)::INT AS num_pages, '1.3' AS version FROM conversations GROUP BY conv_id")
def pdf_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry of the information changed, streams deflated, structure kept."""
    return pdf.documents(compose.rewrite(conversation_files(spark, sf_dir), compress=True, info={"/Title": "altered"})).select("doc_id", "info", "num_pages", "version")


@query("SELECT conv_id::VARCHAR || '#page=' || (turn + 1) AS uri, (turn + 1)::INT AS page_no, coalesce(text, '') AS text FROM conversations")
def pdf_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses joined to the pages that they name."""
    uris = table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("#page="), (F.col("turn") + 1).cast("string")).alias("uri"))
    return pdf.addressed(uris, conversation_files(spark, sf_dir)).select("uri", "page_no", F.decode("content", "UTF-8").alias("text"))


#: A stream with each operator once, its operands numbers where it doesn't matter.
EVERY = {op: f"{' '.join(['1'] * n)} {op}".strip() for op, n in content.COUNTS.items()} | {
    "d": "[3 1] 0 d", "Tf": "/F1 12 Tf", "ri": "/Perceptual ri", "gs": "/G1 gs", "Do": "/X Do", "Tj": "(one) Tj", "'": "(two) '", '"': '1 2 (three) "', "TJ": "[(fo) -20 (ur)] TJ",
}
_SHOWN = {"Tj": "one", "'": "two", '"': "three", "TJ": "four"}
_GROUP = {op: g for g, ops in content.GROUPS.items() for op in ops}


def _sql(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


@query(f"""SELECT op, op_group, operands, shown, count(*) AS n FROM {TURNS}, (VALUES {', '.join(f"({_sql(op)}, {_sql(_GROUP[op])}, {2 if op in ('d', 'Tf') else content.COUNTS[op]}, {_sql(_SHOWN.get(op))})" for op in EVERY)}) o(op, op_group, operands, shown) GROUP BY ALL""")
def content_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators of the format, in a stream behind each turn's text as a shown string."""
    streams = turns(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page_no").alias("doc_id"), F.concat(strings.literal_column(F.coalesce("text", F.lit(""))), F.lit(" Tj\n" + "\n".join(EVERY.values()))).cast("binary").alias("content"))
    ops = content.operators(streams).where("ord > 0")
    return ops.groupBy("op", content.operator_group(F.col("op")).alias("op_group"), F.size("operands").alias("operands"), "shown").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id || '/' || page_no AS doc_id, {len(EVERY) + 1}::BIGINT AS operators, coalesce(text, '') AS text FROM {TURNS}")
def content_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators read, written back and read again."""
    streams = turns(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page_no").alias("doc_id"), F.concat(strings.utf16_hex_column(F.coalesce("text", F.lit(""))), F.lit(" Tj\n" + "\n".join(EVERY.values()))).cast("binary").alias("content"))
    again = content.operators(content.replayed(content.operators(streams)))
    return again.groupBy("doc_id").agg(F.count("*").alias("operators"), F.max(F.when(F.col("ord") == 0, F.col("shown"))).alias("text"))


@query("SELECT c_custkey, c_name AS text FROM customer")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings read by a function registered for SQL."""
    sql.register(spark)
    return table(spark, sf_dir, "customer").select("c_custkey", strings.literal_column(F.col("c_name")).alias("s")).selectExpr("c_custkey", "pdf_string_text(s) AS text")


@query("SELECT conv_id::VARCHAR || '/' || (turn + 1) AS doc_id, coalesce(text, '') AS text FROM conversations")
def content_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns shown by a text operator and read back."""
    lit = strings.utf16_hex_column(F.coalesce("text", F.lit("")))
    streams = turns(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page_no").alias("doc_id"), F.concat(F.lit("BT /F1 9 Tf "), lit, F.lit(" Tj ET")).cast("binary").alias("content"))
    return content.operators(streams).where("op = 'Tj'").select("doc_id", F.col("shown").alias("text"))


#: A stream, and after some of its operators the values that hold: (ord, column, value).
STATE = "q 2 w 1 J 2 j 4 M [3 1] 0 d 0.5 g 1 0 0 RG 1 0 0 1 9 9 cm 5 6 m 7 8 l 1 2 3 4 5 6 c h 10 20 30 40 re S BT /F1 12 Tf 14 TL 1 Tc 2 Tw 90 Tz 3 Ts 2 0 0 2 50 60 Tm 1 1 Td T* (a) ' 5 6 (b) \" ET Q n"
HOLDS = [
    (1, "line_width", "2"), (2, "line_cap", "1"), (3, "line_join", "2"), (4, "miter_limit", "4"), (5, "dash", "[3 1] 0"), (6, "fill", "0.5"), (7, "stroke", "1 0 0"), (8, "ctm", "1.0 0.0 0.0 1.0 9.0 9.0"), (9, "point", "5.0 6.0"),
    (10, "point", "7.0 8.0"), (11, "point", "5.0 6.0"), (12, "point", "5.0 6.0"), (13, "point", "10.0 20.0"), (14, "path", "0"), (15, "text_block", "1"), (15, "path", "1"), (16, "font", "/F1 12"), (17, "leading", "14"),
    (18, "char_space", "1"), (19, "word_space", "2"), (20, "scale", "90"), (21, "rise", "3"), (22, "text_matrix", "2.0 0.0 0.0 2.0 50.0 60.0"), (23, "text_matrix", "2.0 0.0 0.0 2.0 52.0 62.0"),
    (24, "text_matrix", "2.0 0.0 0.0 2.0 52.0 34.0"), (25, "text_matrix", "2.0 0.0 0.0 2.0 52.0 6.0"), (26, "word_space", "5"), (26, "char_space", "6"), (26, "text_matrix", "2.0 0.0 0.0 2.0 52.0 -22.0"), (26, "depth", "1"), (28, "depth", "0"),
]


@query(f"""SELECT ord, held, value, count(*) AS n FROM {TURNS}, (VALUES {', '.join(f"({k}, {_sql(c)}, {_sql(v)})" for k, c, v in HOLDS)}) h(ord, held, value) GROUP BY ALL""")
def content_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds after the operators of a stream, each turn's text shown behind it."""
    streams = turns(spark, sf_dir).select(F.concat_ws("/", "doc_id", "page_no").alias("doc_id"), F.concat(F.lit(STATE + " "), strings.literal_column(F.coalesce("text", F.lit(""))), F.lit(" Tj")).cast("binary").alias("content"))
    found = content.states(streams)
    names = sorted({c for _, c, _ in HOLDS})
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ") if c in ("ctm", "point", "text_matrix") else F.col(c).cast("string")
    wanted = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.array(*[F.lit(c) for n, c, _ in HOLDS if n == k]).alias("value")) for k in sorted({k for k, _, _ in HOLDS})]))
    held = found.select("ord", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), text(c))])).alias("held", "value"))
    return held.where(F.array_contains(F.try_element_at(wanted, F.col("ord")), F.col("held"))).groupBy("ord", "held", "value").agg(F.count("*").alias("n"))


@query("""SELECT (conv_id // 10)::VARCHAR AS doc_id, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn)::INT AS page_no, coalesce(text, '') AS text FROM conversations""")
def pdf_joined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files in one, pages copied whole."""
    order = Window.partitionBy("out_doc").orderBy("conv_id", "turn")
    plan = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 10).cast("string").alias("out_doc"), "conv_id", "turn")
    plan = plan.select("out_doc", F.row_number().over(order).alias("out_page"), F.col("conv_id").cast("string").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.lit(True).alias("whole"))
    made = compose.compose(conversation_files(spark, sf_dir), plan, compress=True)
    return pdf.pages(made).select("doc_id", "page_no", F.decode("content", "UTF-8").alias("text"))


def four_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pages a sheet, as fragments at half their size."""
    made = written(conversation_files(spark, sf_dir), "files")
    half = lambda c, size: (F.col(c) * F.col("scale") * size)
    plan = pages.grid(pdf.pages(made)).select(F.col("doc_id").alias("out_doc"), F.col("sheet").alias("out_page"), "doc_id", "page_no", "scale", half("x", 612).alias("x"), half("y", 792).alias("y"))
    return written(compose.compose(made, plan), "sheets")


@query("SELECT conv_id::VARCHAR AS doc_id, ((count(*) + 3) // 4)::BIGINT AS sheets, count(*) AS fragments, 792.0::DOUBLE AS height FROM conversations GROUP BY conv_id")
def pdf_four_up_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = pdf.pages(four_up(spark, sf_dir))
    shown = content.operators(sheets.select(F.concat_ws("/", "doc_id", "page_no").alias("doc_id"), "content")).where("op = 'Do'")
    counted = shown.groupBy(F.split("doc_id", "/")[0].alias("doc_id")).agg(F.count("*").alias("fragments"))
    return sheets.groupBy("doc_id").agg(F.count("*").alias("sheets"), F.max(F.col("media_box")[3]).alias("height")).join(counted, "doc_id")


# --- page algebra ---


@query(f"""SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY s + page_no - a)::INT AS out_page, role FROM {TURNS}
  JOIN (VALUES (1, 3, 0), (5, 5, 3), (2, 2, 4)) r(a, b, s) ON page_no BETWEEN a AND b""")
def page_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.subset(turns(spark, sf_dir), RANGES).select("doc_id", "page_no", "out_page", "role")


@query(f"""SELECT part, doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY part, page_no)::INT AS out_page FROM (
  SELECT 0 AS part, * FROM {TURNS} WHERE role = 'user' UNION ALL SELECT 1, * FROM {TURNS})""")
def page_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = turns(spark, sf_dir)
    return pages.concatenate([every.where("role = 'user'"), every], by="doc_id").select("part", "doc_id", "page_no", "out_page")


@query(f"SELECT doc_id, page_no, ((90 * (page_no % 4) + 270 * ((page_no BETWEEN 1 AND 4)::INT + (page_no BETWEEN 3 AND 6)::INT)) % 360)::INT AS rotate FROM {TURNS}")
def page_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = turns(spark, sf_dir).withColumn("rotate", 90 * (F.col("page_no") % 4))
    return pages.rotate(given, 270, [(1, 4), (3, 6)]).select("doc_id", "page_no", "rotate")


@query(f"SELECT doc_id, page_no, ((page_no - 1) // 4 + 1)::BIGINT AS sheet, ((page_no - 1) % 4)::INT AS slot, 0.5::DOUBLE AS scale, ((page_no - 1) % 2)::DOUBLE AS x, (1 - ((page_no - 1) % 4) // 2)::DOUBLE AS y FROM {TURNS}")
def page_4up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.grid(turns(spark, sf_dir)).select("doc_id", "page_no", "sheet", "slot", "scale", "x", "y")


@query(f"""WITH n AS (SELECT doc_id, max(page_no) AS last, ((max(page_no) + 3) // 4 * 4)::INT AS n FROM {TURNS} GROUP BY doc_id),
s AS (SELECT *, unnest(range(1, n // 2 + 1))::INT AS sheet FROM n),
o AS (SELECT doc_id, sheet, CASE WHEN sheet <= last THEN sheet END AS low, CASE WHEN n + 1 - sheet <= last THEN n + 1 - sheet END AS high FROM s)
SELECT doc_id, sheet, CASE WHEN sheet % 2 = 1 THEN high ELSE low END AS left_page, CASE WHEN sheet % 2 = 1 THEN low ELSE high END AS right_page FROM o""")
def page_booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.booklet(turns(spark, sf_dir))


@query(f"""WITH p AS (SELECT doc_id, ((page_no - 1) // 4 + 1)::INT AS signature, (page_no - 1) % 4 + 1 AS k FROM {TURNS}),
n AS (SELECT doc_id, signature, max(k) AS last, ((max(k) + 1) // 2 * 2)::INT AS n FROM p GROUP BY ALL),
s AS (SELECT *, unnest(range(1, n // 2 + 1))::INT AS sheet FROM n),
o AS (SELECT doc_id, signature, sheet, CASE WHEN sheet <= last THEN sheet END AS low, CASE WHEN n + 1 - sheet <= last THEN n + 1 - sheet END AS high FROM s)
SELECT doc_id, signature, sheet, (CASE WHEN sheet % 2 = 1 THEN high ELSE low END + 4 * (signature - 1))::INT AS left_page, (CASE WHEN sheet % 2 = 1 THEN low ELSE high END + 4 * (signature - 1))::INT AS right_page FROM o""")
def page_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.signatures(turns(spark, sf_dir), 4, multiple=2)


@query(f"SELECT doc_id, page_no, copy::INT AS copy, CASE WHEN (page_no + copy) % 2 = 1 THEN 0 ELSE 180 END::INT AS turn FROM {TURNS}, (VALUES (0), (1)) c(copy)")
def page_print_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.twice(turns(spark, sf_dir)).select("doc_id", "page_no", "copy", "turn")


@query(f"SELECT doc_id, page_no, half::INT AS half, half * 0.5::DOUBLE AS view_x, 0.5::DOUBLE AS view_w, (2 * page_no - 1 + half)::INT AS out_page FROM {TURNS}, (VALUES (0), (1)) c(half)")
def page_unspread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.halves(turns(spark, sf_dir)).select("doc_id", "page_no", "half", "view_x", "view_w", "out_page")


SIZED = "(SELECT p_partkey, p_size, (300 + p_size)::DOUBLE AS width, (400 + 2 * p_size)::DOUBLE AS height, (p_partkey % 5 + 1)::INT AS page_no FROM part)"


def sized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of different sizes."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") + 300).cast("double").alias("width"), (F.col("p_size") * 2 + 400).cast("double").alias("height"), (F.col("p_partkey") % 5 + 1).cast("int").alias("page_no"))


@query(f"SELECT p_partkey, width - 72 AS view_w, height - 72 AS view_h, (width - 72) * 4.8::DOUBLE AS out_w, (height - 72) * 4.8::DOUBLE AS out_h FROM {SIZED} WHERE page_no = 1")
def page_poster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.poster(sized_pages(spark, sf_dir)).select("p_partkey", "view_w", "view_h", "out_w", "out_h")


@query(f"SELECT doc_id, page_no, (SELECT r_name FROM region WHERE r_regionkey = 0) AS mark, 1 AS z FROM {TURNS}")
def page_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.col("r_name").alias("mark"))
    return pages.stamp(turns(spark, sf_dir), mark).select("doc_id", "page_no", "mark", "z")


@query(f"""SELECT p_partkey, least(1.0::DOUBLE, width / 325.0::DOUBLE) AS scale, CASE WHEN page_no % 2 = 1 THEN 0.0::DOUBLE ELSE width - least(1.0::DOUBLE, width / 325.0::DOUBLE) * 325.0::DOUBLE END AS mark_x FROM {SIZED}""")
def page_fancy_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(325.0).alias("mark_width"))
    return pages.fitted_stamp(sized_pages(spark, sf_dir), mark).select("p_partkey", "scale", "mark_x")


# --- overlays and fragments ---


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + l_tax) AS x1, max(l_discount + l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def merge_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.envelope(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query(f"SELECT doc_id, page_no, '/Mark_' || (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 7 END + row_number() OVER (PARTITION BY doc_id ORDER BY page_no))::VARCHAR AS name FROM {TURNS}")
def overlay_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = turns(spark, sf_dir).withColumn("largest", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 7))
    return layout.overlay_names(given, ["doc_id"], "page_no", "largest", "/Mark_").select("doc_id", "page_no", "name")


@query(f"""SELECT doc_id, coalesce(string_agg('/' || role || ' Do', chr(10) ORDER BY z) FILTER (z < 0), '') AS before, coalesce(string_agg('/' || role || ' Do', chr(10) ORDER BY z) FILTER (z > 0), '') AS after,
  bool_or(z > 0) AS guarded FROM (SELECT *, CASE WHEN page_no < 3 THEN page_no - 3 ELSE page_no - 2 END AS z FROM {TURNS}) GROUP BY doc_id""")
def overlay_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = turns(spark, sf_dir).withColumn("z", F.when(F.col("page_no") < 3, F.col("page_no") - 3).otherwise(F.col("page_no") - 2)).withColumn("name", F.concat(F.lit("/"), "role"))
    return layout.painted(given, ["doc_id"], "z", "name")


@query(f"SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS content, count(*) AS parts, octet_length(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY page_no)))::BIGINT AS n_bytes FROM {TURNS} GROUP BY doc_id")
def contents_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_parts(turns(spark, sf_dir), ["doc_id"], "page_no", "text")


@query("""SELECT doc_id, part, s FROM (SELECT doc_id, 'text' AS part, text AS s FROM documents UNION ALL SELECT doc_id, 'form', 'q 1 0 0 1 ' || doc_id || ' 0 cm /Fm0 Do Q' FROM documents UNION ALL SELECT doc_id, 'image', 'q /Im' || doc_id || ' Do Q' FROM documents)
  WHERE NOT (length(s) < 300 AND len(list_filter(regexp_split_to_array(s, '[\\x00\\t\\n\\f\\r ]+'), lambda w: w <> '' AND NOT (w IN ('q', 'Q', 'cm', 'Do') OR w LIKE '/%' OR regexp_full_match(w, '[.-]*[0-9][0-9.-]*')))) = 0)""")
def trivial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts, beside two made-up streams a document."""
    made = {"text": F.col("text"), "form": F.concat(F.lit("q 1 0 0 1 "), "doc_id", F.lit(" 0 cm /Fm0 Do Q")), "image": F.concat(F.lit("q /Im"), "doc_id", F.lit(" Do Q"))}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("s")) for k, v in made.items()])).alias("x")
    return table(spark, sf_dir, "documents").select("doc_id", parts).select("doc_id", "x.part", "x.s").where(~layout.trivial(F.col("s")))


@query(f"SELECT p_partkey, 612.0::DOUBLE AS page_width, height * 540.0::DOUBLE / width + 72.0::DOUBLE AS page_height, 'q 540 0 0 ' || rtrim(rtrim(printf('%.9f', height * 540.0::DOUBLE / width), '0'), '.') || ' 36 36 cm /Fragment0 Do Q' AS content FROM {SIZED}")
def fragment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, c = layout.fragment_page(F.col("width"), F.col("height"), 612, 36)
    return sized_pages(spark, sf_dir).select("p_partkey", w.alias("page_width"), h.alias("page_height"), c.alias("content"))


# --- cross-reference and object graph ---


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def xref_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_type", "event_id", "value"])


@query(f"SELECT doc_id, page_no, (15 + coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM {TURNS}")
def xref_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.offsets(turns(spark, sf_dir), ["doc_id"], ["page_no"], F.octet_length("text")).select("doc_id", "page_no", "offset")


@query("SELECT event_id, printf('%010d %05d %s', event_id * 7, event_id % 65536, CASE WHEN event_id % 3 > 0 THEN 'n' ELSE 'f' END) AS line FROM events")
def xref_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", layout.xref_line(k * 7, k % 65536, k % 3 > 0).alias("line"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return graph.resolve(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), targets, ["o_custkey"])


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 30)")
def ref_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("l_partkey"))
    return graph.dangling(table(spark, sf_dir, "lineitem").select("l_partkey").distinct(), targets, ["l_partkey"])


@query("SELECT o_orderkey, coalesce((SELECT c_custkey + 1000000 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 10), o_custkey) AS o_custkey FROM orders")
def ref_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    remap = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return graph.rewrite(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), remap, "o_custkey")


TREE = """t AS (SELECT r_regionkey AS doc_id, 'r' || r_regionkey AS node, NULL AS parent, 0 AS ord, 7::BIGINT AS box FROM region
  UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END FROM nation
  UNION ALL SELECT n_regionkey, 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as documents, each with a page tree of nations and suppliers; some nodes have a box."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    some = lambda c, n: F.when(F.col(c) % n == 0, F.col(c).cast("long"))
    nation = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), text("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit(7).cast("long").alias("box"))
    n = nation.select("n_regionkey", text("n", "n_nationkey"), text("r", "n_regionkey"), F.col("n_nationkey").cast("long"), some("n_nationkey", 2))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", text("s", "s_suppkey"), text("n", "s_nationkey"), F.col("s_suppkey").cast("long"), some("s_suppkey", 3))
    return r.union(n).union(s)


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT doc_id, node, 0 AS level, [ord::BIGINT] AS path FROM t WHERE parent IS NULL
  UNION ALL SELECT w.doc_id, t.node, w.level + 1, list_append(w.path, t.ord::BIGINT) FROM w JOIN t ON t.parent = w.node AND t.doc_id = w.doc_id)
SELECT doc_id, node, level::INT AS level, row_number() OVER (PARTITION BY doc_id ORDER BY path)::INT AS page_no FROM w WHERE node LIKE 's%'""")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of each document's tree in order."""
    walk = graph.ordered_tree(tree_nodes(spark, sf_dir), F.col("parent").isNull(), by=["doc_id"]).where("node LIKE 's%'")
    return walk.select("doc_id", "node", "level", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("page_no"))


@query(f"""WITH {TREE} SELECT s.doc_id, s.node, coalesce(s.box, n.box, r.box) AS box FROM t s JOIN t n ON s.parent = n.node JOIN t r ON n.parent = r.node""")
def inheritable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree_nodes(spark, sf_dir)
    return graph.inherited(graph.ordered_tree(nodes, "parent IS NULL", by=["doc_id"]), nodes, "box", by=["doc_id"]).where("node LIKE 's%'")


@query("""WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)), p AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (FROM o))
SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 'o' || o_orderkey FROM o UNION ALL SELECT 'p' || l_partkey FROM p""")
def reachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of references from all customers."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    down = o.select(text("c", "o_custkey").alias("src"), text("o", "o_orderkey").alias("dst"))
    down = down.union(line.join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(text("o", "l_orderkey"), text("p", "l_partkey")))
    return graph.reachable(down, table(spark, sf_dir, "customer").select(text("c", "c_custkey").alias("node")))


@query("SELECT l_orderkey, count(*) AS members, min(l_linenumber) AS first_member, max(l_linenumber) AS last_member, array_to_string(list_sort(list(l_linenumber)), ' ') AS member_list FROM lineitem GROUP BY l_orderkey")
def objstm_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.containers(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber").withColumn("member_list", F.array_join(F.transform("member_list", lambda x: x.cast("string")), " "))


@query("SELECT p_partkey, p_type FROM part WHERE (p_type IS NULL OR p_type IN ('ECONOMY', 'PROMO', 'STANDARD ANODIZED TIN')) AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#1', 'Brand#2')")
def find_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.found_objects(table(spark, sf_dir, "part"), ["ECONOMY", "PROMO", "STANDARD ANODIZED TIN", None], ["Brand#12", "Brand#23", "Brand#1", "Brand#2"], "p_type", "p_brand").select("p_partkey", "p_type")


@query("""SELECT d.doc_id, md5(text) AS digest, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic THEN 'skipped' WHEN good THEN 'ok' WHEN bad THEN 'known bad' ELSE 'changed' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id, bool_or(toxic = 1) AS toxic, bool_or(quality = 1) AS good, bool_or(quality = 0) AS bad FROM labels GROUP BY doc_id) l USING (doc_id)""")
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts held against a table of accepted digests, which labels are made into."""
    results = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    verdict = F.when(F.col("toxic") == 1, golden.SKIP).when(F.col("quality") == 1, F.col("digest")).otherwise(F.concat(F.lit(golden.BAD), "digest"))
    accepted = table(spark, sf_dir, "labels").join(results, "doc_id").select("doc_id", verdict.alias("digest"))
    return golden.compared(results, accepted, ["doc_id"])


# --- strings, names, numbers, geometry ---


@query("SELECT page_id, '(' || regexp_replace(html, '([()\\\\])', '\\\\\\1', 'g') || ')' AS lexeme FROM pages")
def str_encode_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.literal_column(F.col("html")).alias("lexeme"))


@query("SELECT page_id, html AS text FROM pages")
def str_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strings.text_udf(strings.literal_column(F.col("html"))).alias("text"))


@query("SELECT doc_id, '<FEFF' || array_to_string(list_transform(string_split(text, ''), lambda c: printf('%04X', ord(c))), '') || '>' AS lexeme FROM documents")
def str_encode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strings.utf16_hex_column(F.col("text")).alias("lexeme"))


@query("SELECT doc_id, text FROM documents")
def str_decode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strings.doc_text_column(strings.hex_column(strings.utf16_hex_column(F.col("text")))).alias("text"))


@query("SELECT c_custkey, c_name AS text FROM customer")
def str_decode_octal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings in which every character is an octal code."""
    codes = F.transform(F.split("c_name", ""), lambda c: F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(c), 10, 8), 3, "0")))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.text_udf(F.concat(F.lit("("), F.array_join(codes, ""), F.lit(")"))).alias("text"))


@query("SELECT p_partkey, '/' || replace(p_name, ' ', '#20') AS name FROM part")
def name_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.name_column(F.concat(F.lit("/"), "p_name")).alias("name"))


@query("SELECT p_partkey, '/' || p_name AS name FROM part")
def name_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.name_decode_udf(strings.name_column(F.concat(F.lit("/"), "p_name"))).alias("name"))


@query("SELECT p_partkey, rtrim(rtrim(printf('%.9f', p_retailprice), '0'), '.') AS number FROM part")
def float_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", strings.number_column(F.col("p_retailprice")).alias("number"))


@query("SELECT event_id, (event_id * 37) % 16777216 AS number FROM events")
def be_uint(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.unhex(F.lpad(F.hex((F.col("event_id") * 37) % 16777216), 6, "0"))
    return table(spark, sf_dir, "events").select("event_id", strings.big_endian(raw).alias("number"))


@query("SELECT page_id, CASE WHEN instr(url, '#') > 0 THEN left(url, instr(url, '#') - 1) ELSE url END || '' AS docname, page_id % 9 AS page, 0.25::DOUBLE AS x, 90::INT AS rotate FROM pages")
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "#.*", "")
    uri = F.concat(bare, F.lit("#page="), (F.col("page_id") % 9).cast("string"), F.lit("&viewrect=0.25,0,1,1&rotate=90"))
    return table(spark, sf_dir, "pages").select("page_id", geometry.address(uri).alias("a")).select("page_id", "a.docname", F.col("a.page").cast("long").alias("page"), F.col("a.viewrect")[0].alias("x"), "a.rotate")


BOXES = "(SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d, (vec_id % 4)::INT AS r FROM embeddings)"


@query(f"""SELECT vec_id, least(x0, x1) + 0 AS x0, least(y0, y1) + 0 AS y0, greatest(x0, x1) + 0 AS x1, greatest(y0, y1) + 0 AS y1 FROM (SELECT vec_id,
  CASE r WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN -a ELSE -b END AS x0, CASE r WHEN 0 THEN b WHEN 1 THEN -a WHEN 2 THEN -b ELSE a END AS y0,
  CASE r WHEN 0 THEN c WHEN 1 THEN d WHEN 2 THEN -c ELSE -d END AS x1, CASE r WHEN 0 THEN d WHEN 1 THEN -c WHEN 2 THEN -d ELSE c END AS y1 FROM {BOXES})""")
def rect_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    turned = geometry.turn_box(geometry.Box(*e), geometry.quarter_turns((F.col("vec_id") % 4 * 90).cast("int")))
    return table(spark, sf_dir, "embeddings").select("vec_id", *[(c + 0).alias(n) for c, n in zip(turned, ("x0", "y0", "x1", "y1"), strict=True)])


@query(f"SELECT p_partkey, width * 0.25::DOUBLE AS x0, height - height AS y0, width * 0.25::DOUBLE + width * 0.5::DOUBLE AS x1, height - height * 0.5::DOUBLE AS y1 FROM {SIZED}")
def view_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of a page, without the outer quarters."""
    page = geometry.Box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    view = geometry.view_box(page, None, (F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(0.5)), F.lit(0))
    return sized_pages(spark, sf_dir).select("p_partkey", *[c.alias(n) for c, n in zip(view, ("x0", "y0", "x1", "y1"), strict=True)])


@query(f"SELECT p_partkey, 300.0::DOUBLE AS w, height * (300.0::DOUBLE / width) AS h, 300.0::DOUBLE / width AS a, 10.0::DOUBLE + (10.0::DOUBLE - 10.0::DOUBLE) * (300.0::DOUBLE / width) AS e FROM {SIZED}")
def place_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page moved to (10, 20) and scaled to a width of 300."""
    p = geometry.move_to(geometry.place(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")), F.lit(10.0), F.lit(20.0))
    q = geometry.with_width(p, F.lit(300.0))
    return sized_pages(spark, sf_dir).select("p_partkey", F.lit(300.0).alias("w"), q.h.alias("h"), q.matrix[0].alias("a"), q.matrix[4].alias("e"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line, (length(string_split(text, chr(10))[-1]) + 1)::INT AS place FROM documents")
def linepos(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, end = F.col("text"), F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", strings.line_column(text, end).alias("line"), strings.column_column(text, end).alias("place"))


@query("""SELECT c_custkey, '<</Name (' || c_name || ')' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' /Seg#20ment /' || c_mktsegment END || ' /Size ' || c_custkey % 10 || '>>' AS dictionary, CASE WHEN c_custkey % 3 > 0 THEN '/' || c_mktsegment END AS segment FROM customer""")
def dict_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys set, overwritten and taken away, then written in order."""
    base = F.create_map(F.lit("/Size"), F.lit("0"), F.lit("/Seg ment"), F.lit("x"), F.lit("/Old"), F.lit("null"))
    held = values.merged(values.drop(base, "/Old"), F.create_map(F.lit("/Size"), (F.col("c_custkey") % 10).cast("string")))
    held = values.put(held, "/Name", strings.literal_column(F.col("c_name")))
    held = values.put(held, "/Seg ment", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("/"), "c_mktsegment")))
    made = table(spark, sf_dir, "customer").select("c_custkey", held.alias("held"))
    return made.select("c_custkey", values.written(F.col("held")).alias("dictionary"), values.get(F.col("held"), "/Seg ment").alias("segment"))


@query("""SELECT l_orderkey, count(*) FILTER (l_linenumber = 2)::INT AS twos, CASE WHEN count(*) FILTER (l_linenumber = 2) > 0 THEN count(*) FILTER (l_linenumber < 2) END::BIGINT AS first_two,
  (count(*) - least(count(*) FILTER (l_linenumber = 2), 1))::INT AS without_two, (count(*) - 1)::INT AS without_last FROM lineitem GROUP BY l_orderkey""")
def array_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    arrays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    two = F.lit(2)
    return arrays.select("l_orderkey", values.count_of(a, two).alias("twos"), values.index_of(a, two).alias("first_two"), F.size(values.without_first(a, two)).alias("without_two"), F.size(values.without_last(a)).alias("without_last"))


# --- tokens and filters ---


@query("""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '[(<>)%{}\\[\\]]', ' ', 'g'), '[^\\x00 \\t\\f\\n\\r/]+|/[^\\x00 \\t\\f\\n\\r/]*'))::BIGINT AS tokens FROM pages""")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and names of a text without delimiters of other kinds."""
    plain = F.regexp_replace("html", r"[(<>)%{}\[\]]", " ")
    found = pdf.token_table(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), plain.cast("binary").alias("content")))
    return found.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.count("*").alias("tokens"))


@query("SELECT doc_id, text FROM documents")
def deflate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.decode(filters.inflate_udf(filters.deflate_udf(F.col("text").cast("binary"))), "UTF-8").alias("text"))


#: Of rows of 16 bytes: each byte's left, upper and upper left neighbour, 0 outside.
NEIGHBOURS = """WITH h AS (SELECT doc_id, regexp_extract_all(rpad(hex(encode(text)), ((octet_length(encode(text)) + 15) // 16 * 32)::INT, '0'), '..') AS h FROM documents),
e AS (SELECT doc_id, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS i FROM h), v AS (SELECT doc_id, i, ('0x' || x)::BIGINT AS v FROM e),
n AS (SELECT doc_id, i, v, CASE WHEN i % 16 > 0 THEN lag(v, 1, 0) OVER w ELSE 0 END AS a, lag(v, 16, 0) OVER w AS b, CASE WHEN i % 16 > 0 THEN lag(v, 17, 0) OVER w ELSE 0 END AS c FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, abs(b - c) AS pa, abs(a - c) AS pb, abs(a + b - 2 * c) AS pc FROM n)"""
GUESSES = {"png_sub": "a", "png_up": "b", "png_average": "(a + b) // 2", "png_paeth": "CASE WHEN pa <= pb AND pa <= pc THEN a WHEN pb <= pc THEN b ELSE c END"}


def predictor(name: str, kind: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Whole texts as rows of 16 bytes, the last filled up with zeros: a digest of the predicted bytes, and the text restored from them."""
        raw = F.col("text").cast("binary")
        made = filters.predict_udf(kind, 16)(raw)
        back = F.decode(F.substring(filters.unpredict_udf(16)(made), F.lit(1), F.octet_length("text")), "UTF-8")
        digest = F.md5(F.regexp_replace(F.hex(made), "..(.{32})", "$1").cast("binary"))
        return table(spark, sf_dir, "documents").select("doc_id", digest.alias("predicted"), back.alias("text"))

    run.__name__ = name
    query(f"{NEIGHBOURS}, d AS (SELECT doc_id, md5(string_agg(printf('%02X', ((v - ({GUESSES[name]})) % 256 + 256) % 256), '' ORDER BY i)) AS predicted FROM p GROUP BY doc_id) SELECT doc_id, predicted, text FROM documents JOIN d USING (doc_id)")(run)


for _kind, _name in enumerate(GUESSES, 1):
    predictor(_name, _kind)


@query("""WITH b AS (SELECT page_id, regexp_extract_all(hex(encode(html)), '..') AS h FROM pages), e AS (SELECT page_id, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS i FROM b),
v AS (SELECT page_id, i, ('0x' || x)::BIGINT AS v FROM e), r AS (SELECT page_id, i, (sum(v) OVER (PARTITION BY page_id, i // 48, i % 3 ORDER BY i) % 256)::INT AS sub, (sum(v) OVER (PARTITION BY page_id, i % 48 ORDER BY i) % 256)::INT AS up FROM v),
d AS (SELECT page_id, md5(string_agg(printf('%02X', sub), '' ORDER BY i)) AS sub, md5(string_agg(printf('%02X', up), '' ORDER BY i)) AS up FROM r GROUP BY page_id)
SELECT page_id, octet_length(encode(html))::BIGINT AS n_bytes, sub, up FROM pages LEFT JOIN d USING (page_id)""")
def png_running_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and up predictors undone over all bytes of every page, as rows of 16 pixels of three bytes; digests of what comes out."""
    raw = F.col("html").cast("binary")
    sums = [filters.running_digest_udf(k, 16, 3)(raw).alias(c) for k, c in ((1, "sub"), (2, "up"))]
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(raw).cast("long").alias("n_bytes"), *sums)


# --- streaming ---


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, read as a stream to its end and written each round."""
    import uuid

    from quire.streaming import ingest

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    # as a pattern, the path may be a file as well as a folder
    found = ingest.table_stream(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    columns = ["event_type", "event_id"]
    ingest.drain_newest(ingest.newest(found, ["user_id"], "ts", columns), f"{at}/out", f"{at}/state")
    return ingest.newest_rows(spark, f"{at}/out", ["user_id"], "ts", columns).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
