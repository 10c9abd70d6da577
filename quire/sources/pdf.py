"""Tables of PDF files: a row a document, page, object, node, reference, cross-reference entry, token or operator.

Every table takes a frame with `doc_id` and `content` (bytes). Documents are parsed where their bytes are, one by one,
without a shuffle; a damaged one yields a row in `documents` with its problems and no rows elsewhere (mode PERMISSIVE),
or is left out (DROPMALFORMED), or ends the job (FAILFAST). With a password, encrypted documents are read as if they weren't.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.sources import objects as o
from quire.sources.lexer import Lexer
from quire.sources.parser import Document, decoded, parse
from quire.sources.shared import packed, tuned, values

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}

DOCUMENTS = "doc_id string, version string, is_xref_stream boolean, num_pages int, num_objects int, status string, info string, problems array<string>"
OBJECTS = "doc_id string, objnum int, gennum int, kind string, type string, subtype string, value string, stream binary, filter array<string>, length long"
NODES = "doc_id string, objnum int, gennum int, node_id int, parent_id int, key string, ord int, kind string, lexeme string, ref_objnum int, ref_gennum int"
PAGES = "doc_id string, page_no int, objnum int, gennum int, media_box array<double>, crop_box array<double>, rotate int, content binary"
XREF = "doc_id string, revision int, objnum int, gennum int, kind string, offset long, container int, idx int"
TOKENS = "doc_id string, ord int, start_pos long, end_pos long, lexeme string, kind string"


def files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, content, modified, length) of files below a path; the path is the id."""
    tuned(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), "content", F.col("modificationTime").alias("modified"), "length")


def rows_of(content: DataFrame, ddl: str, make: Callable[[str, bytes], Iterator[tuple]], at_once: int = 4096) -> DataFrame:
    """A table from a generator of rows a document, in batches, so that a large document's rows needn't be held together."""
    schema = pa.schema([(n, _TYPES[t]) for n, t in _fields(ddl)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((row for b in batches for key, data in values(b) for row in make(key, data)), schema, at_once)

    return content.select(F.col("doc_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, ddl)


def checked(key: str, data: bytes | None, mode: str, password: bytes | None = None) -> Document | None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    doc = parse(data, password)
    if doc.status == "failed" and mode == "FAILFAST":
        raise ValueError(f"{key}: {doc.problems[-1].message}")
    return None if doc.status == "failed" and mode == "DROPMALFORMED" else doc


def plain(value: o.Value | None) -> object:
    """A value for JSON: names and strings by their lexemes, references as `n g R`."""
    if isinstance(value, o.Ref):
        return f"{value.objnum} {value.gennum} R"
    if isinstance(value, o.Atom):
        return None if value.kind == "null" else value.text
    if isinstance(value, list):
        return [plain(x) for x in value]
    held = o.entries(value)
    return {k: plain(held[k]) for k in sorted(held)}


def _document_rows(doc: Document) -> Iterator[tuple]:
    info = doc.resolve(doc.trailer.get("/Info"))
    notes = [f"{p.level}: {p.message} ({p.line}, {p.column})" for p in doc.problems]
    yield doc.version, bool(doc.sections) and doc.sections[0].is_stream, len(doc.pages), len(doc.objects), doc.status, json.dumps(plain(info), ensure_ascii=False) if info else None, notes


def _object_rows(doc: Document, decompress: bool = False) -> Iterator[tuple]:
    for (n, g), value in sorted(doc.objects.items()):
        held, stream = o.entries(value), value.data if isinstance(value, o.Stream) else None
        names = doc.resolve(held.get("/Filter"))
        names = [x for x in map(o.name_of, names if isinstance(names, list) else [names]) if x]
        if decompress and isinstance(value, o.Stream):
            stream, done = decoded(value, doc)
            names = [] if done else names
        kind = "stream" if stream is not None else "dict" if isinstance(value, dict) else "array" if isinstance(value, list) else "ref" if isinstance(value, o.Ref) else value.kind
        yield n, g, kind, o.name_of(doc.resolve(held.get("/Type"))), o.name_of(doc.resolve(held.get("/Subtype"))), json.dumps(plain(value), ensure_ascii=False), stream, names, len(stream) if stream is not None else None


def _node_rows(doc: Document) -> Iterator[tuple]:
    for (n, g), top in sorted([*doc.objects.items(), ((0, 65535), doc.trailer)]):
        todo, made = [(top, -1, None, 0)], 0
        while todo:
            value, parent, name, ord_ = todo.pop()
            me, made = made, made + 1
            ref = value if isinstance(value, o.Ref) else (None, None)
            kind = "ref" if isinstance(value, o.Ref) else "array" if isinstance(value, list) else "stream" if isinstance(value, o.Stream) else "dict" if isinstance(value, dict) else value.kind
            yield n, g, me, parent if parent >= 0 else None, name, ord_, kind, value.text if isinstance(value, o.Atom) else None, *ref
            held = o.entries(value)
            below = [(v, me, k, i) for i, (k, v) in enumerate(sorted(held.items()))] if held else [(v, me, None, i) for i, v in enumerate(value)] if isinstance(value, list) else []
            todo += reversed(below)


def _page_rows(doc: Document) -> Iterator[tuple]:
    for k, (ref, page) in enumerate(doc.pages, 1):
        media = box(page.get("/MediaBox"), doc)
        yield k, *(ref or (None, None)), media, box(page.get("/CropBox"), doc) or media, o.integer(doc.resolve(page.get("/Rotate"))) or 0, contents(page, doc)


def _xref_rows(doc: Document) -> Iterator[tuple]:
    for revision, section in enumerate(reversed(doc.sections)):
        for (n, g), e in sorted(section.entries.items()):
            yield revision, n, g, "compressed" if e.container else "plain", e.offset, e.container or None, e.index if e.container else None


def _table(content: DataFrame, ddl: str, rows: Callable[[Document], Iterator[tuple]], mode: str, password: bytes | None) -> DataFrame:
    def make(key: str, data: bytes) -> Iterator[tuple]:
        doc = checked(key, data, mode, password)
        for row in rows(doc) if doc else ():
            yield key, *row

    return rows_of(content, ddl, make)


def documents(content: DataFrame, mode: str = "PERMISSIVE", password: bytes | None = None) -> DataFrame:
    return _table(content, DOCUMENTS, _document_rows, mode, password)


def objects(content: DataFrame, mode: str = "PERMISSIVE", decompress: bool = False, password: bytes | None = None) -> DataFrame:
    """Indirect objects, values as JSON of lexemes; streams as stored, or decoded where that is asked for and possible."""
    return _table(content, OBJECTS, lambda doc: _object_rows(doc, decompress), mode, password)


def nodes(content: DataFrame, mode: str = "PERMISSIVE", password: bytes | None = None) -> DataFrame:
    """Every value of every object, with its place in its parent; node 0 is the object itself. The trailer is object 0."""
    return _table(content, NODES, _node_rows, mode, password)


#: The tables of a parsed document, their columns and their rows.
TABLES = {"documents": (DOCUMENTS, _document_rows), "pages": (PAGES, _page_rows), "objects": (OBJECTS, _object_rows), "nodes": (NODES, _node_rows), "xref": (XREF, _xref_rows)}


def _fields(ddl: str) -> list[list[str]]:
    return [f.strip().rsplit(" ", 1) if "<" not in f else f.strip().split(" ", 1) for f in ddl.split(", ")]


def parsed(content: DataFrame, tables: tuple[str, ...] = tuple(TABLES), mode: str = "PERMISSIVE", password: bytes | None = None) -> DataFrame:
    """(doc_id, and an array of rows for each table): documents read once for several tables.

    Written as Parquet, each table is read from it by table() without the others. A document's rows meet in one row, so very
    large documents are better read table by table."""
    kinds = {name: _fields(TABLES[name][0])[1:] for name in tables}
    schema = pa.schema([("doc_id", pa.string())] + [(name, pa.list_(pa.struct([(n, _TYPES[t]) for n, t in kinds[name]]))) for name in tables])
    ddl = ", ".join(["doc_id string", *[f"{name} array<struct<{', '.join(f'{n}: {t}' for n, t in kinds[name])}>>" for name in tables]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in values(b):
                doc = checked(key, data, mode, password)
                if doc is not None:
                    held = [[dict(zip((n for n, _ in kinds[name]), row, strict=True)) for row in TABLES[name][1](doc)] for name in tables]
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), *[pa.array([rows], schema.field(name).type) for name, rows in zip(tables, held, strict=True)]], schema=schema)

    return content.select(F.col("doc_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, ddl)


def table(found: DataFrame, name: str) -> DataFrame:
    """One of the tables of parsed(), as the function of that name gives it."""
    return found.select("doc_id", F.inline(name))


def edges(found: DataFrame) -> DataFrame:
    """References of a node table: (doc_id, src_objnum, src_gennum, key_path, ord, dst_objnum, dst_gennum)."""
    return found.where("kind = 'ref'").select("doc_id", F.col("objnum").alias("src_objnum"), F.col("gennum").alias("src_gennum"), F.col("key").alias("key_path"), "ord", F.col("ref_objnum").alias("dst_objnum"), F.col("ref_gennum").alias("dst_gennum"))


def box(value: o.Value | None, doc: Document) -> list[float] | None:
    value = doc.resolve(value)
    found = [o.real(doc.resolve(x)) for x in value] if isinstance(value, list) else []
    return found if len(found) == 4 and None not in found else None


def contents(page: dict[str, o.Value], doc: Document) -> bytes:
    """A page's content: its parts decoded and joined by line feeds."""
    held = doc.resolve(page.get("/Contents"))
    parts = [doc.resolve(x) for x in held] if isinstance(held, list) else [held]
    return b"\n".join(decoded(p, doc)[0] for p in parts if isinstance(p, o.Stream))


def pages(content: DataFrame, mode: str = "PERMISSIVE", password: bytes | None = None) -> DataFrame:
    """Pages in order, numbered from 1, with what they inherit; a missing crop box is the media box."""
    return _table(content, PAGES, _page_rows, mode, password)


def search(doc: Document, types: tuple[str | None, ...] = ("/XObject", None), subtypes: tuple[str | None, ...] = ("/Form", "/Image"), no_follow: tuple[str, ...] = ("/Parent",)) -> Iterator[tuple[o.Ref | None, o.Value]]:
    """Dictionaries and streams of given types and subtypes (None: without one), with the reference that led there.

    The search starts at the catalog and reads each object once, whatever loops there are: arrays in order, entries in order
    of their keys, but for those of keys that aren't followed."""
    todo, seen = [doc.trailer.get("/Root")], set()
    while todo:
        value = ref = todo.pop()
        if isinstance(value, o.Ref):
            if value in seen:
                continue
            seen.add(value)
            value = doc.objects.get(tuple(value))
        held = o.entries(value)
        if isinstance(value, dict | o.Stream) and o.name_of(doc.resolve(held.get("/Type"))) in types and o.name_of(doc.resolve(held.get("/Subtype"))) in subtypes:
            yield ref if isinstance(ref, o.Ref) else None, value
        todo += reversed(value) if isinstance(value, list) else [held[k] for k in sorted(held, reverse=True) if k not in no_follow]


FOUND = "doc_id string, ord int, objnum int, gennum int, type string, subtype string, length long"


def found(content: DataFrame, types: tuple[str | None, ...] = ("/XObject", None), subtypes: tuple[str | None, ...] = ("/Form", "/Image"), no_follow: tuple[str, ...] = ("/Parent",), mode: str = "PERMISSIVE", password: bytes | None = None) -> DataFrame:
    """What search() finds in each document, in order; numbers are null for what stands inside another object."""

    def make(key: str, data: bytes) -> Iterator[tuple]:
        doc = checked(key, data, mode, password)
        for k, (ref, value) in enumerate(search(doc, types, subtypes, no_follow)) if doc else ():
            held = o.entries(value)
            yield key, k, *(ref or (None, None)), o.name_of(doc.resolve(held.get("/Type"))), o.name_of(doc.resolve(held.get("/Subtype"))), len(value.data) if isinstance(value, o.Stream) else None

    return rows_of(content, FOUND, make)


def addressed(uris: DataFrame, content: DataFrame, uri: str = "uri", password: bytes | None = None) -> DataFrame:
    """Rows with page addresses beside their pages: adds docname, page, viewrect, rotate and the page's columns.

    Only documents that some address names are read, each once, however many addresses it has. An address without a page means
    the first. One without a document, or whose document or page isn't there, keeps nulls; so does a null one. Columns of `uris`
    must differ from those of the pages and addresses."""
    given = uris.withColumn("_at", geometry.address(F.col(uri))).select("*", "_at.*").drop("_at").withColumn("page", F.coalesce("page", F.lit(1)))
    asked = given.select(F.col("docname").alias("doc_id")).distinct()
    leaves = pages(content.withColumn("doc_id", F.col("doc_id").cast("string")).join(asked, "doc_id", "left_semi"), password=password)
    return given.join(leaves, (F.col("docname") == F.col("doc_id")) & (F.col("page") == F.col("page_no")), "left")


def xref(content: DataFrame, mode: str = "PERMISSIVE", password: bytes | None = None) -> DataFrame:
    """Cross-reference entries of all revisions, numbered from 0 for the oldest."""
    return _table(content, XREF, _xref_rows, mode, password)


def token_table(content: DataFrame, comments: bool = False) -> DataFrame:
    """Tokens of any text in PDF syntax, such as content streams; what can't be read ends the document's rows."""

    def make(key: str, data: bytes) -> Iterator[tuple]:
        lexer = Lexer((data or b"").decode("latin-1"), 0, comments)
        try:
            for k, t in enumerate(lexer):
                yield key, k, t.start, t.end, t.text, t.kind
        except ValueError:
            return

    return rows_of(content, TOKENS, make)


def assemble(pages_: DataFrame, key: str, order: str, text: str, width: float = 612, height: float = 792, compress: bool = False, finish: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """(doc_id, content): one document a key, a page a row in order, its content stream the text's bytes in UTF-8.

    The pages of one document meet in one task, as they do in its file; there `finish` turns the file into what is returned.
    """
    from quire.sources.writer import from_pages

    box_ = [o.number(x) for x in (0, 0, float(width), float(height))]

    def file(rows: list[dict]) -> bytes:
        made = from_pages([{"/MediaBox": box_, "/Contents": o.Stream({}, (r["text"] or "").encode())} for r in rows], compress=compress)
        return finish(made) if finish else made

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(((name, file(rows)) for b in batches for name, rows in values(b)), pa.schema([("doc_id", pa.string()), ("content", pa.binary())]))

    grouped = pages_.groupBy(F.col(key).cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text")))).alias("rows"))
    return grouped.mapInArrow(make, "doc_id string, content binary")
