"""New documents from old ones: pages copied, fragments placed on sheets, stamps, extracted objects.

A plan is a table with a row for each fragment: out_doc, out_page, and the source's doc_id and page_no; then, where given,
z (order of painting), x, y, scale and turn (placement, in points and quarter turns), view (x, y, width, height from the
top left) and whole (the page itself is copied, not placed). The pages of one new document meet in one task with the files
they come from, each of which is sent there once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import NUMBERS, Box, turn_box, turn_point, view_box
from quire.operators.layout import DIGITS, PLACING
from quire.sources import objects as o
from quire.sources import pdf
from quire.sources.parser import INHERITED, Document, decoded, parse
from quire.sources.shared import file_system
from quire.sources.writer import VERSION, from_pages, scalar, serialize

PLAN = {"z": "int", "x": "double", "y": "double", "scale": "double", "turn": "int", "view": "array<double>", "whole": "boolean"}
FRAGMENT = "/Fragment"


class Form:
    """A page, or what a view shows of it, as a reusable fragment, with its box as it is seen."""

    def __init__(self, page: dict[str, o.Value], doc: Document, view: list[float] | None = None, turns: int = 0):
        media = pdf.box(page.get("/MediaBox"), doc) or [0.0, 0.0, 612.0, 792.0]
        page_turns = (o.integer(doc.resolve(page.get("/Rotate"))) or 0) // 90
        box = Box(*(pdf.box(page.get("/CropBox"), doc) or media))
        self.box = view_box(box, None, tuple(view), page_turns, NUMBERS) if view else box
        turns += page_turns
        self.seen = turn_box(self.box, turns, NUMBERS)
        held: dict[str, o.Value] = {"/Type": o.name("XObject"), "/Subtype": o.name("Form"), "/FormType": o.number(1), "/BBox": [o.number(v) for v in self.box]}
        if turns % 4:
            held["/Matrix"] = [o.number(v) for v in (*turn_point(1.0, 0.0, turns), *turn_point(0.0, 1.0, turns), 0.0, 0.0)]
        if "/Resources" in page:
            held["/Resources"] = page["/Resources"]
        self.stream = o.Stream(held, pdf.contents(page, doc))

    def size(self) -> tuple[float, float]:
        return self.seen[2] - self.seen[0], self.seen[3] - self.seen[1]


def sheet(base: dict[str, o.Value] | None, base_doc: Document | None, items: list[tuple[int, str, Form, float, float, float]]) -> dict[str, o.Value]:
    """A page with fragments (z, name, form, x, y, scale): below and above the base page, or on a sheet as large as they need."""
    forms: dict[str, o.Value] = {}
    below, above, edges = [], [], [0.0, 0.0]
    resources = dict(o.entries(base_doc.resolve(base.get("/Resources")))) if base is not None else {}
    taken = dict(o.entries(base_doc.resolve(resources.get("/XObject")))) if base is not None else {}
    used = [int(k[len(FRAGMENT) :]) for k in taken if k.startswith(FRAGMENT) and k[len(FRAGMENT) :].isdigit()]
    first = max(used, default=-1) + 1
    for n, (z, _, form, x, y, scale) in enumerate(sorted(items, key=lambda i: i[0]), first):
        forms[f"{FRAGMENT}{n}"] = form.stream
        dx, dy = x - form.seen[0] * scale, y - form.seen[1] * scale
        numbers = " ".join(o.number(float(v)).text for v in (scale, 0, 0, scale, dx, dy))
        (below if z < 0 else above).append(f"q {numbers} cm {FRAGMENT}{n} Do Q")
        wide, high = form.size()
        edges = [max(edges[0], x + wide * scale), max(edges[1], y + high * scale)]
    page = dict(base) if base is not None else {"/Type": o.name("Page"), "/MediaBox": [o.number(v) for v in (0.0, 0.0, *edges)]}
    page["/Resources"] = resources | {"/XObject": taken | forms}
    parts: list[bytes] = ["\n".join(below).encode()] if below else []
    if base is not None:
        own = pdf.contents(base, base_doc)
        parts.append(b"q\n" + own + b"\nQ" if above else own)
    parts += ["\n".join(above).encode()] if above else []
    page["/Contents"] = o.Stream({}, b"\n".join(parts))
    return page


class Sources:
    """Parsed source files, whose objects are numbered apart from each other."""

    def __init__(self, files: dict[str, bytes], password: bytes | None = None):
        self.docs = {k: parse(v, password) for k, v in sorted(files.items())}
        self.objects: dict[tuple[int, int], o.Value] = {}
        shift = 0
        for doc in self.docs.values():
            top = max((n for n, _ in doc.objects), default=0) + 1
            self._moved(doc, shift)
            shift += top
            self.objects |= doc.objects

    @staticmethod
    def _moved(doc: Document, by: int) -> None:
        def move(v: o.Value) -> o.Value:
            if isinstance(v, o.Ref):
                return o.Ref(v.objnum + by, v.gennum)
            if isinstance(v, list):
                return [move(x) for x in v]
            if isinstance(v, o.Stream):
                return o.Stream(move(v.entries), v.data)
            return {k: move(x) for k, x in v.items()} if isinstance(v, dict) else v

        doc.objects = {(n + by, g): move(v) for (n, g), v in doc.objects.items()}
        doc.trailer = move(doc.trailer)
        doc.pages = [((ref[0] + by, ref[1]) if ref else None, move(page)) for ref, page in doc.pages]

    def page(self, key: str, number: int) -> tuple[dict[str, o.Value], Document] | None:
        doc = self.docs.get(key)
        return (doc.pages[number - 1][1], doc) if doc and 1 <= number <= len(doc.pages) else None


def build(rows: list[dict], files: dict[str, bytes], compress: bool, version: str, info: dict[str, str] | None, password: bytes | None) -> bytes:
    sources, made, forms = Sources(files, password), [], {}
    for _, group in groupby(sorted(rows, key=lambda r: r["out_page"]), key=lambda r: r["out_page"]):
        base, items = (None, None), []
        for r in group:
            found = sources.page(r["doc_id"], r["page_no"])
            if found is None:
                continue
            if r["whole"]:
                page = dict(found[0])
                if r["turn"]:
                    page["/Rotate"] = o.number(((o.integer(found[1].resolve(page.get("/Rotate"))) or 0) + 90 * r["turn"]) % 360)
                base = (page, found[1])
                continue
            view = tuple(r["view"]) if r["view"] else None
            key = (r["doc_id"], r["page_no"], view, r["turn"] or 0)
            if key not in forms:  # a fragment placed again is stored once
                forms[key] = Form(*found, list(view) if view else None, r["turn"] or 0)
            items.append((1 if r["z"] is None else r["z"], "", forms[key], r["x"] or 0.0, r["y"] or 0.0, r["scale"] or 1.0))
        if items:
            made.append(sheet(*base, items))
        elif base[0] is not None:
            made.append({k: v for k, v in base[0].items() if k in INHERITED or k not in ("/Parent",)})
    return from_pages(made, sources.objects, info, version, compress)


def compose(content: DataFrame, plan: DataFrame, compress: bool = False, version: str = VERSION, info: dict[str, str] | None = None, password: bytes | None = None) -> DataFrame:
    """(doc_id, content) of the documents that a plan describes; rows whose source page isn't there add nothing.

    Each source is parsed once for each document that takes pages from it. The sources of one new document meet in one
    task, as their pages do in its file, so what it takes from must fit there."""
    for name, kind in PLAN.items():
        if name not in plan.columns:
            plan = plan.withColumn(name, F.lit(None).cast(kind) if name != "whole" else F.lit(False))
    fields = ["out_page", "page_no", *PLAN]
    typed = [F.col("out_page").cast("int"), F.col("page_no").cast("int"), *[F.col(c).cast(k) for c, k in PLAN.items()]]
    rows = plan.select(F.col("out_doc").cast("string"), F.col("doc_id").cast("string"), F.struct(*[t.alias(n) for t, n in zip(typed, fields, strict=True)]).alias("row"))
    per_file = rows.groupBy("out_doc", "doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    met = per_file.join(content.select(F.col("doc_id").cast("string"), "content"), "doc_id")
    per_doc = met.groupBy("out_doc").agg(F.array_sort(F.collect_list(F.struct("doc_id", "rows", "content"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                every = [r | {"doc_id": p["doc_id"]} for p in parts for r in p["rows"]]
                data = build(every, {p["doc_id"]: p["content"] for p in parts}, compress, version, info, password)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([data], pa.binary())], names=["doc_id", "content"])

    return per_doc.mapInArrow(run, "doc_id string, content binary")


def rewrite(
    content: DataFrame, compress: bool | Callable[[o.Stream], bool] = False, decompress: bool = False, info: dict[str, str] | None = None, version: str | None = None,
    user_format: Callable[[object], o.Value] = scalar, canonical: bool = False, password: bytes | None = None,
) -> DataFrame:
    """Each document written anew with its structure: streams deflated (all, or those that `compress` picks) or inflated, entries
    of its information changed, values written as `user_format` says, in canonical form where asked for; encrypted ones in
    the clear with a password. A document that can't be read has null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(1).to_pylist():
                doc = parse(data, password)
                if doc.status == "failed":
                    out.append(None)
                    continue
                if decompress:
                    for v in doc.objects.values():
                        if isinstance(v, o.Stream) and "/Filter" in v.entries:
                            v.data, done = decoded(v, doc)
                            if done:
                                v.entries.pop("/Filter")
                                v.entries.pop("/DecodeParms", None)
                trailer = dict(doc.trailer)
                if doc.status == "decrypted":
                    trailer.pop("/Encrypt", None)
                if info:
                    trailer["/Info"] = o.entries(doc.resolve(trailer.get("/Info"))) | info
                out.append(serialize(trailer, doc.objects, version or doc.version, compress, canonical=canonical, user_format=user_format))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return content.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, content binary")


def trivial(stream: o.Stream, most: int = 300) -> bool:
    """Whether a form only places others; the same rule as operators.layout.trivial. An image never is."""
    if o.name_of(stream.entries.get("/Subtype")) != "/Form" or len(stream.data) >= most:
        return False
    return all(w in PLACING or w[:1] == "/" or re.fullmatch(DIGITS, w) for w in stream.data.decode("latin-1").split())


def shown(stream: o.Stream, doc: Document, width: float = 612, margin: float = 36) -> dict[str, o.Value] | None:
    """A page that shows a form at its size, or an image within margins; None where its size isn't known."""
    resources: dict[str, o.Value] = {"/XObject": {FRAGMENT + "0": stream}}
    if o.name_of(doc.resolve(stream.entries.get("/Subtype"))) == "/Form":
        box = pdf.box(stream.entries.get("/BBox"), doc)
        return box and {"/MediaBox": [o.number(v) for v in box], "/Resources": resources, "/Contents": o.Stream({}, f"{FRAGMENT}0 Do".encode())}
    w, h = (o.real(doc.resolve(stream.entries.get(k))) for k in ("/Width", "/Height"))
    if not w or not h:
        return None
    wide = width - 2 * margin
    high = wide * h / w
    numbers = " ".join(o.number(float(v)).text for v in (wide, 0, 0, high, margin, margin))
    return {"/MediaBox": [o.number(float(v)) for v in (0, 0, width, high + 2 * margin)], "/Resources": resources, "/Contents": o.Stream({}, f"q {numbers} cm {FRAGMENT}0 Do Q".encode())}


def fragments(
    content: DataFrame, margin: float = 36, width: float = 612, ignore_below: int = 300, types: tuple[str | None, ...] = ("/XObject", None), subtypes: tuple[str | None, ...] = ("/Form", "/Image"),
    no_follow: tuple[str, ...] = ("/Parent",), image_only: bool = False, ignore: Callable[[o.Stream], bool] | None = None, wrap: Callable[[o.Stream, Document], dict[str, o.Value] | None] | None = None, password: bytes | None = None,
) -> DataFrame:
    """(doc_id, content): for each document with forms or images one with a page for each of them, trivial forms left out.

    Objects are found by pdf.search(), which the types, subtypes and keys not followed are for. `ignore` says what is left out
    (by default trivial forms of fewer bytes than `ignore_below`), `wrap` makes the page for an object (by default a form at its
    size, an image within margins). Documents without any, and those that can't be read, have no row.
    """
    left_out = ignore or (lambda stream: trivial(stream, ignore_below))
    page_of = wrap or (lambda stream, doc: shown(stream, doc, width, margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = parse(data, password)
                met = [v for _, v in pdf.search(doc, types, ("/Image",) if image_only else subtypes, no_follow) if isinstance(v, o.Stream)]
                made = [p for s in met if not left_out(s) and (p := page_of(s, doc))]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([from_pages(made, doc.objects)], pa.binary())], names=["doc_id", "content"])

    return content.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, content binary")


def save(content: DataFrame, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Writes each document to a file of a folder that all tasks reach, named by a digest of its id; (doc_id, path, n_bytes).

    A file appears under its name only when it is whole, and a task that runs again writes the same file; of equal ids one
    document remains. Null content is an empty file. For folders in stores that only Spark reaches this is a ValueError.
    """
    file_system(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            names = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = hashlib.sha256(str(key).encode()).hexdigest()[:32] + suffix
                part = f"{root}/.{name}.{attempt}"
                with system.open_output_stream(part) as out:
                    out.write(data or b"")
                system.move(part, f"{root}/{name}")
                names.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array([len(d or b"") for d in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "path", "n_bytes"])

    return content.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, "doc_id string, path string, n_bytes long")
