"""Operator 1: WARC archives, written and read back with verified record boundaries.

Reading cuts archives at the magic line wherever it occurs, also inside payloads, so every piece is
only a candidate record. Tasks emit each candidate's offset and the offset its header says the next
record has. From offset 0 of a file these pointers form a chain: within a block of the file a task
follows them itself, which leaves one pointer per candidate out of its block, and pointer jumping
(``p <- p after p``, in as many rounds as the logarithm of the blocks of the longest file) finds where
the chain enters each block. Only candidates on the chain are records; all others are payload, and
are put back into the record that holds them.

Archives are written and read by Spark's text source with the record separator as line end, so any
file system Spark knows will do, and files are split. Payload bytes stay in the first pass unless a
record is cut up.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultfold.session import settle, work_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC, _END = MAGIC.encode(), END.encode()
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Words of 64 bits that tell pages which are no revisits; a bound for what is broadcast, about 5 MB.
MARK_WORDS = 1 << 17


def base32_sha1(payload: Column) -> Column:
    """The bare base32 digest: 20 bits at a time through a number in base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, target): the rows whose payload a page with a larger page_id has too.

    Works on ids and digests only; groups are reduced before they are joined.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = settle(pages.where(F.octet_length(payload) >= least_bytes).select(
        F.col("page_id").cast("long").alias("page_id"), base32_sha1(payload).alias("digest")
    ))
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    again = narrow.join(shared.where("n > 1 and target is not null"), "digest")
    return again.where("page_id is null or page_id < target").select("page_id", "digest", "target").distinct()


def records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): one record per row of ``pages`` (page_id, url, html), without its closing line ends."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace("url", r"[\r\n]+", "%0D%0A").alias("url"),
        payload.alias("payload"),
        base32_sha1(payload.cast("binary")).alias("digest"),
    )
    old = settle(revisits(pages, least_bytes)).select(
        F.col("page_id").alias("old_id"), F.col("digest").alias("old_digest"), "target"
    )
    # Whoever has no mark is no revisit, so that most payloads are not shuffled; the rest is looked up.
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(64 * MARK_WORDS))
    bit = place("old_id", "old_digest")
    marks = old.select(F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int").alias("bit"))
    marks = marks.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    rows = rows.withColumn("place", place("page_id", "digest")).withColumn("word", F.shiftright("place", 6))
    rows = rows.join(F.broadcast(marks), "word", "left")
    marked = F.coalesce(F.getbit("bits", (F.col("place") % 64).cast("int")) == 1, F.lit(False))
    rows = rows.withColumn("marked", marked).drop("word", "place", "bits")
    found = rows.where("marked").join(
        old, F.col("page_id").eqNullSafe(F.col("old_id")) & (F.col("digest") == F.col("old_digest")), "left"
    )
    none = rows.where("not marked").withColumn("target", F.lit(None).cast("long"))
    rows = found.select("page_id", "url", "payload", "digest", "target").union(
        none.select("page_id", "url", "payload", "digest", "target")
    )
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
    )
    again = F.col("target").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.concat(http, "payload"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<urn:x-page:"), F.col("target").cast("string"), F.lit(">"))),
    )
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), name, F.lit(">"))),
            line("WARC-Date", F.lit(date)),
            F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(again, refers).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
        ).alias("value")
    )


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, compression: str = "none", per_file: int = 0) -> None:
    """Write archives to ``folder``: a file per task, or more with ``per_file`` records each.

    With ``compression="gzip"`` whole files are compressed: smaller, but read without splitting.
    """
    writer = records(pages, least_bytes).write.option("lineSep", END).option("compression", compression)
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).text(folder)


def _page_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def parse_record(piece: bytes) -> tuple[int, dict] | None:
    """(bytes from the magic to the next record, header fields); None where there is no header."""
    stop = piece.find(_END)
    if stop < 0:
        return None
    fields = {}
    for line in piece[:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields:
        return None
    fields["begin"] = stop + 4
    return len(_MAGIC) + stop + 4 + int(length) + 4, fields


def contents(piece: bytes, fields: dict) -> tuple:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, digest_ok) of a whole record."""
    block = memoryview(piece)[fields["begin"] : len(piece) - 4]
    told = fields.get("warc-payload-digest", "").rpartition(":")[2]
    page, kind = _page_of(fields.get("warc-record-id")), fields["warc-type"]
    if kind == "revisit":
        return page, kind, None, told, _page_of(fields.get("warc-refers-to")), None
    head = piece.find(_END, fields["begin"]) if fields.get("content-type", "").startswith("application/http") else -1
    payload = block[head + 4 - fields["begin"] :] if head >= 0 else block
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return page, kind, len(payload), own, None, own == told


_FIELDS = [
    ("page_id", pa.int64()),
    ("record_type", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("refers_to", pa.int64()),
    ("digest_ok", pa.bool_()),
]
_FIELDS_DDL = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean"
_PIECE = pa.schema(
    [("file", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("span", pa.int64()), ("whole", pa.bool_()), *_FIELDS, ("raw", pa.binary())]
)
_PIECE_DDL = f"file long, block long, n long, rel long, size long, span long, whole boolean, {_FIELDS_DDL}, raw binary"


def pieces(spark: SparkSession, folder: str, keep_all: bool = False) -> DataFrame:
    """One row per piece between magic lines, in the order of the file.

    ``span`` (null without a header) leads from the magic to the next record; a ``whole`` piece ends
    just there, and its contents are read at once. ``raw`` has the bytes of pieces that are not
    whole or that an open record in front may hold; with ``keep_all``, of all pieces.
    """
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(folder)
    lines = lines.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, rel, open_until = None, 0, 0, 0
        for part in parts:
            out = []
            for file, block, value in zip(*(part.column(i) for i in range(3)), strict=True):
                here, value = (file.as_py(), block.as_py()), value.as_py() or b""
                if here != at:
                    at, n, rel, open_until = here, 0, 0, 0
                # What stands before the first magic of a file is no candidate.
                front = here[1] == 0 and n == 0
                size = len(value) + (0 if front else len(_MAGIC))
                found = None if front else parse_record(value)
                span = found[0] if found else None
                whole = found is not None and span == size and value.endswith(_END)
                told = contents(value, found[1]) if whole else (None,) * len(_FIELDS)
                raw = value if keep_all or not (whole or front) or rel < open_until else None
                out.append((*here, n, rel, size, span, whole, *told, raw))
                if span:
                    open_until = max(open_until, rel + span)
                n, rel = n + 1, rel + size
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECE, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_PIECE)

    return lines.mapInArrow(run, _PIECE_DDL)


def _exits(table: pa.Table) -> pa.Table:
    """Of every candidate of a block, the offset at which its chain leaves the block."""
    table = table.filter(table.column("span").is_valid()).sort_by("off")
    off, span = table.column("off").to_pylist(), table.column("span").to_pylist()
    end = table.column("end")[0].as_py() if off else 0
    leaves: dict[int, int] = {}
    for a, s in zip(reversed(off), reversed(span), strict=True):
        leaves[a] = a + s if a + s >= end else leaves.get(a + s, -1)
    return pa.table({"file": table.column("file"), "off": table.column("off"), "nxt": pa.array([leaves[a] for a in off], pa.int64())})


def _owners(table: pa.Table) -> pa.Table:
    """Follow the chain from the block's entry; ``owner`` is the record a piece belongs to."""
    table = table.sort_by("off")
    off, span = table.column("off").to_pylist(), table.column("span").to_pylist()
    due = table.column("entry")[0].as_py() if off else None
    owner, current = [], None
    for a, s in zip(off, span, strict=True):
        if a == due and s is not None:
            current, due = a, a + s
        owner.append(current)
    return table.drop_columns(["entry", "end"]).append_column("owner", pa.array(owner, pa.int64()))


def _entries(spark: SparkSession, exits: DataFrame, blocks: int) -> DataFrame:
    """(file, off): where the chain from offset 0 enters a block, by pointer jumping."""
    jumps = exits.where("nxt >= 0")
    reached = exits.where("off = 0").select("file", "off")
    for _ in range(math.ceil(math.log2(blocks)) if blocks > 1 else 0):
        onward = reached.join(jumps, ["file", "off"]).select("file", F.col("nxt").alias("off"))
        reached = settle(reached.union(onward).distinct())
        second = jumps.select("file", F.col("off").alias("nxt"), F.col("nxt").alias("far"))
        jumps = settle(jumps.join(second, ["file", "nxt"]).select("file", "off", F.col("far").alias("nxt")))
    return reached


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below ``folder``.

    Columns: page_id, record_type, payload_bytes, payload_digest, refers_to, digest_ok (the payload
    has the digest its header states; null for revisits). A revisit has the size of the response it
    refers to, or none where that is missing.

    A file that does not begin with a record has none; a chain that leads nowhere ends there, and
    what follows in the file is not read as records.
    """
    kept = work_dir(spark, "warc-pieces")
    pieces(spark, folder).write.parquet(kept)
    found = spark.read.parquet(kept)
    sizes = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    in_file = Window.partitionBy("file").orderBy("block")
    bases = sizes.select(
        "file", "block", (F.sum("bytes").over(in_file) - F.col("bytes")).alias("base"), F.sum("bytes").over(in_file).alias("end")
    )
    blocks = sizes.groupBy("file").count().agg(F.max("count").alias("n")).first()["n"] or 1
    placed = found.join(bases, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel")).drop("base", "rel")
    exits = placed.where("span is not null").select("file", "block", "off", "span", "end")
    exits = exits.groupBy("file", "block").applyInArrow(_exits, "file long, off long, nxt long")
    entries = _entries(spark, exits, blocks).join(placed.select("file", "block", "off"), ["file", "off"])
    entries = entries.groupBy("file", "block").agg(F.min("off").alias("entry"))
    ddl = f"file long, block long, n long, size long, span long, whole boolean, {_FIELDS_DDL}, raw binary, off long, owner long"
    columns = [*(c.split()[0] for c in ddl.split(", ") if c != "owner long"), "end", "entry"]
    owned = placed.join(entries, ["file", "block"], "left").select(*columns)
    owned = settle(owned.groupBy("file", "block").applyInArrow(_owners, ddl))
    names = [n for n, _ in _FIELDS]
    whole = owned.where("off = owner and whole").select(*names)

    # Pieces in front of a block's entry belong to the last record of an earlier block.
    last = owned.where("owner is not null").groupBy("file", "block").agg(F.max("owner").alias("off"))
    stray = owned.where("owner is null").select("file", "block", "n", "size", "raw", "off", F.lit(None).cast("long").alias("owner"))
    marks = last.select("file", "block", F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("raw"), "off", F.col("off").alias("owner"))
    before = Window.partitionBy("file").orderBy("off", F.col("owner").isNull())
    stray = stray.union(marks).withColumn("owner", F.last("owner", ignorenulls=True).over(before))
    stray = stray.where("n is not null and owner is not null")
    cut = owned.where("off = owner and not whole").select("file", F.col("off").alias("owner"), "span")
    parts = owned.where("owner is not null").select(*stray.columns).union(stray)
    parts = settle(parts.join(cut, ["file", "owner"]).where("off < owner + span"))
    lacking = parts.where("raw is null and size > 0").select("file", "block", "n")
    if not lacking.isEmpty():
        again = pieces(spark, folder, keep_all=True).join(lacking, ["file", "block", "n"], "left_semi")
        again = again.select("file", "block", "n", F.col("raw").alias("more"))
        parts = parts.join(again, ["file", "block", "n"], "left").withColumn("raw", F.coalesce("raw", "more")).drop("more")
    # One record, of at most the size of a row, is put together at a time.
    pile = F.array_sort(F.collect_list(F.struct("off", "raw")))
    joined = F.aggregate(pile, F.lit(b""), lambda made, p: F.concat(made, F.lit(_MAGIC), p["raw"]))
    spread = parts.groupBy("file", "owner").agg(joined.alias("value"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("value"):
                value = value.as_py()[len(_MAGIC) :]
                span, fields = parse_record(value)
                if len(value) + len(_MAGIC) >= span:
                    out.append(contents(value[: span - len(_MAGIC)], fields))
            columns = [pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays(columns, names)

    read = whole.union(spread.select("value").mapInArrow(assemble, _FIELDS_DDL))
    response = read.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("referred")
    ).distinct()
    return (
        read.join(response, ["refers_to", "payload_digest"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "referred"))
        .select(*names)
    )


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, compression: str = "none", per_file: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into the shared folder and read them back.

    Of pages with equal payloads of at least ``least_bytes``, the one with the largest page_id is a
    response and the others revisit it.

    Cases: a null html is an empty payload; a null url leaves its header out; a null page_id counts
    as smaller than all others, and a group of such pages only are responses; rows that repeat a
    page_id and payload are of one type; an empty table gives no rows; other columns are left out.
    """
    folder = work_dir(pages.sparkSession, "warc")
    write_warc(pages, folder, least_bytes, compression, per_file)
    return read_warc(pages.sparkSession, folder)
