"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing: a record is a line of which the separator is CR LF CR LF, so files are plain WARC, and the output committer
makes lost tasks harmless. Pages with equal payloads have one response, with the largest page_id; the others revisit it.

Reading: the text reader splits files at CR LF "WARC/1.", which every record but a file's first follows. No start of this
mark is an end of it, so its places do not depend on where reading starts, nor on the line breaks that end a payload: any
record's start begins a chunk, in whichever split. A task emits each chunk that opens with a record's header as a candidate, with its offset in the split and that of its
successor, and follows successors as far as the split goes. Offsets in the file follow from the sums of the splits
before. From each file's start, pointer jumping over the exits of splits finds where the chain enters each split; what
the chain does not reach is magic inside a payload and is dropped. Records that run over the end of a split are read
again from the splits that they touch; there is at most one for each split.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import shared_path, written

SEP = "\r\n\r\n"
#: What all records start with, and the mark between chunks.
MAGIC = "WARC/1."
MARK = "\r\n" + MAGIC
#: Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BROADCAST_ROWS = 200_000


def base32(digest: Column) -> Column:
    """Base 32 of a SHA-1 in hexadecimal digits: each five digits are four letters."""
    five = lambda i: F.conv(F.substr(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda i: F.substr(F.lit(BASE32), F.pmod(F.floor(five(i) / F.pow(F.lit(32), 3 - i % 4)), F.lit(32)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def written_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes a record for each page to files under path, and returns the table of repeated payloads (digest, top).

    Null html: empty. A page without page_id is larger than none: it revisits a response with an id. Line breaks in urls
    are escaped. An empty table writes no record."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("hex"))
    same = written(rows.groupBy("hex").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1").select("hex", "top"), "same")
    rows = rows.join(F.broadcast(same) if same.count() <= BROADCAST_ROWS else same, "hex", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("top")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("hex"))), F.concat(F.lit("WARC-Payload-Length: "), F.octet_length("html").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.octet_length("html")).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *head), F.lit(SEP), F.when(revisit, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", SEP).text(path)
    return same


FIELDS = "page_id long, url string, type string, refers_to long, digest string, length long"
CANDIDATE = f"file string, split long, off long, next long, leaves long, whole boolean, {FIELDS}, own_digest string, own_bytes long, payload binary"


def number(name: str) -> int | None:
    """Of a record id the page."""
    rest = name.removeprefix("<urn:page:").removesuffix(">")
    return int(rest) if rest.lstrip("-").isdigit() else None


def header(text: bytes) -> dict | None:
    """The fields of a record's header from after the magic to before the empty line; None if it is none."""
    got = {}
    for line in text.split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        got[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not got.get("content-length", "").isdigit() or "warc-type" not in got:
        return None
    return {"size": int(got["content-length"]), "page_id": number(got.get("warc-record-id", "")), "url": got.get("warc-target-uri", ""), "type": got["warc-type"], "refers_to": number(got.get("warc-refers-to", "")), "digest": got.get("warc-payload-digest", "").removeprefix("sha1:"), "length": int(got["warc-payload-length"]) if got.get("warc-payload-length", "").isdigit() else None}


def chunks(batches):
    """(file, split, offset of the magic in the split, bytes from after the magic to the next mark), in order."""
    key, off, magic = None, 0, len(MAGIC)
    for b in batches:
        for value, file, start in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            chunk = value.as_buffer().to_pybytes()
            if (file, start) != key:
                key, off = (file, start), 0
                if start == 0:  # no mark is before a file's first chunk
                    if not chunk.startswith(MAGIC.encode()):
                        off = len(chunk) + 2
                        continue
                    chunk = chunk[magic:]
            yield file, start, off, chunk
            off += magic + len(chunk) + 2


def head_end(chunk: bytes) -> int:
    """Where the empty line after a chunk's header starts, or -1; its second line break may be the next mark's."""
    at = chunk.find(SEP.encode())
    return len(chunk) - 2 if at < 0 and chunk.endswith(b"\r\n") else at


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def scanned(spark, path: str) -> DataFrame:
    return spark.read.option("lineSep", MARK).text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def candidates(spark, path: str, payloads: bool) -> DataFrame:
    """Candidates of all splits; a row with a null next ends each split, of which off is the size."""

    def run(batches):
        rows: list[dict] = []
        key, end = None, 0
        open_: list[list] = []  # candidates whose payload is not complete: row, its bytes, bytes held, parts between marks

        def close(one, whole):
            row, n, _, parts = one
            data = MARK.encode().join(parts)[len(SEP) :][:n] if whole else b""
            row["whole"] = whole
            row["own_digest"] = digest_of(data) if whole else None
            row["own_bytes"] = len(data) if whole else None
            row["payload"] = data if payloads and whole else None

        def flush():
            for one in open_:
                close(one, False)
            leaves = {}
            for r in reversed(rows):
                leaves[r["off"]] = r["leaves"] = leaves.get(r["next"], r["next"])
            out = [*rows, {"file": key[0], "split": key[1], "off": end}]
            rows.clear()
            open_.clear()
            return pa.RecordBatch.from_pylist(out, schema=SCHEMA)

        for file, split, off, chunk in chunks(batches):
            if key and key != (file, split):
                yield flush()
            key, end = (file, split), off + len(MARK) + len(chunk)
            for one in open_:
                one[2] += len(MARK) + len(chunk)
                one[3].append(chunk)
            at = head_end(chunk)
            if at >= 0 and (h := header(chunk[:at])) is not None:
                n = h.pop("size")
                row = h | {"file": file, "split": split, "off": off, "next": off + len(MAGIC) + at + len(SEP) + n + len(SEP)}
                rows.append(row)
                open_.append([row, n, len(chunk) - at - len(SEP), [chunk[at:]]])
            for one in open_:
                if one[1] <= max(one[2], 0):
                    close(one, True)
            open_ = [one for one in open_ if one[1] > max(one[2], 0)]
        if key:
            yield flush()

    return scanned(spark, path).mapInArrow(run, CANDIDATE)


SCHEMA = pa.schema([("file", pa.string()), ("split", pa.int64()), ("off", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()), ("whole", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("own_digest", pa.string()), ("own_bytes", pa.int64()), ("payload", pa.binary())])


def chain(found: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches, with base, the offset of their split in the file."""
    ends = found.where("next is null").select("file", "split", F.col("off").alias("size"))
    base = written(ends.withColumn("base", F.sum("size").over(Window.partitionBy("file").orderBy("split")) - F.col("size")), "splits")
    rows = found.where("next is not null").join(F.broadcast(base) if base.count() <= BROADCAST_ROWS else base, ["file", "split"])
    # pointer jumping: a candidate's exit from its split is a place in a later split; distances double
    jump = written(rows.select("file", (F.col("base") + F.col("off")).alias("at"), (F.col("base") + F.col("leaves")).alias("to")), "jumps")
    entry = written(base.groupBy("file").agg(F.lit(0).cast("long").alias("at")), "entries")
    before, leap = entry.count(), jump
    while True:
        entry = written(entry.union(entry.join(leap, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "entries")
        if (now := entry.count()) == before:
            break
        before = now
        leap = written(leap.select("file", "at", F.col("to").alias("mid")).join(leap.select("file", F.col("at").alias("mid"), "to"), ["file", "mid"]).select("file", "at", "to"), "jumps")
    # within a split: what its entry's chain reaches
    inside = base.select("file", "split", "base", "size").join(entry, "file").where("at >= base and at < base + size").groupBy("file", "split").agg(F.collect_set(F.col("at") - F.col("base")).alias("enter"))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        after = dict(zip(left["off"].to_pylist(), left["next"].to_pylist()))
        good = set()
        for at in (right["enter"].to_pylist() or [[]])[0]:
            while at in after and at not in good:
                good.add(at)
                at = after[at]
        return left.filter(pa.array([o in good for o in left["off"].to_pylist()], pa.bool_()))

    slim = rows.select("file", "split", "off", "next")
    real = slim.groupBy("file", "split").cogroup(inside.groupBy("file", "split")).applyInArrow(walk, "file string, split long, off long, next long").select("file", "split", "off")
    return rows.join(real, ["file", "split", "off"])


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path: page_id, url, type, refers_to, digest and length as in the header, own_digest and
    own_bytes (of the bytes read), intact and, if asked for, payload. Payloads may hold record separators and whole records.

    intact: the bytes read have the header's digest and length, or it is a revisit, of which the payload is elsewhere. A
    record that its file's end cuts short is returned with what is there, and is not intact; what follows a place at
    which no record starts is not reached: lost_bytes() counts it. No file: no record."""
    found = written(candidates(spark, path, payloads), "candidates")
    good = written(chain(found).select("file", "split", "base", "off", "next", "whole", *(f.split()[0] for f in FIELDS.split(", ")), "own_digest", "own_bytes", "payload"), "records")
    right = (F.col("type") == "revisit") | (F.col("own_digest").eqNullSafe(F.col("digest")) & F.col("own_bytes").eqNullSafe(F.col("length")))
    done = good.where("whole").drop("file", "split", "base", "off", "next", "whole").withColumn("intact", right)
    over = good.where("not whole").select("file", "base", "off", "next", "page_id").withColumn("start", F.col("base") + F.col("off")).withColumn("stop", F.col("base") + F.col("next"))
    if over.isEmpty():
        return done
    # records over the end of a split: one for each split at most, with the splits that they touch
    bases = found.where("next is null").select("file", "split", F.col("off").alias("size")).withColumn("base", F.sum("size").over(Window.partitionBy("file").orderBy("split")) - F.col("size"))
    touch = bases.join(over.select("file", "start", "stop"), "file").where("base < stop and base + size > start").groupBy("file", "split").agg(F.first("base").alias("base"), F.collect_list(F.struct("start", "stop")).alias("spans"))
    want = {(r.file, r.split): (r.base, [tuple(s) for s in r.spans]) for r in touch.collect()}  # places of splits, as Spark's driver holds them too
    sent = spark.sparkContext.broadcast(want)

    def pieces(batches):
        want = sent.value
        for file, split, off, chunk in chunks(batches):
            base, spans = want.get((file, split), (0, ()))
            at = base + off
            out = [{"file": file, "start": s, "stop": e, "at": at, "chunk": chunk} for s, e in spans if s <= at < e]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("at", pa.int64()), ("chunk", pa.binary())]))

    def join(t: pa.Table) -> pa.Table:
        parts = [c for _, c in sorted(zip(t["at"].to_pylist(), t["chunk"].to_pylist()))]
        data, at = MARK.encode().join(parts), head_end(parts[0]) + len(SEP)
        data = data[at : t["stop"][0].as_py() - t["start"][0].as_py() - len(MAGIC) - len(SEP)]
        return pa.table({"file": t["file"][:1], "start": t["start"][:1], "bytes": pa.array([data], pa.binary()), "found": [digest_of(data)]})  # one record

    rebuilt = scanned(spark, path).mapInArrow(pieces, "file string, start long, stop long, at long, chunk binary").groupBy("file", "start").applyInArrow(join, "file string, start long, bytes binary, found string")
    late = good.where("not whole").withColumn("start", F.col("base") + F.col("off")).drop("own_digest", "own_bytes", "payload").join(rebuilt, ["file", "start"])
    late = late.withColumns({"own_digest": F.col("found"), "own_bytes": F.octet_length("bytes").cast("long"), "payload": F.col("bytes") if payloads else F.lit(None).cast("binary")})
    return done.unionByName(late.withColumn("intact", right).select(*done.columns))


def lost_bytes(spark, path: str) -> DataFrame:
    """file, size, and lost: the bytes after the last record that the chain from the file's start reaches; 0 in whole archives."""
    found = written(candidates(spark, path, False), "candidates")
    sizes = spark.read.option("lineSep", MARK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    ends = chain(found).groupBy("file").agg(F.max(F.col("base") + F.col("next")).alias("end"))
    lost = F.greatest(F.lit(0), F.col("size") - F.coalesce("end", F.lit(0)))
    return sizes.join(ends, "file", "left").select("file", "size", lost.cast("long").alias("lost"))


def query(pages: DataFrame) -> DataFrame:
    """op7: one row for each page, from the archives: payloads of responses are counted and digested anew as read.

    Null and repeated page_ids have a record each; equal payloads of one page_id are all responses if it is the largest."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    written_archives(pages, path)
    rows = read_archives(spark, path, payloads=False)
    revisit = F.col("type") == "revisit"
    size = F.when(revisit, F.col("length")).otherwise(F.col("own_bytes"))
    return rows.select("page_id", size.alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.col("own_digest")).alias("payload_digest"), F.col("type").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


#: DuckDB's statement of op7.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(concat('0x', substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m
"""
