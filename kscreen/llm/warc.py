"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is written as three gzip members: request, response (or revisit, when an equal
payload has its response elsewhere) and metadata; request and metadata name the response
through WARC-Concurrent-To. Reading streams one record at a time; assembly brings the records
of a transaction together by that identifier and emits one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kscreen.llm.common import fresh, taken, trimmed, written
from kscreen.llm.components import components
from kscreen.llm.token_store import filesystem

#: Compressed bytes after which a task closes an archive and starts another.
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = """file string, record_id string, type string, concurrent_to array<string>, target_uri string, date string, payload_digest string,
    payload_bytes long, refers_to_uri string, status int, fields map<string,string>, payload binary"""


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), *headers, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 3, mtime=0)


def capture(name: str, page_id: object, url: str | None, payload: bytes, first: object, first_url: str | None, is_revisit: bool) -> bytes:
    """The three records of one capture. name: unique, gives the record ids."""
    ids = [str(uuid.uuid5(uuid.NAMESPACE_OID, f"{name}-{k}")) for k in ("response", "request", "metadata")]
    uri, digest = ("WARC-Target-URI", url or ""), bare_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [uri, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if is_revisit:
        main += [("WARC-Profile", REVISIT), ("WARC-Refers-To-Target-URI", first_url or ""), ("WARC-Refers-To-Date", DATE)]
    fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("refers-to-page-id", first if is_revisit else None)) if v is not None)
    tied = [uri, ("WARC-Concurrent-To", f"<urn:uuid:{ids[0]}>")]
    path = "/" + (url or "").partition("://")[2].partition("/")[2]
    return (
        record("request", ids[1], tied, "application/http; msgtype=request", f"GET {' '.join(path.split())} HTTP/1.1\r\n\r\n".encode())
        + record("revisit" if is_revisit else "response", ids[0], main, "application/http; msgtype=response", http + (b"" if is_revisit else payload))
        + record("metadata", ids[2], tied, "application/warc-fields", fields.encode())
    )


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write every row as a capture and return the manifest: (file, n_captures).

    Of rows with equal payloads of at least min_bytes, those with the largest id are responses
    and the others revisit it; a group whose ids are all null has responses only. Null payloads
    count as empty, null urls too; repeated rows are all written; other columns are not read.
    """
    folder = folder or fresh(pages.sparkSession, "warc")
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    rows = taken(pages, id=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("id").cast("long"), "url", payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.max_by("url", "id").alias("first_url"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1 and first is not null").drop("n"), "warc-groups")
    # groups is a plain scan, so that a payload of very many rows can be split by the engine
    rows = rows.join(groups, "sha", "left").select("id", "url", "payload", "first", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, out, n, size = TaskContext.get(), 0, None, 0, 0
        name = ""
        for b in batches:
            for page_id, url, body, first, first_url in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None:
                    name = f"{folder}/part-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.warc.gz"
                    out, n, size, seq = filesystem(name)[0].open_output_stream(filesystem(name)[1], compression=None), 0, 0, seq + 1
                data = capture(f"{name}#{n}", page_id, url, body, first, first_url, first is not None and page_id != first)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "n_captures": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_captures": [n]})

    return written(rows.mapInArrow(trimmed(run), "file string, n_captures long"), "warc-manifest")


def parse(f: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed stream."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            k, v = k.strip().lower(), v.strip()
            headers[k] = f"{headers[k]} {v}" if k == "warc-concurrent-to" and k in headers else v
        size = headers.get("content-length", "0")
        yield headers, f.read(int(size) if size.isdigit() else 0)


def _row(file: str, h: dict[str, str], block: bytes) -> dict:
    kind, ident = h.get("warc-type"), lambda k: h[k].strip("<>") if k in h else None
    method, _, digest = h.get("warc-payload-digest", "").rpartition(":")
    out = {
        "file": file, "record_id": ident("warc-record-id"), "type": kind, "concurrent_to": [x.strip("<>") for x in h.get("warc-concurrent-to", "").split()], "target_uri": h.get("warc-target-uri"),
        "date": h.get("warc-date"), "payload_digest": digest if method.lower() == "sha1" and digest else None, "payload_bytes": None, "refers_to_uri": h.get("warc-refers-to-target-uri"), "status": None,
        "fields": None, "payload": None,
    }
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, *lines = head.decode("latin-1").split("\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        status = first.split(" ")[1:2]
        out["status"] = int(status[0]) if status and status[0].isdigit() and len(status[0]) == 3 else None
        if kind == "response":
            out |= {"payload": payload, "payload_bytes": len(payload)}
            if out["payload_digest"] not in (None, bare_digest(payload)):
                raise ValueError(f"{out['record_id']}: payload and digest differ")
        elif http.get("content-length", "").isdigit():
            out["payload_bytes"] = int(http["content-length"])
    elif kind == "metadata":
        out["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x.strip())]
    return out


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record (``RECORD``) of the manifest's files, read as streams, a file a task.

    payload_digest is null where a record names none or another than SHA-1, status where the first
    line of a response is malformed; a SHA-1 digest that is not its payload's raises. Of a repeated
    header the last counts, but all records of WARC-Concurrent-To do.
    """
    names = [x.split()[0] for x in RECORD.replace("\n", " ").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            for file in b.column(0).to_pylist():
                system, path = filesystem(file)
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for h, block in parse(io.BufferedReader(f, 1 << 20)):
                        held.append(_row(file, h, block))
                        size += len(block) + 500
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(trimmed(run), RECORD)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata, n_requests, n_metadata).

    Every response or revisit is a capture, also where several have the same id or none; capture_id
    is its id. Requests and metadata records belong to all captures that they are concurrent to, by
    themselves or by way of other records, whichever of two records names the other. Of several
    requests or metadata records that with the least record id is kept, and all are counted. Those
    without a capture make rows with a null response: one for each event that they share, and one
    for each record without any identifier. payload=False leaves payloads out, so they are not
    shuffled. An empty table gives an empty one.
    """
    # read once and kept without payloads; these are read again where they are asked for
    light = written(records.drop("payload", "file"), "warc-records")
    is_main = F.col("type").isin("response", "revisit")
    common = ["record_id", "type", "target_uri", "date"]
    main = F.struct(*common, "payload_digest", "payload_bytes", "refers_to_uri", "status", *(["payload"] if payload else []))
    mains = (records if payload else light).filter(is_main).select("record_id", "concurrent_to", main.alias("response"))
    tied = light.filter(F.col("type").isin("request", "metadata"))
    tied = tied.select("record_id", "concurrent_to", "type", F.struct(*common).alias("own"), F.to_json("fields").alias("fields"))
    first = F.get("concurrent_to", F.lit(0))
    links = light.select("record_id", is_main.alias("main"), F.explode("concurrent_to").alias("other"))
    ids = light.filter(is_main & F.col("record_id").isNotNull()).select(F.col("record_id").alias("other"))
    # as a rule requests and metadata records each name one response; else events are components of links
    odd = links.filter("main").select("other").union(links.join(ids, "other", "left_anti").select("other"))
    several = light.filter(F.size("concurrent_to") > 1).select(first.alias("other"))
    if odd.union(several).limit(1).count():
        events = components(links.filter("record_id is not null").select(F.col("record_id").alias("a"), F.col("other").alias("b")))
        key = events.select(F.col("v").alias("_id"), F.col("label").alias("_event"))
        mains, tied = (
            x.withColumn("_id", F.coalesce("record_id", first)).join(key, "_id", "left").withColumn("_event", F.coalesce("_event", "_id")).drop("_id") for x in (mains, tied)
        )
    else:
        mains, tied = mains.withColumn("_event", F.col("record_id")), tied.withColumn("_event", F.coalesce(first, "record_id"))
    counts = [
        F.min(F.when(F.col("type") == "request", F.col("own"))).alias("request"),
        F.min(F.when(F.col("type") == "metadata", F.struct("own.record_id", "fields"))).alias("metadata"),
        F.count(F.when(F.col("type") == "request", 1)).alias("n_requests"),
        F.count(F.when(F.col("type") == "metadata", 1)).alias("n_metadata"),
    ]
    # one row an event, summed in each task first; records without identifiers stand alone
    alone = F.when(F.col("_event").isNull(), F.monotonically_increasing_id())
    events = written(tied.withColumn("_alone", alone).groupBy("_event", "_alone").agg(*counts), "warc-events")
    told = [c for c in events.columns if c[0] != "_"]
    captures = mains.join(events.filter("_event is not null").select("_event", *told), "_event", "left")
    captures = captures.select(F.col("record_id").alias("capture_id"), "response", "request", "metadata", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_requests", "n_metadata")])
    left = events.join(mains.select("_event").filter("_event is not null"), "_event", "left_anti")
    none = F.lit(None).cast(captures.schema["response"].dataType)
    return captures.unionByName(left.select(F.col("_event").alias("capture_id"), none.alias("response"), *told))
