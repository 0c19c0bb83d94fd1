"""Web archives packed in ZIP files: written by tasks, read by byte ranges without unpacking.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member per WARC record, and
``indexes/index.cdxj``, a line with offset and length for each record. The reader takes the central directory
at the end of the file (ZIP64 where it must), finds where the stored members lie, reads the index, and then
single records straight out of the package.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import materialize, scratch_path, store

DATA, INDEX, MIME = "archive/data.warc.gz", "indexes/index.cdxj", "application/http; msgtype=response"
LEAST_BYTES = 100
RANGE = 8 << 20  # neighbouring records are read together up to so many bytes


def _uri(page_id) -> str:
    return f"<urn:page:{'' if pd.isna(page_id) else int(page_id)}>"


def _page(uri: str | None):
    digits = (uri or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def warc_record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One record: a response with its payload, or a revisit of the page ``first`` without it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += [f"Content-Type: {MIME}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if first is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_uri(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; digest and length of a response are those of the payload it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:size + 4] != b"\r\n\r\n":
        raise ValueError("damaged record")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    kind = fields["warc-type"]
    digest, n = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, n):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": n, "payload_digest": digest,
        "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


class _Sink:
    """What zipfile needs of a stream that cannot seek."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def write_packages(pages: DataFrame, target: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write every page as a record, one package per task, and return their list: path, n_records.

    Of pages with equal payloads of at least ``least_bytes`` that with the smallest id is a response, the others
    revisit it; smaller payloads are all responses. A null page text is an empty payload; a null url leaves its
    field out. Rows with a null id can only revisit; where no equal page has an id, all are responses. Repeated
    rows of the first page are responses each. Other columns are ignored. Only packages of finished tasks
    are listed.
    """
    target = target or scratch_path(pages.sparkSession, "packages")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("digest", "id")
    shared = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    told = rows.join(materialize(shared, "equal-pages"), "digest", "left")
    told = told.withColumn("first", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    fs, folder = store(target)
    fs.create_dir(folder, recursive=True)

    def write(batches):
        path, out, pack, n, at, lines = f"{target}/pages-{uuid.uuid4().hex}.wacz", None, None, 0, 0, []
        for pdf in batches:
            for page, url, payload, digest, first in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["first"]):
                if pack is None:
                    task_fs, where = store(path)
                    out = task_fs.open_output_stream(where)
                    pack = zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = pack.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(warc_record(page, url, payload, digest, None if pd.isna(first) else first)) + packer.flush()
                member.write(data)
                lines.append(f"{'' if pd.isna(page) else int(page)} 20000101000000 {json.dumps({'offset': at, 'length': len(data), 'digest': digest})}\n")
                at += len(data)
                n += 1
        if pack is not None:
            member.close()
            pack.writestr(zipfile.ZipInfo(INDEX), "".join(lines).encode())
            pack.close()
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    return materialize(told.mapInPandas(write, "path string, n_records long"), "packages-list")


def read_directory(f) -> dict[str, tuple[int, int, int, int]]:
    """Member name -> (method, compressed size, size, offset of the local header), from the end of the file."""
    size = f.size()
    tail_at = max(0, size - (1 << 16) - 22)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, n_bytes, start = struct.unpack_from("<HII", tail, at + 10)
    locator = f.read_at(20, tail_at + at - 20) if tail_at + at >= 20 else b""
    if locator[:4] == b"PK\6\7" and (entries == 0xFFFF or n_bytes == 0xFFFFFFFF or start == 0xFFFFFFFF):
        end64 = f.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        entries, n_bytes, start = struct.unpack_from("<QQQ", end64, 32)
    directory, out, at = f.read_at(n_bytes, start), {}, 0
    for _ in range(entries):
        if directory[at:at + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = directory[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, x)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            x += 4 + n
        out[name] = (method, packed, full, header)
        at += 46 + n_name + n_extra + n_comment
    return out


def stored_member(f, directory: dict, name: str) -> tuple[int, int]:
    """(first byte, size) of a member that is stored as it is."""
    method, packed, full, header = directory[name]
    if method or packed != full:
        raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
    local = f.read_at(30, header)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {name}")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return header + 30 + n_name + n_extra, full


def list_records(listing: DataFrame) -> DataFrame:
    """(path, at, length) of every record of the packages listed by ``path``, from their indexes."""

    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                fs, where = store(path)
                with fs.open_input_file(where) as f:
                    directory = read_directory(f)
                    data_at, data_size = stored_member(f, directory, DATA)
                    index_at, index_size = stored_member(f, directory, INDEX)
                    found = [json.loads(x.split(" ", 2)[2]) for x in f.read_at(index_size, index_at).decode().splitlines()]
                if any(x["offset"] + x["length"] > data_size for x in found):
                    raise ValueError(f"index of {path} points behind its archive")
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pd.DataFrame({"path": path, "at": [data_at + x["offset"] for x in part], "length": [x["length"] for x in part]})

    return listing.select("path").repartition(F.col("path")).mapInPandas(read, "path string, at long, length long")


def read_records(spots: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record: id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""

    def read(batches):
        for pdf in batches:
            out = []
            for path, rows in pdf.groupby("path", sort=False):
                rows = rows.sort_values("at")
                begin, size = rows["at"].to_numpy(), rows["length"].to_numpy()
                fs, where = store(path)
                with fs.open_input_file(where) as f:
                    i = 0
                    while i < len(begin):
                        j = i + 1
                        while j < len(begin) and begin[j] == begin[j - 1] + size[j - 1] and begin[j] + size[j] - begin[i] <= RANGE:
                            j += 1
                        data = f.read_at(int(begin[j - 1] + size[j - 1] - begin[i]), int(begin[i]))
                        out += [parse_record(zlib.decompress(data[b:b + s], 31)) for b, s in zip(begin[i:j] - begin[i], size[i:j])]
                        i = j
            yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]).astype(
                {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": np.int64})

    chunk = F.floor(F.col("at") / RANGE)
    dealt = spots.repartition(F.col("path"), chunk).sortWithinPartitions("path", "at")
    return dealt.mapInPandas(
        read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    ).withColumnRenamed("page_id", id_col)
