"""Packages against the zipfile and gzip modules, and pages by hand."""

import gzip
import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest
from compare import compare, oracle
from pyspark.sql import types as T

from valora.llm import catalog
from valora.llm.common import store
from valora.llm.zip_warc import DATA, INDEX, list_records, parse_record, read_directory, read_records, stored_member, write_packages

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("first", T.StringType()), T.StructField("id", T.StringType())])


def test_same_as_sql(spark, sf_dir):
    assert compare(catalog.QUERIES["op6_zip_warc"](spark, sf_dir), oracle(sf_dir), catalog.ORACLES["op6_zip_warc"]) is None


def test_pages_by_hand(spark):
    a, b, long = "x" * 100, "y" * 99, "<p>ü</p>\r\n\r\n" * 20000
    rows = [(7, "u", a), (3, None, a), (9, "u\r\nWARC-Type: x", a), (1, "u", b), (2, "u", b), (4, "u", None), (5, "u", ""), (6, "u", long), (8, "u", long),
            (None, "u", a), (None, "u", "z" * 200), (None, "u", "z" * 200), (3, None, a)]
    df = spark.createDataFrame([(*r, "p", "q", "r") for r in rows], SCHEMA).repartition(2)
    listing = write_packages(df)
    got = read_records(list_records(listing)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((str(i), len((h or "").encode()), sha(h), "revisit" if to else "response", to) for (i, _, h), to in zip(
        rows, [3, None, 3, None, None, None, None, None, 6, 3, None, None, None]))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.page_id: r.payload for r in got if r.page_id == 6}[6].decode() == long
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    for r in listing.collect():  # other readers agree
        with zipfile.ZipFile(io.BytesIO(store(r.path)[0].open_input_file(store(r.path)[1]).read())) as z:
            assert z.testzip() is None and set(z.namelist()) == {DATA, INDEX}
            assert gzip.decompress(z.read(DATA)).count(b"WARC/1.1\r\n") == r.n_records
    assert read_records(list_records(write_packages(df.where("false")))).count() == 0


def test_zip64_directory_comments_and_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("packed", b"a" * 500, zipfile.ZIP_DEFLATED)
        z.writestr("é/stored", b"hello")
        z.comment = b"PK\5\6 in a comment"
    f = pa.BufferReader(out.getvalue())
    reader = type("F", (), {"size": lambda s: f.size(), "read_at": lambda s, n, at: f.read_at(n, at)})()
    directory = read_directory(reader)
    at, size = stored_member(reader, directory, "é/stored")
    assert out.getvalue()[at:at + size] == b"hello"
    with pytest.raises(ValueError, match="compressed"):
        stored_member(reader, directory, "packed")
    # The same package with every size and offset moved into ZIP64 fields.
    name, data = b"m", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, len(data), len(data), 1, 0) + name + data
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at64 = len(local) + len(central)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    whole = local + central + end64 + struct.pack("<4sIQI", b"PK\6\7", 0, at64, 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    g = pa.BufferReader(whole)
    reader = type("F", (), {"size": lambda s: g.size(), "read_at": lambda s, n, at: g.read_at(n, at)})()
    at, size = stored_member(reader, read_directory(reader), "m")
    assert whole[at:at + size] == data
    with pytest.raises(ValueError):
        read_directory(type("F", (), {"size": lambda s: 4, "read_at": lambda s, n, at: b"abcd"})())


def test_damage_is_noticed():
    with pytest.raises(ValueError):
        parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 1\r\n"
                     b"Content-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n")
