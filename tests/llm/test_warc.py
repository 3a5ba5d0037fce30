"""Archives written and read back, and archives that are broken in every way the reader must name."""

import base64
import gzip
import hashlib

import pytest

from tests import oracle
from visitwise.llm import warc


def record(head=(), block=b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello", length=None, kind="response"):
    lines = ["WARC/1.1", f"Content-Length: {len(block) if length is None else length}", "Content-Type: application/http"]
    lines += [f"WARC-Type: {kind}"] if kind else []
    lines = [line for line in [*lines, *head] if not line.endswith(": drop")]
    return gzip.compress("\r\n".join(lines).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n")


def read(data, piece=7):
    return list(warc.Records(data[i : i + piece] for i in range(0, len(data), piece)))


@pytest.mark.parametrize("piece", [1, 7, 10**6])
def test_members_one_by_one(piece):
    data = record() + record(block=b"HTTP/1.1 200 OK\r\n\r\n") + record(kind="revisit")
    assert [r.payload for r in read(data, piece)] == [b"hello", b"", b"hello"]
    assert read(b"") == []


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha512"])
def test_digests_by_their_named_algorithm(name):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    found = hashlib.new(name, block).digest()
    for value in (found.hex(), base64.b32encode(found).decode()):
        assert read(record([f"WARC-Block-Digest: {name}:{value}"]))[0].payload == b"hello"
    payload = hashlib.new(name, b"hello").hexdigest()
    assert read(record([f"WARC-Payload-Digest: {name}:{payload}"]))
    for field in ("Block", "Payload"):
        with pytest.raises(warc.BadArchive, match="digest"):
            read(record([f"WARC-{field}-Digest: {name}:{'0' * len(payload)}"]))
    assert read(record(["WARC-Block-Digest: crc99:1234"]))


@pytest.mark.parametrize(
    "data",
    [
        record()[:-9],
        record() + b"junk behind the last record",
        gzip.compress(b"no header at all"),
        gzip.compress(b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"),
        gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"),
        record(kind=None),
        record(length="many"),
        record(length="-3"),
        record(length="²"),
        record(length=3),
        record(length=3000),
        record(block=b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\nhello"),
        record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nhello"),
    ],
)
def test_broken_archives_are_named(data):
    with pytest.raises(warc.BadArchive):
        read(data)


def test_a_byte_that_is_not_utf8_spoils_its_field_only():
    found = read(record(["WARC-Target-URI: http://x/\xff"]))
    assert found[0].payload == b"hello" and found[0].fields["warc-target-uri"].startswith("http://x/")


def test_pages_come_back(spark):
    long = "<p>same</p>" * 20
    rows = [(1, "http://a/é\n b", long), (2, None, long), (3, "u", None), (4, "u", ""), (None, "u", long), (5, "u", "short"), (6, "u", "short")]
    rows += [(1, "http://a/é\n b", long), (2**63 - 1, "u", "東京" * 50)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, file string").repartition(3)
    folder = warc.new_path(spark, "archives")
    manifest = warc.write_archives(warc.with_revisits(pages), folder)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(spark, folder, manifest).collect()
    assert sorted((r["page_id"], r["url"]) for r in got if r["page_id"]) == sorted((r[0], r[1]) for r in rows if r[0])
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[2] == ("revisit", 1) and kinds[1] == ("response", None) and kinds[6] == kinds[5] == ("response", None)
    assert {r["payload_digest"] for r in got if r["page_id"] == 2} == {hashlib.sha256(long.encode()).hexdigest()}
    assert all(r["problem"] is None for r in got)


def test_sql(spark, sf_dir):
    con = oracle.connect(sf_dir)
    assert oracle.spark_result(warc.op4_warc(spark, sf_dir)) == oracle.duck_result(con, warc.ORACLE)
