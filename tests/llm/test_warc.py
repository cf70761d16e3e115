import base64
import gzip
import hashlib
import io

import pytest

from lorequarry.llm import warc
from lorequarry.llm._shared import fresh_path

PAGES = "page_id long, url string, html string, extra int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        other = first.get(html or "")
        again = page is not None and page != other and len((html or "").encode()) >= least
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    rows = [(3, "u3", "<p>same é</p>"), (1, "u1", "<p>same é</p>"), (2, "u2", "x" * 3_000_000), (4, None, None), (5, "u\r\n5", ""), (6, "u6", "ab"), (7, "u7", "ab"), (None, "n", "<p>same é</p>"), (8, "u8", "HTTP/1.1 200\r\n\r\n"), (9, "u9", "漢字😀"), (9, "u9", "漢字😀")]
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES).repartition(3)
    out = warc.round_trip(spark, df, least, payload=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    assert got == expected(rows, least)
    for r in out:
        if r.record_type == "response":
            assert digest(bytes(r.payload).decode()) == r.payload_digest


def test_archives_are_gzip_members_that_can_be_read_one_by_one(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * i, 1) for i in range(40)], PAGES).coalesce(1)
    files = warc.write_archives(df, fresh_path(spark, "w"), roll_bytes=4000).collect()
    assert len(files) > 1 and sum(f.records for f in files) == 40
    store, at = warc.open_filesystem(files[0].file)
    data = store.open_input_stream(at, compression=None).read()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == files[0].records


def record(text="<p>hello</p>"):
    return warc.record(1, "http://x", text.encode(), digest(text), None, False)


def test_small_reads_give_the_same():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(1)

    data = record() + record("y" * 1000)
    assert list(warc.read_records(Slow(data))) == list(warc.read_records(io.BytesIO(data)))


@pytest.mark.parametrize("damage", ["cut", "payload", "length", "plain"])
def test_damage_is_found(damage):
    plain = gzip.decompress(record())
    data = {
        "cut": record()[:-12],
        "payload": gzip.compress(plain.replace(b"hello", b"hullo")),
        "length": gzip.compress(plain + b"x"),
        "plain": plain,
    }[damage]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0
