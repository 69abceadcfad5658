import base64
import gzip
import hashlib
import random

from agrolens.llm import warc
from tests.llm.helpers import CLASHES


def record(i, payload, digest=True, kind="response"):
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Page-ID: {i}\r\nContent-Type: application/http; msgtype=response\r\n"
    head += f"WARC-Payload-Digest: sha1:{sha}\r\n" if digest else ""
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read(data, how):
    """(ids of the records, byte ranges of the gaps); nothing overlaps and every byte is told of."""
    ids, gaps, at = [], [], 0
    for r in how(data):
        assert r.start == at and r.end > at
        at = r.end
        if r.kind == "quarantine":
            assert r.reason and not r.payload
            gaps.append((r.start, r.end))
        else:
            ids.append(int(r.headers["warc-page-id"]))
    assert at == len(data)
    return ids, gaps


PAYLOADS = [b"", b"one", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"a\r\n\r\nb\r\n\r\n", b"x" * 5000, "é\x00".encode()]


def test_whole_archives():
    data = [record(i, p) for i, p in enumerate(PAYLOADS)]
    assert read(b"".join(data), warc.read_plain) == (list(range(6)), [])
    assert read(b"".join(map(gzip.compress, data)), warc.read_gzip) == (list(range(6)), [])
    assert read(b"", warc.read_plain) == read(b"", warc.read_gzip) == ([], [])


def test_later_records_are_recovered():
    data = [record(i, b"payload %d " % i * 20) for i in range(8)]
    for pack, how in ((bytes, warc.read_plain), (gzip.compress, warc.read_gzip)):
        parts = [pack(x) for x in data]
        place = [sum(map(len, parts[:i])) for i in range(9)]
        broken = list(parts)
        broken[3] = parts[3][:20] + b"\xff\xfe" + parts[3][22:] if how is warc.read_gzip else parts[3].replace(b"payload 3", b"PAYLOAD 3", 1)
        assert read(b"".join(broken), how) == ([0, 1, 2, 4, 5, 6, 7], [(place[3], place[4])])
        cut = b"".join(parts[:2]) + parts[2][:-30] + b"".join(parts[3:])
        assert read(cut, how) == ([0, 1, 3, 4, 5, 6, 7], [(place[2], place[3] - 30)])
        junk = b"garbage" + b"".join(parts[:4]) + b"\x00" * 99 + b"".join(parts[4:])
        ids, gaps = read(junk, how)
        assert ids == list(range(8)) and gaps == [(0, 7), (7 + place[4], 7 + place[4] + 99)]
        ids, gaps = read(b"".join(parts)[:-9], how)
        assert ids == list(range(7)) and len(gaps) == 1


def test_random_damage_loses_only_what_it_touches():
    rng = random.Random(9)
    data = [record(i, bytes(rng.choices(b"abc \r\n<>", k=rng.randrange(400)))) for i in range(40)]
    for pack, how in ((bytes, warc.read_plain), (gzip.compress, warc.read_gzip)):
        parts = [pack(x) for x in data]
        for _ in range(20):
            hit = rng.sample(range(40), 4)
            broken = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 60))) if i in hit else x for i, x in enumerate(parts)]
            ids, _ = read(b"".join(broken), how)
            assert ids == [i for i in range(40) if i not in hit]


def rows_of(df):
    return sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in df.collect()))


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        out.append((i is None, i or 0, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else -1))
    return sorted(out)


AWKWARD = [(1, "http://a/", "<p>x"), (2, None, "<p>x"), (2, None, "<p>x"), (3, "bad\r\n: url\n", ""), (4, "", None), (None, "http://b", "only here"),
           (None, "http://b", "<p>x"), (5, "u", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"), (6, "u", "é" * 70_000), (9, "u", "\x00\ud7ff\r"),
           (8, "u", "\x00\ud7ff\r"), (10, "u", "\n"), (11, "u", "\r\n\r\n")]


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(AWKWARD, "page_id long, url string, html string")
    assert rows_of(warc.round_trip(pages)) == brute(AWKWARD)
    assert rows_of(warc.round_trip(pages, least=5)) == brute(AWKWARD, 5)
    wide = pages.withColumns({c: F.lit("1") for c in [*CLASHES, "payload", "value", "record_type", "first", "refers_to", "payload_digest"]})
    assert rows_of(warc.round_trip(wide)) == brute(AWKWARD)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_archives_hold_the_payloads(spark, tmp_path):
    pages = spark.createDataFrame(AWKWARD, "page_id long, url string, html string")
    warc.write_warc(warc.records(pages, "page_id", "url", "html"), f"file://{tmp_path}/w", 10, file_bytes=2000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 2
    back = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert {r.record_type for r in back} == {"response", "revisit"}
    got = sorted(bytes(r.payload).decode() for r in back if r.record_type == "response")
    assert got == sorted({h or "" for _, _, h in AWKWARD})
    (tmp_path / "damaged").mkdir()
    for x in (tmp_path / "w").glob("part-*"):
        (tmp_path / "damaged" / x.name).write_bytes(x.read_bytes()[30:])
    assert warc.read_warc(spark, f"file://{tmp_path}/damaged").where("record_type = 'quarantine'").select("start", "reason").collect()[0] == (0, "no version line")


def test_ids_of_any_text_come_back(spark):
    ids = [" a ", "b\r\nc", "d", "", "é%2B + &", "x: y", None]
    pages = spark.createDataFrame([(i, "http://u/", f"<p>{'same' if k < 3 else k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert set(got) == set(ids) and [got[i].refers_to for i in ids[:3]] == [None, " a ", " a "]


def test_lost_bytes_are_told(spark, monkeypatch):
    import pytest

    pages = spark.createDataFrame([(1, "http://u/", "text")], "page_id long, url string, html string")
    real = warc.write_warc

    def damaged(found, path, *more):
        real(found, path, *more)
        for x in spark.read.text(path).inputFiles():
            name = x.removeprefix("file:").replace("//", "", 1) if x.startswith("file://") else x.removeprefix("file:")
            with open(name, "ab") as f:
                f.write(b"junk")
            import pathlib
            crc = pathlib.Path(name).with_name(f".{pathlib.Path(name).name}.crc")
            crc.unlink(missing_ok=True)
    monkeypatch.setattr(warc, "write_warc", damaged)
    with pytest.raises(Exception, match="quarantined bytes in"):
        warc.round_trip(pages).collect()


def test_gzip_archives_are_read_in_linear_time():
    import time

    rng = random.Random(3)
    members = [gzip.compress(record(i, bytes(rng.choices(b"abcdefgh", k=6000))), 1) for i in range(4000)]

    def seconds(n):
        data = b"".join(members[:n])
        began = time.process_time()
        assert sum(r.kind == "response" for r in warc.read_gzip(data)) == n
        return time.process_time() - began
    seconds(200)
    small, large = seconds(500), seconds(4000)
    assert large < 8 * small * 2.5 + 0.2
