import gzip
import hashlib
import random
from pathlib import Path

import pytest

from gridspark.llm import warc as w
from tests.llm.helpers import collect

PAGE = "page_id long, url string, html string, digest string, path string, headers string, value string, first string"
SAME = "<p>" + "the same page again " * 20


def rows():
    rng = random.Random(3)
    out = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "http://c\r\nEvil: 1", None), (4, "u", ""), (None, "u", SAME), (9, "u9", SAME), (7, "u7", SAME), (7, "other", SAME), (8, "u8", SAME + "!"), (None, None, "ä" * 60), (None, "n", "ä" * 60)]
    out += [(11, "gz", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (12, "long", "".join(rng.choice("abcdef <>\r\n") for _ in range(300_000))), (13, "e", "a" * 99), (14, "e", "a" * 99), (15, "e", "b" * 100), (16, "e", "b" * 100)]
    return out + [(i, f"http://h/{i}", "".join(chr(rng.randint(32, 900)) for _ in range(rng.randint(0, 3000)))) for i in range(20, 80)]


def pages(spark, data):
    return spark.createDataFrame([(*r, "d", "p", "h", "v", "f") for r in data], PAGE).repartition(3)


def brute(data):
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in data:
        raw, f = (h or "").encode(), first.get(h or "")
        again = len(raw) >= 100 and f is not None and (i is None or i > f)
        out.append(str((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None)))
    return sorted(out)


def found(df):
    return sorted(str(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    folder = f"{tmp_path}/archives"
    w.write_warc(pages(spark, rows()), folder, compress)
    scan = w.scan_warc(spark, folder)
    assert found(w.page_report(scan)) == brute(rows())
    assert w.gaps(scan).count() == 0
    html = {r["headers"]["page-id"]: r["payload"].decode() for r in collect(w.records(scan)) if r["warc_type"] == "response" and "page-id" in r["headers"]}
    assert html["12"] == dict((i, h) for i, _, h in rows())[12] and html["11"].startswith("WARC/1.1")
    ids = {r["record_id"] for r in collect(w.records(scan)) if r["warc_type"] == "response"}
    assert {r["headers"]["warc-refers-to"] for r in collect(w.records(scan)) if r["warc_type"] == "revisit"} <= ids
    assert {r["warc_type"] for r in collect(w.records(scan))} == {"warcinfo", "response", "revisit"}
    if compress:  # each file is a plain series of gzip members to other readers
        for part in Path(folder).glob("part-*"):
            assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_empty_table_and_whole_file_reader(spark, tmp_path, monkeypatch):
    w.write_warc(pages(spark, rows()).where("false"), f"{tmp_path}/none")
    assert found(w.page_report(w.scan_warc(spark, f"{tmp_path}/none"))) == []
    w.write_warc(pages(spark, rows()), f"{tmp_path}/some")
    monkeypatch.setattr(w, "opened", lambda path: (_ for _ in ()).throw(OSError("unknown file system")))
    assert found(w.page_report(w.scan_warc(spark, f"{tmp_path}/some"))) == brute(rows())


def archive(compress: bool, n: int = 40) -> tuple[bytes, list[tuple[int, int]]]:
    """An archive and the places of its records."""
    rng, data, places = random.Random(n), b"", []
    for i in range(n):
        page = {"page_id": i, "url": f"http://h/{i}", "html": bytes(rng.randint(97, 122) for _ in range(rng.randint(0, 20_000))), "first_page": None, "first_url": None}
        one = w.page_record(page | {"digest": hashlib.sha256(page["html"]).hexdigest()}, "2024-01-01T00:00:00Z")
        one = gzip.compress(one, 6, mtime=0) if compress else one
        places.append((len(data), len(data) + len(one)))
        data += one
    return data, places


def read(data: bytes, chunk: int = 1 << 20):
    at = [0]

    def more(n):
        piece = data[at[0] : at[0] + min(n, chunk)]
        at[0] += len(piece)
        return piece

    out = list(w.salvage(w.Source(more)))
    ids = [int(dict(r["headers"])["page-id"]) for r in out if r["reason"] is None]
    return ids, [(r["start"], r["end"]) for r in out if r["reason"] is not None], out


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("chunk", [1 << 20, 777])
def test_damaged_bytes_cost_their_record_only(compress, chunk):
    data, places = archive(compress)
    rng = random.Random(7)
    for k in rng.sample(range(1, 39), 12):
        start, end = places[k]
        spot = rng.randrange(start, end)
        hurt = data[:spot] + bytes([data[spot] ^ 0xFF]) + data[spot + 1 :]
        ids, lost, _ = read(hurt, chunk)
        assert ids == [i for i in range(40) if i != k] and lost == [places[k]], (k, spot)


@pytest.mark.parametrize("compress", [True, False])
def test_cuts_inserts_and_runs(compress):
    data, places = archive(compress)
    (a, b), (c, d) = places[5], places[20]
    cut = data[: a + 30] + data[b - 10 :]  # bytes missing in the midst of record 5
    ids, lost, _ = read(cut)
    assert ids == [i for i in range(40) if i != 5] and lost == [(a, a + 40)]
    noise = bytes(random.Random(1).randrange(256) for _ in range(100_000)) + b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08\x00"
    ids, lost, _ = read(data[:c] + noise + data[c:])
    assert ids == list(range(40)) and lost == [(c, c + len(noise))]
    ids, lost, _ = read(data[: places[-1][1] - 5])  # the end is missing
    assert ids == list(range(39)) and lost == [(places[-1][0], places[-1][1] - 5)]
    ids, lost, _ = read(data[:a] + b"\xff" * (d - a) + data[d:])  # fifteen records overwritten
    assert ids == [*range(5), *range(21, 40)] and lost == [(a, d)]
    ids, lost, out = read(noise)
    assert ids == [] and lost == [(0, len(noise))] and out[0]["reason"]
    assert read(b"") == ([], [], [])


def test_bounds_digests_and_whole_file_gzip():
    data, _ = archive(False, 5)
    ids, lost, _ = read(gzip.compress(data))  # all records in one member
    assert ids == list(range(5)) and lost == []
    both = data + archive(True, 3)[0]
    assert read(both)[0] == [0, 1, 2, 3, 4, 0, 1, 2]
    small = list(w.salvage(w.Source(None, data), max_record=100))
    assert all(r["reason"] is not None or r["payload_bytes"] <= 100 for r in small) and any(r["reason"] == "longer than the bound" for r in small)
    body = b"hello"
    import base64
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert w.digest_holds(f"sha1:{sha1}", body) and not w.digest_holds(f"sha1:{sha1}", b"x") and w.digest_holds("xyz:1", body) and w.digest_holds(None, body)
