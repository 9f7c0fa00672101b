import base64
import hashlib
import random

from brambling.llm import warc
from brambling.llm.storage import new_folder


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8):
        runs = [sorted((str(rng.randint(0, 5)), "t", rng.choice([None, 1, 2])) for _ in range(rng.randint(0, 9))) if False else sorted(((str(rng.randint(0, 5)), "t", rng.choice([None, 1, 2])) for _ in range(rng.randint(0, 9))), key=warc.order) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []), key=warc.order)


def test_round_trip(spark):
    rows = [(1, "http://www.b.org/x", "<p>é\r\n\r\nWARC/1.1</p>", 1), (2, "http://a.org/", None, 1), (3, None, "", 1), (4, "http://b.org/x\n", "<p>é\r\n\r\nWARC/1.1</p>", 1), (5, "u", "z", 1), (5, "u", "z", 1), (None, "n", "only", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, run int")
    for least in (0, 1):
        folder = new_folder(spark, "test")
        warc.write_archive(pages, folder, least_bytes=least)
        got = warc.capture_history(spark, folder).collect()
        keys = [(r.url_key, r.time, r.page_id or 0) for r in got]
        assert keys == sorted(keys)
        found = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got}
        want = set()
        for i, _, html, _ in rows:
            b = (html or "").encode()
            same = [j for j, _, h, _ in rows if (h or "") == (html or "") and j is not None]
            again = len(b) >= least and same and i != max(same)
            want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", max(same) if again else None))
        assert found == want and len(got) == len(rows)


def test_empty(spark):
    folder = new_folder(spark, "test")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.capture_history(spark, folder).count() == 0


def test_large_payloads_and_seeking(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_BYTES", 4_000)
    monkeypatch.setattr(warc, "CLASSES", (0, 100, 1_000, 50_000))
    rng = random.Random(2)
    rows = [(i, f"http://a.org/{i % 7}", "".join(rng.choice("ab\r\né") for _ in range(rng.choice([0, 5, 90, 500, 900, 40_000])))) for i in range(120)] + [(500, "http://a.org/big", "é" * 3_000_000)]
    folder = new_folder(spark, "test")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder, least_bytes=1)
    got = warc.capture_history(spark, folder).collect()
    payload = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows) and len({r.run for r in got}) > 40
    for r in got:
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            head, block = warc.read_record(f.read(r.length))
        assert head["warc-record-id"] == f"<urn:page:{r.page_id}>" and r.payload_bytes == len(payload[r.page_id])
        assert r.record_type == "revisit" or block.partition(b"\r\n\r\n")[2] == payload[r.page_id]
