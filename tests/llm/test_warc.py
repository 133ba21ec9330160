import base64
import hashlib
import io

from tessella.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, n string"


def test_round_trip(spark):
    html = "<html><body>" + "text é " * 200
    rows = [(i, f"http://x/{i}\r\nEvil: 1", html + str(i % 7), "x", "y") for i in range(60)]
    rows += [(100, None, None, "x", "y"), (101, "u", "", "x", "y"), (102, "u", "WARC/1.1\r\n\r\n" * 5, "x", "y"), (103, "u", "z" * 3_000_000, "x", "y")]
    rows += [(None, "u", html + "3", "x", "y"), rows[59], (200, "u", "only", "x", "y")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h, *_ in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        to = largest[h or ""]
        again = i != to
        want.append((-1 if i is None else i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
    have = [(-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_smaller_payloads_do_not_revisit(spark):
    rows = [(1, "u", "tiny", "x", "y"), (2, "u", "tiny", "x", "y"), (3, "u", "long enough", "x", "y"), (4, "u", "long enough", "x", "y")]
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA), 8).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archive_has_a_dictionary_frame_and_a_frame_per_record():
    class Sink(io.BytesIO):
        def close(self):
            pass

    for n in (1, 3, 600):
        sink = Sink()
        writer = warc.ArchiveWriter(sink)
        data = [warc.record(i, f"http://host/{i}", f"<p>page {i} {'same words again ' * 30}</p>".encode(), None) for i in range(n)]
        for d in data:
            writer.write(d)
        writer.close()
        raw = sink.getvalue()
        assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
        assert raw.count(b"\x28\xb5\x2f\xfd") >= n + 1
        back = list(warc.read_archive(io.BytesIO(raw)))
        assert [warc.page_of(f["WARC-Record-ID"]) for f, _ in back] == list(range(n))
        if n == 600:
            assert len(raw) < sum(map(len, data)) / 3


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
