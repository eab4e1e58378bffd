import io
import zipfile

import pytest

from vacantia.llm import warc_zip as wz


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_plain_zip_files(zip64):
    out = io.BytesIO()
    made = wz.ZipWriter(out, zip64)
    for name, parts in (("a/one", [b"abc", b"defg"]), ("b/two", []), ("é", [b"x" * 70_000])):
        made.begin(name)
        for p in parts:
            made.write(p)
        made.end()
    made.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        assert [z.read(n) for n in ("a/one", "b/two", "é")] == [b"abcdefg", b"", b"x" * 70_000]
    members = wz.ZipReader(lambda at, n: data[at : at + n], len(data)).members()
    assert data[members["a/one"].start :][: members["a/one"].size] == b"abcdefg"


def test_reads_archives_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr("m", b"member data")
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"wide data")
    data = out.getvalue()
    members = wz.ZipReader(lambda at, n: data[at : at + n], len(data)).members()
    assert {k: data[m.start : m.start + m.size] for k, m in members.items()} == {"m": b"member data", "wide": b"wide data"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", b"member data" * 99)
    with pytest.raises(ValueError, match="compressed"):
        wz.ZipReader(lambda at, n: packed.getvalue()[at : at + n], len(packed.getvalue())).members()


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wz, "ARCHIVE_BYTES", 400)
    big, other = "<p>é</p>" * 20, "z" * 99
    rows = [(5, "http://a/\r\nb: c", big), (2, None, big), (9, "u", big), (9, "u", big), (7, "u", other), (8, "u", other), (1, "u", None), (3, "u", ""), (None, "u", big), (None, "u", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    written, folder = wz.archive(pages)
    assert written.count() > 1
    got = wz.read_archives(written, folder).collect()
    assert [(r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] is None] in ([("response", None, len(big.encode())), ("response", None, 0)], [("response", None, 0), ("response", None, len(big.encode()))])
    got = [r for r in got if r["page_id"] is not None]
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, "response", None), (2, "response", None), (3, "response", None), (5, "revisit", 2),
        (7, "response", None), (8, "response", None), (9, "revisit", 2), (9, "revisit", 2),
    ]
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {1: "", 2: big, 3: "", 7: other, 8: other}
    assert wz.report(pages.limit(0)).count() == 0
