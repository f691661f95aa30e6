import io
import zipfile

import pytest

from statuta.llm.warc import build_record, parse_record
from statuta.llm.zip_archive import ZipReader, pack


@pytest.mark.parametrize("zip64", [False, True])
def test_other_readers_agree(tmp_path, zip64):
    members = [("a/b.txt", b"hello" * 100), ("ü.bin", bytes(range(256))), ("empty", b"")]
    raw = pack(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None
        assert [(n, z.read(n)) for n in z.namelist()] == members
    (tmp_path / "x.zip").write_bytes(raw)
    with ZipReader(str(tmp_path / "x.zip")) as mine:
        assert [(n, mine.read(n)) for n in mine.members] == members
        assert list(mine.ranges("ü.bin", [(3, 2), (5, 1), (0, 1), (250, 6)], join=4)) == [b"\x03\x04", b"\x05", b"\x00", bytes(range(250, 256))]
        with pytest.raises(ValueError):
            list(mine.ranges("ü.bin", [(255, 2)]))


def test_archives_of_others_are_read(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one", b"1" * 5000)
        z.writestr("packed", b"1" * 5000, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment" * 3
    with ZipReader(str(tmp_path / "x.zip")) as mine:
        assert mine.read("one") == b"1" * 5000
        with pytest.raises(ValueError):
            mine.read("packed")
    (tmp_path / "y.zip").write_bytes(b"no archive")
    with pytest.raises(ValueError):
        ZipReader(str(tmp_path / "y.zip"))


def test_record_round_trip():
    payload = b"<p>\r\n\r\n</p>\xff"
    fields, http, got = parse_record(build_record(7, "http://x/\r\ny", payload, "00" * 20, None, False))
    assert (fields["x-page"], got, http.endswith(b"Content-Length: 12")) == ("7", payload, True)
    fields, http, got = parse_record(build_record(None, None, payload, "00" * 20, 9, True))
    assert ("x-page" in fields, fields["x-refers-to-page"], got) == (False, "9", b"")
