"""What a read of repetitive pages holds."""

import gzip

from aerolake.llm import warc


def packed(n, size):
    import base64
    import hashlib

    data, records = b"", []
    for page in range(n):
        payload = bytes([97 + page % 20]) * size
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        one = gzip.compress(warc.record(page, "http://a/", digest, payload, page, False), 5, mtime=0)
        records.append((len(data), len(one)))
        data += one
    return data, records


def test_pages_that_compress_a_thousandfold():
    n, size = 40, 1_000_000
    data, records = packed(n, size)
    assert len(data) * 500 < n * size and len(list(warc._ranges([("a", *r) for r in records]))) == 1
    lists = list(warc._parsed(data, 0, records, True))
    assert [r[0] for part in lists for r in part] == list(range(n)) and len(lists) > 4
    assert all(sum(len(r[6]) for r in part) <= warc.READ_BYTES for part in lists)
    assert all(r[6] == bytes([97 + r[0] % 20]) * size for part in lists for r in part)
    (bare,) = warc._parsed(data, 0, records, False)
    assert [(r[0], r[4], len(r)) for r in bare] == [(i, size, 6) for i in range(n)]


def test_a_page_larger_than_a_read():
    data, records = packed(3, warc.READ_BYTES + 1)
    assert [len(part) for part in warc._parsed(data, 0, records, True)] == [1, 1, 1]
    assert list(warc._parsed(b"", 0, [], True)) == []
