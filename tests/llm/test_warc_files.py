"""WARC files that others write: one gzip stream, several records in a member, plain files."""

import gzip

from pubmetrics.llm import warc


def test_members_of_several_records_and_plain_files(spark, tmp_path):
    records = [warc.record(i, f"http://x/{i}", b"body %d" % i) for i in range(8)]
    plain = [gzip.decompress(r) for r in records]
    spoilt = plain[4].replace(b"body", b"bode")
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(plain[:3])))
    (tmp_path / "two.warc.gz").write_bytes(records[3] + gzip.compress(spoilt + plain[5] + b"rest") + records[6] + gzip.compress(spoilt))
    (tmp_path / "three.warc").write_bytes(plain[7] + spoilt + plain[0])
    (tmp_path / "other.txt").write_bytes(plain[0])
    rows = warc.read(spark, str(tmp_path)).collect()
    got = sorted((r.file.rsplit("/", 1)[-1], r.at, r.inside, r.record_id, bytes(r.payload)) for r in rows if r.reason is None)
    middle, last = len(records[3]), len(records[3]) + len(gzip.compress(spoilt + plain[5] + b"rest"))
    assert got == [
        *(("one.warc.gz", 0, sum(map(len, plain[:i])), str(i), b"body %d" % i) for i in range(3)),
        ("three.warc", 0, 0, "7", b"body 7"),
        ("three.warc", len(plain[7]) + len(spoilt), 0, "0", b"body 0"),
        ("two.warc.gz", 0, 0, "3", b"body 3"),
        ("two.warc.gz", middle, len(spoilt), "5", b"body 5"),
        ("two.warc.gz", last, 0, "6", b"body 6"),
    ]
    gaps = sorted((r.file.rsplit("/", 1)[-1], r.gap_start, r.inside, r.gap_bytes, r.reason) for r in rows if r.reason)
    assert gaps == [
        ("three.warc", len(plain[7]), 0, len(spoilt), "block digest"),
        ("two.warc.gz", middle, 0, len(spoilt), "block digest"),
        ("two.warc.gz", middle, len(spoilt) + len(plain[5]), 4, "version"),
        ("two.warc.gz", last + len(records[6]), 0, len(gzip.compress(spoilt)), "block digest"),
    ]
