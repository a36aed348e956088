import base64
import gzip
import hashlib
import io
from pathlib import Path

import pytest

from strandline.llm import queries, warc
from strandline.session import read_table


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.warc.gz")}


def expected(rows, least=0):
    out = []
    groups = {}
    for i, u, h in rows:
        groups.setdefault((h or "").encode(), []).append((i is None, i if i is not None else 0, u is not None, u or ""))
    for payload, members in groups.items():
        members.sort()
        first = members[0]
        for k, m in enumerate(members):
            revisit = k > 0 and len(payload) >= least
            page_id = None if m[0] else m[1]
            refers = (None if first[0] else first[1]) if revisit else None
            out.append((str(page_id), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", str(refers)))
    return sorted(out)


def shown(df):
    return sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in read_table(spark, sf, "pages").collect()]
    return rows + [(10**12 + i, f"http://copy/{i}", rows[3][2]) for i in range(40)] + [(-5, "u", rows[3][2]), (7, None, None), (8, "e", ""), (9, "two\nlines é", "x" * 300_000), (None, "a", "nulls"), (None, "b", "nulls"), (12, "z", "twice"), (12, "z", "twice"), (12, "y", "twice")]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, rows, tmp_path, least):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, digest string")
    one, two = f"file://{tmp_path}/one", f"{tmp_path}/two"
    warc.write_archives(df, one, revisit_from=least, shards=16)
    manifest = warc.write_archives(df.repartition(5), two, revisit_from=least, shards=16)
    assert files(tmp_path / "one") == files(tmp_path / "two") and len(files(two)) > 3
    assert not (tmp_path / "two/_temporary").exists()
    back = warc.read_archives(spark, one)
    assert shown(back) == expected(rows, least)
    payloads = {r.record_id: (r.payload or b"").decode() for r in back.where("record_type = 'response'").collect()}
    assert sorted(payloads.values()) == sorted({h or "" for _, _, h in rows} if least == 0 else [h or "" for _, _, h in rows if len((h or "").encode()) < 100] + list({h for _, _, h in rows if h and len(h.encode()) >= 100}))
    assert {(r.file, r.sha1) for r in manifest.collect()} == {(n, hashlib.sha1(b).hexdigest()) for n, b in files(two).items()}
    again = warc.write_archives(df.where("false"), two)  # committed: stays as it is
    assert again.count() == manifest.count()


def test_files_are_rolled_and_sorted(spark, rows, tmp_path):
    df = spark.createDataFrame([r for r in rows if r[0] is not None], "page_id long, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path / "x"), shards=1, roll_bytes=20_000).collect()
    assert max(r.part for r in manifest) > 1 and all(r.bytes >= 20_000 for r in manifest if any(m.shard == r.shard and m.part > r.part for m in manifest))
    for name, data in files(tmp_path / "x").items():
        keys = [int(h["X-Record-Key"]) for h, _ in warc.read_records(io.BytesIO(gzip.decompress(data)))]
        assert keys == sorted(keys), name


def test_shards_of_clustered_keys(spark):
    sized = spark.createDataFrame([(i, 10) for i in range(1000)] + [(2**62, 10), (-(2**62), 10)] + [(5000, 50)] * 40, "key long, bytes long")
    bounds = warc.shard_bounds(sized, 500)
    assert len(bounds) > 15 and sum(p for _, _, p in bounds) >= 22
    assert [b[0] for b in bounds] == sorted(b[0] for b in bounds)
    assert next(p for low, _, p in bounds if low == 5000) == 4


def test_query_and_empty_table(spark, sf, tmp_path):
    assert shown(queries.op2_warc(spark, sf)) == expected([(r.page_id, r.url, r.html) for r in read_table(spark, sf, "pages").collect()])
    warc.write_archives(read_table(spark, sf, "pages").where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, str(tmp_path / "never"))
