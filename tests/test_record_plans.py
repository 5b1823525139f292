"""How files of many frames are planned and entered."""

import zstandard

from gradus.sources import records as R


def many(path, n):
    """A file of n frames of one record each; its text is the same for any n but for the number."""
    path.write_bytes(b"".join(zstandard.compress(f'[Event "e{k}"]\n\n1. e4 1-0\n\n'.encode()) for k in range(n)))
    return str(path)


def test_partitions_grow_with_bytes_not_with_frames(spark, tmp_path):
    path = many(tmp_path / "a.zst", 300)
    size = (tmp_path / "a.zst").stat().st_size
    assert len(R.partitions_of(path, 0, size)) == 1 and len(R.partitions_of(path, 0, size, 1)) == 300
    parts = R.partitions_of(path, 0, size, size=size // 7)
    assert 7 <= len(parts) <= 8 and [p.own for p in parts[:-1]] == [p.start for p in parts[1:]]
    spark.dataSource.register(R.RecordFiles)
    df = spark.read.format("record_files").option("path", path)
    assert df.load().rdd.getNumPartitions() == 1
    assert sorted(r.record for r in df.option("bytes", size // 7).load().collect()) == sorted(f'[Event "e{k}"]\n\n1. e4 1-0' for k in range(300))


def test_a_partition_reads_no_headers_beyond_its_records(tmp_path, monkeypatch):
    path, looked = many(tmp_path / "a.zst", 300), []
    found = R._frame_end
    first = R.partitions_of(path, 0, (tmp_path / "a.zst").stat().st_size, 1)[0]
    monkeypatch.setattr(R, "_frame_end", lambda *at: looked.append(at) or found(*at))
    made = [f'[Event "e{k}"]\n\n1. e4 1-0' for k in range(2)]  # the gap before the second begins in the first frame
    assert [r.strip() for r in R.records_in(first, 1 << 31)] == made
    assert len(looked) <= 4
