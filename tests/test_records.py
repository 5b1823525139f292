"""The record source: frames from headers alone, records across frames, batches and streams."""

import numpy as np
import pytest
import zstandard

from gradus.sources import records as R


def squeezed(text, cuts, **more):
    ends = [0, *cuts, len(text)]
    return b"".join(zstandard.ZstdCompressor(level=1, **more).compress(text[a:b]) for a, b in zip(ends, ends[1:]))


def sample(n, seed=1):
    draw = np.random.default_rng(seed)
    made = [f'[Event "e{k} é"]\n[White "w"]\n\n1. e4 {"x" * int(draw.integers(0, 300))} 1-0' for k in range(n)]
    return made, ("\n\n".join(made) + "\n").encode()


def test_frames_are_found_without_decompressing(tmp_path):
    made, text = sample(60)
    path, skipped = tmp_path / "a.zst", (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
    streamed = zstandard.ZstdCompressor(write_checksum=True).compressobj()
    parts = [squeezed(text[:900], []), skipped, squeezed(text[900:1000], [], write_content_size=False), streamed.compress(text[1000:5000]) + streamed.flush(), squeezed(b"a" * 500_000, [], write_checksum=True), squeezed(np.random.default_rng(0).bytes(400_000), [])]
    path.write_bytes(b"".join(parts))
    ends = np.cumsum([len(p) for p in parts]).tolist()
    want = [(e - len(p), e) for p, e in zip(parts, ends) if p is not skipped]
    assert R.frames_of(str(path)) == want and R.frames_of(str(path), ends[1]) == want[1:]
    path.write_bytes(b"".join(parts)[:-3])  # the last frame has not been written whole
    assert R.frames_of(str(path)) == want[:-1]
    path.write_bytes(b"no frame here")
    with pytest.raises(ValueError):
        R.frames_of(str(path))


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_records_across_frames(tmp_path, monkeypatch, piece):
    """Wherever frames are cut, every record comes once, from one partition."""
    monkeypatch.setattr(R, "PIECE", piece)
    made, text = sample(25)
    draw, path = np.random.default_rng(5), tmp_path / "a.zst"
    starts = [i for i in range(len(text)) if text.startswith(b"\n\n[Event ", i)]
    near = [i + d for i in starts[3:8] for d in range(10)]  # cuts inside the mark of a start
    for cuts in ([], near, sorted(draw.integers(0, len(text), 40).tolist()), sorted(draw.integers(0, len(text), 3).tolist()), [10, 11, 12]):
        path.write_bytes(squeezed(text, cuts))
        for frames in (1, 3):
            parts = R.partitions_of(str(path), 0, path.stat().st_size, frames)
            got = [r.strip() for p in parts for r in R.records_in(p, 1 << 31) if r.strip()]
            assert got == made


def test_batch_and_line_ends(spark, tmp_path):
    made, text = sample(200)
    spark.dataSource.register(R.RecordFiles)
    (tmp_path / "a.zst").write_bytes(squeezed(text, list(range(1000, len(text), 3000))))
    (tmp_path / "b.zst").write_bytes(squeezed(text.replace(b"\n", b"\r\n"), list(range(777, len(text), 2500))))
    (tmp_path / "c.zst").write_bytes(b"")
    df = spark.read.format("record_files").option("path", str(tmp_path / "*.zst")).option("frames", 2).load()
    assert df.rdd.getNumPartitions() > 8
    assert sorted(r.record for r in df.collect()) == sorted(made * 2)


def test_stream_restarts_without_loss(spark, tmp_path):
    spark.dataSource.register(R.RecordFiles)
    first, second, third = ([f'[Event "{n}{k}"]\n\n1. e4 1-0' for k in range(30)] for n in "abc")
    joined = lambda made: ("\n\n".join(made) + "\n\n").encode()
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("record_files").option("path", str(tmp_path / "in" / "*.zst")).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets")).option("path", str(tmp_path / "out")).trigger(once=True).start()
        query.awaitTermination(120)
        return sorted(r.record for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in" / "1.zst").write_bytes(squeezed(joined(first), [100, 101, 400]))
    assert run() == sorted(first)
    with open(tmp_path / "in" / "1.zst", "ab") as file:  # frames are appended, a file arrives
        file.write(squeezed(joined(second), [200]))
    (tmp_path / "in" / "2.zst").write_bytes(squeezed(joined(third), [50]))
    assert run() == sorted(first + second + third)
    assert run() == sorted(first + second + third)


def test_ingest_of_frames(spark, tmp_path):
    """Frames that are appended between two runs are ingested once, each run as a batch of its own."""
    from gradus.streaming import ingest

    game = '[Event "e{}"]\n[Result "1-0"]\n[WhiteElo "1500"]\n[BlackElo "{}"]\n\n1. e4 e5 2. d4 d5 3. c4 1-0\n\n'
    (tmp_path / "in").mkdir()
    for batch in range(3):
        text = "".join(game.format(k, k % 2 * 1400) for k in range(10 * batch, 10 * batch + 10)).encode()
        with open(tmp_path / "in" / "a.zst", "ab") as file:
            file.write(squeezed(text, [33, 200, 400]))
        ingest.ingest_stream(spark, str(tmp_path / "in" / "*.zst"), str(tmp_path / "out"), str(tmp_path / "offsets"), zstd_frames=True).awaitTermination(120)
        seen = [(r.input_rows, r.usable, r.skipped) for r in ingest.ingest_progress(spark, str(tmp_path / "out")).orderBy("batch").collect() if r.input_rows]
        assert seen == [(10, 5, 5)] * (batch + 1)
    skipped = ingest.ingested(spark, str(tmp_path / "out"), "skipped")
    assert {r.skip_detail for r in skipped.collect()} == {"W=1500 B=0"} and skipped.count() == 15
