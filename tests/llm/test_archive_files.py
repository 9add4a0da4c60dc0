"""Archives as files: round trip, the bytes that are read, runs of records, files of lost attempts."""

from __future__ import annotations

from pathlib import Path

from weekloom.llm import warc

PAGES = "page_id long, url string, html string"
KEYS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")


def _pages(spark, n=300):
    rows = [(i, f"u{i}", f"page {i % 200} " + "".join(chr(97 + (i * i + j * 7) % 26) for j in range(400))) for i in range(n)]
    rows += [(None, None, None), (1000, "u", ""), (7, "again", "page 7"), (7, "again", "page 7")]
    return spark.createDataFrame(rows, PAGES)


def _rows(df):
    return sorted((tuple(r[k] for k in KEYS) for r in df.collect()), key=str)


def test_files_hold_what_stored_rows_hold(spark, tmp_path):
    pages = _pages(spark).repartition(3)
    files = warc.save_archives(pages, f"file://{tmp_path}/a", archive_bytes=20_000)
    assert files.count() > 3
    assert sum(r["n_records"] for r in files.collect()) == pages.count()
    assert all(Path(r["path"].removeprefix("file://")).stat().st_size == r["n_bytes"] for r in files.collect())
    assert _rows(warc.read_files(files, run_bytes=3000)) == _rows(warc.read_archives(warc.write_archives(pages)))
    assert all(r["payload"] is None for r in warc.read_files(files, payloads=False).collect())


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    files = warc.save_archives(_pages(spark, 20).coalesce(1), f"{tmp_path}/a")
    (tmp_path / "a" / "part-000000-0000-999.wacz").write_bytes(b"half a file")
    assert warc.read_files(files).count() == 24


def test_no_pages_and_no_files(spark, tmp_path):
    files = warc.save_archives(_pages(spark).limit(0), f"{tmp_path}/a")
    assert files.count() == 0 and warc.read_files(files).count() == 0


def test_only_ranges_are_read(spark, tmp_path):
    """One record out of many costs the end of the file, the directory, the index and its own bytes."""
    files = warc.save_archives(_pages(spark, 3000).coalesce(1), f"{tmp_path}/a").collect()
    assert len(files) == 1
    with warc.StoredFile(files[0]["path"]) as source:
        listed = warc.members(source)
        begin = warc.data_offset(source, listed[warc.RECORDS])
        entry = list(warc.read_index(source, listed))[1234]
        before = source.bytes_read
        assert before <= 22 + 0xFFFF + 300 + listed[warc.INDEX].size
        warc.read_record(source, begin, int(entry["offset"]), int(entry["length"]))
        assert source.bytes_read - before == int(entry["length"])
        assert source.bytes_read < source.size


def test_index_is_read_in_pieces(spark, tmp_path, monkeypatch):
    files = warc.save_archives(_pages(spark, 200).coalesce(1), f"{tmp_path}/a").collect()
    with warc.StoredFile(files[0]["path"]) as source:
        whole = list(warc.read_index(source, warc.members(source)))
        monkeypatch.setattr(warc, "_INDEX_BYTES", 37)
        assert list(warc.read_index(source, warc.members(source))) == whole
        assert len(whole) == 204
