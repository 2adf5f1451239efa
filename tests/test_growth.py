"""Work of tasks that must not grow faster than the input."""

from pairforge.plans import packed

SF = "/root/testdata/sf0.001"


def test_csv_files_grow_in_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packed, "FILE_CHARS", 20000)
    monkeypatch.setattr(packed, "folder", lambda *_: str(tmp_path / "csv"))
    rows = packed.csv_ranges(spark, SF).count()
    assert rows == 200 and len(list((tmp_path / "csv").glob("part-*"))) > 3
