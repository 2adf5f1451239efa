import csv
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairforge.sources import quoted_csv, readers

NAMES = ["primary_Accession", "protein_sequence", "[final]text_caption", "pfam_label"]


def expected(path):
    with open(path, newline="") as f:
        return [tuple(r.get(c) for c in NAMES) for r in csv.DictReader(f)]


@given(st.lists(st.text(alphabet=st.sampled_from('a",\n\r x'), max_size=40), max_size=6), st.lists(st.integers(0, 60), max_size=8))
@settings(max_examples=400, deadline=None)
def test_records_of_any_ranges_are_those_of_a_csv_reader(parts, cuts):
    """Any text, quotes and line ends where they may stand, cut into ranges of whole lines: notes fold, pieces meet."""
    text = "".join(parts)
    text += "\n" if text and not text.endswith("\n") else ""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    edges = sorted({0, len(lines), *(c % (len(lines) + 1) for c in cuts)})
    ranges = [lines[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    entry, open_text, got = False, None, []
    for rows in ranges:
        both = [quoted_csv.Reading(False, 1 << 20), quoted_csv.Reading(True, 1 << 20)]
        known = quoted_csv.Reading(entry)
        records = []
        for line in rows:
            for piece in quoted_csv.pieces(line):
                for r in both:
                    r.add(piece)
                if (x := known.add(piece)) is not None:
                    records.append(x)
        note = both[entry].note(0)
        assert note["n"] == known.n and note["ends_inside"] == known.inside and not note["cut"]
        if note["head"] is not None:
            open_text += note["head"]
            if not (note["ends_inside"] and note["tail"] is None):
                got.append(open_text)
                open_text = None
        got += records
        if note["tail"] is not None:
            open_text = note["tail"]
        entry = note["ends_inside"]
    if open_text is not None:
        got.append(open_text)
    want = [r for r in csv.reader(_lines(text)) if r]
    assert [next(csv.reader([x])) for x in got] == want


def _lines(text):
    """Lines as a file opened without translation gives them."""
    out, line = [], ""
    for k, c in enumerate(text):
        line += c
        if c == "\n" or c == "\r" and text[k + 1 : k + 2] != "\n":
            out.append(line)
            line = ""
    return out + ([line] if line else [])


def written(path, rng, n):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(NAMES)
        for k in range(n):
            text = "".join(rng.choice(["word", " ", ",", '"', "\n", "\r\n", "\n\n", "é"]) for _ in range(rng.randint(0, 60)))
            out.writerow([f"K{k}", rng.choice(["MKV", "", 'A"C']), text * rng.choice([1, 1, 1, 9]), rng.choice(["", "['PF1']"])])
            if rng.random() < 0.05:
                f.write("\r\n")


@pytest.mark.parametrize("piece,ranges", [(1 << 20, 1 << 18), (40, 1 << 18), (1 << 20, 0)])
def test_one_file_is_read_in_many_ranges(spark, tmp_path, monkeypatch, piece, ranges):
    """Quoted line ends, escaped quotes, blank lines, cells longer than a range; two files follow one another."""
    rng = random.Random(4)
    for name in ("a.csv", "b.csv"):
        written(tmp_path / name, rng, 700)
    (tmp_path / "c.csv").write_text('pfam_label,primary_Accession,"[final]text_caption",protein_sequence\nx,stray,5" nail and 6" nail,"q"\nonly,short\n')
    want = expected(tmp_path / "a.csv") + expected(tmp_path / "b.csv") + [("stray", "q", '5" nail and 6" nail', "x"), ("short", None, None, "only")]
    monkeypatch.setattr(quoted_csv, "MOST_RANGES", ranges)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = quoted_csv._lines(spark, str(tmp_path / "a.csv"))
        assert len({r.block for r in lines.select("block").distinct().collect()}) >= 8 and lines.rdd.getNumPartitions() >= 8
        got = quoted_csv.read_records(spark, str(tmp_path), NAMES[:3], ("pfam_label",), most_piece=max(piece, 70)).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r)[1:] for r in got] == want and [r.row_idx for r in got] == list(range(len(want)))


def test_pairs_of_a_folder_and_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_pairs(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text(",".join(NAMES))
    assert readers.read_pairs(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "open.csv").write_text(",".join(NAMES) + '\nk,p,"never closed\nlast,,\n')
    assert [tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "open.csv")).collect()] == [(0, "k", "p", "never closed\nlast,,\n", None)]
