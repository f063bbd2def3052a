"""CSV in byte ranges against the one-task read."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from mailbench.sources import labeled_csv_rejects, read_labeled_csv
from mailbench.sources.records import INSIDE, OUTSIDE, after_line, csv_records, lines_of

PARTS = ['"', '""', '"""', ",", "\n", "\n\n", "a", "é", "x,y", '"\n"', " ", "'", "end.", "\t"]


def sheet(seed, rows, newline="\n"):
    """A file with quoted line ends, doubled quotes and commas nearly everywhere, and empty lines between records."""
    rng = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(["label", "text", "subject"])
    for i in range(rows):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))).replace("\n", newline)
        writer.writerow([rng.randint(0, 1), f"t{i}{text}", rng.choice(["", "s", '"', f"a{newline}b"])])
        if rng.random() < 0.1:
            out.write(newline)
    return out.getvalue()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("range_bytes", [1, 64, 1000])
def test_same_rows_as_one_task(spark, tmp_path, newline, range_bytes):
    path = tmp_path / "a.csv"
    path.write_bytes(sheet(range_bytes, 14 if range_bytes < 64 else 120, newline).encode())
    whole = rows_of(read_labeled_csv(spark, str(path), range_bytes=None))
    found = rows_of(read_labeled_csv(spark, str(path), range_bytes=range_bytes))
    assert found == whole and [r[0] for r in found] == list(range(len(whole)))


def test_more_than_one_task_and_stable_numbers(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(sheet(5, 400).encode())
    df = csv_records(spark, str(path), 2000)
    assert len({r[0] for r in df.selectExpr("spark_partition_id()").distinct().collect()}) > 1
    one, two = (rows_of(read_labeled_csv(spark, str(path), range_bytes=n)) for n in (2000, 3333))
    assert one == two == rows_of(read_labeled_csv(spark, str(path), range_bytes=None))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b'"', b'""', b",", b"a", b"\n", b"\n", b" "]), max_size=30).map(b"".join), st.integers(1, 40))
def test_ranges_follow_each_other(text, size):
    """States and lines at the borders, by going through the whole text from its beginning."""
    every, state, at, want = text.split(b"\n"), OUTSIDE, 0, []
    if not every[-1]:
        every.pop()
    for line in every:
        want.append((at, line, state))
        state, at = after_line(line, state), at + len(line) + 1
    got, begun = [], OUTSIDE
    for start in range(0, max(len(text), 1), size):
        ends = [OUTSIDE, INSIDE]
        for line, own in lines_of(io.BytesIO(text), start, start + size, 7):
            if not own:
                break
            got.append((line, ends[begun]))
            ends = [after_line(line, s) for s in ends]
        begun = ends[begun]
    assert got == [(line, state) for _, line, state in want]


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", OUTSIDE, INSIDE), (b'"a', INSIDE, OUTSIDE), (b'"a"', OUTSIDE, OUTSIDE), (b'a"b,c', OUTSIDE, OUTSIDE), (b'""', OUTSIDE, INSIDE),
    (b'x,"a ""b""', INSIDE, OUTSIDE), (b'"""', INSIDE, OUTSIDE), (b'x","y', INSIDE, INSIDE), (b'a,"', INSIDE, OUTSIDE), (b"", OUTSIDE, INSIDE)])
def test_after_line(line, outside, inside):
    assert (after_line(line, OUTSIDE), after_line(line, INSIDE)) == (outside, inside)


def test_stray_quotes_in_plain_fields(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('text,label\nsay "hi,1\n5" long,0\n"q, ""x""\nz",1\nend,0\n')
    want = rows_of(read_labeled_csv(spark, str(path), range_bytes=None))
    for size in (1, 5, 11, 1000):
        assert rows_of(read_labeled_csv(spark, str(path), range_bytes=size)) == want
    assert len(want) == 4


def test_long_fields_and_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    long = "line one\nline \"\"two\"\"\n" * 20_000
    path.write_bytes(b"\xef\xbb\xbf" + f'text,label\n"{long}",1\nshort,0\n'.encode())
    for size in (50_000, 1 << 26):
        rows = rows_of(read_labeled_csv(spark, str(path), range_bytes=size))
        assert [(r[0], len(r[3]), r[4]) for r in rows] == [(0, len(long) - 40_000, 1), (1, 5, 0)]


@pytest.mark.parametrize("body", ["text,label\na,1,zz\nb,0\n", "text,label,x\na,1\nb,0,c\n", 'text,label\na,1\n"open,0\n'])
def test_rows_of_wrong_length_fail_whatever_is_selected(spark, tmp_path, body):
    (tmp_path / "bad.csv").write_text(body)
    for size in (4, 1 << 20):
        df = read_labeled_csv(spark, str(tmp_path / "bad.csv"), range_bytes=size)
        for columns in (["text"], ["label"], ["email_id"], df.columns):
            with pytest.raises((Py4JJavaError, PySparkException)):
                df.select(*columns).collect()


def test_files_of_a_folder(spark, tmp_path):
    """Each file has its header; one that differs fails; rejects come by the same ranges."""
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"{i} x.csv").write_text(f'id,text,label\n{2 * i},"a\nb",1\n\n{2 * i + 1},c,x\n')
    for size in (3, 1 << 20):
        rows = rows_of(read_labeled_csv(spark, str(tmp_path / "d"), "id", strict=False, range_bytes=size))
        assert [(r[0], r[3]) for r in rows] == [(0, "a\nb"), (2, "a\nb"), (4, "a\nb")]
        assert sorted(r["email_id"] for r in labeled_csv_rejects(spark, str(tmp_path / "d"), "id", range_bytes=size).collect()) == [1, 3, 5]
    (tmp_path / "d" / "z.csv").write_text("id,label,text\n7,1,a\n")
    with pytest.raises((Py4JJavaError, PySparkException)):
        read_labeled_csv(spark, str(tmp_path / "d"), "id").collect()
