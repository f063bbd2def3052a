import io
import os
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from mailbench.catalog.fixtures import native_scorers
from mailbench.operators.scorers import score_all
from mailbench.plans.classifiers import archive_dataset
from mailbench.sinks import manifest_of, read_report, reports, write_json, write_report
from mailbench.sources import (
    emails_from_rows,
    labeled_csv_rejects,
    list_folder,
    list_mail_paths,
    parse_mail,
    read_class_folders,
    read_dataset,
    read_emails_json,
    read_files,
    read_labeled_csv,
    read_mail,
    read_texts_json,
    split_rejects,
)
from mailbench.sources import files as files_module
from mailbench.sources import mail as mail_module
from mailbench.sources.mail import read_message


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


# CSV


def test_csv_quoting_order_and_tokens(spark, tmp_path):
    path = put(tmp_path, "a.csv", (
        'label,subject,text,from\n'
        '1,"a, ""b""","line one\nline two",x@y\n'
        '1.0,s,NA,z\n'
        '0,,,\n'
    ))
    rows = read_labeled_csv(spark, path).orderBy("email_id").collect()
    assert [r.asDict() for r in rows] == [
        {"email_id": 0, "sender": "x@y", "subject": 'a, "b"', "text": "line one\nline two", "label": 1},
        {"email_id": 1, "sender": "z", "subject": "s", "text": "NA", "label": 1},
        {"email_id": 2, "sender": None, "subject": None, "text": None, "label": 0},
    ]


def test_csv_minimal(spark, tmp_path):
    rows = read_labeled_csv(spark, put(tmp_path, "m.csv", "text,label\nhello,1\nbye,0\n")).collect()
    assert [tuple(r) for r in rows] == [(0, None, None, "hello", 1), (1, None, None, "bye", 0)]


@pytest.mark.parametrize("body", ["text,label\na,1,zz\nb,0\n", "text,label,x\na,1\nb,0,c\n"])
def test_csv_rows_of_wrong_length_fail(spark, tmp_path, body):
    df = read_labeled_csv(spark, put(tmp_path, "bad.csv", body))
    for columns in (["text"], ["label"], df.columns):
        with pytest.raises((Py4JJavaError, PySparkException)):
            df.select(*columns).collect()


@pytest.mark.parametrize("label", ["", "abc", "2", "-1"])
def test_csv_strict_labels(spark, tmp_path, label):
    path = put(tmp_path, "s.csv", f"text,label\na,1\nb,{label}\n")
    with pytest.raises(PySparkException, match="label is not 0 or 1"):
        read_labeled_csv(spark, path).collect()


def test_csv_lenient_labels(spark, tmp_path):
    path = put(tmp_path, "l.csv", "text,label\na,1\nb,\nc,abc\nd,2\ne,0\n")
    rows = read_labeled_csv(spark, path, strict=False).collect()
    assert [(r.email_id, r.text, r.label) for r in rows] == [(0, "a", 1), (3, "d", 0), (4, "e", 0)]
    assert [(r.text, r.label) for r in labeled_csv_rejects(spark, path).collect()] == [("b", None), ("c", "abc")]


def test_csv_needs_columns_and_a_key_for_many_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no column 'label'"):
        read_labeled_csv(spark, put(tmp_path, "n.csv", "text\na\n"))
    put(tmp_path, "many/1.csv", "id,text,label\n5,a,1\n")
    put(tmp_path, "many/2.csv", "id,text,label\n6,b,0\n")
    with pytest.raises(ValueError, match="key column"):
        read_labeled_csv(spark, str(tmp_path / "many"))
    for multi_line in (True, False):
        rows = read_labeled_csv(spark, str(tmp_path / "many"), "id", multi_line=multi_line).collect()
        assert sorted((r.email_id, r.text) for r in rows) == [(5, "a"), (6, "b")]
    with pytest.raises(ValueError, match="key column"):
        read_labeled_csv(spark, str(tmp_path / "many" / "1.csv"), multi_line=False)


def test_dataset_choice(spark, tmp_path, monkeypatch):
    file, sheet = (put(tmp_path, f"{n}.csv", f"text,label\n{n},1\n") for n in ("file", "sheet"))

    def text(source, uri):
        return read_dataset(spark, source, file, uri).first().text

    assert text("sheet", sheet) == "sheet"
    monkeypatch.setenv("DATA_PATH", sheet)
    assert read_dataset(spark).first().text == "sheet"
    monkeypatch.setenv("DATA_URL", file)
    assert read_dataset(spark, "sheet").first().text == "file"
    monkeypatch.delenv("DATA_URL")
    monkeypatch.delenv("DATA_PATH")
    with pytest.raises(ValueError):
        read_dataset(spark)
    assert text("sheet", None) == text("sheet", "") == text("file", sheet) == text("other", sheet) == "file"


# JSON


def test_json_defaults_and_rejects(spark, tmp_path):
    path = put(tmp_path, "e.json", (
        '{"email_id": 1, "body": "b"}\n'
        '{"email_id": 2, "subject": "s", "sender": "x", "body": ""}\n'
        '{"email_id": 3, "subject": "s"}\n'
    ))
    accepted, rejected = split_rejects(read_emails_json(spark, path))
    assert [tuple(r) for r in accepted.orderBy("email_id").collect()] == [(1, "", "", "b"), (2, "x", "s", "")]
    assert [tuple(r) for r in rejected.collect()] == [(3, "", "s", None)]


def test_nested_request(spark):
    df = spark.createDataFrame(
        [(7, [(None, "s1", "b1"), ("x", None, "b2")])],
        "request_id long, emails array<struct<sender string, subject string, body string>>",
    )
    rows = emails_from_rows(df).collect()
    assert sorted((r.sender, r.subject, r.body) for r in rows) == [("", "s1", "b1"), ("x", "", "b2")]
    assert sorted(r.email_id for r in rows) == ["7:0", "7:1"]


def test_texts_to_predict(spark, tmp_path):
    path = put(tmp_path, "t.json", '{"email_id": 1, "text": "hi"}\n{"email_id": 2}\n')
    assert sorted(map(tuple, read_texts_json(spark, path).collect())) == [(1, "hi"), (2, "")]


# Files


@pytest.fixture
def archive(tmp_path):
    for name in ("_sent/1.", ".h/3.", "in/_2.", "in/a b{x}.", "in/deep/er/4", "0"):
        put(tmp_path, name, f"X: 1\n\n{name}")
    return tmp_path


@pytest.mark.parametrize("walked", [20_000, 1])
def test_every_name_is_listed_and_read(spark, archive, walked, monkeypatch):
    monkeypatch.setattr(files_module, "WALKED_ENTRIES", walked)
    paths = list_mail_paths(spark, str(archive))
    names = {os.path.relpath(r.path, archive) for r in paths.collect()}
    assert names == {"_sent/1.", ".h/3.", "in/_2.", "in/a b{x}.", "in/deep/er/4", "0"}
    (archive / "in/_2.").unlink()
    read = {os.path.relpath(r.path, archive): bytes(r.content) for r in read_files(paths).collect()}
    assert set(read) == names - {"in/_2."} and read["0"] == b"X: 1\n\n0"


def test_missing_root_and_folder(spark, tmp_path):
    assert list_mail_paths(spark, str(tmp_path / "none")).count() == 0
    put(tmp_path, "a/x", "1")
    put(tmp_path, "a/sub/y", "2")
    found = list_folder(spark, str(tmp_path / "a"), str(tmp_path / "none")).collect()
    assert [os.path.basename(r.path) for r in found] == ["x"]


def test_linked_folders_are_not_walked(spark, archive):
    os.symlink(archive / "in", archive / "link")
    assert list_mail_paths(spark, str(archive)).filter(F.col("path").contains("/link/")).count() == 0


def test_file_uris(spark, archive):
    assert read_files(list_mail_paths(spark, f"file://{archive}")).count() == 6


# Mail


MAILS = {
    "plain": (b"From: A <a@x>\nSubject: Hi\n\nbody text\n", ("A <a@x>", "Hi", "body text\n")),
    "html": (b"Subject: H\nContent-Type: text/html\n\n<p>x</p>", ("", "H", "<p>x</p>")),
    "encoded": (b"Content-Transfer-Encoding: base64\n\naGVsbG8=", ("", "", "hello")),
    "bad bytes": (b"Content-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: 8bit\n\na\xffb\xc3\xa9",
                  ("", "", "abé")),
    "parts": (b'Content-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/html\n\n<p>\n--B\n'
              b"Content-Type: text/plain\n\n\n--B\nContent-Type: text/plain\n\nsecond\n--B--\n", ("", "", "second")),
    "no text part": (b'Content-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/html\n\n<p>\n--B--\n',
                     ("", "", "")),
    "empty": (b"", ("", "", "")),
}


def test_parse_mail(spark, tmp_path):
    rows = [(name, raw) for name, (raw, _) in MAILS.items()]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r["from"], r.subject, r.text) for r in parse_mail(df).collect()}
    assert got == {name: fields for name, (_, fields) in MAILS.items()}
    for name, (raw, _) in MAILS.items():
        put(tmp_path, name, raw)
    paths = list_folder(spark, str(tmp_path))
    fused = {os.path.basename(r.path): (r["from"], r.subject, r.text) for r in read_mail(paths).collect()}
    assert fused == got


def test_mail_the_parser_fails_on(spark):
    # Content that is no bytes stands for whatever makes the standard parser raise.
    raw = b"Subject: ok\nContent-Type: text/plain\n\nfine"
    df = spark.createDataFrame([("good", raw), ("bad", None)], "path string, content binary")
    assert [r.path for r in parse_mail(df).collect()] == ["good"]
    kept = {r.path: r for r in parse_mail(df, keep_bad=True).collect()}
    assert kept["good"].error is None and kept["bad"].error and kept["bad"].text is None


def test_class_folders(spark, tmp_path):
    put(tmp_path, "spam/1.txt", b"one\r\ntwo\rthree\xff\n")
    put(tmp_path, "spam/sub/2.txt", b"not read")
    rows = read_class_folders(spark, str(tmp_path)).collect()
    assert [(os.path.basename(r.path), r.subject, r.body, r.label) for r in rows] == [
        ("1.txt", "", "one\ntwo\nthree\n", 1)]
    put(tmp_path, "ham/3.txt", "h")
    assert {(r.body, r.label) for r in read_class_folders(spark, str(tmp_path)).collect()} == {
        ("one\ntwo\nthree\n", 1), ("h", 0)}


# Sinks


def test_report_location_rows_and_no_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", \n b', ""), (2, " pad ", None)], "id int, t string, u string")
    now = datetime(2020, 1, 2, 3, 4, 5)
    written = write_report(df, str(tmp_path), "bulk", "csv", now)
    assert written == (f"{tmp_path}/bulk_20200102_030405", 2)
    back = spark.read.csv(written.location, header=True, multiLine=True, escape='"').orderBy("id").collect()
    assert [r.t for r in back] == ['a "q", \n b', " pad "]
    with pytest.raises(PySparkException, match="PATH_ALREADY_EXISTS"):
        write_report(df, str(tmp_path), "bulk", "csv", now)
    assert write_report(df, str(tmp_path), "benchmark", now=now).rows == 2
    ordered = write_report(df.repartition(2), str(tmp_path), "email_analysis", now=now, order_by="id")
    files = sorted(name for name in os.listdir(ordered.location) if name.startswith("part-"))
    firsts = [spark.read.parquet(f"{ordered.location}/{name}").first() for name in files]
    assert [r.id for r in firsts if r] == sorted(r.id for r in firsts if r)
    with pytest.raises(ValueError):
        write_report(df, str(tmp_path), "other")


def test_json_keeps_nesting(spark, tmp_path):
    df = score_all(spark.createDataFrame([(1, "trash")], "email_id long, text string"), native_scorers())
    write_json(df.select("email_id", F.create_map(F.lit("m1"), F.col("m1")).alias("models")), f"{tmp_path}/out")
    row = spark.read.json(f"{tmp_path}/out").first()
    assert row.models.m1.label == "spam" and row.models.m1.error is None


def test_object_store_paths(tmp_path):
    from pyarrow import fs

    put(tmp_path, "bucket/in/_1.", b"one")
    stores = files_module.Stores()
    stores._opened["s3://bucket"] = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    assert list(stores.readable("s3a://bucket")) == [("s3a://bucket/in", True)]
    assert list(stores.readable("s3a://bucket/in")) == [("s3a://bucket/in/_1.", False)]
    assert stores.read("s3a://bucket/in/_1.") == b"one"
    assert list(stores.readable("s3a://bucket/none")) == []
    with pytest.raises(OSError):
        stores.read("s3a://bucket/none")
    stores.write("s3a://bucket/out/2.", b"two")
    assert (tmp_path / "bucket/out/2.").read_bytes() == b"two"


# Listing and reading that lose nothing


def test_a_task_hands_on_what_it_has_not_entered(spark, tmp_path, monkeypatch):
    for folder in range(5):
        (tmp_path / f"d{folder}").mkdir()
        for name in range(10):
            (tmp_path / f"d{folder}" / f"{name}").write_text("x")
    monkeypatch.setattr(files_module, "WALKED_ENTRIES", 6)
    first = pd.concat(files_module._list_folders(iter([pd.DataFrame({"path": [str(tmp_path)]})])))
    assert (~first.is_folder.astype(bool)).sum() <= 10 and first.is_folder.astype(bool).sum() == 4
    assert list_mail_paths(spark, str(tmp_path)).count() == 50


def test_names_that_are_not_utf8(spark, tmp_path):
    folder = os.fsencode(str(tmp_path)) + b"/caf\xe9"
    os.mkdir(folder)
    for name in (b"/a%41", b"/\xff", "/é".encode()):
        with open(folder + name, "wb") as out:
            out.write(name)
    (tmp_path / "plain").write_text("p")
    paths = list_mail_paths(spark, str(tmp_path))
    assert sorted(bytes(r.content) for r in read_files(paths).collect()) == sorted([b"/a%41", b"/\xff", "/é".encode(), b"p"])


def test_errors_are_tried_again_and_then_raised(monkeypatch):
    monkeypatch.setattr(files_module, "PAUSE_SEC", 0)
    left = [OSError("slow down"), OSError("slow down")]

    def action():
        if left:
            raise left.pop()
        return "read"

    assert files_module.attempted(action) == "read"
    left += [OSError("slow down")] * 9
    with pytest.raises(OSError):
        files_module.attempted(action)
    with pytest.raises(FileNotFoundError):
        files_module.attempted(lambda: open("/nowhere/at/all"))


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "1.csv").write_text("id,subject,text,label\n1,s1,t1,0\n")
    (tmp_path / "b" / "2.csv").write_text("id,text,subject,label\n2,t2,s2,1\n")
    for multi_line in (True, False):
        both = read_labeled_csv(spark, [str(tmp_path / "a"), str(tmp_path / "b")], key="id", multi_line=multi_line)
        assert sorted((r.email_id, r.subject, r.text) for r in both.collect()) == [(1, "s1", "t1"), (2, "s2", "t2")]
        with pytest.raises(Exception):
            read_labeled_csv(spark, str(tmp_path / "*"), key="id", multi_line=multi_line).collect()


def test_keys_of_json_records(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"body": "x", "id": "k1"}\n{"body": "y"}\n')
    derived = read_emails_json(spark, str(path), key=None).collect()
    assert len({r.email_id for r in derived}) == 2 and all(r.email_id for r in derived)
    with pytest.raises(Exception, match="without id"):
        read_emails_json(spark, str(path), key="id", text_keys=True).collect()
    path.write_text('{"body": "x", "id": "k1"}\n')
    assert read_emails_json(spark, str(path), key="id", text_keys=True).first().email_id == "k1"


def test_archive_from_a_table_of_paths(spark, tmp_path):
    (tmp_path / "m1").write_text("Subject: a\n\n" + "long enough text " * 3)
    (tmp_path / "m2").write_text("Subject: b\n\n" + "long enough text " * 3)
    paths = spark.createDataFrame([(str(tmp_path / "m1"),)], "path string")
    assert [r.subject for r in archive_dataset(spark, paths).collect()] == ["a"]


def test_one_large_folder_is_listed_by_several_tasks(spark, tmp_path, monkeypatch):
    """30 000 names in one folder, some of them folders: slices of names, again where a slice is too large; none lost or doubled."""
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(30_000):
        os.close(os.open(flat / f"{i}.eml", os.O_CREAT))
    for i in range(20):
        put(flat, f"sub{i}/x", "1")
    monkeypatch.setattr(files_module, "SPLIT_ENTRIES", 1_000)
    monkeypatch.setattr(files_module, "WALKED_ENTRIES", 2_000)
    held, children = [], files_module.Stores.slice_of
    first = pd.concat(files_module._list_folders(iter([pd.DataFrame({"path": [str(flat)]})])))
    assert len(first) == files_module.SLICES and first.is_folder.all()
    for part, parts in zip(first.part, first.parts):
        found = children(files_module.Stores(), str(flat), part, parts)
        held += found
    assert len(held) == len(set(held)) == 30_020
    direct = {f"{i}.eml" for i in range(30_000)}
    paths = list_folder(spark, str(flat))
    assert sorted(os.path.basename(r.path) for r in paths.collect()) == sorted(direct)
    assert len({r[0] for r in paths.selectExpr("spark_partition_id()").distinct().collect()}) > 1
    assert list_mail_paths(spark, str(tmp_path)).count() == 30_020


def test_reports_are_there_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "concat('a \"q\"\n, ', id) AS text").repartition(4)
    for fmt in ("parquet", "csv"):
        done = write_report(df, str(tmp_path / fmt), "bulk", fmt, datetime(2024, 1, 2))
        assert manifest_of(spark, done.location) == {"kind": "bulk", "format": fmt, "rows": 40, "columns": ["id", "text"]}
        rows = read_report(spark, done.location)
        assert sorted((int(r.id), r.text) for r in rows.collect()) == sorted(map(tuple, df.collect()))
        with pytest.raises(Exception):
            write_report(df, str(tmp_path / fmt), "bulk", fmt, datetime(2024, 1, 2))
        assert manifest_of(spark, done.location)["rows"] == 40
        failing = df.select("id", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("text")).alias("text"))
        with pytest.raises(Exception):
            write_report(failing, str(tmp_path / fmt), "bulk", fmt, datetime(2024, 1, 3))
        assert os.listdir(tmp_path / fmt).count("bulk_20240103_000000") == 0
        with pytest.raises(FileNotFoundError):
            read_report(spark, str(tmp_path / fmt / "bulk_20240103_000000"))


def test_a_store_without_renaming_at_once(spark, tmp_path, monkeypatch):
    """The manifest is the last thing written: a folder without one is no report."""
    real = reports._Folders.write

    def fails(self, path, text):
        raise OSError("lost")

    monkeypatch.setattr(reports._Folders, "renames_at_once", False, raising=False)
    monkeypatch.setattr(reports._Folders, "__setattr__", lambda self, k, v: k == "renames_at_once" or object.__setattr__(self, k, v))
    monkeypatch.setattr(reports._Folders, "write", fails)
    with pytest.raises(OSError):
        write_report(spark.range(3), str(tmp_path), "bulk", now=datetime(2024, 1, 2))
    assert "bulk_20240102_000000" in os.listdir(tmp_path)
    with pytest.raises(FileNotFoundError):
        read_report(spark, str(tmp_path / "bulk_20240102_000000"))
    monkeypatch.setattr(reports._Folders, "write", real)
    assert read_report(spark, write_report(spark.range(3), str(tmp_path), "bulk", now=datetime(2024, 1, 3)).location).count() == 3


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        block = super().read(n)
        self.taken += len(block)
        return block


def mime(*parts, tail=b""):
    body = b"".join(b"--B\nContent-Type: " + kind + b"\n\n" + content + b"\n" for kind, content in parts)
    return b'From: a@x\nSubject: s\nContent-Type: multipart/mixed; boundary="B"\n\n' + body + b"--B--\n" + tail


def test_attachments_behind_the_text_are_not_read():
    attachment = b"QUJD" * 19 + b"\n"
    mail = mime((b"text/html", b"<p>"), (b"text/plain", b""), (b"text/plain", b"the text"), (b"application/pdf", attachment * 400_000))
    file = Counted(mail)
    assert mail_module._fields("p", read_message(file))[1:4] == ("a@x", "s", "the text")
    assert file.taken <= 2 * mail_module.FIRST_BLOCK < len(mail) // 100


def nested(rng, depth=0):
    """A random tree of parts, with lines that look like borders, long lines and empty texts."""
    kinds = [b"text/plain", b"text/html", b"application/octet-stream", b'text/plain; charset="latin-1"']
    lines = [b"--B", b"--B0", b"--B0x", b"--", b"word " * 40, b"", b"From x", b"=E9=", b"QUJD"]
    border = b"B%d" % depth
    parts = []
    for _ in range(rng.randint(0, 4)):
        if depth < 2 and rng.random() < 0.3:
            parts.append(nested(rng, depth + 1))
        else:
            encoding = rng.choice([b"", b"Content-Transfer-Encoding: base64\n", b"Content-Transfer-Encoding: quoted-printable\n"])
            content = b"\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30)))
            parts.append(b"Content-Type: " + rng.choice(kinds) + b"\n" + encoding + b"\n" + content)
    ended = rng.choice([b"--" + border + b"--\n", b"", b"--" + border + b"--\nepilogue\n"])
    return (b"Subject: s%d\nContent-Type: multipart/mixed; boundary=\"" % depth + border + b'"\n\n'
            + b"".join(b"--" + border + b"\n" + p + b"\n" for p in parts) + ended)


def test_reading_in_blocks_gives_what_the_whole_mail_gives():
    rng = random.Random(4)
    samples = [raw for raw, _ in MAILS.values()] + [nested(rng) for _ in range(250)]
    for raw in samples:
        want = mail_module._fields("p", mail_module._parsed(raw))
        for first in (1, 40, 300):
            assert mail_module._fields("p", read_message(io.BytesIO(raw), first)) == want
