"""Files as they come: byte order marks, odd columns, missing tracks and members, manifests."""

import gzip
import hashlib
import io
import zipfile

import pytest

from lacuna.operators import cohort
from lacuna.sources import files, readers


def test_a_byte_order_mark_is_no_part_of_the_header(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿case,name\n1,é\n2,\n".encode())
    found = files.read_table(spark, str(tmp_path / "t.csv"))
    assert found.columns == ["case", "name"] and [tuple(r) for r in found.collect()] == [("1", "é"), ("2", None)]
    (tmp_path / "latin.csv").write_bytes("case,name\n1,é\n".encode("latin-1"))
    assert files.read_table(spark, str(tmp_path / "latin.csv"), "ISO-8859-1").first()["name"] == "é"


def track(root, tid, text):
    (root / f"tid={tid}").mkdir(parents=True)
    (root / f"tid={tid}" / "part.csv.gz").write_bytes(gzip.compress(text.encode()))


def test_tracks_are_read_by_position_from_the_first_root(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    track(a, 1, "Time,Anything,More\n0,1.5,x\n2,oops,y\n")
    track(a, 2, "only\n1\n2\n")
    track(b, 1, "t,v\n9,9\n")
    track(b, 3, "t,v\n7,NaN\n8,4\n")
    found = files.read_tracks(spark, str(a), str(b))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("1", 0.0, 1.5), ("1", 2.0, None), ("3", 7.0, None), ("3", 8.0, 4.0)], key=repr)
    wanted = spark.createDataFrame([("1",), ("2",), ("4",)], "tid string")
    assert {r["tid"]: len(r["readings"]) for r in files.tracks_of(found, wanted).collect()} == {"1": 2, "2": 0, "4": 0}


def archive(**members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return bytearray(held.getvalue())


def test_archive_members(spark):
    rows = [(1, archive(**{"x/other.csv": b"0,0", "x/signal.csv": b"\xef\xbb\xbf0,1.5\n1,bad\n2\n"})), (2, archive(**{"signal.csv.gz": gzip.compress(b"3,4\r\n")}))]
    df = spark.createDataFrame(rows, "case_id long, content binary")
    assert sorted(map(tuple, files.archive_member(df, "signal.csv").collect()), key=repr) == sorted([(1, 0.0, 1.5), (1, 1.0, None), (1, 2.0, None), (2, 3.0, 4.0)], key=repr)
    lost = spark.createDataFrame([(5, archive(**{"a.csv": b"1,1"}))], "case_id long, content binary")
    assert files.archive_member(lost, "signal.csv", "empty").count() == 0
    with pytest.raises(Exception, match="archive 5 has no member"):
        files.archive_member(lost, "signal.csv").collect()


def test_manifest_and_its_faults(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "22"), ("c", "333")):
        (tmp_path / name).write_text(text)
    saved = files.settled(files.manifest(spark, str(tmp_path)))
    assert {r["name"]: r["bytes"] for r in saved.collect()} == {"a": 1, "b": 2, "c": 3}
    (tmp_path / "a").write_text("2")
    (tmp_path / "b").rename(tmp_path / "d")
    assert {r["name"]: r["fault"] for r in files.manifest_faults(files.manifest(spark, str(tmp_path)), saved).collect()} == {"a": "changed", "b": "missing", "d": "unexpected"}


def test_manifests_tell_equal_names_apart_and_stay_inside(spark, tmp_path, monkeypatch):
    root, other = tmp_path / "root", tmp_path / "other"
    for d in ("root/a", "root/b", "other"):
        (tmp_path / d).mkdir(parents=True)
    (root / "a" / "x").write_text("1")
    (root / "b" / "x").write_text("2" * 3_000_000)  # more than a buffer
    (other / "y").write_text("3")
    (root / "link").symlink_to(other / "y")
    found = files.manifest(spark, str(root))
    expected = {"a/x": hashlib.sha256(b"1").hexdigest(), "b/x": hashlib.sha256(b"2" * 3_000_000).hexdigest()}
    assert {r["name"]: r["sha256"] for r in found.collect()} == expected
    assert files.manifest_faults(found, files.settled(found)).count() == 0
    only = files.manifest(spark, str(root), [str(root / "a" / "x"), str(other / "y"), str(root / "gone")])
    assert [r["name"] for r in only.collect()] == ["a/x"]
    monkeypatch.setattr(readers, "MOST_FILES", 1)
    assert len(readers.FileDigestReader(str(root)).partitions()) == 2
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        files.manifest(spark, str(root / "nowhere")).collect()


def wave(path, rows, pack=False):
    text = ("time,wave\n" + "".join(f"{t},{v}\n" for t, v in rows)).encode()
    path.write_bytes(gzip.compress(text) if pack else text)


def test_prefixes_of_waveforms(spark, tmp_path):
    (tmp_path / "in").mkdir()
    wave(tmp_path / "in" / "a.csv", [(10 + k / 4, k) for k in range(100_000)])
    wave(tmp_path / "in" / "b.csv.gz", [(0, 5), (0.5, "bad"), (99, 7)], True)  # later times do not count
    wave(tmp_path / "in" / "none.csv", [])
    found = files.wave_prefix(spark, str(tmp_path / "in"), 2.0).collect()
    rows = {f: [(r["idx"], r["sec"], r["value"]) for r in found if r["file"] == f] for f in ("a.csv", "b.csv.gz", "none.csv")}
    assert rows["a.csv"] == [(k, 10 + k / 4, float(k)) for k in range(8)]
    assert rows["b.csv.gz"] == [(0, 0.0, 5.0), (1, 0.5, None), (2, 1.0, 7.0)] and rows["none.csv"] == []
    read = max(r["read_bytes"] for r in found if r["file"] == "a.csv")
    assert read <= readers.BUFFER < (tmp_path / "in" / "a.csv").stat().st_size  # one buffer of a file of over a megabyte
    long = readers.WavePrefixReader({"path": str(tmp_path / "in" / "a.csv"), "end": "5010"})
    last = list(long.read(long.partitions()[0]))[-1]
    assert last[:4] == ("a.csv", 19_999, 10 + 19_999 / 4, 19_999.0) and last[4] < 7 * readers.BUFFER


@pytest.mark.parametrize("rows,what", [([(0, 1)], "one sample"), ([(0, 1), (0, 2)], "interval"), ([(0, 1), (2, 2)], "interval"), ([("x", 1), (1, 2)], "interval")])
def test_waveforms_without_an_interval(spark, tmp_path, rows, what):
    wave(tmp_path / "a.csv", rows)
    with pytest.raises(Exception, match=what):
        files.wave_prefix(spark, str(tmp_path / "a.csv"), 2.0).collect()


def test_tracks_in_shared_files(spark, tmp_path):
    rows = spark.createDataFrame([(t, float(k), float(k) * 2) for t in ("x1", "y/2", "z") for k in range(5)], "tid string, sec double, value double")
    files.write_tracks(rows, str(tmp_path / "t"), 2)
    assert sorted(map(tuple, files.read_tracks(spark, str(tmp_path / "t")).select("tid", "sec", "value").collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "t").glob("*.gz"))) <= 2


def test_digests_of_lists_of_ids(spark):
    rows = [(g, i) for g, n in ((1, 0), (2, 1), (None, 500), (3, 20_000)) for i in range(n)] + [(1, None), (2, None)]
    df = spark.createDataFrame(rows, "g int, id long").repartition(7)
    plain = {g: hashlib.sha256("\n".join(str(i) for i in sorted(i for k, i in rows if k == g and i is not None)).encode()).hexdigest() for g in (1, 2, 3, None)}
    assert {r["g"]: r["digest"] for r in cohort.ids_digest(df, ["g"], "id").collect()} == plain


def test_an_application_forgets_its_own_tables(spark, tmp_path, monkeypatch):
    (tmp_path / "other").mkdir()
    assert files.application_folder(spark).endswith(spark.sparkContext.applicationId)
    monkeypatch.setattr(files, "application_folder", lambda spark: f"file://{tmp_path}/mine")
    assert files.settled(spark.range(3)).count() == 3 and (tmp_path / "mine").exists()
    files.forget(spark)
    files.forget(spark)  # nothing left
    assert [x.name for x in tmp_path.iterdir()] == ["other"]
