import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.session import cut, cut_table
from marlstone.sources import files, records, sinks


def write(path, lines):
    path.write_text("\n".join(json.dumps(x) if isinstance(x, dict) else x for x in lines), encoding="utf-8")
    return str(path)


def test_json_lines(spark, tmp_path):
    ok = write(tmp_path / "a.jsonl", [{"source_id": "s", "chunk_id": "c", "text": "t", "metadata": {"privacy_lane": "generic"}}, "", {"source_id": "s", "chunk_id": "d", "text": "u"}])
    df = records.scan_json_lines(spark, ok, records.CORPUS, ["chunk_id"])
    assert df.count() == 2 and records.require_unique(df, "chunk_id").count() == 2
    assert records.scan_json_lines(spark, str(tmp_path / "none.jsonl"), records.CORPUS).count() == 0
    for bad in ([{"chunk_id": "c", "other": 1}], ["no json"], [{"source_id": "s"}]):
        with pytest.raises(records.InvalidInput):
            records.scan_json_lines(spark, write(tmp_path / "b.jsonl", bad), records.CORPUS, ["chunk_id"])


def test_lanes(spark):
    g = spark.createDataFrame([("a", "generic")], "chunk_id string, privacy_lane string")
    p = spark.createDataFrame([("b", "personal")], "chunk_id string, privacy_lane string")
    both = records.scoped_corpus(g, p)
    assert records.in_scope(both, "all").count() == 2 and records.in_scope(both, "personal").count() == 1
    with pytest.raises(records.InvalidInput):
        records.scoped_corpus(g, g)
    with pytest.raises(Exception, match="unknown lane"):
        records.in_scope(spark.createDataFrame([("a", "odd")], "chunk_id string, privacy_lane string"), "all").collect()


def test_ratings(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("﻿item_id,clarity,coverage\ni1,15,0\ni2,3,30\n", encoding="utf-8")
    assert records.scan_ratings(spark, str(f), {"clarity": 15, "coverage": 30}).count() == 2
    for row in ("i1,16,0", "i1,03,0", "i1,-1,0", "i1,,0", "i1,1.5,0"):
        f.write_text(f"item_id,clarity,coverage\n{row}\n", encoding="utf-8")
        with pytest.raises(records.InvalidInput):
            records.scan_ratings(spark, str(f), {"clarity": 15, "coverage": 30})
    f.write_text("item_id,coverage,clarity\ni1,1,1\n", encoding="utf-8")
    with pytest.raises(records.InvalidInput):
        records.scan_ratings(spark, str(f), {"clarity": 15, "coverage": 30})


def test_duplicate_keys(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":{"b":1}}',), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(records.duplicate_keys(F.col("t"))).collect()] == [True, False, None, None]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 一\n甲\n\n乙", encoding="utf-8")
    (tmp_path / "b.txt").write_text("甲\r\n\r\n乙", encoding="utf-8")
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "empty.txt").write_text(" \n", encoding="utf-8")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>章</w:t></w:r></w:p><w:p><w:r><w:t>文</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    rows = files.scan_files(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["section"], r["text"], r["block_type"], r["error"]))
    assert by["a.md"] == [("一", "甲", "paragraph", None), ("一", "乙", "paragraph", None)]
    assert [x[1] for x in by["b.txt"]] == ["甲", "乙"] and by["c.docx"] == [("章", "文", "paragraph", None), ("章", "a | b", "table", None)]
    assert by["bad.pdf"][0][3] and by["empty.txt"][0][3]
    assert files.file_hashes(spark, str(tmp_path)).count() == 5


def test_publish(spark, tmp_path):
    root = str(tmp_path / "store")
    a = spark.range(3)
    first = sinks.publish({"t": a}, root)
    assert sinks.published(spark, root, "t").count() == 3

    def refuse(tables):
        raise ValueError("no")

    with pytest.raises(ValueError):
        sinks.publish({"t": spark.range(9)}, root, refuse)
    assert sinks.published(spark, root, "t").count() == 3
    assert sinks.publish({"t": spark.range(5)}, root) != first and sinks.published(spark, root, "t").count() == 5


def test_bundles():
    a = sinks.bundle({"b.jsonl": ["1"], "a.jsonl": ["2", "3"]})
    assert a == sinks.bundle({"a.jsonl": ["2", "3"], "b.jsonl": ["1"]}) and sinks.verify_bundle(a) == []


def test_users_and_packs(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "u int, v string")
    kept, counts = sinks.without_user({"t": (t, "u")}, 1)
    assert kept["t"].count() == 2 and counts.first()["deleted"] == 1
    pack = sinks.blind_pack(t.where("u is not null").withColumn("secret", F.lit("s")), "u", ["v"], ["clarity"], "seed")
    assert pack.columns == ["u", "v", "clarity"] and pack.count() == 2


def test_cuts(spark):
    assert cut(spark.range(4)).count() == 4 and cut_table(spark.range(4)).agg(F.sum("id")).first()[0] == 6
