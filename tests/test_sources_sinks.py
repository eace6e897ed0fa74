import glob
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from pagestream.operators import categories, ordering
from pagestream.plans import dumps
from pagestream.plans import expansion
from pagestream.sources import files, json_objects, topics
from pagestream.streaming import sinks


def test_kafka_options():
    assert topics.kafka_options("h:1", topics.RESULT_TOPICS, minPartitions="8") == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "top_resource,top_resource_sliding,event_top_categories,event_wikitype",
        "failOnDataLoss": "false",
        "minPartitions": "8",
    }
    assert topics.kafka_options("h:1", "wikistream", fail_on_data_loss=True)["failOnDataLoss"] == "true"


def test_kafka_sink_options():
    class Writer:
        seen = {}

        def format(self, name):
            self.seen["format"] = name
            return self

        def option(self, key, value):
            self.seen[key] = value
            return self

    assert sinks.kafka_sink("h:1", "t")(Writer()).seen == {
        "format": "kafka", "kafka.bootstrap.servers": "h:1", "topic": "t"
    }


def test_kafka_messages_become_results(spark, rows):
    messages = spark.createDataFrame(
        [("top_resource", bytearray(b"k"), bytearray(b"5"), 3, 0, None)],
        "topic string, key binary, value binary, offset long, partition int, timestamp timestamp",
    )
    assert rows(topics.kafka_results(messages)) == [("top_resource", "k", "5", 3, None)]


def _dump(folder):
    folder.mkdir()
    (folder / "a").write_text('p\t"Heroes" (x)\tlink\t3\n\tback\\slash\tother\t1\n')
    (folder / "b").write_text("#p\tcommas, too\tlink\t-2\n")
    return str(folder)


def test_all_files_of_a_folder_are_scanned_raw(spark, rows, tmp_path):
    assert set(rows(files.scan_views(spark, _dump(tmp_path / "dump")))) == {
        ("", "back\\slash", "other", 1), ("#p", "commas, too", "link", -2),
        ("p", '"Heroes" (x)', "link", 3),
    }


def test_single_views_do_not_depend_on_the_number_of_tasks(spark, rows, setting, tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    for name in "ab":
        (folder / name).write_text("".join(f"p{i % 7}\tc{i % 5}\tlink\t{i % 4 - 1}\n" for i in range(400)))
    found = []
    for tasks in (2, 8):
        setting("spark.sql.leafNodeDefaultParallelism", tasks)
        setting("spark.sql.files.maxPartitionBytes", 4096 // tasks)
        views = expansion.with_row_id(files.scan_views(spark, str(folder)))
        labels = spark.createDataFrame([("c1", "x")], "title string, category string")
        found.append(rows(expansion.single_views(views, labels)))
    assert found[0] == found[1]
    assert len(found[0]) == 2 * sum(max(0, i % 4 - 1) for i in range(400))
    assert len({r[-2] for r in found[0]}) <= 35


def test_an_empty_count_fails_or_drops(spark, tmp_path):
    (tmp_path / "bad").write_text("a\tb\tc\t\na\tb\tc\t1\n")
    path = str(tmp_path / "bad")
    with pytest.raises(Exception, match="MALFORMED"):
        files.scan_views(spark, path).count()
    assert files.scan_views(spark, path, on_malformed="DROPMALFORMED").count() == 1


def test_compact_pretty_and_broken_json_objects(spark, tmp_path):
    (tmp_path / "events").write_text(
        '{"type": "edit", "id": 1}\n{"type": "edit", "id": 2}\n{\n  "type": "log",\n  "meta": {\n    "id": "x"\n  },\n  "id": 3\n}\n'
        '{"type": \n{"type": "edit", "id": 4}\n{"id": 5}\n'
    )
    got = json_objects.scan_json_objects(spark, str(tmp_path / "events"))
    assert sorted(r[0] for r in got.select("e.id").collect()) == [1, 2, 3, 4]


def test_malformed_dump_lines_fail_or_drop(spark, tmp_path):
    (tmp_path / "bad").write_text("a\tb\tc\tx\na\tb\tc\t1\n")
    path = str(tmp_path / "bad")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.scan_views(spark, path).collect()
    assert files.scan_views(spark, path, on_malformed="DROPMALFORMED").count() == 1


def test_quoted_scan(spark, tmp_path):
    (tmp_path / "q").write_text('"a ""x"""\tb\tc\t1\n')
    assert files.scan_views(spark, str(tmp_path / "q"), quoted=True).first()["prev"] == 'a "x"'


def test_gzip_dump_is_spread_after_the_scan(spark, tmp_path):
    with gzip.open(tmp_path / "d.tsv.gz", "wt") as out:
        out.writelines(f"p\tc{i}\tlink\t{i}\n" for i in range(500))
    rows = files.scan_compressed_views(spark, str(tmp_path / "d.tsv.gz"), 6)
    assert rows.count() == 500
    assert rows.select(F.spark_partition_id()).distinct().count() == 6


def test_views_written_raw_read_back_equal(spark, rows, tmp_path):
    data = files.scan_views(spark, _dump(tmp_path / "dump"))
    sinks.write_views(data, str(tmp_path / "out"))
    assert rows(files.scan_views(spark, str(tmp_path / "out"))) == rows(data)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["128MB", "200"])
def test_concatenated_json(spark, rows, tmp_path, setting, newline, split):
    setting("spark.sql.files.maxPartitionBytes", split)
    setting("spark.sql.files.openCostInBytes", "0")
    document = """{
    "id": %d,
    "type": "edit",
    "comment": "not an end: }{ \\"",
    "length": {
        "old": 1,
        "new": %d
    }
}
"""
    whole = "".join(document % (i, i * 2) for i in range(20)).rstrip("\n")
    (tmp_path / "events.json").write_bytes(whole.replace("\n", newline).encode())
    got = json_objects.scan_json_objects(spark, str(tmp_path / "events.json"))
    assert rows(got.select("e.id", "e.type", "e.length.new")) == sorted(
        [(i, "edit", i * 2) for i in range(20)], key=repr
    )


LAYOUTS = {
    "side by side": lambda o: json.dumps(o),
    "blanks": lambda o: "  " + json.dumps(o) + " \t ",
    "lines": lambda o: json.dumps(o) + "\n",
    "indented": lambda o: "\n    " + json.dumps(o, indent=4).replace("\n", "\n    "),
    "unindented": lambda o: json.dumps(o, indent=0) + "\n",
    "braces first": lambda o: json.dumps(o, indent=0).replace(": {", ":\n{") + "\n\n",
}


@pytest.mark.parametrize("split", ["128MB", "61", "7"])
def test_json_objects_of_every_layout(spark, tmp_path, setting, split):
    setting("spark.sql.files.maxPartitionBytes", split)
    setting("spark.sql.files.openCostInBytes", "0")
    texts = ['}{ "', '\\"}\\', "} {\n{", "", '"', "\\", "a } { b", "ü}{"]
    rng, expected = random.Random(12), []
    for number, layouts in enumerate([[k] for k in LAYOUTS] + [list(LAYOUTS)] * 3):
        whole = ""
        for k in range(12):
            event = {"id": number * 100 + k, "type": "edit", "comment": rng.choice(texts), "length": {"old": k, "new": 2}}
            expected.append((event["id"], event["comment"]))
            whole += LAYOUTS[rng.choice(layouts)](event)
        (tmp_path / f"f{number}.json").write_bytes(whole.rstrip("\n" if number % 2 else "").encode())
    got = json_objects.scan_json_objects(spark, str(tmp_path)).select("e.id", "e.comment").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert json_objects.broken_json_objects(spark, str(tmp_path)).count() == 0
    numbers = json_objects.scan_json_texts(spark, str(tmp_path)).groupBy("file").agg(F.sort_array(F.collect_list("number")))
    assert all(r[1] == list(range(12)) for r in numbers.collect())


def test_json_splits_are_dealt_to_partitions_that_grow_with_them(spark, tmp_path, setting, monkeypatch):
    monkeypatch.setattr(json_objects, "_BYTES_EACH", 500)
    setting("spark.sql.files.maxPartitionBytes", "1000")
    setting("spark.sql.files.openCostInBytes", "0")
    (tmp_path / "a.json").write_text("".join('{"id": %d, "comment": "x {y}"}\n' % i for i in range(1000)))
    splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    texts = json_objects.scan_json_texts(spark, str(tmp_path))
    assert splits > 20 and texts.rdd.getNumPartitions() >= 2 * splits
    assert [r["number"] for r in texts.orderBy("number").collect()] == list(range(1000))


def test_broken_json_objects_are_told_by_number(spark, tmp_path):
    (tmp_path / "events").write_text('{"type": "edit", "id": 1} {"type": edit} {"id": 3, "type": "log"}{"type": "edit", "id": ')
    (tmp_path / "blank").write_text(" \n")
    (tmp_path / "empty").write_text("")
    got = json_objects.scan_json_objects(spark, str(tmp_path))
    assert sorted(r[0] for r in got.select("e.id").collect()) == [1, 3]
    broken = json_objects.broken_json_objects(spark, str(tmp_path)).orderBy("number").collect()
    assert [(r["number"], r["value"].strip()) for r in broken] == [(1, '{"type": edit}'), (3, '{"type": "edit", "id":')]


def test_compressed_json_objects(spark, tmp_path):
    with gzip.open(tmp_path / "e.json.gz", "wt") as out:
        out.write("".join('{"type": "edit", "id": %d} ' % i for i in range(300)))
    assert json_objects.scan_json_objects(spark, str(tmp_path)).count() == 300


def test_indexed_csv(spark, tmp_path):
    data = spark.createDataFrame([('say "x", y', "b"), ("a", None)], "prev string, category string")
    sinks.write_indexed_csv(
        ordering.numbered(ordering.in_order(data, "prev")).coalesce(1), str(tmp_path / "csv")
    )
    text = open(glob.glob(f"{tmp_path}/csv/*.csv")[0]).read()
    assert text == ',prev,category\n0,a,\n1,"say ""x"", y",b\n'


def test_csv_files_follow_the_global_order(spark, tmp_path):
    data = spark.range(5000).selectExpr("uuid() as prev", "id as row_id").repartition(6).checkpoint()
    sinks.write_indexed_csv(ordering.numbered(ordering.in_order(data, "prev", "row_id")), str(tmp_path / "csv"))
    names = sorted(glob.glob(f"{tmp_path}/csv/part-*.csv"))
    rows = [line.rstrip("\n").split(",") for name in names for line in open(name).readlines()[1:]]
    assert [int(r[0]) for r in rows] == list(range(5000))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_split_files_hold_at_most_n_lines(spark, tmp_path):
    dumps.split_dump(spark.range(1050).selectExpr("string(id) as value"), str(tmp_path / "split"), 100)
    sizes = [len(open(f).readlines()) for f in glob.glob(f"{tmp_path}/split/part-*")]
    assert sum(sizes) == 1050 and max(sizes) <= 100


@pytest.mark.parametrize("split", ["128MB", "700"])
def test_split_files_hold_exactly_n_lines_in_order(spark, tmp_path, setting, split):
    setting("spark.sql.files.maxPartitionBytes", split)
    setting("spark.sql.files.openCostInBytes", "0")
    lines = [f"line {i} " + "x" * (i * 31 % 57) + (" é" if i % 9 else "") for i in range(1037)]
    (tmp_path / "dump").mkdir()
    for name, (a, b) in {"b": (300, 1037), "a": (0, 299), "a1": (299, 300)}.items():
        (tmp_path / "dump" / name).write_text("".join(f"{x}\n" for x in lines[a:b]))
    dumps.split_files(spark, str(tmp_path / "dump"), str(tmp_path / "split"), 100)
    found = [open(f).read().splitlines() for f in sorted(glob.glob(f"{tmp_path}/split/part-*"))]
    assert [len(f) for f in found] == [100] * 10 + [37] and sum(found, []) == lines
    numbered = files.numbered_lines(spark, str(tmp_path / "dump"))
    sinks.write_numbered_lines(numbered, str(tmp_path / "few"), 100, most_tasks=3)
    found = [open(f).read().splitlines() for f in sorted(glob.glob(f"{tmp_path}/few/part-*"))]
    assert [len(f) for f in found] == [100] * 10 + [37] and sum(found, []) == lines


def test_file_topics_keep_name_and_batch(spark, rows, tmp_path):
    data = spark.createDataFrame([("k", "1")], "key string, value string")
    for topic in ("top_resource", "event_wikitype", "elsewhere"):
        data.write.parquet(f"{tmp_path}/topic={topic}/batch_id=4")
    assert rows(topics.file_results(spark, str(tmp_path))) == [
        ("event_wikitype", "k", "1", 4, None), ("top_resource", "k", "1", 4, None)
    ]


def test_the_tail_opens_only_the_last_files(spark, rows, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.gz").write_text("no gzip file")
    for name, count in (("b b", 4), ("c", 3), ("d", 2)):
        (tmp_path / "d" / name).write_text("".join(f"{name}{i}\n" for i in range(count)))
    got = [r[0] for r in dumps.last_lines(spark, str(tmp_path / "d"), 4).collect()]
    assert got == ["c1", "c2", "d0", "d1"]
    (tmp_path / "d" / "a.gz").unlink()
    assert [r[0] for r in dumps.last_lines(spark, str(tmp_path / "d"), 7).collect()][:2] == ["b b2", "b b3"]
    assert dumps.last_lines(spark, str(tmp_path / "d"), 99).count() == 9


def test_a_bucketed_table_is_joined_in_place(spark, tmp_path, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    known = spark.range(100).selectExpr("concat('T', id) as title", "'Category:X' as category", "false as hidden")
    sinks.write_bucketed(known, "known_categories", "title", 4, str(tmp_path / "table"))
    edits = spark.range(50).selectExpr("id as timestamp", "'w' as wiki", "concat('T', id) as title")
    joined = categories.with_categories(edits, spark.table("known_categories"))
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    spark.sql("drop table known_categories")
