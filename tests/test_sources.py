import json

from factloom.sources import landing
from factloom.streaming.ingest import stream_ingest


def test_landing(spark, tmp_path):
    (tmp_path / "coll").mkdir()
    (tmp_path / "coll" / "a.txt").write_text("page one\fpage two")
    (tmp_path / "coll" / "b.txt").write_text("page one\fpage two")
    (tmp_path / "coll" / "empty.txt").write_text("")
    files = landing.scan_directory(spark, str(tmp_path), "*.txt")
    pages = landing.read_pages(files).collect()
    assert [(p.collection, p.page_index, p.text) for p in sorted(pages)] == [("coll", 0, "page one"), ("coll", 1, "page two")]

    def broken(content):
        raise ValueError("no such format")

    assert landing.read_pages(files, broken).first().warning == "ValueError: no such format"


def test_traces_and_export(spark, tmp_path):
    path = str(tmp_path / "trace")
    landing.append_trace(spark.createDataFrame([("llm", 1), ("run", 2)], "type string, at int"), path)
    landing.append_trace(spark.createDataFrame([("llm", 3)], "type string, at int"), path)
    (tmp_path / "trace" / "broken.json").write_text("{nope\n")
    assert [r.at for r in landing.read_traces(spark, path, "type string, at int", "llm").collect()] == [3, 1]
    df = spark.createDataFrame([(1, None, "long")], "a int, b string, text string")
    assert json.loads(landing.export_json(df, ("text",)).first().json) == {"a": 1, "b": None}
    landing.export_tables({"t": df}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "t")).columns == ["a"]


def test_micro_batches_equal_one_batch(spark, tmp_path):
    body = "Some words stand here. " * 200
    rows = [(d, p, f"{d}.{p} {body}") for d in range(6) for p in range(2)]
    schema = "doc_id bigint, page_index int, text string"

    def run(name, batches):
        src = str(tmp_path / f"in-{name}")
        for part in batches:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            stream_ingest(stream, str(tmp_path / name), str(tmp_path / f"ck-{name}")).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name / "chunks")).select("chunk_id", "doc_id", "char_start", "char_end").collect())

    one = run("one", [rows])
    many = run("many", [rows[:4], rows[4:8], rows[8:], rows[:4]])
    assert one and one == many


def test_crash_between_staging_and_replacing(spark, tmp_path):
    from factloom.streaming import ingest

    path = f"file://{tmp_path}/t"
    old = spark.createDataFrame([(d, "old") for d in range(20)], "doc_id bigint, x string")
    ingest.store_by_document(spark, old, path, 4)
    new = spark.createDataFrame([(3, "new"), (77, "new")], "doc_id bigint, x string")
    kept = spark.read.parquet(path).join(new, "doc_id", "left_anti").select("doc_id", "x")
    staged = ingest._bucketed(kept.unionByName(new), 4)
    staged.write.partitionBy("bucket").parquet(f"{path}__staged")  # the crash comes here
    ingest.store_by_document(spark, spark.createDataFrame([(5, "later")], "doc_id bigint, x string"), path, 4)
    got = dict(spark.read.parquet(path).select("doc_id", "x").collect())
    assert got[3] == got[77] == "new" and got[5] == "later" and len(got) == 21 and not (tmp_path / "t__staged").exists()
    assert not list(tmp_path.glob("t__staged"))


def test_command_line_and_runs(spark, tmp_path):
    import pytest

    from factloom import cli
    from factloom.operators import runs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Some words stand here. " * 40 + "\f" + "And some more of them. " * 40)
    assert cli.ingest(spark, str(tmp_path / "in"), f"file://{tmp_path}/s", collection="c") == 2
    with pytest.raises(ValueError), runs.RunRecorder(spark, f"file://{tmp_path}/s/runs", "extract", "7") as run:
        run.called(False, 10, 3)
        run.called(True)
        raise ValueError("broken")
    rows = spark.read.parquet(str(tmp_path / "s" / "runs"))
    assert sorted((r.stage, r.n_items, r.n_calls, r.tokens_in) for r in rows.collect()) == [("extract", 0, 1, 10), ("ingest", 2, 0, 0)]
    one = runs.document_runs(rows, "7").first()
    assert one.errors[0]["detail"] == "ValueError: broken" and one.notes["cache_hits"] == "1"
    assert spark.read.parquet(str(tmp_path / "s" / "chunks")).count() == 2


def test_tables_are_made_once(spark, tmp_path):
    from factloom.operators import store

    schemas = {"a": "x int", "b": "y string, z array<double>"}
    assert store.ensure_tables(spark, f"file://{tmp_path}/d", schemas) == ["a", "b"]
    assert store.ensure_tables(spark, f"file://{tmp_path}/d", schemas) == [] and spark.read.parquet(str(tmp_path / "d" / "b")).columns == ["y", "z"]
