from __future__ import annotations

import json

import pytest

from siltstone.schemas import PROGRAM_STATE, QA_PAIR
from siltstone.sources import tables


def test_json_array_round_trip(spark, tmp_path):
    rows = [{"doc_id": "d", "section": "s", "question": "q", "answer": "a\nb", "context": "é"}]
    (tmp_path / "qa.json").write_text(json.dumps(rows, indent=2))
    assert [r.asDict() for r in tables.read_json_array(spark, str(tmp_path / "qa.json"), QA_PAIR).collect()] == rows


def test_index_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = str(tmp_path / "index")
    assert [tables.load_or_build(spark, path, build, force=f).count() for f in (False, False, True)] == [1, 1, 2]


def test_missing_chunks_and_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.chunk_source(spark, str(tmp_path / "none"))
    assert tables.saved_results(spark, str(tmp_path / "none")).count() == 0


def test_state_round_trip(spark, tmp_path):
    tables.save_state(spark, str(tmp_path / "s"), {"k": 5})
    assert tables.load_state(spark, str(tmp_path / "s"), {"k": 3, "j": 1}) == {"k": 5, "j": 1}
    assert tables.load_state(spark, str(tmp_path / "t"), {"k": 3}) == {"k": 3}


def test_entry_has_sql_for_known_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_array_sink_results_and_pages(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b\n'), (2, None)], "k int, t string")
    tables.write_json_array(df, str(tmp_path / "a"))
    assert sorted((r["k"], r["t"]) for r in tables.read_json_array(spark, str(tmp_path / "a"), "k int, t string").collect()) == [(1, 'a"b\n'), (2, None)]
    tables.write_json_array(df.limit(0), str(tmp_path / "b"))
    assert tables.read_json_array(spark, str(tmp_path / "b"), "k int, t string").count() == 0
    row = lambda label, score: spark.createDataFrame([(label, score, "m", "t")], "label string, score double, model string, timestamp string")
    for label, score in (("pre", 0.1), ("post", 0.2), ("pre", 0.3)):
        got = tables.save_results(spark, str(tmp_path / "r"), row(label, score))
    assert sorted((r["label"], r["score"]) for r in got.collect()) == [("post", 0.2), ("pre", 0.3)]
    tables.write_pages(spark.createDataFrame([("x", "u1", "old"), ("x", "u2", "new"), ("y", "u3", "z")], "file string, url string, html string"), str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("file", "html").collect())) == [("x", "new"), ("y", "z")]


def test_results_stay_until_new_ones_are_whole(spark, tmp_path):
    path = str(tmp_path / "r")
    row = lambda label, score: spark.createDataFrame([(label, score, "m", "t")], "label string, score double, model string, timestamp string")
    for k in range(4):
        tables.save_results(spark, path, row("a", float(k)))
    broken = tmp_path / "r" / "version=9"  # begun and not ended
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert [r["score"] for r in tables.saved_results(spark, path).collect()] == [3.0]
    assert [r["score"] for r in tables.save_results(spark, path, row("a", 7.0)).collect()] == [7.0]
    assert sorted(x.name for x in (tmp_path / "r").iterdir() if (x / "_SUCCESS").exists()) == ["version=4", "version=5"]


def test_program_with_its_retriever(spark, tmp_path):
    path = str(tmp_path / "p")
    predictors, retriever = tables.load_program(spark, path, {"index": "i", "k": 3})
    assert predictors.count() == 0 and retriever == {"index": "i", "k": 3}
    rows = [("answer", "Be short.", [("q", "a")]), ("expand", "Say it otherwise.", [])]
    tables.save_program(spark, path, spark.createDataFrame(rows, PROGRAM_STATE), {"k": 5})
    predictors, retriever = tables.load_program(spark, path, {"index": "i", "k": 3})
    assert sorted((r["predictor"], r["instruction"], [tuple(d) for d in r["demos"]]) for r in predictors.collect()) == rows and retriever == {"index": "i", "k": 5}


def test_page_folder_to_chunks(spark, tmp_path):
    from siltstone.operators import chunk

    root = tmp_path / "raw"
    (root / "sub").mkdir(parents=True)
    (root / "my-page.html").write_text("<main><h1>T</h1><p>caf\u00e9</p></main>", encoding="utf-8")
    (root / "sub" / "my-page.html").write_bytes(b"<main><p>bad \xff byte</p></main>")
    (root / "note.txt").write_text("no page")
    files = tables.page_folder(spark, str(root)).unionByName(tables.page_folder(spark, str(root / "sub")))
    got = sorted((r["source_path"], r["doc_id"], r["chunk_id"], r["text"]) for r in chunk.folder_corpus(files, f"file:{root}").collect())
    assert got == [("my-page.html", "my_page", "my-page.html_0", "[T] caf\u00e9"), ("sub/my-page.html", "my_page", "sub/my-page.html_0", "[General] bad  byte")]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from siltstone import __main__ as cli

    spark.createDataFrame([(1, "/a", "<html><body><main><h1>Rates</h1><p>The rate of the loan is two per cent.</p></main></body></html>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "q.txt").write_text("What is the rate?\n\n What is the rate? \n  Quit \nIs this still asked?\n")
    monkeypatch.setenv("SILTSTONE_INDEX", str(tmp_path / "index"))
    cli.run(spark, cli.parameters(["ingest", "--pages", str(tmp_path / "pages")]))
    cli.run(spark, cli.parameters(["ask", "--questions", str(tmp_path / "q.txt"), "--answers", str(tmp_path / "out")]))
    got = tables.read_json_array(spark, str(tmp_path / "out"), "question string, answer string").collect()
    assert [r["question"] for r in got] == ["What is the rate?"] and "rate" in got[0]["answer"]
    assert (out := capsys.readouterr().out).startswith("Q: What is the rate?\nA: [Rates] The rate") and "  [1] [Rates] The rate" in out, out
    html = "<main>" + "".join(f"<h2>Part {i}</h2><p>Paragraph {i} tells of the loans, rates and grants that a family of {i} may ask for at the office, and when. </p>" for i in range(30)) + "</main>"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "all.html").write_text(html)
    for argv in (["ingest", "--folder", str(tmp_path / "raw"), "--index", str(tmp_path / "i2")], ["questions", "--index", str(tmp_path / "i2"), "--pairs", str(tmp_path / "qa"), "--n", "25"], ["split", "--pairs", str(tmp_path / "qa"), "--out", str(tmp_path / "s")]):
        cli.run(spark, cli.parameters(argv))
    assert spark.read.parquet(str(tmp_path / "i2" / "chunks")).select("source_path").distinct().first()[0] == "all.html"
    pairs = tables.read_json_array(spark, str(tmp_path / "qa"), QA_PAIR).count()
    assert pairs == 25 and sum(tables.read_json_array(spark, str(tmp_path / "s" / x), QA_PAIR).count() for x in ("train", "dev", "test")) == 25
    with pytest.raises(SystemExit):
        cli.parameters(["ask"])
