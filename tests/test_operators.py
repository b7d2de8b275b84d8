import pytest
from pyspark.sql import functions as F

from charta.operators import entities, index, lexical, provenance, quant, retrieve
from charta.sources import attempts, connectors, containers, registry, run
from charta.streaming import windows


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "source_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "source_id string, v int")
    assert sorted(map(tuple, index.upserted(old, new).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_ids_are_stable_and_keep_leading_zeros(spark):
    df = spark.createDataFrame([("dhs", "017332"), ("dhs", "17332")], "p string, e string")
    ids = [r[0] for r in df.select(index.source_id(F.col("p"), F.col("e"))).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 16 for i in ids)


def test_fuzzy_join_loses_nothing(spark):
    words = ["colonel", "colonels", "kolonel", "clonel", "affair", "affaire", "a", "ab", "", "xy", "colnoel"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {(r["a"], r["b"]) for r in entities.fuzzy(df, df, 2).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert got == {(a, b) for a in words for b in words if distance(a, b) <= 2}


def test_bm25_on_empty_input(spark):
    docs = spark.createDataFrame([], "source string, doc_id long, text string")
    assert retrieve.cited_top(docs, ["x"]).collect() == []


def test_hops_end_in_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in provenance.hops(links, "a", 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_as_of_takes_the_last_value_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 3), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 10, "y")], "k int, since int, v string")
    got = {tuple(r) for r in quant.as_of(left, right, "k", "t", "since", "v").collect()}
    assert got == {(1, 10, "y"), (1, 3, None), (2, 9, None)}


def test_context_at_the_edges(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in lexical.in_context(docs, "a", 1).collect())
    assert got == [(1, 1, "", "b"), (1, 3, "b", "")]


def test_text_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("dhs", "# Title"), ("wiki", "Text")], "provider string, text string")
    connectors.write_markdown(rows, str(tmp_path / "out"))
    got = connectors.read_texts(spark, str(tmp_path / "out"), "*.txt")
    assert {(r["provider"], r["text"].strip()) for r in got.collect()} == {("dhs", "# Title"), ("wiki", "Text")}
    assert connectors.read_any(spark, str(tmp_path / "out")).filter("kind = 'txt' and text is not null").count() == 2


def test_written_index_is_read_by_provider(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"p{i % 3}", 6) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    connectors.write_index(index.described(docs), str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index"))
    one = back.filter("provider = 'p1'")
    assert sorted(r["external_id"] for r in one.collect()) == ["1", "10", "4", "7"] and back.count() == 12
    assert "PartitionFilters: [isnotnull(provider" in one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_database_commands(spark, tmp_path):
    from charta.sources.tables import administered

    try:
        assert administered(spark, "charta_t", ["init"], str(tmp_path / "db")).filter("table_name = 'claim'").count() == 6
        assert administered(spark, "charta_t", ["init"], str(tmp_path / "db")).count() == 32
        spark.sql("INSERT INTO charta_t.mention VALUES ('s', 1, 'A', null, null)")
        spark.sql("INSERT INTO charta_t.passage VALUES ('s', 1, 1, 't')")
        stats = lambda *args: {r["name"]: r["n"] for r in administered(spark, "charta_t", list(args)).collect()}
        assert stats("stats")["mention"] == 1 and stats("reset") == {**stats("stats"), "mention": 0, "passage": 1}
        assert stats("reset", "passage")["passage"] == 0
        for wrong in ([], ["drop"], ["reset", "nosuch"]):
            with pytest.raises(ValueError):
                administered(spark, "charta_t", wrong)
    finally:
        spark.sql("DROP DATABASE IF EXISTS charta_t CASCADE")


def test_json_descriptions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"provider": "dhs", "external_id": "017332", "lang": "fr"}\n')
    assert connectors.read_descriptions(spark, str(tmp_path)).first()["external_id"] == "017332"


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    def put(name, rows):
        df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    day = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    rows = [[(1, day, 1, "a", 1.0, "")], [(2, day + 10 * hour, 1, "a", 1.0, "")], [(3, day + 11 * hour, 1, "a", 1.0, "")], [(4, day, 1, "a", 1.0, "")]]
    query = None
    for i, batch in enumerate(rows):
        put("in", batch)
        if query is None:
            from charta.sources.tables import schema

            stream = windows.timed(spark.readStream.schema(schema("events")).parquet(str(tmp_path / "in")))
            out = windows.late_limited(stream, "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
            query = out.writeStream.format("memory").queryName("late").outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    got = {r["window"]["start"]: r["n"] for r in spark.table("late").collect()}
    assert got[day] == 1


def test_repeats_in_a_stream_count_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "event_id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert windows.run_to_table(windows.without_repeats(stream)).count() == 2


def test_containers_of_several_files_and_odd_cells(spark):
    rows = [[(i, f"n{i}", None if i % 2 else i / 4) for i in range(k, 9000, 3)] for k in range(3)]
    files = [(containers.sqlite_bytes({"a b": ('"x y" INTEGER, name TEXT, v REAL', r), "other": ("z TEXT", [])}),) for r in rows]
    out = containers.sqlite_rows(spark.createDataFrame([*files, (None,)], "content binary"), "a b", "`x y` int, name string, v double")
    assert sorted(tuple(r) for r in out.collect()) == sorted(x for r in rows for x in r)
    book = containers.workbook_bytes({"One & only": [["a", None, 3], [], [None, "é <b>"]], "Two": [[1.5]]})
    got = containers.workbook_cells(spark.createDataFrame([(book,)], "content binary")).collect()
    assert sorted(map(tuple, got)) == [("One & only", 1, 1, "a"), ("One & only", 1, 3, "3"), ("One & only", 3, 2, "é <b>"), ("Two", 1, 1, "1.5")]


def test_attempts_and_fallbacks():
    tries, cleaned = [], []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    assert attempts.attempted(action, step=0, between=cleaned.append) == "done" and len(tries) == 3 and cleaned == [1, 2]
    for n, retry in ((2, lambda e: True), (5, lambda e: isinstance(e, KeyError))):
        tries.clear()
        with pytest.raises(OSError):
            attempts.attempted(action, attempts=n, step=0, retry=retry)
    tries.clear()
    assert attempts.first_success([action, action, action, action]) == "done"
    tries.clear()
    with pytest.raises(OSError):
        attempts.first_success([action, action])


def test_folder_of_sources_runs_connectors(spark, tmp_path):
    for name, text in {"dhs/affaire_dhs_000017_fr.md": "# L'Affaire des colonels\nText", "wikipedia/a_wikipedia_1_en.md": "Colonels Affair\nMore"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = run.folder_documents(spark, str(tmp_path))
    asked = registry.dispatched(spark.createDataFrame([(1, ["dhs", "affaire"]), (2, ["wiki", "colonels", "affair"]), (3, ["wiki", "colonels affair", "--lang", "fr"])], "case_id int, args array<string>"), registry.registry(spark))
    got = run.executed(asked, {"documents": docs}).collect()
    assert sorted((r["case_id"], r["title"]) for r in got) == [(1, "# L'Affaire des colonels"), (2, "Colonels Affair")]


def test_listed_contents_from_an_array(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"url": "u1", "x": 1}, {"url": "u2"}, {"url": null}]')
    pages = spark.createDataFrame([(1, "u1", "h")], "page_id long, url string, html string")
    got = run.listed_contents(spark, str(tmp_path / "list.json"), pages, array=True).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("u1", 1, "h"), ("u2", None, None)]))


def test_periods_join_equals_all_pairs(spark):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=7 * i)) for i in range(60)] + [(99, None)]
    spans = [("a", 0, 400), ("b", 3, 3), ("c", 9, 8), ("d", 20, 21), ("e", -900, 2)]
    periods = [(n, day + dt.timedelta(hours=a), day + dt.timedelta(hours=z)) for n, a, z in spans] + [("f", None, day)]
    left = spark.createDataFrame(rows, "i int, t timestamp_ntz")
    right = spark.createDataFrame(periods, "p string, s timestamp_ntz, e timestamp_ntz")
    for days in (1, 7):
        got = sorted((r["i"], r["p"]) for r in quant.in_periods(left, "t", right, "s", "e", days).collect())
        assert got == sorted((i, p) for i, t in rows for p, s, e in periods if t and s and s <= t < e)


def test_streams_over_several_files(spark, tmp_path):
    rows = [(i, i, i % 3, "ab"[i % 2], float(i), "") for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, s int, user_id long, event_type string, value double, props string")
    events = events.withColumn("ts", F.timestamp_seconds(F.col("s") * 3600).cast("timestamp_ntz")).drop("s")
    for k in range(4):
        events.filter(F.col("event_id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    files = lambda: windows.timed(spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet")))
    got = sorted(tuple(r) for r in windows.run_to_table(windows.running_totals(files()), "update", ["user_id"]).collect())
    assert got == [(u, len(range(u, 20, 3)), float(sum(range(u, 20, 3)))) for u in range(3)]
    want = sorted(map(str, windows.tumbling(windows.timed(spark.read.parquet(str(tmp_path / "events.parquet")))).collect()))
    assert sorted(map(str, windows.run_to_table(windows.tumbling(files()), "complete").collect())) == want


def test_hops_of_a_dense_graph_take_few_steps(spark):
    n = 14
    links = spark.createDataFrame([(f"a{i}", f"a{j}") for i in range(n) for j in range(n)] + [("a1", "end"), ("a2", None)], "src string, dst string")
    got = dict(tuple(r) for r in provenance.hops(links, "a0", 12).collect())
    assert got == {"a0": 0, **{f"a{i}": 1 for i in range(1, n)}, "end": 2}


def test_sketches_are_near_the_exact_values(spark):
    docs = spark.createDataFrame([(i, f"t{i % 700}", "ab"[i % 2], i % 500) for i in range(4000)] + [(9000, None, "a", None), (9001, "", "c", 0)], "doc_id long, text string, lang string, n_chars long")
    got = {r["lang"]: r for r in index.approximate_statistics(docs).collect()}
    exact = {r["lang"]: r for r in docs.groupBy("lang").agg(F.countDistinct("text").alias("texts"), F.percentile("n_chars", 0.5).alias("median_chars")).collect()}
    assert set(got) == set(exact) == {"a", "b", "c"}
    for k, r in exact.items():
        assert abs(got[k]["texts"] - r["texts"]) <= 0.15 * r["texts"] and abs(got[k]["median_chars"] - r["median_chars"]) <= 2
