"""Stores: inverted index, data source with one rate, streams that may repeat, zip members, many-pattern containment."""

import http.server
import json
import random
import threading
import time
import zipfile
from datetime import date
from urllib.parse import parse_qs, urlsplit

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from lodestone.operators import containment, search
from lodestone.sources import archives, papers, postings, stores, works
from lodestone.sources.shared import Folder
from lodestone.streaming import stores as streams

DOCS = [(1, "graph search, graph index"), (2, "index of words"), (3, None), (4, ""), (5, "graph of a city"), (6, "City graph search search"), (None, "graph")]


def scores(df):
    return {(r.q, r.id): (round(r.score, 9), r.held) for r in df.collect()}


def test_index_in_segments_searches_as_the_texts(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, body string")
    terms = spark.createDataFrame([(1, "graph"), (1, "search"), (2, "city"), (2, "nowhere")], "q int, token string")
    path = str(tmp_path / "index")
    want = scores(search.bm25(docs, terms, "id", "body", "q"))
    postings.add_to_index(docs.filter("id < 3"), "id", "body", path)
    part = scores(postings.stored_bm25(spark, path, terms, "id", "q"))
    assert part == scores(search.bm25(docs.filter("id < 3"), terms, "id", "body", "q"))
    postings.add_to_index(docs.filter("id >= 3 OR id IS NULL"), "id", "body", path)
    assert scores(postings.stored_bm25(spark, path, terms, "id", "q")) == want and len(want) > 4
    unfinished = tmp_path / "index/postings/segment=broken"
    unfinished.mkdir()
    assert scores(postings.stored_bm25(spark, path, terms, "id", "q")) == want
    assert postings.stored_bm25(spark, path, terms.limit(0), "id", "q").count() == 0


def test_index_without_texts(spark, tmp_path):
    path, terms = str(tmp_path / "none"), spark.createDataFrame([(1, "graph")], "q int, token string")
    postings.add_to_index(spark.createDataFrame([(1, None)], "id long, body string"), "id", "body", path)
    assert len(postings.segments(spark, path)) == 1 and postings.stored_bm25(spark, path, terms, "id", "q").count() == 0


def test_search_reads_few_bytes(spark, tmp_path):
    """A question of two words reads their buckets, not the index."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    path = str(tmp_path / "index")
    postings.add_to_index(docs, "doc_id", "text", path)
    size = lambda files: sum((tmp_path / f.removeprefix("file://")).stat().st_size for f in files)
    everything = size(spark.read.parquet(f"{path}/postings").inputFiles())
    words = docs.select(F.explode(search.T.words(F.col("text"))).alias("token")).groupBy("token").count().orderBy("count", "token").limit(2)
    terms = words.select(F.lit(1).alias("q"), "token")
    buckets = [r.b for r in terms.select(postings.bucket_of("token").alias("b")).collect()]
    files = [f for f in postings.read_buckets(spark, path, "postings").inputFiles() if any(f"bucket={b}/" in f for b in buckets)]
    plan = postings.read_buckets(spark, path, "postings", buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and 0 < size(files) < everything / 10
    assert scores(postings.stored_bm25(spark, path, terms, "id", "q").withColumnRenamed("doc_id", "id")) == scores(search.bm25(docs.withColumnRenamed("doc_id", "id"), terms, "id", "text", "q"))


class Catalogue(http.server.BaseHTTPRequestHandler):
    """A catalogue of 95 works; it fails once with 503 and keeps the requests' times and parameters."""

    works = [{"id": f"W{k:03}", "display_name": f"Work {k}", "publication_date": f"20{10 + k % 15}-0{1 + k % 9}-15", "publication_year": 2010 + k % 15, "cited_by_count": k, "doi": None} for k in range(95)]
    seen: list = []
    failed: set = set()

    def do_GET(self):  # noqa: N802
        asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        Catalogue.seen.append((time.monotonic(), asked))
        if asked.get("page") == "3" and "3" not in Catalogue.failed:
            Catalogue.failed.add("3")
            self.send_response(503)
            self.end_headers()
            return
        bounds = dict(p.split(":") for p in asked.get("filter", "").split(",") if p)
        kept = [w for w in Catalogue.works if bounds.get("from_publication_date", "") <= w["publication_date"] <= bounds.get("to_publication_date", "9999")]
        size, page = int(asked["per-page"]), int(asked["page"])
        body = json.dumps({"meta": {"count": len(kept)}, "results": kept[(page - 1) * size : page * size]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def catalogue(spark):
    Catalogue.seen, Catalogue.failed = [], set()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Catalogue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(works.WorksSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield f"http://127.0.0.1:{server.server_port}/works"
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()


def test_works_are_read_in_partitions_at_one_rate(spark, catalogue):
    reader = spark.read.format("works").option("path", catalogue).option("search", "a b").option("page_size", 10).option("partitions", 3).option("rate", 10).option("wait", 0.01)
    rows = reader.load().collect()
    assert sorted(r.paper_id for r in rows) == [w["id"] for w in Catalogue.works]
    assert rows[0].published == date.fromisoformat(json.loads(rows[0].value)["publication_date"])
    times = sorted(t for t, a in Catalogue.seen if a["per-page"] == "10")
    assert len(times) == 11 and all(a["search"] == "a b" for _, a in Catalogue.seen)
    assert max(sum(t <= u < t + 1 for u in times) for t in times) <= 12  # 10 a second, and what waited
    assert papers.from_works(reader.load().select("value")).count() == 95


def test_dates_reach_the_request(spark, catalogue):
    rows = spark.read.format("works").option("path", catalogue).option("page_size", 50).load()
    found = rows.filter((F.col("published") >= F.lit(date(2015, 3, 1))) & (F.col("published") < F.lit(date(2020, 1, 1))) & (F.col("citation_count") > 50)).collect()
    want = [w["id"] for w in Catalogue.works if "2015-03-01" <= w["publication_date"] < "2020-01-01" and w["cited_by_count"] > 50]
    assert sorted(r.paper_id for r in found) == want
    assert {a["filter"] for _, a in Catalogue.seen} == {"from_publication_date:2015-03-01,to_publication_date:2019-12-31"}


def test_credentials_share_the_work(spark, catalogue, monkeypatch):
    source = works.WorksReader({"path": catalogue, "page_size": "10", "partitions": "5", "rate": "4", "keys": "KEY_A, KEY_B"})
    parts = source.partitions()
    assert [(p.first, p.last, p.key) for p in parts] == [(1, 2, "KEY_A"), (3, 4, "KEY_B"), (5, 6, "KEY_A"), (7, 8, "KEY_B"), (9, 10, "KEY_A")]
    for key in ("KEY_A", "KEY_B"):
        assert sum(1 / p.interval for p in parts if p.key == key) == pytest.approx(4)
    monkeypatch.setenv("KEY_A", "secret")
    assert "api_key=secret" in source._address(1, 10, "KEY_A") and "api_key" not in source._address(1, 10, "KEY_B")


def test_catalogue_without_works(spark, catalogue):
    rows = spark.read.format("works").option("path", catalogue).load()
    assert rows.filter(F.col("published") > F.lit(date(2100, 1, 1))).count() == 0


RUN_NAMES = [c.split()[0] for c in stores.RUNS.split(", ")]


def run(**held):
    return tuple(held.get(n) for n in RUN_NAMES)


def run_rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = streams.RunStore(spark, str(tmp_path / "runs"), buckets=4)
    first = spark.createDataFrame([run(job_id=f"j{k}", status="queued", created_at="1", updated_at="1") for k in range(9)] + [run(status="lost")], stores.RUNS)
    second = spark.createDataFrame([run(job_id="j3", status="done", created_at="9", updated_at="2"), run(job_id="j3", status="running", updated_at="1"), run(job_id="new", status="queued", updated_at="2")], stores.RUNS)
    assert store.read().count() == 0 and store.upsert(first, 0) and store.upsert(second, 1)
    once = run_rows(store.read())
    assert len(once) == 10 and not store.upsert(second, 1) and not store.upsert(first, 0) and run_rows(store.read()) == once
    j3 = store.read().filter("job_id = 'j3'").first()
    assert (j3.status, j3.created_at) == ("done", "1")
    Folder(spark, f"{tmp_path}/runs/batch=1").remove("_SUCCESS")
    assert store.read().filter("job_id = 'new'").count() == 0 and store.upsert(second, 1) and run_rows(store.read()) == once
    assert store.vacuum() > 0 and run_rows(store.read()) == once


LOG = "job_id string, ts double, kind string, stage string, progress double, error string"


def test_a_log_becomes_job_status(spark, tmp_path):
    """The checkpoint is lost after the second batch, so the stream sends all again under its old numbers."""
    source, store = tmp_path / "log", streams.RunStore(spark, str(tmp_path / "runs"), buckets=4)
    batches = [[("a", 1.0, "queued", None, 0.0, None), ("b", 2.0, "queued", None, 0.0, None)], [("a", 3.0, "started", "retrieval", 0.1, None), ("b", 4.0, "failed", "retrieval", 0.2, "boom")], [("a", 5.0, "finished", "done", 1.0, None)]]
    source.mkdir()
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    for n, rows in enumerate(batches[:2]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(str(source / f"{n}"))
        time.sleep(0.05)
        store.follow(streams.job_updates(log), str(tmp_path / "ck"), available_now=True).awaitTermination()
    before = run_rows(store.read())
    store.follow(streams.job_updates(log), str(tmp_path / "ck2"), available_now=True).awaitTermination()
    assert run_rows(store.read()) == before
    spark.createDataFrame(batches[2], LOG).coalesce(1).write.parquet(str(source / "2"))
    store.follow(streams.job_updates(log), str(tmp_path / "ck"), available_now=True).awaitTermination()
    found = {r.job_id: r for r in store.read().collect()}
    assert (found["a"].status, found["a"].stage, found["a"].created_at[-6:], found["a"].finished_at[-6:]) == ("succeeded", "done", "01.000", "05.000")
    assert (found["b"].status, found["b"].error, found["b"].progress) == ("failed", "boom", 0.2)


def test_a_stopped_vector_build_goes_on(spark, tmp_path):
    source, path, asked = tmp_path / "papers", str(tmp_path / "vectors"), []
    for k in range(4):
        spark.createDataFrame([(10 * k + i, f"Title {k} {i}", None) for i in range(3)] + [(0, "Title again", "x"), (99, " ", "untitled")], "id long, title string, abstract string").coalesce(1).write.parquet(str(source / str(k)))
        time.sleep(0.05)

    def embed(texts):
        ids = [r.id for r in texts.collect()]
        if len(asked) == 2:
            asked.append("stopped")
            raise RuntimeError("stopped")
        asked.append(ids)
        return texts.select("id", F.array(F.length("text").cast("float")).alias("embedding"))

    rows = lambda: spark.readStream.schema("id long, title string, abstract string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    build = lambda: streams.build_vectors(rows(), path, "id", embed, str(tmp_path / "ck")).awaitTermination()
    assert streams.read_vectors(spark, path) is None
    with pytest.raises(Exception, match="stopped"):
        build()
    assert streams.read_vectors(spark, path).count() == 6
    build()
    build()
    made = [i for ids in asked if ids != "stopped" for i in ids]
    assert len(made) == len(set(made)) == 12 == streams.read_vectors(spark, path).select("id").distinct().count()


def test_papers_come_from_folder_and_zip(spark, tmp_path):
    folder, zips = tmp_path / "papers", [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")]
    folder.mkdir()
    (folder / "deepnets").write_text('{"title": "Deep nets"}')
    with zipfile.ZipFile(zips[0], "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("sub")
        z.writestr("deepnets", "from the zip")
        z.writestr("graphs", '{"title": "Graphs é", "abstract": "' + "long " * 50_000 + '"}')
        z.writestr("empty", "")
    with zipfile.ZipFile(zips[1], "w", zipfile.ZIP_STORED) as z:
        z.writestr("graphs", "second")
        z.writestr("stored", '{"title": "Stored"}')
    keys = spark.createDataFrame([("deepnets",), ("graphs",), ("stored",), ("empty",), ("missing",), ("graphs",), ("",), (None,)], "title_key string")
    found = {r.title_key: r.value for r in archives.papers_by_key(spark, keys, str(folder), zips).collect()}
    assert set(found) == {"deepnets", "graphs", "stored", "empty"} and found["deepnets"] == '{"title": "Deep nets"}'
    assert json.loads(found["graphs"])["title"] == "Graphs é" and found["stored"] == '{"title": "Stored"}' and found["empty"] == ""
    listed = archives.directory(spark, zips)
    assert listed.count() == 5 and archives.contents(listed).count() == 5
    broken = listed.filter("name = 'stored'").withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="checksum"):
        archives.contents(broken).count()
    with pytest.raises(Exception, match="no member starts"):
        archives.contents(listed.withColumn("at", F.col("at") + 1)).count()


@pytest.mark.parametrize("most", [containment.MOST_CHARS, 12])
def test_containment_is_letter_for_letter(spark, most):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(k, word(rng.randint(0, 30))) for k in range(60)] + [(60, None), (61, "aé"), (62, "a"), (62, "a")]
    patterns = [(k, word(rng.randint(0, 9))) for k in range(25)] + [(25, None), (26, "é"), (27, "xaéx"), (27, "xaéx"), (28, "a")]
    t, p = spark.createDataFrame(texts, "id long, text string, ".rstrip(", ")), spark.createDataFrame(patterns, "pid int, pattern string")
    for both in (False, True):
        found = containment.contained(t, "id", "text", p, "pid", "pattern", both, most).collect()
        want = {(a, b) for a, x in patterns for b, y in texts if x and y and (x in y or both and y in x)}
        assert len(found) == len(want) and {(r.pid, r.id) for r in found} == want


def test_containment_of_nothing(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert containment.contained(texts, "id", "text", texts.limit(0).toDF("p", "x"), "p", "x").count() == 0
    assert containment.contained(texts.limit(0), "id", "text", texts.toDF("p", "x"), "p", "x").count() == 0


def some_vectors(n, width, clusters, seed=3):
    import numpy as np

    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, width)) * 6
    return [(k, (middles[k % clusters] + rng.normal(size=width)).astype("float32").tolist()) for k in range(n)]


@pytest.mark.parametrize(("n", "clusters", "block"), [(400, 8, None), (90, 1, 3), (7, 2, 2)])
def test_stored_blocks_search_as_all_vectors(spark, tmp_path, n, clusters, block):
    from lodestone.operators import vectors
    from lodestone.sources import vector_blocks

    rows = some_vectors(n, 12, clusters)
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, [0.0] * 12)]
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] * 12), (None, rows[0][1])]
    schema, path = "vec_id long, embedding array<float>", str(tmp_path / "blocks")
    good = spark.createDataFrame(rows, schema)
    blocks = vector_blocks.write_blocks(spark.createDataFrame(rows + bad, schema).repartition(3), path, block)
    asked = good.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    found, met = vector_blocks.search_blocks(spark, asked.unionByName(spark.createDataFrame([(2000, None), (2003, [1.0])], "query_id long, embedding array<float>")), path, 6)
    want = vectors.similar(asked, good, 6)
    order = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    assert order(found) == order(want)
    share = met.count() / (asked.count() * blocks)
    assert share < 0.5 if clusters == 8 else share <= 1


def test_a_large_centre_is_several_blocks(spark, tmp_path, monkeypatch):
    from lodestone.sources import vector_blocks

    monkeypatch.setattr(vector_blocks, "BLOCK", 20)
    rows = some_vectors(100, 4, 1)
    assert vector_blocks.write_blocks(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), str(tmp_path / "b"), 1) == 5
    assert vector_blocks.write_blocks(spark.createDataFrame([], "vec_id long, embedding array<float>"), str(tmp_path / "none")) == 0
