from __future__ import annotations

import datetime as dt
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import text as X
from quillspark.operators import duplicates as D
from quillspark.operators import editorial as E
from quillspark.operators import limits as M
from quillspark.operators import relations as R
from quillspark.operators import search as S
from quillspark.sources import crawl, sinks
from quillspark.streaming import readers

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_tags_are_anded(spark):
    works = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Gamma")], "id int, title string")
    bridge = spark.createDataFrame([(1, "naat"), (1, "maqam-hijaz"), (2, "naat"), (2, "bahr-kamil"), (2, "maqam-hijaz"), (3, "hamd")], "work_id int, tag string")
    assert rows(S.with_all_tags(works, bridge, ["naat", "bahr-kamil", "NAAT"]), "title") == [("Beta",)]
    assert rows(S.with_all_tags(works, bridge, ["hamd", "naat"]), "title") == []
    assert S.read_values(["Naat", "naat", " ", "Hamd"]) == ["Naat", "Hamd"]
    counts = spark.createDataFrame([("naat", 2), ("maqam-hijaz", 2), ("odd", 1), ("hamd", 3)], "tag string, n long")
    got = S.grouped_by_axis(counts, ["naat"]).collect()
    assert [(r["axis"], r["total"]) for r in got] == [("form", 5), ("maqam", 2), ("other", 1)] and got[0]["items"][0]["tag"] == "naat"


def test_missing(spark):
    w = spark.createDataFrame([(1, 5, 5, "en", "x", "y", "z"), (2, None, None, "", "", "", "")], "id int, author_id int, dedication_id int, language string, lyrics string, transliteration string, translation string")
    bridge = spark.createDataFrame([(1, "t")], "work_id int, tag string")
    for gap in S.MISSING:
        assert rows(S.still_missing(w, bridge, gap), "id") == [(2,)]
    assert S.still_missing(w, bridge, "unknown").count() == 2


def test_pages_clamp(spark):
    df = spark.range(50)
    assert [r[0] for r in S.page(df, [F.asc("id")], 99).collect()] == [48, 49]
    assert S.page(df, [F.asc("id")], -1).first()[0] == 0
    assert rows(R.numbered(spark.range(1000).repartition(7), ["id"], "n"), "id", "n") == [(i, i) for i in range(1000)]


def test_follow(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4)], "id int, replaced_by_id int")
    got = R.follow(links, links.select("id"), spark.createDataFrame([(3,)], "id int"))
    assert rows(got) == [(1, 3), (2, 3), (3, None), (4, None), (5, None)] or dict(rows(got))[1] == 3
    assert dict((r["id"], r["target"]) for r in got.collect()) == {1: 3, 2: 3, 3: None, 4: None, 5: None}


def test_collections(spark):
    w = spark.createDataFrame([(1, "Long poem (Part 2)"), (2, "long poem part 1"), (3, "Alone part 1"), (4, "x")], "id int, title string")
    assert rows(R.collections_of(w)) == [("long poem", 2)]
    parts = spark.createDataFrame([(1, 1)], "collection_id int, position int")
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "collection_id int, title string")
    assert rows(R.numbered_after(parts, new, ["title"]), "collection_id", "title", "position") == [(1, "a", 2), (1, "b", 3), (2, "c", 1)]


def test_limiter(spark):
    ev = spark.createDataFrame([(i, "k", T0 + dt.timedelta(seconds=i)) for i in range(10)] + [(99, "k", T0 + dt.timedelta(seconds=3601)), (100, None, T0)], "event_id int, key string, ts timestamp")
    got = {r["event_id"]: r["allowed"] for r in M.limited(ev, "key", "ts", "event_id", 5, 3600).collect()}
    assert sum(got[i] for i in range(10)) == 5 and got[99] and got[100]
    assert M.decide([0, 1, 2], 1, 100, [False, True, False])[0] == [True, True, True]
    assert M.limit_table(spark).count() == len(M.LIMITS)


def test_slots_and_runs(spark):
    ev = spark.createDataFrame([(1, "h", T0), (2, "h", T0 + dt.timedelta(seconds=1)), (3, "h", T0 + dt.timedelta(seconds=60))], "event_id int, host string, ts timestamp")
    got = [r["slot"] for r in R.request_slots(ev, "host", "ts", 6).orderBy("event_id").collect()]
    assert got == [T0, T0 + dt.timedelta(seconds=6), T0 + dt.timedelta(seconds=60)]
    tries = spark.createDataFrame([(i, "h", x) for i, x in enumerate("RRAREER")], "i int, host string, x string")
    out = R.refusal_runs(tries, "host", ["i"], F.col("x") == "R", F.col("x") == "A")
    assert [r["in_a_row"] for r in out.orderBy("i").collect()] == [1, 2, 0, 1, 1, 1, 2]


def test_duplicates(spark):
    opening = "ya nabi salam alayka ya rasul salam alayka " * 3
    w = spark.createDataFrame([(1, opening), (2, opening + "x"), (3, "a wholly different opening of another poem"), (4, opening), (5, "")], "id int, signature string")
    assert {(a, b) for a, b, *_ in rows(D.similar_pairs(w))} == {(1, 2), (1, 4)}
    links = spark.createDataFrame([], "first int, second int, score double, matched_on string, state string")
    once = D.record(links, D.similar_pairs(w))
    assert rows(D.record(once, D.similar_pairs(w))) == rows(once) and once.count() == 2


def library(spark):
    return D.Library(
        spark.createDataFrame([(1, "approved", None, None, 7, 3), (2, "pending", None, None, None, None), (3, "rejected", None, 1, None, None)], "id int, review_state string, reviewed_at timestamp, replaced_by_id int, collection_id int, collection_position int"),
        spark.createDataFrame([(10, 1, T0), (10, 2, T0), (11, 1, T0)], "user_id int, work_id int, created_at timestamp"),
        spark.createDataFrame([(10, 1, T0, 4)], "user_id int, work_id int, last_read_at timestamp, read_count int"),
        spark.createDataFrame([(1, 1, "v1"), (2, 1, "v2"), (3, 2, "v2")], "id int, work_id int, video_id string"),
        spark.createDataFrame([(1, 5), (2, 6)], "work_id int, tag_id int"),
        spark.createDataFrame([(1, 2, "pending", None, "", "")], "first int, second int, state string, kept_id int, kept_was string, hidden_was string"),
    )


def test_ruling(spark):
    ruled = D.keep(library(spark), spark.createDataFrame([(1, 2, 2)], "first int, second int, kept int"), F.lit(T0))
    works = {r["id"]: r for r in ruled.works.collect()}
    assert works[1]["review_state"] == "rejected" and works[1]["replaced_by_id"] == 2 and works[2]["review_state"] == "approved" and works[3]["replaced_by_id"] == 2
    assert (works[2]["collection_id"], works[2]["collection_position"]) == (7, 3)
    assert rows(ruled.favourites, "user_id", "work_id") == [(10, 2), (11, 2)] and rows(ruled.history, "user_id", "work_id") == [(10, 2)]
    assert {(r["id"], r["work_id"]) for r in ruled.media.collect()} == {(1, 2), (2, 1), (3, 2)}
    assert (2, 5) in rows(ruled.tags) and rows(ruled.links)[0] == (1, 2, "duplicate", 2, "pending", "approved")
    again = D.keep(ruled, spark.createDataFrame([(1, 2, 1)], "first int, second int, kept int"), F.lit(T0))
    assert rows(again.links) == rows(ruled.links)
    back = D.reopen(ruled, spark.createDataFrame([(1, 2)], "first int, second int"))
    works = {r["id"]: r for r in back.works.collect()}
    assert works[1]["review_state"] == "approved" and works[1]["replaced_by_id"] is None and works[2]["review_state"] == "pending"
    assert D.keep_both(library(spark).links, spark.createDataFrame([(1, 2)], "first int, second int")).first()["state"] == "distinct"


def test_editorial(spark):
    names = ", ".join(f"{c} string" for c in E.PROPOSED)
    works = spark.createDataFrame([(1, *["old"] * 7)], f"id int, {names}")
    proposed = ", ".join(f"proposed_{c} string" for c in E.PROPOSED)
    sg = spark.createDataFrame([(1, 1, "new", *[""] * 6, False, False, None, True), (2, 1, "late", *[""] * 6, True, True, T0, True)], f"id int, work_id int, {proposed}, is_reviewed boolean, is_approved boolean, reviewed_at timestamp, accept boolean")
    out, decided = E.apply_suggestions(works, sg, F.lit(T0))
    assert out.first()["title"] == "new" and out.first()["lyrics"] == "old" and decided.where("is_reviewed").count() == 2
    c = spark.createDataFrame([(5, "T", "L", "pending", "submission", True, None), (6, "U", "M", "declined", "submission", True, None)], "id int, title string, lyrics string, status string, kind string, accept boolean, published_as long")
    made, after = E.publish_contributions(c, 100)
    assert rows(made, "id", "title") == [(100, "T")] and rows(after, "id", "status") == [(5, "accepted"), (6, "declined")]
    text = spark.createDataFrame([(1, "**a**"), (2, "b")], "id int, lyrics string")
    changed, stats = E.tidy_markers(text)
    assert rows(changed, "id", "before", "after") == [(1, "**a**", "a")] and rows(stats) == [("changed", 1), ("unchanged", 1)]


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, 0, '[{"link":"u1","title":{"rendered":"A &amp; B"},"content":{"rendered":"x"},"tags":[7]}]'), (2, 0, "broken"), (2, 1, '[{"link":"u2","title":{"rendered":"C"},"content":{"rendered":"y"},"tags":[]}]'), (3, 0, '{"code":"error"}'), (4, 0, '[{"link":"u4"}]')],
        "number int, part int, body string",
    )
    posts = crawl.paged_posts(pages)
    assert rows(posts, "link") == [("u1",), ("u2",)]
    terms = spark.createDataFrame([(7, "hijaz", "maqam-")], "id int, name string, prefix string")
    assert {r["link"]: r["labels"] for r in crawl.uniform_posts(posts, terms).collect()} == {"u1": ["maqam-hijaz"], "u2": []}
    maps = spark.createDataFrame([("https://h/a.xml", "<urlset><loc>https://h/1</loc><loc>https://evil/2</loc></urlset>")], "url string, body string")
    assert rows(crawl.sitemap_urls(maps, "h")) == [("https://h/1",)]
    (tmp_path / "index.txt").write_text("http://www.a.com/x?y=1 2020\nhttp://a.com/x 2021\nhttp://a.com/z 2021\n")
    assert rows(crawl.archive_candidates(spark, str(tmp_path / "index.txt")), "url") == [("http://a.com/x",), ("http://a.com/z",)]
    imgs = spark.createDataFrame([("p", '<img src="http://h//a-300x200.jpg"><a href="http://h/a.jpg">')], "link string, html string")
    assert rows(crawl.image_urls(imgs), "url") == [("http://h/a.jpg",)]
    feed = spark.createDataFrame([('{"feed":{"entry":[{"title":{"$t":"T"},"content":{"$t":"B"},"link":[{"rel":"alternate","href":"L"}],"category":[{"term":"naat"}]}]}}',)], "body string")
    assert crawl.feed_posts(feed).first().asDict() == {"link": "L", "title": "T", "html": "B", "labels": ["naat"]}


def test_sinks(spark):
    crawled = spark.createDataFrame([("https://a/1",), ("https://a/1",), ("https://a/2",), ("https://a/3",), ("javascript:x",)], "source_url string")
    known, gone = spark.createDataFrame([("https://a/2",)], "source_url string"), spark.createDataFrame([("https://a/3",)], "source_url string")
    assert rows(sinks.new_works(crawled, known, gone)) == [("https://a/1",)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert rows(sinks.changed_rows(old, old.withColumn("t", F.when(F.col("id") == 2, "c").otherwise(F.col("t"))), "id", ["t"])) == [(2, "c")]
    made = spark.createDataFrame([("x" * 300, None, None, "P", None, "verse", "", "")], "title string, native_title string, language string, author string, dedication string, lyrics string, transliteration string, translation string")
    row = sinks.with_derived(made).first()
    assert len(row["title"]) == 200 and row["language"] == "Unknown" and row["signature"] == "verse"
    page = made.select(sinks.printable(F.lit("A<B"), F.lit(""), {"lyrics": F.lit("a\nb\n\nc")}).alias("h")).first()["h"]
    assert page == '<h1>A&lt;B</h1><section class="lyrics" dir="ltr"><p>a<br>b</p><p>c</p></section>'
    assert made.select(sinks.media_name(F.lit("http://h/My Scan-en.jpg")).alias("m")).first()["m"].startswith("my-scan-en-")


def test_streams_match_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = readers.limited_stream(stream, "user_id", "ts", 2, 86_400).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("limited"), "event_id", "allowed") == rows(M.limited(ev, "user_id", "ts", "event_id", 2, 86_400), "event_id", "allowed")
    q = readers.history_stream(stream, ["user_id"]).writeStream.format("memory").queryName("history").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("history")) == rows(ev.groupBy("user_id").agg(F.max("ts").alias("last_read_at"), F.count("*").alias("read_count")))


def normal(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(normal, v)) if isinstance(v, (list, tuple)) else str(v)


PLAIN = [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.mark.parametrize("name", PLAIN)
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    got = sorted(repr([normal(r[c]) for c in sorted(names)]) for r in found.collect())
    assert got == sorted(repr([normal(r[names.index(c)]) for c in sorted(names)]) for r in want.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith(("op", "pipeline"))])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).columns


def test_benchmark_containment_of_short_and_cut_items(spark):
    from quillspark.plans.texts import benchmark_containment

    docs = {1: "zero one two three four five sixty seventy eight nine ten", 2: "a b", 3: "", 4: None, 5: "x  one two three four five six seven eight nine  y"}
    items = {1: "one", 2: "two three four five six", 3: "one two three four five sixty seven", 4: " one two three four five six seven eight nine ", 5: "ero one two three four five sixty seventy ei", 6: "", 7: None, 8: "a b c"}
    tables = {"documents": spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "benchmark": spark.createDataFrame(list(items.items()), "item_id long, text string")}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if t is not None and x is not None and x in t}
    assert {tuple(r) for r in benchmark_containment(lambda name: tables[name]).collect()} == want


def test_similar_pairs_in_blocks(spark, monkeypatch):
    """many signatures from few trigrams, dealt into blocks, against all pairs; prefixes left nearly all of them open."""
    monkeypatch.setattr(D, "SMALL", 8)
    r = random.Random(3)
    made = []
    for _ in range(150):
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 40))]
        made += [" ".join(words), " ".join(w if r.random() < 0.7 else r.choice("xyz") * 3 for w in words)]
    made += ["a", "b", "ab a", "-", "ça É", " ".join(f"{i:04}" for i in range(400)), " ".join(f"{i:04}" for i in range(60, 400))]
    works = spark.createDataFrame([(i, s) for i, s in enumerate(made)], "id int, signature string")
    lead = {s: i for i, s in reversed(list(enumerate(made)))}
    grams = {i: g for s, i in lead.items() if (g := {f"  {w} "[k : k + 3] for w in re.split(r"[^\w]+", s.lower()) if w for k in range(len(w) + 1)})}
    want = {(a, b) for a, x in grams.items() for b, y in grams.items() if a < b and len(x & y) / len(x | y) >= 0.55}
    found = D.similar_pairs(works).where("matched_on = 'fuzzy'")
    got = [(a, b) for a, b, *_ in rows(found)]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert "Join" not in found._jdf.queryExecution().sparkPlan().toString()


def test_signature_reads_the_opening_alone(spark):
    texts = ["word " * 5000, "Σ" * 900, "ΑΣ" * 700, "x" * 239 + "Σ" + "ʰ" * 40 + "b" * 900, " \n" * 3000 + "late " * 900, "َ" * 2000 + "Ab" * 300, "İ" * 500, "a. " * 260, "", None, "!?" * 700]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert not rows(d.where(~X.signature(F.col("t")).eqNullSafe(F.substring(X.fold(F.col("t")), 1, 240))))
    long = spark.createDataFrame([("a " * 2_000_000,)] * 8, "t string")
    began = time.perf_counter()
    assert {x for (x,) in rows(long.select(X.signature(F.col("t"))))} == {("a " * 120)}
    assert time.perf_counter() - began < 5


def test_copy_differences_of_all_linked_texts(spark, monkeypatch):
    """texts with the same opening, and those linked through one, against all pairs; blocks of a few texts."""
    from quillspark.functions import sequential as Q
    from quillspark.plans.texts import copy_differences

    monkeypatch.setattr(D, "BLOCK_TEXTS", 3, raising=False)
    r = random.Random(7)
    opening = [" ".join(f"{r.choice('abcde')}{r.choice('xyz')}{i % 7}" for i in range(80)) for _ in range(3)]
    texts = [f"{o} {' '.join(r.choice(('one', 'two', 'th<ree')) for _ in range(r.randint(0, 9)))}" for o in opening for _ in range(9)]
    texts += [re.sub(r"\b\w", lambda m: r.choice("qrs") if r.random() < p else m[0], t) for t in texts[::4] for p in (0.05, 0.3)]
    texts += [texts[0], texts[5], texts[5], texts[0].upper(), "lone words here", "-", "", " ", None, None]
    order = r.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    signature = dict(rows(docs.select("doc_id", X.signature(F.col("text")))))
    grams = {i: {f"  {w} "[k : k + 3] for w in re.split(r"[^\w]+", s) if w for k in range(len(w) + 1)} for i, s in signature.items()}
    reps: dict = {}
    want = []
    for i, t in enumerate(texts[k] for k in order):
        if signature[i] and (rep := reps.setdefault(t, i)) != i:
            want.append((rep, i, *Q.differences(t, t)))
    for t, i in reps.items():
        for u, j in reps.items():
            if i < j and (signature[i] == signature[j] or len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.55):
                want.append((i, j, *Q.differences(t, u)))
    assert rows(copy_differences(lambda name: docs)) == sorted(want)
    assert len(want) > 100 and any(w[4] == 0 for w in want) and any(signature[w[0]] == signature[w[1]] and w[4] for w in want)
