"""Functions of sources, sinks, streams and editorial jobs on small inputs."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from test_text import values

from quillspark.functions import sequential as Q
from quillspark.functions import text as X
from quillspark.operators import duplicates as D
from quillspark.operators import editorial as E
from quillspark.operators import glyphs as G
from quillspark.operators import limits as M
from quillspark.operators import relations as R
from quillspark.operators import search as S
from quillspark.sources import crawl, sinks
from quillspark.streaming import locks, readers

T0 = dt.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_rebuilt_text(spark):
    def line(page, y, text, x=100.0, width=10.0, gap=8.0):
        out = []
        for c in text:
            if c == " ":
                x -= gap
                continue
            out.append((page, len(out), c, x - width, y, x, y + 10))
            x -= width
        return out

    drawn = line(1, 20.0, "نور على") + line(1, 0.0, "قصيدة") + line(1, 40.3, "سلـام", gap=0) + line(2, 0.0, "ab") + [(2, 9, " ", 0.0, 0.0, 5.0, 10.0), (3, 0, "ـ", 0.0, 0.0, 5.0, 10.0)]
    glyphs = spark.createDataFrame(drawn, "page int, at int, glyph string, x0 double, y0 double, x1 double, y1 double")
    assert rows(G.rebuilt_text(glyphs, ["page"])) == [(1, "قصيدة\nنور على\nسلام"), (2, "ab")]
    assert rows(G.rebuilt_text(glyphs.limit(0), ["page"])) == []


def test_lock(spark, tmp_path):
    folder, ran = str(tmp_path / "locks"), []
    first = locks.acquire(spark, folder, "nightly")
    assert first and locks.acquire(spark, folder, "nightly") is None and not locks.single_flight(spark, folder, "nightly", lambda: ran.append(0))
    assert locks.acquire(spark, folder, "other")
    second = locks.acquire(spark, folder, "nightly", hours=0)  # the first has run out
    locks.release(spark, first)
    assert second and second != first and locks.acquire(spark, folder, "nightly") is None
    locks.release(spark, second)
    with pytest.raises(ValueError):
        locks.single_flight(spark, folder, "nightly", lambda: int("x"))
    assert locks.single_flight(spark, folder, "nightly", lambda: ran.append(1)) and ran == [1]


def test_throttled(spark):
    tries = spark.createDataFrame([(i, "h", x) for i, x in enumerate("RRARERRA")], "i int, host string, x string")
    out = R.throttled(tries, "host", ["i"], F.col("x") == "R", F.col("x") == "A", most=3)
    assert [(r["in_a_row"], r["pause"]) for r in out.orderBy("i").collect()] == [(1, 30), (2, 60), (0, 0), (1, 30), (1, 0), (2, 60), (3, 0)]


def test_limits_in_force(spark):
    tries = [(i, "login", "a", T0 + dt.timedelta(seconds=i), False) for i in range(10)] + [(20 + i, "contact", "a", T0 + dt.timedelta(seconds=i), False) for i in range(8)]
    tries += [(40, "login", "b", T0, False), (41, "login", "a", T0 + dt.timedelta(seconds=900), False), (42, "contact", "a", T0 + dt.timedelta(seconds=900), False), (43, "contact", None, T0, False), (44, None, "a", T0, False), (45, "read", "a", T0, False)]
    events = spark.createDataFrame(tries, "event_id int, action string, client string, ts timestamp, good boolean")
    refused = [r[0] for r in rows(M.limited_actions(events, "action", "client", "ts", "event_id").where("not allowed"), "event_id")]
    assert refused == [8, 9, 26, 27, 42]
    cleared = events.withColumn("good", F.col("event_id") == 5)  # a login that succeeds ends the counter
    assert [r[0] for r in rows(M.limited_actions(cleared, "action", "client", "ts", "event_id", "good").where("not allowed"), "event_id")] == [26, 27, 42]


def test_post_bodies(spark):
    page = '<h2>My <b>Poem</b></h2><h2>Part one</h2><p>first line</p><p>second</p>\n\n<div class="x sharedaddy">share</div><p>Download now</p><script>x</script><p>third<br>fourth &amp; last</p>'
    posts = spark.createDataFrame([(1, "My Poem", page), (2, None, None), (3, "x", "<h1>X lyrics</h1>")], "id int, title string, html string")
    got = dict(rows(crawl.post_texts(posts), "id", "lyrics"))
    assert got[2] == got[3] == "" and got[1] == "Part one\nfirst line\nsecond\n\nthird\n\nfourth & last"


def test_listing_posts(spark):
    listing = '<a href="https://h/2015/01/a">a</a><a href="https://h/2015/01/a">a</a><a href="https://evil/2016/b">b</a><a href="https://h/about">c</a>'
    assert Q.listing_links(listing) == ["https://h/2015/01/a", "https://evil/2016/b"]
    assert Q.listing_links('<a href="/2009/x">x</a><div id="content"><p><a href="https://h/2009/y">y</a></div>') == ["https://h/2009/y"]
    entry = '<h1 class="entry-title"> A <i>title</i></h1><div class="entry-content"><p> one </p>two<div class="wpcnt">ad</div></div>'
    pages = spark.createDataFrame([("https://h/2015/01/a", entry), ("https://evil/2016/b", entry)], "url string, html string")
    assert rows(crawl.listing_posts(spark.createDataFrame([(listing,), (None,)], "html string"), pages, "h")) == [("https://h/2015/01/a", "Atitle", "one\ntwo")]
    assert Q.entry_post("<p>x") == ("Unknown Title", None)


def test_files_by_their_first_bytes(spark, tmp_path):
    for name, data in {"a.png": b"\x89PNG\r\n\x1a\n0000", "b.bin": b"\xff\xd8\xff\xe0rest", "c.webp": b"RIFF\x01\x02\x03\x04WEBPxx", "d.pdf": b"%PDF-1.7", "e.png": b"no image", "f": b""}.items():
        (tmp_path / name).write_bytes(data)
    assert [(p.rsplit("/", 1)[1], m, s) for p, m, s in rows(crawl.image_files(spark, str(tmp_path)), "path", "mime", "as_is")] == [("a.png", "image/png", True), ("b.bin", "image/jpeg", True), ("c.webp", "image/webp", True)]
    assert [r["path"].rsplit("/", 1)[1] for r in crawl.pdf_files(spark, str(tmp_path)).collect()] == ["d.pdf"]


def test_bundles_and_labels(spark):
    body = 'x={url:"u1",title:"A"},{url:"u2",n:1,title:"B"},{url:"u1",title:"C"}'
    assert rows(crawl.bundle_records(spark.createDataFrame([(body,), (None,)], "body string"))) == [("u1", "A"), ("u2", "B")]
    posts = spark.createDataFrame([(1, ["Naat"]), (2, ["news"]), (3, []), (4, None), (5, ["news", "old qaseeda"])], "id int, labels array<string>")
    assert [r[0] for r in rows(crawl.verse_labels_only(posts), "id")] == [1, 3, 4, 5]


def test_tagged_facets(spark):
    works = spark.createDataFrame([(1, "ar", True), (2, "ur", True), (3, "ar", False), (4, "ar", True)], "id int, language string, ok boolean")
    bridge = spark.createDataFrame([(1, "naat"), (1, "hamd"), (2, "naat"), (3, "naat"), (4, "hamd"), (1, "naat")], "work_id int, tag string")
    got = S.tagged_facets(works, bridge, ["NAAT"], {"ok": F.col("ok"), "language": F.col("language") == "ar"}, {"language": "language"})
    assert rows(got) == [("language", "ar", 1), ("language", "ur", 1), ("tag", "hamd", 1), ("tag", "naat", 1)]


def test_keyed_ids_and_forms(spark):
    key = hashlib.sha1(b"saltsecret").digest()
    want = hmac.new(key, b"42", hashlib.sha1).hexdigest()[:20]
    assert values(spark, lambda c: X.keyed_id(c, "salt", "secret"), "42", None) == [want, "anon"]
    assert values(spark, X.mixed_password, "abc", "abc1", "123", "", None, "é\n") == [False, True, False, False, False, True]
    assert values(spark, X.message_is_fit, ("long enough text", ""), ("  short   ", ""), ("long enough text", "bot"), (None, None)) == [True, False, False, False]


def test_derived_columns_meet_composed_queries(spark):
    made = spark.createDataFrame([("ﬁne Ｎａａｔ", "", "", "", None, "ﷺ verse", None, None)], "title string, native_title string, language string, author string, dedication string, lyrics string, transliteration string, translation string")
    document = sinks.with_derived(made).first()["search_text"]
    assert Q.fold("fine naat") in document and Q.fold("ﷺ") in document


def test_sentences_and_links(spark):
    said = lambda *c: X.meta_description(c[0], c[1], c[2], c[3], c[4], c[5], F.lit(True), "site")
    assert values(spark, said, ("T", "P", "D", "Urdu", "x", "y"), ("", None, None, "", "", "")) == [
        "T by P, in praise of D. Read the Urdu lyrics, Latin transliteration, English translation and scanned pages on site.",
        "A qasida. Read the lyrics and scanned pages on site.",
    ]
    assert values(spark, X.image_caption, "http://h/a_Friend-en.jpg", "http://h/a-ar.png", "http://h/a-swedish.gif", "http://h/a.jpg") == ["English", "Arabic", "Swedish", ""]
    assert values(spark, lambda c: X.pick_arabic(F.split(c, " ")), "a.pdf b-ar.pdf", "a.pdf b.pdf", "x-Arabic.pdf") == ["b-ar.pdf", "a.pdf", "x-Arabic.pdf"]
    assert values(spark, lambda c: X.video_urls(c)["watch"], "abc") == ["https://www.youtube.com/watch?v=abc"]
    assert values(spark, X.suggested_tags, "a, b ,, " + "x" * 51, None) == [["a", "b"], []]
    assert values(spark, X.web_url, " https://h/x ", "ftp://h", None) == ["https://h/x", "", ""]
    assert values(spark, X.strip_viewer_chrome, "verse\nLoading...\nRelated Posts\nmore", None) == ["verse\nmore", ""]


def test_gain_guards(spark):
    whole, broken = "كلمة طيبة " * 15, "ك ل م ة " * 15
    assert values(spark, X.ocr_is_improvement, (whole, broken), (broken, whole), ("", broken), (whole + "abc " * 30, broken)) == [True, False, False, False]
    assert values(spark, X.reassembly_is_improvement, (whole, broken), (broken, whole), ("", whole), ("كلمة", whole)) == [True, False, False, False]


def test_batch_jobs(spark):
    verse = "\n".join(["هذا بيت من الشعر الطويل"] * 20)
    noise = "\n".join(["12", "— 3 —"] * 4)
    long = "قال الشاعر " * 50 + "and then the poet said " * 10
    mixed = "\n".join(["هذا بيت من الشعر الطويل"] * 10 + ["and this is its translation"] * 10)
    works = spark.createDataFrame([(1, verse + "\n" + noise, None), (2, verse, ""), (3, long, ""), (4, mixed, ""), (5, mixed, "have one"), (6, None, None)], "id int, lyrics string, translation string")
    changed, stats = E.tidy_lyrics(works.where("id < 3 or id = 6"))
    assert rows(changed, "id", "after") == [(1, verse)] and rows(stats) == [("changed", 1), ("unchanged", 2)]
    changed, _ = E.reflow_lyrics(works)
    assert [(i, a.count("\n")) for i, a in rows(changed, "id", "after")] == [(3, 1)]
    (one,) = rows(E.split_translations(works))
    assert one[0] == 4 and one[1].count("\n") == 9 and one[2].startswith("and this")


def test_editorial_views(spark):
    tags = spark.createDataFrame([("naat", "other"), ("maqam-x", "form")], "name string, category string")
    assert rows(E.refile_tags(tags)) == [("maqam-x", "maqam"), ("naat", "form")]
    accounts = spark.createDataFrame([(1, True, False), (2, True, True), (3, True, False)], "id int, is_active boolean, is_superuser boolean")
    assert rows(E.suspend(accounts, F.lit(True), 1, False), "id", "is_active") == [(1, True), (2, True), (3, False)]
    assert rows(E.suspend(accounts, F.lit(True), 1, True), "id", "is_active") == [(1, True), (2, False), (3, False)]
    assert [tuple(r) for r in values(spark, E.shown_layer, ("a", "b"), (" ", "b"), (None, None))] == [("lyrics", "a"), ("transliteration", "b"), ("transliteration", "")]
    assert values(spark, E.present_layers, (" abc ", "", "xy"), (None, None, None)) == ["lyrics (3), translation (2)", ""]
    assert values(spark, lambda a, b: E.proposal_labels(title=a, native_title=b), ("x", "y"), (" ", None)) == ["Title, Native title", "Report only"]
    assert rows(E.decision_counts(tags, F.col("name") == "naat")) == [(1, 1)]
    holders = E.confirmed_holders(spark.createDataFrame([(1, "A@b.c"), (2, "a@b.c")], "user_id int, email string"), spark.createDataFrame([(2,)], "id int"), "a@B.c")
    assert rows(holders, "user_id") == [(1,)]
    links = spark.createDataFrame([(1, 2, "pending", 0.7, T0), (3, 4, "pending", 0.9, T0), (5, 6, "distinct", 1.0, T0)], "first int, second int, state string, score double, created_at timestamp")
    assert rows(D.next_pending(links), "first") == [(3,)]
    works = spark.createDataFrame([(1, "pending", None), (2, "approved", T0)], "id int, review_state string, reviewed_at timestamp")
    assert rows(E.set_state(works, F.lit(True), "approved", F.lit(T0))) == [(1, "approved", T0), (2, "approved", T0)]
    assert values(spark, lambda c: X.percent(c.cast("double")), "0.554", "1") == ["55%", "100%"]


def test_small_sinks(spark):
    deleted = spark.createDataFrame([("https://a/1",), ("https://a/1",), ("",), (None,)], "source_url string")
    assert rows(sinks.tombstones_of(deleted)) == [("https://a/1",)]
    entries = spark.createDataFrame([(i, f"https://h/?a={i}&b", T0, "0.5") for i in range(5)], "id int, loc string, lastmod timestamp, priority string")
    got = rows(sinks.sitemap_lines(entries, 2))
    assert [s for s, _ in got] == [0, 0, 1, 1, 2] and got[4][1] == "<url><loc>https://h/?a=4&amp;b</loc><lastmod>2024-01-01</lastmod><priority>0.5</priority></url>"
    assert rows(sinks.json_lines(spark.createDataFrame([(1, "x")], "a int, b string"))) == [('{"a":1,"b":"x"}',)]
    assert values(spark, lambda c: sinks.file_name(c, ["lyrics", "translation"]), "My Poem", "شعر") == ["my-poem-lyrics-translation.pdf", "work-lyrics-translation.pdf"]
    drafts = spark.createDataFrame([(1, hashlib.sha256(b"a").hexdigest()), (2, "old")], "work_id int, text_hash string")
    assert rows(readers.unchanged_only(drafts, spark.createDataFrame([(1, "a"), (2, "b")], "id int, lyrics string")), "work_id") == [(1,)]


def test_streams_over_stored_files(spark, tmp_path):
    calls = [(T0 + dt.timedelta(hours=h), "m", 1, 2) for h in (0, 19, 21, 80)]
    spark.createDataFrame(calls, "ts timestamp, model string, tokens_in long, tokens_out long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, model string, tokens_in long, tokens_out long").parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.table(name))

    day = dt.date(2024, 1, 1)
    assert [r for r in drain(readers.usage_stream(stream), "used", "append") if r[0] <= dt.date(2024, 1, 2)] == [(day, "m", 2, 2, 4), (dt.date(2024, 1, 2), "m", 1, 1, 2)]
    assert len(drain(readers.first_seen_stream(stream, "model", "ts"), "seen", "append")) == 1
    held: dict[int, list] = {}
    merge = readers.merge_batches(lambda: spark.createDataFrame([("m", 1)], "model string, calls long"), lambda now, new: now.union(new.groupBy("model").agg(F.count("*"))).groupBy("model").agg(F.sum("calls").alias("calls")), lambda df, n: held.__setitem__(n, rows(df)))
    readers.nightly(stream, merge, str(tmp_path / "n"), "nightly").awaitTermination()
    assert held == {0: [("m", 5)]}
