from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.functions import sequential as Q
from quillspark.functions import text as X
from quillspark.operators import layers as L


def values(spark, fn, *rows):
    """fn applied to each row of strings."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0])))).coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(*[F.col(f"c{k}") for k in range(len(rows[0]))]).alias("r")).collect()]


def test_fold(spark):
    assert values(spark, X.fold, "بِحَقِّ اللهِ", "Hello,  World_1!", None, "أإآٱ ى ة", "a-b") == ["بحق الله", "hello world_1", "", "اااا ي ه", "a b"]
    once = values(spark, X.fold, "Ünïcode — «text»  x", "ﷲ")
    assert values(spark, X.fold, *once) == once


def test_verse_markers(spark):
    cases = {"**a title**": "a title", "**Heading** the verse follows": "Heading\nthe verse follows", "one ** two ** three ** four": "one\ntwo\nthree\nfour", "* edge *": "edge", "plain": "plain"}
    assert values(spark, X.verse_markers, *cases) == list(cases.values())


def test_language(spark):
    got = values(spark, lambda c: X.detect_language(c)["code"], "the lord of the worlds is with you and for all", "ye ishq nahi asan itna samajh lijiye", "یہ ہے محبت ٹوٹے ہوئے دل کی ایک کہانی", "الحمد لله رب العالمين على كل حال", "short", None)
    assert got == ["en", "latin", "ur", "ar", None, None]


def test_titles(spark):
    got = values(spark, X.split_title, "Qasida | Ithna 'Ashara - القصيدة الاثنى عشرة | Sh. Muhammad al-Yaqoubi", "A plain title", "القصيدة", "", None)
    assert [tuple(r) for r in got] == [("Ithna 'Ashara", "القصيدة الاثنى عشرة", "Sh. Muhammad al-Yaqoubi"), ("A plain title", "", ""), ("القصيدة", "", ""), ("", "", ""), ("", "", "")]
    assert values(spark, X.clean_page_title, "Ya Nabi-Naat Lyrics in Roman English, Hindi and Urdu || x") == ["Ya Nabi"]


@pytest.mark.parametrize(("url", "want"), [("https://youtu.be/abcdefghijk?t=1", "abcdefghijk"), ("m.youtube.com/watch?a=1&v=abcdefghijk", "abcdefghijk"), ("https://www.youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("abcdefghijk", "abcdefghijk"), ("https://vimeo.com/1", None), ("https://youtu.be/short", None), (None, None)])
def test_youtube(spark, url, want):
    assert values(spark, X.youtube_id, url) == [want]


def test_urls(spark):
    urls = ["https://site.com/a", "https://site.com.evil.tld/", "https://site.com@10.0.0.5/", "file:///etc/passwd", "javascript:alert(1)", "https://site.com/" + "x" * 600, None]
    assert values(spark, lambda c: X.same_host(c, F.lit("site.com")), *urls[:5]) == [True, False, False, False, False]
    assert values(spark, X.safe_source_url, *urls) == [urls[0], urls[1], urls[2], "", "", "", ""]
    assert values(spark, X.normalize_url, "https://nur.nu//damas//x") == ["https://nur.nu/damas/x"]


def test_tags(spark):
    names = ["maqam-hijaz", "bahr-kamil", "naat", "urdu", "from-archive", "unknown", None]
    assert values(spark, X.tag_axis, *names) == ["maqam", "bahr", "form", "language", "condition", "other", "other"]
    assert values(spark, X.tag_label, "maqam-hijaz", "bahr-kamil", "sufiyana-kalam", "durood-o-salam") == ["Hijaz", "Kamil", "Sufiyana Kalam", "Durood o Salam"]
    assert values(spark, X.title_case, "durood-o salam") == ["Durood-O Salam"]


def test_similarity(spark):
    assert values(spark, X.similarity, ("word", "two words"))[0] == pytest.approx(0.363636, abs=1e-6)
    assert values(spark, X.similarity, ("", "x"), ("abc", "abc"), ("two words", "word")) == [0.0, 1.0, pytest.approx(0.363636, abs=1e-6)]


def test_repair(spark):
    assert values(spark, X.shatter_score, "ا ب ت ث")[0]["singles"] == 1.0
    assert values(spark, X.keep_arabic_lines, "abc\nالله abc نور\n\n\n\nxyz") == ["الله نور"]
    assert values(spark, X.strip_furniture, "12\nverse one\n--\n\n\n\nverse two") == ["verse one\n\nverse two"]
    long = "latin words here " * 20 + "كلمات عربية " * 10
    out = values(spark, X.reflow, long)[0]
    assert out.count("\n") == 1 and out.replace("\n", "").replace(" ", "") == long.replace(" ", "")
    assert values(spark, X.series_part, "My poem (Part 3)", "No number")[0].asDict() == {"base": "My poem", "n": 3}
    assert values(spark, lambda c: X.split_chunks(c, 10), "aaaa\nbbbb\n\ncccccccc\n\ndd") == [["aaaa\nbbbb", "cccccccc", "dd"]]
    assert values(spark, lambda c: X.split_long_line(c, 7), "one two three") == [["one two", "three"]]


def test_client_ip(spark):
    assert values(spark, lambda f, r: X.client_ip(f, r, 1), ("1.1.1.1, 2.2.2.2", "9.9.9.9"), ("nonsense", "9.9.9.9"), (None, "9.9.9.9")) == ["2.2.2.2", "9.9.9.9", "9.9.9.9"]


def test_layout(spark):
    def made(lyrics, latin, translation):
        r = values(spark, L.layout, (lyrics, latin, translation))[0]
        return [tuple(x) for x in r["rows"]], r["loose"]

    assert made("a\nb\n\nc", "x\ny\n\nz", "") == ([("a\nb", "x\ny", ""), ("c", "z", "")], [])
    assert made("a\n\nb\n\nc", "x\ny\nz", "") == ([("a", "x", ""), ("b", "y", ""), ("c", "z", "")], [])
    twelve = "\n".join("abcdefghijkl")
    rows, loose = made(twelve, twelve.upper(), "\n".join("mnopqrstuvw"))
    assert len(rows) == 3 and loose == ["translation"] and rows[0][1] == "A\nB\nC\nD"
    assert made("a\nb\nc", "x", "") == ([("a\nb\nc", "x", "")], [])
    assert made("a  b\nc  d", "w\nx\ny\nz", "")[0] == [("a  b\nc  d", "w\nx\ny\nz", "")]


def test_differences():
    assert Q.differences("one two three", "one 2 three")[2] == 1
    refrain = "\n".join(f"line {i}\nrefrain again" for i in range(12))
    assert Q.differences(refrain, refrain.replace("line 3", "line x") + "\nmore words")[2] == 2
    assert Q.differences("بِحَقِّ", "بحق")[2] == 0
    assert Q.differences("a b", "a c")[0] == 'a <mark class="q-diff">b</mark>'


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_fewest_edits(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    pairs = Q.fewest_edits(a, b)
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_romanise():
    assert Q.romanise_text("الله") == "Allah"
    assert Q.romanise_text("الشمس").startswith("ash-sh") and Q.romanise_text("القمر").startswith("al-q")
    assert Q.romanise_text("hello") == "hello" and Q.romanise_text(None) == ""
    assert Q.romanise_text("مُحَمَّد") == "Muhammad"


def test_slugs(spark):
    assert Q.suffixed(["a", "a", "a-2", "a", "b"]) == ["a", "a-2", "a-2-2", "a-3", "b"]
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-2"), (4, "b"), (5, "b")], "id int, base string")
    assert {r["id"]: r["slug"] for r in Q.unique_slugs(df, "id", "base").collect()} == {1: "a", 2: "a-2", 3: "a-2-2", 4: "b", 5: "b-2"}
    assert values(spark, lambda t, x: X.slug_base(t, x, F.lit(7)), ("قصيدة", ""), ("Hello, World", ""), ("قصيدة", "\nYa Nabi")) == ["qasida-7", "hello-world", "ya-nabi"]


PAGE = """<html><body><nav>Home</nav><h1>Ya Nabi</h1><div id="c"><p>Shayar: Test Poet</p><p>Ya nabi salam<br>Ya rasul salam</p>
<p>या नबी सलाम</p><p>شاعر: شاعر نام</p><p>یا نبی سلام<br>یا رسول سلام</p><p>Naat-Khwaan: Someone</p></div></body></html>"""


def test_pages():
    got = Q.split_page(PAGE)
    assert got == {"urdu": "یا نبی سلام\nیا رسول سلام", "roman": "Home\n\nYa nabi salam\nYa rasul salam", "poet": "Test Poet", "poet_native": "شاعر نام"}
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"MusicComposition","name":"T","lyrics":{"text":"' + "verse " * 30 + '"},"author":{"name":"A"}}]}</script>'
    assert Q.extract_work(ld)["via"] == "json-ld" and Q.extract_work(ld)["author"] == "A"
    verse = "<div>" + "".join(f"<p>a short verse line number {i}</p>" for i in range(8)) + "</div>"
    work = Q.extract_work(f"<h1>Title</h1>{verse}")
    assert work["title"] == "Title" and len(work["lyrics"].splitlines()) >= 8
    assert Q.extract_work("<p>nothing</p>") is None and Q.extract_work(None) is None


def test_merge_orphans(spark):
    assert values(spark, X.merge_orphans, "ق صيدة و نور", "نور ق", "a b", "", None, "قَ صيدة") == ["قصيدة و نور", "نورق", "a b", "", "", "قَصيدة"]


def test_differences_of_texts_far_apart():
    """texts that have hundreds of edits between them; a step for each edit and diagonal took over a second a pair."""
    r = random.Random(5)
    texts = [" ".join(r.choice(("the", "of", "and")) if r.random() < 0.3 else f"w{r.randrange(3000)}" for _ in range(900)) for _ in range(40)]
    began = time.perf_counter()
    found = [Q.fewest_edits(a.split(), b.split()) for a, b in zip(texts, texts[1:], strict=False)]
    assert time.perf_counter() - began < 2
    for pairs, a, b in zip(found, texts, texts[1:], strict=False):
        assert pairs and all(a.split()[i] == b.split()[j] for i, j in pairs)


def furthest_reaching(a, b, most):
    """The path by furthest-reaching diagonals, a step for each edit and diagonal."""
    reach = {1: (0, ())}
    for edits in range(min(len(a) + len(b), most) + 1):
        for k in range(-edits, edits + 1, 2):
            down, right = reach.get(k + 1, (-1, ())), reach.get(k - 1, (-1, ()))
            x, path = down if k == -edits or k != edits and right[0] < down[0] else (right[0] + 1, right[1])
            while x < len(a) and 0 <= x - k < len(b) and a[x] == b[x - k]:
                path, x = (*path, (x, x - k)), x + 1
            reach[k] = x, path
            if x >= len(a) and x - k >= len(b):
                return list(path)
    return None


@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.sampled_from([0, 2, 5, 1500]))
@settings(max_examples=300, deadline=None)
def test_fewest_edits_take_the_furthest_reaching_path(a, b, most):
    assert Q.fewest_edits(list(a), list(b), most) == furthest_reaching(a, b, most)


def test_html_titles_as_their_sql(spark, tmp_path):
    """quotes, other references, white space of all kinds, null and missing titles."""
    import duckdb

    titles = ["a &quot;b&quot; &amp;quot; &amp;amp;", "  a ", "\n a\t", "&#39;x&#8211; &lt;b&gt; &nbsp;", "a > b", "", "\u3000\u00a0z \u2003", "x\u0085", "\u200by"]
    pages = [*[f"<title>{t}</title><title>two</title>" for t in titles], "none", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        want = sorted(c.execute(entry.oracle_sql()["html_titles"]).fetchall())
    assert sorted(tuple(r) for r in entry.queries()["html_titles"](spark, str(tmp_path)).collect()) == want


def test_differences_of_long_texts():
    """over 15,000 words, and over 1,500 edits, where the longest runs were taken and not the fewest edits."""
    words = [f"w{i}" for i in range(15_500)]
    changed = [*words[:100], "x", *words[101:9000], "y", "z", *words[9000:]]
    assert Q.differences(" ".join(words), " ".join(changed))[1:] == (" ".join(changed).replace(" x ", ' <mark class="q-diff">x</mark> ').replace("y z", '<mark class="q-diff">y z</mark>'), 2)
    a, b = [*"ab" * 900, *words[:5], *"cd" * 900], [*words[:5], *"ab" * 900, *words[5:9]]
    assert len(Q.fewest_edits(a, b)) == 1800
    assert Q.differences(" ".join(a), " ".join(b))[2] == 2


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=2, max_size=6), st.sampled_from([1, 60, 1 << 24]))
@settings(max_examples=200, deadline=None)
def test_texts_in_lanes_are_aligned_as_alone(texts, kept):
    """many texts in one row of bits, with rows and masks kept or worked out again."""
    before, Q.KEPT_BYTES = Q.KEPT_BYTES, kept
    try:
        texts = dict(enumerate(map(" ".join, texts)))
        got = list(Q.all_differences(texts, {i: [j for j in texts if j > i] for i in texts}))
    finally:
        Q.KEPT_BYTES = before
    assert sorted(got) == [(i, j, *Q.differences(texts[i], texts[j])) for i in texts for j in texts if i < j]
