"""Scalar text functions as column expressions.

All are built-in expressions and stay inside code generation or higher-order functions; algorithms that are
sequential over a text are in `sequential`. Character classes are written out, as Java's short classes are ASCII only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------------------------------------
#: Marks dropped by folding: vowel marks, maddah and hamza marks, superscript alef, quranic annotation, tatweel.
MARKS = "[\u064b-\u0652\u0653-\u0655\u0670\u06d6-\u06ed\u0640]"
#: Letters that folding takes for the same one.
FOLDED_FROM, FOLDED_TO = "أإآٱىئؤة", "ااااييوه"
#: The vowel marks and annotation alone, the stretch, and the letters that are words by themselves.
VOWEL_MARKS = "[\u064b-\u0652\u0670\u06d6-\u06ed]"
STRETCH = "\u0640"
REAL_SINGLES = "وأا"
ARABIC = "[\u0600-\u06ff]"
LATIN = "[A-Za-z]"
URDU_ONLY = "[ٹڈڑںےۓھہ]"
ARABIC_FORMS = "[يكةى]"
PERSIAN_FORMS = "[یکپچژگ]"
ENGLISH_WORDS = ("the", "and", "of", "to", "is", "in", "you", "my", "your", "our", "we", "he", "his", "o", "lord", "with", "for", "all")
LANGUAGE_CODES = {
    "arabic": "ar", "urdu": "ur", "persian": "fa", "farsi": "fa", "punjabi": "pa", "sindhi": "sd", "pashto": "ps", "english": "en", "turkish": "tr", "french": "fr", "german": "de", "spanish": "es", "swedish": "sv",
}
TAG_PREFIXES = (("maqam-", "maqam"), ("bahr-", "bahr"), ("qasida-", "form"))
TAG_LANGUAGES = ("arabic", "urdu", "english", "spanish", "turkish", "swedish", "french", "german", "persian", "farsi", "punjabi", "sindhi")
TAG_CONDITIONS = ("transliterated", "from-archive", "lyrics-in-images", "text-needs-review")
TAG_FORMS = ("naat", "qasida", "hamd", "manqbat", "manqabat", "manzhuma", "durood-o-salam", "sufiyana-kalam", "mawlid-hadra", "tawassul", "around-the-year", "madih", "nasheed", "ghazal")
TAG_LABELS = {
    "lyrics-in-images": "Lyrics only as scans", "text-needs-review": "Text needs review", "from-archive": "From the Internet Archive", "transliterated": "Has a transliteration", "manqbat": "Manqabat", "durood-o-salam": "Durood o Salam",
}
TAG_AXES = ("form", "language", "maqam", "bahr", "condition", "other")
FORM_WORDS = ("qasida", "qasidah", "naat", "nasheed", "nashid", "mawlid", "manzhuma", "manzuma", "madih", "hadra", "burda", "burdah", "poem", "poetry")
AUTHOR_HINTS = ("sh.", "shaykh", "sheikh", "imam", "sayyid", "sayyidi", "sidi", "mawlana", "al-qutb", "ibn ", "hazrat", "dr.", "prof.")
VIEWER_CHROME = ("Loading...", "Taking too long?", "Reload document", "Open in new tab", "Related Posts")
SIGNATURE_LENGTH = 240
MIN_LETTERS = 12
ENGLISH_SHARE = 0.12
MIN_NATIVE, MIN_NATIVE_SHARE = 40, 0.5
SHATTER_TOKENS, SHATTER_SINGLES, SHATTER_TATWEEL = 20, 0.25, 0.02
LINE_ARABIC_SHARE = 0.35
FURNITURE_LINES, FURNITURE_RATIO, FURNITURE_KEPT = 20, 0.20, 0.9
MEGA_LINE = 400
# -------------------------------------------------------------------------------------------------------------------

_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def blank(c: Column) -> Column:
    """'' for null."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """The lines of a text; a final line break begins no line."""
    parts = F.split(blank(c), _BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(blank(c), F.lit(pattern))


def fold(c: Column) -> Column:
    """The form that search compares: marks dropped, letter variants joined, punctuation to spaces, lower case.

    Text with compatibility characters goes through `sequential.nfkc` first.
    """
    x = F.regexp_replace(blank(c), MARKS, "")
    x = F.translate(F.replace(x, F.lit("ﷲ"), F.lit("الله")), FOLDED_FROM, FOLDED_TO)
    x = F.regexp_replace(x, "(?U)[^\\p{L}\\p{N}_\\s\u0600-\u06ff]+", " ")
    return F.lower(collapse(x))


def search_document(*fields: Column) -> Column:
    """The fields that are not blank, joined and folded."""
    return fold(F.concat_ws(" \n ", *[F.when(f != "", f) for f in fields]))


def opening(c: Column, most: int = SIGNATURE_LENGTH) -> Column:
    """A column whose first `most` characters are those of fold(c). Where the folded opening of a text is long enough the rest is
    not read; a capital sigma, whose small form depends on what follows, takes the whole text."""
    head = F.substring(blank(c), 1, 4 * most)
    short = let(fold(head), lambda o: F.when((F.length(o) >= most + 32) & ~F.contains(head, F.lit("Σ")), o))
    return F.coalesce(short, fold(c))


def signature(*texts: Column) -> Column:
    """The opening of the first text with anything left after folding."""
    return F.substring(F.coalesce(*[let(opening(t), lambda o: F.when(o != "", o)) for t in texts], F.lit("")), 1, SIGNATURE_LENGTH)


def arabic_length(c: Column) -> Column:
    return count(c, ARABIC)


def detect_language(c: Column) -> Column:
    """(code, name) from the letters of a text: ar, ur, fa, en, `latin` for a romanisation, null for too few letters."""
    native, latin = count(c, ARABIC), count(c, LATIN)
    low = F.lower(blank(c))
    words = F.regexp_count(low, F.lit("[a-z]+"))
    # Words are maximal letter runs, so a listed word is one between non-letters.
    english = F.regexp_count(low, F.lit(rf"(?<![a-z])({'|'.join(ENGLISH_WORDS)})(?![a-z])"))
    urdu, arabic, persian = count(c, URDU_ONLY), count(c, ARABIC_FORMS), count(c, PERSIAN_FORMS)
    tokens = count(c, f"{ARABIC}+")
    article = count(c, "(?<![\u0600-\u06ff])ال[\u0600-\u06ff]{2,}")
    code = (
        F.when(native + latin < MIN_LETTERS, F.lit(None).cast("string"))
        .when((latin > native) & (words > 0) & (english / F.greatest(words, F.lit(1)) > ENGLISH_SHARE), "en")
        .when(latin > native, "latin")
        .when(urdu >= F.greatest(F.lit(2.0), native * 0.01), "ur")
        .when((persian > arabic) & (article <= tokens * 0.12), "fa")
        .otherwise("ar")
    )
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("ar", "Arabic", "ur", "Urdu", "fa", "Persian", "en", "English", "latin", None)]), F.coalesce(code, F.lit("latin")))
    return F.struct(code.alias("code"), name.alias("name"))


def is_native_script(c: Column) -> Column:
    native, latin = count(c, ARABIC), count(c, LATIN)
    return (native >= MIN_NATIVE) & (native >= (native + latin) * MIN_NATIVE_SHARE)


def language_code(name: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.lower(strip(blank(name)))), F.lit(""))


def tag_axis(name: Column) -> Column:
    """The axis a tag belongs to: by prefix, then by name."""
    key = F.lower(strip(blank(name)))
    out = None
    for prefix, axis in TAG_PREFIXES:
        out = F.when(key.startswith(prefix), axis) if out is None else out.when(key.startswith(prefix), axis)
    return out.when(key.isin(*TAG_LANGUAGES), "language").when(key.isin(*TAG_CONDITIONS), "condition").when(key.isin(*TAG_FORMS), "form").otherwise("other")


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, lower case elsewhere."""
    runs = F.regexp_extract_all(blank(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def tag_label(name: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in TAG_LABELS.items() for x in pair])
    bare = F.regexp_replace(name, "^(maqam-|bahr-|qasida-)", "")
    return F.coalesce(F.try_element_at(labels, name), title_case(F.translate(bare, "-", " ")))


def split_title(raw: Column) -> Column:
    """(title, native_title, author) of `form | transliteration - native title | author`."""
    parts = F.filter(F.transform(F.split(blank(raw), r"\|"), lambda p: F.regexp_replace(p, "^[ \\t\u200f]+|[ \\t\u200f]+$", "")), lambda p: p != "")
    edge = "^[ \\-–—:|\\t]+|[ \\-–—:|\\t]+$"

    def by_author(p: Column) -> Column:
        """(rest, author) of the parts."""
        last = F.lower(F.try_element_at(p, F.lit(-1)))
        hint = last.rlike("|".join(h.replace(".", r"\.") for h in AUTHOR_HINTS))
        shaped = last.rlike("^(al-|abu |abd )") & (F.size(F.split(strip(last), r"\s+")) <= 5)
        named = (F.size(p) > 1) & (hint | shaped) & ~F.try_element_at(p, F.lit(-1)).rlike(ARABIC)
        return F.when(named, F.struct(F.slice(p, F.lit(1), F.size(p) - 1).alias("rest"), F.element_at(p, -1).alias("author"))).otherwise(F.struct(p.alias("rest"), F.lit("").alias("author")))

    def body(x: Column) -> Column:
        form = (F.size(x["rest"]) > 1) & F.lower(F.regexp_replace(F.try_element_at(x["rest"], F.lit(1)), ":+$", "")).isin(*FORM_WORDS)
        return F.struct(strip(F.array_join(F.when(form, F.slice(x["rest"], 2, 1 << 20)).otherwise(x["rest"]), " | ")).alias("body"), x["author"].alias("author"))

    def by_script(x: Column) -> Column:
        at = F.regexp_instr(x["body"], F.lit(ARABIC))
        latin = F.regexp_replace(F.when(at > 0, F.substring(x["body"], F.lit(1), at - 1)).otherwise(x["body"]), edge, "")
        native = F.when(at > 0, F.regexp_replace(F.substring(x["body"], at, F.length(x["body"])), edge, "")).otherwise("")
        return F.struct(x["body"].alias("body"), x["author"].alias("author"), latin.alias("latin"), native.alias("native"))

    def named(x: Column) -> Column:
        return F.struct(
            F.when(x["latin"] != "", x["latin"]).when(x["native"] != "", x["native"]).otherwise(x["body"]).alias("title"),
            F.when(x["latin"] != "", x["native"]).otherwise("").alias("native_title"), x["author"].alias("author"),
        )

    return let(let(let(let(parts, by_author), body), by_script), named)


def clean_page_title(c: Column) -> Column:
    """A page title without the site's words about the page."""
    first = F.element_at(F.split(blank(c), r"\s*(\|\||\s/\s)\s*", 2), 1)
    tail = r"(?is)\s*[-–—|]*\s*(naat|manqabat|manqbat|hamd|salam|salaam|kalam|kalaam|nasheed|qaseeda|qasida)?\s*lyrics\b.*$"
    return F.regexp_replace(collapse(F.regexp_replace(first, tail, "")), "^[ \\-–—|]+|[ \\-–—|]+$", "")


def clean_html_title(c: Column) -> Column:
    """Tags to spaces, the common character references decoded."""
    x = F.regexp_replace(blank(c), "<[^>]*>", " ")
    for ref, char in (("&#8211;", "–"), ("&#8217;", "’"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        x = F.replace(x, F.lit(ref), F.lit(char))
    return strip(x)


def normalize_url(c: Column) -> Column:
    """Doubled slashes after the scheme made one."""
    return F.when(F.contains(c, F.lit("://")), F.concat(F.substring_index(c, "://", 1), F.lit("://"), F.regexp_replace(F.substring(c, F.instr(c, "://") + 3, F.length(c)), "/{2,}", "/"))).otherwise(c)


def host(url: Column) -> Column:
    """The host name in lower case, without user or port; null without one."""
    authority = F.regexp_extract(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":[0-9]*$", "")), F.lit(""))


def is_web_url(url: Column) -> Column:
    return blank(url).rlike("(?i)^https?://")


def safe_source_url(url: Column, most: int = 500) -> Column:
    """The URL if it is an http(s) one with a host and fits its column, else ''. Tombstones are an anti-join."""
    own = strip(blank(url))
    return F.when(is_web_url(own) & host(own).isNotNull() & (F.length(own) <= most), own).otherwise("")


def same_host(url: Column, name: Column) -> Column:
    return is_web_url(url) & (F.coalesce(host(url), F.lit("")) == F.lower(name))


def youtube_id(value: Column) -> Column:
    """The video id of a link in any of its shapes, or of a bare id; else null."""
    own = strip(blank(value))
    bare = own.rlike("^[A-Za-z0-9_-]{11}$")
    url = F.when(F.contains(own, F.lit("//")), own).otherwise(F.concat(F.lit("https://"), own))
    name = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", ""), r"^m\.", "")
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    in_path = F.regexp_extract(path, "^/(?:embed|v|shorts|live)/([A-Za-z0-9_-]{11})", 1)
    in_query = F.regexp_extract(query, "(?:^|&)v=([^&]+)", 1)
    short = F.regexp_extract(path, "^/*([^/]*)", 1)
    valid = lambda c: F.when(c.rlike("^[A-Za-z0-9_-]{11}$"), c)
    long = F.coalesce(F.nullif(in_path, F.lit("")), valid(in_query))
    return F.when(bare, own).when(name == "youtu.be", valid(short)).when(name.isin("youtube.com", "youtube-nocookie.com", "music.youtube.com"), long)


def video_urls(video: Column) -> Column:
    return F.struct(
        F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), video).alias("embed"), F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("watch"),
        F.concat(F.lit("https://i.ytimg.com/vi/"), video, F.lit("/hqdefault.jpg")).alias("thumbnail"),
    )


def image_caption(url: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(url, "/", -1), r"(?i)\.(jpe?g|png|gif|webp)$", "")
    return F.when(stem.rlike("(?i)[-_](ar|arabic)$"), "Arabic").when(stem.rlike("(?i)[-_](en|english)$"), "English").when(stem.rlike("(?i)[-_](sv|swedish)$"), "Swedish").otherwise("")


def original_image(url: Column) -> Column:
    """The URL of an image's original size."""
    return F.regexp_replace(url, r"(?i)-\d+x\d+\.(jpe?g|png|gif|webp)$", ".$1")


def pick_arabic(urls: Column) -> Column:
    """The first URL that names itself Arabic, else the first."""
    return F.coalesce(F.try_element_at(F.filter(urls, lambda u: F.lower(u).rlike("-ar|arabic")), F.lit(1)), F.try_element_at(urls, F.lit(1)))


def slugify(c: Column) -> Column:
    """ASCII words joined by hyphens. Accents are taken off by `sequential.ascii_fold` first."""
    x = F.lower(F.regexp_replace(blank(c), r"[^\x00-\x7f]", ""))
    x = F.regexp_replace(x, r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(strip(x), r"[-\s]+", "-"), "^[-_]+|[-_]+$", "")


def slug_base(title: Column, transliteration: Column, id_: Column) -> Column:
    first = F.try_element_at(F.filter(lines(transliteration), lambda x: strip(x) != ""), F.lit(1))
    own = F.substring(F.coalesce(F.nullif(slugify(title), F.lit("")), F.nullif(slugify(first), F.lit(""))), 1, 200)
    return F.coalesce(own, F.concat(F.lit("qasida-"), id_.cast("string")))


def meta_description(title: Column, author: Column, dedication: Column, language: Column, transliteration: Column, translation: Column, has_scans: Column, site: str) -> Column:
    """The sentence a search engine shows, composed of what the record has."""
    set_ = lambda c: F.nullif(c, F.lit(""))
    opening = F.concat(F.coalesce(set_(title), F.lit("A qasida")), F.when(author.isNotNull(), F.concat(F.lit(" by "), author)).otherwise(""), F.when(dedication.isNotNull(), F.concat(F.lit(", in praise of "), dedication)).otherwise(""))
    carries = F.array_compact(F.array(
        F.coalesce(F.concat(set_(language), F.lit(" lyrics")), F.lit("lyrics")), F.when(set_(transliteration).isNotNull(), "Latin transliteration"),
        F.when(set_(translation).isNotNull(), "English translation"), F.when(has_scans, "scanned pages"),
    ))
    n = F.size(carries)
    layers = F.when(n > 1, F.concat(F.array_join(F.slice(carries, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(carries, -1))).otherwise(F.element_at(carries, 1))
    return F.concat(opening, F.lit(". Read the "), layers, F.lit(f" on {site}."))


def suggested_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(blank(c), ","), strip), lambda t: (t != "") & (F.length(t) <= 50))


def verse_markers(c: Column) -> Column:
    """Emphasis unwrapped, an emphasised opening on a line of its own, other asterisk runs to line breaks."""
    emphasis = r"\*{1,3}(?=\S)(.+?)(?<=\S)\*{1,3}"

    def one(line: Column) -> Column:
        own = strip(line)
        head = F.regexp_extract(own, f"^{emphasis}", 0)
        opens = (head != "") & (F.length(head) < F.length(own))
        rest = strip(F.regexp_replace(F.substring(own, F.length(head) + 1, F.length(own)), emphasis, "$1"))
        first = strip(F.regexp_extract(own, f"^{emphasis}", 1))
        clean = F.when(opens, F.when(rest != "", F.concat(first, F.lit("\n"), rest)).otherwise(first)).otherwise(F.regexp_replace(line, emphasis, "$1"))
        return F.regexp_replace(F.regexp_replace(clean, "[ \\t\u00a0]*\\*+[ \\t\u00a0]*", "\n"), r"^\n+|\n+\z", "")

    joined = F.array_join(F.transform(lines(c), one), "\n")
    tidy = F.regexp_replace(F.regexp_replace(joined, "(?m)[ \\t\u00a0]+$", ""), r"\n{3,}", "\n\n")
    return F.when(F.contains(blank(c), F.lit("*")), strip(tidy)).otherwise(blank(c))


def describe_shape(c: Column) -> Column:
    """A text's shape without its words."""
    return F.when(blank(c) == "", "(empty)").otherwise(F.substring(F.regexp_replace(blank(c), r"[^\s*|=-]+", "·"), 1, 160))


def shatter_score(c: Column) -> Column:
    """(singles, tatweel, tokens): share of Arabic tokens of one letter, share of tatweel, number of tokens."""
    tokens = F.filter(F.split(blank(c), r"(?U)\s+"), lambda t: t.rlike(ARABIC))
    n = F.size(tokens)
    singles = F.size(F.filter(tokens, lambda t: F.length(F.regexp_replace(t, "^ـ+|ـ+$", "")) <= 1))
    tatweel = count(c, "ـ") / F.greatest(F.length(blank(c)), F.lit(1))
    return F.struct(
        F.when(n == 0, 1.0).otherwise(singles / F.greatest(n, F.lit(1))).alias("singles"), F.when(n == 0, 1.0).otherwise(tatweel).alias("tatweel"), n.alias("tokens"),
    )


def looks_shattered(c: Column) -> Column:
    s = shatter_score(c)
    return (s["tokens"] >= SHATTER_TOKENS) & ((s["singles"] > SHATTER_SINGLES) | (s["tatweel"] > SHATTER_TATWEEL))


def ocr_noise_ratio(c: Column) -> Column:
    tokens = F.filter(F.split(blank(c), r"(?U)\s+"), lambda t: t != "")
    noise = F.filter(tokens, lambda t: t.rlike("[A-Za-z0-9]") & ~t.rlike(ARABIC))
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(noise) / F.greatest(F.size(tokens), F.lit(1)))


def ocr_is_improvement(new: Column, old: Column) -> Column:
    """Better to read, and without loss of content."""
    return (
        (blank(new) != "") & (shatter_score(new)["tokens"] >= SHATTER_TOKENS) & (arabic_length(new) >= arabic_length(old) * 0.6)
        & (ocr_noise_ratio(new) <= 0.25) & (shatter_score(new)["singles"] < shatter_score(old)["singles"])
    )


def arabic_letters(c: Column) -> Column:
    """How many letters from hamza to ya, without tatweel."""
    return count(c, "[\u0621-\u063f\u0641-\u064a]")


def reassembly_is_improvement(new: Column, old: Column) -> Column:
    return (blank(new) != "") & ~looks_shattered(new) & (arabic_letters(new) >= arabic_letters(old) * 0.9)


def _join_lines(parts: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(parts, "\n"), r"\n{3,}", "\n\n"))


def keep_arabic_lines(c: Column) -> Column:
    """Lines that are Arabic enough, without their words of other scripts; blank lines stay."""
    fit = F.filter(F.transform(lines(c), strip), lambda x: (x == "") | ((F.regexp_count(x, F.lit(ARABIC)) >= 2) & (F.regexp_count(x, F.lit(ARABIC)) >= F.length(x) * LINE_ARABIC_SHARE)))
    return _join_lines(F.transform(fit, lambda x: F.array_join(F.filter(F.split(x, r"(?U)\s+"), lambda w: w.rlike(ARABIC)), " ")))


def is_furniture(line: Column) -> Column:
    """Page apparatus: digits and marks, a lone letter or two, or neither Arabic nor a Latin word."""
    own = strip(line)
    arabic = own.rlike(ARABIC)
    marks = own.rlike(r"^[^\p{L}]+$")
    return (own != "") & (marks | (arabic & (F.length(own) <= 2)) | (~arabic & ~own.rlike("[A-Za-z]{3}")))


def furniture_ratio(c: Column) -> Column:
    own = F.filter(lines(c), lambda x: strip(x) != "")
    return F.when(F.size(own) < FURNITURE_LINES, 0.0).otherwise(F.size(F.filter(own, is_furniture)) / F.greatest(F.size(own), F.lit(1)))


def strip_furniture(c: Column) -> Column:
    return _join_lines(F.transform(F.filter(lines(c), lambda x: ~is_furniture(x)), strip))


def furniture_is_safe(c: Column) -> Column:
    """Whether stripping keeps nine tenths of the Arabic letters."""
    return arabic_length(strip_furniture(c)) >= arabic_length(c) * FURNITURE_KEPT


def strip_viewer_chrome(c: Column) -> Column:
    return strip(F.array_join(F.filter(lines(c), lambda x: ~strip(x).isin(*VIEWER_CHROME)), "\n"))


def split_at_script_change(line: Column) -> Column:
    """Pieces of a line between changes of script; spaces belong to no script."""
    marked = F.regexp_replace(line, "(?U)(?<=[\u0600-\u06ff])(\\s*)(?=[^\\s\u0600-\u06ff])|(?<=[^\\s\u0600-\u06ff])(\\s*)(?=[\u0600-\u06ff])", "\n")
    return F.filter(F.transform(F.split(marked, "\n"), strip), lambda p: p != "")


def reflow(c: Column, limit: int = MEGA_LINE) -> Column:
    """Breaks at script changes in lines so long that they are a collapsed page. Only white space changes."""
    pieces = F.flatten(F.transform(F.transform(lines(c), strip), lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(split_at_script_change(x))))
    return _join_lines(pieces)


def same_characters(a: Column, b: Column) -> Column:
    """Equal but for white space."""
    return F.regexp_replace(blank(a), r"(?U)\s+", "") == F.regexp_replace(blank(b), r"(?U)\s+", "")


def split_by_script(c: Column) -> Column:
    """(original, translation): lines where one script has twice the letters of the other; blank lines go to both."""
    own = lines(c)
    native, latin = (lambda x: F.regexp_count(x, F.lit(ARABIC))), (lambda x: F.regexp_count(x, F.lit(LATIN)))
    original = F.filter(own, lambda x: (strip(x) == "") | (native(x) > latin(x) * 2))
    other = F.filter(own, lambda x: (strip(x) == "") | (latin(x) > native(x) * 2))
    return F.struct(_join_lines(F.transform(original, strip)).alias("original"), _join_lines(F.transform(other, strip)).alias("translation"))


def series_part(title: Column) -> Column:
    """(base, n) of a title that ends in a part number, else nulls."""
    pattern = r"(?i)^(.*?)[\s,:–—-]*(?:\(?\s*(?:part|pt\.?|vol\.?|volume|no\.?|number|#)\s*(\d{1,3})\s*\)?|\(\s*(\d{1,3})\s*\))\s*$"
    base = strip(F.regexp_extract(blank(title), pattern, 1))
    n = F.coalesce(F.nullif(F.regexp_extract(blank(title), pattern, 2), F.lit("")), F.nullif(F.regexp_extract(blank(title), pattern, 3), F.lit("")))
    fit = n.isNotNull() & (F.length(base) >= 3)
    return F.struct(F.when(fit, base).alias("base"), F.when(fit, n.cast("int")).alias("n"))


def greedy_chunks(pieces: Column, limit: int, joint: str) -> Column:
    """Pieces joined in order into chunks of at most `limit` characters; a longer piece is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    put = lambda s, p: F.when(s["now"] == "", F.struct(s["done"].alias("done"), p.alias("now"))).when(
        F.length(s["now"]) + len(joint) + F.length(p) > limit, F.struct(F.array_append(s["done"], s["now"]).alias("done"), p.alias("now"))
    ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(joint), p).alias("now")))
    return F.aggregate(pieces, start, put, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def split_long_line(line: Column, limit: int = 180) -> Column:
    words = F.filter(F.split(blank(line), r"(?U)\s+"), lambda w: w != "")
    return F.when(F.length(line) <= limit, F.array(line)).otherwise(greedy_chunks(words, limit, " "))


def split_chunks(c: Column, limit: int = 6000) -> Column:
    """A text in chunks at stanza boundaries, a longer stanza at its lines."""
    stanzas = F.split(strip(blank(c)), r"\n\s*\n")
    own = lambda s: F.filter(lines(s), lambda x: strip(x) != "")
    return greedy_chunks(F.flatten(F.transform(stanzas, lambda s: greedy_chunks(own(s), limit, "\n"))), limit, "\n\n")


def stanzas(c: Column) -> Column:
    """Runs of lines between blank ones."""
    own = F.transform(F.split(strip(blank(c)), r"\n\s*\n+"), lambda b: F.regexp_replace(b, r"^\n+|\n+\z", ""))
    return F.filter(own, lambda b: strip(b) != "")


def direction(c: Column) -> Column:
    return F.when(blank(c).rlike(ARABIC), "rtl").otherwise("ltr")


def web_url(c: Column) -> Column:
    own = strip(blank(c))
    return F.when(is_web_url(own), own).otherwise("")


def submitted(c: Column) -> Column:
    """Line feeds for all line ends, stripped."""
    return strip(F.regexp_replace(blank(c), "\r\n?", "\n"))


def preview(c: Column, most: int = 90) -> Column:
    one = collapse(blank(c))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def merge_orphans(line: Column) -> Column:
    """A line whose single Arabic letters, those that are no words, are joined to a neighbour: the one before, else the one after."""
    orphan = lambda w: w.rlike(f"^{VOWEL_MARKS}*[\u0600-\u06ff&&[^{REAL_SINGLES}{VOWEL_MARKS[1:-1]}]]{VOWEL_MARKS}*$")
    words = F.filter(F.split(blank(line), " +"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))
    put = lambda s, w: F.when(orphan(w) | orphan(s["last"]) | (s["last"] == ""), F.struct(s["done"].alias("done"), F.concat(s["last"], w).alias("last"))).otherwise(
        F.struct(F.concat(s["done"], s["last"], F.lit(" ")).alias("done"), w.alias("last"))
    )
    return F.aggregate(words, start, put, lambda s: F.concat(s["done"], s["last"]))


def keyed_id(value: Column, salt: str, secret: str, length: int = 20) -> Column:
    """The opening of a keyed hash (HMAC by SHA-1, its key derived from salt and secret); `anon` for null. The secret stays on the driver."""
    key = hashlib.sha1((salt + secret).encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    whole = F.sha1(F.concat(outer, F.unhex(F.sha1(F.concat(inner, F.encode(value.cast("string"), "UTF-8"))))))
    return F.coalesce(F.substring(whole, 1, length), F.lit("anon"))


def mixed_password(c: Column) -> Column:
    """Whether a password has a letter and something else."""
    return blank(c).rlike(r"\p{L}") & blank(c).rlike(r"(?s)[^\p{L}]")


def message_is_fit(message: Column, trap: Column) -> Column:
    """Whether a message has ten characters or more and its hidden field is blank."""
    return (F.length(strip(blank(message))) >= 10) & (strip(blank(trap)) == "")


def percent(score: Column) -> Column:
    return F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%"))


def trigram_words(c: Column) -> Column:
    """The words whose three-letter runs a text is compared by, in lower case."""
    return F.filter(F.split(F.lower(blank(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """The distinct three-letter runs of a text's words, each word padded with two spaces before and one after."""
    padded = F.transform(trigram_words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def client_ip(forwarded: Column, remote: Column, trusted: int) -> Column:
    """The hop that the outermost trusted proxy wrote, if it is an address; else the remote address."""
    if not trusted:
        return remote
    hops = F.filter(F.transform(F.split(blank(forwarded), ","), strip), lambda h: h != "")
    own = F.try_element_at(hops, F.lit(-trusted))
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    is_ip = own.rlike(rf"^{octet}(\.{octet}){{3}}$") | (own.rlike("^[0-9A-Fa-f:]{2,39}$") & F.contains(own, F.lit(":")))
    return F.when(is_ip, own).otherwise(remote)
