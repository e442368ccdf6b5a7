"""Text functions on columns. All stay in the JVM; nulls count as empty text unless a function says otherwise.

White space is Unicode white space as in `WS`; lower case is the JVM's. Paragraphs are parted by `sep`, by default a
blank line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinfeed.functions import lexicon as L

# Fixed value: the characters that count as white space.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ENDING = r"[.!?।\"')\]]$"
_BLANK_LINE = r"\n{2,}"


def fused(pieces) -> str:
    """One alternation of patterns, those with the same first letter under it, so that most positions fail at one look."""
    by_first: dict[str, list[str]] = {}
    groups = []
    for p in pieces:
        n = 3 if p.startswith(r"\b") else 2 if p[0] == "\\" else 1
        if p[n - 1 : n] == "(" or p[n : n + 1] in tuple("*+?{"):  # no single first letter
            groups.append(p)
        else:
            by_first.setdefault(p[:n], []).append(p[n:])
    firsts = "".join(dict.fromkeys(a.removeprefix(r"\b") for a in by_first))
    plain = "|".join(f"{a}(?:{chr(124).join(rest)})" for a, rest in by_first.items())
    return f"(?:(?=[{firsts}])(?:{plain})" + "".join(f"|{g}" for g in groups) + ")"


def phrase(words_: str) -> str:
    """A pattern of these very characters."""
    return "".join(c if c.isalnum() or c == " " or ord(c) > 127 else f"[{c}]" for c in words_)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f uses it."""
    return F.transform(F.array(c), lambda v: f(v))[0]  # a function of two parameters would get the index too


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(text(c), f"[{WS}]+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def match_key(c: Column, spaces: bool = False) -> Column:
    """Lower-case letters and digits of the Latin and Telugu scripts, by which titles and sentences compare."""
    return F.regexp_replace(F.lower(text(c)), f"[^a-z0-9{' ' if spaces else ''}\\x{{0c00}}-\\x{{0c7f}}]", "")


def paragraphs(c: Column, sep: str = _BLANK_LINE) -> Column:
    return F.filter(F.transform(F.split(text(c), sep), strip), lambda p: p != "")


def has_telugu(c: Column) -> Column:
    return c.rlike(r"[\x{0c00}-\x{0c7f}]")


def hits(c: Column, needles) -> Column:
    """How many of the needles are substrings."""
    return let(c, lambda v: F.size(F.filter(F.array(*(F.lit(n) for n in needles)), lambda n: F.contains(v, n))))


# identities, scores, labels


def article_id(url: Column, title: Column) -> Column:
    return F.md5(F.concat_ws("|", strip(url), strip(title)))


def sentiment(title: Column, description: Column) -> tuple[Column, Column]:
    """(label, score) by words found as substrings: 60 + 5 for each good one - 4 for each bad one, kept within 38 and 99."""
    t = F.lower(F.concat_ws(" ", text(title), text(description)))
    good, bad = hits(t, L.POSITIVE), hits(t, L.NEGATIVE)
    score = F.greatest(F.lit(38), F.least(F.lit(99), F.lit(60) + good * 5 - bad * 4))
    return F.when(good > bad, "Positive").when(good < bad, "Negative").otherwise("Neutral"), score


def category(title: Column, description: Column) -> Column:
    """The category with most keywords found as substrings, ties in the order of the table; none: general."""
    t = F.lower(F.concat_ws(" ", text(title), text(description)))
    ranked = F.array_max(F.array(*(F.struct(hits(t, w).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, w) in enumerate(L.CATEGORY_WORDS.items()))))
    return F.when(ranked["n"] > 0, ranked["c"]).otherwise("general")


def tags(cat: Column, id_: Column, language: Column) -> Column:
    start = F.conv(F.substring(id_, 1, 8), 16, 10).cast("bigint")
    te = text(language) == "te"
    pools = [F.when((te if lang == "te" else ~te) & (F.lower(text(cat)) == c), F.array(*(F.lit(t) for t in pool))) for lang, by in L.TAG_POOLS.items() for c, pool in by.items()]
    pool = F.coalesce(*pools, F.array(F.lit(L.OTHER_TAG)))
    at = lambda k: F.element_at(pool, ((start + k) % F.size(pool) + 1).cast("int"))
    return F.array(at(0), at(1), F.when(te, L.LIVE_TAG["te"]).otherwise(L.LIVE_TAG["en"]))


def normal_category(c: Column) -> Column:
    """The code of a display label, or of a known code in any case; else general."""
    label = F.create_map(*(F.lit(x) for kv in L.CATEGORY_LABELS.items() for x in kv))[strip(c)]
    low = F.lower(strip(c))
    return F.coalesce(label, F.when(low.isin(*L.CATEGORY_LABELS.values()), low), F.lit("general"))


def normal_language(c: Column) -> Column:
    label = F.create_map(*(F.lit(x) for kv in L.LANGUAGE_LABELS.items() for x in kv))[strip(c)]
    low = F.lower(strip(c))
    return F.coalesce(label, F.when(low.isin(*L.LANGUAGE_LABELS.values()), low), F.lit("en"))


# predicates


def required(url: Column, title: Column) -> Column:
    return (strip(url) != "") & (strip(title) != "") & ~F.contains(text(title), F.lit("[Removed]"))


def of_publisher(url: Column, source: Column, publisher: str) -> Column:
    in_url, in_name = L.PUBLISHERS[publisher]
    return F.contains(F.lower(text(url)), F.lit(in_url)) | F.contains(F.lower(text(source)), F.lit(in_name))


def scrapeable(url: Column) -> Column:

    def of(url: Column) -> Column:
        return (text(url) != "") & ~text(url).rlike(f"(?i)/({'|'.join(L.NO_TEXT_PATHS)})/")

    return let(text(url), of)


def image_url(url: Column) -> Column:

    def of(url: Column) -> Column:
        u = strip(url)
        path = F.split_part(F.lower(u), F.lit("?"), F.lit(1))
        return u.rlike("^https?://") & (path.rlike(f"({'|'.join(e.replace('.', '[.]') for e in L.IMAGE_ENDS)})$") | (hits(F.lower(u), L.IMAGE_PARTS) > 0))

    return let(text(url), of)


def article_image(url: Column) -> Column:

    def of(url: Column) -> Column:
        path = F.split_part(F.lower(text(url)), F.lit("?"), F.lit(1))
        size = r"/(\d{1,9})x(\d{1,9})[.](gif|png)$"
        small = path.rlike(size) & ((F.regexp_extract(path, size, 1).try_cast("int") < 50) | (F.regexp_extract(path, size, 2).try_cast("int") < 50))
        return image_url(url) & ~text(url).rlike(f"(?i)({L.NO_ARTICLE_IMAGE})") & ~small

    return let(text(url), of)


def title_words(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(title)), F.lit(r"([a-z\x{0c00}-\x{0c7f}]{4,})"), 1))


def fits_title(content: Column, title: Column, least: int = 1) -> Column:
    """Whether at least so many words of the title (four letters or more) are substrings of the content."""
    found = let(F.lower(text(content)), lambda low: F.size(F.filter(title_words(title), lambda w: F.contains(low, w))))
    return F.when(text(title) == "", text(content) != "").otherwise(found >= least)


def repeats_title(body: Column, title: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "[.!?। ]+$", "")
    same = lambda p: (p["b"] != "") & (p["t"] != "") & ((p["b"] == p["t"]) | (bare(p["b"]) == bare(p["t"])))
    return let(F.struct(F.lower(collapse(body)).alias("b"), F.lower(collapse(title)).alias("t")), same)


def complete(content: Column) -> Column:
    """At least twenty words, a closing mark at the end, and a last word that can end a sentence."""

    def of(content: Column) -> Column:
        last = F.lower(F.regexp_replace(F.element_at(words(content), -1), r"^[^\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+$", ""))
        return F.when(word_count(content) < 20, False).otherwise(strip(content).rlike(ENDING) & ~F.coalesce(last.isin(*L.CUTOFF_WORDS), F.lit(False)))

    return let(text(content), of)


def valid_bundle(content: Column, least: int = 40) -> Column:
    """At least forty words that do not end in a letter or digit without a closing mark."""

    def of(content: Column) -> Column:
        return F.when(word_count(content) < least, False).otherwise(strip(content).rlike(ENDING) | ~strip(content).rlike(r"[\p{L}\p{N}]$"))

    return let(text(content), of)


def no_details(language: Column) -> Column:
    return F.when(text(language) == "te", L.NO_DETAILS["te"]).otherwise(L.NO_DETAILS["en"])


def is_no_details(c: Column) -> Column:
    return strip(c).isin(*L.NO_DETAILS.values())


def garbage_sentence(c: Column) -> Column:

    def of(c: Column) -> Column:
        s = strip(c)
        return (F.length(s) < 5) | s.rlike(r"(?i)^(https?://|www[.])\S+$") | F.lower(s).rlike(fused(L.GARBAGE_SENTENCES))

    return let(text(c), of)


def noise_paragraph(c: Column) -> Column:

    def of(c: Column) -> Column:
        s = strip(c)
        heading = (word_count(c) <= 5) & ~s.rlike("[.!?।]") & s.rlike(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$")
        return (F.length(s) < 5) | (hits(F.lower(text(c)), L.NOISE_WORDS) >= 2) | heading

    return let(text(c), of)


# cleaning


def strip_symbols(c: Column) -> Column:
    """Arrows, geometric and other signs, guillemets and invisible characters become a blank; blank lines are taken out."""
    signs = F.regexp_replace(text(c), r"[\x{2190}-\x{21ff}\x{2794}-\x{27bf}\x{2b00}-\x{2bff}\x{25a0}-\x{26ff}\x{bb}\x{ab}\x{feff}\x{200b}-\x{200f}\x{202a}-\x{202e}]+|>{2,}|<{2,}|-+>|<-+", " ")
    return strip(F.regexp_replace(F.regexp_replace(signs, r"[ \t]{2,}", " "), rf"\n(?:[{WS}]*\n)+", "\n"))


# The characters that code page 1252 shows for bytes 80 to 9F, and these bytes' own controls.
_PAGE_1252 = "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
_CONTROLS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
#: The lead bytes of Telugu in UTF-8 as a single-byte page shows them.
_TELUGU_LEADS = "à[°±]"


def repaired_telugu(c: Column) -> Column:
    """Telugu that was read in a single-byte page back as Telugu, word by word; words that do not decode stay as they are."""

    def word(w: Column) -> Column:
        one_byte = F.translate(w, _PAGE_1252, _CONTROLS)
        raw = F.encode(F.when(w.rlike(_TELUGU_LEADS) & one_byte.rlike(r"^[\x00-\x{ff}]*$"), one_byte).otherwise(""), "ISO-8859-1").cast("string")
        return F.when((raw != "") & F.is_valid_utf8(raw), raw).otherwise(w)

    return let(text(c), lambda t: F.when(t.rlike(_TELUGU_LEADS), F.array_join(F.transform(F.split(t, " "), word), " ")).otherwise(t))


def fix_encoding(c: Column) -> Column:
    """Garbled Telugu is repaired. Controls, invisible characters and the replacement character become a blank, as do HTML entities; script and style fragments go to the end of the line."""
    t = F.regexp_replace(repaired_telugu(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}\x{fffd}]+", " ")
    t = F.regexp_replace(t, r"&(#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,31});", " ")
    return F.regexp_replace(t, r"(\bvar [a-z_]+ ?=|\bfunction ?\(|\bdocument\.|\bwindow\.|\b(color|font-size|margin|padding) ?: ?[#0-9])[^\n]*", "")


def strip_html(c: Column, with_: str = "") -> Column:
    return F.regexp_replace(text(c), "<[^>]+>", with_)


def without_empty_elements(c: Column) -> Column:
    t = F.regexp_replace(text(c), r"<(p|h[1-3]|div|span)(\s[^>]*)?>\s*</\1>", "")
    return strip(F.regexp_replace(t, r">\s+<", "> <"))


def without_summaries(c: Column) -> Column:
    """Takes out summary headings with all lines that follow without a blank line, and summaries within a line."""
    head = "|".join(L.SUMMARY_HEADS)
    t = F.regexp_replace(text(c), rf"(?i)(^|\n)(?:{head})\s*[:-]?\s*\n(?:[ \t]*[^\n]+\n)*", "\n")
    return strip(F.regexp_replace(t, r"(?i)\b(?:(english|ai|ai generated|machine|translation) )?summary\s*[:-]\s*[^\n.।]{3,}", ""))


def clean_metadata(c: Column) -> Column:
    """Bylines, dates, credits, navigation, notices and links taken out of running text; then junk phrases to the end of their line."""
    t = fix_encoding(c)
    t = F.regexp_replace(t, rf"(?im)^(?:{'|'.join(L.METADATA_LINES)})[^\n.।]*$|^(?:https?://|www[.])\S+$", "")
    t = F.regexp_replace(t, rf"(?i){fused(L.METADATA_TO_END)}[^\n।]*", "")
    t = F.regexp_replace(t, rf"(?i){fused(L.METADATA_TO_STOP)}[^\n.।]*", "")
    t = F.regexp_replace(t, rf"(?i){fused(L.METADATA_ITSELF)}|[.]{{3}}$", "")
    t = F.regexp_replace(t, rf"(?i)(^|[{WS}।]){fused(map(phrase, L.JUNK_PHRASES))}[^\n।]*", "$1")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def _first_of_each(items: Column, key) -> Column:
    """Items in order without those whose key came before; empty keys are kept."""
    keyed = F.transform(items, lambda x, i: F.struct(x.alias("x"), key(x).alias("k"), i.alias("i")))
    keys = lambda all_: F.transform(all_, lambda x: x["k"])
    with_keys = let(keyed, lambda a: F.struct(a.alias("a"), keys(a).alias("k")))
    # an item stays if its key's first position is its own
    first = let(with_keys, lambda p: F.filter(p["a"], lambda x: (x["k"] == "") | (F.array_position(p["k"], x["k"]) == x["i"] + 1)))
    return F.transform(first, lambda x: x["x"])


def distinct_lines(c: Column) -> Column:

    def of(c: Column) -> Column:
        return F.array_join(_first_of_each(F.split(text(c), "\n"), lambda x: F.lower(collapse(x))), "\n")

    return let(text(c), of)


def distinct_paragraphs(c: Column, sep: str = _BLANK_LINE) -> Column:

    def of(c: Column) -> Column:
        return F.array_join(_first_of_each(paragraphs(c, sep), lambda x: F.substring(F.lower(collapse(x)), 1, 120)), "\n\n")

    return let(text(c), of)


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), r"(?<=[.!?।]) "), lambda s: s != "")


def distinct_sentences(c: Column) -> Column:
    """Sentences of eight characters or more that are no garbage, each once, with blanks between."""
    kept = F.filter(sentences(fix_encoding(c)), lambda s: (F.length(s) >= 8) & ~garbage_sentence(s) & (F.length(match_key(s)) >= 6))
    return F.array_join(_first_of_each(kept, match_key), " ")


def complete_ending(c: Column, language: Column) -> Column:
    """Ends the text in a closing mark: cut back to the last one if at most eighty characters follow it, else one is added."""

    def of(c: Column) -> Column:
        t = strip(c)
        mark = F.when(text(language) == "en", ".").otherwise("।")
        back = F.regexp_extract(t, r"^([\s\S]*[.!?।])[^.!?।]{0,80}$", 1)
        loose = t.rlike(r"[\p{L}\p{N},;:]$")
        return F.when((t == "") | t.rlike(ENDING), t).when(loose & (back != ""), strip(back)).otherwise(F.concat(t, mark))

    return let(text(c), of)


def without_broken_words(c: Column, sep: str = _BLANK_LINE) -> Column:
    return F.array_join(F.transform(paragraphs(c, sep), lambda p: strip(F.regexp_replace(F.regexp_replace(p, "^[a-z]{1,2} ", ""), " [a-z]{1,2}$", ""))), "\n\n")


def without_empty_paragraphs(c: Column, sep: str = _BLANK_LINE) -> Column:

    def of(c: Column) -> Column:
        keep = lambda p: ~p.rlike(r"^[^\p{L}\p{M}\p{N}]*$") & ((word_count(p) >= 3) | has_telugu(p))
        return F.array_join(F.filter(paragraphs(c, sep), keep), "\n\n")

    return let(text(c), of)


def without_trailing_junk(c: Column, sep: str = _BLANK_LINE) -> Column:
    """Closing paragraphs without a sentence mark and of at most eight words go if they name a topic, have at most three words or are a link; the first stays."""

    def of(c: Column) -> Column:
        ps = paragraphs(c, sep)
        junk = lambda p: ~p.rlike("[.!?।]") & (word_count(p) <= 8) & (F.lower(p).rlike(f"^({'|'.join(L.TRAILING_LABELS)})\\b") | ((word_count(p) <= 3) & ~has_telugu(p)) | p.rlike(r"^https?://\S+$"))
        last = F.array_max(F.transform(ps, lambda p, i: F.when(~junk(p), i + 1)))
        return F.array_join(F.slice(ps, F.lit(1), F.greatest(F.coalesce(last, F.lit(1)), F.lit(1))), "\n\n")

    return let(text(c), of)


def relevant_paragraphs(c: Column, title: Column, least: int = 2, sep: str = _BLANK_LINE) -> Column:
    """Of more than two paragraphs those that lead, are long or share a word with the title; others only up to `least` kept."""

    def of(c: Column) -> Column:
        ps, keys = paragraphs(c, sep), F.array_except(title_words(title), F.array(*(F.lit(w) for w in L.STOPWORDS)))
        fits = lambda p: (word_count(p) >= 20) | F.arrays_overlap(title_words(p), keys)
        numbered = F.transform(ps, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        step = lambda kept, x: F.when((x["i"] == 0) | fits(x["p"]) | (F.size(kept) < least), F.concat(kept, F.array(x["p"]))).otherwise(kept)
        kept = F.aggregate(numbered, F.array().cast("array<string>"), step)
        return F.array_join(F.when((F.size(ps) > 2) & (F.size(keys) > 0), kept).otherwise(ps), "\n\n")

    return let(text(c), of)


def clean_article(c: Column, language: Column, title: Column, sep: str = _BLANK_LINE) -> Column:
    """All cleaning steps of an article's text in their order. With sep a single line end, lines count as paragraphs."""
    steps = [
        strip_symbols, without_summaries, clean_metadata, lambda t: distinct_paragraphs(t, sep), distinct_lines, lambda t: without_broken_words(t, sep), without_trailing_junk,
        lambda t: F.when(text(title) != "", relevant_paragraphs(t, title)).otherwise(t), lambda t: complete_ending(t, language), without_empty_paragraphs,
    ]
    for step in steps:
        c = let(c, step)
    return collapse_blank(c)


def collapse_blank(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text(c), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def built_article(c: Column, language: Column, least: int = 5) -> Column:
    """Cleaned distinct sentences with a closing mark, or null below `least` words."""
    done = complete_ending(let(let(c, clean_metadata), distinct_sentences), language)
    return let(done, lambda t: F.when(word_count(t) >= least, t))


# presentation


def card_text(description: Column, title: Column, most: int = 170) -> Column:
    """The description cut to `most` characters, back to the last blank; empty if it repeats the title."""
    cut = lambda d: F.when(F.length(d) > most, F.concat(F.regexp_replace(F.substring(d, 1, most), " [^ ]*$", ""), F.lit("…"))).otherwise(d)
    return F.when(repeats_title(description, title), "").otherwise(let(strip(description), cut))


def highlights(c: Column, most: int = 5) -> Column:
    """The first sentences of eight to forty words that are no garbage and neither contain nor are contained in one before."""

    def of(c: Column) -> Column:
        counted = F.transform(sentences(c), lambda s: F.struct(s.alias("s"), match_key(s).alias("k"), (F.size(F.split(s, " "))).alias("n")))
        fit = F.filter(counted, lambda x: (x["n"] >= 8) & (x["n"] <= 40) & (F.length(x["k"]) >= 10) & ~garbage_sentence(x["s"]))
        near = lambda a, x: F.exists(a, lambda y: F.contains(y["k"], x["k"]) | F.contains(x["k"], y["k"]))
        step = lambda a, x: F.when(near(a, x), a).otherwise(F.concat(a, F.array(x)))
        kept = F.aggregate(fit, F.array().cast("array<struct<s:string,k:string,n:int>>"), step)
        return F.slice(F.transform(kept, lambda x: x["s"]), 1, most)

    return let(text(c), of)


def chunks(c: Column, target: int = 80) -> Column:
    """Runs of sentences, each closed once it holds `target` words or more."""

    def of(c: Column) -> Column:
        empty = F.array().cast("array<string>")
        start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("n"))

        def step(a: Column, s: Column) -> Column:
            open_, n = F.concat(a["open"], F.array(s)), a["n"] + word_count(s)
            return F.when(n >= target, F.struct(F.concat(a["done"], F.array(F.array_join(open_, " "))).alias("done"), empty.alias("open"), F.lit(0).alias("n"))).otherwise(F.struct(a["done"].alias("done"), open_.alias("open"), n.alias("n")))

        return F.aggregate(sentences(c), start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], " ")))).otherwise(a["done"]))

    return let(text(c), of)


def best_source(title: Column, description: Column, scraped: Column) -> Column:
    def of(x: Column) -> Column:
        body = F.when(word_count(x["s"]) > word_count(x["d"]), x["s"]).otherwise(x["d"])
        return F.concat_ws("\n\n", F.when(x["t"] != "", F.concat(F.lit("Title: "), x["t"])), F.nullif(body, F.lit("")))

    return let(F.struct(clean_metadata(title).alias("t"), clean_metadata(description).alias("d"), clean_metadata(scraped).alias("s")), of)


def prompt_tier(words_: Column) -> Column:
    return F.when(words_ >= 150, "RICH").when(words_ >= 40, "MEDIUM").otherwise("THIN")


def raw_fallback(title: Column, description: Column, scraped: Column, language: Column) -> Column:
    """The first of scraped text, description and title with five words, with distinct paragraphs and a closing mark; the notice if it repeats the title."""
    first = F.coalesce(*(F.when(word_count(x) >= 5, strip(x)) for x in (scraped, description, title)), F.lit(""))
    body = complete_ending(distinct_paragraphs(first), language)
    return let(body, lambda b: F.when((b == "") | repeats_title(b, title), no_details(language)).otherwise(b))
