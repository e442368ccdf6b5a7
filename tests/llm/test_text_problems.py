import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinfeed.llm import garbled as G
from skeinfeed.llm.languages import Trees, document_languages, language_segments, sentences_of, stated_language, unstated_languages
from skeinfeed.llm.leakage import contained_items, plain_words
from skeinfeed.llm.packing import Tokens, TOKENIZER, best_fit, packed_texts
from skeinfeed.llm.page_body import boilerplate_lines, line_tokens, main_body
from skeinfeed.llm.page_lines import ENDS, furniture, is_figures, runs_on
from skeinfeed.llm.source_lines import LineCounts
from skeinfeed.llm.subjects import Model, document_subjects, fitted_model
from skeinfeed.llm.truncation import judge_value, truncated_values, truncation_report

# --- 2: garbled text --------------------------------------------------------------------------------------------------

WORDS = ["café", "Größe", "niño", "తెలుగు", "हिन्दी", "“Perhaps", "it’s", "₹42"]
CORRECT = ["SÃO Grijâ TÂMARA", "„Spaß“", "ESPAÑ”", "voilà”", "“Étude", "« à »", "Übrigens – à la carte", "ÅÄÖ", "naïve»", "привет", "Ελλάδα", "日本語", "20 °C", "§ 5", "n° 3"]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_stays(text):
    assert G.ungarbled(text) == text and not any(G.suspicious(t) for t in G.tokens_of(text))


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman"])
def test_single_garbling_is_undone(page):
    assert [G.ungarbled(G.garble(w, (page,))) for w in WORDS] == WORDS


def fields(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "table_name string, row_key long, field_name string, text string, token string")


def test_every_chain_is_found_and_restored_where_the_word_stands_clean(spark):
    rows = [("a", 0, "t", " ".join(WORDS))] + [("a", 1 + i, "t", f"x {G.garble(w, c)} y") for i, (w, c) in enumerate((w, c) for w in WORDS for c in G.CHAINS) if G.garble(w, c) != w]
    df = fields(spark, rows)
    found = {r["row_key"] for r in G.garbled_fields(df).collect()}
    missed = [rows[k] for k in range(1, len(rows)) if k not in found]
    assert 0 not in found and len(missed) <= 0.12 * len(rows), missed
    back = {r["row_key"]: r["restored"] for r in G.restored_fields(df).collect()}
    right = sum(back[i] == f"x {w} y" for i, (w, c) in enumerate(((w, c) for w in WORDS for c in G.CHAINS), 1) if i in found)
    assert right >= 0.9 * len(found) and back[0] == " ".join(WORDS)


def test_garbled_edges(spark):
    rows = [("a", 1, "t", None), ("a", 2, "t", ""), ("a", 3, "t", "J�holm"), ("a", 4, "t", "plain " * 20_000 + "NÃ©dra"), ("a", 4, "t2", "NÃ©dra"), ("c", 5, "data", '{"content": "caf\\u00c3\\u00a9"}'), ("c", 6, "data", '{"content": "caf\\u00e9"'), ("c", 7, "data", '{"broken": "caf\\u00c3\\u00a9')]
    got = {(r["row_key"], r["field_name"]) for r in G.garbled_fields(fields(spark, rows)).collect()}
    assert got == {(3, "t"), (4, "t"), (4, "t2"), (5, "data"), (7, "data")}
    assert G.garbled_fields(fields(spark, [])).collect() == []


def test_garbled_forms_without_signs_are_found(spark):
    words = [("für", "cp1250"), ("Straße", "cp1250"), ("más", "cp1250"), ("être", "cp1250"), ("où", "cp1250"), ("À", "cp1251"), ("😀", "cp1252"), ("日本", "cp1252"), ("مرحبا", "cp1252")]
    rows = [("a", i, "t", " ".join(w for w, _ in words)) for i in range(3)] + [("a", 10 + i, "t", f"x {G.garble(w, (p,))} y") for i, (w, p) in enumerate(words)] + [("a", 30, "t", "für fĂź"), ("a", 31, "t", "fĂź")]
    back = {r["row_key"]: r["restored"] for r in G.restored_fields(fields(spark, rows)).collect()}
    assert [back[10 + i] for i in range(len(words))] == [f"x {w} y" for w, _ in words]
    assert all(back[r[1]] == r[3] for r in rows if r[1] < 10 or r[1] >= 30)


def test_escaped_json_is_restored(spark):
    rows = [("c", 1, "data", '{"a": "caf\\u00c3\\u00a9 \\"x\\" y", "n": [1.50]}'), ("c", 2, "data", '{"broken": "caf\\u00C3\\u00a9 y'), ("c", 3, "data", '{"a": "cafÃ© y"}'), ("c", 4, "data", '{"a": "caf\\u00e9"}'), ("c", 5, "data", '{"a": "caf\\u00c3\\u00a9", "b": "cafÃ©"}')]
    back = {r["row_key"]: r["restored"] for r in G.restored_fields(fields(spark, rows)).collect()}
    assert back == {1: '{"a": "caf\\u00e9 \\"x\\" y", "n": [1.50]}', 2: '{"broken": "caf\\u00e9 y', 3: '{"a": "café y"}', 4: rows[3][3], 5: '{"a": "caf\\u00e9", "b": "café"}'}


def test_tokens_are_replaced_as_a_whole():
    assert G._replaced("Ã© (Ã©) xÃ© Ã©t", {"Ã©": "é"}) == "é (é) xÃ© Ã©t"
    assert G.restored_json('{"a": "Ã©t Ã©,"}', {"Ã©": "é"}) == '{"a": "Ã©t é,"}'
    assert G.restored_json('{"a": "\\u00c3\\u00a9t \\u00c3\\u00a9', {"Ã©": "é"}) == '{"a": "\\u00c3\\u00a9t \\u00e9'


# --- 4: cut texts -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "title", "page", "state"),
    [
        ("A full sentence.", "T", False, "ended"), ("He said: “We shall wait…”", "T", False, "ended"), ("A sentence. And then the se", "T", False, "cut"), ("Together with the [+27 chars]", "T", False, "cut"),
        ("The news... [26 chars]", "T", False, "cut"), ("It ended here. [26 chars]", "T", False, "ended"), ("Why a chip failed", "Why a chip failed", False, "headline"), ("Why a chip failed - Daily", "Why a chip failed", False, "headline"),
        ("A story line stands here.\nShare this story with your friends", "T", True, "ended"), ("A story line stands here. And then the wo\nAll rights reserved", "T", True, "cut"), ("ఒక వాక్యం ఉంది. మరో వా", "T", False, "cut"), ("Story here.\nWeather in Oz: 3 degrees", "T", True, "ended"), ("Share this story", "T", True, "ended"),
    ],
)
def test_how_values_end(text, title, page, state):
    assert judge_value(text, title, page)[0] == state


ARTICLES = "row_id long, source string, title string, description string, content string, url string, language string, state string"


def test_limits_and_edges(spark):
    text = "The committee met again on Monday to discuss the budget and nobody could agree on anything at all in the end"
    rows = [(i, " Src", f"t{i}", text[: 60], None, "u", "en", "x") for i in range(8)] + [(100, None, None, None, "", "u", "en", "x"), (101, "b", "t", "Whole sentence.", "y " * 50_000 + "end.", "u", "en", "x")]
    df = spark.createDataFrame(rows, ARTICLES)
    got = {(r["row_id"], r["field_name"]): (r["truncated"], r["at_limit"]) for r in truncated_values(df).collect()}
    assert all(got[(i, "description")] == (True, True) for i in range(8)) and got[(101, "description")] == (False, False) and got[(101, "content")] == (False, False) and len(got) == 10
    assert {r["source"]: r["n_truncated"] for r in truncation_report(df).filter("field_name = 'description'").collect()} == {"src": 8, "b": 0}
    assert truncated_values(spark.createDataFrame([], ARTICLES)).collect() == []


def test_cuts_at_words_that_end_titles(spark):
    """However many titles share an end, a cut there counts if the end mostly stands inside sentences; known titles stay."""
    places = ["Oz", "Ur", "Ys", "Ed", "Ix", "Ra"]
    rows = [(i, "s", f"{p}: a dispute over the river bank", f"People in {p} saw the river bank give way on Monday.", f"Many in {p} left the river bank at noon.", "u", "en", "x") for i, p in enumerate(places)]
    rows += [(20 + i, "s", f"t{i}", f"{p} was calm.", None, "u", "en", "x") for i, p in enumerate(places)]
    rows += [(100, "s", "t", "Nobody had crossed over to the river bank", None, "u", "en", "x"), (101, "s", "t", "Lo: a dispute over the river bank", None, "u", "en", "x")]
    df = spark.createDataFrame(rows, ARTICLES)
    for times in (1, 5):
        more = df.filter("row_id < 100").crossJoin(spark.range(times)).drop("id")
        got = {r["row_id"]: r["truncated"] for r in truncated_values(more.unionByName(df.filter("row_id >= 100"))).filter("field_name = 'description' and row_id >= 100").collect()}
        assert got == {100: True, 101: False}


# --- 5: languages -----------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": ["The minister said that the budget was ready.", "Nobody in the town had planned for such a turn.", "A crowd of people waited for the train in the rain."],
    "de": ["Der Minister sagte, dass der Haushalt fertig ist.", "Niemand in der Stadt hatte das geplant.", "Viele Menschen warteten im Regen auf den Zug."],
    "fr": ["Le ministre a dit que le budget était prêt.", "Personne dans la ville ne savait ce qui allait suivre.", "Une foule attendait le train sous la pluie."],
    "te": ["మంత్రి బడ్జెట్ సిద్ధంగా ఉందని చెప్పారు.", "పట్టణంలో ఎవరూ దీనిని ఊహించలేదు.", "ప్రజలు వర్షంలో రైలు కోసం వేచి ఉన్నారు."],
}


def test_stated():
    assert [stated_language(x) for x in ("EN", "en_GB", "te-IN", " Telugu ", "deu", "xx", "None", None, "", "und", "english-ish")] == ["en", "en", "te", "te", "de", None, None, None, None, None, None]


def test_code_lengths_are_exact():
    """Against a plain recursion over the same counts."""
    from collections import Counter, defaultdict
    from math import log2

    from skeinfeed.llm.languages import ORDER

    words = Counter({"abab": 3, "abc": 1, "ca": 2})
    trees = Trees.built({"x": words})
    seen = defaultdict(Counter)
    for w, n in words.items():
        raw = b" " + w.encode() + b" "
        for i in range(1, len(raw)):
            for k in range(min(i, ORDER) + 1):
                seen[(k, raw[i - k : i])][raw[i]] += n

    def bits(word):
        raw, total = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(raw)):
            for k in range(min(i, ORDER), -1, -1):
                c = seen.get((k, raw[i - k : i]))
                if c and raw[i] in c:
                    total += log2((sum(c.values()) + len(c)) / c[raw[i]])
                    break
                total += log2((sum(c.values()) + len(c)) / len(c)) if c else 0
            else:
                total += 8
        return total

    for w in ("abab", "abc", "cab", "zzz", "a"):
        assert abs(float(trees.code_lengths([w])[0, 0]) - bits(w)) < 1e-3


def test_languages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(160):
        lang = rng.choice(list(SENTENCES))
        rows.append((i, "s", "t", None, " ".join(rng.sample(SENTENCES[lang], 2)), "u", lang if i % 10 else "en", "x"))
    rows += [(900, "s", "t", None, " ".join(SENTENCES["en"] + SENTENCES["de"][:2]), "u", "en", "x"), (901, "s", "t", None, " ".join(SENTENCES["en"] + SENTENCES["de"][:1]), "u", "EN", "x"), (902, "s", "t", None, None, "u", None, "x"), (903, "s", "t", None, "", "u", None, "x"), (904, "s", "t", None, SENTENCES["fr"][0], "u", None, "x"), (905, "s", "t", None, "5 | 7 | 9", "u", None, "x")]
    df = spark.createDataFrame(rows, ARTICLES)
    segments = language_segments(df).cache()
    assert [(r["lang"], r["n_sentences"]) for r in segments.filter("row_id = 900").orderBy("segment_no").collect()] == [("en", 3), ("de", 2)]
    assert segments.filter("confidence < 0 or confidence > 1").count() == 0 and segments.filter("row_id in (902, 903, 905)").count() == 0
    assert {r["lang"] for r in document_languages(segments).filter("row_id = 901").collect()} == {"en"}
    got = {(r["row_id"], r["lang"]) for r in unstated_languages(df).collect()}
    assert {(900, "de"), (904, "fr")} <= got and not {k for k, _ in got} & {901, 902, 903}
    assert unstated_languages(spark.createDataFrame([], ARTICLES)).collect() == []


def test_sentences_skip_furniture():
    assert sentences_of("A story line. Another one.\nShare this story with your friends\nScores: A 5, B 7.") == ["A story line.", "Another one."]


# --- 6: page bodies ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("line", ["ADVERTISEMENT", "Home | Nation | Sport | Daily Plus", "© Daily. All rights reserved.", "Next: Why it rained", "12,345 shares  67 comments", "Filed under: rain, floods", "हमसे जुड़ें" if False else "इस खबर को साझा करें", "మా గోప్యతా విధానం చదవండి", "Wir verwenden Cookies. Zustimmen oder ablehnen", "Partager cet article", "Aviso legal  Privacidad  Contacto", "Written by Ann Lee, senior writer", "46 min read | Ann Lee | Oz", "Home > Law > A ruling", "This site uses cookies for ads."])
def test_furniture(line):
    assert furniture(line) is True


@pytest.mark.parametrize("line", ["The court ruled on Monday.", "“Cookies, privacy terms and newsletters all bore me,” Ann told readers.", "Oz 5 | Ur 7 | drawn 3", "Scores: Ann 5, Bo 7, Cy 9.", "Here is what we know so far.", "Prices are as of the previous close."])
def test_story_lines(line):
    assert not furniture(line)


def test_boilerplate_and_body(spark):
    rows = [(i, "s", "t", None, f"Share this story with your friends\nStory number {i} happened in the town of Oz{i}.\n\nHome | Nation | Sport | Daily Plus", f"https://www.Daily.example/{i}", "en", "x") for i in range(6)]
    rows += [(50, None, "t", None, None, None, "en", "x"), (51, None, "t", None, "", None, "en", "x"), (52, None, "t", None, "word " * 30_000 + ".", None, "en", "x"), (53, "s", "t", None, "A single headline without an end", "u", "en", "x")]
    df = spark.createDataFrame(rows, ARTICLES)
    got = {(r["row_id"], r["line_no"]) for r in boilerplate_lines(df).collect()}
    assert got == {(i, n) for i in range(6) for n in (1, 4)}
    body = {r["row_id"]: r["content"] for r in main_body(df).collect()}
    assert body[0] == "Story number 0 happened in the town of Oz0.\n" and body[50] is None and len(body) == len(rows)
    assert boilerplate_lines(spark.createDataFrame([], ARTICLES)).collect() == []
    assert {(r["row_id"], r["line_no"]) for r in boilerplate_lines(df, block_bytes=200).collect()} <= got | {(i, 2) for i in range(6)}


def furniture_by_hand(rows, phrases=True):
    """What boilerplate_lines() gives for (key, host, text), by plain counting of strings of tokens."""
    import re
    from collections import defaultdict

    pages = [(k, h, t, [(n, re.sub(r"\d+(?:[.,]\d+)*", "0", x.strip())) for n, x in enumerate(t.split("\n"), 1) if x.strip()]) for k, h, t in rows]

    def forth(tokens, i):
        """The shortest string from i on with two words that are no names."""
        for j in range(i + 1, len(tokens) + 1):
            if sum(x != "•" for x in tokens[i:j]) == 2:
                return tokens[i:j]
        return tokens[i:]

    def back(tokens, j):
        for i in range(j - 1, -1, -1):
            if sum(x != "•" for x in tokens[i:j]) == 2:
                return tokens[i:j]
        return tokens[:j]

    n, opens, closes = Counter(), defaultdict(list), defaultdict(list)
    for _, h, t, lines in pages:
        for _, x in lines:
            w = tuple(line_tokens(x))
            n.update((h, s) for s in [forth(w, i) for i in range(len(w))] + [back(w, j + 1) for j in range(len(w)) if w[j] == "•"])
            opens[h, forth(w, 0)].append(t), closes[h, back(w, len(w))].append(t)
    class_, spots = {}, defaultdict(list)
    for k, h, t, lines in pages:
        of = {}
        for no, x in lines:
            w = tuple(line_tokens(x))
            o, c = (h, forth(w, 0)), (h, back(w, len(w)))
            ended, runs = ENDS.search(x) is not None, re.search(r"(?<![\d\s])[.!?]\s+\S", x) is not None
            again = len(set(opens[o])) > 1, len(set(closes[c])) > 1
            tied = len(opens[o]) >= 0.7 * n[o] and len(closes[c]) >= 0.7 * n[c] and again[1]
            if tied or (not ended and not runs and any(again)):
                of[no] = (c, ended or is_figures(x))
            elif phrases and not any(again) and furniture(x):
                of[no] = (c, False)
        story = [no for no, _ in lines if no not in of]
        for no, (c, by_place) in of.items():
            if len(lines) > 1:
                class_[k, no] = (c, by_place)
                if by_place:
                    spots[c].append(not story or story[0] < no < story[-1])
    return {x for x, (c, by_place) in class_.items() if not by_place or sum(spots[c]) < 0.4 * len(spots[c])}


def test_lines_against_counting_by_hand(spark):
    """Whole hosts are judged, however small the blocks are; whole lines of stories and phrases stay what they are."""
    rng = random.Random(5)
    places, things = ["Oz", "Ur", "Ys", "Ed"], ["mill", "farm", "port", "pier", "bank", "dam"]
    said = ["People in {p} saw the {t} fall.", "The {t} of {p} was sold.", "Nobody bought the old {t}.", "It rained over {p} and its {t}."]
    frame = ["Share this with {p}", "Daily {t} news {n}", "We keep small files in {p} for our {t}. Stay and agree to that.", "Call our desk in {p}, number {n}."]
    say = lambda x: x.format(p=rng.choice(places), t=rng.choice(things), n=rng.randrange(99))
    rows = []
    for i in range(120):
        story = [" ".join(say(x) for x in rng.sample(said, rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.4:
            story.insert(1, "Here is what is known.")
        rows.append((i, "s", "t", None, "\n".join([say(rng.choice(frame)) for _ in range(rng.randrange(3))] + story + [""] + [say(rng.choice(frame)) for _ in range(rng.randrange(3))]), f"https://{rng.choice('ab')}.example/1", "en", "x"))
    rows += [(500 + i, *r[1:]) for i, r in enumerate(rows[:10])] + [(600, "s", "t", None, "All rights reserved by Nolo\nA quiet day in Oz.", "https://c.example/1", "en", "x")]
    df = spark.createDataFrame(rows, ARTICLES)
    for phrases, sizes in ((True, (1, 900, 4_000_000)), (False, (4_000_000,))):
        got = [{(r["row_id"], r["line_no"]) for r in boilerplate_lines(df, block_bytes=n, phrases=phrases).collect()} for n in sizes]
        want = furniture_by_hand([(r[0], r[5][:17], r[4]) for r in rows], phrases)
        assert all(x == want for x in got) and ((600, 1) in want) == phrases
    lines = {(r[0], n): x for r in rows for n, x in enumerate(r[4].split("\n"), 1) if x}
    framed = {k for k, x in lines.items() if x.startswith(("Share", "Daily", "We keep", "Call"))}
    assert len(want & framed) >= 0.9 * len(framed) and len(want & framed) >= 0.9 * len(want)


def test_figures_and_cuts():
    assert is_figures("A 5 | B 6 | 7") and not is_figures("One, two and three") and runs_on("It rained. Then the su") and not runs_on("A headline on rain")


# --- 7: lines of a source ---------------------------------------------------------------------------------------------


def test_line_counts_grow_as_from_scratch(spark):
    rng = random.Random(4)
    rows = [(i, f"d{rng.randrange(60)}", rng.choice([" Src", "src ", "Other", None]), "\n".join(rng.choice(["Legal  notice", "legal NOTICE ", f"line {rng.randrange(200)}", ""]) for _ in range(4)) if rng.random() < 0.9 else None, "x") for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, article_id string, source string, content string, source_key string").drop("source_key")
    parts = [df.filter(f"row_id % 3 = {k}") for k in range(3)]
    grown, whole = LineCounts(spark), LineCounts(spark)
    changes = [grown.update(p).collect() for p in parts]
    whole.update(df)
    key = lambda t: {tuple(r) for r in t.excessive().collect()}
    assert key(grown) == key(whole) and changes[0]
    pages: dict = {}
    for _, doc, s, t, _ in rows:
        if s is not None:
            pages.setdefault(s.strip().lower(), {}).setdefault(doc, set()).update(" ".join(x.split()).lower() for x in (t or "").split("\n") if x.strip())
    want = set()
    for i, _, s, t, _ in rows:
        if s is not None and t is not None:
            docs = pages[s.strip().lower()]
            for n, x in enumerate(t.split("\n"), 1):
                hits = sum(" ".join(x.split()).lower() in d for d in docs.values())
                if x.strip() and hits >= 5 and hits >= 0.02 * len(docs):
                    want.add((i, n))
    assert {(r["row_id"], r["line_no"]) for r in grown.occurrences(df).collect()} == want
    clean = {r["row_id"]: r["content"] for r in grown.rebuilt(df).collect()}
    assert len(clean) == len(rows) and all("notice" not in (c or "").lower() for i, c in clean.items() if rows[i][2] is not None)
    empty = LineCounts(spark)
    assert empty.update(df.limit(0)).collect() == [] and empty.occurrences(df).collect() == []


def test_line_counts_last_and_merge(spark, tmp_path):
    """Objects that go on with one path give what one object gives, across merged versions and broken updates; only rows with changed lines are rebuilt."""
    path, lines = str(tmp_path / "counts"), ["legal notice", "share this", "line a", "line b"]
    rows = [(i, f"d{i}", "s", f"{lines[i % 4]}\nstory {i}" + "\nA rare note." * (i in (1, 2, 3, 4, 9))) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, article_id string, source string, content string")
    one = LineCounts(spark)
    one.update(df)
    for k in range(10):
        part = df.filter(f"row_id % 10 = {k}")
        if k == 4:
            LineCounts(spark, path)._write("totals", spark.createDataFrame([("s", 1000)], "source_key string, n long"), 5)  # without a mark
        changed = LineCounts(spark, path).update(part)
    last = LineCounts(spark, path)
    assert {tuple(r) for r in last.excessive().collect()} == {tuple(r) for r in one.excessive().collect()} and len(last.versions) < 8
    rebuilt = {r["row_id"]: r["content"] for r in last.rebuilt(df).collect()}
    assert rebuilt == {i: f"story {i}" for i in range(40)}
    assert [r["excessive"] for r in changed.collect()] == [True]
    assert {r["row_id"]: r["content"] for r in last.rebuilt(df, changed=changed).collect()} == {i: f"story {i}" for i in (1, 2, 3, 4, 9)}


# --- 8: containers ----------------------------------------------------------------------------------------------------


def test_best_fit_keeps_copies_apart():
    rng = random.Random(6)
    pieces = [(rng.randint(1, 100), rng.choice([0, 0, 1, 2]), rng.randrange(3)) for _ in range(500)]
    place = best_fit(pieces, 100)
    bins: dict = {}
    for (n, c, _), b in zip(pieces, place):
        bins.setdefault(b, []).append((n, c))
    assert all(sum(n for n, _ in x) <= 100 for x in bins.values())
    assert all(len([c for _, c in x if c]) == len({c for _, c in x if c}) for x in bins.values())


def plain_best_fit(pieces, capacity, apart):
    bins, place = [], [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], pieces[i][1], i)):
        n, c, s = pieces[i]
        fit = min(((b[0], k) for k, b in enumerate(bins) if b[0] >= n and not (c and c in b[1]) and not (apart and s in b[2])), default=None)
        if fit is None:
            bins.append([capacity, set(), set()])
        k = len(bins) - 1 if fit is None else fit[1]
        bins[k][0] -= n
        bins[k][1].add(c), bins[k][2].add(s)
        place[i] = k
    return place


@pytest.mark.parametrize("apart", [False, True])
def test_best_fit_against_a_plain_search(apart):
    rng = random.Random(11)
    for _ in range(100):
        sizes = {c: rng.randint(1, 100) for c in range(1, 6)}
        pieces = [(sizes.get(c) or rng.randint(1, 100), c, rng.randrange(4)) for c in (rng.choice([0, 0, 1, 2, 3, 4, 5]) for _ in range(rng.randint(1, 80)))]
        assert best_fit(pieces, 100, apart) == plain_best_fit(pieces, 100, apart)


def test_a_third_of_copies_packs_in_one_walk():
    import time

    began = time.perf_counter()
    place = best_fit([(50, 1, 1)] * 30_000 + [(20, 0, 2)] * 60_000, 2048)
    assert len(set(place[:30_000])) == 30_000 and time.perf_counter() - began < 20


def test_containers_hold_every_text(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["rain", "తెలుగు", "étude", "x" * 9]) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["same text"] * 5 + ["a" * 30_000, "", None]
    df = spark.createDataFrame([(i, t, rng.choice(["s", None]), 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_tokens int")
    for group in (30_000, 20):
        rows = packed_texts(df, group_pieces=group).collect()
        full: dict = {}
        parts: dict = {}
        for r in rows:
            full.setdefault(r["container_id"], []).append(r)
            parts.setdefault(r["doc_id"], []).append(r)
        assert all(sum(r["n_tokens"] for r in x) <= 2048 for x in full.values())
        assert all("".join(texts[k][r["first_char"] : r["end_char"]] for r in sorted(x, key=lambda r: r["part_no"])) == texts[k] for k, x in parts.items())
        assert set(parts) == {i for i, t in enumerate(texts) if t}
        assert all(len([r for r in x if texts[r["doc_id"]] == "same text"]) <= 1 for x in full.values())
        tokens = Tokens(open(TOKENIZER, "rb").read())
        assert all(len(parts[i]) == 1 for i, t in enumerate(texts) if t and sum(map(tokens.count, __import__("re").findall(r"\s*\S+|\s+", t))) <= 2048)
        assert len(full) <= 1.15 * sum(r["n_tokens"] for r in rows) / 2048 + 5


def test_token_counts_add_up():
    tokens = Tokens(open(TOKENIZER, "rb").read())
    for text in ("Hello  world,\n\n it's fine", "తెలుగు వార్తలు\nరోజు", " a\t\tb ", "¿Qué? «No»"):
        assert tokens.pieces(text, 2048)[0][2] == len(tokens.encoding.encode_ordinary(text))


# --- 9: leakage -------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, "b", "en", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30)))) for i in range(20)]
    items += [(50, "b", "en", items[9][3]), (51, "b", "en", None), (52, "b", "en", "")]
    docs = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(40)]
        it = items[rng.randrange(20)][3].split()
        n = rng.randint(8, len(it)) if len(it) > 8 else len(it)
        piece = [rng.choice([w, w.upper(), f"“{w},”", w[0] + "­" + w[1:]]) for w in it[:n]]
        docs.append((d, " ".join(words[:20] + piece + words[20:]) if d % 2 else "  –  ".join(piece)))
    docs += [(100, None), (101, ""), (102, "z " * 50_000 + items[9][3])]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int")
    got = {(r["item_id"], r["doc_id"]): r for r in contained_items(df, spark.createDataFrame(items, "item_id long, benchmark string, lang string, text string")).collect()}
    want = set()
    for k, t in docs:
        flat = f" {' '.join(plain_words(t or ''))} "
        for i, _, _, x in items:
            w = plain_words(x or "")
            if any(f" {' '.join(w[a : a + 13])} " in flat for a in range(len(w) - 12)):
                want.add((i, k))
    assert set(got) == want and want
    schema = "item_id long, benchmark string, lang string, text string"
    assert {tuple(r) for r in contained_items(df, spark.createDataFrame(items, schema), block_chars=300).collect()} == {tuple(r) for r in got.values()}
    assert contained_items(df, spark.createDataFrame([], schema)).collect() == []
    text = dict(docs)
    for (i, k), r in got.items():
        span = plain_words(text[k][r["first_char"] : r["end_char"]])
        assert len(span) >= 13 and f" {' '.join(span[:13])} " in f" {' '.join(plain_words(dict((a, x) for a, _, _, x in items)[i]))} "


# --- 10: subjects -----------------------------------------------------------------------------------------------------


def corpus(spark, n=240):
    rng = random.Random(9)
    topics = {"law": ["the court ruled on the appeal", "a judge heard the witness", "the trial was adjourned"], "sports": ["the team won the match", "a striker scored a goal", "the coach praised the players"]}
    filler = ["nobody had planned for it", "a crowd waited outside", "more details are expected soon"]
    docs, labels, truth = [], [], {}
    for i in range(n):
        about = rng.choice([["law"], ["sports"], ["law", "sports"], []])
        lines = [rng.choice(topics[s]) for s in about for _ in range(3)] + [rng.choice(filler) for _ in range(3)]
        rng.shuffle(lines)
        docs.append((i, ". ".join(x.capitalize() for x in lines) + ".", "x"))
        truth[i] = set(about)
        if i % 2 == 0:
            labels += [(i, s.upper() if i % 4 else f" {s} ", "ann") for s in (about if i % 20 else ["law"])] or [(i, None, "ann")]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "The court ruled on the appeal. " * 3000, "x"), (1003, "12 34.", "x")]
    return (spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), spark.createDataFrame([("Law", "c"), ("sports", "c")], "subject string, covers string"), truth)


def test_subjects_on_held_out_documents(spark):
    docs, labels, subjects, truth = corpus(spark)
    model = fitted_model(docs, labels, subjects)
    got: dict = {}
    for r in document_subjects(docs, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in truth if i % 2]
    assert sum(got.get(i, set()) == truth[i] for i in held) >= 0.9 * len(held)
    assert got[1002] == {"law"} and not {1000, 1001, 1003} & set(got)


def test_outputs_are_independent(spark):
    """A sentence with words of two subjects counts for both."""
    model = Model(["law", "sports"], ["court", "goal"], np.asarray([[20, -1], [-1, 20]], np.float32), np.full(2, -2.0))
    docs = spark.createDataFrame([(1, "The court saw a goal. Nobody spoke."), (2, "Rain fell.")], "doc_id long, text string")
    assert {(r["doc_id"], r["subject"], r["n_sentences"]) for r in document_subjects(docs, model).collect()} == {(1, "law", 1), (1, "sports", 1)}


def test_too_many_subjects_raise(spark, monkeypatch):
    docs, labels, subjects, _ = corpus(spark, 10)
    monkeypatch.setattr("skeinfeed.llm.subjects.MAX_SUBJECTS", 1)
    with pytest.raises(ValueError):
        fitted_model(docs, labels, subjects)


def test_subjects_without_labels_or_documents(spark):
    docs, labels, subjects, _ = corpus(spark, 10)
    assert document_subjects(docs, fitted_model(docs, labels.limit(0), subjects)).collect() == []
    assert document_subjects(docs.limit(0), Model(["law"], [], np.zeros((0, 1), np.float32), np.full(1, -9.0))).collect() == []
