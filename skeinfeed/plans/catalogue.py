"""Queries of the engine's own operators, over whole tables, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinfeed.functions import lexicon as L
from skeinfeed.functions import text as X
from skeinfeed.operators import dedup, feed, reader, store
from skeinfeed.operators.rewrite import rewritten
from skeinfeed.session import spread, table
from skeinfeed.sources import feeds, pages
from skeinfeed.streaming import dedup as streams

AS_OF = "2025-07-01 00:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
c = F.col


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def of_articles(name: str, columns, sql: str | None = None, heavy: bool = False) -> None:
    """A query that projects each article; columns: name to column. Heavy ones use all cores even on few files."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _articles(spark, d)
        return (spread(rows) if heavy else rows).select("row_id", *(v.alias(k) for k, v in columns().items()))

    run.__name__ = name
    query(sql)(run)


def where_articles(name: str, predicate, sql: str | None = None) -> None:
    """A query that keeps articles by a predicate."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _articles(spark, d).filter(predicate()).select("row_id")

    run.__name__ = name
    query(sql)(run)


# --- SQL pieces -------------------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def s_text(x: str) -> str:
    return f"coalesce({x}, '')"


def s_strip(x: str) -> str:
    return f"regexp_replace({s_text(x)}, '^[{X.WS}]+|[{X.WS}]+$', '', 'g')"


def s_collapse(x: str) -> str:
    return s_strip(f"regexp_replace({s_text(x)}, '[{X.WS}]+', ' ', 'g')")


def s_words(x: str) -> str:
    return f"list_filter(string_split({s_collapse(x)}, ' '), lambda w: w <> '')"


def s_count(x: str) -> str:
    return f"CAST(len({s_words(x)}) AS INTEGER)"


def s_hits(x: str, needles) -> str:
    return f"CAST(len(list_filter({s_list(needles)}, lambda n: contains({x}, n))) AS INTEGER)"


def s_key(x: str) -> str:
    return rf"regexp_replace(lower({s_text(x)}), '[^a-z0-9\x{{0c00}}-\x{{0c7f}}]', '', 'g')"


#: The form encoding of the JVM: blanks as +, the star as it is, the tilde written out.
S_ENCODED = "replace(replace(replace(url_encode(term), '%20', '+'), '%2A', '*'), '~', '%7E')"
BOTH = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"
ID = f"md5({s_strip('url')} || '|' || {s_strip('title')})"
ENDS = r"[.!?।\"''\])]$"
SENTIMENT = f"SELECT row_id, {s_hits(BOTH, L.POSITIVE)} AS p, {s_hits(BOTH, L.NEGATIVE)} AS n FROM articles"
HITS = ", ".join(f"{s_hits(BOTH, w)} AS {k}" for k, w in L.CATEGORY_WORDS.items())
_ORDERED = list(L.CATEGORY_WORDS)
CATEGORY = f"SELECT row_id, CASE WHEN greatest({', '.join(_ORDERED)}) = 0 THEN 'general' " + " ".join(f"WHEN {k} = greatest({', '.join(_ORDERED)}) THEN '{k}'" for k in _ORDERED) + f" END AS category FROM (SELECT row_id, {HITS} FROM articles)"
POOL = "CASE " + " ".join(f"WHEN {'lang_te' if lang == 'te' else 'NOT lang_te'} AND cat = '{k}' THEN {s_list(v)}" for lang, by in L.TAG_POOLS.items() for k, v in by.items()) + f" ELSE ['{L.OTHER_TAG}'] END"
_BARE = f"regexp_replace({s_strip('published_at')}, '^[A-Za-z]{{3,9}}, *', '')"
MOMENT = f"""SELECT row_id, {_BARE} AS b, CASE
  WHEN regexp_full_match({_BARE}, '\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d{{2}}:\\d{{2}}:\\d{{2}} [+-]\\d{{4}}') THEN epoch_us(try_strptime({_BARE}, '%d %b %Y %H:%M:%S %z'))
  WHEN regexp_full_match({_BARE}, '\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d{{2}}:\\d{{2}}:\\d{{2}} (GMT|UTC)') THEN epoch_us(try_strptime(regexp_replace({_BARE}, ' (GMT|UTC)$', ''), '%d %b %Y %H:%M:%S'))
  WHEN regexp_full_match({_BARE}, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}([.]\\d{{1,6}})?)?(Z|[+-]\\d{{2}}:\\d{{2}})?)?') THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches({_BARE}, '[T ]\\d{{2}}:\\d{{2}}([Z+-]|$)') THEN regexp_replace({_BARE}, '([T ]\\d{{2}}:\\d{{2}})', '\\1:00') ELSE {_BARE} END AS TIMESTAMPTZ)) END AS us FROM articles"""
FRESH = f"(us IS NULL OR epoch_us(TIMESTAMP '{AS_OF}') - us BETWEEN -3600000000 AND 259200000000)"
REQUIRED = f"{s_strip('url')} <> '' AND {s_strip('title')} <> '' AND NOT contains(title, '[Removed]')"

# --- projections and scores -------------------------------------------------------------------------------------------

of_articles("q_article_id", lambda: {"article_id": X.article_id(c("url"), c("title"))}, f"SELECT row_id, {ID} AS article_id FROM articles")
of_articles("q_sentiment", lambda: dict(zip(("sentiment", "score"), X.sentiment(c("title"), c("description")))), f"SELECT row_id, CASE WHEN p > n THEN 'Positive' WHEN p < n THEN 'Negative' ELSE 'Neutral' END AS sentiment, CAST(greatest(38, least(99, 60 + 5 * p - 4 * n)) AS INTEGER) AS score FROM ({SENTIMENT})")
of_articles("q_category", lambda: {"category": X.category(c("title"), c("description"))}, CATEGORY)
of_articles("q_tags", lambda: {"tags": F.array_join(X.tags(c("category"), X.article_id(c("url"), c("title")), c("language")), " ")}, f"SELECT row_id, pool[i % len(pool) + 1] || ' ' || pool[(i + 1) % len(pool) + 1] || ' ' || CASE WHEN lang_te THEN {q(L.LIVE_TAG['te'])} ELSE {q(L.LIVE_TAG['en'])} END AS tags FROM (SELECT *, {POOL} AS pool FROM (SELECT row_id, lower(coalesce(category, '')) AS cat, coalesce(language, '') = 'te' AS lang_te, ('0x' || substr({ID}, 1, 8))::BIGINT AS i FROM articles))")
of_articles("q_word_count", lambda: {"n_words": X.word_count(c("content"))}, f"SELECT row_id, {s_count('content')} AS n_words FROM articles")
of_articles("q_normal_keys", lambda: {"category": X.normal_category(c("category")), "language": X.normal_language(c("language"))}, f"SELECT row_id, coalesce(map_extract_value(MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in L.CATEGORY_LABELS.items())}}}, {s_strip('category')}), CASE WHEN list_contains({s_list(L.CATEGORY_LABELS.values())}, lower({s_strip('category')})) THEN lower({s_strip('category')}) END, 'general') AS category, coalesce(map_extract_value(MAP {{'English': 'en', 'Telugu': 'te'}}, {s_strip('language')}), CASE WHEN lower({s_strip('language')}) IN ('en', 'te') THEN lower({s_strip('language')}) END, 'en') AS language FROM articles")
of_articles("q_prompt_tier", lambda: {"tier": X.prompt_tier(X.word_count(c("content")))}, f"SELECT row_id, CASE WHEN {s_count('content')} >= 150 THEN 'RICH' WHEN {s_count('content')} >= 40 THEN 'MEDIUM' ELSE 'THIN' END AS tier FROM articles")
_D, _BARE_D = s_strip("description"), "regexp_replace({}, '[.!?। ]+$', '')"
_REPEATS = f"(b <> '' AND t <> '' AND (b = t OR {_BARE_D.format('b')} = {_BARE_D.format('t')}))"
of_articles("q_card", lambda: {"card": X.card_text(c("description"), c("title")), "day": F.substring(X.text(c("published_at")), 1, 10)}, f"SELECT row_id, CASE WHEN {_REPEATS} THEN '' WHEN length(d) > 170 THEN regexp_replace(substr(d, 1, 170), ' [^ ]*$', '') || '…' ELSE d END AS card, substr(coalesce(published_at, ''), 1, 10) AS day FROM (SELECT *, lower({s_collapse('description')}) AS b, lower({s_collapse('title')}) AS t, {_D} AS d FROM articles)")
of_articles("q_json_address", lambda: {"address": feeds.json_address("https://api.example", c("category"), c("language"), F.when(c("score") > 70, F.element_at(X.words(c("title")), 1)))}, f"SELECT row_id, CASE WHEN coalesce(term, '') <> '' THEN 'https://api.example/search?q=' || {S_ENCODED} || lang || '&country=in' ELSE 'https://api.example/top-headlines?country=in' || lang || '&category=' || CASE WHEN category IN ({', '.join(map(q, feeds.JSON_CATEGORIES))}) THEN category ELSE 'general' END END || '&max=30&token=' AS address FROM (SELECT row_id, category, CASE WHEN score > 70 THEN {s_words('title')}[1] END AS term, CASE WHEN coalesce(language, '') <> '' THEN '&lang=' || language ELSE '' END AS lang FROM articles)")
of_articles("q_news_address", lambda: {"address": feeds.news_address("https://news.example/rss", c("category"), c("language"), F.when(c("score") > 80, F.element_at(X.words(c("title")), 1)))}, f"SELECT row_id, CASE WHEN coalesce(term, '') <> '' THEN 'https://news.example/rss/search?q=' || {S_ENCODED} || '&' || own WHEN lower(coalesce(category, '')) IN ('general', 'eenadu', 'sakshi', 'andhrajyothi') THEN 'https://news.example/rss?' || own ELSE 'https://news.example/rss/headlines/section/topic/' || CASE WHEN lower(category) IN ({', '.join(map(q, feeds.TOPICS))}) THEN upper(category) ELSE 'WORLD' END || '?hl=en-IN&gl=IN&ceid=IN:en' END AS address FROM (SELECT row_id, category, CASE WHEN score > 80 THEN {s_words('title')}[1] END AS term, CASE WHEN language = 'te' THEN 'hl=te&gl=IN&ceid=IN:te' ELSE 'hl=en-IN&gl=IN&ceid=IN:en' END AS own FROM articles)")

# --- predicates -------------------------------------------------------------------------------------------------------

where_articles("q_content_sufficient", lambda: X.word_count(c("content")) >= 40, f"SELECT row_id FROM articles WHERE {s_count('content')} >= 40")
_LAST = rf"lower(regexp_replace({s_words('content')}[-1], '^[^\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+$', '', 'g'))"
where_articles("q_complete", lambda: X.complete(c("content")), f"SELECT row_id FROM articles WHERE {s_count('content')} >= 20 AND regexp_matches({s_strip('content')}, '{ENDS}') AND NOT coalesce(list_contains({s_list(L.CUTOFF_WORDS)}, {_LAST}), false)")
where_articles("q_bundle_valid", lambda: X.valid_bundle(c("content")), rf"SELECT row_id FROM articles WHERE {s_count('content')} >= 40 AND (regexp_matches({s_strip('content')}, '{ENDS}') OR NOT regexp_matches({s_strip('content')}, '[\p{{L}}\p{{N}}]$'))")
where_articles("q_required_fields", lambda: X.required(c("url"), c("title")), f"SELECT row_id FROM articles WHERE {REQUIRED}")
where_articles("q_fresh", lambda: feed.fresh(c("published_at"), F.lit(AS_OF).cast("timestamp")), f"SELECT row_id FROM ({MOMENT}) WHERE {FRESH}")
of_articles("q_moment", lambda: {"us": F.unix_micros(feed.moment(c("published_at")))}, f"SELECT row_id, us FROM ({MOMENT})")
where_articles("q_publisher", lambda: X.of_publisher(c("url"), c("source"), "eenadu") | X.of_publisher(c("url"), c("source"), "sakshi") | F.contains(F.lower(X.text(c("source"))), F.lit("varta")), "SELECT row_id FROM articles WHERE contains(lower(coalesce(url, '')), 'eenadu.net') OR contains(lower(coalesce(source, '')), 'eenadu') OR contains(lower(coalesce(url, '')), 'sakshi.com') OR contains(lower(coalesce(source, '')), 'sakshi') OR contains(lower(coalesce(source, '')), 'varta')")
where_articles("q_scrapeable", lambda: X.scrapeable(c("url")), f"SELECT row_id FROM articles WHERE coalesce(url, '') <> '' AND NOT regexp_matches(url, '(?i)/({'|'.join(L.NO_TEXT_PATHS)})/')")
_IMAGE = f"(regexp_matches({s_strip('image_url')}, '^https?://') AND (regexp_matches(split_part(lower({s_strip('image_url')}), '?', 1), '({'|'.join(e.replace('.', '[.]') for e in L.IMAGE_ENDS)})$') OR {s_hits('lower(' + s_strip('image_url') + ')', L.IMAGE_PARTS)} > 0))"
where_articles("q_image_valid", lambda: X.image_url(c("image_url")), f"SELECT row_id FROM articles WHERE {_IMAGE}")
_SMALL = rf"regexp_matches(split_part(lower({s_text('image_url')}), '?', 1), '/\d{{1,9}}x\d{{1,9}}[.](gif|png)$') AND (TRY_CAST(regexp_extract(split_part(lower({s_text('image_url')}), '?', 1), '/(\d{{1,9}})x(\d{{1,9}})[.](gif|png)$', 1) AS INTEGER) < 50 OR TRY_CAST(regexp_extract(split_part(lower({s_text('image_url')}), '?', 1), '/(\d{{1,9}})x(\d{{1,9}})[.](gif|png)$', 2) AS INTEGER) < 50)"
where_articles("q_article_image", lambda: X.article_image(c("image_url")), f"SELECT row_id FROM articles WHERE {_IMAGE} AND NOT regexp_matches(coalesce(image_url, ''), '(?i)({L.NO_ARTICLE_IMAGE})') AND NOT ({_SMALL})")
where_articles("q_fits_title", lambda: X.fits_title(c("content"), c("title")), rf"SELECT row_id FROM articles WHERE CASE WHEN coalesce(title, '') = '' THEN coalesce(content, '') <> '' ELSE len(list_filter(regexp_extract_all(lower(title), '[a-z\x{{0c00}}-\x{{0c7f}}]{{4,}}'), lambda w: contains(lower(coalesce(content, '')), w))) >= 1 END")
where_articles("q_repeats_title", lambda: X.repeats_title(c("description"), c("title")), f"SELECT row_id FROM (SELECT row_id, lower({s_collapse('description')}) AS b, lower({s_collapse('title')}) AS t FROM articles) WHERE {_REPEATS}")
_D_LOW = f"lower({s_strip('description')})"
where_articles("q_garbage_sentence", lambda: X.garbage_sentence(c("description")), f"SELECT row_id FROM articles WHERE length({_D_LOW}) < 5 OR regexp_matches({_D_LOW}, '^(https?://|www[.])[^{X.WS}]+$') OR regexp_matches({_D_LOW}, '{'|'.join(L.GARBAGE_SENTENCES)}')")
_S = s_strip("description")
where_articles("q_noise_paragraph", lambda: X.noise_paragraph(c("description")), rf"SELECT row_id FROM articles WHERE length({_S}) < 5 OR {s_hits('lower(' + s_text('description') + ')', L.NOISE_WORDS)} >= 2 OR ({s_count('description')} <= 5 AND NOT regexp_matches({_S}, '[.!?।]') AND regexp_matches({_S}, '^[^\p{{Ll}}\p{{Lt}}]*\p{{Lu}}[^\p{{Ll}}\p{{Lt}}]*$'))")

# --- cleaning ---------------------------------------------------------------------------------------------------------

_SIGNS = rf"regexp_replace(coalesce(content, ''), '[\x{{2190}}-\x{{21ff}}\x{{2794}}-\x{{27bf}}\x{{2b00}}-\x{{2bff}}\x{{25a0}}-\x{{26ff}}\x{{bb}}\x{{ab}}\x{{feff}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}]+|>{{2,}}|<{{2,}}|-+>|<-+', ' ', 'g')"
of_articles("q_strip_symbols", lambda: {"text": X.strip_symbols(c("content"))}, rf"SELECT row_id, {s_strip(rf'''regexp_replace(regexp_replace({_SIGNS}, '[ \t]{{2,}}', ' ', 'g'), '\n([{X.WS}]*\n)+', chr(10), 'g')''')} AS text FROM articles")
of_articles("q_strip_html", lambda: {"text": X.strip_html(F.concat(F.lit("<p class='a'>"), X.text(c("description")), F.lit("</p>")), " ")}, "SELECT row_id, regexp_replace('<p class=''a''>' || coalesce(description, '') || '</p>', '<[^>]+>', ' ', 'g') AS text FROM articles")
_T = "t"
_BACK = r"regexp_extract(t, '^((.|\n)*[.!?।])[^.!?।]{0,80}$', 1)"
of_articles("q_ending", lambda: {"text": X.complete_ending(c("description"), c("language"))}, rf"SELECT row_id, CASE WHEN t = '' OR regexp_matches(t, '{ENDS}') THEN t WHEN regexp_matches(t, '[\p{{L}}\p{{N}},;:]$') AND {_BACK} <> '' THEN {s_strip(_BACK)} ELSE t || CASE WHEN coalesce(language, '') = 'en' THEN '.' ELSE '।' END END AS text FROM (SELECT row_id, language, {s_strip('description')} AS t FROM articles)")
_PARAS = f"list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda p: {s_strip('p')}), lambda p: p <> '')"
of_articles("q_broken_words", lambda: {"text": X.without_broken_words(c("content"), "\n")}, f"SELECT row_id, array_to_string(list_transform({_PARAS}, lambda p: {s_strip(chr(32).join(['''regexp_replace(regexp_replace(p, '^[a-z]{1,2} ', ''), ' [a-z]{1,2}$', '')''']))}), chr(10) || chr(10)) AS text FROM articles")
of_articles("q_empty_paragraphs", lambda: {"text": X.without_empty_paragraphs(c("content"), "\n")}, rf"SELECT row_id, array_to_string(list_filter({_PARAS}, lambda p: NOT regexp_matches(p, '^[^\p{{L}}\p{{M}}\p{{N}}]*$') AND ({s_count('p')} >= 3 OR regexp_matches(p, '[\x{{0c00}}-\x{{0c7f}}]'))), chr(10) || chr(10)) AS text FROM articles")
_LINES = "SELECT row_id, line, i FROM (SELECT row_id, unnest(string_split(coalesce(content, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(content, ''), chr(10))) + 1)) AS i FROM articles)"
of_articles("q_distinct_lines", lambda: {"text": X.distinct_lines(c("content"))}, f"WITH l AS (SELECT *, lower({s_collapse('line')}) AS k FROM ({_LINES})), f AS (SELECT *, row_number() OVER (PARTITION BY row_id, k ORDER BY i) AS n FROM l) SELECT row_id, string_agg(line, chr(10) ORDER BY i) AS text FROM f WHERE n = 1 OR k = '' GROUP BY row_id")
of_articles("q_distinct_paragraphs", lambda: {"text": X.distinct_paragraphs(c("content"), "\n")}, f"WITH l AS (SELECT row_id, i, {s_strip('line')} AS p FROM ({_LINES})), f AS (SELECT *, row_number() OVER (PARTITION BY row_id, substr(lower({s_collapse('p')}), 1, 120) ORDER BY i) AS n FROM l WHERE p <> '') SELECT a.row_id, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i), '') AS text FROM articles a LEFT JOIN f ON a.row_id = f.row_id AND n = 1 GROUP BY a.row_id")
of_articles("q_fix_encoding", lambda: {"text": X.fix_encoding(c("content"))})
of_articles("q_without_summaries", lambda: {"text": X.without_summaries(c("content"))})
of_articles("q_clean_metadata", lambda: {"text": X.clean_metadata(c("content"))}, heavy=True)
of_articles("q_distinct_sentences", lambda: {"text": X.distinct_sentences(c("content"))}, heavy=True)
_JUNK = rf"NOT regexp_matches(p, '[.!?।]') AND {s_count('p')} <= 8 AND (regexp_matches(lower(p), '^({'|'.join(L.TRAILING_LABELS)})\b') OR ({s_count('p')} <= 3 AND NOT regexp_matches(p, '[\x{{0c00}}-\x{{0c7f}}]')) OR regexp_matches(p, '^https?://[^{X.WS}]+$'))"
of_articles("q_trailing_junk", lambda: {"text": X.without_trailing_junk(c("content"), "\n")}, f"SELECT row_id, array_to_string(ps[:greatest(coalesce(list_max(list_transform(list_filter(range(1, len(ps) + 1), lambda i: NOT js[i]), lambda i: i)), 1), 1)], chr(10) || chr(10)) AS text FROM (SELECT row_id, ps, list_transform(ps, lambda p: {_JUNK}) AS js FROM (SELECT row_id, {_PARAS} AS ps FROM articles))")
of_articles("q_relevant_paragraphs", lambda: {"text": X.relevant_paragraphs(c("content"), c("title"), sep="\n")}, heavy=True)
of_articles("q_clean_article", lambda: {"text": X.clean_article(c("content"), c("language"), c("title"))}, heavy=True)
of_articles("q_built_article", lambda: {"text": X.built_article(c("content"), c("language"))}, heavy=True)
of_articles("q_highlights", lambda: {"highlights": F.array_join(X.highlights(c("content")), "\n")}, heavy=True)
of_articles("q_chunks", lambda: {"chunks": F.array_join(X.chunks(c("content")), "\n\n")}, heavy=True)
of_articles("q_best_source", lambda: {"text": X.best_source(c("title"), c("description"), c("content"))}, heavy=True)
of_articles("q_raw_fallback", lambda: {"text": X.raw_fallback(c("title"), c("description"), c("content"), c("language"))}, heavy=True)

# --- deduplication, feed, search --------------------------------------------------------------------------------------


@query("SELECT row_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY row_id) AS n FROM articles WHERE article_id IS NOT NULL) WHERE n = 1")
def q_dedup_id(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(_articles(spark, d).select("row_id", "article_id"), "article_id", ["row_id"])


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {s_strip('url')} ORDER BY row_id) AS n FROM articles WHERE {s_strip('url')} <> '' AND lower(category) IN ('technology', 'sports')) WHERE n = 1")
def q_preferred(spark: SparkSession, d: str) -> DataFrame:
    return feed.preferred(_articles(spark, d).select("row_id", "url", "category"), ["technology", "sports"]).select("row_id")


_GREEDY = f"""
WITH RECURSIVE good AS (SELECT a.row_id, coalesce(url, '') AS u, {s_key('title')} AS t FROM articles a JOIN ({MOMENT}) m USING (row_id) WHERE {REQUIRED} AND {FRESH}),
numbered AS (SELECT *, row_number() OVER (ORDER BY row_id) AS k FROM good),
scan AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS row_id, false AS keep, []::VARCHAR[] AS us, []::VARCHAR[] AS ts
  UNION ALL
  SELECT n.k, n.row_id, ok, CASE WHEN ok THEN list_append(us, u) ELSE us END, CASE WHEN ok THEN list_append(ts, t) ELSE ts END
  FROM (SELECT n.k, n.row_id, n.u, n.t, s.us, s.ts, NOT list_contains(s.us, n.u) AND NOT list_contains(s.ts, n.t) AS ok FROM scan s JOIN numbered n ON n.k = s.k + 1) n)
SELECT row_id FROM scan WHERE keep
"""


@query(_GREEDY)
def q_smart_filter(spark: SparkSession, d: str) -> DataFrame:
    return feed.smart_filter(_articles(spark, d), F.lit(AS_OF).cast("timestamp")).select("row_id")


_TOP = f"""
WITH kept AS ({_GREEDY}),
scored AS (SELECT a.row_id, {ID} AS article_id, a.title, a.source, ca.category, CASE WHEN p > n THEN 'Positive' WHEN p < n THEN 'Negative' ELSE 'Neutral' END AS sentiment, CAST(greatest(38, least(99, 60 + 5 * p - 4 * n)) AS INTEGER) AS score, coalesce(a.language, '') = 'te' AS lang_te, lower(ca.category) AS cat
  FROM articles a JOIN kept USING (row_id) JOIN ({SENTIMENT}) s USING (row_id) JOIN ({CATEGORY}) ca USING (row_id)),
pooled AS (SELECT *, ('0x' || substr(article_id, 1, 8))::BIGINT AS i, {POOL} AS pool FROM scored)
SELECT row_id, article_id, title, source, category, sentiment, score, [pool[i % len(pool) + 1], pool[(i + 1) % len(pool) + 1], CASE WHEN lang_te THEN {q(L.LIVE_TAG['te'])} ELSE {q(L.LIVE_TAG['en'])} END] AS tags FROM pooled ORDER BY score DESC, row_id LIMIT 30
"""


@query(_TOP)
def q_feed_top30(spark: SparkSession, d: str) -> DataFrame:
    kept = feed.smart_filter(_articles(spark, d), F.lit(AS_OF).cast("timestamp"))
    return feed.ranked(feed.scored(kept)).limit(30).select("row_id", "article_id", "title", "source", "category", "sentiment", "score", "tags")


@query(f"SELECT count(*) AS total, (SELECT count(*) FROM ({_GREEDY})) AS kept, count(*) - (SELECT count(*) FROM ({_GREEDY})) AS dropped FROM articles")
def q_kept_counts(spark: SparkSession, d: str) -> DataFrame:
    return feed.kept_counts(_articles(spark, d), F.lit(AS_OF).cast("timestamp"))


@query("SELECT row_id, score FROM articles ORDER BY coalesce(score, 0) DESC, row_id LIMIT 30")
def q_rank_top30(spark: SparkSession, d: str) -> DataFrame:
    return feed.ranked(_articles(spark, d)).limit(30).select("row_id", "score")


@query("SELECT row_id, source, score FROM (SELECT row_id, source, score, row_number() OVER (PARTITION BY source ORDER BY coalesce(score, 0) DESC, row_id) AS n FROM articles) WHERE n <= 3")
def q_top_of_source(spark: SparkSession, d: str) -> DataFrame:
    return feed.top_of_each(_articles(spark, d).select("row_id", "source", "score"), "source", 3)


@query("SELECT row_id FROM articles WHERE contains(lower(coalesce(title, '')), 'market') OR contains(lower(coalesce(description, '')), 'market')")
def q_search(spark: SparkSession, d: str) -> DataFrame:
    return feed.search(_articles(spark, d), " Market ").select("row_id")


@query("SELECT row_id FROM articles WHERE language = 'en' AND contains(lower(coalesce(title, '') || ' ' || coalesce(description, '')), 'release') AND category = 'entertainment'")
def q_search_cached(spark: SparkSession, d: str) -> DataFrame:
    return feed.search_cached(_articles(spark, d), "Release", "en", "entertainment").select("row_id")


@query("WITH hits AS (SELECT row_id FROM articles WHERE language = 'en' AND contains(lower(coalesce(title, '') || ' ' || coalesce(description, '')), 'nowhere said')), rest AS (SELECT row_id FROM articles WHERE contains(lower(coalesce(title, '')), 'trial') OR contains(lower(coalesce(description, '')), 'trial')) SELECT row_id FROM hits UNION ALL SELECT row_id FROM rest WHERE NOT EXISTS (SELECT 1 FROM hits)")
def q_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).select("row_id", "title", "description", "language", "category")
    return feed.or_else(feed.search_cached(rows, "nowhere said", "en"), feed.search(rows, "trial")).select("row_id")


@query("SELECT row_id FROM articles WHERE category = 'sports' AND language = 'te' UNION ALL SELECT row_id FROM articles WHERE category = 'sports' AND language = 'en' AND NOT EXISTS (SELECT 1 FROM articles WHERE category = 'sports' AND language = 'te')")
def q_language_fallback(spark: SparkSession, d: str) -> DataFrame:
    return feed.with_fallback(_articles(spark, d), "sports", "te").select("row_id")


@query("""
WITH tiers AS (SELECT row_id, article_id, category, CAST(row_id % 3 AS INTEGER) + 1 AS tier FROM articles WHERE article_id IS NOT NULL),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY tier, row_id) AS n FROM tiers) WHERE n = 1),
counts AS (SELECT category, tier, count(*) AS n FROM first GROUP BY ALL),
taken AS (SELECT category, tier FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY category ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts) WHERE tier = 1 OR (tier = 2 AND before < 40) OR (tier = 3 AND before < 10))
SELECT f.row_id, f.category, f.tier FROM first f JOIN taken t ON f.category = t.category AND f.tier = t.tier
""")
def q_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).select("row_id", "article_id", "category", (F.col("row_id") % 3 + 1).cast("int").alias("tier"))
    return dedup.cascade(rows, ["category"], "tier", {2: 40, 3: 10}, "article_id", ["row_id"]).select("row_id", "category", "tier")


# --- stores -----------------------------------------------------------------------------------------------------------


_STATES = rf"""
WITH latest AS (SELECT article_id, {s_strip("CASE WHEN json_valid(data) THEN json_extract_string(data, '$.content') END")} AS cached FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY cached_at DESC NULLS LAST, cache_id DESC) AS n FROM ai_cache WHERE article_id IS NOT NULL) WHERE n = 1)
SELECT row_id, CASE WHEN coalesce(cached, '') = '' THEN 'miss' WHEN {s_count('cached')} < CASE WHEN coalesce(language, '') = 'te' THEN 80 ELSE %d END THEN 'short'
  WHEN %s AND NOT CASE WHEN coalesce(title, '') = '' THEN true ELSE len(list_filter(regexp_extract_all(lower(title), '[a-z\x{{0c00}}-\x{{0c7f}}]{{4,}}'), lambda w: contains(lower(cached), w))) >= 1 END THEN 'mismatch' ELSE 'hit' END AS state
FROM articles LEFT JOIN latest USING (article_id)
"""


@query(_STATES.replace("%d", "280").replace("%s", "true"))
def q_reader_state(spark: SparkSession, d: str) -> DataFrame:
    return reader.cache_states(_articles(spark, d), table(spark, d, "ai_cache")).select("row_id", "state")


@query(_STATES.replace("%d", "300").replace("%s", "false"))
def q_bundle_state(spark: SparkSession, d: str) -> DataFrame:
    return reader.cache_states(_articles(spark, d), table(spark, d, "ai_cache"), reader.BUNDLE_WORDS, match_title=False).select("row_id", "state")


@query()
def q_reader_texts(spark: SparkSession, d: str) -> DataFrame:
    states = reader.cache_states(spread(_articles(spark, d)), table(spark, d, "ai_cache"))
    return reader.reader_texts(states.withColumn("scraped", F.lit(None).cast("string"))).select("row_id", "text", "from_cache", "saved")


@query("SELECT article_id, cache_id, word_count FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY cached_at DESC NULLS LAST, cache_id DESC) AS n FROM (SELECT DISTINCT article_id, cache_id, word_count, cached_at FROM ai_cache)) WHERE n = 1")
def q_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upserted(table(spark, d, "ai_cache").select("article_id", "cached_at", "cache_id", "word_count"), ["article_id"], "cached_at").select("article_id", "cache_id", "word_count")


_CONTENT = "CASE WHEN json_valid(data) THEN json_extract_string(data, '$.content') END"
_VALID = rf"coalesce({s_count('t')} >= 40 AND t IS NOT NULL AND (regexp_matches({s_strip('t')}, '{ENDS}') OR NOT regexp_matches({s_strip('t')}, '[\p{{L}}\p{{N}}]$')), false)"


@query(f"SELECT cache_id FROM (SELECT cache_id, {_CONTENT} AS t FROM ai_cache) WHERE {_VALID}")
def q_cache_valid(spark: SparkSession, d: str) -> DataFrame:
    return store.cached_entries(table(spark, d, "ai_cache")).select("cache_id")


@query(f"SELECT cache_id FROM (SELECT cache_id, {_CONTENT} AS t FROM ai_cache) WHERE NOT {_VALID}")
def q_cache_evict(spark: SparkSession, d: str) -> DataFrame:
    return store.cached_entries(table(spark, d, "ai_cache"), valid=False).select("cache_id")


@query("SELECT cache_id FROM ai_cache WHERE epoch_us(TIMESTAMP '2025-07-01 00:00:00') < epoch_us(cached_at) + 86400000000")
def q_cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    return store.unexpired(table(spark, d, "ai_cache"), F.lit(AS_OF).cast("timestamp")).select("cache_id")


@query("SELECT row_id, article_id FROM articles WHERE NOT (coalesce(category = 'sports' AND language = 'en', false))")
def q_invalidate(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d).withColumns({"category": F.coalesce("category", F.lit("")), "language": F.coalesce("language", F.lit(""))})
    return store.invalidated(rows, "sports", "en").select("row_id", "article_id")


@query(f"""
WITH cached AS (SELECT article_id, max(t) AS scraped FROM (SELECT article_id, {_CONTENT} AS t FROM ai_cache) GROUP BY article_id)
SELECT row_id, {s_count('new')} AS n_words FROM (SELECT a.row_id, CASE WHEN scraped IS NOT NULL AND {s_count('scraped')} > greatest({s_count('content')}, {s_count('description')}) THEN scraped ELSE content END AS new FROM articles a LEFT JOIN cached USING (article_id))
""")
def q_enriched(spark: SparkSession, d: str) -> DataFrame:
    read = table(spark, d, "ai_cache").select("article_id", F.get_json_object("data", "$.content").alias("t"))
    scraped = read.groupBy("article_id").agg(F.max("t").alias("scraped")).withColumn("image", F.lit(""))
    return feed.enriched(_articles(spark, d), scraped).select("row_id", X.word_count(c("content")).alias("n_words"))


@query("SELECT username, pref_key, pref_value, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY username, pref_key ORDER BY saved_at DESC NULLS LAST, pref_value DESC NULLS LAST) AS n FROM user_preferences) WHERE n = 1")
def q_pref_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upserted(table(spark, d, "user_preferences"), ["username", "pref_key"], "saved_at")


@query("""
WITH latest AS (SELECT username, pref_key, coalesce(CASE WHEN json_valid(pref_value) AND json_type(pref_value) <> 'NULL' THEN json_extract_string(pref_value, '$') END, pref_value) AS own FROM (SELECT *, row_number() OVER (PARTITION BY username, pref_key ORDER BY saved_at DESC NULLS LAST, pref_value DESC NULLS LAST) AS n FROM user_preferences) WHERE n = 1),
defaults AS (SELECT username, unnest(['category', 'language', 'dark_mode']) AS pref_key, unnest(['General', 'English', 'false']) AS d FROM users)
SELECT username, pref_key, coalesce(own, d) AS pref_value FROM defaults FULL JOIN latest USING (username, pref_key)
""")
def q_preferences(spark: SparkSession, d: str) -> DataFrame:
    return store.preferences(table(spark, d, "user_preferences"), table(spark, d, "users"))


@query(f"SELECT username, sha256('secret-' || username) AS password, CASE WHEN username IN (SELECT username FROM users) THEN 'exists' ELSE 'success' END AS outcome FROM (SELECT DISTINCT {s_strip('username')} AS username FROM user_preferences)")
def q_register(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "user_preferences").select(X.strip(c("username")).alias("username")).distinct()
    return store.registered(table(spark, d, "users"), new.select("username", F.concat(F.lit("secret-"), "username").alias("password")))


@query("SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, sum(value) AS sum_value FROM events GROUP BY event_type")
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    return store.metrics(table(spark, d, "events"))


# --- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1000000) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def q_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return streams.call_counts(rows, "ts", 3600, ["user_id"]).select("event_id", "n")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.window_counts(table(spark, d, "events"), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not path.startswith("/") else f"file://{path}*")
    first = streams.first_sightings(stream, ["user_id", "event_type"], "ts", "400 days")
    return streams.run_available(spark, first.select("user_id", "event_type"), "stream-dedup")


# --- sources ----------------------------------------------------------------------------------------------------------


def _xml(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(X.fix_encoding(x), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def _rendered(spark: SparkSession, d: str, item: Column, joint: str, head: str, tail: str) -> DataFrame:
    """Articles written as one document for each 25 ids, in the order of their ids."""
    items = _articles(spark, d).select((F.col("row_id") / 25).cast("bigint").alias("doc"), "row_id", item.alias("item"))
    return items.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "item"))), lambda x: x["item"]), joint).alias("v")).select(F.col("doc").cast("string").alias("path"), F.concat(F.lit(head), "v", F.lit(tail)).alias("value"))


@query()
def q_rss_scan(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.lit("<item><title>"), _xml(c("title")), F.lit("</title><link>"), _xml(c("url")), F.lit("</link><description>"), _xml(c("description")), F.lit("</description><pubDate>"), _xml(c("published_at")), F.lit("</pubDate><source>"), _xml(c("source")), F.lit("</source></item>"))
    return feeds.rss_articles(_rendered(spark, d, item, "", "<rss><channel>", "</channel></rss>"), "general", "en")


@query()
def q_publisher_scan(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.lit("<item><title>"), _xml(c("title")), F.lit("</title><link>"), _xml(c("url")), F.lit("</link><description>"), _xml(c("description")), F.lit("</description><source>"), _xml(c("source")), F.lit("</source></item>"))
    documents = _rendered(spark, d, item, "", "<rss><channel>", "</channel></rss>")
    part = F.pmod(F.xxhash64("path"), F.lit(3))
    return feeds.publisher_articles([documents.filter("path = '0'"), documents.filter("path = '1'")], documents.filter(part == 1), documents.filter(part == 2), "sakshi", "te").select("path", "item_no", "article_id", "title", "tags")


@query()
def q_json_scan(spark: SparkSession, d: str) -> DataFrame:
    item = F.to_json(F.struct("title", "description", "content", "url", c("image_url").alias("image"), c("published_at").alias("publishedAt"), F.struct(c("source").alias("name")).alias("source")))
    return feeds.json_articles(_rendered(spark, d, item, ",", '{"articles":[', "]}"), "general", "en")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Articles as pages of tag soup: each line a paragraph within an article element, between navigation and footer."""
    body = F.concat(F.lit("<p>"), F.regexp_replace(_xml(c("content")), "\n+", "<p>"))
    html = F.concat(F.lit('<html><head><meta property="og:image" content="'), X.text(c("image_url")), F.lit('"><script>var a = "</p>";</script></head><body><nav>Home News Sport</nav><article>'), body, F.lit('</article><div class="ad-slot">Buy this now, today only</div><footer>All rights reserved</footer>'))
    return spread(_articles(spark, d)).select("row_id", "url", html.alias("html"))


@query()
def q_page_parts(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_parts(_pages(spark, d), "row_id").select("row_id", "tier", F.size("paragraphs").alias("n_paragraphs"), "image_url")


@query()
def q_scraped(spark: SparkSession, d: str) -> DataFrame:
    return pages.scraped_articles(_pages(spark, d), "row_id")


@query("SELECT row_id, 'en' AS language FROM articles WHERE NOT regexp_matches(lower(coalesce(url, '')), 'eenadu|sakshi|andhrajyothi|tupaki|hindustantimes') UNION ALL SELECT row_id, 'te' FROM articles WHERE regexp_matches(lower(coalesce(url, '')), 'eenadu|sakshi|andhrajyothi|tupaki|hindustantimes')")
def q_host_language(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("row_id", pages.language_of_host(c("url")).alias("language"))


@query("SELECT row_id, coalesce(content, '') AS text FROM articles")
def q_decoded(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d).select("row_id", pages.decoded(X.text(c("content")).cast("binary"), F.lit("text/html; charset=utf-8")).alias("text"))


@query()
def q_rewritten(spark: SparkSession, d: str) -> DataFrame:
    return rewritten(spread(_articles(spark, d)), "row_id")
