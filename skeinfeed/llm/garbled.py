"""Text that went through a wrong character encoding: its detection and, where nothing was lost, its restoration.

Every distinct clean word of the corpus is garbled along every chain of encodings; the suspicious tokens of the documents
are hash-joined against that table, and the clean original takes their place. Tokens whose original stands nowhere clean
are decoded strictly, and count only if every letter they give stands in the corpus's clean text.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinfeed.session import small, written


def _single_byte(codec: str) -> dict[int, str]:
    """The character each byte becomes; bytes the code page leaves open become the control of the same number."""
    table = {}
    for b in range(256):
        try:
            table[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            table[b] = chr(b)
    return table


# Single-byte code pages that text in UTF-8 is wrongly read as, in order of how common that is.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp1251", "cp437", "cp850", "iso8859-15")
DECODE = {page: _single_byte(page) for page in PAGES}
ENCODE = {page: {c: b for b, c in reversed(table.items())} for page, table in DECODE.items()}
#: Each chain is the code pages a text was wrongly read as, one after the other.
CHAINS: tuple[tuple[str, ...], ...] = (*((p,) for p in PAGES), ("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp1252", "cp1252", "cp1252"))
#: What takes the place of bytes that could not be decoded.
LOST = "�"
# Lead bytes of UTF-8 sequences that common scripts and typographic marks begin with.
_TWO, _THREE = (*range(0xC2, 0xC6), 0xCE, 0xCF, 0xD0, 0xD1), (0xE0, 0xE1, 0xE2)


def _run(page: str) -> str:
    show = lambda codes: "".join(re.escape(DECODE[page][b]) for b in codes)
    follow = show(range(0x80, 0xC0))
    return f"(?:[{show(_TWO)}][{follow}]|[{show(_THREE)}][{follow}]{{2}})+"


RUNS = {page: re.compile(_run(page)) for page in PAGES}
_ANY = re.compile("|".join(_run(p) for p in PAGES))
_QUICK = re.compile(f"[{''.join(re.escape(DECODE[p][b]) for p in PAGES for b in (*_TWO, *_THREE))}]")


def garble(text: str, chain: Iterable[str]) -> str:
    """`text` written in UTF-8 and read in each page of the chain."""
    for page in chain:
        table = DECODE[page]
        text = "".join(map(table.__getitem__, text.encode("utf-8", "surrogatepass")))
    return text


#: Signs of garbling in a token: controls and signs of the upper half of Latin-1 but for quotation marks, symbols that no
#: word holds, the euro sign within words, letters of two scripts side by side, and low quotes within a word.
_BAD = re.compile(
    r"[\x80-\x9f\xa0¤¦¨¬\xad¯´¶¸¹²³¼½¾×÷]|(?<=[ÂÃ])[«»¿¡ªº·]|(?<![\d ])[°ªº](?![\s.,]|$)|[¢£¥](?!\d)|[§©®±µ™](?=\w)|(?<=\w)[§©®±µ]|(?<=[^\W\d])€|(?<=\w)€(?=\W)"
    r"|[Ѐ-ԯ](?=[A-Za-z\u0080-ɏ‐-⁠€])|(?<=[A-Za-zÀ-ɏ])[Ѐ-ԯ]|[Ͱ-Ͽ](?=[A-Za-z -ɏ])|(?<=[A-Za-zÀ-ɏ])[Ͱ-Ͽ]"
    r"|(?<=\w)‚(?=\w)|‚Ä[^A-Za-z\s]|Ã[ƒœŸšžŒŠŽ‐-•]|Å[“”‘’„‚…]|[ÂÃâ][€‐-•]|à[°±¤¥]|[Ѐ-ԯ][‐-›]"
    r"|[∀-⟿⤀-⯿ˆ˜†‡‰◊ﬁﬂ]|[ᄀ-ᇿ]|[0-9A-Za-zÀ-ɏ][҃-҉]"
)


def badness(token: str) -> int:
    """How many signs of garbling a token bears; correct text in any script bears none."""
    return 0 if token.isascii() else len(_BAD.findall(token))


def _decoded(token: str, page: str) -> str:
    table = ENCODE[page]

    def back(m: re.Match) -> str:
        try:
            return bytes([table[c] for c in m[0]]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return m[0]

    return RUNS[page].sub(back, token)


@functools.lru_cache(maxsize=100_000)
def _mended(token: str) -> str:
    """The token decoded in the pages that leave the fewest signs of garbling, as often as that lessens them."""
    best, signs = token, badness(token)
    for _ in range(3):
        if not signs:
            break
        tried = [(badness(x), len(x), k, x) for k, page in enumerate(PAGES) if RUNS[page].search(best) and (x := _decoded(best, page)) != best]
        # a first decoding of twofold garbling may leave as many signs in fewer characters
        tried = [t for t in tried if t[0] < signs or (t[0] <= t[1] and t[1] * 3 <= len(best) * 2)]
        if not tried:
            break
        signs, _, _, best = min(tried)
    return best if signs < badness(token) else token


_PARTS = re.compile(r"[^\x00- ]+")


def ungarbled(text: str) -> str:
    """`text` with every garbled token decoded, repeated garbling too.

    Correct text in any script with any accents comes back unchanged; so does what lost bytes.
    """
    if text.isascii() or not _QUICK.search(text) or not _BAD.search(text):
        return text
    return _PARTS.sub(lambda m: _mended(m[0]) if not m[0].isascii() and _QUICK.search(m[0]) else m[0], text)


#: Beginnings of sequences of which bytes were lost, as the common pages show them.
_BROKEN = re.compile("à[°±¤¥]|â€|вЂ|‡[∞±§•]")


def lost_bytes(token: str) -> bool:
    return LOST in token or _BROKEN.search(token) is not None


def suspicious(token: str) -> bool:
    """Whether a token bears signs of garbling and holds a run that some page shows for UTF-8, or lost bytes."""
    return lost_bytes(token) or (_QUICK.search(token) is not None and badness(token) > 0 and _ANY.search(token) is not None)


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def json_text(data: str) -> str:
    """The texts within JSON, escapes resolved; of broken JSON what stands there, with \\uXXXX resolved."""
    try:
        value = json.loads(data)
    except ValueError:
        return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), data).encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in data else data
    texts, rest = [], [value]
    while rest:
        x = rest.pop()
        rest.extend(x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())
        if isinstance(x, str):
            texts.append(x)
    return "\n".join(texts)


_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def _spelled(text: str, escaped: bool) -> str:
    """A text as it stands within a JSON string, with \\uXXXX or not."""
    return json.dumps(text, ensure_ascii=escaped)[1:-1]


def _replaced(text: str, pairs: dict[str, str]) -> str:
    """`text` with its tokens replaced, each as a whole: a token that stands within another word stays there."""

    def back(m: re.Match) -> str:
        token = m[0].strip(_EDGE)
        return m[0].replace(token, pairs[token], 1) if token in pairs else m[0]

    return _PARTS.sub(back, text)


def restored_json(data: str, pairs: dict[str, str]) -> str:
    """`data` with tokens replaced within its decoded strings; a string is written back as it was, with \\uXXXX where it had them.

    Of broken JSON the tokens are replaced as they stand there, escaped ones by escaped ones.
    """
    try:
        json.loads(data)
    except ValueError:

        def part(m: re.Match) -> str:
            plain = json_text(m[0])
            token = plain.strip(_EDGE)
            if token not in pairs:
                return m[0]
            original = _spelled(pairs[token], True) if "\\u" in m[0] else pairs[token]
            return plain.replace(token, original, 1)

        return _PARTS.sub(part, data)

    def string(m: re.Match) -> str:
        text = json.loads(m[0], strict=False)
        back = _replaced(text, pairs)
        return m[0] if back == text else f'"{_spelled(back, "\\u" in m[0])}"'

    return _STRING.sub(string, data)


_SPLIT = re.compile(r"[\x00- ]+")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens_of(text: str) -> list[str]:
    """Tokens parted by ASCII blanks (others may be garbling), without ASCII punctuation at the ends, with a non-ASCII character."""
    return [t for x in _SPLIT.split(text) if not x.isascii() and (t := x.strip(_EDGE))]


_SEEN = pa.schema([("clean", pa.bool_()), ("table_name", pa.string()), ("row_key", pa.int64()), ("field_name", pa.string()), ("token", pa.string()), ("n", pa.int64())])
#: Distinct words that a task counts before it hands their counts on.
HELD_WORDS = 500_000


def _words(fields: DataFrame) -> DataFrame:
    """Words without signs of garbling with the number (n) of fields they stand in, and suspicious tokens with their field."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter[str] = Counter()
        judged: dict[str, bool] = {}

        def filled(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, _SEEN.types)], schema=_SEEN)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out: list[tuple] = []
            for table, key, field, text in zip(*columns):
                if text.isascii() and "\\u" not in text:
                    continue
                if field == "data":
                    text = json_text(text)
                for token in set(tokens_of(text)):
                    bad = judged.get(token)
                    if bad is None:
                        bad = judged[token] = suspicious(token)
                    if bad:
                        out.append((False, table, key, field, token, 1))
                    else:
                        known[token] += 1
                if len(judged) > HELD_WORDS:
                    yield filled([(True, None, None, None, w, n) for w, n in known.items()])
                    judged.clear(), known.clear()
            yield filled(out)
        yield filled([(True, None, None, None, w, n) for w, n in known.items()])

    return fields.mapInArrow(seen, "clean boolean, table_name string, row_key bigint, field_name string, token string, n bigint")


def _holding(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table_name, row_key, field_name, token) of the fields that hold one of the wanted tokens."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t, k, f, token) for t, k, f, text in zip(*(batch.column(i).to_pylist() for i in range(4))) if not text.isascii() or "\\u" in text for token in set(tokens_of(json_text(text) if f == "data" else text))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, _SEEN.types[1:5])], names=_SEEN.names[1:5])

    return fields.mapInArrow(hold, "table_name string, row_key bigint, field_name string, token string").join(small(wanted), "token", "left_semi")


def _garbled_forms(clean: DataFrame) -> DataFrame:
    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(g, w, len(c)) for w in batch.column(0).to_pylist() for c in CHAINS if (g := garble(w, c)) != w]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["token", "original", "steps"])

    return clean.mapInArrow(forms, "token string, original string, steps int")


def _decoded_tokens(tokens: DataFrame, letters: frozenset[str]) -> DataFrame:
    """Strictly decoded tokens whose every non-ASCII character is one of `letters`."""
    share = tokens.sparkSession.sparkContext.broadcast(letters)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, out = share.value, []
            for token in batch.column(0).to_pylist():
                back = ungarbled(token)
                lost = lost_bytes(token) if back == token else lost_bytes(back)
                fits = back != token and all(c.isascii() or c in known or c == LOST or c in token for c in back)
                if fits or lost:
                    out.append((token, back if fits and not lost else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(2)], ["token", "original"])

    return tokens.mapInArrow(decode, "token string, original string")


def garbled_tokens(fields: DataFrame) -> DataFrame:
    """(table_name, row_key, field_name, token, original) of each garbled token of `fields`.

    `fields` has table_name, row_key, field_name and text; null and empty texts give nothing. `original` is null where
    bytes were lost. A word that several chains explain takes the one of fewest steps, then the smallest original.
    """
    spark = fields.sparkSession
    texts = fields.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("table_name", F.col("row_key").cast("bigint"), "field_name", "text")
    words = written(spark, _words(texts), "garbled-words")
    counted = words.filter("clean").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = words.filter("not clean").select("token").distinct()
    # a word without signs is garbled too if it is the garbled form of a word that stands in more fields
    every = counted.unionByName(tokens.select("token", F.lit(0).cast("bigint").alias("n")))
    pairs = written(spark, _garbled_forms(counted.select("token")).join(every, "token"), "garbled-pairs")
    pairs = pairs.join(counted.select(F.col("token").alias("original"), F.col("n").alias("_of")), "original").filter(F.col("_of") > F.col("n"))
    hidden = written(spark, pairs.filter("n > 0").select("token").distinct(), "garbled-hidden")
    clean = counted.select("token").join(hidden, "token", "left_anti")
    table = pairs.join(hidden.select(F.col("token").alias("original")), "original", "left_anti").groupBy("token").agg(F.min(F.struct("steps", "original")).alias("best")).select("token", "best.original")
    table = written(spark, table, "garbled-table")
    # the alphabet of the clean text: bounded by the characters of Unicode
    letters = frozenset(r[0] for r in clean.select(F.explode(F.split("token", "")).alias("c")).filter(F.col("c") > "\x7f").distinct().toLocalIterator())
    rest = _decoded_tokens(tokens.join(table, "token", "left_anti"), letters)
    held = words.filter("not clean").select("table_name", "row_key", "field_name", "token")
    if not hidden.isEmpty():
        held = held.unionByName(_holding(texts, hidden))
    return held.join(table.unionByName(rest), "token")


def garbled_fields(fields: DataFrame) -> DataFrame:
    """The distinct (table_name, row_key, field_name) of fields that hold garbled text, restorable or not."""
    return garbled_tokens(fields).select("table_name", "row_key", "field_name").distinct()


def restored_fields(fields: DataFrame) -> DataFrame:
    """`fields` with the column `restored`: the text with every garbled token replaced by its original; lost bytes stay."""

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for field, text, pairs in zip(*(batch.column(n).to_pylist() for n in ("field_name", "text", "_pairs"))):
                if pairs:
                    pairs = dict(pairs)
                    text = restored_json(text, pairs) if field == "data" else _replaced(text, pairs)
                out.append(text)
            kept = batch.select([n for n in batch.schema.names if n != "_pairs"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.string())], names=[*kept.schema.names, "restored"])

    pairs = garbled_tokens(fields).filter(F.col("original").isNotNull()).groupBy("table_name", "row_key", "field_name").agg(F.collect_set(F.array("token", "original")).alias("_pairs"))
    named = fields.select("table_name", F.col("row_key").cast("bigint").alias("row_key"), "field_name", "text")
    return named.join(pairs, ["table_name", "row_key", "field_name"], "left").mapInArrow(restore, "table_name string, row_key bigint, field_name string, text string, restored string")


def text_fields(rows: DataFrame, table_name: str, key: str, fields: list[str]) -> DataFrame:
    """(table_name, row_key, field_name, text): one row for each of the `fields` of each row."""
    each = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields]
    return rows.select(F.lit(table_name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.explode(F.array(*each)).alias("f")).select("table_name", "row_key", "f.*")
