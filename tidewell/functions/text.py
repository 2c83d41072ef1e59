"""Text cleaning as column expressions, in the JVM but for HTML entities. A null text stays null."""

import hashlib
import html
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@cache
def emoji_class() -> str:
    """A character class of pictographs, emoji shown as such, skin tones and the variation selector, from the Unicode properties that the `regex` package knows."""
    hit = regex.compile(r"\p{Extended_Pictographic}|\p{Emoji_Presentation}|\p{Emoji_Modifier}|\uFE0F").match
    points = [i for i in range(0x80, 0x20000) if hit(chr(i))]

    def ranges(gap: int) -> str:
        runs = [[points[0], points[0]]]
        for i in points[1:]:
            if i <= runs[-1][1] + gap:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"

    # A few wide ranges first: most characters are in none of them, and the many narrow ones are slow.
    return f"(?={ranges(0x1000)}){ranges(1)}"


URL = r"(?i)(?:https?|ftp)://\S+"
# Fixed capital words that are tickers and words alike.
AMBIGUOUS = ("ON", "IT", "OR", "IN", "AS", "AT", "AN", "BE", "BY", "US", "WE")
# Fixed forms of explicit tickers.
DOLLAR = r"(?<![A-Za-z0-9_])\$([A-Za-z]{1,6})(?![A-Za-z0-9_])"
DOLLAR_UPPER = r"(?<![A-Za-z0-9_])\$([A-Z]{1,6})(?![A-Za-z0-9_])"
EXCHANGE = r"(?i)\b(?:NASDAQ|NYSE|AMEX)\s*:\s*([A-Za-z]{1,6})\b"
PARENTHESES = r"\(([A-Z]{1,6})\)"
CAPITALS = r"\b[A-Z]{2,6}\b"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def unescape_html(c: Column) -> Column:
    """Named, decimal and hexadecimal entities, each once and none twice, as the standard library has them. Spark has no such table, so texts with a `&` go to Python in Arrow batches; others stay in the JVM."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.coalesce(run(F.when(F.contains(c, F.lit("&")), c)), c)


# Fixed: what the bytes 80 to 9F show when read as Windows-1252, and those bytes as code points.
SHOWN, MEANT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ", "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))
# Fixed stop words by which languages are told apart.
STOP_WORDS = {"de": "der die das und ist nicht ein eine zu mit von den".split(), "en": "the of and to in that is for it with as was".split(), "es": "el los las que y en una para con por del se".split(), "fr": "le les des et une que dans est pour qui du au".split()}


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, undone once: only where every character is a byte and the bytes are valid UTF-8 with more than ASCII."""
    narrow = F.translate(c, SHOWN, MEANT)
    fits = narrow.rlike(r"^[\x00-\xFF]*$") & narrow.rlike(r"[\xC2-\xF4][\x80-\xBF]")
    again = F.when(fits, F.encode(F.when(fits, narrow), "ISO-8859-1").cast("string"))
    return F.when(fits & F.is_valid_utf8(again), again).otherwise(c)


def one_of(values: list[str]):
    return lambda w: w.isin(values)


def guess_language(c: Column) -> Column:
    """lang and share: the language with most stop words (first in order of names on ties), and its share of the stop words found; `unknown` and 0 without any."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    n = {k: F.size(F.filter(words, one_of(v))) for k, v in STOP_WORDS.items()}
    best = F.greatest(*n.values())
    total = sum(list(n.values())[1:], list(n.values())[0])
    lang = F.coalesce(*[F.when(best == x, F.lit(k)) for k, x in n.items()])
    none = c.isNull() | (best <= 0)
    return F.struct(F.when(none, "unknown").otherwise(lang).alias("lang"), F.when(none, F.lit(0.0)).otherwise(best / total).alias("share"))


def strip_html(c: Column) -> Column:
    """Entities undone, then tags replaced by a blank."""
    return _sub(unescape_html(c), "<[^>]+>", " ")


def remove_control(c: Column, compat: bool = False) -> Column:
    """Control and format characters but newline and tab. compat: the behaviour of a pattern whose set intersection is read literally."""
    return _sub(c, r"[\p{C}&\[^\n\t]\]+" if compat else r"[\p{C}&&[^\n\t]]+", "")


def collapse_space(c: Column) -> Column:
    return F.trim(_sub(c, r"(?U)\s+", " "))


def domain(url: Column) -> Column:
    """Registered domain of a URL by its last two labels (three below a two-letter code with a short label before it)."""
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://(?:[^/@\s]*@)?([^/:?#\s]+)", 1))
    short = F.regexp_extract(host, r"([^.]+\.(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})$", 1)
    two = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(short != "", short).when(two != "", two).otherwise(host)


def replace_urls(c: Column, mode: str = "token") -> Column:
    """token: URL; domain_token: EXAMPLE.COM_TOKEN; domain_visible: [example.com]; keep. Domains as `domain` has them."""
    if mode == "keep":
        return c
    if mode == "token":
        return _sub(c, URL, "URL")
    shape = {"domain_token": lambda d: F.concat(F.upper(d), F.lit("_TOKEN")), "domain_visible": lambda d: F.concat(F.lit("["), d, F.lit("]"))}[mode]
    # What stands between URLs, and the URLs, in turn.
    between, urls = F.split(c, URL), F.regexp_extract_all(c, F.lit(URL), F.lit(0))
    return F.array_join(F.zip_with(between, urls, lambda t, u: F.concat(t, F.coalesce(shape(domain(u)), F.lit("")))), "")


def replace_mentions(c: Column, mode: str = "token") -> Column:
    return c if mode == "keep" else _sub(c, r"@\w+", "@USER" if mode == "token" else "")


def strip_emoji(c: Column) -> Column:
    """Pictographs and what belongs to them; the digit of a keycap stays."""
    return _sub(_sub(c, r"([0-9])\x{FE0F}?\x{20E3}", "$1"), emoji_class(), "")


def limit_punctuation(c: Column, most: int = 3) -> Column:
    return _sub(c, rf"([!?.,;:])\1{{{most},}}", "$1" * most)


def limit_elongation(c: Column, most: int = 3) -> Column:
    return _sub(c, rf"(.)\1{{{most},}}", "$1" * most)


def clean(c: Column, urls: str, emoji: str) -> Column:
    """Charset, HTML, control characters, blanks, URLs, mentions and emoji (`strip` or `keep`), in this order. For tables: `cleaned`."""
    c = replace_mentions(replace_urls(collapse_space(remove_control(strip_html(repair_mojibake(c)))), urls))
    return strip_emoji(c) if emoji == "strip" else c


def cleaned(df: DataFrame, column: str, **forms: tuple[str, str]) -> DataFrame:
    """df with a column for each form (its URLs and emoji as for `clean`). What the forms share is made once, and each step is a column of its own, so that no text is made again for every place that an expression names it."""
    at = "__cleaned"
    df = df.withColumn(at, repair_mojibake(F.col(column)))
    for step in (unescape_html, lambda c: _sub(c, "<[^>]+>", " "), remove_control, collapse_space):
        df = df.withColumn(at, step(F.col(at)))
    for name, (urls, emoji) in forms.items():
        c = replace_mentions(replace_urls(F.col(at), urls))
        df = df.withColumn(name, strip_emoji(c) if emoji == "strip" else c)
    return df.drop(at)


def clean_for_models(c: Column) -> Column:
    """URLs as a bare token, no emoji."""
    return clean(c, "token", "strip")


def clean_for_reading(c: Column) -> Column:
    """URLs as a token of their domain, emoji kept."""
    return clean(c, "domain_token", "keep")


def combine(*parts: Column) -> Column:
    """Non-blank parts joined by ` - `."""
    return F.concat_ws(" - ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def blake2b(c: Column, size: int = 20) -> Column:
    """BLAKE2b of the trimmed text as hex, for tables that hold such hashes already: Spark has none, so Arrow batches go through Python. 20 bytes for cleaned texts, 16 for scored ones."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.blake2b((t or "").strip().encode(), digest_size=size).hexdigest())

    return run(c)


def content_hash(c: Column) -> Column:
    """Identity of the trimmed text, in the JVM."""
    return F.sha2(F.trim(F.coalesce(c, F.lit(""))), 256)


def tickers(c: Column, universe: list[str] | None, aliases: dict[str, str] | None = None, bare: bool = True, ambiguous: tuple[str, ...] = AMBIGUOUS) -> Column:
    """Sorted distinct symbols: $X, EXCHANGE:X and (X) as explicit, capital words as bare, alias phrases. Without a universe nothing is checked against it and bare words do not count."""
    take = lambda pattern: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.upper)
    found = F.array_union(F.array_union(take(DOLLAR), take(EXCHANGE)), take(PARENTHESES))
    for phrase, symbol in (aliases or {}).items():
        found = F.array_union(found, F.when(F.lower(c).rlike(rf"\b\Q{phrase.lower()}\E\b"), F.array(F.lit(symbol))).otherwise(F.array().cast("array<string>")))
    if universe:
        known = F.array(*[F.lit(u) for u in universe])
        found = F.array_intersect(found, known)
        if bare:
            words = F.array_except(F.regexp_extract_all(c, F.lit(CAPITALS), F.lit(0)), F.array(*[F.lit(a) for a in ambiguous]))
            found = F.array_union(found, F.array_intersect(words, known))
    return F.array_sort(found)


def explicit_tickers(c: Column, most: int = 10) -> Column:
    """$X in order of appearance, each once."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(DOLLAR_UPPER), F.lit(1))), 1, most)


def shorten(c: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def all_in(evidence: Column, text: Column) -> Column:
    """Whether every piece of evidence stands in the text."""
    return F.forall(evidence, lambda e: F.contains(text, e))
