"""Turkish-aware text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that canonical decomposition turns into an ASCII letter and marks."""
    accented, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        first, *marks = unicodedata.normalize("NFD", letter)
        if marks and first.isascii() and first.isalpha() and letter == letter.lower():
            accented.append(letter)
            plain.append(first)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _plain_letters()
#: White space as browsers understand it, which Java's class is not.
SPACE = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
_WORD_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# Suffixes behind an apostrophe.
_APOSTROPHE = "['’´`][a-zçğıöşüA-ZÇĞİÖŞÜ]{1,6}" + _WORD_EDGE
# Named character references.
ENTITIES = {
    "nbsp": "\u00A0",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "rsquo": "’",
    "lsquo": "‘",
    "ldquo": "“",
    "rdquo": "”",
    "amp": "&",
}


def lower_tr(text: Column) -> Column:
    return F.lower(F.translate(text, "İI", "iı"))


def upper_tr(text: Column) -> Column:
    return F.upper(F.translate(text, "iı", "İI"))


def fold_key(text: Column) -> Column:
    """The key under which spellings of a name meet: ASCII letters and digits, one space between."""
    bare = F.regexp_replace(F.lower(F.translate(text, "İIı", "iii")), r"[\u0300-\u036F]", "")
    return F.trim(F.regexp_replace(F.translate(bare, ACCENTED, PLAIN), "[^a-z0-9]+", " "))


def strip_apostrophe_suffix(text: Column) -> Column:
    return F.regexp_replace(text, _APOSTROPHE, "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def proper(word: Column) -> Column:
    """Whether a word starts with a Turkish capital."""
    return word.rlike("^[A-ZÇĞİÖŞÜ]")


def tokens(text: Column) -> Column:
    words = F.split(strip_apostrophe_suffix(text), "[^0-9A-Za-zÇĞİıÖŞÜçğöşü]+")
    return F.filter(words, lambda w: w != "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the greater length; 1 for equal texts, 0 where one is empty."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    part = 1 - F.levenshtein(a, b) / longest
    return F.when(a == b, 1.0).when((F.char_length(a) == 0) | (F.char_length(b) == 0), 0.0).otherwise(part)


def hyphens(text: Column) -> Column:
    return F.replace(fold_key(text), F.lit(" "), F.lit("-"))


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` by its value; names without a value stay."""
    return reduce(lambda x, pair: F.replace(x, F.lit("{%s}" % pair[0]), pair[1].cast("string")), values.items(), template)


def _numbered(text: Column, pattern: str, base: int) -> Column:
    """Numeric character references decoded: what is between them, joined by their characters."""
    between, codes = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    letter = lambda c: F.decode(F.unhex(F.lpad(F.conv(c, base, 16), 8, "0")), "UTF-32")
    tail = F.zip_with(codes, F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))), lambda c, t: F.concat(letter(c), t))
    return F.when(F.size(codes) == 0, text).otherwise(F.concat(between[0], F.array_join(tail, "")))


def decode_entities(text: Column) -> Column:
    text = _numbered(_numbered(text, "&#([0-9]+);", 10), "(?i)&#x([0-9a-f]+);", 16)
    return reduce(lambda x, e: F.regexp_replace(x, f"(?i)&{e[0]};", e[1]), ENTITIES.items(), text)


def collapse_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t\\u00A0]+", " "), f"^{SPACE}|{SPACE}$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


# What markup turns into, step by step: elements without text, ends of blocks, line breaks, other tags.
_MARKUP = (
    (r"(?is)<script.*?</script>", " "),
    (r"(?is)<style.*?</style>", " "),
    (r"(?i)</(p|div|li|tr|h[1-6])>", "\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]+>", " "),
)


def html_to_text(html: Column) -> Column:
    """Text of HTML: one line a block, scripts and styles dropped, references decoded."""
    bare = reduce(lambda text, step: F.regexp_replace(text, *step), _MARKUP, html)
    return collapse_lines(decode_entities(bare))


def sha256_prefix(text: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, length)


def article_hash(title: Column, body: Column) -> Column:
    return sha256_prefix(F.concat(title, F.char(F.lit(0)), body))


def review_fingerprint(url: Column, raw_text: Column) -> Column:
    return F.md5(F.encode(F.concat(F.coalesce(url, F.lit("")), raw_text), "UTF-8"))


def ics_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def site_url(value: Column, default: str) -> Column:
    """A configured address: a bare host gets https; what is no address falls back."""
    text = F.trim(value)
    full = F.when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    valid = full.rlike(r"(?i)^https?://[a-z0-9.-]+(:[0-9]+)?(/|$)")
    return F.when(valid, F.regexp_replace(full, "/+$", "")).otherwise(F.lit(default))


# Words of texts about interruptions: power is named, and a cut or a restoration.
_POWER = "elektrik|enerji"
_CUT = "kesinti(?!siz)|kesil(ecek|di|iyor|mi[şs]|ir)|kesme"
_RESTORED = r"gideril|yeniden\s+veril|enerji\s+veril|elektrik(ler)?\s+veril|normale\s+d[öo]n"


def about(text: Column, subject: str = _POWER, event: str = f"{_CUT}|{_RESTORED}") -> Column:
    """Whether a text names the subject and one of the events."""
    low = lower_tr(text)
    return low.rlike(subject) & low.rlike(event)


def slug_about(url: Column, pattern: str = "elektrik|elektriksiz|enerji-veril") -> Column:
    return url.rlike(f"(?i){pattern}")
