"""Column expressions over texts: splitting, cleaning, n-grams, JSON cells and lexicon text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence delimiters, Han characters, and the marks that token cleaning removes.
CJK_SENTENCE_MARKS = r"[，。！？；\n]"
LATIN_SENTENCE_MARKS = r"[,.!?;\n]"
HAN = r"[一-龥〇]"
TOKEN_NOISE = r"[，。！？；、\s　]"
TOKEN_SYNONYMS = {"白玉兰": "玉兰", "玉兰花": "玉兰"}
PUNCTUATION_IN_PATTERNS = r"[,.\\`|*$]"
_EDGES = r"^[\s　]+|[\s　]+$"


def strip(text: Column) -> Column:
    """Without white space at either end, the ideographic space included."""
    return F.regexp_replace(text, _EDGES, "")


def sentences(text: Column, marks: str = CJK_SENTENCE_MARKS) -> Column:
    """pieces between delimiters, stripped, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), marks), strip), lambda s: s != "")


def han(text: Column) -> Column:
    """the Han characters of a text in order."""
    return F.regexp_extract_all(text, F.lit(f"({HAN})"), F.lit(1))


def lookup(value: Column, known: dict[str, str]) -> Column:
    """A value's entry in a small map, or the value itself."""
    if not known:
        return value
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), value), value)


def clean_token(token: Column, synonyms: dict[str, str] | None = None) -> Column:
    """a token without punctuation and white space, by its preferred synonym."""
    return lookup(F.regexp_replace(token, TOKEN_NOISE, ""), TOKEN_SYNONYMS if synonyms is None else synonyms)


# Affixes that tune families share a core name without.
TUNE_PREFIXES = ("摊破", "减字", "偷声", "促拍", "添字")
TUNE_SUFFIXES = ("令", "引", "近", "慢", "犯")


def core_tune(name: Column) -> Column:
    """a tune's name without family prefixes and suffixes."""
    return F.regexp_replace(name, f"^(?:{'|'.join(TUNE_PREFIXES)})|(?:{'|'.join(TUNE_SUFFIXES)})$", "")


def rhyme_group(key: Column) -> Column:
    """平声一东 becomes 东; bracketed remarks and 韵 go."""
    bare = F.regexp_replace(key, r"[（(].*?[）)]|韵", "")
    return F.regexp_replace(bare, r"^[平上去入]声[一二三四五六七八九十百]*", "")


def char_ngrams(text: Column, n: int = 2) -> Column:
    """distinct character n-grams without white space; a shorter text is its own n-gram, an empty one has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s　]+", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(windows(bare, n)))


def windows(text: Column, n: int) -> Column:
    """All runs of n characters of a non-empty text in order, the text itself if it is shorter; linear in its length."""
    each = F.split(text, r"(?!^|\z)")
    places = F.sequence(F.lit(1), F.greatest(F.size(each) - (n - 1), F.lit(1)))
    # one element, so that the characters are split once and not at every place
    return F.flatten(F.transform(F.array(F.struct(each.alias("c"), places.alias("p"))), lambda x: F.transform(x["p"], lambda i: F.array_join(F.slice(x["c"], i, F.lit(n)), ""))))


def chars(text: Column) -> Column:
    """Distinct characters of a text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(text, r"(?!^|\z)")))


def json_list(cell: Column, synonyms: dict[str, str] | None = None) -> Column:
    """tokens of a JSON array cell, cleaned; anything else gives an empty list."""
    parsed = F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))
    tokens = F.transform(F.filter(parsed, lambda x: x.isNotNull()), lambda x: clean_token(x, synonyms))
    return F.filter(tokens, lambda x: x != "")


def error_list(cell: Column) -> Column:
    """messages of a JSON array cell, stripped; null items and blank ones are dropped."""
    parsed = F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(F.filter(parsed, lambda x: x.isNotNull()), strip), lambda x: x != "")


def llm_object(response: Column, schema: str) -> Column:
    """the object between the first and last brace of a model's answer, without its thinking."""
    said = F.regexp_replace(response, r"(?is)<think.*?</think.*?>", "")
    return F.from_json(F.regexp_extract(said, r"(?s)(\{.*\})", 1), schema)


def llm_array(response: Column, item: str) -> Column:
    """F13 (native part): an array, or an object as an array of one, with or without a code fence."""
    said = F.regexp_replace(F.regexp_replace(response, r"(?is)<think.*?</think.*?>", ""), r"```(?:json)?", "")
    whole = strip(said)
    array = F.from_json(F.when(whole.startswith("[") & whole.endswith("]"), whole), f"array<{item}>")
    single = F.when(whole.startswith("{") & whole.endswith("}"), F.array(F.from_json(whole, item)))
    return F.coalesce(array, single)


def compact_json(value: Column) -> Column:
    """F14."""
    return F.to_json(value)


def number(value: Column, otherwise: float = 0.0) -> Column:
    """a text as a number, or a default."""
    return F.coalesce(F.expr("null").cast("double") if value is None else value.try_cast("double"), F.lit(otherwise))


def fixed(value: Column, digits: int = 4) -> Column:
    """a number with so many decimals, as text."""
    return F.format_string(f"%.{digits}f", value)


def ranked_string(items: Column) -> Column:
    """name:count entries of an array of (name, n) structs, joined by |."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), "|")


_ZH = "一二三四五六七八九"


def zh_number(text: Column) -> Column:
    """a Chinese numeral below 200 as a number."""
    digit = lambda c: F.instr(F.lit(_ZH), c)
    rest = F.regexp_replace(text, "^一?百零?", "")
    tens = F.when(rest.contains("十"), F.when(rest.startswith("十"), 1).otherwise(digit(F.substring(rest, 1, 1)))).otherwise(0)
    last = F.regexp_extract(rest, f"([{_ZH}])$", 1)
    units = F.when(last == "", 0).otherwise(digit(last))
    return F.when(text.contains("百"), 100).otherwise(0) + tens * 10 + units


def expected_length(mode: Column, brief: Column) -> Column:
    """the number of characters that a tune's mode or brief names, null if neither does."""
    wanted = "([一二三四五六七八九十百零]+)字"
    found = F.coalesce(F.nullif(F.regexp_extract(mode, wanted, 1), F.lit("")), F.nullif(F.regexp_extract(brief, wanted, 1), F.lit("")))
    return F.when(found.isNotNull(), zh_number(found))


def slot_count(sketch: Column) -> Column:
    """slots of a pattern, punctuation aside."""
    return F.length(F.regexp_replace(sketch, PUNCTUATION_IN_PATTERNS, ""))


def repair_pattern(sketch: Column, expected: Column) -> Column:
    """a digit pattern with 24 and 13 read as one slot, kept only where its length then is the expected one or twice it."""
    fixed_pattern = F.replace(F.replace(sketch, F.lit("24"), F.lit("4")), F.lit("13"), F.lit("3"))
    now, was = slot_count(fixed_pattern), slot_count(sketch)
    fits = (now == expected) | (now == expected * 2)
    return F.when((was != expected) & fits, fixed_pattern).otherwise(sketch)


def merged_characters(left: Column, right: Column) -> Column:
    """distinct Han characters of two texts in order."""
    return F.array_join(F.array_distinct(F.concat(han(F.coalesce(left, F.lit(""))), han(F.coalesce(right, F.lit(""))))), "")


# Entities that HTML escaping uses.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def html_escape(text: Column) -> Column:
    """F25."""
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def slug(text: Column) -> Column:
    """lower case, words and Han characters joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def normal_text(text: Column) -> Column:
    """markup and runs of white space out."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def fill_prompt(template: Column, pool: Column, theme: Column, key: Column) -> Column:
    """{cipai} by a hash-picked name of the pool and {theme} by the theme."""
    picked = F.element_at(pool, (F.pmod(F.xxhash64(key), F.size(pool)) + 1).cast("int"))
    return F.replace(F.replace(template, F.lit("{cipai}"), F.coalesce(picked, F.lit(""))), F.lit("{theme}"), F.coalesce(theme, F.lit("")))


def splice(text: Column, first: str, after: str, new: str) -> Column:
    """A text with its lines from the one that begins with `first` up to the next that begins with `after` replaced; as it is without both."""
    lines = F.split(text, "\n")
    begin = F.array_position(F.transform(lines, lambda x: x.startswith(first)), True)
    rest = F.slice(lines, F.greatest(begin, F.lit(1)).cast("int"), F.size(lines))
    length = F.array_position(F.transform(rest, lambda x: x.startswith(after)), True) - 1
    joined = F.array_join(F.concat(F.slice(lines, F.lit(1), (F.greatest(begin, F.lit(1)) - 1).cast("int")), F.array(F.lit(new)), F.slice(rest, (F.greatest(length, F.lit(0)) + 1).cast("int"), F.size(lines))), "\n")
    return F.when((begin > 0) & (length >= 0), joined).otherwise(text)


def rename_headings(text: Column, names: dict[str, str]) -> Column:
    """A Markdown text whose headings of these names (without their marks) have others."""
    renamed = F.transform(F.split(text, "\n"), lambda x: F.concat(F.regexp_extract(x, "^(#+ +)?", 0), F.when(x.startswith("#"), lookup(F.regexp_replace(x, "^#+ +", ""), names)).otherwise(x)))
    return F.array_join(renamed, "\n")
