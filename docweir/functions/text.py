"""Text functions as Spark columns. All regular expressions are Unicode-aware: (?U) or (?u)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a name.
STOP_WORDS = [
    "và", "của", "các", "cho", "theo", "khi", "là", "có", "được", "này", "về", "một", "tại", "để", "do", "từ", "với", "hay",
    "nếu", "sẽ", "đã", "đang", "sau", "trước", "trên", "trong", "ngoài", "mà", "thì", "nên", "còn", "cả", "mọi", "những", "nào",
]
#: Fixed value: the namespace of sample ids.
SAMPLE_NAMESPACE = "5c1f3b9e7c1a4b6f9d2e8a4f6c0d1e2b"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_question(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_name(x: Column) -> Column:
    return F.lower(normalize_question(x))


def _accents() -> tuple[str, str]:
    """Letters with marks and their letters, found by decomposition."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if base != chr(code) and len(base) == 1:
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


def strip_diacritics(x: Column) -> Column:
    return F.translate(F.regexp_replace(x, r"\p{Mn}+", ""), *_accents())


def tokens(x: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))


def words(x: Column) -> Column:
    """What is between white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def token_count(x: Column) -> Column:
    return F.size(words(F.coalesce(x, F.lit(""))))


def significant_words(x: Column, least: int = 2) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words(normalize_name(x)), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w)))


def final_content(title: Column, prefix: Column, raw: Column) -> Column:
    head = strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), strip(F.coalesce(prefix, F.lit("")))))
    return strip(F.concat(head, F.lit("\n\n"), F.coalesce(raw, F.lit(""))))


def strip_fence(x: Column) -> Column:
    """A text in one code fence without the fence."""
    return strip(F.regexp_replace(strip(x), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", "$1"))


def lenient_json(x: Column, default: str | None = "{}") -> Column:
    """The text as JSON, else its part from the first brace to the last, else the default (null for
    none, as where a caller must tell an answer from no answer); as a variant."""
    found = F.coalesce(F.try_parse_json(strip_fence(x)), F.try_parse_json(F.regexp_extract(x, r"(?s)\{.*\}", 0)))
    return found if default is None else F.coalesce(found, F.parse_json(F.lit(default)))


def focus_entities(x: Column) -> Column:
    """A JSON list, or items between line feeds, semicolons and commas; trimmed, none empty."""
    listed = F.when(strip(x).startswith("["), F.from_json(x, "array<string>"))
    items = F.coalesce(listed, F.split(F.regexp_replace(x, "[;,]", "\n"), "\n"))
    return F.filter(F.transform(items, strip), lambda t: t != "")


def sample_id(question: Column, persona: Column) -> Column:
    """The version 5 UUID of the JSON list of both in the namespace of samples."""
    said = lambda c: F.coalesce(F.get_json_object(F.to_json(F.struct(c.alias("x"))), "$"), F.lit("null"))
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_extract(said(c), r'(?s)^\{"x":(.*)\}$', 1))
    name = F.concat(F.lit("["), quoted(question), F.lit(", "), quoted(persona), F.lit("]"))
    h = F.sha1(F.concat(F.unhex(F.lit(SAMPLE_NAMESPACE)), F.encode(name, "UTF-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.conv((digit % 4 + 8).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def hop_type(synthesizer: Column) -> Column:
    return F.when(synthesizer.startswith("single_hop"), "single-hop").when(synthesizer.startswith("multi_hop"), "multi-hop").otherwise("unknown")


def link_citations(answer: Column) -> Column:
    """[n] as a link to citation n, unless it is one."""
    return F.regexp_replace(answer, r"(?<!\[)\[(\d+)\](?!\()", "[$1](#citation-$1)")


def broaden(query: Column, hops: Column, note: Column) -> Column:
    """The query as it is at first; later with the note on what is missing."""
    return F.when(hops == 0, query).otherwise(F.concat(query, F.lit(" "), F.when(F.coalesce(note, F.lit("")) != "", note).otherwise("chi tiết cụ thể")))
