"""Column expressions over raw text. Everything here is map-only: no shuffle, no Python per row.

Declared rules
* word: a run of letters; token: a run of letters, a run of digits, or one other visible character.
* sentence: ends after ``.``, ``!`` or ``?`` followed by white space, or at a line break; blank pieces are dropped.
* syllable: one per group of vowels, at least one per word.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import lexicons

WORD = r"\p{L}+"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
TOKEN_WITH_SPACE = rf"(?:{TOKEN})\s*"
SENTENCE_END = r"([.!?]\s+|\s*\n\s*)"
SENTENCE_MARK = "\u001e"
VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýÿ"
BLANKS = " \t\n\r\f\u000b"
# The characters Unicode-aware stripping removes.
UNICODE_BLANKS = BLANKS + "\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B))


def starts_with_letter(text: Column) -> Column:
    """Is the first character a letter? Texts compare by bytes, so two bounds settle most of them without a pattern."""
    return (text >= "A") & (text < "[") | (text >= "a") & (text < "{") | F.substring(text, 1, 1).rlike(r"\p{L}")


def starts_with_capital(text: Column) -> Column:
    return (text >= "A") & (text < "[") | (text >= "\u0080") & F.substring(text, 1, 1).rlike(r"\p{Lu}")


def words(text: Column) -> Column:
    """Lower-cased words of the text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def raw_sentences(text: Column) -> Column:
    """Sentence pieces that concatenate back to the text without its leading white space."""
    body = F.regexp_replace(text, r"^\s+", "")
    marked = F.regexp_replace(body, SENTENCE_END, "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s.rlike(r"\S"))


def sentences(text: Column) -> Column:
    """Trimmed sentences."""
    return F.transform(raw_sentences(text), lambda s: F.rtrim(s, F.lit(BLANKS)))


def word_count(text: Column) -> Column:
    """Number of runs of visible characters (Unicode aware)."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(UNICODE_BLANKS))


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower(word), F.lit(f"[{VOWELS}]+"), F.lit(0))))


def is_stop(lang: Column, word: Column) -> Column:
    """Membership of a lower-cased word in the default stop list of its language (hashed set, no join)."""
    test = F.lit(False)
    for code in sorted(lexicons.FUNCTION_WORDS):
        test = test | ((lang == code) & word.isin(*lexicons.stop_words(code)))
    return F.coalesce(test, F.lit(False))


def lemma(lang: Column, word: Column) -> Column:
    """Dictionary form of a lower-cased word, the word itself when none is listed.

    The hashed membership test guards the map look-up, which scans the listed pairs.
    """
    pairs = lexicons.lemma_pairs()
    table = F.create_map(*[F.lit(x) for code, form, base in pairs for x in (f"{code}:{form}", base)])
    listed = word.isin(*sorted({form for _, form, _ in pairs}))
    found = F.try_element_at(table, F.concat(F.coalesce(lang, F.lit("")), F.lit(":"), word))
    return F.when(listed, F.coalesce(found, word)).otherwise(word)


def normalize_lang(code: Column) -> Column:
    """Two-letter lower-case language code; anything that cannot be folded becomes ``en``."""
    compact = F.lower(F.regexp_replace(F.coalesce(code, F.lit("")), " ", ""))
    base = F.split(F.regexp_replace(compact, "_", "-"), "-")[0]
    folded = base
    for three, two in lexicons.THREE_LETTER_CODES.items():
        folded = F.when(base == three, two).otherwise(folded)
    return F.when(F.length(folded) == 2, folded).otherwise(F.lit("en"))


def _markup(loop: str) -> dict[str, str]:
    """Patterns of a page's parts. ``loop`` repeats the attributes of a tag; the possessive form, which never comes back, runs in constant stack."""
    # A quote only opens a value right behind an equals sign, and a greater-than sign in a quoted value does not end the tag.
    attributes = rf"""[^>=]*(?:=\s*(?:"[^"]*"|'[^']*'|)[^>=]*){loop}"""
    # An element whose content is no markup goes up to its end tag or to the end of the page.
    raw = [rf"<{n}(?:[\s/]{attributes})?(?:>|\z).*?(?:</{n}(?:[\s/]{attributes})?(?:>|\z)|\z)" for n in ("script", "style", "noscript")]
    hidden = "|".join([r"<!--(?:-?>|.*?(?:--!?>|\z))", *raw])
    return {"hidden": f"(?is)(?:{hidden})", "all": rf"(?is)(?:{hidden}|</?[a-z]{attributes}(?:>|\z)|<[!?/][^>]*(?:>|\z))",
            "title": rf"(?is)<title(?:[\s/]{attributes})?>(.*?)(?:</title|\z)"}


#: Parts of a page that hold no text (comments, script, style and noscript, also where they are never closed); all markup, with tags, declarations and
#: processing instructions, where a less-than sign before anything else is text; the title element.
HIDDEN, MARKUP, TITLE = _markup("*+").values()
#: Runs of white space, Unicode's included.
BLANK_RUN = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: Named character references of HTML with their text, from the standard library; a name without a semicolon is one that may lack it.
NAMED_REFERENCES = html.entities.html5
#: A name at the start of a longer word, the longest one first.
OPEN_NAME = "^&(" + "|".join(sorted((n for n in NAMED_REFERENCES if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")(.*)$"
#: Numbers 128 to 159 stand for what Windows has there, if anything.
WINDOWS_CODES = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def code_point(n: Column) -> Column:
    """Text of a numeric character reference: replacement character for impossible numbers, nothing for controls and non-characters."""
    hidden = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 0xFFFE)
    windows = F.from_json(F.lit(json.dumps({str(k): v for k, v in WINDOWS_CODES.items()})), "map<string,string>")
    return (F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.isin(*WINDOWS_CODES), F.try_element_at(windows, n.cast("string"))).when(hidden, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def decode_references(text: Column) -> Column:
    """Replace all character references: named ones of HTML (of those that may lack the semicolon also at the start of a word), decimal and hexadecimal."""
    table = F.from_json(F.lit(json.dumps(NAMED_REFERENCES)), "map<string,string>")

    def one(ref: Column) -> Column:
        name = F.substr(ref, F.lit(2))
        digits, hexa = F.regexp_extract(ref, "^&#([0-9]+)", 1), F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]+)", 1)
        number = F.when(digits != "", digits.try_cast("bigint")).when(F.length(hexa) <= 8, F.conv(hexa, 16, 10).try_cast("bigint"))
        begun = F.try_element_at(table, F.regexp_extract(ref, OPEN_NAME, 1))
        return (F.when(ref == "&amp;", "&").when(ref == "&lt;", "<").when(ref == "&gt;", ">").when(ref == "&quot;", '"').when(ref == "&nbsp;", "\u00a0")
                .when(ref.startswith("&#"), code_point(number))
                .otherwise(F.coalesce(F.try_element_at(table, name), F.concat(begun, F.regexp_extract(ref, OPEN_NAME, 2)), ref)))

    refs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one)
    pieces = F.zip_with(F.split(text, REFERENCE, -1), refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text of a page: markup and hidden parts become blanks, references are decoded, runs of white space become one blank."""
    return F.trim(F.regexp_replace(decode_references(F.regexp_replace(html, MARKUP, " ")), BLANK_RUN, " "))


def page_title(html: Column) -> Column:
    """Stripped text of the first title element outside of hidden parts; ``Untitled`` when the page has none."""
    seen = F.regexp_replace(html, HIDDEN, " ")
    return F.when(seen.rlike(TITLE), strip(decode_references(F.regexp_extract(seen, TITLE, 1)))).otherwise(F.lit("Untitled"))


def url_domain(url: Column) -> Column:
    """Network location of a URL (with port and user part); empty when there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path and query of a URL, ``/`` when empty."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def slug(text: Column) -> Column:
    safe = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_-]", "-")
    safe = F.regexp_replace(safe, r"^-+|-+$", "")
    return F.when(safe == "", "output").otherwise(safe)


def output_key(url: Column, row_id: Column) -> Column:
    """Collision-free output name: host without ``www.`` as a slug, then the row id."""
    host = url_domain(url)
    host = F.when(host == "", "url").otherwise(host)
    return F.concat_ws("_", slug(F.replace(host, F.lit("www."), F.lit(""))), row_id.cast("string"))


def language_csv(csv: Column) -> Column:
    """Distinct language codes of a comma list, first occurrence first."""
    parts = F.filter(F.split(csv, ","), lambda c: F.trim(c) != "")
    return F.array_distinct(F.transform(parts, lambda c: normalize_lang(F.trim(c))))


def redact(text: Column, secret: Column) -> Column:
    """Replace a known key wherever it occurs."""
    return F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("***REDACTED***"))).otherwise(text)


def embedded_json(text: Column, marker: str) -> Column:
    """JSON object inside noisy output, as text; null when there is none.

    Starts at the brace before ``marker`` (at the first brace when the marker is absent) and ends at the last
    closing brace.
    """
    has_marker = F.contains(text, F.lit(marker))
    head = F.substring_index(text, marker, 1)
    before = F.length(head) - F.length(F.substring_index(head, "{", -1))
    first = F.instr(text, "{")
    start = F.when(has_marker & (before > 0), before).otherwise(first)
    end = F.length(text) - F.length(F.substring_index(text, "}", -1))
    found = (start > 0) & (end > start)
    cut = F.substr(text, start.cast("int"), (end - start + 1).cast("int"))
    return F.when(found & F.try_parse_json(cut).isNotNull(), cut)


def conllu_field(value: Column) -> Column:
    """CoNLL-U cell: blank becomes ``_``, tabs and line breaks become spaces."""
    value = F.coalesce(value, F.lit(""))
    last = F.substring(value, -1, 1)
    visible = (value >= "!") & (value < "\x7f") & (last >= "!") & (last < "\x7f")  # nothing to strip at either end
    text = F.when(visible, value).otherwise(strip(value))
    broken = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))  # a translation looks up every character
    return F.when(text == "", "_").when(broken, F.translate(text, "\t\n\r", "   ")).otherwise(text)


def conllu_feats(morph: Column) -> Column:
    """FEATS cell: pairs with ``=``, without the two punctuation features; ``_`` when empty."""
    pairs = F.filter(
        F.split(F.btrim(morph, F.lit("{}")), r"\|"),
        lambda p: F.contains(p, F.lit("=")) & ~F.substring_index(p, "=", 1).isin("PunctType", "PunctSide"))
    return F.when(F.coalesce(morph, F.lit("")) == "", "_").otherwise(F.regexp_replace(F.array_join(pairs, "|"), "^$", "_"))


def sort_feats(line: Column) -> Column:
    """Sort the feature pairs of a finished 10-column line, ignoring case; other lines pass unchanged."""
    cells = F.split(line, "\t", -1)
    pairs = F.transform(F.split(cells[5], r"\|"), lambda p, i: F.struct(F.lower(p).alias("k"), i.alias("i"), p.alias("p")))
    by_name = F.array_sort(pairs)  # equal names keep their order
    feats = F.array_join(F.transform(by_name, lambda s: s["p"]), "|")
    fixed = F.concat_ws("\t", F.slice(cells, 1, 5), feats, F.slice(cells, 7, 4))
    row = ~F.startswith(line, F.lit("#")) & line.rlike(r"\S") & (F.size(cells) == 10)
    # A line without a bar has one pair at most; it is settled before anything is cut.
    return F.when(~F.contains(line, F.lit("|")), line).when(row, fixed).otherwise(line)
