"""Column functions over text; all lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.constants import TRIM_CHARS


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(TRIM_CHARS))  # looks at the ends only


def dedup_key(content: Column) -> Column:
    """CRLF as LF, no blanks or tabs at line ends, trimmed; case, punctuation, indentation and lone CR stay."""
    unix = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return trimmed(F.regexp_replace(unix, "[ \\t]+(?=\\n|\\z)", ""))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` code points at steps of ``size - overlap`` up to the one that reaches the end; trimmed, blank ones dropped."""
    size, overlap = chunk_params(size, overlap)
    step = size - overlap
    # a place in a text is found by counting from its start: the text is measured once and cut into
    # stretches of as many windows as there are stretches, and these into windows
    measured = F.transform(F.array(F.struct(text.alias("text"), F.length(text).alias("n"))), lambda o: F.struct(o["text"].alias("text"), F.greatest(F.lit(1), F.ceil((o["n"] - size) / step).cast("int") + 1).alias("windows")))
    many = lambda o: F.ceil(F.sqrt(o["windows"])).cast("int")
    stretches = lambda o: F.transform(F.sequence(F.lit(0), o["windows"] - 1, many(o)), lambda first: F.struct(F.substring(o["text"], first * step + 1, many(o) * step + overlap).alias("text"), F.least(many(o), o["windows"] - first).alias("windows")))
    cut = lambda s: F.transform(F.sequence(F.lit(0), s["windows"] - 1), lambda i: trimmed(F.substring(s["text"], i * step + 1, F.lit(size))))
    chunks = F.flatten(F.transform(F.flatten(F.transform(measured, stretches)), cut))
    return F.when(F.length(text) > 0, F.filter(chunks, lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def chunk_params(size: int, overlap: int) -> tuple[int, int]:
    size = 500 if size <= 0 else size
    return size, 0 if overlap < 0 or overlap >= size else overlap


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n)) if n > 0 else F.lit("")


def paragraphs(text: Column) -> Column:
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, "\\n[\\t\\n\\f\\r ]*\\n+", -1), trimmed), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Up to the marks that end a sentence, and the rest after the last of them: split behind each run of marks, one linear pass."""
    found = F.split(text, "(?<=[。！？.!?])(?![。！？.!?])", -1)
    return F.filter(F.transform(found, trimmed), lambda s: s != "")


def escape_attribute(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_body(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def shown_name(name: Column, document_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), document_id.cast("string"))


def source_tag(ref: Column, name: Column, section: Column, page: Column, body: Column, truncated: Column | None = None) -> Column:
    """One ``<source>`` element: ref, document, section and page unless null, truncated if so."""
    parts = [
        F.lit('<source ref="'), escape_attribute(ref), F.lit('" document="'), escape_attribute(name), F.lit('"'),
        F.coalesce(F.concat(F.lit(' section="'), escape_attribute(section), F.lit('"')), F.lit("")),
        F.coalesce(F.concat(F.lit(' page="'), page.cast("string"), F.lit('"')), F.lit("")),
    ]
    if truncated is not None:
        parts.append(F.when(truncated, ' truncated="true"').otherwise(""))
    return F.concat(*parts, F.lit(">\n"), escape_body(body), F.lit("\n</source>\n"))


def citations(content: Column, allowed: Column) -> tuple[Column, Column, Column]:
    """Cleaned text, valid refs in order of first occurrence, and the number of invalid occurrences."""
    found = F.transform(F.regexp_extract_all(content, F.lit("\\[S([1-9][0-9]*)\\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n))
    allowed = F.coalesce(allowed, F.array().cast("array<string>"))
    valid = F.array_distinct(F.filter(found, lambda r: F.array_contains(allowed, r)))
    invalid = F.size(F.filter(found, lambda r: ~F.array_contains(allowed, r)))
    bar = F.array_join(F.transform(allowed, lambda r: F.substring(r, 2, 100)), "|")
    pattern = F.when(F.size(allowed) > 0, F.concat(F.lit("\\[S(?!(?:"), bar, F.lit(")\\])[1-9][0-9]*\\]"))).otherwise("\\[S[1-9][0-9]*\\]")
    return F.regexp_replace(content, pattern, F.lit("")), valid, invalid


def delta(new: Column, old: Column) -> Column:
    """``—`` without a value on either side, ``=`` if equal, else the signed difference to two places."""
    return F.when(new.isNull() | old.isNull(), "—").when(new == old, "=").otherwise(F.printf(F.lit("%+.2f"), new.cast("double") - old.cast("double")))


def ref_number(ref: Column) -> Column:
    return F.coalesce(F.substring(ref, 2, 100).try_cast("int"), F.lit(0))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def clean_attrs(strings: Column, integers: Column) -> Column:
    """JSON, by key, of a string map without empty strings and an integer map without zeros; nulls go too, ``{}`` if nothing is left."""

    def quoted(value: Column) -> Column:
        shown = F.to_json(F.array(value))
        return F.substring(shown, F.lit(2), F.length(shown) - 2)

    def pairs(values: Column, shown) -> Column:
        return F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("key"), F.concat(quoted(e["key"]), F.lit(":"), shown(e["value"])).alias("pair")))

    texts = pairs(F.map_filter(strings, lambda k, v: v.isNotNull() & (v != "")), quoted)
    numbers = pairs(F.map_filter(integers, lambda k, v: v.isNotNull() & (v != 0)), lambda v: v.cast("string"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.concat(texts, numbers)), lambda p: p["pair"]), ","), F.lit("}"))


def judge_cut(text: Column, most_bytes: int = 500) -> Column:
    """The trimmed text; of more than ``most_bytes`` bytes the first, marked as cut; a character that is cut through goes."""
    text = trimmed(text)
    data = F.encode(text, "UTF-8")
    whole = F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, most_bytes).cast("string")), "\\x{FFFD}+$", "")
    return F.when(F.octet_length(text) > most_bytes, F.concat(whole, F.lit("...(截断)"))).otherwise(text)


def case_turns(prompt: Column, turns: Column) -> Column:
    """A case's turns, or its prompt as the only one."""
    return F.when(F.size(turns) > 0, turns).otherwise(F.array(prompt))


def cursor(at: Column, key: Column) -> Column:
    """``<time in UTC>_<key>``."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z_"), key.cast("string"))


def cursor_parts(text: Column) -> tuple[Column, Column]:
    """Time and key of a cursor, split at its first ``_``; both null if it is not one."""
    parts = F.split(text, "_", 2)
    at, key = F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.get(parts, F.lit(1))
    ok = at.isNotNull() & (F.length(key) > 0)
    return F.when(ok, at), F.when(ok, key)


def encrypt(text: Column, key: Column) -> Column:
    """AES-GCM with the nonce in front."""
    return F.aes_encrypt(text, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    return F.aes_decrypt(data, key, F.lit("GCM")).cast("string")
