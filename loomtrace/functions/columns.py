"""Scalar functions as Column expressions, all inside the JVM but for Unicode normalization."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import HARNESS_BLOCKS, ID_NAMESPACE, INJECTED_BLOCKS, JS_SPACE, REDACTIONS
from .plain import nfkc_lower as _nfkc_lower


def trim(text: Column) -> Column:
    """White space as ECMAScript sees it, off both ends."""
    return F.regexp_replace(text, rf"\A{JS_SPACE}+|{JS_SPACE}+\z", "")


def text_or_null(text: Column) -> Column:
    return F.nullif(trim(text), F.lit(""))


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_text(text: Column) -> Column:
    return trim(line_feeds(text))


def strip_injected(text: Column) -> Column:
    """Without injected memory blocks; texts without any bracket pass untouched."""
    out = text
    for p in INJECTED_BLOCKS:
        out = F.regexp_replace(out, f"(?is){p}", "")
    return trim(F.regexp_replace(F.when(text.contains("<") | text.contains("["), out).otherwise(text), r"\n{3,}", "\n\n"))


def strip_harness(text: Column) -> Column:
    for p in HARNESS_BLOCKS:
        text = F.regexp_replace(text, f"(?is){p}", "")
    return trim(text)


def _secret_forms() -> list[tuple[str, str]]:
    """The assignment rule for double-quoted, single-quoted and bare values.

    A value that is redacted already does not match; a bare value may begin with a
    quote that nothing closes, and then shows it on both sides.  Loops take whole
    stretches of plain characters and never give back, so they need no stack, however
    long a value is.
    """
    whole = next(pattern for name, _, pattern, _, _ in REDACTIONS if name == "SECRET_ASSIGNMENT")
    name = "(?im)" + whole[: whole.index(r"(\"")]
    closed = {q: rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+{q}" for q in "\"'"}
    marked = {q: rf"{q}[^{q}\\\[]*+(?:(?:\\(?!\[REDACTED:)[\s\S]|\[(?!REDACTED:))[^{q}\\\[]*+)*+\\?\[REDACTED:" for q in "\"'"}
    forms = [(f"{name}(?!{marked[q]}){closed[q]}", f"$1$2$3$4{q}[REDACTED:SECRET]{q}") for q in "\"'"]
    bare = r"(?![^\s,;}\]#]*\[REDACTED:)"
    forms += [(f"{name}{bare}(?!{closed[q]}){q}[^\\s,;}}\\]#]*", f"$1$2$3$4{q}[REDACTED:SECRET]{q}") for q in "\"'"]
    return [*forms, (f"{name}{bare}(?![\"'])[^\\s,;}}\\]#]+", "$1$2$3$4[REDACTED:SECRET]")]


def _rule(forms: list[tuple[str, str]], hint: str) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        out = text
        for pattern, to in forms:
            out = F.regexp_replace(out, pattern, to)
        return F.when(F.rlike(text, F.lit(f"(?i){hint}")), out).otherwise(text)

    return apply


def redaction_steps(text: Column) -> list[tuple[str, Column, Column]]:
    """(rule, text before, text after) of each rule in turn; a rule runs only where its keyword stands."""
    steps, now = [], line_feeds(text)
    for name, flags, pattern, to, hint in REDACTIONS:
        forms = _secret_forms() if name == "SECRET_ASSIGNMENT" else [(f"(?{flags}){pattern}" if flags else pattern, to)]

        # bound in a lambda: each rule reads the text before it once, so the chain stays linear
        after = F.get(F.transform(F.array(now), _rule(forms, hint)), 0)
        steps.append((name, now, after))
        now = after
    return steps


def redact(text: Column) -> Column:
    return redaction_steps(text)[-1][2]


def redaction_count(text: Column) -> Column:
    """Replacements that change anything, over all rules; what is redacted already does not count again."""
    now = F.struct(line_feeds(text).alias("t"), F.lit(0).alias("n"))
    for name, flags, pattern, to, hint in REDACTIONS:
        forms = _secret_forms() if name == "SECRET_ASSIGNMENT" else [(f"(?{flags}){pattern}" if flags else pattern, to)]
        for p, s in forms:

            def step(x: Column) -> Column:
                changed = F.filter(F.regexp_extract_all(x["t"], F.lit(p), 0), lambda m: F.regexp_replace(m, p, s) != m)
                after = F.struct(F.regexp_replace(x["t"], p, s).alias("t"), (x["n"] + F.size(changed)).alias("n"))
                return F.when(F.rlike(x["t"], F.lit(f"(?i){hint}")), after).otherwise(x)

            now = F.get(F.transform(F.array(now), step), 0)
    return F.when(text.isNull(), 0).otherwise(now["n"])


def document_id(source: Column, session: Column) -> Column:
    return F.concat(F.lit("agent-session:"), source, F.lit(":"), session)


def fallback_id(source: Column, key: Column, started: Column) -> Column:
    return F.concat(F.lit("fallback-"), F.substring(F.sha2(F.concat_ws("\n", source, key, started), 256), 1, 32))


def uuid5(name: Column, namespace: str = ID_NAMESPACE) -> Column:
    """Version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def operation_id(*parts: Column) -> Column:
    return uuid5(F.concat_ws("\n", *parts))


def iso_millis(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso(value: Column, fallback: Column) -> Column:
    """ISO text of a numeric string (seconds below 1e10, else milliseconds) or of a timestamp text."""
    number = value.try_cast("double")
    millis = F.when(number < 1e10, number * 1000).otherwise(number).cast("bigint")
    return F.coalesce(F.when(number.isNotNull(), iso_millis(F.timestamp_millis(millis))), iso_millis(value.try_cast("timestamp")), fallback)


def estimate_tokens(n_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n_bytes / 4)).cast("bigint")


def estimate_cost(tokens: Column, input_price: float, output_price: float, multiplier: float = 0.25) -> Column:
    """US dollars for tokens at prices a million."""
    return tokens * (input_price / 1e6) + tokens * multiplier * (output_price / 1e6)


@F.pandas_udf(StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    """NFKC and lower case; Spark has no normalization of its own."""
    return text.map(lambda t: None if t is None else _nfkc_lower(t))


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` UTF-8 bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    parts = [F.try_validate_utf8(F.substring(cut, F.lit(1), F.length(cut) - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*parts))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many terms stand in a text, NFKC and in lower case: words as whole words, hyphenated terms anywhere.

    For candidates, of which there are a few hundred: normalization is an Arrow UDF.
    """
    text = nfkc_lower(text)
    plain, joined = [t for t in terms if "-" not in t], [t for t in terms if "-" in t]
    n = F.size(F.array_intersect(F.array_distinct(words(text)), F.array(*map(F.lit, plain)))) if plain else F.lit(0)
    for t in joined:
        n = n + text.contains(t).cast("int")
    return n


def status_of_error(message: Column) -> Column:
    return F.when(F.rlike(message, F.lit("(?i)configured limit|exceeds .* bytes")), "too_large").when(F.rlike(message, F.lit("(?i)json|malformed|unexpected token")), "malformed").otherwise("error")


def whole_count(value: Column) -> Column:
    """A finite number of at least zero, rounded down; anything else is zero."""
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")) & (value >= 0) & (value.cast("double") < float("inf")), F.floor(value)).otherwise(0).cast("bigint")


def source_key(*parts: Column) -> Column:
    return F.nullif(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), F.lit("|" * (len(parts) - 1)))


def json_line(**fields: Column) -> Column:
    """Compact JSON of the non-null fields, control characters in lower-case hex."""
    text = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    for code in [*range(0x0A, 0x10), *range(0x1A, 0x20), 0x7F]:
        if code not in (0x0A, 0x0C, 0x0D):
            text = F.replace(text, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return text

