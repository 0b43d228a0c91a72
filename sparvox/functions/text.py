"""Text clean-up and tokenisation as Column expressions, in code generated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPENERS, CLOSERS = "⁽₍❨❪⟮⦅⸨⹙⹛﴿︵﹙（｟", "⁾₎❩❫⟯⦆⸩⹚⹜﴾︶﹚）｠"
SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"^ | $", "")


def punctuation_to_spaces(text: Column) -> Column:
    """Punctuation and symbols become spaces, marks stay; by the JVM's Unicode tables."""
    return collapse(F.regexp_replace(text, r"[\p{P}\p{S}]+", " "))


def strip_tags(text: Column) -> Column:
    """Without [...] of up to 80 characters and <...> of up to 120; what tags enclose stays."""
    no_square = F.regexp_replace(text, r"\[[^\[\]]{0,80}\]", " ")
    return collapse(F.regexp_replace(no_square, r"</?[^<>]{0,120}>", " "))


def strip_annotations(text: Column) -> Column:
    """Without {...} that hold a letter, other braces unwrapped, then without tags."""
    dropped = F.regexp_replace(text, r"\{(?=[^{}]*\p{L})[^{}]{0,200}\}", " ")
    return strip_tags(F.regexp_replace(dropped, r"\{([^{}]{0,200})\}", " $1 "))


def strip_parentheses(text: Column) -> Column:
    """Without (...), however deeply nested: as many passes as the text nests them; escapes of spaces and joiners decoded, Unicode parentheses as ASCII ones."""
    for code in ("200c", "200d", "00a0", "3000"):
        text = F.regexp_replace(text, rf"(?i)\\+u{code}", chr(int(code, 16)))
    text = F.translate(text, OPENERS + CLOSERS, "(" * len(OPENERS) + ")" * len(CLOSERS))

    def passes(t: Column) -> Column:
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

        def step(a: Column, mark: Column) -> Column:
            now = F.greatest(F.lit(0), a["now"] + F.when(mark == "(", 1).otherwise(-1))
            return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

        depth = F.aggregate(F.regexp_extract_all(t, F.lit("[()]"), F.lit(0)), start, step, lambda a: a["most"])
        inner = lambda x, _: F.regexp_replace(x, r"\([^()]*\)", " ")
        return F.aggregate(F.slice(F.sequence(F.lit(0), depth), 1, depth), t, inner)

    stripped = F.element_at(F.transform(F.array(text), lambda t: F.when(t.contains("("), passes(t)).otherwise(t)), 1)
    return F.translate(stripped, "()", "  ")


def tokens(text: Column, metric: str | Column) -> Column:
    """Units of the metric: code points that aren't white space for cer, else what white space separates."""
    chars = F.array_remove(F.split(F.regexp_replace(text, SPACE, ""), ""), "")
    split = F.array_remove(F.split(text, SPACE), "")
    if isinstance(metric, str):
        return chars if metric == "cer" else split
    return F.when(metric == "cer", chars).otherwise(split)


def redact(message: Column) -> Column:
    """An error message without what looks like a credential."""
    for pattern, put in REDACTIONS:
        message = F.regexp_replace(message, pattern, put)
    return message


#: Token shapes, then values that follow a credential's name. Valid for Java and DuckDB (RE2).
REDACTIONS = (
    (r"(?:sk|hf|xai|pk|rk)[-_][A-Za-z0-9_\-]{8,}", "[redacted]"),
    (r"AIza[0-9A-Za-z_\-]{20,}", "[redacted]"),
    (r"(?i)(bearer|token)\s+[A-Za-z0-9._~+/=\-]{8,}", "$1 [redacted]"),
    (r"(?i)((?:api[_-]?key|token|secret|password|authorization)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;&]+", "$1[redacted]"),
)


def pair_letters(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Both token arrays as strings with one character for each distinct token, so that levenshtein counts tokens.

    Characters come from U+0100 on, past the surrogates from the 55,040th token of a pair on.
    """
    vocabulary = F.array_distinct(F.concat(reference, hypothesis))

    def spelled(words: Column) -> Column:
        def letter(word: Column) -> Column:
            place = F.array_position(vocabulary, word) + 255
            code = F.when(place < 0xD800, place).otherwise(place + 0x800)
            return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

        return F.array_join(F.transform(words, letter), "")

    return spelled(reference), spelled(hypothesis)


def token_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of token arrays."""
    return F.levenshtein(*pair_letters(reference, hypothesis)).cast("long")


def rate(numerator: Column, denominator: Column) -> Column:
    """Errors over length; without any length 0, or 1 if there are errors."""
    return F.when(denominator != 0, numerator / denominator).when(numerator == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def shard_of(identity: Column, channel: Column, shards: int) -> Column:
    """The task's shard: the first 8 bytes of sha256(id, NUL, channel) as a big-endian number, modulo shards."""
    digest = F.sha2(F.concat(identity, F.decode(F.unhex(F.lit("00")), "UTF-8"), channel), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(shards)).cast("int")


def ids_digest(ids: Column) -> Column:
    """sha256 of the sorted ids as a compact JSON array (ASCII ids)."""
    return F.sha2(F.to_json(F.array_sort(ids)), 256)
