"""Text columns: code-aware tokens, token counts, lines, identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word of code, and where an identifier is cut.
CODE_WORD = r"[A-Za-z][A-Za-z0-9_]*|\p{Nd}+"
IDENTIFIER_CUT = r"_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
CHUNK_TOKEN = r"(?U)\w+|[^\w\s]"
#: Characters that ``str.split`` takes for white space.
WHITE = "\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def code_tokens(text: Column | str) -> Column:
    """Lower-case tokens of code-aware tokenisation: words, cut at underscores and camel-case humps; null gives none.

    The words are joined by spaces first, so that cutting and lower-casing are one pass over a string, not one per word.
    """
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CODE_WORD), F.lit(0))
    cut = F.regexp_replace(F.array_join(words, " "), IDENTIFIER_CUT, " ")
    return F.array_remove(F.split(F.lower(cut), " "), "")


def normalized_identifier(name: Column | str) -> Column:
    return F.array_join(code_tokens(name), "")


def identifier_forms(name: Column) -> Column:
    """The normalised forms under which a name is matched exactly: whole, and after its last ``:`` or ``.``."""
    short = F.element_at(F.split(name, r"[:.]"), -1)
    return F.array(normalized_identifier(name), normalized_identifier(short))


def word_estimate(text: Column | str) -> Column:
    """White-space separated words, the token estimate of context budgets."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE}]+"), lambda w: w != ""))


def chunk_token_count(text: Column | str) -> Column:
    """Words and single punctuation marks (Unicode), the token count of chunk budgets."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK_TOKEN), F.lit(0)))


def lines_of(text: Column | str) -> Column:
    """Lines as ``str.splitlines`` gives them for \\n-, \\r- and \\r\\n-separated text: no empty line after a last break."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\r\n|\n|\r)\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\r\n|\n|\r"))


def newline_lines(text: Column | str) -> Column:
    """Lines cut at \\n only, without an empty one after a last \\n; an empty text is one empty line, null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def ascii_words(text: Column | str) -> Column:
    """Number of words between ASCII white space, as RE2's ``\\s`` has it (no vertical tab)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\t\n\f\r ]+"), lambda w: w != ""))


def module_name(path: Column | str) -> Column:
    """Dotted module of a file path: last suffix and a trailing ``__init__`` go."""
    path = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(path, r"(?<=[^/.])\.[^/.]*$", "")
    bare = F.regexp_replace(bare, r"(^|/)__init__$", "")
    return F.translate(bare, "/", ".")


def qualified_name(kind: Column, module: Column, name: Column) -> Column:
    return F.when(kind == "import", F.concat(module, F.lit("::<import>"), name)).otherwise(F.concat(module, F.lit("."), name))


def short_name(kind: Column, name: Column) -> Column:
    return F.when(kind == "method", F.element_at(F.split(name, r"\."), -1)).otherwise(name)


def code_cache_key(model: str, code: Column) -> Column:
    return F.concat(F.lit(model + ":"), F.sha2(code, 256))


def doc_cache_key(model: str, parent: Column, kind: Column, path: Column, text: Column) -> Column:
    return F.concat(F.lit(model + ":doc:"), F.sha2(F.concat(parent, F.lit("\n"), kind, F.lit("\n"), F.coalesce(path, F.lit("")), F.lit("\n"), text), 256))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))
