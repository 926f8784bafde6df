"""Text functions on columns. All stay within generated code; none calls Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to search by.
STOPWORDS = ("the", "is", "at", "which", "on", "a", "an", "and", "or", "but", "in", "with", "to", "for")
# Path tokens that name no particular file.
GENERIC_PATH_TOKENS = ("src", "lib", "app", "test", "tests", "main", "index", "init", "py")


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def portable(pattern: str) -> str:
    """The pattern with word boundaries of ASCII words and lines that end by a line feed alone, as SQL's
    engine has them: to Java an accented letter is part of a word."""
    w = "[0-9A-Za-z_]"
    return "(?d)" + pattern.replace("\\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")


def tokens(text: Column) -> Column:
    """Lower-case runs of [a-z0-9_], in order, with repeats."""
    return F.filter(F.split(F.lower(blank(text)), "[^a-z0-9_]+"), lambda t: t != "")


def search_terms(text: Column, min_length: int = 3) -> Column:
    """Distinct tokens, in order, that are long enough and no stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) >= min_length) & ~F.array_contains(stop, t)))


def tokens_by_length(text: Column, per_token: float = 3.5) -> Column:
    """floor(characters / per_token), 1 at least; 0 for an empty text."""
    n = F.length(blank(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / per_token).cast("int")))


def tokens_quarter(text: Column) -> Column:
    """A quarter of the characters, rounded down; 0 is allowed."""
    return F.floor(F.length(blank(text)) / 4).cast("int")


def tokens_quarter_min1(text: Column) -> Column:
    return F.greatest(F.lit(1), tokens_quarter(text))


def tokens_quarter_or(text: Column, empty: int = 50) -> Column:
    return F.when(F.length(blank(text)) == 0, empty).otherwise(tokens_quarter_min1(text))


def stem(token: Column) -> Column:
    """ies -> y; then ing, ed, es, s go, from words long enough."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), cut(3))
        .when(token.endswith("ed") & (n > 4), cut(2))
        .when(token.endswith("es") & (n > 4), cut(2))
        .when(token.endswith("s") & (n > 3), cut(1))
        .otherwise(token)
    )


def line_count(text: Column) -> Column:
    """Lines, where a newline at the end starts no further one."""
    t = blank(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, "\n")) - F.when(t.endswith("\n"), 1).otherwise(0))


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes; leading dots and slashes go."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^[./]+", "")


def hash_text(text: Column) -> Column:
    """SHA-256 of the text with line ends as newlines."""
    return F.sha2(F.replace(blank(text), F.lit("\r\n"), F.lit("\n")), 256)


def file_id(path: Column, content_hash: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":"), content_hash), 256), 1, 16)


def chunk_id(path: Column, level: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, level, index.cast("string")), 256), 1, 24)


def identifier_tail(value: Column) -> Column:
    """What follows the last of :: : . in lower case."""
    return F.lower(F.element_at(F.split(value, "::|:|\\."), -1))


def heading_count(text: Column) -> Column:
    """Lines that are # headings, and lines under which = or - run."""
    return F.size(F.filter(F.split(blank(text), "\n"), lambda x: x.rlike("^#{1,6}[ ]+[^ ]"))) + F.size(F.filter(F.split(blank(text), "\n"), lambda x: x.rlike("^(={3,}|-{3,})[ ]*$")))


def list_density(text: Column) -> Column:
    """Share of the lines with text that are list items."""
    lines = F.filter(F.split(blank(text), "\n"), lambda x: F.trim(x) != "")
    items = F.filter(lines, lambda x: x.rlike("^[ ]*([-*+]|[0-9]+[.)])[ ]+"))
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(items) / F.size(lines))


def has_code_block(text: Column) -> Column:
    return F.when(blank(text).contains("```") | blank(text).rlike("(^|\n)    [^ ]"), 1.0).otherwise(0.0)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when((b == 0) | b.isNull(), F.lit(default)).otherwise(a / b)


def format_duration(ms: Column) -> Column:
    """ms below a second, then seconds with one digit, then minutes and seconds."""
    return (
        F.when(ms < 1000, F.concat(F.format_string("%d", F.floor(ms)), F.lit("ms")))
        .when(ms < 60000, F.concat(F.round(ms / 1000, 1).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor((ms % 60000) / 1000).cast("string"), F.lit("s")))
    )


def score_to_ten(score: Column) -> Column:
    """1..5 to 0..10."""
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), (score - 1.0) * 2.5))


def z_score(value: Column, mean: Column | float, std: Column | float, clip: float = 3.0) -> Column:
    z = (value - mean) / (std + 1e-6)
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def granularity(n_chars: Column) -> Column:
    return F.when(n_chars < 1000, "fine").when(n_chars < 3000, "medium").otherwise("coarse")
