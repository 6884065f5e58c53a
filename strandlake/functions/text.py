"""Column functions on text: tokens, citations, white space, small parsers. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no search terms, and the patterns of tokens and citations.
STOP_WORDS = tuple(
    "a an and are as at be by for from has have in is it its of on or shall that the their this to which with where what when "
    "who how do does we our us any such those these been was may must should can if not into other than".split()
)
TOKEN = "[a-z0-9]+"
CITE_GROUP = r"\[([^\[\]]*?::[^\[\]]*?)\]"
CITE_ID = r"^([a-z_]+::[A-Za-z0-9_.:-]+?)((?:\([a-z0-9]+\))*)$"
RETRY_HINT = r"(?i)retry in ([\d.]+)s"
MOST_DELAY = 60.0
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WHITE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def fold_plural(term: Column) -> Column:
    plural = (F.length(term) > 4) & F.endswith(term, F.lit("s")) & ~F.endswith(term, F.lit("ss"))
    return F.when(plural, F.left(term, F.length(term) - 1)).otherwise(term)


def tokenize(text: Column) -> Column:
    """Search terms in order: words but for stop words, plurals folded afterwards; null text has none."""
    kept = F.filter(words(F.coalesce(text, F.lit(""))), lambda t: ~t.isin(*STOP_WORDS))
    return F.transform(kept, fold_plural)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE}+", ""), f"{WHITE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{WHITE}+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{WHITE}+", " "))


def split_lines(text: Column) -> Column:
    """Lines of a text at every kind of line end; a last line end starts no line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def cite_id(token: Column) -> Column:
    """The id of a citation without its point references; what doesn't parse stays as it is, so that it is found to be unknown."""
    plain = strip(token)
    found = F.regexp_extract(plain, CITE_ID, 1)
    return F.when(found == "", plain).otherwise(found)


def cite_points(token: Column) -> Column:
    return F.regexp_extract(strip(token), CITE_ID, 2)


def cite_tokens(group: Column) -> Column:
    """The citation-shaped parts of a bracket group."""
    return F.filter(F.split(group, "[,;]"), lambda t: F.contains(t, F.lit("::")))


def citations(text: Column) -> Column:
    """Ids that a text cites, each once, in the order of first appearance."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITE_GROUP), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(cite_tokens(g), cite_id))))


def snippet(body: Column, chars: int = 140) -> Column:
    return F.concat(F.replace(F.left(body, F.lit(chars)), F.lit("\n"), F.lit(" ")), F.lit("…"))


def retry_delay(message: Column, attempt: Column) -> Column:
    """Seconds to wait: the server's hint and one more, else a growing delay of at most a minute."""
    hint = F.regexp_extract(message, RETRY_HINT, 1)
    return F.when(hint != "", F.try_add(hint.try_cast("double"), F.lit(1.0))).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(MOST_DELAY)))


def parse_list(text: Column, most: int = 6) -> Column:
    """The JSON array between the outermost brackets; if there is none, the lines without list marks, at most so many."""
    raw = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    # elements of other types come as their JSON text
    items = F.when(F.try_parse_json(raw).isNotNull() & (raw != ""), F.from_json(raw, "array<string>"))
    lines = F.filter(split_lines(text), lambda x: strip(x) != "")
    plain = F.slice(F.transform(lines, lambda x: strip(F.btrim(x, F.lit("-* ")))), 1, most)
    return F.coalesce(items, plain)


def strip_brackets(identifier: Column) -> Column:
    return F.btrim(identifier, F.lit("[] "))


def without_token(text: Column, token: str) -> Column:
    return strip(F.replace(text, F.lit(token), F.lit("")))


def route_after_human(decision: Column, revisions: Column, most: int = 2) -> Column:
    """Where a run goes: an approval or too many revisions end it."""
    done = F.startswith(F.lower(F.coalesce(decision, F.lit(""))), F.lit("approve")) | (F.coalesce(revisions, F.lit(0)) >= most)
    return F.when(done, "finalize").otherwise("revise")


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, start, step, finish)
