"""String expressions: Unicode trim, key parts, labels, violation paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points which count as white space (Spark's own trim only knows U+0020).
SPACE_CLASS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACES = "\t\n\x0B\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
FOUR_PARTS = r"^[^|]*[^|S][^|]*(?:\|[^|]*[^|S][^|]*){3}$".replace("S", SPACE_CLASS[1:-1])
IDENTIFIER_PATTERN = "(?i)^[a-z_$][a-z0-9_$]*$"
CJK_BLOCK_PATTERN = r"^[一-龥（）()·—\-\s]+"
BRACKET_SUFFIX_PATTERN = r"[（(].*?[）)]$"
CYCLE_PATTERN = r"^\d{4}$"
FOUR_DIGIT_RUN = r"(?<!\d)\d{4}(?!\d)"
CONTROL_PATTERN = r"[\x00-\x1F\x7F]"


def trim_u(text: Column) -> Column:
    """Trim every Unicode space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank, then trim."""
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def non_blank(text: Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(trim_u(text), F.lit(""))


def one_of(value: Column, allowed: Iterable[str]) -> Column:
    return value.isin(*allowed)


def label_of(labels: dict[str, str], key: Column) -> Column:
    """Look a label up in a small literal map."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def has_four_parts(project_id: Column) -> Column:
    """Four non-blank pipe-separated parts."""
    return project_id.rlike(FOUR_PARTS)


def first_part(project_id: Column) -> Column:
    return F.substring_index(project_id, "|", 1)


def key_cycle(project_id: Column) -> Column:
    return trim_u(first_part(project_id))


def key_is_valid(project_id: Column) -> Column:
    """Four non-blank parts, the first of them four digits."""
    return has_four_parts(project_id) & key_cycle(project_id).rlike(CYCLE_PATTERN)


def key_institute(project_id: Column) -> Column:
    return trim_u(F.regexp_extract(project_id, r"^[^|]*\|[^|]*\|([^|]*)", 1))


def cycle_of(cycle_text: Column, id_cycle: Column, is_expired: Column) -> Column:
    """The one four-digit run of the cycle text if it equals the key's cycle.

    Expired rows may leave the text out; NULL marks an ambiguous, absent or differing cycle.
    """
    runs = F.array_distinct(F.regexp_extract_all(cycle_text, F.lit(FOUR_DIGIT_RUN), F.lit(0)))
    stated = F.when(runs == F.array(id_cycle), id_cycle)
    return F.when(non_blank(cycle_text).isNotNull(), stated).when(is_expired, id_cycle)


def child_path(path: Column, key: Column) -> Column:
    """Dotted path for identifiers, bracket-quoted otherwise."""
    quoted = F.regexp_extract(F.to_json(F.struct(key.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    return F.when(key.rlike(IDENTIFIER_PATTERN), F.concat(path, F.lit("."), key)).otherwise(
        F.concat(path, F.lit("["), quoted, F.lit("]"))
    )


def index_path(path: str, position: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{path}["), position.cast("string"), F.lit(f"]{suffix}"))


def leading_cjk(name: Column) -> Column:
    """The leading CJK block of a mixed name, or the name itself."""
    block = F.regexp_extract(name, CJK_BLOCK_PATTERN, 0)
    return trim_u(F.when(block != "", block).otherwise(name))


def without_bracket_suffix(name: Column) -> Column:
    return F.regexp_replace(name, BRACKET_SUFFIX_PATTERN, "")


def diagnostic_text(message: Column) -> Column:
    """A message for a failure record: control characters blanked, 500 characters."""
    return F.substring(F.regexp_replace(message, CONTROL_PATTERN, " "), 1, 500)


def split_list(value: Column) -> Column:
    """Comma list of a shared link: trimmed, blanks dropped; NULL becomes the empty list."""
    items = F.transform(F.split(value, ","), trim_u)
    return F.coalesce(F.filter(items, lambda item: item != ""), F.array().cast("array<string>"))


def enum_list(value: Column, allowed: Iterable[str]) -> Column:
    """As ``split_list``, restricted to the allowed values, first occurrence kept."""
    return F.array_distinct(F.filter(split_list(value), lambda item: item.isin(*allowed)))


def literal_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")
