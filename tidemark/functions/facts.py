"""Evidence facts: mixed-type inputs, phrase rules, fact groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import non_blank, trim_u

# Evidence phrases, path shapes and markers.
UNVERIFIED_PATTERN = (
    r"未核实|待核实|待系统核实|未确认|未明确|无法核实|不确定|疑似|传闻|可能|交流群|群聊|截图|(?:请)?以[^，。；\n]*系统[^，。；\n]*为准"
)
NOT_PUBLISHED_PATTERN = r"未公布|待公布|暂未公布|未提及|未在[^，。；\n]*(?:列出|提及|说明|要求)|暂无|待定|后续通知"
UNVERIFIED_SUMMARY = "待官方公布"
NOT_PUBLISHED_SUMMARY = "未公布"
URL_TOKEN_STOP = r"\s<>\"'`，。；！？、（）()【】{}"
PATH_TOKEN_STOP = r"\s<>\"'`，。；！？、（）()\[\]【】{}"
UNIX_PATH_TOKEN = r"(?<!/)/(?!/)[^\\" + PATH_TOKEN_STOP + "]+"
UNIX_ROOTS = (
    "applications", "boot", "dev", "etc", "home", "library", "media", "mnt", "opt", "private", "proc", "root",
    "run", "srv", "sys", "tmp", "users", "usr", "var", "volumes",
)
FILE_EXTENSION = r"\.[\p{L}\p{N}][\p{L}\p{N}_-]*$"
OTHER_PATHS = (
    r"[A-Za-z]:[\\/][^" + PATH_TOKEN_STOP + "]+"
    r"|\\\\[^\\/" + PATH_TOKEN_STOP + r"]+[\\/][^" + PATH_TOKEN_STOP + "]+"
    r"|(?i:targets)[\\/][^" + PATH_TOKEN_STOP + "]+"
)
PRIVATE_MARKERS = (
    r"(?i)file://|profile_space|submittedProjectIds?|submittedIds?|PENDING_PRIVATE(?:_[A-Z0-9_]*)?|PRIVATE_[A-Z0-9_]+"
)

# A complete http(s) token with a host and without credentials.
PLAIN_URL_TOKEN = (
    r"(?i)https?://[^/?#@:|^%\\\[\]" + URL_TOKEN_STOP + r"]+(?::\d{0,5})?(?:[/?#][^" + URL_TOKEN_STOP + r"]*)?"
    r"(?![^" + URL_TOKEN_STOP + "])"
)


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN_URL_TOKEN, "")


def may_have_private_free_text(text: Column) -> Column:
    """Could any part of the text be a local path or a private marker?"""
    return text.rlike(r"[/\\]|(?i)profile_space|submitted|PRIVATE_")


def has_private_free_text(text: Column) -> Column:
    """A local path or a private marker outside of plain URLs."""
    rest = without_urls(text)
    segments = lambda token: F.filter(F.split(token, "/"), lambda part: part != "")
    unix = F.exists(
        F.regexp_extract_all(rest, F.lit(UNIX_PATH_TOKEN), F.lit(0)),
        lambda token: (F.size(segments(token)) >= 2)
        & (
            F.lower(F.get(segments(token), F.lit(0))).isin(*UNIX_ROOTS)
            | F.element_at(segments(token), -1).rlike(FILE_EXTENSION)
        ),
    )
    # One cheap test first: without a slash, a backslash or a marker nothing can match.
    return F.coalesce(may_have_private_free_text(text) & (unix | rest.rlike(OTHER_PATHS) | rest.rlike(PRIVATE_MARKERS)), F.lit(False))


def is_unverified(text: Column) -> Column:
    return text.rlike(UNVERIFIED_PATTERN)


def is_not_published(text: Column) -> Column:
    return text.rlike(NOT_PUBLISHED_PATTERN)


def variant_type(row: Column, key: str) -> Column:
    """Type text of a key of a VARIANT object; NULL when the key is absent."""
    return F.schema_of_variant(F.try_variant_get(row, f"$.{key}", "variant"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value which is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def variant_fields(row: Column, keys: Sequence[str]) -> Column:
    """The values of many keys of a VARIANT object, taken in one pass: a struct of VARIANTs, NULL where a key is absent."""
    return F.try_variant_get(row, "$", f"struct<{','.join(f'`{key}`:variant' for key in keys)}>")


def variant_text(row: Column, key: str) -> Column:
    """The text of a key which holds a non-blank string, trimmed; else NULL."""
    return text_of(F.try_variant_get(row, f"$.{key}", "variant"))


def text_of(value: Column) -> Column:
    """The text of a VARIANT which is a non-blank string, trimmed; else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", non_blank(F.try_variant_get(value, "$", "string")))


def fact_text(row: Column, key: str) -> Column:
    """String, number or list of strings as one text; other types count as absent."""
    return fact_of(F.try_variant_get(row, f"$.{key}", "variant"))


def fact_of(value: Column) -> Column:
    """``fact_text`` of a VARIANT."""
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda item: F.when(F.schema_of_variant(item) == "STRING", non_blank(F.try_variant_get(item, "$", "string"))),
    )
    return (
        F.when(kind == "STRING", non_blank(as_text))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), trim_u(as_text))
        .when(kind.startswith("ARRAY"), F.nullif(F.array_join(F.array_compact(items), "、"), F.lit("")))
    )


def with_fact_groups(rows: DataFrame, groups: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Add one struct(status, summary) for each group of (text column, label).

    Private text or an unproven phrase anywhere makes the group unverified; unpublished values are left out; labels
    are shown only in groups of more than one field.
    """
    def graded(column: str, label: str) -> Column:
        value = F.col(column)
        grade = (
            F.when(has_private_free_text(value) | is_unverified(value), 2).when(is_not_published(value), 1).otherwise(0)
        )
        return F.when(value.isNotNull(), F.struct(grade.alias("grade"), F.lit(label).alias("label"), value.alias("value")))

    rows = rows.withColumns({
        f"_facts_{name}": F.array_compact(F.array(*[graded(column, label) for column, label in fields]))
        for name, fields in groups.items()
    })

    def group(name: str, labelled: bool) -> Column:
        facts = F.col(f"_facts_{name}")
        worst = F.coalesce(F.array_max(F.transform(facts, lambda fact: fact["grade"])), F.lit(1))
        shown = F.array_join(F.transform(
            F.filter(facts, lambda fact: fact["grade"] == 0),
            lambda fact: F.concat(fact["label"], F.lit("："), fact["value"]) if labelled else fact["value"]), "；")
        proven = F.exists(facts, lambda fact: fact["grade"] == 0)
        return (
            F.when(worst == 2, fixed_fact("unverified", UNVERIFIED_SUMMARY))
            .when(proven, F.struct(F.lit("confirmed").alias("status"), shown.alias("summary")))
            .otherwise(fixed_fact("not-published", NOT_PUBLISHED_SUMMARY))
        )

    return rows.withColumns({name: group(name, len(fields) > 1) for name, fields in groups.items()}).drop(
        *[f"_facts_{name}" for name in groups])


def fixed_fact(status: str, summary: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(summary).alias("summary"))
