"""Rules of raw JSON documents: key sets, field types, private values, strictness.

Documents are text or VARIANT columns; free-form ones are walked by a small table function, the fixed public shape
needs none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions import privacy, text
from tidemark.functions.facts import bound, variant_type

BATCH_NODES = 50_000
LEAF_COLUMNS = ["doc_id", "path", "key", "value", "depth", "nodes"]
_LEAVES = "path string, key string, value string, depth int, nodes bigint"


Found = "array<struct<path:string,rule:string,message:string>>"


def _found(path: Column, name: str, message: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(name).alias("rule"), message.alias("message"))


def broken_keys(body: Column, path: Column, allowed: Sequence[str], required: Sequence[str]) -> Column:
    """Array of (path, rule, message) for unknown and missing keys of the object with JSON text ``body``."""
    return _broken_key_names(F.json_object_keys(body), path, allowed, required)


def _broken_object(doc: Column, path: Column, keys: Sequence[str], types: dict[str, str], more: Callable[[Column], Sequence[Column]] = lambda values: ()) -> Column:
    """``broken_keys`` (all of ``keys`` and no others) and ``broken_types`` of a VARIANT, whose values are taken out in one pass, and what ``more`` says of them."""
    return bound(F.try_variant_get(doc, "$", "map<string,variant>"), lambda values: F.concat(
        _broken_key_names(F.map_keys(values), path, keys, keys),
        _broken_type_names(lambda key: F.schema_of_variant(F.try_element_at(values, F.lit(key))), path, types), *more(values)))


def _broken_key_names(keys: Column, path: Column, allowed: Sequence[str], required: Sequence[str]) -> Column:
    unknown = F.transform(F.array_except(keys, text.literal_array(allowed)), lambda key: _found(F.concat_ws(".", path, key), "exact-keys", F.lit("unknown property")))
    missing = F.transform(F.array_except(text.literal_array(required), keys), lambda key: _found(F.concat_ws(".", path, key), "exact-keys", F.lit("missing property")))
    return F.when(keys.isNull(), F.array(_found(path, "exact-keys", F.lit("expected an object")))).otherwise(F.concat(unknown, missing)).cast(Found)


TYPE_PATTERNS = {
    "string": ("^STRING$", "expected a string"),
    "string?": ("^(STRING|VOID)$", "expected a string or null"),
    "number": ("^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "expected a finite number"),
    "number?": ("^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)", "expected a finite number or null"),
    "array": ("^ARRAY", "expected an array"),
}


def broken_types(doc: Column, path: Column, expected: dict[str, str]) -> Column:
    """Array of (path, rule, message) for the present keys of a VARIANT object without their type: string, string?, number, number?,
    array, strings (an array of them)."""
    return _broken_type_names(lambda key: variant_type(doc, key), path, expected)


def _broken_type_names(type_of: Callable[[str], Column], path: Column, expected: dict[str, str]) -> Column:
    tests = [(key, *TYPE_PATTERNS["array" if kind == "strings" else kind]) for key, kind in expected.items()]
    # only an array can have elements of a wrong type
    tests += [(key, "^(ARRAY<(STRING|VOID)>|[^A].*)$", "expected an array of strings") for key, kind in expected.items() if kind == "strings"]
    return F.array_compact(F.array(*[
        F.when(~type_of(key).rlike(pattern), _found(F.concat(path, F.lit(f".{key}")), "field-type", F.lit(message)))
        for key, pattern, message in tests
    ])).cast(Found)


def _as_rows(objects: DataFrame, found: Column) -> DataFrame:
    return objects.select("snapshotKey", F.explode(found).alias("v")).select("snapshotKey", "v.path", "v.rule", "v.message")


def key_violations(objects: DataFrame, allowed: Sequence[str], required: Sequence[str]) -> DataFrame:
    """(snapshotKey, path, json) -> unknown and missing keys of each object, as violations."""
    return _as_rows(objects, broken_keys(F.col("json"), F.col("path"), allowed, required))


def type_violations(objects: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(snapshotKey, path, doc VARIANT) -> present keys of a wrong type, see ``broken_types``."""
    return _as_rows(objects, broken_types(F.col("doc"), F.col("path"), expected))


OPPORTUNITY_TYPES = {
    **{name: "string" for name in ("projectId", "feedId", "name", "institute", "project", "eventType", "description",
                                   "verificationStatus", "deadlineOriginal", "website", "verifiedAt", "province")},
    "deadline": "string?", "deadlineEpochMs": "number?", "tags": "strings", "discoverySources": "array",
}
FEED_TYPES = {"id": "string", "label": "string", "admissionCycle": "string", "eventYear": "number"}
HEADER_TYPES = {"scanAt": "string", "defaultFeedId": "string", "feeds": "array", "opportunities": "array"}
APPROVAL_TYPES = {"snapshotId": "string", "approvedAt": "string", "previousSnapshotId": "string?", "dataHash": "string"}


def _child(doc: Column, key: str) -> Column:
    return F.try_variant_get(doc, f"$.{key}", "variant")


FACT_TYPES = {"status": "string", "summary": "string"}


def _broken_facts(values: Column, path: Column, keys: Sequence[str]) -> list[Column]:
    """Keys and types of the fact objects under ``keys`` of a map of VARIANTs; an absent one is named by its path."""
    return [_broken_object(F.try_element_at(values, F.lit(key)), F.concat(path, F.lit(f".{key}")), S.FACT_KEYS, FACT_TYPES) for key in keys]


def broken_opportunity_shape(doc: Column, path: Column, version: Column) -> Column:
    """Exact keys and types of an opportunity object and of all objects in it."""
    at = F.concat(path, F.lit(".eventArrangement"))
    link = lambda source, i: _broken_object(
        source, F.concat(path, F.lit(".discoverySources["), i.cast("string"), F.lit("]")), S.SOURCE_KEYS, {key: "string" for key in S.SOURCE_KEYS})

    def shape(values: Column) -> Column:
        keys, child = F.map_keys(values), lambda key: F.try_element_at(values, F.lit(key))
        old = _broken_key_names(keys, path, S.OPPORTUNITY_KEYS_V1 + ("province",), S.OPPORTUNITY_KEYS_V1)
        new = F.concat(
            _broken_key_names(keys, path, S.OPPORTUNITY_KEYS_V2 + ("province",), S.OPPORTUNITY_KEYS_V2),
            _broken_object(child("eventArrangement"), at, S.ARRANGEMENT_KEYS, {}, lambda parts: _broken_facts(parts, at, ("time", "formatLocation"))))
        links = F.coalesce(F.flatten(F.transform(F.try_variant_get(child("discoverySources"), "$", "array<variant>"), link)), F.array().cast(Found))
        return F.concat(
            F.when(version == 1, old).otherwise(new), *_broken_facts(values, path, ("logistics", "recommendation", "materials")),
            _broken_type_names(lambda key: F.schema_of_variant(child(key)), path, OPPORTUNITY_TYPES), links)

    return bound(F.try_variant_get(doc, "$", "map<string,variant>"), shape)


def broken_head_shape(doc: Column, approved: bool) -> Column:
    """Exact keys and types of a snapshot object, its counts and its feeds; opportunities are looked at one by one."""
    keys = S.CANDIDATE_KEYS + (S.APPROVAL_KEYS if approved else ())
    root = F.lit("snapshot")
    feed = lambda item, i: _broken_object(item, text.index_path("snapshot.feeds", i), S.FEED_KEYS, FEED_TYPES)
    feeds = F.coalesce(F.flatten(F.transform(F.try_variant_get(doc, "$.feeds", "array<variant>"), feed)), F.array().cast(Found))
    names = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    return F.concat(
        _broken_key_names(names, root, keys, keys), _broken_object(_child(doc, "counts"), F.lit("snapshot.counts"), S.COUNT_KEYS, {}),
        feeds, broken_types(doc, root, HEADER_TYPES | (APPROVAL_TYPES if approved else {})))


def document_version(doc: Column) -> Column:
    return F.when(F.try_variant_get(doc, "$.schemaVersion", "double") == 1, 1).otherwise(2)


def opportunity_items(documents: DataFrame) -> DataFrame:
    """(snapshotKey, other columns, version, pos, item VARIANT) of all opportunities of (snapshotKey, doc, ...)."""
    others = [name for name in documents.columns if name not in ("snapshotKey", "doc")]
    return documents.select("snapshotKey", *others, document_version(F.col("doc")).alias("version"), F.posexplode(F.try_variant_get("doc", "$.opportunities", "array<variant>")).alias("pos", "item"))


def shape_violations(documents: DataFrame, approved: bool) -> DataFrame:
    """(snapshotKey, doc VARIANT) of whole snapshots -> exact keys and field types at every level, in two passes: heads and opportunities."""
    rows = opportunity_items(documents)
    path = text.index_path("snapshot.opportunities", F.col("pos"))
    return _as_rows(documents, broken_head_shape(F.col("doc"), approved)).unionAll(_as_rows(rows, broken_opportunity_shape(F.col("item"), path, F.col("version"))))


# ------------------------------------------------------------------ free-form documents
def _child_path(path: str, key: str) -> str:
    plain = key.replace("$", "_").isascii() and key.replace("$", "_").isidentifier()
    return f"{path}.{key}" if plain else f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def _walk(root: object) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(path, key, leaf text or NULL, depth) of every node at any depth, without recursion."""
    stack: list[tuple[str, str | None, object, int]] = [("$", None, root, 0)]
    while stack:
        path, key, value, depth = stack.pop()
        if isinstance(value, (dict, list)):
            yield path, key, None, depth
            pairs = value.items() if isinstance(value, dict) else enumerate(value)
            named = [(_child_path(path, name) if isinstance(name, str) else f"{path}[{name}]",
                      name if isinstance(name, str) else None, child, depth + 1) for name, child in pairs]
            stack.extend(reversed(named))
        elif isinstance(value, bool) or value is None:
            yield path, key, None, depth
        elif isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
            yield path, key, str(int(value)), depth
        else:
            yield path, key, value if isinstance(value, str) else json.dumps(value), depth


def is_strict_json(body: Column) -> Column:
    """One JSON value and nothing else, no key twice in any spelling, nesting within the bound.

    A parser alone ignores what follows the first value.  Text that would close an enclosing array early breaks an
    enclosing object and the other way round, so a value which is whole inside both stands alone.
    """
    in_array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    return F.coalesce((F.size(in_array) == 1) & in_object.isNotNull() & (json_depth(body) <= S.MAX_JSON_DEPTH), F.lit(False))


def json_depth(body: Column) -> Column:
    """Nesting depth; only texts with very many brackets are looked at bracket by bracket."""
    brackets = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]+", "")
    opening = F.length(F.regexp_replace(brackets, r"[\]}]+", ""))
    level = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda state, mark: F.struct(
            (state["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(state["top"], state["now"] + F.when(mark.isin("[", "{"), 1).otherwise(0)).alias("top")),
        lambda state: state["top"])
    return F.when(opening <= S.MAX_JSON_DEPTH, F.least(opening, F.lit(S.MAX_JSON_DEPTH))).otherwise(level)


def json_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, json) -> one row for each node with path, key, scalar text, depth and the node count of its document.

    Documents which are no strict JSON are left out here; ``loose_json`` reports them.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, body in zip(batch["doc_id"], batch["json"]):
                root = json.loads(body)
                count = sum(1 for _ in _walk(root))  # stands in every row; the second walk gives the rows out in chunks
                for node in _walk(root):
                    rows.append((doc_id, *node, count))
                    if len(rows) >= BATCH_NODES:
                        yield pd.DataFrame(rows, columns=LEAF_COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=LEAF_COLUMNS)

    strict = docs.where(is_strict_json(F.col("json"))).select("doc_id", "json")
    return strict.mapInPandas(walk, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_LEAVES}")


def loose_json(docs: DataFrame) -> DataFrame:
    """Documents which a strict reader refuses: no JSON, trailing text, a repeated key in any spelling, too deep."""
    return docs.where(~is_strict_json(F.col("json"))).select("doc_id", F.lit("not strict JSON").alias("message"))


def budget_violations(leaves: DataFrame, max_nodes: int = S.MAX_SCAN_NODES, max_depth: int = S.MAX_SCAN_DEPTH) -> DataFrame:
    """Documents with more nodes or deeper nesting than the scan allows."""
    totals = leaves.groupBy("doc_id").agg(F.max("nodes").alias("n"), F.max("depth").alias("d"))
    found = F.array_compact(F.array(
        F.when(F.col("n") > max_nodes, "privacy scan exceeded node budget"),
        F.when(F.col("d") > max_depth, "privacy scan exceeded depth budget")))
    return totals.select("doc_id", F.explode(found).alias("message"))


def private_leaves(leaves: DataFrame) -> DataFrame:
    """(doc_id, path, message): private keys and private values under all their spellings."""
    found = F.array_compact(F.array(
        F.when(F.coalesce(privacy.is_private_key(F.col("key")), F.lit(False)), "private publication marker"), F.col("kind")))
    composed = privacy.with_nfkc(leaves, "key")
    return privacy.with_private_kind(composed, "value").select("doc_id", "path", F.explode(found).alias("kind")).select(
        "doc_id", "path", F.concat(F.lit("contains a "), "kind").alias("message"))


TEXT_COLUMNS = ("projectId", "feedId", "name", "institute", "project", "eventType", "description", "verificationStatus",
                "deadline", "deadlineOriginal", "website", "province", "verifiedAt")
FACT_COLUMNS = ("logistics", "recommendation", "materials", "eventArrangement.time", "eventArrangement.formatLocation")


def text_leaves() -> Column:
    """All texts of an opportunity row as array<struct<path,text>>; the fixed shape needs no walk."""
    leaf = lambda path, value: F.struct(path.alias("path"), value.alias("text"))
    fixed = [leaf(F.lit(f".{name}"), F.col(name)) for name in TEXT_COLUMNS]
    fixed += [leaf(F.lit(".deadlineEpochMs"), F.col("deadlineEpochMs").cast("string"))]
    fixed += [leaf(F.lit(f".{name}.{part}"), F.col(f"{name}.{part}")) for name in FACT_COLUMNS for part in ("status", "summary")]
    fixed += [leaf(F.lit(".eventArrangement.mode"), F.col("eventArrangement.mode"))]
    tags = F.transform("tags", lambda tag, i: leaf(F.concat(F.lit(".tags["), i.cast("string"), F.lit("]")), tag))
    links = F.flatten(F.transform("discoverySources", lambda source, i: F.array(*[
        leaf(F.concat(F.lit(".discoverySources["), i.cast("string"), F.lit(f"].{part}")), source[part])
        for part in S.SOURCE_KEYS])))
    present = lambda array: F.coalesce(array, F.array().cast("array<struct<path:string,text:string>>"))
    return F.filter(F.concat(F.array(*fixed), present(tags), present(links)), lambda item: item["text"].isNotNull())


def row_text(addresses: bool = True) -> Column:
    """All texts of ``text_leaves`` in one, so that a test which most rows fail looks at a row once; without website and source addresses on request."""
    scalar = [name for name in TEXT_COLUMNS if addresses or name != "website"]
    parts = [F.col(name) for name in scalar] + [F.col("deadlineEpochMs").cast("string"), F.col("eventArrangement.mode"), F.col("tags")]
    parts += [F.col(f"{name}.{part}") for name in FACT_COLUMNS for part in ("status", "summary")]
    parts += [F.col(f"discoverySources.{part}") for part in S.SOURCE_KEYS if addresses or part != "url"]
    return F.concat_ws("\n", *parts)


def _private_leaves_of(rows: DataFrame, leaves: Column, root: Column) -> DataFrame:
    found = rows.select("snapshotKey", root.alias("root"), F.explode(leaves).alias("leaf")).select(
        "snapshotKey", "root", "leaf.path", "leaf.text")
    return privacy.with_private_kind(found, "text").where(F.col("kind").isNotNull()).select(
        "snapshotKey", F.concat("root", "path").alias("path"), F.lit("private-value").alias("rule"),
        F.concat(F.lit("contains a "), "kind").alias("message"))


def private_row_values(opportunities: DataFrame) -> DataFrame:
    """Violations for private values in any text of a typed row."""
    # unfolded where it stands: of a column of its own the optimizer infers filters, and their constraints take minutes
    return _private_leaves_of(opportunities, row_suspects(), text.index_path("snapshot.opportunities", F.col("pos")))


def suspect_leaves(leaves: Column) -> Column:
    """The leaves which hold a private value as they stand or could in another spelling; most rows have none."""
    return F.filter(leaves, lambda leaf: privacy.has_other_spelling(leaf["text"]) | privacy.private_kind(leaf["text"]).isNotNull())


def row_suspects() -> Column:
    """``suspect_leaves`` of an opportunity row; leaves are only made where the text of the whole row may be private."""
    return F.when(privacy.may_be_private(row_text()), suspect_leaves(text_leaves())).otherwise(F.array().cast("array<struct<path:string,text:string>>"))


def private_suspects(facts: DataFrame) -> DataFrame:
    """``private_row_values`` from rows whose ``suspects`` were taken before, see ``suspect_leaves``."""
    return _private_leaves_of(facts, F.col("suspects"), text.index_path("snapshot.opportunities", F.col("pos")))


def private_head_values(headers: DataFrame, feeds: DataFrame) -> DataFrame:
    """Violations for private values in headers and feeds."""
    named = lambda columns: F.filter(F.array(*[
        F.struct(F.lit(f".{name}").alias("path"), F.col(name).cast("string").alias("text")) for name in columns]),
        lambda item: item["text"].isNotNull())
    head = _private_leaves_of(headers, named(("scanAt", "defaultFeedId") + S.APPROVAL_KEYS), F.lit("snapshot"))
    return head.unionAll(_private_leaves_of(feeds, named(S.FEED_KEYS), text.index_path("snapshot.feeds", F.col("pos"))))


def private_values(headers: DataFrame, feeds: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Violations for private values anywhere in a snapshot."""
    return private_head_values(headers, feeds).unionAll(private_row_values(opportunities))
