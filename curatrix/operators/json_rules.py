"""Rules on JSON lines before any cast: a line is parsed to a VARIANT, and its fields are told by their types.

A cast loses what validation looks for: unknown fields, numbers for strings, malformed parts of a list. So a rule asks for the type at a path; lists
of records are exploded and each record is held against the rules by itself. Findings are (line, item, severity, rule), item
the place in the list from 1, null for rules on the whole line. A line may break many rules. Nothing is shuffled but keys that may repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.labels import constants
from curatrix.operators.threads import ROLES
from curatrix.operators.validation import CATEGORIES, PRIORITIES
from curatrix.sources.files import staged

Rule = tuple[str, str, Column]

# Metrics of a post; forms of ids and times.
METRICS = ["like_count", "reply_count", "repost_count", "quote_count", "view_count"]
STATUS_ID, DIGITS = r"^\d{16,20}$", r"^[0-9]+$"
_TIME = r"^\d{4}-\d\d-\d\d([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d\d(:?\d\d){0,2})?)?$"
_KINDS = {"string": "^STRING$", "boolean": "^BOOLEAN$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "object": "^OBJECT<", "array": "^ARRAY<", "null": "^VOID$"}


def part(v: Column, path: str) -> Column:
    """What is at a path, as a variant: null if nothing is, a variant null for a JSON null."""
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(part(v, path))


def there(v: Column, path: str) -> Column:
    return part(v, path).isNotNull()


def is_kind(v: Column, path: str, *kinds: str) -> Column:
    """Whether something of one of the kinds is at the path; false where nothing is."""
    return F.coalesce(kind(v, path).rlike("|".join(_KINDS[k] for k in kinds)), F.lit(False))


def text(v: Column, path: str) -> Column:
    """The string at a path; null if there is no string."""
    return F.when(is_kind(v, path, "string"), F.try_variant_get(v, f"$.{path}", "string"))


def filled(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?U)\S"), F.lit(False))


def is_time(value: Column) -> Column:
    """ISO 8601 with a calendar date, as the form and as a day that exists."""
    return F.coalesce(value.rlike(_TIME) & F.try_to_date(F.substring(value, 1, 10)).isNotNull(), F.lit(False))


def is_count(v: Column, path: str) -> Column:
    """A whole number from 0 on; true and false count as 1 and 0, as the reference's language has it."""
    return is_kind(v, path, "boolean") | (is_kind(v, path, "integer") & F.coalesce(F.try_variant_get(v, f"$.{path}", "decimal(38,0)") >= 0, F.lit(False)))


def items(v: Column, path: str) -> Column:
    return F.when(is_kind(v, path, "array"), F.try_variant_get(v, f"$.{path}", "array<variant>"))


def names(v: Column) -> Column:
    """The fields of an object."""
    return F.json_object_keys(F.to_json(v))


def optional(v: Column, fields: Sequence[str], *kinds: str) -> list[Rule]:
    return [("error", f"{f} is not {' or '.join(kinds)}", there(v, f) & ~is_kind(v, f, *kinds)) for f in fields]


def found(rows: DataFrame, line: str, rules: list[Rule], item: str | None = None) -> DataFrame:
    """(line, item, severity, rule) for each rule that holds. An outer explode: for an inner one Spark asks beforehand, by all rules once more, whether a row has any."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for s, n, c in rules]))
    place = F.col(item) if item else F.lit(None)
    return rows.select(line, place.cast("int").alias("item"), F.explode_outer(broken).alias("f")).where("f is not null").select(line, "item", "f.*")


def parsed(lines: DataFrame, value: str, line: str, blank: str | None = "warning") -> tuple[DataFrame, list[Rule]]:
    """(line, state, v), v null but for lines that hold an object, and the rules on other lines. Without `blank`, blank lines pass.

    No line is filtered out, so that each is parsed once: a filter would parse it for itself.
    """
    read = lines.select(line, F.col(value).alias("value"), F.try_parse_json(value).alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").rlike("^OBJECT"), F.lit(False))
    state = F.when(~filled(F.col("value")), "blank").when(F.col("v").isNull(), "broken").when(is_object, "object").otherwise("other")
    rules: list[Rule] = [("error", "broken JSON", F.col("state") == "broken"), ("error", "record is not an object", F.col("state") == "other")]
    if blank:
        rules.append((blank, "blank line", F.col("state") == "blank"))
    told = read.select(line, state.alias("state"), "v")
    return told.select(line, "state", F.when(F.col("state") == "object", F.col("v")).alias("v")), rules


def on(condition: Column, rules: list[Rule]) -> list[Rule]:
    return [(severity, name, condition & rule) for severity, name, rule in rules]


def repeats(rows: DataFrame, line: str, key: Column, rule: str, spare_first: bool) -> DataFrame:
    """Findings on keys that several lines have: on all of those, or on all but the first. Keys are staged, so that lines are parsed once for them; only keys that repeat meet their lines again."""
    keyed = staged(rows.select(line, key.alias("key")), "json-keys").where("key is not null")
    again = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(line).alias("first")).where("n > 1").select("key", "first")
    both = keyed.join(again, "key")
    if spare_first:
        both = both.where(F.col(line) > F.col("first"))
    return both.select(line, F.lit(None).cast("int").alias("item"), F.lit("error").alias("severity"), F.lit(rule).alias("rule"))


def label_rules(v: Column, taxonomy: Sequence[str]) -> list[Rule]:
    own = items(v, "labels")
    plain = F.transform(own, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return [
        ("error", "duplicate labels", F.size(F.array_distinct(F.transform(own, lambda x: F.to_json(x)))) < F.size(own)),
        ("error", "label is not a filled string", F.exists(plain, lambda x: ~filled(F.coalesce(x, F.lit(""))))),
        ("error", "unknown label", F.size(F.array_except(F.filter(plain, lambda x: filled(F.coalesce(x, F.lit("")))), constants(list(taxonomy)))) > 0),
    ]


def thread_findings(lines: DataFrame, value: str, line: str, taxonomy: Sequence[str]) -> DataFrame:
    """Reply threads: rules on the record, on each of its posts, and on how posts hang together."""
    rows, broken = parsed(lines, value, line)
    v, posts = F.col("v"), F.col("posts")
    has = F.coalesce(F.size(posts) > 0, F.lit(False))
    record: list[Rule] = [
        ("error", "id is not a filled string", ~filled(text(v, "id"))), ("error", "platform is not x", ~F.coalesce(text(v, "platform") == "x", F.lit(False))),
        ("error", "collected_at is no time", ~is_time(text(v, "collected_at"))),
        ("error", "labels missing", ~there(v, "labels") | is_kind(v, "labels", "null")), ("error", "labels is no filled list", there(v, "labels") & ~is_kind(v, "labels", "null") & ~F.coalesce(F.size(items(v, "labels")) > 0, F.lit(False))),
        ("error", "tweets missing", ~there(v, "tweets") | is_kind(v, "tweets", "null")), ("error", "tweets is no filled list", there(v, "tweets") & ~is_kind(v, "tweets", "null") & ~has),
        *optional(v, ["notes"], "string"), *label_rules(v, taxonomy),
    ]
    known = F.filter(F.transform(posts, lambda p: F.trim(text(p, "status_id"))), lambda x: x.isNotNull())
    roles = F.transform(posts, lambda p: text(p, "role"))
    record += [
        ("error", "no ai reply", has & ~F.coalesce(F.array_contains(roles, "ai_reply"), F.lit(False))),
        ("error", "duplicate status id", F.size(F.array_distinct("ids")) < F.size("ids")),
    ]
    # a row for the record, at 0, and one for each post: rules on both are held against a line that is parsed once
    whole = rows.select(line, "state", "v", items(v, "tweets").alias("posts"))
    whole = whole.select("*", known.alias("ids"), F.concat(F.array(F.lit(None).cast("variant")), F.coalesce(posts, F.array().cast("array<variant>"))).alias("parts"))
    each = whole.select(line, "state", "v", "posts", "ids", F.posexplode_outer("parts").alias("at", "p"))
    first = F.col("at") == 0
    each = each.select(line, "state", "at", "ids", "p", *[F.when(first, F.col(c)).alias(c) for c in ("v", "posts")], F.when(~first, F.col("at")).alias("item"))
    p = F.col("p")
    own, parent = text(p, "status_id"), text(p, "parent_status_id")
    bad_parent = there(p, "parent_status_id") & ~is_kind(p, "parent_status_id", "null") & ~filled(parent)
    metrics = F.when(is_kind(p, "metrics", "object"), names(part(p, "metrics")))
    is_object = F.coalesce(F.schema_of_variant("p").rlike("^OBJECT"), F.lit(False))
    post: list[Rule] = [
        ("error", "status_id is not a filled string", ~filled(own)), ("warning", "form of status_id", filled(own) & ~own.rlike(STATUS_ID)),
        ("error", "handle is not a filled string", ~filled(text(p, "handle"))), ("error", "handle with @", text(p, "handle").startswith("@")),
        ("error", "text missing", ~there(p, "text") | is_kind(p, "text", "null")), ("error", "text is not string", there(p, "text") & ~is_kind(p, "text", "null", "string")), ("warning", "empty text", ~filled(text(p, "text")) & is_kind(p, "text", "string")),
        ("error", "unknown role", ~F.coalesce(text(p, "role").isin(ROLES), F.lit(False))),
        ("error", "parent is not a filled string", bad_parent), ("error", "its own parent", ~bad_parent & (own == parent)), ("error", "unknown parent", parent.isNotNull() & ~F.array_contains("ids", F.trim(parent))),
        ("error", "created_at is no time", ~is_time(text(p, "created_at"))),
        *optional(p, ["source_url", "display_name", "user_id", "bio"], "string"), *optional(p, ["verified"], "boolean"),
        *[("error", f"{f} is no count", there(p, f) & ~is_count(p, f)) for f in ("follower_count", "following_count", "tweet_count")],
        *optional(p, ["metrics"], "object"), ("warning", "unknown metric", F.size(F.array_except(metrics, constants(METRICS))) > 0),
        *[("error", f"metrics.{f} is no count", metrics.isNotNull() & there(p, f"metrics.{f}") & ~is_count(p, f"metrics.{f}")) for f in METRICS],
    ]
    post = [("error", "post is not an object", ~is_object), *on(is_object, post)]
    out = found(each, line, [*on(first, [*broken, *on(F.col("state") == "object", record)]), *on(~first, post)], "item")
    return out.unionByName(repeats(rows, line, F.when(filled(text(v, "id")), F.trim(text(v, "id"))), "duplicate id", spare_first=False))


def account_findings(lines: DataFrame, value: str, line: str, taxonomy: Sequence[str]) -> DataFrame:
    """Accounts; the second and later lines of a handle, whatever its case, are duplicates."""
    rows, broken = parsed(lines, value, line, blank=None)
    v = F.col("v")
    handle = text(v, "handle")
    labels = F.transform(items(v, "labels"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    rules: list[Rule] = [
        ("error", "handle missing", ~there(v, "handle")), ("error", "handle is not a filled string", there(v, "handle") & ~filled(handle)), ("error", "handle with @", handle.startswith("@")),
        ("error", "category missing", ~there(v, "category")), ("error", "unknown category", there(v, "category") & ~F.coalesce(text(v, "category").isin(CATEGORIES), F.lit(False))),
        *optional(v, ["user_id", "display_name", "bio", "notes", "url"], "string"), *optional(v, ["verified", "suspended"], "boolean"), *optional(v, ["labels"], "array"),
        *[("error", f"{f} is no count", there(v, f) & ~is_count(v, f)) for f in ("follower_count", "following_count")],
        ("error", "unknown priority", there(v, "scrape_priority") & ~F.coalesce(text(v, "scrape_priority").isin(PRIORITIES), F.lit(False))),
        ("error", "unknown label", F.exists(labels, lambda x: ~F.coalesce(F.array_contains(constants(list(taxonomy)), x), F.lit(False)))),
        *[("error", f"{f} is no date", there(v, f) & ~F.coalesce(F.length(text(v, f)) >= 10, F.lit(False))) for f in ("created_at", "collected_at")],
    ]
    again = repeats(rows, line, F.when(handle != "", F.lower(handle)), "duplicate handle", spare_first=True)
    return found(rows, line, [*broken, *on(F.col("state") == "object", rules)]).unionByName(again)


@dataclass(frozen=True)
class Field:
    """What a schema says of a path: its kinds, and, where given, a pattern, the values it may have, the length of a string or list, and fields that each item of a list needs."""

    path: str
    kinds: tuple[str, ...]
    required: bool = False
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    sizes: tuple[int, int] | None = None
    each: str | None = None
    needs: tuple[str, ...] = ()


_OBJECTS = "entities attachments geo withheld public_metrics non_public_metrics organic_metrics promoted_metrics note_tweet article media_metadata scopes edit_controls".split()
# The schema of a snapshot of a post.
SNAPSHOT = [
    Field("snapshot_id", ("string",), True, sizes=(1, 1 << 30)), Field("retrieved_at", ("string",), True), Field("endpoint", ("string",), True, sizes=(1, 1 << 30)),
    Field("query", ("object",), True), *[Field(f"query.{k}_fields", ("array",), each="string") for k in ("tweet", "user", "media", "poll", "place")], Field("query.expansions", ("array",), each="string"),
    Field("post_id", ("string",), True, DIGITS), Field("auth_context", ("object",)), Field("auth_context.mode", ("string",), True, choices=("app_only", "user_context")), Field("auth_context.user_id", ("string", "null")),
    Field("raw", ("object",), True), Field("raw.data", ("object",), True), Field("raw.data.id", ("string",), True, DIGITS),
    *[Field(f"raw.data.{k}", ("string",)) for k in ("text", "created_at", "source", "reply_settings", "community_id", "card_uri")],
    *[Field(f"raw.data.{k}", ("string",), pattern=DIGITS) for k in ("author_id", "conversation_id", "in_reply_to_user_id")],
    Field("raw.data.lang", ("string",), sizes=(2, 16)), Field("raw.data.possibly_sensitive", ("boolean",)), Field("raw.data.edit_history_tweet_ids", ("array",), pattern=DIGITS, each="string"),
    *[Field(f"raw.data.{k}", ("object",)) for k in _OBJECTS], *[Field(f"raw.data.{k}", ("array",), each="object") for k in ("context_annotations", "suggested_source_links", "suggested_source_links_with_counts")],
    Field("raw.data.referenced_tweets", ("array",), each="object", needs=("id", "type")), Field("raw.data.display_text_range", ("array",), sizes=(2, 2), each="integer"),
    Field("raw.includes", ("object",)), *[Field(f"raw.includes.{k}", ("array",), each="object", needs=("id",)) for k in ("users", "polls", "places", "tweets")], Field("raw.includes.media", ("array",), each="object", needs=("media_key",)),
    Field("raw.errors", ("array",), each="object"), Field("raw.meta", ("object",)),
]
# Objects that may have no other fields; kinds of references.
CLOSED = {"": ["snapshot_id", "retrieved_at", "endpoint", "query", "post_id", "raw", "auth_context"], "auth_context": ["mode", "user_id"]}
REFERENCES = ["retweeted", "quoted", "replied_to"]


def _lacking(own: Column, need: str) -> Column:
    return F.exists(own, lambda x: F.schema_of_variant(x).startswith("OBJECT") & ~there(x, need))


def field_rules(v: Column, field: Field) -> list[Rule]:
    path, known = field.path, is_kind(v, field.path, *field.kinds)
    rules: list[Rule] = []
    if field.required:
        parent = path.rpartition(".")[0]
        rules.append(("error", f"{path} missing", (is_kind(v, parent, "object") if parent else F.lit(True)) & ~there(v, path)))
    rules.append(("error", f"{path} is not {' or '.join(field.kinds)}", there(v, path) & ~known))
    if "array" in field.kinds:
        own = items(v, path)
        if field.sizes:
            rules.append(("error", f"{path} has a wrong size", ~F.size(own).between(*field.sizes)))
        if field.each:
            rules.append(("error", f"{path} holds other than {field.each}", F.exists(own, lambda x: ~F.coalesce(F.schema_of_variant(x).rlike(_KINDS[field.each]), F.lit(False)))))
        if field.pattern:
            rules.append(("error", f"{path} has a wrong form", F.exists(own, lambda x: (F.schema_of_variant(x) == "STRING") & ~F.coalesce(F.try_variant_get(x, "$", "string").rlike(field.pattern), F.lit(False)))))
        return rules + [("error", f"{path} lacks {need}", _lacking(own, need)) for need in field.needs]
    value = text(v, path)
    if field.pattern:
        rules.append(("error", f"{path} has a wrong form", ~value.rlike(field.pattern)))
    if field.choices:
        rules.append(("error", f"{path} is none of its values", ~value.isin(*field.choices)))
    if field.sizes:
        rules.append(("error", f"{path} has a wrong length", ~F.length(value).between(*field.sizes)))
    return rules


def snapshot_findings(lines: DataFrame, value: str, line: str) -> DataFrame:
    """Snapshots against their schema: required fields, no further ones, kinds, forms and values."""
    rows, broken = parsed(lines, value, line)
    v = F.col("v")
    rules = [rule for field in SNAPSHOT for rule in field_rules(v, field)]
    for path, own in CLOSED.items():
        inner = names(v) if not path else F.when(is_kind(v, path, "object"), names(part(v, path)))
        rules.append(("error", f"{path or 'record'} has further fields", F.size(F.array_except(inner, constants(own))) > 0))
    references = items(v, "raw.data.referenced_tweets")
    rules += [
        ("error", "reference of another type", F.exists(references, lambda x: there(x, "type") & ~F.coalesce(text(x, "type").isin(REFERENCES), F.lit(False)))),
        ("error", "reference with a wrong id", F.exists(references, lambda x: there(x, "id") & ~F.coalesce(text(x, "id").rlike(DIGITS), F.lit(False)))),
    ]
    return found(rows, line, [*broken, *on(F.col("state") == "object", rules)])
