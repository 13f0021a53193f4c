"""Queries on JSON lines: each line is a good record that one mutation breaks, and the SQL knows what each mutation breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.operators import json_rules as J
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query

_KNOWN = ["clean", "scam", "phishing"]
#: (what stands in a good line, what a mutation puts there, findings): a finding is (rule) or (rule, item), a warning begins with ~.
Mutation = tuple[str, str, list]

_FIRST, _SECOND = '"status_id":"1000000000000001"', '"status_id":"1000000000000002"'
THREADS: list[Mutation] = [
    ("", "", []), ('"id":"t', '"id":5,"was":"t', ["id is not a filled string"]), ('"platform":"x"', '"platform":"web"', ["platform is not x"]), ('"collected_at":"2024-01-31T10:00:00Z"', '"collected_at":"2024-02-31"', ["collected_at is no time"]),
    ('"labels":["scam"]', '"labels":null', ["labels missing"]), ('"labels":["scam"]', '"labels":"scam"', ["labels is no filled list"]), ('"labels":["scam"]', '"labels":[]', ["labels is no filled list"]),
    ('"labels":["scam"]', '"labels":["scam","clean","scam"]', ["duplicate labels"]), ('"labels":["scam"]', '"labels":["scam"," ",7]', ["label is not a filled string"]), ('"labels":["scam"]', '"labels":["scam","nonsense"]', ["unknown label"]),
    ('"tweets":[', '"posts":[', ["tweets missing"]), ('"tweets":[', '"tweets":{},"posts":[', ["tweets is no filled list"]), ('"notes":', '"notes":1,"note":', ["notes is not string"]),
    ('"role":"ai_reply"', '"role":"context"', ["no ai reply"]), (_SECOND, _FIRST, ["duplicate status id", ("its own parent", 2)]), ('"tweets":[', '"tweets":[7,', [("post is not an object", 1)]),
    (_SECOND, '"status_id":" "', [("status_id is not a filled string", 2)]), (_SECOND, '"status_id":2', [("status_id is not a filled string", 2)]), (_SECOND, '"status_id":"12"', [("~form of status_id", 2)]),
    ('"handle":"b"', '"handle":""', [("handle is not a filled string", 2)]), ('"handle":"b"', '"handle":"@b"', [("handle with @", 2)]), ('"text":"second"', '"text":null', [("text missing", 2)]), ('"text":"second"', '"text":[]', [("text is not string", 2)]),
    ('"text":"second"', '"text":"\\t"', [("~empty text", 2)]), ('"role":"original_post"', '"role":"poster"', [("unknown role", 1)]), ('"parent_status_id":"1000000000000001"', '"parent_status_id":""', [("parent is not a filled string", 2), ("unknown parent", 2)]),
    ('"parent_status_id":"1000000000000001"', '"parent_status_id":1', [("parent is not a filled string", 2)]), ('"parent_status_id":"1000000000000001"', '"parent_status_id":"9"', [("unknown parent", 2)]), ('"parent_status_id":"1000000000000001"', '"parent_status_id":null', []),
    ('"created_at":"2024-01-30"', '"created_at":"30.1.2024"', [("created_at is no time", 2)]), ('"source_url":"u"', '"source_url":{}', [("source_url is not string", 2)]), ('"display_name":"n"', '"display_name":1', [("display_name is not string", 2)]),
    ('"user_id":"1"', '"user_id":1', [("user_id is not string", 2)]), ('"bio":"b"', '"bio":false', [("bio is not string", 2)]), ('"verified":true', '"verified":"yes"', [("verified is not boolean", 2)]),
    ('"follower_count":3', '"follower_count":-3', [("follower_count is no count", 2)]), ('"following_count":3', '"following_count":3.5', [("following_count is no count", 2)]), ('"tweet_count":3', '"tweet_count":"3"', [("tweet_count is no count", 2)]),
    ('"metrics":{', '"metrics":[],"m":{', [("metrics is not object", 2)]), ('"like_count":1', '"likes":1', [("~unknown metric", 2)]), *[(f'"{m}":1', f'"{m}":-1', [(f"metrics.{m} is no count", 2)]) for m in J.METRICS],
    ('"id":"t', '"id":"twice","was":"t', ["duplicate id"]),
]

ACCOUNTS: list[Mutation] = [
    ("", "", []), ('"handle":', '"name":', ["handle missing"]), ('"handle":"', '"handle":7,"was":"', ["handle is not a filled string"]), ('"handle":"', '"handle":"@', ["handle with @"]), ('"category":"bot"', '"kind":"bot"', ["category missing"]), ('"category":"bot"', '"category":"robot"', ["unknown category"]),
    *[(f'"{f}":"text of ', f'"{f}":1,"was":"', [f"{f} is not string"]) for f in ("user_id", "display_name", "bio", "url")], ('"notes":', '"notes":[],"was":', ["notes is not string"]), *[(f'"{f}":true', f'"{f}":1', [f"{f} is not boolean"]) for f in ("verified", "suspended")],
    ('"labels":["scam"]', '"labels":"scam"', ["labels is not array"]), ('"labels":["scam"]', '"labels":["scam",null]', ["unknown label"]), ('"labels":["scam"]', '"labels":["scams"]', ["unknown label"]),
    ('"follower_count":3', '"follower_count":null', ["follower_count is no count"]), ('"following_count":3', '"following_count":-1', ["following_count is no count"]), ('"scrape_priority":"low"', '"scrape_priority":"urgent"', ["unknown priority"]),
    ('"created_at":"2024-01-01"', '"created_at":"2024"', ["created_at is no date"]), ('"collected_at":"2024-01-01"', '"collected_at":20240101', ["collected_at is no date"]),
]


def _value(f: J.Field) -> str:
    if f.path == "raw.data.referenced_tweets":
        return '[{"id":"5","type":"quoted"}]'
    if "array" in f.kinds:
        return {"string": '["1","2"]', "integer": "[1,2]", "object": "[{" + ",".join(f'"{n}":"1"' for n in f.needs) + "}]"}[f.each or "string"]
    return {"object": "{}", "boolean": "true"}.get(f.kinds[0], f'"{f.choices[0] if f.choices else 11}"')


def good_snapshot() -> dict:
    """A record with every field of the schema, as text of its values."""
    root: dict = {}
    for f in J.SNAPSHOT:
        at, *path = root, *f.path.split(".")
        for name in path[:-1]:
            at = at[name]
        at[path[-1]] = {} if any(g.path.startswith(f.path + ".") for g in J.SNAPSHOT) else _value(f)
    return root


def _json(record: dict | str) -> str:
    return record if isinstance(record, str) else "{" + ",".join(f'"{k}":{_json(v)}' for k, v in record.items()) + "}"


def snapshot_mutations() -> list[tuple[dict, list]]:
    """(record, findings): each field of another kind, away where it is required, of another form, value or size, and with items that don't do."""
    out: list[tuple[dict, list]] = [(good_snapshot(), [])]

    def put(path: str, value: str | dict | None, *rules: str) -> None:
        record = at = good_snapshot()
        *before, last = path.split(".")
        for name in before:
            at = at[name]
        if value is None:
            del at[last]
        else:
            at[last] = value
        out.append((record, list(rules)))

    put("extra", "1", "record has further fields")
    put("auth_context.token", '"t"', "auth_context has further fields")
    for f in J.SNAPSHOT:
        put(f.path, "7", f"{f.path} is not {' or '.join(f.kinds)}")
        if f.required:
            put(f.path, None, f"{f.path} missing")
        if f.each:
            other = '"x"' if f.each == "integer" else "7"
            put(f.path, f"[{other},{other}]", f"{f.path} holds other than {f.each}")
        if f.pattern:
            put(f.path, '["x1"]' if f.each else '"x1"', f"{f.path} has a wrong form")
        if f.choices:
            put(f.path, '"other"', f"{f.path} is none of its values")
        if f.sizes:
            put(f.path, "[1,2,3]" if f.each else '""', f"{f.path} has a wrong {'size' if f.each else 'length'}")
        for need in f.needs:
            put(f.path, "[{" + ",".join(f'"{n}":"{"quoted" if n == "type" else 5}"' for n in f.needs if n != need) + "}]", f"{f.path} lacks {need}")
    put("raw.data.referenced_tweets", '[{"id":"5","type":"liked"}]', "reference of another type")
    put("raw.data.referenced_tweets", '[{"id":"x","type":"quoted"}]', "reference with a wrong id")
    put("auth_context.user_id", "null")
    return out


def _broken(line: Column, m: Column, first: int, blank: bool) -> Column:
    """Three more mutations of the whole line."""
    out = F.when(m == first, F.concat(F.lit("{"), line)).when(m == first + 1, F.concat(F.lit("["), line, F.lit("]")))
    return (out.when(m == first + 2, "  ") if blank else out).otherwise(line)


_WHOLE = [["broken JSON"], ["record is not an object"], ["~blank line"]]


def _mutated(docs: DataFrame, good: Column, mutations: list[Mutation], blank: bool = True) -> DataFrame:
    size = len(mutations) + (3 if blank else 2)
    m = (F.col("doc_id") % size).cast("int")
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in mutations]), m)
    changed = F.when(pick(0) == "", good).otherwise(F.replace(good, pick(0), pick(1)))
    return docs.select(F.col("doc_id").alias("line"), _broken(F.when(m < len(mutations), changed).otherwise(good), m, len(mutations), blank).alias("value"))


def _expected(findings: list[list], size: int) -> str:
    rows = []
    for m, found in enumerate(findings):
        for f in found:
            rule, item = f if isinstance(f, tuple) else (f, None)
            rows.append(f"({m}, CAST({'NULL' if item is None else item} AS INTEGER), '{'warning' if rule[0] == '~' else 'error'}', '{rule.lstrip('~')}')")
    return f"SELECT doc_id AS line, e.item, e.severity, e.rule FROM documents JOIN (VALUES {', '.join(rows)}) e(m, item, severity, rule) ON doc_id % {size} = e.m"


def _sql(mutations: list[Mutation], blank: bool = True) -> str:
    whole = _WHOLE if blank else _WHOLE[:2]
    return _expected([f for _, _, f in mutations] + whole, len(mutations) + len(whole))


@query("validate_thread_lines", _sql(THREADS))
def validate_thread_lines(spark, sf):
    metrics = ",".join(f'"{m}":1' for m in J.METRICS)
    posts = f'"tweets":[{{{_FIRST},"handle":"a","text":"first","role":"original_post","created_at":"2024-01-30T00:00:00+01:00"}},{{{_SECOND},"handle":"b","text":"second","role":"ai_reply","parent_status_id":"1000000000000001","created_at":"2024-01-30","source_url":"u","display_name":"n","user_id":"1","bio":"b","verified":true,"follower_count":3,"following_count":3,"tweet_count":3,"metrics":{{{metrics}}}}}]'
    notes = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("notes")))
    good = F.concat(F.lit('{"id":"t'), F.col("doc_id").cast("string"), F.lit('","platform":"x","collected_at":"2024-01-31T10:00:00Z","labels":["scam"],' + posts + ","), F.substr(notes, F.lit(2)))
    return J.thread_findings(_mutated(fx.table(spark, sf, "documents"), good, THREADS), "value", "line", _KNOWN)


_AGAIN = len(ACCOUNTS)


@query("validate_account_lines", _expected([f for _, _, f in ACCOUNTS] + [[], *_WHOLE[:2]], _AGAIN + 3) + f"""
UNION ALL SELECT doc_id, CAST(NULL AS INTEGER), 'error', 'duplicate handle' FROM documents WHERE doc_id % {_AGAIN + 3} = {_AGAIN} AND doc_id > (SELECT min(doc_id) FROM documents WHERE doc_id % {_AGAIN + 3} = {_AGAIN})""")
def validate_account_lines(spark, sf):
    texts = ",".join(f'"{f}":"text of it"' for f in ("user_id", "display_name", "bio", "url"))
    fields = f'"category":"bot",{texts},"verified":true,"suspended":true,"labels":["scam"],"follower_count":3,"following_count":3,"scrape_priority":"low","created_at":"2024-01-01","collected_at":"2024-01-01",'
    notes = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("notes")))
    good = F.concat(F.lit('{"handle":"User'), F.col("doc_id").cast("string"), F.lit('",' + fields), F.substr(notes, F.lit(2)))
    docs = fx.table(spark, sf, "documents")
    lines = _mutated(docs, good, [*ACCOUNTS, ('{"handle":"User', '{"handle":"TWICE","was":"User', [])], blank=False)
    return J.account_findings(lines, "value", "line", _KNOWN)


_SNAPSHOTS = snapshot_mutations()


@query("validate_snapshot_lines", _expected([f for _, f in _SNAPSHOTS] + _WHOLE, len(_SNAPSHOTS) + 3))
def validate_snapshot_lines(spark, sf):
    m = (F.col("doc_id") % (len(_SNAPSHOTS) + 3)).cast("int")
    record = F.coalesce(F.get(F.array(*[F.lit(_json(r)) for r, _ in _SNAPSHOTS]), m), F.lit(_json(_SNAPSHOTS[0][0])))
    # the document's text is the post's, wherever the record has the good one
    text = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    whole = F.replace(record, F.lit('"text":"11"'), F.expr("substring(__t, 2, length(__t) - 2)"))
    docs = fx.table(spark, sf, "documents").withColumn("__t", text)
    lines = docs.select(F.col("doc_id").alias("line"), _broken(whole, m, len(_SNAPSHOTS), True).alias("value"))
    return J.snapshot_findings(lines, "value", "line")
