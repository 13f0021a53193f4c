"""What moves between tasks, what a worker holds, and how often a text is searched."""

import random
import re

import pyarrow as pa

from curatrix.operators import pages, rules
from curatrix.plans import queries_text


def test_subgroup_flags_moves_no_text(spark, sf_dir):
    plan = queries_text.subgroup_flags(spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("text#" in x for x in moved)


def test_suggest_relabel_finds_the_same_term_once_a_row(spark):
    rng = random.Random(2)
    for terms in (rules.CRYPTO_TERMS, ["ab", "abc", "a", "ac", "a b", "a-b", "b"], ["a b", "a", "a b c", "ab", "b"]):
        text = [" ".join(rng.choice([*terms, "the", "on", "x"]) + rng.choice(["", "s", "-", "."]) for _ in range(rng.randrange(6))) for _ in range(3000)]
        flat, nested = (re.compile(rf"(?i)\b({x})\b") for x in (rules.alternation(terms), rules.by_beginnings(terms)))
        assert [m and m[1] for m in map(flat.search, text)] == [m and m[1] for m in map(nested.search, text)]
    df = spark.createDataFrame([("Cross-Chain BAGS", ["clean"]), ("picnic bags", ["clean"]), ("token", ["scam"]), ("0x" + "a" * 40, ["clean"]), (None, ["clean"])], "text string, labels array<string>")
    out = rules.suggest_relabel(df.selectExpr("*", "array() as addresses"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert sorted(r.reason for r in out.collect()) == ["eth_address", "keyword:cross-chain, crypto_bags_slang"]


def test_page_blocks_leave_python_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pages, "OUT_BYTES", 5000)
    html = "<p>" + "a block of some words </p><p>".join(str(k) for k in range(40)) + "</p>"
    sizes = []
    whole = spark.createDataFrame([(k, html if k % 3 else None) for k in range(60)], "page_id long, html string")

    class Seen:
        sparkSession, schema = spark, whole.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([html if k % 3 else None for k in range(60)])], names=["page_id", "html"])
            return [r for b in run([batch]) if sizes.append(b.nbytes) is None for r in b.to_pylist()]

    rows = pages.page_blocks(Seen(), "page_id", "html")
    one = pages.blocks_of(html)
    assert [(r["page_id"], r["block_no"], r["text"]) for r in rows] == [(k, n, t) for k in range(60) if k % 3 for n, t in enumerate(one)] and one
    assert max(sizes) < 12000 and len(sizes) > 10
    assert pages.page_blocks(whole, "page_id", "html").count() == 40 * len(one)
