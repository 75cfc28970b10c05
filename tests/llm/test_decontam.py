import brute
from brute import invented
from llm_rows import SF, docs_table, rows_of  # noqa: F401

from tracegauge.llm import decontam
from tracegauge.llm.queries import QUERIES

OUT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def digests(out):
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"]).encode()), r.n_hit > 0) for r in out.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(brute.decontaminate(docs, items), key=repr)
    assert rows_of(QUERIES["op8_decontamination"](spark, SF), *OUT) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_short_null_and_repeated_items_and_rows(docs_table):
    texts = invented(11)
    docs = [(i % 40 if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[0])]
    items = [(1, texts[0]), (2, texts[0]), (2, "one"), (3, "one two"), (None, texts[5]), (4, None), (5, ""), (6, " ".join((texts[2] or "").split()[:4])), (10, texts[-4])]
    out = decontam.decontaminate(docs_table(docs), docs_table(items, id="item_id"))
    assert digests(out) == sorted(brute.decontaminate(docs, items), key=repr)


def test_empty_tables(docs_table):
    full, none = docs_table([(1, "one two")]), docs_table([(1, "x")]).limit(0)
    items = docs_table([(1, "one")], id="item_id")
    assert digests(decontam.decontaminate(none, items)) == []
    assert [r[:4] for r in digests(decontam.decontaminate(full, items.limit(0)))] == [(1, 2, 0, 0)]
