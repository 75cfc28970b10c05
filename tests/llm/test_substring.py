import brute
from llm_rows import SF, docs_table, rows_of  # noqa: F401

from tracegauge.llm import substring
from tracegauge.llm.queries import QUERIES

OUT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def digests(out):
    return sorted(((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept.encode())) for r in out.collect()), key=repr)


def test_query_equals_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(brute.substring(docs), key=repr)
    assert rows_of(QUERIES["op2_substring_dedup"](spark, sf), *OUT) == want and any(r[2] for r in want)


def test_nulls_ties_repeats_and_periodic_texts(docs_table):
    docs = [(i % 50 if i % 11 else None, t) for i, t in enumerate(brute.invented(21))]
    docs += [(-5, "x y " * 60), (90, "y x " * 50), (91, "a " * 200), (92, "b a " + "a " * 30)]
    for window in (13, 4):
        assert digests(substring.remove_repeats(docs_table(docs), window)) == sorted(brute.substring(docs, window), key=repr)
    assert digests(substring.remove_repeats(docs_table(docs).limit(0))) == []
