import random

import brute
import numpy as np
from llm_rows import SF, docs_table, rows_of  # noqa: F401
from pyspark.sql import functions as F

from tracegauge.llm import lines
from tracegauge.llm.queries import QUERIES

OUT = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_query_equals_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted(brute.drop_lines(docs), key=repr)
    assert rows_of(QUERIES["op9_line_templates"](spark, sf), *OUT) == want
    assert any(r[2] for r in want)


def test_templates_nulls_and_repeats(docs_table):
    r = random.Random(4)
    prose = lambda: " ".join(r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(r.randint(1, 9)))
    docs = []
    for i in range(60):
        rows = [prose() for _ in range(r.randint(0, 4))]
        if i % 3 == 0:
            rows.insert(r.randint(0, len(rows)), f"page {i} of the whole long book")
        if i % 4 == 0:
            rows.insert(r.randint(0, len(rows)), f"written for the reader by {prose().split()[0]}")
        docs.append((i % 50 if i % 13 else None, "\n".join(rows)))
    docs += [(70, None), (71, ""), (72, "\n\n"), *[(80 + i, "one copy of this text\nand its second line here") for i in range(20)]]
    out = lines.drop_lines(docs_table(docs).withColumnRenamed("a", "template"))
    assert out.columns[-3:] == ["template", "n_lines", "n_dropped"]
    got = rows_of(out.withColumn("n", F.coalesce("text", F.lit(""))).select("doc_id", F.col("text"), F.col("n_dropped"), F.sha2(F.col("n").cast("binary"), 256).alias("kept")), "doc_id", "n_dropped", "kept")
    want = sorted(((d, g, k) for d, _, g, k in brute.drop_lines(docs)), key=repr)
    assert got == want and sum(g for _, g, _ in want) > 20
    assert lines.drop_lines(docs_table(docs).limit(0)).count() == 0


def test_line_bounds_follow_rows_and_newlines():
    data = np.frombuffer(b"a\nb\n\nc\n", np.uint8)
    bounds, per_row = lines.line_offsets(data, np.array([0, 4, 4, 5, 7]))
    assert per_row.tolist() == [3, 1, 2, 2] and bounds.tolist() == [0, 2, 4, 4, 4, 5, 5, 7, 7]


def test_passages_blank_lines_and_fixed_orders_recur(docs_table):
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(4)) for _ in range(9))
    passage = ["first line of the passage", "a second line follows it", "here is the third line", "and the last of them"]
    docs = [(i, "\n".join([prose(), *passage, prose()])) for i in range(12)]
    docs += [(20 + i, "\n".join([prose(), "", "alone between two blank lines", "", prose()])) for i in range(12)]
    docs += [(40 + i, f"start of job {i} on host\nread {i} rows from the table\nend of job {i} with success") for i in range(12)]
    docs += [(60 + i, "one copy of this text\nand its second line here") for i in range(20)]
    docs += [(90 + i, "\n".join([prose(), "", "a line of fewer documents", "", prose()])) for i in range(11)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in lines.drop_lines(docs_table(docs)).collect()}
    gone = {range(1, 12): 4, range(21, 32): 1, range(41, 52): 3}
    for d, text in docs:
        n = next((k for ids, k in gone.items() if d in ids), 0)
        assert got[d][0] == n and (n or got[d][1] == text)
    assert got[1][1] == "\n".join(docs[1][1].split("\n")[::5]) and got[41][1] == ""
