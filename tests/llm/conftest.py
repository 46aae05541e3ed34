import random

import pyarrow.parquet as pq
import pytest

from routeloom.llm import runs


@pytest.fixture(scope="session")
def corpus():
    """Documents of a driver table with nulls, empty texts, repeats, near copies and shared passages added."""
    random.seed(5)
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").slice(0, 400).to_pydict()
    rows = list(zip(table["doc_id"], table["text"]))
    a, b, c = rows[3][1], rows[11][1], rows[20][1].split()
    rows += [(5000, None), (5001, ""), (5002, "x y z"), (5003, "X y  z"), (5004, "x y " * 60), (None, a), (-9, a), (5006, a[:200]), (5006, a[:200]), (5007, "\x00" * 80), (5008, "\x00" * 60)]
    rows += [(5009, "a" * 300), (5010, "a" * 120), (5011, "q " * 36), (5012, " 　é  b " * 90), (5013, "x" * 49)]
    for k in range(40):
        rows.append((6000 + k, rows[k][1][: random.randrange(400)] + b[random.randrange(300) : random.randrange(300, 900)] + rows[k + 50][1][: random.randrange(300)]))
    for k in range(60):
        w = list(c)
        for _ in range(random.randrange(9)):
            w[random.randrange(len(w))] = f"zz{random.randrange(99999)}"
        rows.append((7000 + k, " ".join(w)))
    for k in range(60):
        rows.append((8000 + k, " ".join([f"k{random.randrange(1 << 30)}" for _ in range(random.randrange(30, 60))] + c[:60])))
    return rows


@pytest.fixture
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)


@pytest.fixture(params=[64 << 10, 4 << 20])
def run_bytes(request, monkeypatch):
    """Many short runs, and one."""
    defaults = runs.Runs.__init__.__defaults__
    monkeypatch.setattr(runs.Runs.__init__, "__defaults__", (*defaults[:-1], request.param))
    return request.param
