"""What rows hold, in bytes: the bound of broadcasts and of what Python works on at once."""

import tracemalloc
import weakref

import pyarrow as pa

from tidemark.llm import common
from tidemark.llm.common import bytes_of, pieces, small, width
from tidemark.llm.suffixes import WordHashes

NESTED = "id string, s struct<a: string, b: struct<c: string, n: long>>, l array<string>, m map<string, array<string>>, k array<long>, n long"
LONG = "x" * (1 << 20)


def broadcast(df) -> bool:
    return "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()


def test_texts_count_wherever_they_stand(spark):
    plain = ("a", ("a", ("a", 1)), ["a"], {"a": ["a"]}, [1], 1)
    for at, value in enumerate([LONG, (LONG, None), ["a", LONG], {"k": [None, LONG]}]):
        row = (*plain[:at], value, *plain[at + 1 :])
        df = spark.createDataFrame([plain, row, (None,) * 6], NESTED)
        low, high = sorted(r[0] for r in df.select(width(df)).collect())[1:]
        assert low < 200 and (1 << 20) < high < (1 << 20) + 200
        assert broadcast(small(df)) and not broadcast(small(df, most=1 << 20))


def test_rows_of_structs_are_bounded_by_their_texts():
    column = pa.array([{"t": LONG, "l": [LONG]}, None, {"t": "a", "l": None}, {"t": LONG, "l": []}], pa.struct([("t", pa.string()), ("l", pa.list_(pa.string()))]))
    sizes = bytes_of(column).tolist()
    assert [s >> 20 for s in sizes] == [2, 0, 0, 1]
    maps = pa.array([[("k", LONG)], None, []], pa.map_(pa.string(), pa.string()))
    assert [s >> 20 for s in bytes_of(maps).tolist()] == [1, 0, 0]
    batch = pa.RecordBatch.from_arrays([column, pa.array(range(4))], ["s", "n"])
    assert [p.num_rows for p in pieces(batch, 1 << 20)] == [3, 1]
    assert sum(p.num_rows for p in pieces(batch.slice(1), 1 << 20)) == 3


class Known(dict):
    """A task's cache."""


def test_caches_are_gone_when_a_task_gives_memory_back(monkeypatch):
    caches, alive = [], []

    def work():
        known = Known()
        caches.append(weakref.ref(known))

        def step(batch):
            known[len(known)] = batch
            return {"n": batch.column(0)}

        return step

    monkeypatch.setattr(common, "give_back", lambda: alive.append(caches[0]() is not None))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["n"])
    out = list(common.worked(iter([batch, batch]), work, pa.schema([("n", pa.int64())])))
    assert sum(b.num_rows for b in out) == 4 and alive == [False]


def test_hashes_of_words_are_bounded_in_bytes():
    known = WordHashes()
    tracemalloc.start()
    for i in range(30):
        known.of(" ".join(f"word{i * 10_000 + j}" for j in range(10_000)))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 20 << 20
