"""Named values kept for each session, as a stateful streaming operator.

Commands: ``session_id, seq, op, name, value``. ``set`` writes, ``default``
writes where there is none, ``update`` writes where there is one, ``delete``
removes, ``get`` reads. Every command yields the value that stands after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "session_id long, seq long, name string, value double"


def apply(values: dict, op: str, name: str, value: float | None) -> float | None:
    """Change ``values`` by one command; the value of ``name`` after it."""
    known = name in values
    if op == "set" or (op == "default" and not known) or (op == "update" and known):
        values[name] = value
    elif op == "delete":
        values.pop(name, None)
    return values.get(name)


class ValuesProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("seq", kind="stable")
        before = {k[0]: v[0] for k, v in self.values.iterator()}
        values = dict(before)
        given = [None if x != x else x for x in got["value"]]
        after = [apply(values, op, name, x) for op, name, x in zip(got["op"], got["name"], given, strict=True)]
        for name in before.keys() - values.keys():
            self.values.removeKey((name,))
        for name, x in values.items():
            if name not in before or before[name] != x:
                self.values.updateValue((name,), (x,))
        yield pd.DataFrame({"session_id": [key[0]] * len(got), "seq": got["seq"].to_numpy(), "name": got["name"].to_numpy(), "value": after})

    def close(self) -> None:
        pass


def named_values(commands: DataFrame) -> DataFrame:
    """The value after every command of the stream. Start it with the RocksDB state store (``streams.drained`` does)."""
    return commands.groupBy("session_id").transformWithStateInPandas(ValuesProcessor(), RESULT, "Append", "None")
