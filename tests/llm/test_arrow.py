import pyarrow as pa
import pytest
from pyspark.sql import types as T

from loomtrace.llm import arrow


@pytest.mark.parametrize("helper", ["map_batches", "map_rows"])
def test_memory_is_given_back_after_the_last_batch(spark, helper, monkeypatch):
    """The function that Spark would run on a task's batches, run here."""
    class Frame:
        schema = T.StructType([T.StructField("a", T.LongType())])

        def mapInArrow(self, run, _):
            return run

    said = []
    monkeypatch.setattr(arrow, "give_back", lambda: said.append("back"))
    if helper == "map_batches":
        run = arrow.map_batches(Frame(), "b bigint", lambda: lambda batches: ({"b": [x + 1 for x in b.column(0).to_pylist()]} for b in batches))
    else:
        run = arrow.map_rows(Frame(), ["a"], "b bigint", lambda: lambda b: {"b": [x + 1 for x in b.column(0).to_pylist()]})
    for out in run(iter([pa.RecordBatch.from_pydict({"a": [k]}) for k in range(3)])):
        said.append(out.column(out.num_columns - 1).to_pylist()[0])
    assert said == [1, 2, 3, "back"]
    monkeypatch.undo()
    arrow.give_back()
