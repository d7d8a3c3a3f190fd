"""Segments leave Python some at a time."""

import pyarrow as pa
from sievelake.operators import prose as P


class Docs:
    """What mapInArrow is given."""

    def __init__(self):
        from pyspark.sql.types import StringType, StructField, StructType

        self.schema = StructType([StructField("k", StringType())])

    def select(self, *cols):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_no_batch_holds_the_segments_of_all_texts():
    text = "A sentence that is said. " * 2000
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(40)] + [None]), pa.array([text] * 40 + [None])], ["k", "t"])
    out = list(P.text_segments(Docs(), "k", "t")(iter([batch])))
    assert sum(b.num_rows for b in out) == 80_000 and max(b.num_rows for b in out) < 40_000
    whole = pa.Table.from_batches(out).to_pylist()
    assert [r["idx"] for r in whole] == list(range(2000)) * 40 and {r["n"] for r in whole} == {2000}
