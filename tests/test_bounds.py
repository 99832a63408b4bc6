"""What a task or the driver holds at once stays bounded, whatever the size of the tables."""

import struct

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake import codec_queries as Q
from framelake.operators import decoding, verification
from framelake.sources import clips, fragments
from framelake.sources import packets as PK
from framelake.streaming import decoding as streaming

SF = "/root/testdata/sf0.001"


class Caught:
    """Stands for a table; keeps the function that is to be run over its batches."""

    columns = ["stream_id", "data"]

    def __init__(self, spark):
        self.sparkSession, self.ran = spark, None

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)

        def call(*args):
            if name in ("mapInArrow", "applyInPandasWithState"):
                self.ran = args[0]
            return self

        return call


def _stream(packets: int, payload: int = 8) -> bytes:
    return PK.encode_stream(PK.Stream(64, 64, 25, 1)) + PK.encode_packets([(i, PK.SHOW | PK.KEY | PK.GOLDEN, 32, struct.pack("<I", i) * (payload // 4)) for i in range(packets)])


def _sizes(run, batches):
    return [(b.num_rows, b.nbytes) for b in run(iter(batches))]


def test_scan_gives_packets_in_parts(spark):
    t = Caught(spark)
    PK.scan(t)
    got = _sizes(t.ran, [pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([_stream(10)] * 300, pa.binary())], names=["stream_id", "data"])])
    assert sum(n for n, _ in got) == 3000 and max(n for n, _ in got) <= 256


def test_events_do_not_hang_on_how_many_marks_are_looked_at():
    data = _stream(50, 16)
    broken = bytearray(data + PK.PACKET_MAGIC * 3 + _stream(60, 16)[24 + 50 * 40 : -5])
    broken[24 + 7 * 40 + 30] ^= 1
    want = PK.events(bytes(broken))
    assert [e for e, _, _ in want].count("packet") == 58 and want[-1][0] == "truncated"
    for n in (1, 2, 7, 50):
        assert list(PK.each_event(bytes(broken), at_once=n)) == want


def test_a_bookmark_is_written_and_read_once(spark):
    plan = Q._Q.QUERIES["view_fragments"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains") <= 2  # the text, and the text with a field of its own


@pytest.mark.parametrize(
    ("text", "view"),
    [("#f=7&o=mp&b=1,2", (7, ["partition", "motion"], 1)), ("##f=7", (0, ["partition"], None)), ("o=&f=1&f=2", (1, [], None)), ("f", (0, ["partition"], None)), ("of=1&o", (0, [], None)), ("s=12", None), ("f=1&f=2&s=" + "aB" * 32, None), ("f=3&s=" + "aB" * 32, (3, ["partition"], None)), ("q=1&s=" + "aB" * 32, None)],
)
def test_odd_bookmarks(spark, text, view):
    v = spark.createDataFrame([(text,)], "t string").select(fragments.decoded(F.col("t")).alias("v")).head()["v"]
    assert (v and (v["frame"], v["overlays"], v["x"])) == view


def test_pictures_are_not_broadcast(spark, monkeypatch):
    every = clips.enlarged
    monkeypatch.setattr(clips, "enlarged", lambda s, d: every(s, d).where("stream_id = 1 and frame < 2"))
    got = Q._Q.QUERIES["encode_decode"](spark, SF)
    assert [(r["frame"], r["same"], r["status"]) for r in got.orderBy("frame").collect()] == [(0, True, "shown"), (1, True, "shown")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def _packets(n: int) -> pa.RecordBatch:
    fields = {"stream_id": [1] * n, "gop": range(n), "pos": range(n), "event": ["packet"] * n, "frame_index": range(n), "expected": range(n), "key": [True] * n, "golden": [True] * n, "qp": [6] * n, "width": [64] * n, "height": [64] * n, "payload": [clips.write_payload(True, [(64, [(("intra", "dc"), {})])], None)[0]] * n}
    return pa.RecordBatch.from_pydict({k: list(v) for k, v in fields.items()})


def test_pictures_are_given_in_parts(spark):
    t = Caught(spark)
    decoding.pictures_of(t)
    got = _sizes(t.ran, [_packets(400)])
    assert sum(n for n, _ in got) == 400 and max(size for _, size in got) < 2 << 20


def test_streamed_pictures_are_given_in_parts(spark):
    class State:
        exists = False

        def update(self, value):
            self.value = value

    t, state = Caught(spark), State()
    streaming.decode(t)
    got = [len(x) for x in t.ran((1,), iter([_packets(150).to_pandas()]), state)]
    assert sum(got) == 150 and max(got) <= 64 and state.value[0] == 150


def test_payloads_are_dealt_to_every_task(spark):
    p = PK.payloads(spark.createDataFrame(pd.DataFrame({"stream_id": [1, 2], "data": [_stream(20)] * 2}), "stream_id bigint, data binary"))
    assert "BroadcastExchange" not in verification.seek_equivalence(p)._jdf.queryExecution().executedPlan().toString()
    assert decoding.pictures_of(decoding.grouped(p)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
