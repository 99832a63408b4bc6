"""Pictures of a stream while it arrives: references and contexts of a sender live from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import codec as K
from ..functions import pictures as P
from ..operators.decoding import PICTURE, decode_packet

#: Pictures given back together.
PART_ROWS = 64
STATE = "expected bigint, width int, height int, last binary, golden binary, contexts array<int>"


def _restored(state: GroupState) -> tuple[int, K.State]:
    if not state.exists:
        return 0, K.State()
    expected, width, height, last, golden, contexts = state.get
    if last is None:
        return expected, K.State()
    return expected, K.State(P.unpacked(bytes(last), width, height), P.unpacked(bytes(golden), width, height), [int(c) for c in contexts])


def decode(packets: DataFrame) -> DataFrame:
    """status and picture of every packet of a stream of ``packets.payloads`` rows, as ``operators.decoding.decode`` gives them.

    Packets of one sender must arrive in order between batches; inside a batch
    they are sorted.  State is the index expected next, both references and the
    contexts: bounded, whatever has arrived.  Pictures are given back in parts;
    Spark gathers parts up to ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows.
    """
    names = [c.split()[0] for c in PICTURE.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        expected, state = _restored(group)
        rows = []
        for row in pd.concat(list(batches)).sort_values("pos").to_dict("records"):
            status, got = decode_packet(state, {**row, "expected": expected, "payload": bytes(row["payload"]) if row["payload"] is not None else None})
            expected = row["frame_index"] + 1
            planes = [p.tobytes() for p in P.crop(got.picture, row["width"], row["height"])] if got else [None] * 3
            rows.append((key[0], row["pos"], row["frame_index"], row["key"], status, row["width"], row["height"], *planes))
            if len(rows) == PART_ROWS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if state.ready:
            height, width = state.last[0].shape
            group.update((expected, width, height, P.packed(state.last), P.packed(state.golden), list(state.contexts)))
        else:
            group.update((expected, 0, 0, None, None, None))
        yield pd.DataFrame(rows, columns=names)

    return packets.groupBy("stream_id").applyInPandasWithState(step, PICTURE, STATE, "append", GroupStateTimeout.NoTimeout)
